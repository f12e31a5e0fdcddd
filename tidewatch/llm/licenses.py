"""Licence scans with a generalised suffix automaton.

The words of all licence templates make one automaton: its states are the classes of template strings that end at the same
places. A text is streamed through it, which gives matching statistics: after each word, the longest string that ends there and
stands in some template. From a state, suffix links lead to its shorter endings, and so to the longest match with every other
template; what a text shares with one template therefore does not depend on which others there are. Matches that cannot be
extended are chained, template by template, in the order of text and template, and a chain that covers enough of its template
is a span of that licence. Phrases stand in the automaton too: a phrase ends wherever the state lies below the phrase's own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import re
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PUNCTUATION, column_bytes, prefix_hash, range_hash, slices, words
from .licensetexts import TEMPLATES

#: Base phrases and their labels; each counts wherever its words stand one after another.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Words of all templates at most; the automaton, about 100 bytes a word, is sent to every task.
TEMPLATE_WORDS = 2_000_000

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass
class Automaton:
    """States in the order of a walk through the tree of suffix links, so a state's endings are a range of states and of marks."""
    size: int               # words known
    hashes: np.ndarray      # word hashes, sorted; a word's id is its place
    pairs: np.ndarray       # first id * size + second id of all neighbours in templates, sorted
    keys: np.ndarray        # state * size + word of all transitions, sorted, and a last one that is never met
    targets: np.ndarray
    link: np.ndarray
    length: np.ndarray
    last: np.ndarray        # end of the range of states below a state
    marks: np.ndarray       # template places (0.. over all templates), by the state that they end in
    first_mark: np.ndarray  # of a state, and one more
    template: np.ndarray    # template of a place
    longest: int


def _grown(texts: Sequence[Sequence[int]]) -> tuple[list[dict[int, int]], list[int], list[int], list[int]]:
    """(transitions, suffix links, lengths, state that each word ends in) of all substrings of all texts."""
    onward: list[dict[int, int]] = [{}]
    link, length, ends = [-1], [0], []

    def split(state: int, word: int, old: int) -> int:
        """A state of its own for the shorter strings of ``old``."""
        new = len(onward)
        onward.append(dict(onward[old]))
        link.append(link[old])
        length.append(length[state] + 1)
        link[old] = new
        while state >= 0 and onward[state].get(word) == old:
            onward[state][word] = new
            state = link[state]
        return new

    def extend(state: int, word: int) -> int:
        old = onward[state].get(word)
        if old is not None:
            return old if length[old] == length[state] + 1 else split(state, word, old)
        new = len(onward)
        onward.append({})
        link.append(0)
        length.append(length[state] + 1)
        while state >= 0 and word not in onward[state]:
            onward[state][word] = new
            state = link[state]
        if state >= 0:
            old = onward[state][word]
            link[new] = old if length[old] == length[state] + 1 else split(state, word, old)
        return new

    for text in texts:
        state = 0
        for word in text:
            state = extend(state, word)
            ends.append(state)
    return onward, link, length, ends


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(data, lower=True), start, end)


def automaton(texts: Sequence[str]) -> Automaton:
    """The automaton of all texts; words are compared without the case of A-Z."""
    data, offsets = column_bytes(pa.array(texts, pa.string()))
    start, end, row = words(data, offsets, PUNCTUATION)
    if len(start) > TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {TEMPLATE_WORDS} words")
    known, ids = np.unique(word_hashes(data, start, end), return_inverse=True)
    size = max(1, len(known))
    counts = np.bincount(row, minlength=len(texts))
    cut = np.cumsum(counts)[:-1]
    onward, link, length, ends = _grown([part.tolist() for part in np.split(ids, cut)])
    # Number the states anew: parents first, each with all that lies below it in one range.
    n = len(link)
    link, length = np.array(link), np.array(length)
    deep = np.argsort(length, kind="stable")
    below = np.ones(n, np.int64)
    for state in deep[:0:-1]:
        below[link[state]] += below[state]
    place, free = np.zeros(n, np.int64), np.ones(n, np.int64)
    for state in deep[1:]:
        parent = link[state]
        place[state] = free[parent]
        free[parent] += below[state]
        free[state] = place[state] + 1
    order = np.argsort(place)
    up = np.where(link[order] >= 0, place[link[order]], 0)
    moves = np.array([(place[s] * size + w, place[t]) for s, out in enumerate(onward) for w, t in out.items()] or np.zeros((0, 2)), np.int64)
    moves = moves[np.argsort(moves[:, 0])]
    ended = place[np.array(ends, np.int64)]
    marks = np.argsort(ended, kind="stable")
    same = row[1:] == row[:-1]
    return Automaton(size, known, np.unique(ids[:-1][same] * size + ids[1:][same]), np.append(moves[:, 0], np.iinfo(np.int64).max), np.append(moves[:, 1], 0), up,
                     length[order], np.arange(n) + below[order], marks, np.searchsorted(ended[marks], np.arange(n + 1)), row, int(counts.max(initial=0)))


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of each key."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def statistics(auto: Automaton, hashes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers, state, matched length) of all words where the match has two words or more.

    Such a match lies in a stretch whose neighbouring words are all neighbours in templates. The stretches are streamed side by
    side; long ones are cut into parts that start early by the longest template, and so come to the same states.
    """
    ids, there = _find(auto.hashes, hashes)
    both = there[1:] & there[:-1] & (row[1:] == row[:-1])
    both[both] = _find(auto.pairs, ids[:-1][both] * auto.size + ids[1:][both])[1]
    edge = np.diff(np.concatenate([[0], both.view(np.int8), [0]]))
    first, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1     # words first .. stop - 1
    warm, part = auto.longest, 4 * auto.longest
    pieces = np.maximum(1, -(-(stop - first) // max(1, part)))
    own = np.repeat(np.arange(len(first)), pieces)
    number = np.arange(len(own)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first[own] + number * part
    end = np.minimum(begin + part, stop[own])
    at = np.maximum(begin - warm, first[own])
    order = np.argsort(at - end, kind="stable")
    begin, end, at = begin[order], end[order], at[order]
    count = end - at
    state, length = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    all_states, all_lengths = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    for step in range(int(count.max(initial=0))):
        live = int(np.searchsorted(-count, -step, "left"))
        word = ids[at[:live] + step]
        todo = np.arange(live)
        while len(todo):
            move, hit = _find(auto.keys, state[todo] * auto.size + word[todo])
            gone = todo[hit]
            state[gone] = auto.targets[move[hit]]
            length[gone] += 1
            todo = todo[~hit]
            todo = todo[state[todo] > 0]
            state[todo] = auto.link[state[todo]]
            length[todo] = auto.length[state[todo]]
        now = at[:live] + step
        done = now >= begin[:live]
        all_states[now[done]], all_lengths[now[done]] = state[:live][done], length[:live][done]
    found = np.flatnonzero(all_lengths >= 2)
    return found, all_states[found], all_lengths[found]


def matches(auto: Automaton, word: np.ndarray, state: np.ndarray, length: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(last word, template place of it, words) of the longest match with each template at each word, where it can't be extended."""
    templates, places = int(auto.template[-1]) + 1 if len(auto.template) else 1, len(auto.template) + 1
    seen = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    keep = length >= least
    while keep.any():
        word, state, length = word[keep], state[keep], length[keep]
        low, high = auto.first_mark[state], auto.first_mark[auto.last[state]]
        count = high - low
        own = np.repeat(np.arange(len(word)), count)
        mark = auto.marks[np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + low[own]]
        key = word[own] * templates + auto.template[mark]
        new = ~_find(seen, key)[1]
        found.append((word[own][new], mark[new], length[own][new]))
        seen = np.union1d(seen, key[new])
        state = auto.link[state]
        length = auto.length[state]
        keep = length >= least
    if not found:
        return (np.zeros(0, np.int64),) * 3
    at, mark, n = (np.concatenate(x) for x in zip(*found, strict=True))
    key = at * places + mark
    whole = ~_find(np.sort(key), key + places + 1)[1]
    return at[whole], mark[whole], n[whole]


def chains(last: list[int], place: list[int], n: list[int], gap: int) -> list[tuple[int, int, int]]:
    """(first word, end word, words covered) of chains of matches with one template, in the order of ``last``.

    A match follows another that ends before it in text and template, up to ``gap`` words of text earlier; where both overlap
    in text or template, the words count once. Of the best chains, the one that covers most goes first and takes its matches.
    """
    best, back = list(n), [-1] * len(n)
    for j in range(len(n)):
        start, spot = last[j] - n[j] + 1, place[j] - n[j] + 1
        for i in range(j - 1, -1, -1):
            if last[i] < start - 1 - gap:
                break
            over = max(0, last[i] - start + 1, place[i] - spot + 1)
            if last[i] < last[j] and place[i] < place[j] and over < n[j] and last[i] - n[i] < last[j] - n[j] and best[i] + n[j] - over > best[j]:
                best[j], back[j] = best[i] + n[j] - over, i
    used, out = [False] * len(n), []
    for j in sorted(range(len(n)), key=lambda j: (-best[j], j)):
        if used[j]:
            continue
        i = j
        while not used[i]:
            used[i] = True
            if back[i] < 0 or used[back[i]]:
                break
            i = back[i]
        covered = best[j] - (best[back[i]] if back[i] >= 0 else 0)
        out.append((last[i] - n[i] + 1, last[j] + 1, covered))
    return out


def spans(found: Sequence[tuple[int, int, int, int]], sizes: np.ndarray, least_share: float) -> tuple[list[tuple[int, int, int, int]], float]:
    """(spans, best share) from (template, first word, end word, words covered) of one text's chains.

    A chain that covers ``least_share`` of its template is a span, unless more than half of its words belong to spans that cover
    more words (then more of their template, then come first).
    """
    best = max((c / sizes[t] for t, _, _, c in found), default=0.0)
    good = sorted((x for x in found if x[3] >= least_share * sizes[x[0]]), key=lambda x: (-x[3], -x[3] / sizes[x[0]], x[0], x[1]))
    if not good:
        return [], min(1.0, float(best))
    low = min(x[1] for x in good)
    taken = bytearray(max(x[2] for x in good) - low)
    out = []
    for t, a, b, c in good:
        if 2 * taken.count(1, a - low, b - low) <= b - a:
            taken[a - low:b - low] = b"\1" * (b - a)
            out.append((t, a, b, c))
    return sorted(out, key=lambda x: (x[1], x[0])), min(1.0, float(best))


SPAN = pa.struct([("label", pa.string()), ("template", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("covered", pa.int64()),
                  ("share", pa.float64())])
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                    ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(SPAN))])
COLUMNS = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
           "spans array<struct<label string, template string, first_word long, end_word long, covered long, share double>>")


@dataclass
class Scanner:
    """An automaton of templates and phrases, and what it takes to read labels off a slice of texts."""
    auto: Automaton
    templates: list[tuple[str, str]]
    sizes: np.ndarray
    phrases: list[tuple[str, int, int]]     # label, state, words
    least_match: int
    least_share: float
    gap: int

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
        """One row for each text, in the order of SCHEMA but for doc_id."""
        rows = len(offsets) - 1
        start, end, row = words(data, offsets, PUNCTUATION)
        counts = np.bincount(row, minlength=rows)
        base = np.cumsum(counts) - counts
        out = [[int(c), 0, None, None, set(), set(), 0.0, []] for c in counts]
        if not len(start):
            return [(*r[:4], "", "", 0.0, []) for r in out]
        word, state, length = statistics(self.auto, word_hashes(data, start, end), row)
        for label, at, n in self.phrases:
            places = word[(state >= at) & (state < self.auto.last[at]) & (length >= n)] - (n - 1)
            owner = row[places]
            for r, first, last, count in zip(*_ranges(owner, places - base[owner]), strict=True):
                o = out[r]
                o[1] += count
                o[2], o[3] = min(first, first if o[2] is None else o[2]), max(last, last if o[3] is None else o[3])
                o[4].add(label)
                o[6] = 1.0
        at, mark, n = matches(self.auto, word, state, length, self.least_match)
        kind = self.auto.template[mark] if len(mark) else mark
        at, n, mark, kind = (x[kind < len(self.templates)] for x in (at, n, mark, kind))
        order = np.lexsort((mark, at, kind, row[at]))
        at, n, mark, kind = at[order], n[order], mark[order], kind[order]
        owner = row[at]
        cut = np.flatnonzero((owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1])) + 1
        by_row: dict[int, list[tuple[int, int, int, int]]] = {}
        for a, b in zip(np.concatenate([[0], cut]), np.append(cut, len(at)), strict=True):
            if a < b:
                r = int(owner[a])
                got = chains((at[a:b] - base[r]).tolist(), mark[a:b].tolist(), n[a:b].tolist(), self.gap)
                by_row.setdefault(r, []).extend((int(kind[a]), *c) for c in got)
        for r, found in by_row.items():
            kept, best = spans(found, self.sizes, self.least_share)
            out[r][6] = max(out[r][6], best)
            for t, a, b, c in kept:
                label, name = self.templates[t]
                out[r][5].add(label)
                out[r][7].append({"label": label, "template": name, "first_word": a, "end_word": b, "covered": c, "share": min(1.0, float(c / self.sizes[t]))})
        return [(*r[:4], ",".join(sorted(r[4])), ",".join(sorted(r[4] | r[5])), r[6], r[7]) for r in out]


def _ranges(owner: np.ndarray, value: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """(owner, smallest value, largest value, count) from values sorted within sorted owners."""
    if not len(owner):
        return [], [], [], []
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    end = np.append(first[1:], len(owner))
    return owner[first].tolist(), value[first].tolist(), value[end - 1].tolist(), (end - first).tolist()


def scanner(templates: Sequence[tuple[str, str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, least_match: int = 4, least_share: float = 0.6,
            gap: int = 8) -> Scanner:
    """Templates are (label, name, text), phrases (words, label); a phrase has two words at least."""
    split = [[w.lower() for w in _WORD.findall(p.encode())] for p, _ in phrases]
    if any(len(p) < 2 for p in split) or least_match < 2:
        raise ValueError("a phrase and the shortest match have two words at least")
    auto = automaton([*(t for _, _, t in templates), *(p for p, _ in phrases)])
    sizes = np.bincount(auto.template, minlength=len(templates) + len(phrases)) if len(auto.template) else np.zeros(0)
    places = []
    for (text, label), found in zip(phrases, split, strict=True):
        data, offsets = column_bytes(pa.array([text]))
        start, end, _ = words(data, offsets, PUNCTUATION)
        state = 0
        for h in word_hashes(data, start, end):
            state = int(auto.targets[np.searchsorted(auto.keys, state * auto.size + np.searchsorted(auto.hashes, h))])
        places.append((label, state, len(found)))
    return Scanner(auto, [(label, name) for label, name, _ in templates], sizes, places, least_match, least_share, gap)


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, phrases: Sequence[tuple[str, str]] = PHRASES, **settings) -> DataFrame:
    """One row for each row of ``docs``: base places, labels, score and the licence spans (in words) of the whole text.

    ``score`` is the largest share of a template that one chain covers, labelled or not, and 1 with a base place. A null or empty text
    has no words, no labels and score 0; places are null without a base place. Null ids and repeated rows are rows like others.
    Columns other than doc_id and text are not read. ``settings``: least_match (words of the shortest match), least_share (of a
    template that a span covers), gap (words of text between two matches of a chain).
    """
    sent = docs.sparkSession.sparkContext.broadcast(scanner(templates, phrases, **settings))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch, "text"):
                columns = zip(*sent.value.scan(data, offsets), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first),
                                                  *(pa.array(c, f.type) for c, f in zip(columns, list(SCHEMA)[1:], strict=True))], schema=SCHEMA)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, COLUMNS)
