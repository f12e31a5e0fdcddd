"""Plain versions of the text operators, and odd rows."""

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _odd():
    random.seed(4)
    letters = ["".join(random.choice("abcdef gé\n") for _ in range(700)) for _ in range(3)]
    rows = [(1, "one two three four five six seven eight nine ten eleven", "en", "s"), (2, "one two three four five six seven eight nine ten eleven", "en", "s"),
            (3, "ONE two  three\tfour five\nsix seven eight nine ten eleven", None, None), (4, "", "en", "s"), (5, None, "en", "t"), (6, " \n\t", "de", "t"),
            (7, "word", "de", None), (8, "two words", "de", "t"), (8, "two words", "de", "t"), (None, letters[0], "en", "s"), (None, None, None, None),
            (9, letters[0], "en", "s"), (10, letters[1] + letters[1][:260], "fr", "s"), (11, letters[2], "fr", "s"), (12, letters[2][100:420], "fr", "t"),
            (13, "ab " * 400, "es", "t"), (14, "long " + " ".join(f"w{i}" for i in range(20_000)), "es", "u"), (15, "é中🙂 <|endoftext|> it's " * 20, "es", "u"),
            (16, "x" * 5000, "es", "u"), (17, letters[1][:199], None, "s"), (18, "### $$$ %%% &&& *** a b c d e f g h i j", "en", "s")]
    return [(i, t, la, s, None, "x", None, "a", None) for i, t, la, s in rows]


ODD = _odd()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingle_set(text, size):
    w = WORD.findall(lower(text))
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def near_duplicates(rows, size, percent):
    """doc_id -> (set size, component)."""
    sets = {i: shingle_set(t, size) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def repeats(rows, length):
    """(doc_id, n_bytes, n_removed, n_spans, sha256) of each row."""
    seen = Counter()
    for _, t in rows:
        b = (t or "").encode()
        seen.update(b[s:s + length] for s in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s:s + length]] > 1:
                covered[s:s + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(covered)))
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        out.append((i, len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    marked = {p for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), len(w) < 10 or 100 * len(marked) > 20 * len(w))


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
        before = now
    return before[-1]
