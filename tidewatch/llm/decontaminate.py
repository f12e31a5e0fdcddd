"""Benchmark passages in documents, by the q-gram lemma in diagonal bands and banded alignment.

An alignment of an item of n characters with at most e edits leaves at least n - q + 1 - q * e of its q-grams untouched, and these lie
on at most e + 1 neighbouring diagonals (place in the document minus place in the item). Bands of 2 * (e + 1) diagonals that
overlap by half therefore hold all of them in one band. Documents are read once: rolling hashes find the q-grams that
any item has, their diagonals are counted by item and band, bands that meet the bound and hold enough of the item's pieces of six
characters are aligned inside the band, many at once, and only alignments within the edit budget are returned. Characters are compared after Unicode normalisation and full case folding, with an
array of places back to the bytes of the text; white space is compared one for one, then with each run of it as one space: see ``find_items``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple
from unicodedata import combining, decomposition, normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, mix, powers, range_hash, slices

#: Length of the q-grams, and of those of items too short for Q to leave the whole edit budget.
Q, SHORT_Q = 12, 6
#: Edits allowed by character of an item, rounded up.
ERROR_RATE = 0.05
#: Bytes of items in one pass over the documents; more items take more passes. Only the items travel; tasks build the index, which
#: takes 30 to 60 times their bytes.
PASS_BYTES = 2 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[SPACE] = 32
_FOLD[28:32] = 32
_CODES = 0x110000


def fold(data: np.ndarray) -> np.ndarray:
    """Compared bytes of ASCII: A-Z as small letters, white space as a space, one for one."""
    return _FOLD[data]


def fold_text(text: str) -> str:
    """NFC of the full case folding, dotted and dotless i alike, each white space a space."""
    out = normalize("NFC", normalize("NFC", text).casefold()).replace("i\u0307", "i").replace("\u0131", "i")
    return "".join(" " if c.isspace() else c for c in out)


@lru_cache(1)
def _second() -> frozenset:
    """Characters that compose with the one before."""
    pairs = (decomposition(chr(c)).split() for c in range(0x30000))
    return frozenset(int(p[1], 16) for p in pairs if len(p) == 2 and p[0][0] != "<") | frozenset(range(0x1161, 0x1176)) | frozenset(range(0x11A8, 0x11C3))


class _Table:
    """Foldings of single characters, worked out when first met."""

    def __init__(self):
        self.known, self.loose = np.zeros(_CODES, bool), np.zeros(_CODES, bool)
        self.length = np.ones(_CODES, np.int8)
        self.parts = np.zeros((3, _CODES), np.uint32)

    def learn(self, codes: np.ndarray) -> None:
        new = codes[~self.known[codes]]
        for c in np.unique(new).tolist():
            out = [ord(x) for x in fold_text(chr(c))]
            self.length[c] = len(out)
            self.parts[:len(out), c] = out
            self.loose[c] = combining(chr(c)) > 0 or c in _second()
            self.known[c] = True


@lru_cache(1)
def _table() -> _Table:
    return _Table()


class Folded(NamedTuple):
    """Compared characters of a slice, the bytes where each begins and ends, and where rows begin among the characters."""
    chars: np.ndarray
    first: np.ndarray
    last: np.ndarray
    offsets: np.ndarray


def _decoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, first bytes, ends) of UTF-8; a malformed sequence is one replacement character."""
    head = (data & 0xC0) != 0x80
    inner = offsets[offsets < len(data)]
    head[inner] = True
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(data))
    lead = data[first].astype(np.uint32)
    n = last - first
    codes = np.where(lead < 0x80, lead, np.where(lead < 0xE0, lead & 0x1F, np.where(lead < 0xF0, lead & 0x0F, lead & 0x07)))
    for k in (1, 2, 3):
        more = np.flatnonzero(n > k)
        codes[more] = (codes[more] << np.uint32(6)) | (data[first[more] + k] & 0x3F)
    expected = np.where(lead < 0x80, 1, np.where(lead < 0xC2, 0, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead < 0xF5, 4, 0)))))
    codes[(n != expected) | (codes >= _CODES)] = 0xFFFD
    return codes, first, last


def folded(data: np.ndarray, offsets: np.ndarray) -> Folded:
    offsets = np.asarray(offsets, np.int64)
    if not len(data) or data.max() < 0x80:
        at = np.arange(len(data))
        return Folded(fold(data).astype(np.uint32), at, at + 1, offsets)
    codes, first, last = _decoded(data, offsets)
    table = _table()
    table.learn(codes)
    row_at = np.searchsorted(first, offsets)
    length = table.length[codes].astype(np.int64)
    joined = table.loose[codes]
    joined[row_at[:-1][row_at[:-1] < len(codes)]] = False
    replaced: list[tuple[int, list[int]]] = []
    if joined.any():
        # A character and those that may compose with it are folded together; all its bytes are one place.
        begins = np.flatnonzero(joined & ~np.append(False, joined[:-1])) - 1
        ends = np.flatnonzero(joined & ~np.append(joined[1:], False)) + 1
        last = last.copy()
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            out = [ord(c) for c in fold_text("".join(map(chr, codes[a:b].tolist())))]
            replaced.append((a, out))
            length[a:b] = 0
            length[a], last[a] = len(out), last[b - 1]
    ahead = np.concatenate([[0], np.cumsum(length)])
    origin = np.repeat(np.arange(len(codes)), length)
    chars = table.parts[np.minimum(np.arange(len(origin)) - ahead[origin], 2), codes[origin]]
    for a, out in replaced:
        chars[ahead[a]:ahead[a] + len(out)] = out
    return Folded(chars, first[origin], last[origin], ahead[row_at])


def one_space(text: Folded) -> tuple[Folded, np.ndarray]:
    """Each run of spaces of a row as its first one; and where the characters kept were."""
    space = text.chars == 32
    again = space & np.append(False, space[:-1])
    again[text.offsets[text.offsets < len(space)]] = False
    keep = ~again
    return Folded(text.chars[keep], text.first[keep], text.last[keep], np.concatenate([[0], np.cumsum(keep)])[text.offsets]), np.flatnonzero(keep)


def char_hash(chars: np.ndarray) -> np.ndarray:
    """Prefix hashes of characters, for ``range_hash``."""
    out = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((mix(chars.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)) * powers(len(chars))[0], out=out[1:])
    return out


def edit_budget(n: int, error_rate: float = ERROR_RATE, q: int = Q) -> int:
    """Edits allowed in n characters: the rate's share, and few enough for the lemma to ask for one q-gram at least."""
    return max(0, min(int(np.ceil(n * error_rate)), (n - q) // q))


@dataclass
class Index:
    """Postings of all q-grams of items; ``number`` is an item's place among all of them."""
    q: int
    number: np.ndarray
    texts: list[np.ndarray]
    budget: np.ndarray
    needed: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    posting_item: np.ndarray
    posting_at: np.ndarray
    filter_bits: int
    present: np.ndarray
    longest: int
    tiles: np.ndarray       # hashes of consecutive pieces of SHORT_Q characters, item after item, rare ones first
    tile_at: np.ndarray     # their places in the item
    first_tile: np.ndarray
    pieces: np.ndarray


@dataclass
class Exact:
    """Items of one length that are too short for q-grams, in the order of their hashes."""
    length: int
    number: np.ndarray
    texts: list[np.ndarray]
    hashes: np.ndarray


@dataclass
class Items:
    ids: list
    sizes: list[int]
    #: Edits allowed by item when runs of white space are joined.
    budget: list[int]
    #: Indexes with white space one for one; and, of items with runs of it or blanks at the ends, with each run as one space and none at the ends.
    plain: list
    joined: list
    #: Numbers of the latter items.
    changed: frozenset


def _index(numbers: list[int], texts: list[np.ndarray], error_rate: float, q: int) -> Index:
    sizes = np.array([len(t) for t in texts], np.int64)
    budget = np.array([edit_budget(int(n), error_rate, q) for n in sizes], np.int64)
    grams, item, at = [], [], []
    for k, t in enumerate(texts):
        start = np.arange(len(t) - q + 1)
        grams.append(range_hash(char_hash(t), start, start + q))
        item.append(np.full(len(start), k, np.int32))
        at.append(start.astype(np.int32))
    g, item_, at_ = np.concatenate(grams), np.concatenate(item), np.concatenate(at)
    order = np.argsort(g, kind="stable")
    distinct, first = np.unique(g[order], return_index=True)
    bits = min(24, len(distinct).bit_length() + 6)
    present = np.zeros(1 << bits, bool)
    present[(distinct >> np.uint64(64 - bits)).astype(np.int64)] = True
    pieces = sizes // SHORT_Q
    tiles = np.concatenate([range_hash(char_hash(t), np.arange(n) * SHORT_Q, np.arange(n) * SHORT_Q + SHORT_Q) for t, n in zip(texts, pieces.tolist(), strict=True)])
    first_tile = np.cumsum(pieces) - pieces
    owner = np.repeat(np.arange(len(texts)), pieces)
    _, kind, often = np.unique(tiles, return_inverse=True, return_counts=True)
    rare = np.lexsort((often[kind], owner))
    return Index(q, np.array(numbers), texts, budget, sizes - q + 1 - q * budget, distinct, np.append(first, len(g)), item_[order], at_[order], bits, present,
                 int(sizes.max()), tiles[rare], ((np.arange(len(tiles)) - first_tile[owner]) * SHORT_Q)[rare], first_tile, pieces)


def _gram(n: int, error_rate: float) -> int:
    """The q-grams' length for an item of n characters."""
    return Q if edit_budget(n, error_rate, Q) >= np.ceil(n * error_rate) else SHORT_Q


def _indexes(texts: list[np.ndarray], error_rate: float, numbers: Iterable[int]) -> list:
    lots: dict[tuple[int, int], list[int]] = {}
    for k in numbers:
        n = len(texts[k])
        lots.setdefault((_gram(n, error_rate), 0) if n >= Q else (0, n), []).append(k)
    out: list = []
    for (q, n), own in sorted(lots.items()):
        if q:
            out.append(_index(own, [texts[k] for k in own], error_rate, q))
        else:
            hashes = np.array([range_hash(char_hash(texts[k]), np.array([0]), np.array([n]))[0] for k in own], np.uint64)
            order = np.argsort(hashes, kind="stable")
            out.append(Exact(n, np.array(own)[order], [texts[own[k]] for k in order], hashes[order]))
    return out


def build_items(rows: list[tuple], error_rate: float = ERROR_RATE) -> Items:
    """Indexes of (item_id, text) rows; null and empty texts, and white space alone, are never found.

    Items shorter than Q characters are found as a whole, without edits.
    """
    kept = [(i, t.encode("utf-8", "surrogatepass")) for i, t in rows if t and not t.isspace()]
    plain = [folded(np.frombuffer(t, np.uint8), np.array([0, len(t)])) for _, t in kept]
    joined = []
    for x, _ in map(one_space, plain):
        solid = np.flatnonzero(x.chars != 32)
        joined.append(x.chars[solid[0]:solid[-1] + 1])
    chars = [x.chars for x in plain]
    changed = [k for k, (a, b) in enumerate(zip(chars, joined, strict=True)) if len(a) != len(b)]
    budget = [edit_budget(len(t), error_rate, _gram(len(t), error_rate)) for t in joined]
    return Items([i for i, _ in kept], [len(t) for _, t in kept], budget, _indexes(chars, error_rate, range(len(chars))), _indexes(joined, error_rate, changed),
                 frozenset(changed))


_ONE, _FAR = np.int64(1) << 40, np.int64(1) << 60


def align_many(patterns: np.ndarray, chars: np.ndarray, first: np.ndarray, size: np.ndarray, low: np.ndarray, width: int, budget: int) -> tuple[np.ndarray, ...]:
    """(candidate, edits, start, end) of the best alignment of each whole pattern with its text on diagonals low .. low + width - 1.

    ``first`` and ``size`` place a candidate's text among all characters. Candidates above the budget are dropped as soon as all
    their diagonals are. Of equal edits the earliest end, then the earliest start is taken; costs hold the start in their low bits.
    """
    n = patterns.shape[1]
    alive = np.arange(len(patterns))
    steps = np.arange(width)
    slope = steps * _ONE
    diagonal = low[:, None] + steps
    cost = np.where((diagonal >= 0) & (diagonal <= size[:, None]), diagonal, _FAR).astype(np.int64)
    place = low[:, None] + np.arange(width + n)
    body = np.where((place >= 0) & (place < size[:, None]), chars[np.clip(first[:, None] + place, 0, len(chars) - 1)].astype(np.int64), -1)
    for i in range(1, n + 1):
        step = cost + np.where(body[:, i - 1:i - 1 + width] == patterns[:, i - 1:i], 0, _ONE)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + _ONE)
        out = (diagonal + i < 0) | (diagonal + i > size[:, None])
        step[out] = _FAR
        cost = np.minimum.accumulate(step - slope, axis=1) + slope
        cost[out] = _FAR
        if i % 8 == 0 or i == n:
            keep = (cost.min(axis=1) >> np.int64(40)) <= budget
            if not keep.all():
                alive, cost, diagonal, body, patterns, size = (x[keep] for x in (alive, cost, diagonal, body, patterns, size))
            if not len(alive):
                break
    if not len(alive):
        return (np.zeros(0, np.int64),) * 4
    best = (cost >> np.int64(40)).argmin(axis=1)
    chosen = cost[np.arange(len(alive)), best]
    return alive, chosen >> np.int64(40), chosen & (_ONE - 1), diagonal[np.arange(len(alive)), best] + n


def align(pattern: np.ndarray, body: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best alignment of one item with a text on diagonals low..high; None above the budget."""
    one = np.array([0])
    got = align_many(np.asarray(pattern)[None, :], np.append(body, 0), one, np.array([len(body)]), np.array([low]), high - low + 1, budget)
    return tuple(int(x[0]) for x in got[1:]) if len(got[0]) else None


def _find_exact(index: Exact, text: Folded, prefix: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    start = np.arange(max(0, len(text.chars) - index.length + 1))
    hashes = range_hash(prefix, start, start + index.length)
    at = np.minimum(np.searchsorted(index.hashes, hashes), len(index.hashes) - 1)
    hit = np.flatnonzero(index.hashes[at] == hashes)
    row = np.searchsorted(text.offsets, hit, "right") - 1
    inside = hit + index.length <= text.offsets[row + 1]
    hit, row = hit[inside], row[inside]
    _, once = np.unique(row * len(index.hashes) + at[hit], return_index=True)
    found = {}
    for r, place in zip(row[once].tolist(), hit[once].tolist(), strict=True):
        k = int(at[place])
        while k < len(index.hashes) and index.hashes[k] == hashes[place]:
            if np.array_equal(index.texts[k], text.chars[place:place + index.length]):
                found[r, int(index.number[k])] = (0, place - int(text.offsets[r]), place - int(text.offsets[r]) + index.length)
            k += 1
    return found


def _counted(items: Index, row: np.ndarray, start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, band) of the bands that meet the bound, from q-gram hits (row, place in it, gram), rows rising.

    Band b of an item holds diagonals [b * width, (b + 2) * width), shifted by 2 * longest to stay above zero. Hits are taken by
    windows of a row that overlap by more than an alignment can span, and the postings of a window in lots, so that common
    grams of many items take time but no memory; counts of a window's cells are dense where they are few.
    """
    count = items.first[at + 1] - items.first[at]
    n_items, width = len(items.texts), items.budget + 1
    span = 2 * items.longest + int(width.max())
    window = max(4 * span, 1 << 14)
    met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a, b in _windows(row, start, window, span):
        reach = (int(start[b - 1]) + 2 * items.longest) // int(width.min()) + 2 - max(0, (int(start[a]) + items.longest) // int(width.max()) - 1)
        one_row = row[a] == row[b - 1]
        dense = one_row and n_items * reach <= _CELLS
        # Bands of a window differ from item to item; each item's are counted from the lowest it can meet here.
        base = np.maximum(0, (int(start[a]) + items.longest) // width - 1) if one_row else np.zeros(n_items, np.int64)
        total = np.zeros(n_items * reach, np.int32) if dense else None
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        top = (int(start[a:b].max()) + 2 * items.longest) // int(width.min()) + 2
        ahead = np.cumsum(count[a:b])
        cuts = np.searchsorted(ahead, np.arange(0, int(ahead[-1]), _LOT), "right")
        for x, y in zip((a + cuts).tolist(), [*(a + cuts[1:]).tolist(), b], strict=True):
            if x == y:
                continue
            each = np.repeat(np.arange(x, y), count[x:y])
            posting = np.arange(len(each)) + np.repeat(items.first[at[x:y]] - (np.cumsum(count[x:y]) - count[x:y]), count[x:y])
            item = items.posting_item[posting].astype(np.int64)
            band = (start[each] - items.posting_at[posting] + 2 * items.longest) // width[item]
            if dense:
                cell = item * reach + band - base[item]
                total += np.bincount(cell, minlength=len(total))[:len(total)].astype(np.int32)
            else:
                found, n = np.unique(((row[each] - row[a]) * n_items + item) * top + band, return_counts=True)
                keys, place = np.unique(np.concatenate([keys, found]), return_inverse=True)
                counts = np.bincount(place, np.concatenate([counts, n])).astype(np.int64)
        if dense:
            keys = np.flatnonzero(total)
            counts = total[keys].astype(np.int64)
            owner, band = keys // reach, keys % reach + base[keys // reach]
        else:
            owner, band = keys // top, keys % top
        # A hit counts in the band that begins at or before its diagonal's and in the one before.
        both = np.concatenate([owner * (top + 1) + band, owner * (top + 1) + np.maximum(band - 1, 0)])
        key, place = np.unique(both, return_inverse=True)
        n = np.bincount(place, np.concatenate([counts, np.where(band > 0, counts, 0)])).astype(np.int64)
        owner, band = key // (top + 1), key % (top + 1)
        good = n >= items.needed[owner % n_items]
        met.append((owner[good] // n_items + row[a], owner[good] % n_items, band[good]))
    return tuple(np.concatenate(x) for x in zip(*met, strict=True)) if met else (np.zeros(0, np.int64),) * 3


#: Dense cells of a window, and postings taken at once.
_CELLS, _LOT = 1 << 24, 1 << 21


def _windows(row: np.ndarray, start: np.ndarray, window: int, span: int) -> Iterator[tuple[int, int]]:
    """Ranges of hits: many short rows together, or overlapping windows of a long one."""
    a, end = 0, len(row)
    while a < end:
        last = int(np.searchsorted(row, row[a], "right"))
        if start[last - 1] - start[a] <= window:
            # Following rows, as long as they are short, up to about as many hits as a window has places.
            b = last
            while b < end and b - a < window:
                nxt = int(np.searchsorted(row, row[b], "right"))
                if start[nxt - 1] - start[b] > window:
                    break
                b = nxt
            yield a, b
            a = b
        else:
            x = a
            while True:
                y = min(last, int(np.searchsorted(start[x:last], start[x] + window, "right")) + x)
                yield x, y
                if y == last:
                    break
                x = max(x + 1, int(np.searchsorted(start[x:last], start[x] + window - span)) + x)
            a = last


def _merged(row: np.ndarray, item: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One start for two bands that follow each other: from it three widths of diagonals are searched."""
    order = np.lexsort((band, item, row))
    row, item, band = row[order], item[order], band[order]
    begins = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1] + 1))[:len(row)]
    place = np.arange(len(row))
    keep = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
    return row[keep], item[keep], band[keep]


def _tiles_met(items: Index, text: Folded, tiles: np.ndarray, row: np.ndarray, item: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Whether the band still can hold the item: cut into pieces of SHORT_Q characters, each edit spoils one piece at most, and the
    others stand in the text on the band's diagonals. Pieces that few items have are looked for first."""
    out = np.zeros(len(item), bool)
    lot = max(1, _LOT // int(3 * (items.budget.max(initial=0) + 1)))
    for at in range(0, len(item), lot):
        live = np.arange(at, min(len(item), at + lot))
        left = items.budget[item[live]].copy()
        for piece in range(int(items.pieces[item[live]].max(initial=0))):
            k = item[live]
            has = np.flatnonzero(items.pieces[k] > piece)
            tile = items.first_tile[k[has]] + piece
            begin, end = text.offsets[row[live[has]]], text.offsets[row[live[has]] + 1]
            width = items.budget[k[has]] + 1
            place = begin + band[live[has]] * width - 2 * items.longest + items.tile_at[tile]
            step = np.arange(int(3 * width.max(initial=0)))
            fine = (step < 3 * width[:, None]) & (step >= (begin - place)[:, None]) & (step <= (end - place)[:, None] - SHORT_Q)
            r, d = np.nonzero(fine)
            hit = np.zeros(len(has), bool)
            hit[r[tiles[place[r] + d] == items.tiles[tile[r]]]] = True
            left[has[~hit]] -= 1
            keep = left >= 0
            live, left = live[keep], left[keep]
            if not len(live):
                break
        out[live] = True
    return out


def _find(items: Index, text: Folded, prefix: np.ndarray) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(row, item number) -> (edits, start, end) in characters of the row."""
    chars, offsets, q = text.chars, text.offsets, items.q
    if len(chars) < q:
        return {}
    start = np.arange(len(chars) - q + 1)
    grams = range_hash(prefix, start, start + q)
    hit = np.flatnonzero(items.present[(grams >> np.uint64(64 - items.filter_bits)).astype(np.int64)])
    at = np.minimum(np.searchsorted(items.grams, grams[hit]), len(items.grams) - 1)
    same = items.grams[at] == grams[hit]
    hit, at = hit[same], at[same]
    row = np.searchsorted(offsets, hit, "right") - 1
    inside = hit + q <= offsets[row + 1]
    hit, at, row = hit[inside], at[inside], row[inside]
    if not len(hit):
        return {}
    row, item, band = _merged(*_counted(items, row, hit - offsets[row], at))
    if not len(row):
        return {}
    start = np.arange(len(chars) - SHORT_Q + 1)
    met = _tiles_met(items, text, range_hash(prefix, start, start + SHORT_Q), row, item, band)
    row, item, band = row[met], item[met], band[met]
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    sizes = np.array([len(t) for t in items.texts], np.int64)[item]
    for n in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == n)
        e = int(items.budget[item[own[0]]])
        lot = max(1, _LOT // (n + 3 * (e + 1)))
        for a in range(0, len(own), lot):
            c = own[a:a + lot]
            r = row[c]
            got = align_many(np.stack([items.texts[k] for k in item[c].tolist()]).astype(np.int64), chars, offsets[r], offsets[r + 1] - offsets[r],
                             band[c] * (e + 1) - 2 * items.longest, 3 * (e + 1), e)
            for x, edits, begin, end in zip(*(g.tolist() for g in got), strict=True):
                key, value = (int(r[x]), int(items.number[item[c[x]]])), (edits, begin, end)
                if key not in found or value < found[key]:
                    found[key] = value
    return found


def _search(indexes: list, text: Folded) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(row, item number) -> (edits, start, end) in characters of the slice."""
    found, prefix = {}, char_hash(text.chars)
    for index in indexes:
        for (r, k), (edits, start, end) in (_find_exact if isinstance(index, Exact) else _find)(index, text, prefix).items():
            found[r, k] = (edits, int(text.offsets[r]) + start, int(text.offsets[r]) + end)
    return found


def find_items(items: Items, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(row, item number, edits, start, end) for each row of a slice and item found in it; the best place of each.

    White space counts one for one where that is within the budget. Else each run of it in the row and the item is one space; a
    doubled one in the row is still an edit, unless all that were joined exceed the budget by themselves.
    """
    if not len(data) or not items.ids:
        return []
    text = folded(data, offsets)
    out = {at: (edits, text.first[start], text.last[end - 1]) for at, (edits, start, end) in _search(items.plain, text).items()}
    joined, origin = one_space(text)
    if items.changed or len(joined.chars) < len(text.chars):
        again = {at: got for at, got in _search(items.plain, joined).items() if at[1] not in items.changed} if len(joined.chars) < len(text.chars) else {}
        for (r, k), (edits, start, end) in (again | _search(items.joined, joined)).items():
            steps = np.diff(origin[start:end])
            if (steps - 1).sum() <= items.budget[k]:
                edits += int((steps == 2).sum())
            if (r, k) not in out and edits <= items.budget[k]:
                out[r, k] = (edits, joined.first[start], joined.last[end - 1])
    return [(r, k, edits, int(start - offsets[r]), int(end - offsets[r])) for (r, k), (edits, start, end) in sorted(out.items())]


_HELD: dict[str, Items] = {}


def _built(name: str, sent, error_rate: float) -> Items:
    """The index of a lot, built once by each Python worker; it holds the last one alone."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = build_items(sent.value, error_rate)
    return _HELD[name]


FOUND = "doc_id long, item_id long, n_edits long, start long, end long, item_bytes long"


def item_passes(benchmark: DataFrame, pass_bytes: int = PASS_BYTES) -> Iterator[list[tuple]]:
    """(item_id, text) rows in lots of about ``pass_bytes``; equal texts of several items stay items of their own."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lots = -(-total // pass_bytes)
    for k in range(lots):
        yield [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(lots)) == k).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(doc_id, item_id, n_edits, start, end, item_bytes) for each row and item it contains with at most ``edit_budget`` edits.

    Items shorter than Q characters are found without edits only. Characters are compared in NFC and by full case folding, white space being all alike and laid out in any way (see
    ``find_items``). Edits count characters; start and end count bytes of the text, item_bytes those of the item. Null and empty
    texts on either side find nothing; repeated rows are rows like others; a null id is kept as it is. Items are sent to the
    tasks in lots of a bounded size, each lot being one pass over the documents. Columns other than the ids and texts aren't read.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for rows in item_passes(benchmark, pass_bytes):
        sent, name = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            items = _built(name, sent, error_rate)
            schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "item_id", "n_edits", "start", "end", "item_bytes")])
            for batch in batches:
                ids = batch.column("doc_id")
                for first, _, data, offsets in slices(batch, "text"):
                    got = find_items(items, data, offsets)
                    columns = [pa.array([ids[first + g[0]].as_py() for g in got], pa.int64()), pa.array([items.ids[g[1]] for g in got], pa.int64()),
                               *(pa.array([g[k] for g in got], pa.int64()) for k in (2, 3, 4)), pa.array([items.sizes[g[1]] for g in got], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

        found = source.mapInArrow(run, FOUND)
        out = found if out is None else out.unionByName(found)
    return source.sparkSession.createDataFrame([], FOUND) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs``, with all their columns, that contain no item."""
    out = docs
    for rows in item_passes(benchmark, pass_bytes):
        sent, name = docs.sparkSession.sparkContext.broadcast(rows), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], sent=sent, name=name) -> Iterator[pa.RecordBatch]:
            items = _built(name, sent, error_rate)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for first, _, data, offsets in slices(batch, "text"):
                    clean[[first + g[0] for g in find_items(items, data, offsets)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
