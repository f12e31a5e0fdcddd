"""Token counts by compiled finite-state transducers, without producing tokens.

Two deterministic transducers are composed. The first splits text into pieces as the byte-level pre-tokenizer does; it has
eight states over a few character classes (what it must look ahead to is part of the class). Text is cut into chunks, each
chunk's map from entry state to exit state is computed for all entry states at once, the maps are composed by a parallel
prefix scan, and a second pass then knows every chunk's entry state and marks where pieces begin. The second counts the
tokens of a piece: after each byte the last token of the prefix's encoding is unique, namely the token that ends here and
is compatible with the last token of what precedes it. A state keeps, for every suffix that may still grow into a token, the
last token before it and its token count relative to the present; so there are finitely many, and a transition carries the
number of tokens it adds (below zero where a merge takes tokens back). States are determinised when first met and kept in
a table, through which all pieces of a slice walk together.
"""

from __future__ import annotations

import hashlib
import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

CHUNK = 64
#: States kept before the table starts anew, which bounds a worker's memory.
MAX_STATES = 400_000

# ---------------------------------------------------------------- pieces

LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, LAST_SPACE, LAST_BLANK = range(8)
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_BLANK, AFTER_SPACE, ONE_MORE, TWO_MORE = range(8)
# White space of the pre-tokenizer's pattern.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What may follow an apostrophe as a piece of its own.
ONE_LETTER, TWO_LETTERS = "stmd", ("re", "ve", "ll")


def _piece_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece begins) by symbol and state. Symbols from 8 on are the same at the start of a text."""
    to, begins = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    run_of = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}
    for state in range(8):
        for symbol in range(8):
            if symbol == LETTER and state in (ONE_MORE, TWO_MORE):
                step = (FRESH if state == ONE_MORE else ONE_MORE, False)
            elif symbol in (SHORT, LONG):
                inside = state in (IN_OTHER, AFTER_SPACE)
                step = (IN_OTHER, False) if inside else (ONE_MORE if symbol == SHORT else TWO_MORE, True)
            elif symbol in run_of:
                step = (run_of[symbol], state not in (run_of[symbol], AFTER_SPACE))
            elif symbol == BLANK:
                step = (IN_BLANK, state != IN_BLANK)
            else:
                step = (AFTER_SPACE if symbol == LAST_SPACE else FRESH, True)
            to[symbol, state], begins[symbol, state] = step
    to[8:], begins[8:] = to[:8, [FRESH]], True
    return to, begins


@lru_cache(1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or BLANK by code point."""
    kind = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    for point in range(sys.maxunicode + 1):
        first = unicodedata.category(chr(point))[0]
        if first == "L":
            kind[point] = LETTER
        elif first == "N":
            kind[point] = NUMBER
    kind[WHITE] = BLANK
    return kind


_TO, _BEGINS = _piece_machine()


def _maps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All state maps that symbols compose to: (map number by symbol, number of g after f by (f, g), exit state by (map, entry))."""
    number: dict[bytes, int] = {bytes(range(8)): 0}
    maps, at = [bytes(range(8))], 0
    symbols = [bytes(row.tolist()) for row in _TO]
    while at < len(maps):
        for g in symbols:
            f = bytes(g[x] for x in maps[at])
            if f not in number:
                number[f] = len(maps)
                maps.append(f)
        at += 1
    after = np.array([[number[bytes(g[x] for x in f)] for g in maps] for f in maps], np.uint16)
    return np.array([number[g] for g in symbols], np.uint16), after, np.array([list(f) for f in maps], np.uint8)


_MAP_OF, _AFTER, _EXIT = _maps()


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a piece begins at each code point; ``first`` marks where texts begin."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    symbol = _classes()[points]
    last = np.append(first[1:], True)
    blank = symbol == BLANK
    ends = np.flatnonzero(blank & ~np.append(blank[1:], True) & ~last)
    symbol[ends] = np.where(points[ends] == 32, LAST_SPACE, LAST_BLANK)
    for at in (quotes := np.flatnonzero((points == 39) & ~last)).tolist() if np.any(points == 39) else ():
        room = 1 if at + 2 >= n or first[at + 2] else 2
        after = "".join(map(chr, points[at + 1:at + 1 + room].tolist()))
        if after[:1] in ONE_LETTER:
            symbol[at] = SHORT
        elif after in TWO_LETTERS:
            symbol[at] = LONG
    symbol[first] += 8
    chunks = -(-n // CHUNK)
    padded = np.zeros(chunks * CHUNK, np.uint8)
    padded[:n] = symbol
    columns = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    maps = np.zeros(chunks, np.uint16)
    for column in columns:
        maps = _AFTER[maps, _MAP_OF[column]]
    # Parallel prefix scan: after the step of a width, each map covers that many chunks up to its own.
    width = 1
    while width < chunks:
        maps = np.concatenate([maps[:width], _AFTER[maps[:-width], maps[width:]]])
        width *= 2
    state = np.concatenate([[FRESH], _EXIT[maps[:-1], FRESH]]).astype(np.uint8)
    out = np.empty((CHUNK, chunks), bool)
    for k, column in enumerate(columns):
        out[k] = _BEGINS[column, state]
        state = _TO[column, state]
    return np.ascontiguousarray(out.T).ravel()[:n]


# ---------------------------------------------------------------- tokens of a piece

def _byte_letters() -> dict[str, int]:
    """The vocabulary file's printable letter of each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class TokenMachine:
    """Counts a byte-level BPE's tokens. Built from the bytes of a tokenizer file."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        #: How each token is built: (rank, left part, right part); of several ways the first.
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {}
        for (a, b), k in self.rank.items():
            self.made.setdefault(a + b, (k, a, b))
        self.spines: dict[tuple[bytes, bool], list] = {}
        self.tokens = {bytes([b]) for b in range(256)} | {a + b for a, b in self.rank}
        self.specials = [x["content"].encode() for x in spec["added_tokens"]]
        self.grows = {t[:k] for t in self.tokens for k in range(len(t))}
        self.pair_cache: dict[tuple[bytes, bytes], bool] = {}
        self.own_cache: dict[bytes, bool] = {}
        self.column = np.full(256, -1, np.intp)
        self._clear()

    def _clear(self) -> None:
        self.width = 64
        self.table = np.full((1 << 12, self.width), -1, np.int32)
        self.column[:] = -1
        self.columns = 0
        # A state: (open suffix, what precedes it as (last token, count relative to now)), longest suffix first.
        self.states: list[tuple] = [((b"", None, 0),)]
        self.number = {self.states[0]: 0}

    def encode(self, piece: bytes) -> list[bytes]:
        """The merges themselves; used on single tokens only."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best[0] == 1 << 60:
                break
            pair, out, i = (parts[best[1]], parts[best[1] + 1]), [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _fits(self, before: bytes | None, token: bytes) -> bool:
        own = self.own_cache.get(token)
        if own is None:
            own = self.own_cache[token] = self.encode(token) == [token]
        if before is None or not own:
            return own
        pair = (before, token)
        fit = self.pair_cache.get(pair)
        if fit is None:
            fit = self.pair_cache[pair] = not self._merge_across(before, token)
        return fit

    def _spine(self, token: bytes, right: bool) -> list[tuple[bytes, int, int]]:
        """What stands at one end of a token while it is built: (part, rank that makes it, rank that uses it up)."""
        out, used = [], 1 << 60
        while True:
            made = self.made.get(token)
            out.append((token, -1 if made is None else made[0], used))
            if made is None:
                return out
            used, token = made[0], made[2 if right else 1]

    def _spine_of(self, token: bytes, right: bool) -> list[tuple[bytes, int, int]]:
        if (token, right) not in self.spines:
            self.spines[token, right] = self._spine(token, right)
        return self.spines[token, right]

    def _merge_across(self, before: bytes, token: bytes) -> bool:
        """Whether a merge joins the end of ``before`` with the start of ``token`` while both are built. Of equal merges the
        left one goes first."""
        ends, starts = self._spine_of(before, True), self._spine_of(token, False)
        for x, x_made, x_used in ends:
            for y, y_made, y_used in starts:
                if (rank := self.rank.get((x, y))) is not None and max(x_made, y_made) < rank < x_used and rank <= y_used:
                    return True
        return False

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        b = bytes([byte])
        now = [(suffix + b, last, count) for suffix, last, count in self.states[state]]
        token, total = next((u, count + 1) for u, last, count in now if u in self.tokens and self._fits(last, u))
        kept = tuple((u, last, count - total) for u, last, count in now if u in self.grows) + ((b"", token, 0),)
        to = self.number.get(kept)
        if to is None:
            to = self.number[kept] = len(self.states)
            self.states.append(kept)
        return to, total

    def _learn(self, states: np.ndarray, octets: np.ndarray) -> None:
        for key in np.unique(states.astype(np.int64) * 256 + octets).tolist():
            state, byte = divmod(key, 256)
            if self.column[byte] < 0:
                self.column[byte] = self.columns
                self.columns += 1
                if self.columns > self.width:
                    self.table = np.concatenate([self.table, np.full_like(self.table, -1)], axis=1)
                    self.width *= 2
            to, added = self._step(state, byte)
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
            self.table[state, self.column[byte]] = to << 6 | (added + 40)

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[start:end]."""
        if len(self.states) > MAX_STATES:
            self._clear()
            self.pair_cache.clear()
        length = end - start
        longest = int(length.max()) if len(length) else 0
        by_length = np.argsort((longest - length).astype(np.uint16) if longest < 1 << 16 else -length, kind="stable")
        begin, length = start[by_length], length[by_length]
        state, total = np.zeros(len(start), np.int32), np.zeros(len(start), np.int64)
        waiting = np.searchsorted(-length, -np.arange(1, longest + 1), "right")
        for k, m in enumerate(waiting.tolist()):
            octets = data[begin[:m] + k]
            column = self.column[octets]
            step = np.where(column >= 0, self.table[state[:m], column], -1)
            missing = np.flatnonzero(step < 0)
            if len(missing):
                self._learn(state[missing], octets[missing])
                step[missing] = self.table[state[missing], self.column[octets[missing]]]
            state[:m] = step >> 6
            total[:m] += (step & 63) - 40
        out = np.empty_like(total)
        out[by_length] = total
        return out


_MACHINES: dict[bytes, TokenMachine] = {}


def machine(file: bytes) -> TokenMachine:
    key = hashlib.sha256(file).digest()
    if key not in _MACHINES:
        _MACHINES[key] = TokenMachine(file)
    return _MACHINES[key]


def count_slice(tokens: TokenMachine, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each text of a slice. A special token's string is one token and parts the text around it."""
    rows = len(offsets) - 1
    out = np.zeros(rows, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    whole = np.zeros(len(data), bool)
    raw = data.tobytes()
    for special in tokens.specials:
        at = raw.find(special)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            if at + len(special) <= offsets[row + 1]:
                first[[at, at + len(special)]] = True
                whole[at:at + len(special)] = True
                out[row] += 1
                at = raw.find(special, at + len(special))
            else:
                at = raw.find(special, at + 1)
    start = lead[piece_starts(points, first[lead])]
    end = np.append(start[1:], len(data))
    keep = ~whole[start] if len(start) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    counted = tokens.counts(data, start, end)
    return out + np.bincount(np.searchsorted(offsets, start, "right") - 1, weights=counted, minlength=rows).astype(np.int64)


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row.

    ``tokenizer_path`` names a byte-level BPE file on the driver; its bytes (the size of a vocabulary) are broadcast. A null or
    empty text has no tokens; repeated rows and null ids are rows like others. Columns other than doc_id and text are not read.
    """
    with open(tokenizer_path, "rb") as f:
        file = docs.sparkSession.sparkContext.broadcast(f.read())
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = machine(file.value)
        for batch in batches:
            for first, last, data, offsets in slices(batch, "text"):
                n = count_slice(tokens, data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, last - first), pa.array(np.diff(offsets)), pa.array(n),
                                                  pa.array(n > limit)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
