"""A hashed maximum-entropy language model with class-factored softmax.

P(token | history) is a softmax over tokens with weight log S + log(1 + c / (M * S)), where S = P(class | history) * P(token | class)
and c counts the observed n-gram feature (context, token) in the training rows. Its normaliser is known in closed form, since
tokens that never followed the context keep S and the others add up to the context's own count n: P = (M * S + c) / (M + n).

* The class factor is a softmax over sums of hashed weight rows, one for each active feature: the token before (bigram), the two
  before together (trigram), and the one before the last alone (skip). A token's class is a hash of its last bytes, so it needs
  no table. The weights are trained by distributed gradient updates: in each round tasks start from the same weights, walk all
  blocks in minibatches with row-wise adaptive steps, and Spark averages what they changed. The rows of the table grow with
  the square root of the training tokens up to MAX_ROWS, which bounds what is broadcast (52 MB).
* The n-gram features skip over short words: a context is the last word of more than SHORT bytes and the short words after it. Their
  counts, and those of words, grow with the corpus. They stay distributed: each block of whole texts asks for its different codes,
  sorted and packed; the tasks that own a range of codes count them and answer in the order asked.
* M is chosen for each size of n, by the likelihood of all training tokens, each left out of its own counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SLICE_BYTES, mix, powers, prefix_hash, range_hash, slices, words, written

CLASSES = 32
#: Weight rows of each of the three features, at least and at most.
LEAST_ROWS, MAX_ROWS = 256, 1 << 17
FEATURES = 3
#: Bytes of a word that a context reaches over.
SHORT = 3
#: Weights M of a context's own counts to choose from, and the counts n at which another choice begins.
GRID = (0.25, 1.0, 4.0, 16.0, 64.0, 256.0, 1024.0, 4096.0)
SIZES = (8, 512)
#: Bytes of text in a block, tokens scored at once, and bytes of text whose codes are counted in one group.
BLOCK_BYTES, BATCH_TOKENS, PART_BYTES = 8 << 20, 1 << 11, 16 << 20
#: Passes of training over all blocks, tokens of a gradient step, and step size.
ROUNDS, STEP_TOKENS, RATE = 2, 2048, 0.5
#: Weight rows that travel together when changes are averaged.
SEGMENT = 512
_END = np.uint64(0x5EED0E0D0C0B0A09)
_START = np.uint64(0x1234567890ABCDEF)
_BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("packed", pa.binary())])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts in the order they come, BLOCK_BYTES to a block; a longer text makes its block longer."""
    part, number = TaskContext.get().partitionId(), 0
    packer = zstandard.ZstdCompressor(level=1)
    ids: list = []
    held: list = []
    lengths: list[int] = []
    text: list[bytes] = []
    size = 0

    def made() -> pa.RecordBatch:
        nonlocal number, size
        out = pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                                          pa.array([lengths], pa.list_(pa.int64())), pa.array([packer.compress(b"".join(text))], pa.binary())], schema=_BLOCKS)
        number, size = number + 1, 0
        for x in (ids, held, lengths, text):
            x.clear()
        return out

    for batch in batches:
        own_ids, own_held = batch.column("doc_id"), batch.column("held")
        for first, last, data, offsets in slices(batch, "text"):
            ids += own_ids.slice(first, last - first).to_pylist()
            held += own_held.slice(first, last - first).to_pylist()
            lengths += np.diff(offsets).tolist()
            text.append(data.tobytes())
            size += len(data)
            if size >= BLOCK_BYTES:
                yield made()
    if ids:
        yield made()


class Tokens:
    """The tokens of a block: hash, class, row of each, and whether it is a short word; a row's words, then its end."""

    def __init__(self, packed: bytes, lengths: np.ndarray):
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        rows = len(lengths)
        hashes, classes, owners, sizes = [], [], [], []
        first = 0
        while first < rows:
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1)
            part, at = data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
            start, end, row = words(part, at)
            prefix = prefix_hash(part, lower=True)
            hashes.append(range_hash(prefix, start, end))
            tail = np.zeros(len(start), np.uint32)
            for k in range(1, 4):
                tail = tail * np.uint32(256) + np.where(end - k >= start, LOWER[part[np.maximum(end - k, 0)]], 0).astype(np.uint32)
            classes.append((((tail * np.uint32(0x9E3779B1)) >> np.uint32(12)) % np.uint32(CLASSES - 1) + np.uint32(1)).astype(np.uint8))
            owners.append(row + first)
            sizes.append(end - start <= SHORT)
            first = last
        h, c, r, short = (np.concatenate(x) for x in (hashes, classes, owners, sizes))
        count = np.bincount(r, minlength=rows)
        self.first = np.concatenate([[0], np.cumsum(count + 1)])
        n = int(self.first[-1])
        ends = self.first[1:] - 1
        word = np.ones(n, bool)
        word[ends] = False
        self.hash, self.cls = np.full(n, _END), np.zeros(n, np.uint8)
        self.hash[word], self.cls[word] = h, c
        self.short = np.zeros(n, bool)
        self.short[word] = short
        self.row = np.repeat(np.arange(rows), count + 1)

    def contexts(self, rows: int) -> np.ndarray:
        """Weight rows of the active features of each token (tokens x FEATURES)."""
        n = len(self.hash)
        one, two = np.full(n, _START), np.full(n, _START)
        one[1:], two[2:] = self.hash[:-1], self.hash[:-2]
        starts = self.first[:-1]
        one[starts] = _START
        two[starts] = _START
        second = starts[np.diff(self.first) > 1] + 1
        two[second] = _START
        out = np.empty((n, FEATURES), np.int32)
        for k, x in enumerate((one, mix(one * np.uint64(3) + two), mix(two ^ np.uint64(0x77)))):
            out[:, k] = ((x >> np.uint64(20)) & np.uint64(rows - 1)) + np.uint64(k * rows)
        return out

    def ngrams(self) -> np.ndarray:
        """The n-gram feature of each token: its context, which is the last long word before it or else the row's start, and the
        short words since then, and the token."""
        n = len(self.hash)
        power, inverse = powers(n + 1)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self.hash * power[:n], out=prefix[1:])
        anchor = ~self.short
        anchor[self.first[:-1]] = True
        since = np.maximum.accumulate(np.where(anchor, np.arange(n), 0))
        context = mix((prefix[1:] - prefix[since]) * inverse[since] + (np.arange(n) - since).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        # A chain that begins with a short word begins with its row.
        context[self.short[since]] ^= _START
        before = np.full(n, _START)
        before[1:] = context[:-1]
        before[self.first[:-1]] = _START
        return mix(before * np.uint64(0x9FB21C651E98DF25) + self.hash)

    def codes(self) -> np.ndarray:
        """What a block asks for: the words, then the n-grams of all tokens. Bit 6 tells words, whose class is in bits 1 to 5; bit 0 is
        free. So words are told apart by 57 bits of their hash."""
        words = (self.hash & ~np.uint64(127)) | (self.cls.astype(np.uint64) << np.uint64(1)) | np.uint64(64)
        return np.concatenate([words, self.ngrams() & ~np.uint64(65)])

    def counts(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of each token, of its n-gram and of that one's context, from those of ``codes``. Whatever isn't a row's end has one
        token after it, so a context's count is that of its long word, or of the n-gram that ends in its last short one; rows
        start as often as they end."""
        n = len(self.hash)
        word, gram = total[:n], total[n:]
        context = np.empty(n, np.int64)
        context[1:] = np.where(self.short[:-1], gram[:-1], word[:-1])
        context[self.first[:-1]] = word[self.first[1:] - 1]
        return word, gram, context


def feature_rows(train_tokens: int) -> int:
    """Weight rows of a feature: the square root of the training tokens as a power of two, from LEAST_ROWS to MAX_ROWS."""
    return min(MAX_ROWS, max(LEAST_ROWS, 1 << int(train_tokens).bit_length() // 2))


def _logits(weights: np.ndarray, bias: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Sums of weights, moved by each row's maximum only where exponentials need it."""
    z = weights.take(contexts[:, 0], 0)
    for k in range(1, FEATURES):
        z += weights.take(contexts[:, k], 0)
    z += bias
    if len(z) and (z.max() > 60 or z.min() < -60):
        z -= z.max(1, keepdims=True)
    return z


def log_class(weights: np.ndarray, bias: np.ndarray, contexts: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """log P(class | history) of each token."""
    out = np.empty(len(cls))
    one = np.ones(CLASSES, np.float32)
    for i in range(0, len(cls), BATCH_TOKENS):
        j = slice(i, i + BATCH_TOKENS)
        z = _logits(weights, bias, contexts[j])
        own = z[np.arange(len(z)), cls[j]]
        np.exp(z, out=z)
        out[j] = own - np.log(z @ one)
    return out


def train_block(tokens: Tokens, learn: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
    """Gradient steps over the tokens of the rows that ``learn`` marks; changes ``weights``, whose last column is each row's sum of
    squared steps."""
    chosen = np.flatnonzero(learn[tokens.row])
    rows = len(weights) // FEATURES
    contexts = tokens.contexts(rows)
    values, squares = np.ascontiguousarray(weights[:, :CLASSES]), weights[:, CLASSES].copy()
    items = values.view(f"V{values.itemsize * CLASSES}").ravel()
    small, one = np.uint16 if rows <= 1 << 16 else np.uint32, np.ones(CLASSES, np.float32)
    # Steps take tokens from all over the block, so that one of them isn't one language or copy alone.
    strides = max(1, len(chosen) // STEP_TOKENS)
    for k in range(strides):
        at = chosen[k::strides]
        own, target = contexts[at], tokens.cls[at]
        step = _logits(values, bias, own)
        np.exp(step, out=step)
        step *= (-1 / (step @ one))[:, None]
        step[np.arange(len(at)), target] += 1
        for f in range(FEATURES):
            key = (own[:, f] - f * rows).astype(small)
            order = np.argsort(key, kind="stable")
            key = key[order]
            bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            first, count = bounds[:-1], bounds[1:] - bounds[:-1]
            touched = key[first].astype(np.int64) + f * rows
            # Most rows are met once or twice; only the others are summed by segments.
            total = step.take(order[first], 0)
            two, many = np.flatnonzero(count == 2), np.flatnonzero(count > 2)
            if len(two):
                total[two] += step.take(order[first[two] + 1], 0)
            if len(many):
                total[many] = np.add.reduceat(step.take(order[np.repeat(count > 2, count)], 0), np.cumsum(count[many]) - count[many], axis=0)
            square = squares[touched]
            square += np.einsum("ij,ij->i", total, total)
            squares[touched] = square
            total *= (RATE / np.sqrt(square + np.float32(1e-6)))[:, None]
            total += values.take(touched, 0)
            items[touched] = total.view(items.dtype).ravel()
    weights[:, :CLASSES], weights[:, CLASSES] = values, squares


def _trained(weights, bias):
    schema = pa.schema([("segment", pa.int32()), ("part", pa.int32()), ("change", pa.binary()), ("weight", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = seen = None
        for batch in batches:
            for packed, lengths, held in zip(batch.column("packed"), batch.column("lengths"), batch.column("held"), strict=True):
                if total is None:
                    total, seen = np.zeros_like(weights.value), np.zeros(len(weights.value), np.float32)
                own = weights.value.copy()
                train_block(Tokens(packed.as_py(), np.asarray(lengths.as_py())), ~np.asarray(held.as_py(), bool), own, bias)
                change = own - weights.value
                total += change
                seen += change[:, CLASSES] > 0
        if total is not None:
            part = TaskContext.get().partitionId() % 64
            cuts = range(0, len(total), SEGMENT)
            yield pa.RecordBatch.from_arrays([pa.array([i // SEGMENT for i in cuts], pa.int32()), pa.array([part for _ in cuts], pa.int32()),
                                              pa.array([total[i:i + SEGMENT].tobytes() for i in cuts], pa.binary()),
                                              pa.array([seen[i:i + SEGMENT].tobytes() for i in cuts], pa.binary())], schema=schema)

    return run


def _summed(group: pd.DataFrame) -> pd.DataFrame:
    change = sum((np.frombuffer(x, np.float32).astype(np.float64) for x in group["change"]), start=np.float64(0))
    weight = sum((np.frombuffer(x, np.float32).astype(np.float64) for x in group["weight"]), start=np.float64(0))
    return pd.DataFrame({"segment": group["segment"].iloc[:1].to_numpy(), "part": group["part"].iloc[:1].to_numpy(),
                         "change": [change.astype(np.float32).tobytes()], "weight": [weight.astype(np.float32).tobytes()]})


def fit(blocks: DataFrame, bias: np.ndarray, rows: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (FEATURES * rows x CLASSES + 1). Each round trains on all blocks; a row's change is averaged over the blocks that met it."""
    spark = blocks.sparkSession
    weights = np.zeros((FEATURES * rows, CLASSES + 1), np.float32)
    weights[:, CLASSES] = 1
    shape = "segment int, part int, change binary, weight binary"
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(weights)
        changes = blocks.select("packed", "lengths", "held").mapInArrow(_trained(sent, bias), shape)
        # First within 64 parts, then together, so that no task gathers one segment of all tasks.
        merged = changes.groupBy("segment", "part").applyInPandas(_summed, shape).groupBy("segment").applyInPandas(_summed, shape)
        weights = weights.copy()
        for segment, _, change, weight in merged.collect():
            own = np.frombuffer(weight, np.float32)
            weights[segment * SEGMENT:segment * SEGMENT + len(own)] += np.frombuffer(change, np.float32).reshape(len(own), -1) / np.maximum(own, 1)[:, None]
    return weights


def pack(codes: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted codes as differences, and counts, by byte planes: the high planes are zeros."""
    steps = np.diff(codes, prepend=np.uint64(0))
    planes = [steps.view(np.uint8).reshape(-1, 8).T.ravel(), n.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.ravel()]
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate(planes).tobytes())


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    m = len(data) // 12
    steps = np.ascontiguousarray(data[:8 * m].reshape(8, m).T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(data[8 * m:].reshape(4, m).T).view(np.uint32).ravel()


def _pack_counts(c: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(c.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack_counts(packed: bytes) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    return np.ascontiguousarray(data.reshape(8, -1).T).view(np.int64).ravel()


_ASKED = "part long, block long, packed binary"
_ANSWERED = "block long, part long, counts binary, tokens array<long>, words array<long>"


def distinct_counts(codes: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes in order, and how often each occurs where ``held`` is false."""
    keys = np.sort(codes | held)
    code = keys & ~np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])[:len(code)])
    before = np.concatenate([[0], np.cumsum((keys & np.uint64(1)) == 0)])
    return code[first], np.diff(before[np.append(first, len(code))])


def _questions(bits: int):
    """Each block's different codes with their counts in its training rows, cut by the first ``bits`` bits of the codes."""
    schema = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed, lengths, held in zip(batch.column("block").to_pylist(), batch.column("packed"), batch.column("lengths"), batch.column("held"), strict=True):
                tokens = Tokens(packed.as_py(), np.asarray(lengths.as_py()))
                code, n = distinct_counts(tokens.codes(), np.tile(np.asarray(held.as_py(), np.uint64)[tokens.row], 2))
                parts, cuts = _cuts(code, bits)
                yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(np.full(len(parts), block)),
                                                  pa.array([pack(code[a:b], n[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], schema=schema)

    return run


def _cuts(code: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts that sorted codes fall into, and where each begins."""
    part = (code >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(code), np.int64)
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])[:len(part)])
    return part[first], np.append(first, len(code))


def _answers(asked: pa.Table) -> pa.Table:
    """The counts over all blocks of the codes of one part, as each block asked, and once the part's tokens and words by class."""
    got = [unpack(x.as_py()) for x in asked.column("packed")]
    sizes = np.cumsum([0] + [len(c) for c, _ in got])
    code, inverse = np.unique(np.concatenate([c for c, _ in got]), return_inverse=True)
    total = np.bincount(inverse, np.concatenate([n for _, n in got]), len(code)).astype(np.int64)
    count = total[inverse]
    learnt = ((code & np.uint64(64)) > 0) & (total > 0)
    cls = (code[learnt] >> np.uint64(1)).astype(np.int64) % CLASSES
    by_class = [np.bincount(cls, x, CLASSES).astype(np.int64).tolist() for x in (total[learnt], np.ones(len(cls)))]
    rest = [None] * (len(got) - 1)
    return pa.table({"block": asked.column("block"), "part": asked.column("part"),
                     "counts": pa.array([_pack_counts(count[a:b]) for a, b in zip(sizes[:-1], sizes[1:], strict=True)], pa.binary()),
                     "tokens": pa.array([by_class[0], *rest], pa.list_(pa.int64())), "words": pa.array([by_class[1], *rest], pa.list_(pa.int64()))})


def score_block(tokens: Tokens, total: np.ndarray, held: np.ndarray, weights: np.ndarray, bias: np.ndarray, class_totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens' static probabilities S, and (rows, sizes of n x GRID) sums of log10 P) with the counts ``total`` of ``codes``. A token
    of a training row is left out of its own counts."""
    rows = len(tokens.first) - 1
    word, gram, context = tokens.counts(total)
    own = (~held[tokens.row]).astype(np.int64)
    contexts, values = tokens.contexts(len(weights) // FEATURES), np.ascontiguousarray(weights[:, :CLASSES])
    static = np.exp(log_class(values, bias, contexts, tokens.cls)) * (word - own + 1) / (class_totals[tokens.cls] - own)
    c, n = gram - own, context - own
    size = np.searchsorted(SIZES, n, "right")
    cell = tokens.row * (len(SIZES) + 1) + size
    out = np.empty((rows * (len(SIZES) + 1), len(GRID)))
    for k, m in enumerate(GRID):
        out[:, k] = np.bincount(cell, np.log((m * static + c) / (m + n)), len(out))
    return static, out.reshape(rows, -1) / np.log(10)


_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
                     ("base_score", pa.float64()), ("scores", pa.list_(pa.float64()))])


def _scored(weights, bias, class_totals, train_tokens: int, distinct: int):
    base = float(np.log10(train_tokens + distinct + 1))

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("part")
        count = np.concatenate([_unpack_counts(x.as_py()) for x in answers.column("counts")])
        parts = []
        for ids, held, lengths, packed in zip(*(blocks.column(c) for c in ("doc_ids", "held", "lengths", "packed")), strict=True):
            out = np.asarray(held.as_py(), bool)
            tokens = Tokens(packed.as_py(), np.asarray(lengths.as_py()))
            total = count[np.unique(tokens.codes(), return_inverse=True)[1]]
            word = total[:len(tokens.hash)]
            _, scores = score_block(tokens, total, out, weights.value, bias, class_totals)
            n = np.diff(tokens.first)
            sums = np.bincount(tokens.row, np.log(word + 1.0) / np.log(10) - base, len(n))
            listed = pa.ListArray.from_arrays(np.arange(0, scores.size + 1, scores.shape[1], dtype=np.int32), scores.ravel())
            parts.append(pa.Table.from_arrays([pa.array(ids.as_py(), pa.int64()), pa.array(out), pa.array(n), pa.array(np.bincount(tokens.row, word > 0, len(n)).astype(np.int64)),
                                               pa.array(np.full(len(n), train_tokens)), pa.array(sums), listed], schema=_SCORED))
        return pa.concat_tables(parts) if parts else _SCORED.empty_table()

    return run


def counted(blocks: DataFrame) -> DataFrame:
    """Answers to what the blocks ask; a block's parts in order give the counts of its sorted codes."""
    size = blocks.agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)"))).first()[0] or 0
    bits = max(0, int(size // PART_BYTES).bit_length())
    return written(blocks.select("block", "packed", "lengths", "held").mapInArrow(_questions(bits), _ASKED).groupBy("part").applyInArrow(_answers, _ANSWERED), "code-counts")


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row.

    Rows whose crc32 of the id is 2 modulo 7 are held out, null ids too; the model and all counts come from the others, all of
    them. A null or empty text is its end token alone. Without training rows every count is 0. Repeated rows are rows like others.
    ``score`` sums log10 P over events that are the known tokens and, for each class, one unseen token. A training row's tokens are
    left out one by one of the counts that they are scored by, since every text would know itself otherwise; so texts that
    training has twice score apart from others. ``base_score`` takes full counts. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "held", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(True)))
    blocks = written(source.mapInArrow(_blocks, "block long, doc_ids array<long>, held array<boolean>, lengths array<long>, packed binary"), "blocks")
    answers = counted(blocks)
    stats = answers.select(F.posexplode(F.arrays_zip("tokens", "words"))).groupBy("pos").agg(F.sum("col.tokens"), F.sum("col.words")).collect()
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    for cls, n, v in stats:
        class_tokens[cls], class_words[cls] = n, v
    train_tokens = int(class_tokens.sum())
    bias = np.log((class_tokens + 1) / (class_tokens + 1).sum()).astype(np.float32)
    weights = spark.sparkContext.broadcast(fit(blocks, bias, feature_rows(train_tokens), rounds))
    # The unseen token keeps a place in a class whose only token is left out.
    run = _scored(weights, bias, class_tokens + class_words + 1, train_tokens, int(class_words.sum()))
    scored = written(blocks.groupBy("block").cogroup(answers.select("block", "part", "counts").groupBy("block")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, scores array<double>"), "scores")
    cells = [F.col("scores")[k] for k in range((len(SIZES) + 1) * len(GRID))]
    sums = scored.filter(~F.col("held_out")).agg(*(F.sum(x) for x in cells)).first()
    best = np.array([x or 0.0 for x in sums]).reshape(-1, len(GRID)).argmax(1)
    return scored.withColumn("score", sum((cells[i * len(GRID) + int(k)] for i, k in enumerate(best)), start=F.lit(0.0))).drop("scores")
