import random

import numpy as np
import plain
import pyarrow as pa

from tidewatch.llm import common


def test_lookup_of_hot_and_cold_keys(spark):
    rows = [(i, "hot" if i < 3000 else f"k{i % 40}" if i % 9 else None) for i in range(4000)]
    left = spark.createDataFrame(rows, "i int, k string")
    facts = left.filter("k is not null").groupBy("k").count().selectExpr("k", "count as n", "length(k) as x")
    got = common.lookup(left, facts, ["k"], "n")
    assert got.count() == sum(k is not None for _, k in rows)
    assert sorted(map(tuple, got.select("i", "k", "x").collect())) == sorted((i, k, len(k)) for i, k in rows if k is not None)


def test_components_of_chains_stars_and_nothing(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(539, 7), (7, 7), (9, 9), (-3, 160), (160, -3)]
    random.shuffle(edges)
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent if x != 9}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_words_and_slices_do_not_cross_rows():
    texts = [r[1] for r in plain.ODD] + ["ab", "cd", " e", "f ", "", None, "g"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for limit in (1, 50, 1 << 20):
        got = []
        for first, _, data, offsets in common.slices(batch, "text", limit):
            got += [(first + r, data[a:b].tobytes().decode()) for a, b, r in zip(*common.words(data, offsets), strict=True)]
        assert got == [(r, w) for r, t in enumerate(texts) for w in plain.WORD.findall(t or "")]


def test_range_hashes_tell_texts_apart():
    data = np.frombuffer(b"abcabc abcabd", np.uint8)
    h = common.range_hash(common.prefix_hash(data), np.array([0, 3, 7, 10, 0, 0]), np.array([3, 6, 10, 13, 6, 0]))
    assert h[0] == h[1] == h[2] != h[3] and len({int(x) for x in h}) == 4
