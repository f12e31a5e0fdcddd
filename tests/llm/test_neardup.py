import numpy as np
import plain
import pytest

from tidewatch.llm import neardup
from tidewatch.llm.common import mix


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 85, 2_000_000), (5, 80, 50), (3, 85, 3)])
def test_odd_rows(odd, size, percent, block):
    expected = plain.near_duplicates([r[:2] for r in plain.ODD], size, percent)
    got = neardup.near_duplicates(odd, size, percent, block).collect()
    assert len(got) == len(plain.ODD)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
            assert r.kept == (r.doc_id == r.component_id)
    assert neardup.near_duplicates(odd.filter("false"), size, percent).count() == 0


@pytest.mark.parametrize("block", [2_000_000, 4000])
def test_groups_of_near_copies(spark, block):
    """Copies with edits at every rate, so that links lie on both sides of the threshold and chains form."""
    import random
    random.seed(7)
    rows = []
    for g in range(4):
        base = [f"{g}w{random.randint(0, 400)}" for _ in range(120)]
        for k in range(40):
            w = list(base)
            for _ in range(random.randint(0, 9)):
                w[random.randrange(len(w))] = f"e{random.randint(0, 50)}"
            rows.append((g * 100 + k, " ".join(w)))
    expected = plain.near_duplicates(rows, 3, 85)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected


def test_query(spark, sf, documents):
    from tidewatch.llm.queries import op10_minhash_near_dedup
    expected = plain.near_duplicates([tuple(r) for r in documents.select("doc_id", "text").collect()], 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in op10_minhash_near_dedup(spark, sf).collect()} == expected


def _slow_signature(hashes, slots):
    out = np.full(slots, 0xFFFFFFFF, np.uint32)
    for h in hashes:
        p = list(range(slots))
        for level in range(slots):
            value, k = neardup._draw(np.array([h]), level, slots)
            p[level], p[k[0]] = p[k[0]], p[level]
            out[p[level]] = min(out[p[level]], value[0])
    return out


def test_signatures_equal_the_plain_permutation_and_estimate_similarity():
    rng = np.random.default_rng(1)
    sizes = [1, 3, 40, 0, 300]
    sets = [mix(rng.integers(1, 1 << 62, n, dtype=np.uint64)) for n in sizes]
    fast = neardup.superminhash(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]), 32)
    for s, f in zip(sets, fast, strict=True):
        assert (f == _slow_signature(s, 32)).all()
    a, b = sets[4], np.concatenate([sets[4][:270], mix(np.arange(30, dtype=np.uint64))])
    both = neardup.superminhash(np.concatenate([a, b]), np.array([0, 300, 600]))
    assert abs((both[0] == both[1]).mean() - 270 / 330) < 0.08
    for percent in (80, 85, 95):
        rows, bands = neardup.bands_for(percent / 100)
        assert rows * bands <= 252 and (1 - (percent / 100) ** rows) ** bands < 1e-5
