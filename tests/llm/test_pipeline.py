import plain
import pytest

import corpus_pipeline
from tidewatch.llm.common import written


def test_stages_against_plain_versions(spark, sf):
    """Each stage on what the one before kept; every stage but mixing is compared with a plain version of its decision."""
    from collections import Counter
    before = spark.read.parquet(f"{sf}/documents.parquet")
    columns = before.columns
    items = [plain.lower(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = written(stage(spark, before, sf), f"test-{k}")
        rows = {r.doc_id: r.text for r in before.collect()}
        if k < 4:
            assert after.columns == columns and after.schema == before.schema, name
        kept = {r.doc_id: r.text for r in after.collect()} if k < 4 else None
        if k == 0:
            assert set(kept) == {i for i, t in rows.items() if not plain.quality(t)[5]}, "labels are too few here to certify more"
        elif k == 1:
            assert set(kept) == {c for _, c in plain.near_duplicates(rows.items(), 5, 80).values()}
        elif k == 2:
            cut = {i: n - r for i, n, r, _, _ in plain.repeats(list(rows.items()), 200)}
            assert all(cut[i] - 8 <= len(kept[i].encode()) <= cut[i] for i in kept) and all(cut[i] < 20 for i in set(rows) - set(kept))
        elif k == 3:
            assert {i for i, t in rows.items() if any(x in plain.lower(t) for x in items)} <= set(rows) - set(kept)
        else:
            got = after.collect()
            assert {r.doc_id for r in got} == set(rows) and max(Counter(r.doc_id for r in got).values()) <= 5
        before = after


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, sf, odd, empty):
    docs = odd.filter("false") if empty else odd
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = written(stage(spark, docs, sf), f"odd-{k}")
        assert k == 4 or docs.schema == odd.schema
    assert docs.count() == 0 if empty else docs.count() > 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "source", "n_tokens", "repetition", "block", "position"]
