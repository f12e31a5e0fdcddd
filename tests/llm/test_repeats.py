import numpy as np
import plain
import pytest

from tidewatch.llm import repeats


def found(df, **settings):
    return sorted((tuple(r)[:5] for r in repeats.remove_repeats(df, **settings).collect()), key=str)


@pytest.mark.parametrize("settings", [{}, {"group_passages": 1, "task_passages": 3}])
def test_odd_rows(odd, settings):
    assert found(odd, **settings) == sorted(plain.repeats([r[:2] for r in plain.ODD], 200), key=str)
    assert found(odd.filter("false")) == []


def test_shared_passages(spark):
    """A passage in many documents with different surroundings; runs; overlapping repeats in one text; exact lengths."""
    import random
    random.seed(1)
    word = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    passage = word(330)
    rows = [(i, word(random.randint(0, 300)) + passage[random.randint(0, 40):random.randint(240, 330)] + word(200)) for i in range(40)]
    rows += [(50, "a" * 1000), (51, "ab" * 400), (52, passage[:199]), (53, passage[:200]), (54, word(250) * 2), (55, "ab" * 100 + "é" * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(plain.repeats(rows, 200), key=str)
    assert found(df) == expected
    assert found(df, group_passages=2, task_passages=10) == expected


def test_query(spark, sf, documents):
    from tidewatch.llm.queries import op2_suffix_array_dedup
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = op2_suffix_array_dedup(spark, sf).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain.repeats(rows, 200))


def test_windows_by_columns():
    rng = np.random.default_rng(0)
    passages = [bytes(rng.integers(97, 99, 368, dtype=np.uint8)) for _ in range(30)]
    passages += [passages[0][:50] + passages[1][50:260] + passages[0][260:], b"\xff" * 168 + passages[2][168:]]
    got = repeats.repeated_windows(passages, 200)
    for s in range(169):
        windows = [p[s:s + 200] for p in passages]
        assert [windows.count(w) > 1 and b"\xff" not in w for w in windows] == got[:, s].tolist()


def test_cut_keeps_other_columns(odd):
    out = repeats.cut_repeats(odd)
    assert out.schema == odd.schema
    texts = {r.doc_id: r.text for r in out.collect()}
    assert 9 not in texts and texts[11] != texts.get(12) and texts[7] == "word"
