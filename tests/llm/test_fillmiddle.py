import hashlib
import random
import re

import pytest
from plain import ODD
from pyspark.sql import functions as F

from tidewatch.llm.fillmiddle import UNITS, fill_in_middle, restored

PATTERN = {"line": r"[^\n]*\n|[^\n]+", "word": r"[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+", "character": r"(?s:.)"}


def plain(doc_id, text, unit="line", seed=7, percent=100, spm_percent=50, tags=("<P>", "<S>", "<M>")):
    text = text or ""
    hexed = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(hexed[8 * k:8 * k + 8], 16) for k in range(4))
    units = re.findall(PATTERN[unit], text)
    assert "".join(units) == text
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(t in text for t in tags) or h3 % 100 >= percent:
        return doc_id, n, "plain", text, None, None
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    p, s, m = tags
    if h4 % 100 < spm_percent:
        return doc_id, n, "spm", s + suf + p + pre + m + mid, len(pre), len(mid)
    return doc_id, n, "psm", p + pre + s + suf + m + mid, len(pre), len(mid)


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("unit", UNITS)
@pytest.mark.parametrize("percent,spm", [(100, 50), (60, 0), (0, 50)])
def test_odd_rows(spark, odd, unit, percent, spm):
    got = fill_in_middle(odd, unit, 7, percent, spm)
    assert ordered(tuple(r) for r in got.collect()) == ordered(plain(r[0], r[1], unit, 7, percent, spm) for r in ODD)
    assert ordered(r[0] for r in got.select(restored()).collect()) == ordered(r[1] or "" for r in ODD)


def test_many_random_texts(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab\n\n \r é🙂$1\\<P") for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    texts += ["<P>", "x<S>y", "a\n<M>", "\n", "\n\n", "x", "$1$2\n\\1\n", "<P", "P>", "<", "a\n<", ">\n<P\n"]
    rows = list(enumerate(texts))
    got = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"))
    assert ordered(tuple(r) for r in got.collect()) == ordered(plain(*r) for r in rows)
    back = {r[0]: r[1] for r in got.select("doc_id", restored()).collect()}
    assert back == dict(rows)


def test_very_many_units_need_no_stack(spark):
    rows = [(k, "line of text\n" * 200_000) for k in range(4)] + [(9, "\n" * 500_000), (10, "y" * 3_000_000)]
    got = {r["doc_id"]: tuple(r) for r in fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: plain(i, t) for i, t in rows}


def test_every_row_of_a_table_reads_back(spark, documents):
    both = fill_in_middle(documents).select("doc_id", "form", restored().alias("back")).join(documents.select("doc_id", "text"), "doc_id")
    assert both.count() == documents.count()
    assert both.filter("not back <=> coalesce(text, '')").count() == 0
    assert {r[0] for r in both.select("form").distinct().collect()} >= {"psm", "spm"}


def test_other_tags_and_bad_tags(spark, odd):
    tags = ("[pre]", "{suf}", "(mid)")
    got = fill_in_middle(odd, tags=tags)
    assert ordered(tuple(r) for r in got.collect()) == ordered(plain(r[0], r[1], tags=tags) for r in ODD)
    assert ordered(r[0] for r in got.select(restored(tags)).collect()) == ordered(r[1] or "" for r in ODD)
    for bad in (("<P>", "<P>", "<M>"), ("", "<S>", "<M>"), ("$1", "<S>", "<M>"), ("aba", "<S>", "<M>"), ("<P", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fill_in_middle(odd, tags=bad)


def test_empty_table_and_the_plan_has_no_python(spark, odd):
    assert fill_in_middle(odd.limit(0)).count() == 0
    plan = fill_in_middle(odd.select("doc_id", "text"), "line").select(F.sha2("output", 256))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
