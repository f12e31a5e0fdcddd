import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidewatch.llm import decontaminate
from tidewatch.llm.common import column_bytes
from tidewatch.llm.decontaminate import build_items, contaminated, edit_budget, find_items


def least_edits(item, text):
    """Fewest edits that turn the item into some part of the text."""
    a, b = np.frombuffer(item.encode("utf-32-le"), np.uint32), np.frombuffer(text.encode("utf-32-le"), np.uint32)
    cost = np.zeros(len(b) + 1, np.int64)
    steps = np.arange(len(b) + 1)
    for x in a:
        now = np.minimum(cost + 1, np.append(len(item) + 1, cost[:-1] + (b != x)))
        cost = np.minimum.accumulate(now - steps) + steps
    return int(cost.min())


def edited(rnd, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rnd.randrange(len(out))
        kind = rnd.randrange(3)
        if kind == 0:
            out[at] = rnd.choice("abcdefgh")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rnd.choice("abcdefgh"))
    return "".join(out)


def planted(seed, letters, items, texts, prompt=0, long=0):
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice(letters) for _ in range(n))
    shared = word(prompt)
    given = [(k, shared + word(rnd.randint(12, 150))) for k in range(items)]
    out = []
    for k in range(texts):
        body = word(rnd.randint(0, 400) + (long if k % 7 == 0 else 0))
        for _ in range(rnd.randint(0, 3)):
            source = rnd.choice(given)[1]
            body += edited(rnd, source, rnd.randint(0, edit_budget(len(source)) + 3)) + word(rnd.randint(0, 60))
        out.append(body)
    return given, out


@pytest.mark.parametrize("seed,letters,prompt,long", [(1, "abcdefgh", 0, 0), (2, "ab", 0, 0), (3, "abcdefgh", 60, 0), (4, "abcdefghijklmnop", 40, 40_000), (5, "abé中", 10, 2000)])
@pytest.mark.parametrize("cells", [1 << 24, 0])
def test_inexact_matches_equal_brute_force(monkeypatch, seed, letters, prompt, long, cells):
    """Every item within its budget is found with its fewest edits, in sparse and dense counts, short and long texts, in small lots."""
    monkeypatch.setattr(decontaminate, "_CELLS", cells)
    monkeypatch.setattr(decontaminate, "_LOT", 5000)
    given, texts = planted(seed, letters, 25, 30, prompt, long)
    data, offsets = column_bytes(pa.array(texts, pa.string()))
    got = {(r, k): e for r, k, e, *_ in find_items(build_items(given), data, offsets)}
    want = {}
    for r, text in enumerate(texts):
        for k, (_, item) in enumerate(given):
            q = decontaminate._gram(len(item), decontaminate.ERROR_RATE)
            best, allowed = least_edits(item, text), edit_budget(len(item), q=q)
            if best <= allowed and (len(item) >= decontaminate.Q or best == 0):
                want[r, k] = best
    assert got == want and any(want.values())


def test_found_rows_of_a_table(spark):
    given, texts = planted(9, "abcdefgh", 30, 40, 45)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(given, "item_id long, text string")
    rows = [contaminated(docs, bench, pass_bytes=size).collect() for size in (1 << 20, 700)]
    assert Counter(map(tuple, rows[0])) == Counter(map(tuple, rows[1])) and rows[0]
    for r in rows[0]:
        part = texts[r["doc_id"]].encode()[r["start"]:r["end"]].decode()
        assert least_edits(given[r["item_id"]][1], part) == r["n_edits"] == least_edits(given[r["item_id"]][1], texts[r["doc_id"]])


def test_a_common_prompt_costs_little():
    """14,000 items that begin alike, and a text that holds the beginning ten times and none of the items."""
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    prompt = word(48)
    built = build_items([(k, prompt + word(37)) for k in range(14_000)])
    text = "".join(prompt + word(52) for _ in range(10))
    data, offsets = column_bytes(pa.array([text]))
    best = 9.0
    for _ in range(3):
        began = time.perf_counter()
        assert find_items(built, data, offsets) == []
        best = min(best, time.perf_counter() - began)
    assert best < 1.0
