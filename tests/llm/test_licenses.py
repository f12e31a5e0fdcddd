import random
import re
from collections import Counter

import numpy as np
import pytest
from plain import ODD, lower

from tidewatch.llm import licenses
from tidewatch.llm.common import PUNCTUATION, column_bytes, words
from tidewatch.llm.licenses import PHRASES, TEMPLATES, automaton, matches, scan_licenses, scanner, statistics, word_hashes

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def toks(text):
    return WORD.findall(lower(text))


def base(text):
    """(words, places, first, last, labels) of the base phrases."""
    w, at, labels = toks(text), [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        got = [i for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
        at += got
        labels |= {label} if got else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def streamed(auto, texts):
    import pyarrow as pa
    data, offsets = column_bytes(pa.array(texts, pa.string()))
    start, end, row = words(data, offsets, PUNCTUATION)
    return row, *statistics(auto, word_hashes(data, start, end), row)


@pytest.mark.parametrize("seed", range(6))
def test_matching_statistics_and_matches_equal_brute_force(seed):
    rnd = random.Random(seed)
    letters = "abc" if seed % 2 else "abcdefgh"
    templates = ["".join(rnd.choice(letters) for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 6))]
    texts = ["".join(rnd.choice(letters + "z") for _ in range(rnd.randint(0, 300))) for _ in range(5)] + [t + t for t in templates]
    auto = automaton([" ".join(t) for t in templates])
    row, at, state, length = streamed(auto, [" ".join(t) for t in texts])
    whole = "".join(texts)
    assert len(row) == len(whole)
    first = np.cumsum([0, *map(len, texts)])

    def longest(end, r, where):
        n = 0
        while n < end + 1 - first[r] and any(whole[end - n:end + 1] in t for t in where):
            n += 1
        return n

    got = dict(zip(at.tolist(), length.tolist(), strict=True))
    for end in range(len(whole)):
        n = longest(end, row[end], templates)
        assert got.get(end, 0) == (n if n >= 2 else 0)
    want = set()
    places = np.cumsum([0, *map(len, templates)])
    for k, t in enumerate(templates):
        ms = [longest(end, row[end], [t]) for end in range(len(whole))]
        for end, n in enumerate(ms):
            if n >= 3:
                for i in range(n - 1, len(t)):
                    if t[i - n + 1:i + 1] == whole[end - n + 1:end + 1]:
                        on = end + 1 < len(whole) and row[end + 1] == row[end] and i + 1 < len(t) and whole[end + 1] == t[i + 1]
                        if not on:
                            want.add((end, places[k] + i, n))
    found = matches(auto, at, state, length, 3)
    assert sorted(zip(*(x.tolist() for x in found), strict=True)) == sorted(want)


def test_base_columns_of_a_table(spark, documents):
    got = {r["doc_id"]: tuple(r[1:6]) for r in scan_licenses(documents).collect()}
    want = {r["doc_id"]: base(r["text"]) for r in documents.collect()}
    assert got == want
    assert any(n for _, n, *_ in want.values())


def test_lines_of_the_given_tables(spark, documents):
    rows = {r["doc_id"]: (r["text"], got) for r in documents.collect() for got in [None]}
    for r in scan_licenses(documents).collect():
        text = rows[r["doc_id"]][0].lower()
        want = {label for label, line in (("mit", "mit license"), ("apache", "apache license, version 2.0"), ("gpl", "gnu general public license"),
                                          ("cc-by-nc", "licensed under cc by-nc 4.0")) if line in text}
        assert set(filter(None, r["labels"].split(","))) == want
        assert (r["score"] == 1.0) == bool(want)


def _one(text, **settings):
    import pyarrow as pa
    return scanner(**settings).scan(*column_bytes(pa.array([text], pa.string())))[0]


@pytest.mark.parametrize("label,name,text", TEMPLATES)
def test_every_template_is_found_verbatim_and_reworded(label, name, text):
    rnd = random.Random(name)
    w = toks(text)
    lead, tail = ["lorem"] * 30, ["ipsum"] * 30
    row = _one(" ".join(lead + w + tail).upper().replace(" ", " \n* "))
    assert label in row[5].split(",") and row[6] == 1.0
    span = [s for s in row[7] if s["label"] == label][0]
    assert (span["first_word"], span["end_word"], span["covered"]) == (30, 30 + len(w), len(w))
    if len(w) > 60:
        for k in rnd.sample(range(len(w)), 3):
            w[k] = "changed"
        row = _one(" ".join(lead + w + tail))
        shares = [s["share"] for s in row[7] if s["label"] == label]
        assert shares and 0.6 <= max(shares) < 1.0


def test_two_copies_are_two_spans_and_plain_prose_has_none():
    text = TEMPLATES[0][2]
    n = len(toks(text))
    row = _one(f"{text}\n\n{text}")
    assert [(s["label"], s["first_word"], s["end_word"]) for s in row[7] if s["template"] == "mit-text"] == [("mit", 0, n), ("mit", n, 2 * n)]
    prose = "the software in this house is free to use and the author of the letter shall not be held liable for the use of it"
    assert _one(prose)[4:6] == ("", "") and _one(prose)[6] < 0.05
    assert _one("a house by the sea and a boat")[4:] == ("", "", 0.0, [])
    partial = _one("permission is hereby granted free of charge to the guests")
    assert partial[5] == "" and 0 < partial[6] < 0.2


def test_longer_template_wins_over_one_that_it_covers():
    row = _one("This work is licensed under CC BY-NC 4.0.")
    assert row[5] == "cc-by-nc" and len(row[7]) == 1
    assert _one("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.")[5] == "cc-by-nc-sa"
    assert _one("This program is licensed under the GNU Affero General Public License, version 3")[4:6] == ("gpl", "agpl,gpl")


def test_results_do_not_depend_on_other_templates_or_parts():
    rnd = random.Random(1)
    pool = [w for _, _, t in TEMPLATES[:6] for w in toks(t)]
    texts = [" ".join(x for _ in range(40) for k in [rnd.randrange(len(pool))] for x in pool[k:k + rnd.randint(1, 12)]) for _ in range(4)]
    for text in texts:
        together = _one(text, least_share=0.05, templates=TEMPLATES, phrases=[])
        import pyarrow as pa
        best = max(scanner([t], [], least_share=0.05).scan(*column_bytes(pa.array([text])))[0][6] for t in TEMPLATES)
        assert together[6] == best


def test_odd_rows(spark, odd):
    got = Counter((r["doc_id"], *r[1:6]) for r in scan_licenses(odd).collect())
    assert got == Counter((r[0], *base(r[1])) for r in ODD)
    assert scan_licenses(odd.limit(0)).count() == 0


def test_phrases_overlap_repeat_and_stop_at_texts():
    text = "mit mit license license MIT\nLICENSE; apache License general public-license general public license mit"
    row = _one(text)
    assert row[:5] == base(text)
    import pyarrow as pa
    rows = scanner().scan(*column_bytes(pa.array(["the mit", "license", None, "", "mit license " * 5000])))
    assert [r[1] for r in rows] == [0, 0, 0, 0, 5000]
    assert rows[4][2:4] == (0, 9998)


def test_bad_settings(monkeypatch):
    with pytest.raises(ValueError):
        scanner(phrases=[("mit", "mit")])
    monkeypatch.setattr(licenses, "TEMPLATE_WORDS", 10)
    with pytest.raises(ValueError):
        scanner()
