import random

import numpy as np
import pyarrow as pa
import public_tokenizers
from plain import ODD
from tokenizers import Tokenizer

from tidewatch.llm import tokencount
from tidewatch.llm.common import column_bytes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    return [len(x.ids) for x in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def counted(texts):
    with open(PATH, "rb") as f:
        machine = tokencount.machine(f.read())
    return tokencount.count_slice(machine, *column_bytes(pa.array(texts, pa.string()))).tolist()


def test_random_and_special_texts():
    random.seed(3)
    letters = "aàé中🙂 \t\n'stmdrevl  0 9½!?<|> 　\x1c\x85Aß"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(1500)]
    texts += ["x<|endoftext|> y", "<|endoftext|><|endoftext|>", "   <|endoftext|>   ", "it's we'll 're'S a'b '", "a" * 3000, " " * 500, "'", "<|endoftext",
              "ha" * 700, "\n\n\n x", "!" * 300, "", None]
    assert counted(texts) == library(texts)


def test_states_start_anew(monkeypatch):
    monkeypatch.setattr(tokencount, "MAX_STATES", 50)
    texts = [r[1] for r in ODD]
    assert [counted([t])[0] for t in texts] == library(texts)


def test_piece_scan_does_not_depend_on_chunks(monkeypatch):
    points = np.array([ord(c) for c in "it's  a\n\n test 12 ab'll!? " * 30], np.uint32)
    first = np.zeros(len(points), bool)
    first[[0, 100]] = True
    whole = tokencount.piece_starts(points, first)
    monkeypatch.setattr(tokencount, "CHUNK", 7)
    assert (whole == tokencount.piece_starts(points, first)).all()


def test_odd_rows(odd):
    got = tokencount.count_tokens(odd, PATH, limit=1024).collect()
    expected = sorted((str(i), len((t or "").encode()), n, n > 1024) for (i, t, *_), n in zip(ODD, library([r[1] for r in ODD]), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == expected
    assert tokencount.count_tokens(odd.filter("false"), PATH).count() == 0


def test_query(spark, sf, documents):
    from tidewatch.llm.queries import op1_token_counts
    rows = documents.select("doc_id", "text").collect()
    expected = dict(zip((r.doc_id for r in rows), library([r.text for r in rows]), strict=True))
    assert {r.doc_id: r.n_tokens for r in op1_token_counts(spark, sf).collect()} == expected
