import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import plain
import pyarrow as pa
import zstandard

from tidewatch.llm import decontaminate, maxent, mixing, qualityrules
from tidewatch.llm.common import column_bytes

# ---------------------------------------------------------------- quality rules


def test_counts_of_odd_texts():
    random.seed(2)
    texts = ["".join(random.choice("ab \n\té#") for _ in range(random.randint(0, 80))) for _ in range(1500)] + [r[1] for r in plain.ODD] + ["\n", "a\n", "\na\na", "x " * 50]
    counts = qualityrules.text_counts(*column_bytes(pa.array(texts, pa.string())))
    failed = qualityrules.base_failed(counts)
    for t, c, f in zip(texts, counts, failed, strict=True):
        assert (*c[:5].tolist(), bool(f)) == plain.quality(t)


def test_binomial_bound_and_cutoffs():
    assert abs(qualityrules.binomial_below(10, 0.3, 3) - sum(math.comb(10, i) * 0.3 ** i * 0.7 ** (10 - i) for i in range(4))) < 1e-12
    cells = len(qualityrules.GRID) + 1
    good, bad = np.zeros(cells, int), np.zeros(cells, int)
    good[3], good[70], bad[80] = 5000, 2, 300
    cutoff = qualityrules.choose_cutoff(good, bad, 0.01, 0.001, 30)
    assert cutoff is not None and qualityrules.GRID[70] <= cutoff <= qualityrules.GRID[79]
    assert qualityrules.choose_cutoff(good // 100, bad, 0.01, 0.001, 30) is None, "fifty texts certify nothing"
    good[80] = 300
    assert qualityrules.choose_cutoff(good, bad, 0.01, 0.001, 30) is None, "as many good as poor texts above"


def test_risk_is_controlled_on_fresh_texts():
    """Cutoffs from labelled draws keep the true false rejection below the risk, in all of many repetitions."""
    rng = np.random.default_rng(5)
    cells = len(qualityrules.GRID) + 1
    p_good = np.r_[np.full(40, 0.02), np.full(cells - 40, 0.2 / (cells - 40))]
    p_bad = np.r_[np.full(40, 0.002), np.full(cells - 40, 0.92 / (cells - 40))]
    for _ in range(100):
        cutoff = qualityrules.choose_cutoff(rng.multinomial(3000, p_good), rng.multinomial(3000, p_bad), 0.05, 0.001, 0.1)
        if cutoff is not None:
            assert p_good[qualityrules.GRID.index(cutoff) + 1:].sum() <= 0.05


def test_rules_on_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (2, None, 0), (None, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    got = qualityrules.quality_rules(odd, labels).collect()
    assert len(got) == len(plain.ODD)
    expected = sorted((str(r[0]), *plain.quality(r[1])) for r in plain.ODD)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == expected
    assert all(r.kept == (not r.base_failed) for r in got), "too few labels reject nothing"
    kept = qualityrules.keep_good(odd, labels)
    assert kept.schema == odd.schema and kept.count() == sum(r.kept for r in got)
    assert qualityrules.quality_rules(odd.filter("false"), labels).count() == 0


def test_junk_is_rejected_where_labels_suffice(spark):
    words = " ".join("w%d" % i for i in range(30))
    rows = [(i, f"{words} x{i}" if i % 4 else f"{words} x{i}".replace(" ", "### "), "en") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 4 > 0) as quality").filter("doc_id % 2 = 0 or doc_id % 4 > 0")
    got = qualityrules.quality_rules(docs, labels).collect()
    assert all(r.kept == (r.doc_id % 4 > 0) for r in got)


def test_small_strata_and_copies(spark):
    """A stratum too small for cutoffs by rule certifies one for all rules; copies are one label; tiny strata are pooled."""
    words = " ".join("w%d" % i for i in range(30))
    text = lambda i: f"{words} x{i}" if i % 3 else f"{words} x{i}".replace(" ", "### ")
    rows = [(i, text(i), "en") for i in range(600)] + [(1000 + i, text(1 + i % 2), "copies") for i in range(900)] + [(1900, text(0), "copies")]
    rows += [(3000 + i, text(i), f"tiny{i % 40}") for i in range(600)] + [(9000, text(3), "unlabelled"), (9001, text(3), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.filter("doc_id < 9000").selectExpr("doc_id", "int(not text like '%###%') as quality")
    got = {r.doc_id: r for r in qualityrules.quality_rules(docs, labels).collect()}
    assert len(got) == len(rows)
    junk = {i for i, t, _ in rows if "###" in t}
    assert all(r.kept == (i not in junk) for i, r in got.items() if i < 600 or 3000 <= i < 4000), "certified alone and in the pool"
    assert got[1900].stratum == "copies" and not got[1900].kept, "two different texts certify nothing alone; the pool does"
    measured = qualityrules.measure(docs)
    few = labels.filter("doc_id between 1000 and 1900")
    chosen = {r.stratum: r.cutoffs for r in qualityrules.fit_thresholds(measured, few).collect()}
    assert set(chosen) == {r.stratum for r in got.values()} and all(c == math.inf for v in chosen.values() for c in v)


# ---------------------------------------------------------------- language model

def test_scores(spark, sf, documents, odd):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    from tidewatch.llm.queries import op8_lm_scoring
    for data, got in ((rows, op8_lm_scoring(spark, sf).collect()), ([r[:2] for r in plain.ODD], maxent.score_documents(odd).collect())):
        tokens = [(i, plain.WORD.findall(plain.lower(t)) + [None]) for i, t in data]
        held = {i: i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tokens}
        count = Counter(w for i, ws in tokens if not held[i] for w in ws)
        n, v = sum(count.values()), len(count)
        expected = sorted((str(i), held[i], len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in tokens)
        assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == expected
        assert all(r.score < 0 for r in got)
    assert maxent.score_documents(odd.filter("false")).count() == 0
    scored = op8_lm_scoring(spark, sf).filter("held_out").selectExpr("sum(score)", "sum(base_score)").first()
    assert scored[0] > scored[1] * 0.9, "on held-out texts the model is far better than counts alone"


class PlainModel:
    """The model without class features, from dictionaries: what ``score_documents(rounds=0)`` says."""

    def __init__(self, tokens, held):
        self.cls = {}
        for _, ws in tokens:
            block = zstandard.ZstdCompressor().compress(" ".join(ws[:-1]).encode())
            self.cls |= dict(zip(ws, maxent.Tokens(block, np.array([len(" ".join(ws[:-1]).encode())])).cls.tolist(), strict=True))
        learn = [ws for i, ws in tokens if not held[i]]
        self.count = Counter(w for ws in learn for w in ws)
        self.grams = Counter(x for ws in learn for x in self.events(ws))
        self.context = Counter(c for ws in learn for c, _ in self.events(ws))
        self.n, self.v = ([sum(f(w) for w in self.count if self.cls[w] == k) for k in range(maxent.CLASSES)] for f in (self.count.get, lambda w: 1))

    @staticmethod
    def events(ws):
        context = ("<s>",)
        for w in ws:
            yield context, w
            context = (*context, w) if w is not None and len(w.encode()) <= maxent.SHORT else (w,)

    def static(self, k, c, own=0):
        return (self.n[k] + 1) / (sum(self.n) + maxent.CLASSES) * (c - own + 1) / (self.n[k] + self.v[k] + 1 - own)

    def logs(self, ws, own):
        """(size of n, log10 P for each M) of each token."""
        for x, w in self.events(ws):
            c, n, s = self.grams[x, w] - own, self.context[x] - own, self.static(self.cls[w], self.count[w], own)
            yield sum(n >= k for k in maxent.SIZES), [math.log10((m * s + c) / (m + n)) for m in maxent.GRID]


def test_model_against_plain(spark, documents, odd):
    """Without rounds of training, scores equal a plain model's; over all tokens its probabilities sum to one after any context."""
    for data in ([(r.doc_id, r.text) for r in documents.select("doc_id", "text").limit(60).collect()], [r[:2] for r in plain.ODD]):
        tokens = [(i, plain.WORD.findall(plain.lower(t)) + [None]) for i, t in data]
        held = {i: i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tokens}
        model = PlainModel(tokens, held)
        logs = [(i, list(model.logs(ws, int(not held[i])))) for i, ws in tokens]
        best = [max(range(len(maxent.GRID)), key=lambda k: sum(x[k] for i, row in logs if not held[i] for z, x in row if z == size)) for size in range(len(maxent.SIZES) + 1)]
        expected = sorted((str(i), round(sum(x[best[z]] for z, x in row), 3)) for i, row in logs)
        got = maxent.score_documents(spark.createDataFrame(data, "doc_id long, text string").repartition(3), rounds=0).collect()
        assert sorted((str(r.doc_id), round(r.score, 3)) for r in got) == expected
        for x in list(model.context)[:40] + [("never",)]:
            m, n = 4.0, model.context[x]
            known = sum((m * model.static(model.cls[w], c) + model.grams[x, w]) / (m + n) for w, c in model.count.items())
            unseen = sum(m * model.static(k, 0) / (m + n) for k in range(maxent.CLASSES))
            assert abs(known + unseen - 1) < 1e-9


def test_class_factor_learns():
    """Gradient steps equal a plain loop's, raise the likelihood, and one block is trained on in every round."""
    text = " ".join(random.Random(3).choice(["alpha beta gamma", "delta epsilon zeta", "beta alpha"]) for _ in range(400)).encode()
    tokens = maxent.Tokens(zstandard.ZstdCompressor().compress(text), np.array([len(text)]))
    rows, bias = 256, np.zeros(maxent.CLASSES, np.float32)
    weights = np.zeros((maxent.FEATURES * rows, maxent.CLASSES + 1), np.float32)
    weights[:, maxent.CLASSES] = 1
    own, contexts = weights.astype(np.float64), tokens.contexts(rows)
    steps = max(1, len(tokens.hash) // maxent.STEP_TOKENS)
    assert steps == 1
    gradient = np.zeros((len(own), maxent.CLASSES))
    for at, target in zip(contexts, tokens.cls, strict=True):
        z = np.exp(own[at, :maxent.CLASSES].sum(0) + bias)
        for k in at:
            gradient[k] += (np.arange(maxent.CLASSES) == target) - z / z.sum()
    own[:, maxent.CLASSES] += (gradient ** 2).sum(1)
    own[:, :maxent.CLASSES] += maxent.RATE * gradient / np.sqrt(own[:, maxent.CLASSES:] + 1e-6)
    likelihood = []
    for _ in range(3):
        likelihood.append(maxent.log_class(weights[:, :maxent.CLASSES], bias, contexts, tokens.cls).sum())
        maxent.train_block(tokens, np.array([True]), weights, bias)
        if len(likelihood) == 1:
            assert np.allclose(weights, own, atol=1e-3)
    assert likelihood[0] < likelihood[1] < likelihood[2]


def test_packed_codes():
    rng = np.random.default_rng(1)
    for m in (0, 1, 5000):
        code = np.unique(rng.integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2))
        n = rng.integers(0, 1 << 32, len(code))
        for x, y in zip(maxent.unpack(maxent.pack(code, n)), (code, n), strict=True):
            assert (x == y).all()
        drawn, held = rng.choice(code, 3 * m), rng.integers(0, 2, 3 * m).astype(np.uint64)
        every, learnt = Counter(drawn.tolist()), Counter(drawn[held == 0].tolist())
        got = maxent.distinct_counts(drawn, held) if m else (code, n)
        assert dict(zip(got[0].tolist(), got[1].tolist(), strict=True)) == {x: learnt[x] for x in every} and (np.diff(got[0].astype(object)) > 0).all()
        assert (maxent._unpack_counts(maxent._pack_counts(n)) == n).all()
        for bits in (0, 3):
            parts, cuts = maxent._cuts(code, bits)
            assert all((code[a:b] >> np.uint64(1) >> np.uint64(63 - bits) == p).all() for p, a, b in zip(parts, cuts[:-1], cuts[1:], strict=True)) and cuts[-1] == len(code)


def test_copies_score_apart(spark):
    """A text that training has twice is likelier than any that it has once; held-out rows teach nothing."""
    rng = random.Random(9)
    make = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    texts = [make() for _ in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i]) for i in range(20)]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    got = {r.doc_id: r.score / r.n_tokens for r in maxent.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    likely = {x for i in range(20) for x, y in ((i, 1000 + i), (1000 + i, i)) if y not in held}
    assert min(got[x] for x in likely) > max(v for x, v in got.items() if x not in likely) + 1


# ---------------------------------------------------------------- decontamination

def test_planted_edits():
    random.seed(5)
    item = "The quick onthe thean brown fox jumps stonly over erthe lazy dog while reading a very long ingtion of text"
    built = decontaminate.build_items([(1, item), (2, "short"), (3, None), (4, "")])
    budget = decontaminate.edit_budget(len(item))
    fold = lambda b: bytes(decontaminate.fold(np.frombuffer(b, np.uint8)))
    for _ in range(150):
        s = list(item)
        for _ in range(random.randint(0, budget + 3)):
            k, o = random.randrange(len(s)), random.random()
            s[k:k + (o < 0.67)] = [] if o < 0.33 else [random.choice("abc\n")]
        text = ("Lorem ipsum dolor " * random.randint(0, 30) + "".join(s) + " sit amet" * random.randint(0, 30)).encode()
        found = decontaminate.find_items(built, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        edits = plain.distance(fold(item.encode()), fold("".join(s).encode()))
        assert not (edits <= budget and (not found or found[0][2] > edits))
        for _, k, n, a, b in found:
            assert k == 0 and n <= budget and plain.distance(fold(item.encode()), fold(text)[a:b]) == n


def test_decontamination_rows(spark, sf, documents, odd):
    from tidewatch.llm.queries import op9_benchmark_decontamination
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    fold = lambda t: re.sub(r"[A-ZÀ-ÖØ-Þ]", lambda m: m[0].lower(), re.sub(r"[\x09-\x0d]", " ", t))
    verbatim = {(r.doc_id, i) for r in documents.collect() for i, t in items if fold(t) in fold(r.text)}
    got = op9_benchmark_decontamination(spark, sf).collect()
    assert verbatim and verbatim == {(r.doc_id, r.item_id) for r in got if r.n_edits == 0}
    bench = spark.createDataFrame([(1, "seven eight nine ten eleven", 0), (2, None, 0), (3, "", 0), (None, "w100 w101 w102 w103 w104", 0), (1, "seven eight nine ten eleven", 0)], "item_id long, text string, doc_id int")
    for size in (1 << 20, 20):
        got = decontaminate.contaminated(odd, bench, pass_bytes=size).collect()
        assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (3, 1), (14, None)}
        clean = decontaminate.drop_contaminated(odd, bench, pass_bytes=size)
        assert clean.schema == odd.schema and clean.count() == len(plain.ODD) - 4
    assert decontaminate.contaminated(odd.filter("false"), bench).count() == decontaminate.contaminated(odd, bench.filter("false")).count() == 0


def test_copies_in_other_case_and_layout():
    import textwrap
    import unicodedata
    items = ["Съешь ещё этих мягких французских булок, да выпей же чаю, сказал ему старый друг",
             "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία, είπε ο σοφός δάσκαλος στους μαθητές του",
             "Zażółć gęślą jaźń, powiedział źle wyspany królewicz, i poszedł żąć łąkę",
             "Pijamalı hasta yağız şoföre çabucak güvendi, ışıklı sokaktan içeri girdi",
             "Le cœur de l'œuvre où naît une sœur, un bœuf et des œufs, voilà le nœud",
             "Die Straße ist groß und heiß, außen weiß, und süßer Spaß fließt durch Gießen",
             "私は毎朝六時に起きて、近くの公園まで歩いて行きます。",
             "The quick brown fox jumps over the lazy dog while it reads a very long text of many words in the shade"]
    built = decontaminate.build_items(list(enumerate(items)))

    def turkish(t):
        return t.replace("i", "İ").replace("ı", "I").upper()

    for k, item in enumerate(items):
        wrapped = textwrap.fill(item, 30, subsequent_indent=" " * 8) if " " in item else item
        for copy in (item, item.upper(), item.title() if k != 5 else item, turkish(item) if k == 3 else item, unicodedata.normalize("NFD", item), wrapped, wrapped.upper(),
                     unicodedata.normalize("NFD", wrapped.upper()), item.replace(" ", "\u00a0"), item.replace(" ", " \r\n\t")):
            for before, after in (("", ""), ("é\u0301 ß  ", "\n\n後")):
                parts = [b"x  y", (before + copy + after).encode(), "ﬁ".encode()]
                data, offsets = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
                start = len(before.encode())
                (got,) = decontaminate.find_items(built, data, offsets)
                # Few added blanks are edits.
                added = len(re.sub(r"(?<=\s)\s", "", copy)) < len(copy)
                assert (got[:2], got[3:]) == ((1, k), (start, start + len(copy.encode()))) and (added or got[2] == 0), (copy, before)
        changed = item[:10] + "§" + item[11:]
        got = decontaminate.find_items(built, np.frombuffer(changed.encode(), np.uint8), np.array([0, len(changed.encode())]))
        assert [g[1:3] for g in got] == [(k, 1)]
    long = " ".join(items[:3])
    built = decontaminate.build_items([(1, long)])
    laid = textwrap.fill(long.swapcase(), 60, subsequent_indent=" " * 8)
    for n in range(decontaminate.edit_budget(len(long)) + 3):
        # The whole budget is left for letters in a text laid out anew.
        copy = laid
        for at in [i for i, c in enumerate(laid) if c.isalpha()][5:200:15][:n]:
            copy = copy[:at] + "§" + copy[at + 1:]
        got = decontaminate.find_items(built, np.frombuffer(copy.encode(), np.uint8), np.array([0, len(copy.encode())]))
        assert [g[2] for g in got] == ([n] if n <= decontaminate.edit_budget(len(long)) else [])


def test_short_items_are_found_verbatim(spark):
    items = ["a b", "東京", "Ça va  ?", "x", "eleven char", "Привет", "東京", " \n"]
    texts = ["so A\tB it is", "私は東京に住む", "oui, ÇA VA ?", "ELEVEN   chars, xylophone", "ПРИВЕТ, мир", "東 京", "", "ab", "elevenchar"]
    fold = lambda t: " ".join(decontaminate.fold_text(t).split())
    expected = {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if x.strip() and fold(x) in fold(t)}
    assert {i for _, i in expected} == set(range(7))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for size in (1 << 20, 10):
        got = decontaminate.contaminated(docs, bench, pass_bytes=size).collect()
        assert {(r.doc_id, r.item_id) for r in got} == expected and len(got) == len(expected)
        assert all(r.n_edits == 0 and fold(texts[r.doc_id].encode()[r.start:r.end].decode()) == fold(items[r.item_id]) for r in got)
        assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench, pass_bytes=size).collect()} == set(range(len(texts))) - {d for d, _ in expected}


def test_folded_places_of_odd_texts():
    random.seed(8)
    bits = ["a", "É", "e\u0301", "\u0301", "ß", "İ", "ﬃ", "한", "\u1112\u1161\u11ab", "\u0344", "🙂", " ", "\u2003", "\n", "ǰ", "\u0958", "Ω", "Å"]
    for _ in range(300):
        rows = ["".join(random.choice(bits) for _ in range(random.randint(0, 9))) for _ in range(4)]
        parts = [r.encode() for r in rows]
        text = decontaminate.folded(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]))
        for r, whole in enumerate(rows):
            own = slice(text.offsets[r], text.offsets[r + 1])
            assert "".join(map(chr, text.chars[own])) == decontaminate.fold_text(whole)
            assert all(text.first[own] < text.last[own])
    broken = np.array([0x61, 0xC3, 0x28, 0xFF, 0x80, 0xE2, 0x82], np.uint8)
    assert decontaminate.folded(broken, np.array([0, 3, 7])).chars.tolist() == [0x61, 0xFFFD, 0x28, 0xFFFD, 0xFFFD]


# ---------------------------------------------------------------- mixing

def test_mixture(spark, odd):
    rows = [(i, "a" if i < 600 else "b" if i < 700 else None, "word " * (1 + i % 7)) for i in range(750)] + [(9999, "zero", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").selectExpr("*", "doc_id as at", "source as quota")
    size = {i: len(t.split()) for i, _, t in rows}
    tokens = Counter()
    for i, s, _ in rows:
        tokens[s] += size[i]
    got = mixing.mix_sources(docs, repetitions=3.0, block_tokens=500).collect()
    placed = Counter()
    for r in got:
        placed[r.source] += r.n_tokens
    passes = {s: placed[s] / tokens[s] for s in ("a", "b", None)}
    assert abs(passes["a"] - 1) < 0.02 and max(passes.values()) <= 3.1 and max(passes.values()) > 2.8
    assert {r.doc_id for r in got} == {i for i, _, _ in rows if i != 9999}
    assert all(c <= math.ceil(passes[s] + 0.01) for (_, s), c in Counter((r.doc_id, r.source) for r in got).items())
    assert len({(r.block, r.position) for r in got}) == len(got)
    share = Counter()
    for r in got:
        share[r.block, r.source] += r.n_tokens
    for b in range(1, max(r.block for r in got)):
        assert all(abs(share[b, s] - 500 * placed[s] / sum(placed.values())) < 30 for s in placed)
    assert got and sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(5), repetitions=3.0, block_tokens=500).collect()))
    assert mixing.mix_sources(docs.filter("false")).count() == 0
    assert mixing.mix_sources(odd).filter("n_tokens = 0").count() == 0


def test_exponent_meets_entropy(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10)], "source string, n_tokens long")

    def entropy(t):
        w = np.array([1000, 100, 10]) ** t
        w /= w.sum()
        return float(-(w * np.log(w)).sum())

    for target in (0.5, 0.8, 1.0):
        assert abs(entropy(mixing.temperature(sources, entropy=target)) - target) < 1e-4
    assert mixing.temperature(sources, entropy=2.0) == 0.0 and mixing.temperature(sources, entropy=0.01) == 1.0
    assert abs(100 ** (1 - mixing.temperature(sources, repetitions=4)) - 4) < 1e-3
