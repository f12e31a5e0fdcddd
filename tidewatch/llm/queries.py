"""Registered queries of the text operators, each over its whole table, and their SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN ws ELSE ws[i:i + 2] END AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL)
 JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM r JOIN links l ON l.x = r.y),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, y IS NULL OR doc_id <= y AS kept
FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON x = doc_id""")
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


@query()
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats
    return remove_repeats(table(spark, sf_dir, "documents"), length=200).drop("spans")


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .tokencount import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query()
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maintext import extract_main_text
    return extract_main_text(table(spark, sf_dir, "pages"))


@query(r"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
f AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'), '(\[/INST\]|<\|media:|\[/TURN\]|\[INST\]|\[/SYS\]|\[TURN\]|\[SYS\]|\[ANS\]|\[SEP\]|</s>|<s>)', '\1x', 'g'))
 + CASE role WHEN 'user' THEN 13 WHEN 'system' THEN 11 WHEN 'assistant' THEN 9 ELSE 18 + length(role) END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(3 + sum(chars) AS BIGINT) AS formatted_chars FROM f GROUP BY conv_id""")
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chatformat import format_conversations, read_conversations
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return read_conversations(format_conversations(rows.unionByName(extra)))


@query("""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages)
SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 1 + CAST(5 * i // 4 AS INTEGER), 2) AS INTEGER) >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31), 1)), '') AS payload_digest,
 CASE WHEN page_id = min(page_id) OVER (PARTITION BY html) THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN page_id <> min(page_id) OVER (PARTITION BY html) THEN min(page_id) OVER (PARTITION BY html) END AS refers_to FROM p""")
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .qualityrules import quality_rules
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxent import score_documents
    return score_documents(table(spark, sf_dir, "documents"))


@query()
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources
    return mix_sources(table(spark, sf_dir, "documents"))


@query()
def op11_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


@query(r"""WITH RECURSIVE bits AS (SELECT i, 0 AS k, i AS c FROM range(256) r(i)
 UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
 FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1, text FROM benchmark)),
v AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(hex) // 2 + 1), lambda i: CAST('0x' || substr(hex, 2 * i - 1, 2) AS BIGINT))),
 lambda c, b: xor(tab[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT word, hex(encode(word)) AS hex FROM w), crc),
f AS (SELECT doc_id, bucket, count(*) AS n FROM w JOIN v USING (word) GROUP BY ALL),
b AS (SELECT bucket, coalesce(sum(n) FILTER (doc_id <> -1), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (doc_id = -1), 0)::DOUBLE AS t FROM f GROUP BY bucket),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM b) + 10000) / ((s + 1) * ((SELECT sum(t) FROM b) + 10000))))::BIGINT AS gain FROM b),
d AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM f JOIN g USING (bucket) GROUP BY doc_id),
e AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln(
 (CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM documents LEFT JOIN d USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM e WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM e LEFT JOIN r USING (doc_id)""")
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


@query(r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || doc_id) AS hex FROM documents),
h AS (SELECT *, len(units) AS n, CAST('0x' || substr(hex, 1, 8) AS BIGINT) % (len(units) + 1) AS x, CAST('0x' || substr(hex, 9, 8) AS BIGINT) % (len(units) + 1) AS y,
 CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(hex, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
 WHEN CAST('0x' || substr(hex, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, n, form, text, array_to_string(units[1:least(x, y)], '') AS pre, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') AS mid,
 array_to_string(units[greatest(x, y) + 1:], '') AS suf FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
 sha256(text) AS restored_sha256 FROM p""")
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fillmiddle import fill_in_middle, restored
    rows = fill_in_middle(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))
