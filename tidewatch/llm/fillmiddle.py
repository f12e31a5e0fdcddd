"""Fill-in-the-middle: texts cut at two unit boundaries and put together anew, by regular expressions in the JVM.

A counting match gives a text's n units. Two seeded draws a <= b from 0..n name the cuts, and one match of a pattern made for the
row, unit{a} unit{b-a} and the rest, captures prefix, middle and suffix; the replacement of that one match is the whole output.
Both groups are possessive, so the matcher never steps back over units and needs no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units that tile any text from left to right.
UNITS = {"line": r"[^\n]*\n|[^\n]+", "word": r"\s*\S+|\s+", "character": r"(?s:.)"}
PLAIN, PSM, SPM = "plain", "psm", "spm"


def _draws(seed: int, doc_id: str) -> list[Column]:
    """Four unsigned 32-bit numbers of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "line", seed: int = 7, percent: int = 100, spm_percent: int = 50,
                   tags: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n (units), form, output, prefix_chars, middle_chars.

    ``percent`` of the texts are transformed, ``spm_percent`` of these with the suffix first. A text that is empty, null (read as
    empty) or holds a tag stays plain, with null lengths, so that every output reads back. Draws depend on seed and doc_id alone, so
    repeated rows come out alike; a null id draws as the empty one. Columns other than doc_id and text are not read.
    """
    one = UNITS[unit]
    p, s, m = tags
    if "" in tags or any("$" in t or "\\" in t for t in tags) or any(a[0] in b[1:] or (i != k and b.startswith(a)) for i, a in enumerate(tags) for k, b in enumerate(tags)):
        raise ValueError("tags need a first character found nowhere else in them, none may begin another, and $ and backslash are out")
    h1, h2, h3, h4 = _draws(seed, "doc_id")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text")).withColumns(
        {"n": F.regexp_count("_text", F.lit(one)).cast("long"), "_h1": h1, "_h2": h2})
    x, y = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    held = F.col("_text").contains(p) | F.col("_text").contains(s) | F.col("_text").contains(m)
    form = F.when((F.col("_text") == "") | held | (h3 % 100 >= percent), PLAIN).when(h4 % 100 < spm_percent, SPM).otherwise(PSM)
    pattern = F.format_string(f"\\A((?:{one}){{%d}}+)((?:{one}){{%d}}+)((?s:.*))\\z".replace("%d", "\0").replace("%", "%%").replace("\0", "%d"),
                              F.least(x, y), F.greatest(x, y) - F.least(x, y))
    shaped = counted.withColumn("form", form).withColumn("output", F.when(F.col("form") == PLAIN, F.col("_text")).otherwise(F.regexp_replace(
        "_text", pattern, F.when(F.col("form") == SPM, f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2"))))
    parts = {k: F.when(F.col("form") != PLAIN, F.length(c)).cast("long") for k, c in zip(("prefix_chars", "middle_chars"), _parts(tags), strict=False)}
    return shaped.select("doc_id", "n", "form", "output", *(c.alias(k) for k, c in parts.items()))


def _parts(tags: tuple[str, str, str]) -> tuple[Column, Column, Column]:
    """(prefix, middle, suffix) of a transformed output, which holds each tag once."""
    p, s, m = tags
    out, spm = F.col("output"), F.col("form") == SPM

    def after(tag: str) -> Column:
        return F.substring_index(out, tag, -1)

    return (F.when(spm, F.substring_index(after(p), m, 1)).otherwise(F.substring_index(after(p), s, 1)), after(m),
            F.when(spm, F.substring_index(after(s), p, 1)).otherwise(F.substring_index(after(s), m, 1)))


def restored(tags: tuple[str, str, str] = ("<P>", "<S>", "<M>")) -> Column:
    """The exact text of a row of `fill_in_middle`, from output and form alone."""
    prefix, middle, suffix = _parts(tags)
    return F.when(F.col("form") == PLAIN, F.col("output")).otherwise(F.concat(prefix, middle, suffix))
