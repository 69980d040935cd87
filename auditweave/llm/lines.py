"""Line dedup: lines that many documents share leave every document.

A line's key is the line without white space at both ends, A-Z in lower case.  Keys are counted
once a row (the distinct keys of a text are exploded, so a partial count is made before the
shuffle), by two independent 64-bit hashes.  Positions of frequent keys meet their text again by
two hashes of the whole text, so copies share one list and a missing or repeated doc_id does no
harm.  Lines keep their order.

Rows: every row is a document, repeated rows too; null and empty text is one empty line; keys
shorter than ``min_chars`` code points stay; an empty table gives an empty result; all other columns
are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_DOCS = 10
MIN_CHARS = 1
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = " \t\n\x0b\x0c\r"
_P = "__aw_"


def two_hashes(c: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that don't depend on each other."""
    return F.xxhash64(c), F.xxhash64(F.lit("second"), c)


def line_keys(text: Column) -> Column:
    lowered = F.translate(text, _UPPER, _UPPER.lower())
    return F.transform(F.split(lowered, "\n", -1), lambda x: F.btrim(x, F.lit(_BLANKS)))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of ``docs`` with frequent lines dropped from ``text``, and two more columns:
    ``__aw_lines`` (lines before) and ``__aw_dropped``."""
    common.shared_folder(docs.sparkSession)
    text = common.text_of()
    a, b = two_hashes(text)
    keys = docs.select(a.alias("ta"), b.alias("tb"), line_keys(text).alias("keys"))
    ka, kb = two_hashes(F.col("key"))
    frequent = (
        keys.select(F.explode(F.array_distinct("keys")).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select(ka.alias("ka"), kb.alias("kb"))
        .groupBy("ka", "kb")
        .count()
        .where(F.col("count") >= min_docs)
        .select("ka", "kb")
        .checkpoint()  # a plain side of the join below: only then can Spark split a hot line's rows
    )
    dropped = (
        keys.select("ta", "tb", F.posexplode("keys").alias("at", "key"))
        .where(F.char_length("key") >= min_chars)
        .select("ta", "tb", "at", ka.alias("ka"), kb.alias("kb"))
        .join(frequent, ["ka", "kb"], "left_semi")
        .groupBy("ta", "tb")
        .agg(F.collect_set("at").alias(_P + "at"))
        .select(F.col("ta").alias(_P + "a"), F.col("tb").alias(_P + "b"), _P + "at")
        .checkpoint()  # likewise for the copies of one text
    )
    lines = F.split(common.text_of(), "\n", -1)
    joined = docs.withColumn(_P + "a", a).withColumn(_P + "b", b).join(dropped, [_P + "a", _P + "b"], "left")
    at, n = F.col(_P + "at"), F.size(lines)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), n - 1), at), lambda i: F.get(lines, i))
    new = F.when(at.isNull(), F.col("text").cast("string")).otherwise(F.array_join(kept, "\n"))
    dropped_n = F.coalesce(F.size(at), F.lit(0))
    columns = [new.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, n.cast("long").alias(_P + "lines"), F.when(at.isNull(), 0).otherwise(dropped_n).cast("long").alias(_P + "dropped"))


def drop_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with frequent lines dropped from ``text``, and n_chars, if there, counted anew."""
    out = dedup_lines(docs, min_docs, min_chars)
    size = F.char_length("text")
    return out.select(*[size.cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col(_P + "lines").alias("n_lines"),
        F.col(_P + "dropped").alias("n_dropped"),
        F.sha2(common.text_of(), 256).alias("kept_sha256"),
    )


ORACLE_SQL = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
lines AS (
  SELECT r, doc_id, pos, line,
    trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
  FROM (SELECT r, doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
        FROM (SELECT r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM docs))),
frequent AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
marked AS (SELECT r, doc_id, pos, line, f.key IS NOT NULL AS hit FROM lines LEFT JOIN frequent f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE hit) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT hit), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
