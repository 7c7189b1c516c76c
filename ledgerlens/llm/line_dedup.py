"""Operator 10, line dedup: explode normalised lines, hash, count distinct
documents per hash, drop lines over the threshold, reassemble by position.

A line's key is the line without white space at both ends, A-Z lower-cased. Keys
of at least ``min_chars`` code points found in at least ``min_docs`` documents lose
every line except in the largest doc_id that holds the key.

Defined results: null or empty text is one empty line and stays; a document is a
doc_id (repeated rows of one doc_id count once, each row is cleaned); a null doc_id
is one document that ranks below all others; an empty table gives an empty table;
columns of the input named like an output (``n_lines``, ``n_dropped``,
``kept_text``) are replaced, all others are kept.

Scale: only (hash, doc_id, position) of long enough lines is shuffled for the
counts, with map-side partial aggregates, so a line in a third of all documents is
collapsed before the exchange; the join that marks lines is a plain sort-merge join
whose hot key AQE may split; texts move once, to meet their drop positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER, UPPER, WS_CHARS, Stored, cols, stored, table, without

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(WS_CHARS)), UPPER, LOWER)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per long enough line: hash of its key (two longs, 128 bits), doc_id, hash of the row's text, position."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"),
                        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keyed.select("doc_id", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def drop_positions(spark: SparkSession, docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, th, drops): the sorted positions of the lines each document loses."""
    lines = Stored(spark, line_hashes(docs, min_chars), "lines").df
    # keys with enough lines at all; lines of one document repeat, so the documents are counted after
    often = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h1", "h2")
    hits = stored(spark, lines.join(often, ["h1", "h2"]), "hits")
    per_doc = hits.select("h1", "h2", "doc_id").distinct()
    bad = (per_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
           .where(F.col("n") >= min_docs).select("h1", "h2", "last"))
    lost = hits.join(bad, ["h1", "h2"]).where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last")))
    return lost.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("drops"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with n_lines, n_dropped and kept_text (lines joined by \\n; null text: empty)."""
    keep = without(docs, "n_lines", "n_dropped", "kept_text")
    drops = drop_positions(spark, docs, min_chars, min_docs).select(
        F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), F.col("drops").alias("__drops"))
    both = docs.select(*cols(keep)).join(
        drops, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__th")), "left")
    text = F.coalesce("text", F.lit(""))
    n = F.coalesce(F.size("__drops"), F.lit(0))
    lines = F.split(text, "\n")
    # runs of kept lines between the dropped positions: linear in the number of lines
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("__drops", i - 1) + 1)
    end = lambda i: F.when(i == F.size("__drops"), F.size("__lines")).otherwise(F.get("__drops", i))
    runs = F.flatten(F.transform(F.sequence(F.lit(0), F.size("__drops")), lambda i: F.slice("__lines", start(i) + 1, end(i) - start(i))))
    both = both.withColumn("__lines", F.when(F.col("__drops").isNotNull(), lines))
    return both.select(*cols(keep),
                       (F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
                       n.cast("long").alias("n_dropped"),
                       F.when(n == 0, text).otherwise(F.array_join(runs, "\n")).alias("kept_text"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos, len(lines) AS n FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.*, bad.key IS NOT NULL AND doc_id < last AS gone FROM k LEFT JOIN bad USING (key))
SELECT doc_id, max(n) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
