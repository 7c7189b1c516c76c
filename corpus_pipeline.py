"""The corpus pipeline: training-data operators over ``documents``, each stage written as
Parquet and read again by the next one.

1. quality: documents that the classifier rejects go.
2. lines: lines that many documents share go; a null text stays null.
3. near_duplicates: of rows linked by 5-word shingles at 0.8 the one with the smallest doc_id stays, of several with that
   doc_id the one with the smallest hash of its text. A shared doc_id links no rows; rows without a doc_id all stay.
4. mix: documents appear as often as the mix takes them, those taken in part with the words taken.
5. pack: pieces of token sequences with their ids.

The stages but the last return the columns of the table they get; ``n_chars``, if there is one, follows the text.
Other columns pass through whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import jaccard_join, line_dedup, mixing, packing, site_quality
from ledgerlens.llm.common import Stored, cols, stored, table
from ledgerlens.session import scratch_scope


def _packed(docs: DataFrame, own: Sequence[str]) -> DataFrame:
    """The columns that a stage works with, and all others as one, so that no name of theirs can clash."""
    others = [c for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(F.lit(0).alias("none"), *[c.alias(f"c{i}") for i, c in enumerate(cols(others))]).alias("others"))


def _unpacked(df: DataFrame, docs: DataFrame, own: Sequence[str], text_changed: bool = False) -> DataFrame:
    """The columns of ``docs`` again."""
    place = {c: f"c{i}" for i, c in enumerate(c for c in docs.columns if c not in own)}
    out = []
    for c in docs.columns:
        col = F.col("others")[place[c]] if c in place else F.col(c)
        out.append((F.char_length("text").cast(docs.schema[c].dataType) if text_changed and c == "n_chars" else col).alias(c))
    return df.select(*out)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = ["doc_id", "text", "source", "lang"]
    return _unpacked(site_quality.classify(spark, _packed(docs, own), table(spark, sf_dir, "labels")).where("kept"), docs, own)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = ["doc_id", "text"]
    out = line_dedup.drop_repeated_lines(spark, _packed(docs, own))
    return _unpacked(out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text"))), docs, own, True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = ["doc_id", "text"]
    rows = _packed(docs, own)
    known = rows.where("doc_id is not null")
    if known.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        # numbers that rise with doc_id and text; written, as they differ from run to run
        known = stored(spark, known.orderBy("doc_id", F.xxhash64("text"), F.xxhash64("others")).withColumn("row", F.monotonically_increasing_id()), "rows")
    else:
        known = known.withColumn("row", F.col("doc_id"))
    linked = jaccard_join.link_documents(spark, known.select(F.col("row").alias("doc_id"), "text"))
    gone = stored(spark, linked.where("doc_id <> component_id").select(F.col("doc_id").alias("row")), "gone")
    kept = known.join(gone, "row", "left_anti").select(*own, "others").union(rows.where("doc_id is null"))
    return _unpacked(kept, docs, own)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own = ["doc_id", "text", "source"]
    return _unpacked(mixing.mixed_texts(spark, _packed(docs, own)), docs, own, True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(spark, docs, with_ids=True)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

#: SQL has neither the Jaccard components nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. A stage's scratch tables and the table it read go once its result is written."""
    docs, read = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch_scope(spark) as scope:
            out = Stored(spark, stage(spark, docs, sf_dir), name)
            scope.keep(out.path)
        if read is not None:
            read.drop()
        docs, read = out.df, out
    return STAGES[-1][1](spark, docs, sf_dir)
