"""Operator 1, mixing sources to target weights (DataFrame functions only):
Sainte-Lague apportionment. Equal-token blocks go to sources by highest quotients,
each source's blocks go to its shards by highest quotients again, which gives
integer quotas per shard, and each shard takes its quota of blocks in a seeded order.

A document's size is its number of words. Sources, by code point and null last,
weigh ``weights`` in turn and share ``share`` of all words; a target stops at
``cap`` times its source's words and the excess is shared again by weight (a water
level over cap / weight, so a closed form). A shard is a seeded hash class of one
source's documents, about ``shard_words`` words; its documents in seeded order form
a stream of words, cut into blocks of ``block`` words. With quota q and m blocks,
the shard gives the whole stream q div m times and, once more, the q mod m blocks
that follow a seeded block; a block run is an interval, so what a document gives is
two differences and no block is ever a row.

Defined results: null text has size 0; a null source is a source of its own; equal
rows are separate documents; a source without words has target 0; an empty table
gives an empty table; columns of the input are kept, but for those named like an
output (size, source_size, target, taken, passes, span_start, span_end).

Scale: per-source and per-shard sums are pre-aggregated before their exchange, and
the windows run over one shard (bounded words) or over the table of sources. The
source table joins by broadcast only when its row count is checked to be small,
else salted, so that a source with a third of all rows is spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlens.llm.common import WORD_RE, cols, stored, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
BLOCK = 32
SHARD_WORDS = 1_000_000
SEED = 17
#: A source table of at most this many rows (under 10 MB) is broadcast.
BROADCAST_SOURCES = 100_000
SALTS = 64

def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def hash32(*parts: Column) -> Column:
    """Unsigned 32 bits of md5 over the parts, the same in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sources (source, source_size) with rank and target: least(cap * size, level * weight)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    s = (sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("w", w)
         .withColumn("limit", cap * F.col("source_size")))
    # sources fill up in the order of limit / weight: the level is the first at which the rest fits under its limits
    order = Window.orderBy(F.col("limit") / F.col("w"), "rank")
    everything = Window.partitionBy()
    s = (s.withColumn("full", F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("rest_w", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("total", share * F.sum("source_size").over(everything))
         .withColumn("try", (F.col("total") - F.col("full")) / F.col("rest_w"))
         .withColumn("level", F.min(F.when(F.col("try") * F.col("w") <= F.col("limit"), F.struct(F.col("limit") / F.col("w"), "rank", "try"))).over(everything)["try"]))
    return s.select("source", "source_size", "rank",
                    F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least("limit", F.col("level") * F.col("w"))).alias("target"))


def sainte_lague(votes: DataFrame, group: list[str], vote: str, seats: str, order: str) -> DataFrame:
    """``votes`` with column quota: the ``seats`` of each group go to the highest
    quotients vote / (2k + 1), ties to the smaller ``order``. All seats but two a
    party are given by the divisor bounds; only the quotients between the bounds are ranked."""
    g = Window.partitionBy(*group)
    v = F.col(vote)
    low = F.greatest(F.col(seats) - F.col("__n") / 2.0, F.lit(0.0))   # a divisor that gives at most the seats
    high = F.col(seats) + F.col("__n") / 2.0 + 1                     # and one that gives at least them
    part = votes.withColumn("__n", F.count(F.lit(1)).over(g)).withColumn("__sum", F.sum(v).over(g))
    got = lambda s: F.when((F.col("__sum") > 0) & (F.col(seats) > 0), F.floor(v * s / F.col("__sum") + 0.5)).otherwise(F.lit(0)).cast("long")
    part = (part.withColumn("__low", F.greatest(got(low) - 1, F.lit(0))).withColumn("__high", got(high) + 1)
            .withColumn("__open", F.col(seats) - F.sum("__low").over(g)))
    ranked = (part.where((F.col("__high") > F.col("__low")) & (v > 0) & (F.col(seats) > 0)).select(*group, order, vote, "__open", F.explode(F.sequence("__low", F.col("__high") - 1)).alias("__k"))
              .withColumn("__q", v / (2 * F.col("__k") + 1))
              .withColumn("__rank", F.row_number().over(g.orderBy(F.col("__q").desc(), order, "__k")))
              .where("__rank <= __open").groupBy(*group, order).agg(F.count(F.lit(1)).alias("__more")))
    return part.join(ranked, [*group, order], "left").select(*votes.columns, (F.col("__low") + F.coalesce("__more", F.lit(0))).alias("quota"))


def mix(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP,
        block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, th, size, source_size, target, taken, passes, span_start, span_end) for
    every row of ``docs``; ``th`` is the hash of the row's text. The mix takes each document
    ``passes`` times whole and its words [span_start, span_end) once more."""
    sizes = stored(spark, docs.select("doc_id", "source", F.xxhash64("text").alias("th"), words_in(F.col("text")).alias("size")), "sizes")
    srcs = stored(spark, targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
                  .withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
                  .withColumn("one", F.lit(0)), "sources")
    quotas = (sainte_lague(srcs, ["one"], "target", "blocks", "rank")
              .select("source", "rank", "source_size", "target", F.col("quota").alias("source_blocks"),
                      F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).alias("shards")))
    quotas = stored(spark, quotas, "quotas")
    # every document meets its source's row
    small = quotas.select(F.col("source").alias("__s"), "rank", "shards")
    if srcs.count() <= BROADCAST_SOURCES:
        placed = sizes.join(F.broadcast(small), F.col("source").eqNullSafe(F.col("__s")))
    else:
        salted = sizes.withColumn("__salt", F.abs(F.xxhash64("doc_id", "th")) % SALTS)
        copies = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
        placed = salted.join(copies.withColumnRenamed("__salt", "__salt2"), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__salt") == F.col("__salt2"))).drop("__salt", "__salt2")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    placed = (placed.drop("__s").withColumn("shard", hash32(F.lit(f"shard{seed}"), key) % F.col("shards"))
              .withColumn("turn", hash32(F.lit(f"turn{seed}"), key)))
    # quotas per shard
    per_shard = placed.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"))
    per_shard = per_shard.join(quotas.select("rank", "source_blocks"), "rank").withColumn("votes", F.col("shard_size").cast("double"))
    shard_q = sainte_lague(per_shard, ["rank"], "votes", "source_blocks", "shard")
    m = F.ceil(F.col("shard_size") / block)
    q = F.least(F.col("quota"), (cap * m).cast("long"))
    shard_q = shard_q.select(
        "rank", "shard", F.when(m > 0, F.floor(q / m)).otherwise(0).cast("long").alias("passes"),
        F.when(m > 0, q % m).otherwise(0).cast("long").alias("more"), m.alias("m"))
    # a run of `more` blocks from a seeded first block, not past the end
    first = hash32(F.lit(f"first{seed}"), F.col("rank").cast("string"), F.col("shard").cast("string")) % (F.col("m") - F.col("more") + 1)
    shard_q = (shard_q.withColumn("first", F.when(F.col("more") > 0, first).otherwise(0))
               .select("rank", "shard", "passes", (F.col("first") * block).alias("from"), ((F.col("first") + F.col("more")) * block).alias("to")))
    # positions of the documents in their shard's stream
    stream = Window.partitionBy("rank", "shard").orderBy("turn", F.col("doc_id").asc_nulls_last(), "size", "th")
    at = F.sum("size").over(stream.rowsBetween(Window.unboundedPreceding, 0))
    out = (placed.withColumn("end", at).join(shard_q, ["rank", "shard"]).join(
        F.broadcast(quotas.select("rank", "source_size", "target")) if srcs.count() <= BROADCAST_SOURCES else quotas.select("rank", "source_size", "target"), "rank"))
    clip = lambda x: F.greatest(F.lit(0), F.least(F.col("size"), x - (F.col("end") - F.col("size"))))
    return (out.withColumn("span_start", clip(F.col("from"))).withColumn("span_end", clip(F.col("to")))
            .select("doc_id", "source", "th", "size", "source_size", "target",
                    (F.col("passes") * F.col("size") + F.col("span_end") - F.col("span_start")).alias("taken"),
                    "passes", "span_start", "span_end"))


def mixed_texts(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the mix takes it whole, and once more
    with the words of its span where the mix takes a part (the span's words joined by a space;
    a span of all words is the text as it is). Documents of which nothing is taken go."""
    plan = stored(spark, mix(spark, docs, **options).where("taken > 0").select(
        F.col("doc_id").alias("__doc"), F.col("source").alias("__source"), F.col("th").alias("__th"), "size", "passes", "span_start", "span_end"), "mix")
    key = ["__doc", "__source", "__th"]
    rows = docs.withColumn("__h", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("source").eqNullSafe(F.col("__source")) & (F.col("__h") == F.col("__th"))
    if plan.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count():
        # equal rows share one key: the k-th of them, by the rest of their columns, takes the k-th entry
        rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("doc_id", "source", "__h").orderBy(F.xxhash64(*cols(docs.columns)))))
        plan = plan.withColumn("__at", F.row_number().over(Window.partitionBy(*key).orderBy("span_start", "span_end")))
        same = same & (F.col("__nth") == F.col("__at"))
    rows = rows.join(plan.select(*key, *(["__at"] if "__at" in plan.columns else []), F.struct("size", "passes", "span_start", "span_end").alias("__p")), same)
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD_RE})"), 1), (F.col("__p.span_start") + 1).cast("int"), (F.col("__p.span_end") - F.col("__p.span_start")).cast("int")), " ")
    partial = F.when(F.col("__p.span_end") - F.col("__p.span_start") == F.col("__p.size"), F.col("text")).when(F.col("__p.span_end") > F.col("__p.span_start"), part)
    copies = F.concat(F.array_repeat(F.col("text"), F.col("__p.passes").cast("int")), F.array_compact(F.array(partial)))
    rows = rows.withColumn("__text", F.explode(copies))
    return rows.select(*[F.col("__text").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "passes", "span_start", "span_end")


def op1_sql(block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> str:
    """The same mix in DuckDB; the seats are dealt one by one there, from all quotients."""
    def h(*parts: str) -> str:
        return "CAST('0x' || substr(md5(" + " || '|' || ".join(parts) + "), 1, 8) AS BIGINT)"

    return f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size, coalesce(text, '') AS text FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s0),
s2 AS (SELECT *, (CASE rank % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w, 2.0::DOUBLE * source_size AS lim FROM s1),
s3 AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
              coalesce(sum(lim) OVER (ORDER BY lim / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
              sum(w) OVER (ORDER BY lim / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_w FROM s2),
lev AS (SELECT (total - full_) / rest_w AS level FROM s3 WHERE (total - full_) / rest_w * w <= lim ORDER BY lim / w, rank LIMIT 1),
s4 AS (SELECT source, source_size, rank, least(lim, coalesce((SELECT level FROM lev) * w, lim)) AS target FROM s3),
house AS (SELECT round(sum(target) / {block})::BIGINT AS blocks FROM s4),
seats AS (SELECT rank, target / (2 * k + 1) AS q, k FROM s4, (SELECT unnest(range(0, (SELECT blocks FROM house))) AS k) WHERE target > 0),
won AS (SELECT rank FROM seats ORDER BY q DESC, rank, k LIMIT (SELECT blocks FROM house)),
sq AS (SELECT rank, count(*) AS source_blocks FROM won GROUP BY rank),
p AS (SELECT d.*, s4.rank, s4.source_size, s4.target,
             {h(f"'shard{seed}'", "coalesce(doc_id::VARCHAR, 'null')")} % greatest(ceil(s4.source_size / {shard_words}.0)::BIGINT, 1) AS shard,
             {h(f"'turn{seed}'", "coalesce(doc_id::VARCHAR, 'null')")} AS turn
      FROM d JOIN s4 ON d.source IS NOT DISTINCT FROM s4.source),
sh AS (SELECT rank, shard, sum(size)::BIGINT AS shard_size FROM p GROUP BY rank, shard),
shseats AS (SELECT rank, shard, row_number() OVER (PARTITION BY rank ORDER BY shard_size::DOUBLE / (2 * k + 1) DESC, shard, k) AS place
            FROM sh, (SELECT unnest(range(0, (SELECT max(source_blocks) FROM sq))) AS k) WHERE shard_size > 0),
shq AS (SELECT shseats.rank, shard, count(*) AS quota FROM shseats JOIN sq ON sq.rank = shseats.rank AND place <= source_blocks GROUP BY ALL),
q0 AS (SELECT sh.rank, sh.shard, ceil(shard_size / {block}.0)::BIGINT AS m, coalesce(quota, 0) AS quota FROM sh LEFT JOIN shq USING (rank, shard)),
q1 AS (SELECT rank, shard, m, least(quota, 2 * m) AS q FROM q0),
q2 AS (SELECT rank, shard, CASE WHEN m > 0 THEN q // m ELSE 0 END AS passes, CASE WHEN m > 0 THEN q % m ELSE 0 END AS more, m FROM q1),
q3 AS (SELECT *, CASE WHEN more > 0 THEN {h(f"'first{seed}'", "rank::VARCHAR", "shard::VARCHAR")} % (m - more + 1) ELSE 0 END AS first_ FROM q2),
e AS (SELECT p.*, passes, first_ * {block} AS from_, (first_ + more) * {block} AS to_,
             sum(size) OVER (PARTITION BY p.rank, p.shard ORDER BY turn, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start_
      FROM p JOIN q3 ON p.rank = q3.rank AND p.shard = q3.shard),
f AS (SELECT *, greatest(0, least(size, from_ - start_)) AS span_start, greatest(0, least(size, to_ - start_)) AS span_end FROM e)
SELECT doc_id, size, source_size, target, (passes * size + span_end - span_start)::BIGINT AS taken, passes::BIGINT AS passes,
       span_start::BIGINT AS span_start, span_end::BIGINT AS span_end FROM f
"""
