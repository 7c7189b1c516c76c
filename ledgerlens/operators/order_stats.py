"""Order statistics without a single-partition sort.

``prefix_sums``   running sums over a global order (ROC/PR curves, AUC, AP).
``exact_quantiles`` exact, linearly interpolated quantiles (describe, IQR,
                  deciles, median imputation) — same values as pandas
                  ``quantile`` / DuckDB ``quantile_cont``.

Quantiles are found by repeated narrowing: a sketch gives two bounds that hold each
wanted rank between them, one pass counts the values outside the bounds and keeps
the distinct values inside with their counts (a few in ten thousand of the rows; a heavy
value is one of them). Those are cut at sketched bounds again, and only the piece that holds a
wanted rank is kept, until no piece has more than ``WINDOW_ROWS`` values to be sorted. The bounds limit the
work; the ranks come from exact counts, and a rank that lies outside its bounds is an error, not a guess.

Running sums take one range-partitioned sort: each partition reports its totals by its id,
and a running sum inside a partition starts from the totals of those before it. What is
broadcast has one row per partition.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

#: Distinct values that one task sorts to pick a rank.
WINDOW_ROWS = 100_000
#: Pieces that a round of narrowing makes of each.
PIECES = 200
#: Rank error of the sketch: one in so many rows.
SKETCH = 10_000


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read back: consumers share one evaluation. The table goes with
    the open ``session.scratch_scope``."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def prefix_sums(df: DataFrame, order: str, sums: list[str], descending: bool = False, inclusive: bool = True,
                n_partitions: int | None = None, prefix: str = "cum_", then: list[str] | None = None) -> DataFrame:
    """Add ``cum_<c>`` = sum of ``c`` over rows that come before (and, if
    ``inclusive``, at) each row in ``order``, then by the columns of ``then``.

    (order, *then) must be unique (aggregate first). ``n_partitions`` defaults to the session's shuffle
    partitions; a partition is sorted with spill, so more rows need no more of them than other sorts do.
    """
    n = n_partitions or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8")))
    ordc = [F.col(c).desc() if descending else F.col(c).asc() for c in [order, *(then or [])]]
    # written: the ids of the partitions stay with their rows
    x = written(df.repartitionByRange(n, *ordc).withColumn("_b", F.spark_partition_id()), "prefix")

    totals = x.groupBy("_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    # one row per partition
    w_t = Window.partitionBy().orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_b", *[F.coalesce(F.sum(f"_t_{c}").over(w_t), F.lit(0)).alias(f"_o_{c}") for c in sums])
    x = x.join(F.broadcast(offsets), "_b")      # n rows

    w = Window.partitionBy("_b").orderBy(*ordc).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = x.select("*", *[(F.coalesce(F.sum(c).over(w), F.lit(0)) + F.col(f"_o_{c}")).alias(f"{prefix}{c}")
                          for c in sums])
    return out.drop("_b", *[f"_o_{c}" for c in sums])


def _ranks(probs: list[float]) -> list[tuple[float, str, Column, Column]]:
    """(q, end, position, rank) of the values that each quantile lies between, of ``_n`` rows."""
    out = []
    for q in probs:
        pos = F.lit(float(q)) * (F.col("_n") - 1).cast("double")
        out += [(float(q), "lo", pos, F.floor(pos)), (float(q), "hi", pos, F.ceil(pos))]
    return out


def _narrowed(kept: DataFrame, by: list[str], probs: list[float], limit: int) -> DataFrame:
    """The values that may have a wanted rank, at most ``limit`` in a piece.

    ``kept`` has one row per value and piece: (*by, _n, _r piece, _k value, _c rows, _before rows that
    come before the piece). A round drops all but 1 in ``PIECES`` of a piece's values.
    """
    key = [*by, "_r"]
    while True:
        sizes = kept.groupBy(*key).agg(F.count(F.lit(1)).alias("_m"), F.percentile_approx(
            "_k", [i / PIECES for i in range(1, PIECES)], 10 * PIECES).alias("_cuts"))
        sizes = written(sizes.withColumn("_cuts", F.when(F.col("_m") > limit, F.col("_cuts"))), "cuts")     # one row per piece
        if (sizes.agg(F.max("_m")).head()[0] or 0) <= limit:
            return kept
        cut = F.coalesce(F.size(F.filter("_cuts", lambda c: c < F.col("_k"))), F.lit(0))
        x = kept.join(F.broadcast(sizes), key).withColumn("_s", cut).drop("_m", "_cuts")
        totals = x.groupBy(*key, "_n", "_s").agg(F.sum("_c").alias("_t"), F.max("_before").alias("_o"))
        first = F.coalesce(F.sum("_t").over(
            Window.partitionBy(*key).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))   # at most PIECES rows
        totals = totals.withColumn("_o", F.col("_o") + first)
        wanted = F.lit(False)
        for _, _, _, k in _ranks(probs):
            wanted = wanted | ((k >= F.col("_o")) & (k < F.col("_o") + F.col("_t")))
        pieces = totals.where(wanted).select(*key, "_s", "_o")      # one row per wanted rank at most
        x = x.join(F.broadcast(pieces), [*key, "_s"])
        kept = written(x.select(*by, "_n", (F.col("_r") * PIECES + F.col("_s")).alias("_r"), "_k", "_c", F.col("_o").alias("_before")), "ranks")


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None,
                    window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Exact quantiles with linear interpolation: for each group and ``q`` the
    value at position ``q * (n - 1)`` of the sorted non-null values.

    ``by`` must have few groups (columns of a table, classes). ``window_rows`` bounds the values
    that one task sorts.
    Returns ``(*by, q, quantile)``.
    """
    by = list(by or [])
    x = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    slack = 4 / SKETCH
    fracs = [min(max(q + s, 0.0), 1.0) for q in probs for s in (-slack, slack)]
    sketch = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", fracs, SKETCH).alias("_s"),
                                F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    small = F.col("_n") <= SKETCH       # the slack is under two ranks: keep every distinct value
    bounds = sketch.select(*by, "_n", *[
        F.when(small, F.col(end)).otherwise(F.get("_s", F.lit(2 * i + j))).alias(f"_b{i}{j}")
        for i in range(len(probs)) for j, end in ((0, "_min"), (1, "_max"))])
    bounds = written(bounds, "bounds")          # one row per group
    if by:
        x = x.join(F.broadcast(bounds), by)
    else:
        x = x.withColumns({c: bounds.select(c).scalar() for c in bounds.columns})
    v = F.col("_v")
    inside = region = None
    for i in range(len(probs)):
        a, b = v >= F.col(f"_b{i}0"), v > F.col(f"_b{i}1")
        inside = (a & ~b) if inside is None else inside | (a & ~b)
        region = (a.cast("int") + b.cast("int")) if region is None else region + a.cast("int") + b.cast("int")
    kept = (x.groupBy(*by, "_n", region.alias("_r"), F.when(inside, v).alias("_k"))
            .agg(F.count(F.lit(1)).alias("_c")))
    kept = written(kept, "ranks")
    # running counts: regions first (a few per group), then the distinct values inside a region
    per = kept.groupBy(*by, "_n", "_r").agg(F.sum("_c").alias("_t"), F.count("_k").alias("_inside"))
    per = per.withColumn("_before", F.coalesce(F.sum("_t").over(
        Window.partitionBy(*by).orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    missed = F.lit(False)
    for _, _, _, k in _ranks(probs):
        missed = missed | ((F.col("_inside") == 0) & (k >= F.col("_before")) & (k < F.col("_before") + F.col("_t")))
    per = per.select(*by, "_r", F.when(missed, F.raise_error(F.lit("quantile bounds miss a rank")).cast("long"))
                     .otherwise(F.col("_before")).alias("_before"))
    x = kept.join(F.broadcast(per), [*by, "_r"]).where(F.col("_k").isNotNull())
    x = _narrowed(x.withColumn("_r", F.col("_r").cast("long")), by, probs, window_rows)
    run = F.sum("_c").over(Window.partitionBy(*by, "_r").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    cum = x.withColumn("_hi", run)
    hi = F.col("_before") + F.col("_hi")
    lo = hi - F.col("_c")
    hits = [F.when((k >= lo) & (k < hi), F.struct(F.lit(q).alias("q"), F.lit(end).alias("which"), F.col("_k").alias("v"), pos.alias("pos")))
            for q, end, pos, k in _ranks(probs)]
    picked = (cum.select(*by, F.explode(F.array_compact(F.array(*hits))).alias("h"))
              .select(*by, "h.q", "h.which", "h.v", "h.pos"))
    res = picked.groupBy(*by, "q").agg(
        F.max(F.when(F.col("which") == "lo", F.col("v"))).alias("_v_lo"),
        F.max(F.when(F.col("which") == "hi", F.col("v"))).alias("_v_hi"),
        F.max("pos").alias("_pos"))
    frac = F.col("_pos") - F.floor("_pos").cast("double")
    qv = F.when(frac == 0, F.col("_v_lo")).otherwise(F.col("_v_lo") + (F.col("_v_hi") - F.col("_v_lo")) * frac)
    return res.select(*by, "q", qv.alias("quantile"))


def quantile_column(quantiles: DataFrame, q: float, name: str, by: list[str] | None = None) -> DataFrame:
    """One quantile as a named column (join back on ``by``)."""
    cols = list(by or [])
    return quantiles.where(F.col("q") == F.lit(float(q))).select(*cols, F.col("quantile").alias(name))


def bucket_of(x: Column, edges: list[float], right_closed_last: bool = True) -> Column:
    """Index of the fixed-edge bin holding x (left-closed bins, last bin closed
    on the right like numpy.histogram); NULL outside the edges."""
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        last = i == len(edges) - 2
        cond = (x >= lo) & ((x <= hi) if (last and right_closed_last) else (x < hi))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr
