"""Scale-path checks: a customer owning a third of all orders, CSV scoring input."""

import os
import tempfile

from pyspark.sql import functions as F

from ledgerlens import schemas as S
from ledgerlens.functions import policy as P
from ledgerlens.sources import fixtures as FX
from ledgerlens.sources.tables import read_csv, read_table

from .conftest import SF_SMALL


def test_hot_customer_is_collapsed_before_the_window(spark):
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select(
        "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    customer = spark.read.parquet(f"{SF_SMALL}/customer.parquet").select("c_custkey")
    n = orders.count()
    hot = orders.limit(n // 2).withColumn("o_custkey", F.lit(1).cast("long"))   # customer 1: a third of all rows
    skewed = orders.unionByName(hot)
    amounts = FX.ledger_amounts(skewed, customer)
    per_customer = amounts.groupBy("customer_id").count()
    # every customer — the hot one included — has exactly one row per period of the orders
    span = orders.agg((F.max(FX.period_of(F.col("o_orderdate"))) - F.min(FX.period_of(F.col("o_orderdate"))) + 1).alias("n")).first()["n"]
    assert {r["count"] for r in per_customer.select("count").distinct().collect()} == {span}
    hot_orders = amounts.where("customer_id = 1").agg(F.sum("n")).first()[0]
    assert hot_orders == skewed.where("o_custkey = 1").count()
    # the partial aggregate sits before the shuffle
    plan = amounts._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan


def test_score_batch_from_csv(spark):
    rows = [(30, "Salaried", "Graduate", 50000, "Tier-1", 1, "Rented", 2) + (None,) * 29]
    schema = S.scoring_input_schema()
    root = tempfile.mkdtemp(prefix="ll-csv-", dir="/tmp")
    spark.createDataFrame(rows, schema).write.option("header", True).csv(os.path.join(root, "in"))
    batch = read_csv(spark, os.path.join(root, "in"), schema)
    filled = P.fill_defaults(batch)
    r = P.route(filled, F.lit(None).cast("double"), F.lit(None).cast("double"))
    out = r.first()
    assert out["customer_tier"] == 1 and out["ml_probability"] == 0.2 and out["ml_score"] == 780


def test_spine_follows_the_orders(spark):
    """Orders far outside, without a profile, and that can't be placed."""
    orders = spark.sql("""SELECT * FROM VALUES (1L, timestamp'1990-05-01', 100.0D, 'F'), (2L, timestamp'2030-01-15', 50.0D, 'O'),
        (9L, timestamp'1995-02-01', 2000000.0D, 'P'), (1L, NULL, 5.0D, 'F'), (NULL, timestamp'1995-02-01', 5.0D, 'F'), (2L, timestamp'1995-02-01', 7.0D, 'Z')
        AS t(o_custkey, o_orderdate, o_totalprice, o_orderstatus)""")
    customer = spark.createDataFrame([(1,), (2,), (3,)], "c_custkey long")
    amounts = FX.ledger_amounts(orders, customer)
    n = (2030 - 1990) * 4 - 1 + 1 - 1       # second quarter of 1990 to first of 2030
    assert {r["customer_id"]: r["count"] for r in amounts.groupBy("customer_id").count().collect()} == dict.fromkeys((1, 2, 3, 9), n + 1)
    assert amounts.agg(F.sum("n")).first()[0] == 4
    led = FX.ledger_from_amounts(amounts)
    assert led.where("customer_id = 9 and num_transactions > 0").first()["credit_utilization"] == 2.0     # not capped
    assert led.where("customer_id = 2 and month = 1").first()["payment_ratio"] == 0.0                     # unknown status: nothing paid
    faults = {r["fault"]: r["n_orders"] for r in FX.order_faults(orders).collect()}
    assert faults == {"no date": 1, "no customer": 1, "unknown status": 1}


def test_far_dates_change_only_their_customer(spark):
    """An order of the year 2999, and many of one sentinel date, leave everybody else's rows alone."""
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    customer = spark.read.parquet(f"{SF_SMALL}/customer.parquet").select("c_custkey")
    one = spark.sql("SELECT 7L AS o_custkey, timestamp'2999-06-01' AS o_orderdate, 10.0D AS o_totalprice, 'F' AS o_orderstatus")
    many = orders.where("o_custkey % 3 = 0").limit(200).withColumn("o_orderdate", F.lit("1600-01-01").cast(orders.schema["o_orderdate"].dataType))
    far = orders.unionByName(one).unionByName(many)
    a, b = FX.ledger_amounts(orders, customer), FX.ledger_amounts(far, customer)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0
    assert {r["fault"]: r["n_orders"] for r in FX.order_faults(far).collect()}["far date"] == 201
    # a lower limit parts what lies closer
    two = spark.sql("""SELECT * FROM VALUES (1L, timestamp'2000-01-01', 1.0D, 'F'), (1L, timestamp'2000-05-01', 1.0D, 'F'),
        (2L, timestamp'2010-01-01', 1.0D, 'F') AS t(o_custkey, o_orderdate, o_totalprice, o_orderstatus)""")
    rows = FX.ledger_amounts(two, spark.createDataFrame([(1,), (3,)], "c_custkey long"), max_gap=8).collect()
    assert sorted((r["customer_id"], r["month"], r["n"]) for r in rows) == [(1, 21, 1), (1, 22, 1), (3, 21, 0), (3, 22, 0)]
    assert FX.ledger_amounts(two.limit(0), customer).count() == 0


def test_runs_stay_sparse_up_to_their_exchange(spark):
    """Only active periods and one row per customer are shuffled, and the windows need no second exchange by customer."""
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    customer = spark.read.parquet(f"{SF_SMALL}/customer.parquet")
    runs, dense = FX.ledger_runs(orders, customer), FX.ledger_amounts(orders, customer)
    active = orders.select("o_custkey", FX.period_of(F.col("o_orderdate")).alias("m")).distinct().count()
    assert runs.count() <= active + customer.count() < dense.count()
    assert runs.where("start > month or month > until").count() == 0
    assert runs.agg(F.sum(F.col("until") - F.col("start") + 1)).first()[0] == dense.count()
    spans = FX.idle_spans(runs)
    assert spans.agg(F.sum(F.col("last_period") - F.col("first_period") + 1)).first()[0] == dense.where("n = 0").count()
    plan = FX.ledger_from_amounts(dense)._jdf.queryExecution().executedPlan().toString()
    by_customer = [x for x in plan.splitlines() if "Exchange hashpartitioning(customer_id" in x and "month" not in x]
    assert len(by_customer) == 1


def test_quantiles_sort_only_what_the_sketch_leaves(spark):
    """Ranks are picked among the few values inside the sketch's bounds."""
    import numpy as np

    from ledgerlens.operators.order_stats import exact_quantiles, prefix_sums
    from ledgerlens.operators.stats import row_ids

    g = np.random.default_rng(0)
    v = np.concatenate([g.normal(size=60_000), np.zeros(30_000), np.round(g.exponential(size=10_000), 1)])
    df = spark.createDataFrame([(float(x), int(i % 3)) for i, x in enumerate(v)], "x double, g int").repartition(8)
    qs = [0.0, 0.01, 0.25, 0.3, 0.5, 0.75, 0.999, 1.0]
    got = {r["q"]: r["quantile"] for r in exact_quantiles(df, "x", qs).collect()}
    for q in qs:
        assert abs(got[q] - np.quantile(v, q)) < 1e-12
    by = {(r["g"], r["q"]): r["quantile"] for r in exact_quantiles(df, "x", [0.1, 0.5], by=["g"]).collect()}
    for k in range(3):
        assert abs(by[k, 0.5] - np.quantile(v[k::3], 0.5)) < 1e-12
    kept = spark.read.parquet(*_scratch(spark, "ranks"))
    assert kept.count() < 0.05 * len(v)
    # more buckets than the partitions of the session
    ids = row_ids(df.select((F.monotonically_increasing_id() % 5000).alias("a"), F.monotonically_increasing_id().alias("b")), ["a", "b"])
    rows = sorted((r["a"], r["b"], r["row_id"]) for r in ids.collect())
    assert [r[2] for r in rows] == list(range(1, len(rows) + 1))
    many = prefix_sums(spark.range(3000).select(F.col("id").cast("double").alias("x"), F.lit(1).alias("c")), "x", ["c"], n_partitions=700)
    assert all(r["cum_c"] == r["x"] + 1 for r in many.collect())


def test_rank_windows_are_bounded(spark):
    """With 100 times the rows no more values are sorted in one window, whatever is heavy."""
    import numpy as np

    from ledgerlens.operators.order_stats import exact_quantiles

    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    for n in (5_000, 500_000):
        df = spark.range(n, numPartitions=8).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 4 == 1, 7.5).otherwise(
            (F.xxhash64("id") % 1_000_003).cast("double")).alias("x"))
        got = {(r["g"], r["q"]): r["quantile"] for r in exact_quantiles(df, "x", qs, by=["g"], window_rows=40).collect()}
        v = df.toPandas()
        for g, part in v.groupby("g"):
            for q in qs:
                assert abs(got[g, q] - np.quantile(part["x"], q)) < 1e-9
        left = spark.read.parquet(*_scratch(spark, "ranks"))
        assert 0 < left.groupBy("g", "_r").count().agg(F.max("count")).head()[0] <= 40


def test_running_sums_broadcast_one_row_per_partition(spark):
    from ledgerlens.operators.order_stats import prefix_sums

    for n in (0, 1, 1000, 100_000):
        df = spark.range(n, numPartitions=5).select((F.col("id") * 7919 % 100_003).cast("double").alias("x"), (F.col("id") % 3).alias("c"))
        want = {r["x"]: r["c"] for r in df.collect()}
        for down, inclusive in ((False, True), (True, False)):
            total, expect = 0, {}
            for x in sorted(want, reverse=down):
                expect[x] = total + (want[x] if inclusive else 0)
                total += want[x]
            out = prefix_sums(df, "x", ["c"], descending=down, inclusive=inclusive)
            assert {r["x"]: r["cum_c"] for r in out.collect()} == expect
        ids = spark.read.parquet(*_scratch(spark, "prefix")).select("_b").distinct().count()
        assert ids <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def _scratch(spark, tag):
    import glob

    from ledgerlens.session import warehouse_path
    paths = glob.glob(warehouse_path(spark, f"scratch/{tag}-*").replace("file:", ""))
    return [max(paths, key=os.path.getmtime)]


def test_correlation_is_pairwise(spark):
    import pandas as pd

    from ledgerlens.operators.stats import correlation

    pdf = pd.DataFrame({"a": [1, 2, 3, 4, None, 7], "b": [2, 1, 4, None, 5, 8], "c": [None, 3, 1, 1, 2, 1], "k": [1.0] * 6})
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in correlation(spark.createDataFrame(pdf).replace(float("nan"), None), list(pdf)).collect()}
    want = pdf.corr()
    for (a, b), x in got.items():
        assert (x is None and pd.isna(want.loc[a, b])) or abs(x - want.loc[a, b]) < 1e-12


def test_null_labels_and_probabilities(spark):
    import pytest

    from ledgerlens.operators import metrics as M
    from ledgerlens.operators.prep import with_class_weights
    from ledgerlens.operators.splits import stratified_split

    df = spark.range(100).select("id", F.when(F.col("id") % 10 > 0, (F.col("id") % 2).cast("int")).alias("y"))
    for f in (lambda: stratified_split(df, "y", ["id"]).count(), lambda: with_class_weights(df, "y").count()):
        with pytest.raises(Exception, match="holds NULLs"):
            f()
    ev = spark.range(40).select((F.col("id") % 2).cast("int").alias("y"), F.when(F.col("id") < 10, F.col("id") / 10.0).alias("p"))
    assert sorted(r["n_rows"] for r in M.decile_table(ev).collect()) == [1] * 10
    assert {r["accept_rate"] for r in M.threshold_sweep(ev, thresholds=[0.55]).collect()} == {60.0}


def test_ledger_tasks_grow_with_the_tables(spark, monkeypatch):
    """The expanded ledger is sorted by as many tasks as the tables need, not by as many as there are cores."""
    orders, customer = (read_table(spark, SF_SMALL, t) for t in ("orders", "customer"))
    want = sorted(map(tuple, FX.ledger_amounts(orders, customer).collect()))
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(FX, "TASK_CUSTOMERS", -(-customer.count() // (cores + 40)))
    got = FX.ledger_amounts(orders, customer)
    assert got.rdd.getNumPartitions() > cores
    assert sorted(map(tuple, got.collect())) == want


def test_snapshots_are_written_where_they_are_made(spark, monkeypatch):
    """The wide rows of the snapshot table take no shuffle of their own before they are written."""
    import os

    from ledgerlens.plans import catalog

    monkeypatch.setenv("LEDGERLENS_RUN_TAG", "t-" + os.urandom(4).hex())
    live, table = catalog.snapshots_live(spark, SF_SMALL), catalog.snapshots(spark, SF_SMALL)
    assert not any("snapshot_month=" in f for f in table.inputFiles())
    assert table.schema.names == live.schema.names and sorted(map(str, table.collect())) == sorted(map(str, live.collect()))
