"""Customer profiles and the monthly behaviour ledger, derived from the driver's
TPC-H-style tables (L1–L5, J7, T6).

Mapping (portable, so DuckDB can reproduce it exactly):
  period   = (year(o_orderdate) - 1995) * 4 + quarter(o_orderdate), called ``month``;
             the range runs from the first to the last period of the orders, but for those
             that ``MAX_GAP`` periods without any order part from the most (``calendar``)
  cents    = bigint(round(o_totalprice * 100))
  paid %   = status F 100, P 75, O 40
  bill4    = sum(cents) * 100, paid4 = sum(cents * paid%), unpaid4 = bill4 - paid4
             (integers in 1e-6 currency units, so running sums are exact)
  spine    = every customer, and every customer id of the orders, x every period of the
             range; a period without orders is inactive. Orders that can't be placed are
             reported by ``order_faults``
  default  = md5-derived uniform < hazard of the previous period (first period never)

Plan shape: the order rows and one row per customer are unioned and aggregated once
by (customer, period) — the partial aggregate runs map-side, so a customer with
a huge share of the orders is collapsed to at most one row per period before
the shuffle. Idle periods stay intervals (``ledger_runs``) through the one shuffle by customer
and are expanded behind it, so the windows need no other; each window partition is bounded by
the number of periods, and the number of tasks grows with the tables (``by_customer``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import read_table

# FIXED VALUES — fixture mapping
BASE_YEAR = 1995
PAID_PERCENT = {"F": 100, "P": 75, "O": 40}
EMPLOYMENT_BY_SEGMENT = {"BUILDING": "Salaried", "AUTOMOBILE": "Self-Employed",
                         "MACHINERY": "Business", "HOUSEHOLD": "Daily Wage"}  # else Retired
EDUCATION_LEVELS = ["No Formal Education", "Primary", "Secondary", "High School",
                    "Graduate", "Postgraduate"]
CITY_TIERS = ["Tier-1", "Tier-2", "Tier-3"]
RESIDENCE_TYPES = ["Owned", "Rented"]
UTILIZATION_DIVISOR = 1e10      # bill4 / 1e10 = bill / 10000
CURRENCY_SCALE = 1e6            # bill4 / 1e6 = bill
MISSED_RATIO = 0.8
HAZARD_BASE, HAZARD_MISSED, HAZARD_UNPAID, HAZARD_BALANCE, HAZARD_LATE = 0.015, 0.18, 0.10, 0.06, 0.04
HAZARD_BALANCE_SCALE = 1e4
HAZARD_MIN, HAZARD_MAX = 0.005, 0.45


def _pick(index: Column, values: list[str]) -> Column:
    """values[index] as a CASE ladder (stays in codegen, no array literal)."""
    expr = None
    for i, v in enumerate(values):
        expr = F.when(index == i, F.lit(v)) if expr is None else expr.when(index == i, F.lit(v))
    return expr


def profiles_from_customers(customer: DataFrame) -> DataFrame:
    """Customer profile table (S1) from ``customer``: one row per customer."""
    key = F.col("c_custkey")
    nation = F.col("c_nationkey")
    cents = F.round(F.col("c_acctbal") * 100).cast("long")
    employment = F.coalesce(
        _pick_map(F.col("c_mktsegment"), EMPLOYMENT_BY_SEGMENT), F.lit("Retired"))
    return customer.select(
        key.cast("long").alias("customer_id"),
        (F.lit(21) + key % 55).cast("int").alias("age"),
        employment.alias("employment_status"),
        _pick(nation % 6, EDUCATION_LEVELS).alias("education_level"),
        (F.lit(10000) + F.floor((cents + 100000) / 5)).cast("long").alias("monthly_income"),
        _pick(nation % 3, CITY_TIERS).alias("city_tier"),
        (key % 5).cast("int").alias("dependents"),
        _pick(key % 2, RESIDENCE_TYPES).alias("residence_type"),
        (key % 121).cast("int").alias("account_age_months"),
    )


def _pick_map(value: Column, mapping: dict[str, str]) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(value == k, F.lit(v)) if expr is None else expr.when(value == k, F.lit(v))
    return expr


def period_of(ts: Column) -> Column:
    return ((F.year(ts) - BASE_YEAR) * 4 + F.quarter(ts)).cast("int")


#: Periods without any order after which the orders beyond belong to another calendar (a far date is a fault).
MAX_GAP = 160


def placed_orders(orders: DataFrame) -> DataFrame:
    """Orders of a known customer and date: customer_id, month, n, cents, paid4."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    share = _pick_int(F.col("o_orderstatus"), PAID_PERCENT)
    return orders.select(
        F.col("o_custkey").cast("long").alias("customer_id"),
        period_of(F.col("o_orderdate")).alias("month"),
        F.lit(1).cast("long").alias("n"),
        cents.alias("cents"),
        (cents * F.coalesce(share, F.lit(0))).alias("paid4"),
    ).where("customer_id is not null and month is not null")


def calendar(placed: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """The periods that the ledger covers, one row (lo, hi): of the runs of periods no more than ``max_gap``
    apart the one with the most orders (of equal ones the earliest). NULLs without orders.

    The window runs over one row per period of the calendar, however many orders there are."""
    w = Window.orderBy("month")
    periods = placed.groupBy("month").agg(F.sum("n").alias("n"))
    far = F.coalesce(F.col("month") - F.lag("month").over(w) > max_gap, F.lit(False))
    islands = (periods.withColumn("far", far.cast("int")).withColumn("island", F.sum("far").over(w))
               .groupBy("island").agg(F.min("month").alias("lo"), F.max("month").alias("hi"), F.sum("n").alias("n")))
    most = islands.agg(F.max_by(F.struct("lo", "hi"), F.struct("n", -F.col("lo"))).alias("m"))
    return most.select("m.lo", "m.hi")


#: Customers, and orders, whose expanded periods one task sorts (about 100 MB in memory).
TASK_CUSTOMERS, TASK_ORDERS = 20_000, 200_000


def by_customer(df: DataFrame, orders: DataFrame, customer: DataFrame) -> DataFrame:
    """``df`` dealt by customer into as many tasks as keep the sorts of the expanded ledger in memory, for the windows on
    customer_id behind it. Where the cluster's cores are that many, the shuffle is left to the session."""
    spark = df.sparkSession
    tasks = -(-customer.count() // TASK_CUSTOMERS) + -(-orders.count() // TASK_ORDERS)
    if tasks <= spark.sparkContext.defaultParallelism:
        return df
    # a given number isn't merged again: the runs are small before they expand, whatever the calendar makes of them
    return df.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "customer_id")


def ledger_runs(orders: DataFrame, customer: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """The sparse ledger: one row per customer and period with orders, which also stands for the idle periods
    around it: customer_id, start, month, until, n, bill4, paid4. The runs ``start..until`` of a customer cover the
    calendar without overlap; a customer without orders has one run of zeros.

    The ids are those of ``customer`` and of ``orders`` (a customer without a profile has a ledger too). Rows that
    ``order_faults`` reports as unplaced (no period, no customer, a far date) are left out, so a wrong
    date changes nobody else's periods. Only active periods and one row per customer are shuffled."""
    placed = placed_orders(orders)
    span = calendar(placed, max_gap)
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    zero = F.lit(0).cast("long")
    ids = customer.select(F.col("c_custkey").cast("long").alias("customer_id"), lo.alias("month"),
                          zero.alias("n"), zero.alias("cents"), zero.alias("paid4")).where("customer_id is not null")
    # One aggregate over both inputs: partial sums run before the shuffle.
    active = (placed.where(F.col("month").between(lo, hi)).unionByName(ids)
              .groupBy("customer_id", "month")
              .agg(F.sum("n").alias("n"), (F.coalesce(F.sum("cents"), zero) * 100).alias("bill4"),
                   F.coalesce(F.sum("paid4"), zero).alias("paid4")))
    w = Window.partitionBy("customer_id").orderBy("month")
    return by_customer(active, orders, customer).select(
        "customer_id",
        F.when(F.row_number().over(w) == 1, lo).otherwise(F.col("month")).alias("start"),
        "month",
        F.coalesce(F.lead("month").over(w) - 1, hi).alias("until"),
        "n", "bill4", "paid4")


def idle_spans(runs: DataFrame) -> DataFrame:
    """The longest spans without orders, one row each: customer_id, first_period, last_period. Only a customer's first
    run is idle on both sides of its active period, or altogether."""
    idle = F.array(
        F.when((F.col("n") > 0) & (F.col("start") < F.col("month")), F.struct(F.col("start").alias("a"), (F.col("month") - 1).alias("b"))),
        F.when(F.col("n") == 0, F.struct(F.col("start").alias("a"), F.col("until").alias("b"))),
        F.when((F.col("n") > 0) & (F.col("month") < F.col("until")), F.struct((F.col("month") + 1).alias("a"), F.col("until").alias("b"))))
    return runs.select("customer_id", F.explode(F.array_compact(idle)).alias("i")).select(
        "customer_id", F.col("i.a").cast("int").alias("first_period"), F.col("i.b").cast("int").alias("last_period"))


def ledger_amounts(orders: DataFrame, customer: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Per customer-period integer amounts on the dense spine (L1, J7): the runs of ``ledger_runs``, expanded
    behind their exchange, as every period has a drawn default (L5).

    Output: customer_id, month, n, bill4, paid4 — inactive periods have zeros.
    """
    runs = ledger_runs(orders, customer, max_gap).withColumn("period", F.explode(F.sequence("start", "until")))
    here = F.col("period") == F.col("month")
    return runs.select("customer_id", F.col("period").alias("month"), *[
        F.when(here, F.col(c)).otherwise(F.lit(0).cast("long")).alias(c) for c in ("n", "bill4", "paid4")])


def order_faults(orders: DataFrame, max_gap: int = MAX_GAP) -> DataFrame:
    """Orders with faults, counted by kind: without customer, date or price, of an unknown
    status (billed, nothing counts as paid), dated outside the calendar. Those without customer
    or date and those of a far date can't be placed in the ledger."""
    span = calendar(placed_orders(orders), max_gap)
    month = period_of(F.col("o_orderdate"))
    kinds = F.array(
        F.when((month < span.select("lo").scalar()) | (month > span.select("hi").scalar()), F.lit("far date")),
        F.when(F.col("o_custkey").isNull(), F.lit("no customer")),
        F.when(F.col("o_orderdate").isNull(), F.lit("no date")),
        F.when(F.col("o_totalprice").isNull(), F.lit("no price")),
        F.when(~F.coalesce(F.col("o_orderstatus").isin(*PAID_PERCENT), F.lit(False)), F.lit("unknown status")))
    return (orders.select(F.explode(F.array_compact(kinds)).alias("fault"))
            .groupBy("fault").agg(F.count(F.lit(1)).cast("long").alias("n_orders")))


def _pick_int(value: Column, mapping: dict[str, int]) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(value == k, F.lit(v)) if expr is None else expr.when(value == k, F.lit(v))
    return expr.cast("long")


def hash_uniform(*cols: Column) -> Column:
    """Uniform in [0,1) from the first 8 hex digits of md5(c1|c2|...) — the same
    value in Spark and DuckDB, unlike xxhash64."""
    key = F.concat_ws("|", *[c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def ledger_from_amounts(amounts: DataFrame) -> DataFrame:
    """Monthly behaviour ledger (A2 schema) from per-period amounts (L2–L5). A column ``before``
    (``BEFORE``, NULL for a new customer) holds a customer's row before its first one here and the unpaid sum up to it."""
    known = "before" in amounts.columns
    start = F.coalesce(F.col("before.unpaid4"), F.lit(0)) if known else F.lit(0)
    w = Window.partitionBy("customer_id").orderBy("month")
    running = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bill4, paid4, n = F.col("bill4"), F.col("paid4"), F.col("n")
    unpaid4 = bill4 - paid4
    ratio = F.when(bill4 == 0, F.lit(1.0)).otherwise(paid4.cast("double") / bill4.cast("double"))
    base = amounts.select(
        "customer_id", "month",
        (bill4.cast("double") / F.lit(UTILIZATION_DIVISOR)).alias("credit_utilization"),
        ((unpaid4 > 0) & (unpaid4 < bill4)).cast("int").alias("late_payment"),
        ratio.alias("payment_ratio"),
        ((F.sum(unpaid4).over(running) + start).cast("double") / F.lit(CURRENCY_SCALE)).alias("outstanding_balance"),
        n.cast("int").alias("num_transactions"),
        F.when(n == 0, F.lit(0)).otherwise(
            bill4.cast("double") / F.lit(CURRENCY_SCALE) / n.cast("double")
        ).cast("long").alias("avg_transaction_amount"),
        (ratio < F.lit(MISSED_RATIO)).cast("int").alias("missed_due_flag"),
        *(["before"] if known else []),
    )
    first = (F.row_number().over(w) == 1) & F.col("before").isNull() if known else F.row_number().over(w) == 1
    default = F.when(first, F.lit(0)).otherwise(
        (hash_uniform(F.col("customer_id"), F.col("month")) < _hazard(w, known)).cast("int"))
    return base.select(
        "customer_id", "month", "credit_utilization", "late_payment", "payment_ratio",
        "outstanding_balance", default.cast("int").alias("default_event"),
        "num_transactions", "avg_transaction_amount", "missed_due_flag")


#: The row before the first one of a ledger's part, and the unpaid sum up to it.
BEFORE = "struct<unpaid4:bigint,missed_due_flag:int,payment_ratio:double,outstanding_balance:double,late_payment:int>"


def _hazard(w, known: bool = False) -> Column:
    """Default hazard from the previous row's behaviour, clamped."""
    prev = lambda c: F.coalesce(F.lag(c, 1).over(w), F.col("before")[c]) if known else F.lag(c, 1).over(w)
    raw = (F.lit(HAZARD_BASE)
           + F.lit(HAZARD_MISSED) * prev("missed_due_flag")
           + F.lit(HAZARD_UNPAID) * (F.lit(1.0) - prev("payment_ratio"))
           + F.lit(HAZARD_BALANCE) * F.least(prev("outstanding_balance") / F.lit(HAZARD_BALANCE_SCALE), F.lit(1.0))
           + F.lit(HAZARD_LATE) * prev("late_payment"))
    return F.greatest(F.lit(HAZARD_MIN), F.least(raw, F.lit(HAZARD_MAX)))


def default_hazard(ledger: DataFrame) -> DataFrame:
    """Hazard of each period next to the drawn default (L5); NULL on a first row."""
    w = Window.partitionBy("customer_id").orderBy("month")
    return ledger.select("customer_id", "month", _hazard(w).alias("hazard"), "default_event")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles_from_customers(
        read_table(spark, sf_dir, "customer").select(
            "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"))


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey")
    return ledger_from_amounts(ledger_amounts(orders, customer))
