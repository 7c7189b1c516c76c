"""Reference SQL (DuckDB dialect) for the exact queries.

These are independent formulations — lag sums and CASE ladders rather than
window aggregates — so a query and its oracle agree only if the semantics do.
Portable-arithmetic rules: double literals are written ``1e0``-style, integer
sums are cast to BIGINT, truncation uses ``trunc`` before casts.
"""

from __future__ import annotations

AMOUNT_CTES = """
placed AS (
  SELECT o_custkey::BIGINT AS customer_id,
         ((year(o_orderdate) - 1995) * 4 + quarter(o_orderdate))::INTEGER AS month,
         round(o_totalprice * 100)::BIGINT AS cents,
         CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'P' THEN 75 WHEN 'O' THEN 40 END AS share
  FROM orders),
cal AS (
  SELECT min(month) AS lo, max(month) AS hi FROM (
    SELECT month, n, sum(CASE WHEN month - before > 160 THEN 1 ELSE 0 END) OVER (ORDER BY month) AS island FROM (
      SELECT month, count(*) AS n, lag(month) OVER (ORDER BY month) AS before FROM placed GROUP BY month))
  GROUP BY island ORDER BY sum(n) DESC, min(month) LIMIT 1),
ord AS (SELECT p.* FROM placed p JOIN cal ON p.month BETWEEN cal.lo AND cal.hi),
amt AS (
  SELECT customer_id, month, count(*)::BIGINT AS n, (sum(cents) * 100)::BIGINT AS bill4,
         sum(cents * share)::BIGINT AS paid4
  FROM ord GROUP BY customer_id, month),
oids AS (SELECT c_custkey::BIGINT AS customer_id FROM customer UNION SELECT customer_id FROM ord),
spine AS (
  SELECT customer_id, unnest(range((SELECT lo FROM cal), (SELECT hi FROM cal) + 1))::INTEGER AS month FROM oids),
dense AS (
  SELECT s.customer_id, s.month, coalesce(a.n, 0)::BIGINT AS n,
         coalesce(a.bill4, 0)::BIGINT AS bill4, coalesce(a.paid4, 0)::BIGINT AS paid4
  FROM spine s LEFT JOIN amt a ON s.customer_id = a.customer_id AND s.month = a.month)"""

LEDGER_FROM_DENSE = """
lbase AS (
  SELECT customer_id, month,
    bill4::DOUBLE / 1e10 AS credit_utilization,
    CASE WHEN bill4 - paid4 > 0 AND bill4 - paid4 < bill4 THEN 1 ELSE 0 END::INTEGER AS late_payment,
    CASE WHEN bill4 = 0 THEN 1e0 ELSE paid4::DOUBLE / bill4::DOUBLE END AS payment_ratio,
    (sum(bill4 - paid4) OVER (PARTITION BY customer_id ORDER BY month
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT::DOUBLE / 1e6 AS outstanding_balance,
    n::INTEGER AS num_transactions,
    (CASE WHEN n = 0 THEN 0e0 ELSE trunc(bill4::DOUBLE / 1e6 / n::DOUBLE) END)::BIGINT AS avg_transaction_amount,
    CASE WHEN (CASE WHEN bill4 = 0 THEN 1e0 ELSE paid4::DOUBLE / bill4::DOUBLE END) < 0.8e0
         THEN 1 ELSE 0 END::INTEGER AS missed_due_flag
  FROM dense),
lhaz AS (
  SELECT *,
    row_number() OVER (PARTITION BY customer_id ORDER BY month) AS lrn,
    greatest(0.005e0, least(
        0.015e0
      + 0.18e0 * lag(missed_due_flag) OVER (PARTITION BY customer_id ORDER BY month)
      + 0.1e0 * (1e0 - lag(payment_ratio) OVER (PARTITION BY customer_id ORDER BY month))
      + 0.06e0 * least(lag(outstanding_balance) OVER (PARTITION BY customer_id ORDER BY month) / 1e4, 1e0)
      + 0.04e0 * lag(late_payment) OVER (PARTITION BY customer_id ORDER BY month),
      0.45e0)) AS hazard,
    ('0x' || substr(md5(customer_id::VARCHAR || '|' || month::VARCHAR), 1, 8))::BIGINT / 4294967296e0 AS u
  FROM lbase),
ledger AS (
  SELECT customer_id, month, credit_utilization, late_payment, payment_ratio, outstanding_balance,
    (CASE WHEN lrn = 1 THEN 0 WHEN u < hazard THEN 1 ELSE 0 END)::INTEGER AS default_event,
    num_transactions, avg_transaction_amount, missed_due_flag
  FROM lhaz)"""

LEDGER_CTES = AMOUNT_CTES + ",\n" + LEDGER_FROM_DENSE

PROFILE_CTE = """
profiles AS (
  SELECT c_custkey::BIGINT AS customer_id,
    (21 + c_custkey % 55)::INTEGER AS age,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Salaried' WHEN 'AUTOMOBILE' THEN 'Self-Employed'
      WHEN 'MACHINERY' THEN 'Business' WHEN 'HOUSEHOLD' THEN 'Daily Wage' ELSE 'Retired' END AS employment_status,
    CASE c_nationkey % 6 WHEN 0 THEN 'No Formal Education' WHEN 1 THEN 'Primary' WHEN 2 THEN 'Secondary'
      WHEN 3 THEN 'High School' WHEN 4 THEN 'Graduate' WHEN 5 THEN 'Postgraduate' END AS education_level,
    (10000 + floor((round(c_acctbal * 100)::BIGINT + 100000) / 5))::BIGINT AS monthly_income,
    CASE c_nationkey % 3 WHEN 0 THEN 'Tier-1' WHEN 1 THEN 'Tier-2' WHEN 2 THEN 'Tier-3' END AS city_tier,
    (c_custkey % 5)::INTEGER AS dependents,
    CASE c_custkey % 2 WHEN 0 THEN 'Owned' WHEN 1 THEN 'Rented' END AS residence_type,
    (c_custkey % 121)::INTEGER AS account_age_months
  FROM customer)"""


def _lag(c: str, k: int) -> str:
    return f"lag({c}, {k}) OVER (PARTITION BY customer_id ORDER BY month)"


_PAST = "OVER (PARTITION BY customer_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


EVENT_DENSE_CTES = """
epd AS (
  SELECT user_id::BIGINT AS customer_id, (datediff('day', DATE '2024-01-01', ts::DATE) + 1)::INTEGER AS month,
    count(*) FILTER (WHERE event_type = 'purchase')::BIGINT AS n,
    coalesce(sum(CASE WHEN event_type = 'purchase' THEN round(value * 100)::BIGINT END), 0)::BIGINT AS cents,
    max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS err
  FROM events GROUP BY 1, 2),
espan AS (SELECT customer_id, min(month) AS lo, max(month) AS hi FROM epd GROUP BY 1),
espine AS (SELECT customer_id, unnest(range(lo, hi + 1))::INTEGER AS month FROM espan),
dense AS (
  SELECT s.customer_id, s.month, coalesce(p.n, 0)::BIGINT AS n, (coalesce(p.cents, 0) * 100)::BIGINT AS bill4,
    coalesce(p.cents * CASE WHEN p.err = 1 THEN 40 ELSE 100 END, 0)::BIGINT AS paid4
  FROM espine s LEFT JOIN epd p ON s.customer_id = p.customer_id AND s.month = p.month)"""

EVENT_LEDGER_CTES = EVENT_DENSE_CTES + ",\n" + LEDGER_FROM_DENSE


def snapshot_ctes(leak_safe: bool = False, ledger_ctes: str | None = None) -> str:
    l1 = lambda c: _lag(c, 1)
    l2 = lambda c: _lag(c, 2)
    l3 = lambda c: _lag(c, 3)
    m1, m2, m3 = l1("missed_due_flag"), l2("missed_due_flag"), l3("missed_due_flag")
    act = lambda lag: f"(CASE WHEN {lag('num_transactions')} > 0 THEN 1 ELSE 0 END)"
    act_u = lambda lag: f"(CASE WHEN {lag('num_transactions')} > 0 THEN {lag('credit_utilization')} ELSE 0e0 END)"
    bal_now = l1("outstanding_balance") if leak_safe else "outstanding_balance"
    return f"""
{ledger_ctes or LEDGER_CTES},
{PROFILE_CTE},
lr AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY month) AS rn FROM ledger),
wf AS (
  SELECT customer_id, month::INTEGER AS snapshot_month, rn,
    ({l3('credit_utilization')} + {l2('credit_utilization')} + {l1('credit_utilization')}) / 3e0 AS util_avg_3m,
    ({l3('payment_ratio')} + {l2('payment_ratio')} + {l1('payment_ratio')}) / 3e0 AS payment_ratio_avg_3m,
    greatest({l1('outstanding_balance')}, {l2('outstanding_balance')}, {l3('outstanding_balance')}) AS max_outstanding_3m,
    ({l3('avg_transaction_amount')} + {l2('avg_transaction_amount')} + {l1('avg_transaction_amount')}) / 3e0 AS avg_txn_amt_3m,
    ({l3('num_transactions')} + {l2('num_transactions')} + {l1('num_transactions')}) / 3e0 AS avg_txn_count_3m,
    ({l1('late_payment')} + {l2('late_payment')} + {l3('late_payment')})::BIGINT AS late_payments_3m,
    ({m1} + {m2} + {m3})::BIGINT AS missed_due_count_3m,
    {m1}::INTEGER AS missed_due_last_1m,
    {l1('payment_ratio')} AS payment_ratio_last_1m,
    {l1('outstanding_balance')} - {l3('outstanding_balance')} AS outstanding_delta_3m,
    (CASE WHEN {l1('num_transactions')} > 0 THEN 1 ELSE 0 END)::INTEGER AS bnpl_active_last_1m,
    (CASE WHEN coalesce({m1} = 1, false) = false THEN 0
          WHEN coalesce({m2} = 1, false) = false THEN 1
          WHEN coalesce({m3} = 1, false) = false THEN 2 ELSE 3 END)::INTEGER AS consecutive_missed_due,
    least({l1('payment_ratio')}, {l2('payment_ratio')}, {l3('payment_ratio')}) AS payment_ratio_min_3m,
    greatest({l1('credit_utilization')}, {l2('credit_utilization')}, {l3('credit_utilization')}) AS worst_util_3m,
    (CASE WHEN sum(default_event) {_PAST} > 0 THEN 1 ELSE 0 END)::INTEGER AS ever_defaulted,
    coalesce(sum(default_event) {_PAST}, 0)::BIGINT AS default_count_history,
    coalesce(rn - 1 - max(CASE WHEN default_event = 1 THEN rn END) {_PAST}, 0)::BIGINT AS months_since_last_default,
    {l1('payment_ratio')} - {l3('payment_ratio')} AS payment_ratio_trend,
    {l1('credit_utilization')} - {l3('credit_utilization')} AS utilization_trend,
    {l3('outstanding_balance')} AS bal_first,
    ({act(l1)} + {act(l2)} + {act(l3)})::INTEGER AS active_months_3m,
    ({act_u(l3)} + {act_u(l2)} + {act_u(l1)}) AS act_util_sum,
    {bal_now} AS bal_now,
    default_event::INTEGER AS default_next_1m
  FROM lr),
sf AS (
  SELECT wf.*, p.age, p.employment_status, p.education_level, p.monthly_income, p.city_tier,
    p.dependents, p.residence_type, p.account_age_months,
    CASE WHEN p.customer_id IS NULL THEN 0 ELSE p.monthly_income END AS inc,
    CASE WHEN p.customer_id IS NULL THEN 0 ELSE p.account_age_months END AS acct
  FROM wf LEFT JOIN profiles p ON wf.customer_id = p.customer_id
  WHERE wf.rn > 3),
sp AS (
  SELECT *,
    CASE WHEN inc = 0 THEN 100e0 ELSE bal_now * 100e0 / inc END AS outstanding_to_income_pct,
    CASE WHEN active_months_3m = 0 THEN 0e0 ELSE act_util_sum / active_months_3m END AS avg_util_when_active,
    CASE WHEN max_outstanding_3m + 1e0 = 0 THEN 0e0 ELSE inc / (max_outstanding_3m + 1e0) END AS income_affordability_score,
    CASE WHEN bal_first + 1e0 = 0 THEN 0e0 ELSE outstanding_delta_3m / (bal_first + 1e0) END AS outstanding_growth_rate,
    (CASE WHEN payment_ratio_trend < 0 AND utilization_trend > 0 THEN 1 ELSE 0 END)::INTEGER AS is_deteriorating,
    (CASE WHEN acct < 6 THEN 0 WHEN acct < 24 THEN 1 ELSE 2 END)::INTEGER AS account_age_bucket
  FROM sf),
snapshots AS (
  SELECT customer_id, snapshot_month, util_avg_3m, payment_ratio_avg_3m, max_outstanding_3m,
    avg_txn_amt_3m, avg_txn_count_3m, late_payments_3m, missed_due_count_3m, missed_due_last_1m,
    payment_ratio_last_1m, outstanding_delta_3m, bnpl_active_last_1m, consecutive_missed_due,
    payment_ratio_min_3m, worst_util_3m, ever_defaulted, default_count_history,
    months_since_last_default, outstanding_to_income_pct, income_affordability_score,
    (CASE WHEN outstanding_to_income_pct < 10 THEN 0 WHEN outstanding_to_income_pct < 30 THEN 1
          WHEN outstanding_to_income_pct < 50 THEN 2 ELSE 3 END)::INTEGER AS debt_burden_category,
    payment_ratio_trend, utilization_trend, outstanding_growth_rate, is_deteriorating,
    active_months_3m, avg_util_when_active, account_age_bucket,
    least(missed_due_last_1m * 25 + consecutive_missed_due * 15 + (1e0 - payment_ratio_min_3m) * 20e0
          + least(outstanding_to_income_pct / 100e0, 1e0) * 15e0 + is_deteriorating * 10
          + (CASE WHEN payment_ratio_avg_3m < 0.7e0 THEN 1 ELSE 0 END) * 10 + ever_defaulted * 5,
          100e0) AS risk_score,
    default_next_1m, age, employment_status, education_level, monthly_income, city_tier,
    dependents, residence_type, account_age_months
  FROM sp)"""


def with_snapshots(body: str, leak_safe: bool = False) -> str:
    """``body`` may begin with a comma and more CTEs."""
    return f"WITH {snapshot_ctes(leak_safe)}\n{body}"


def with_ledger(body: str) -> str:
    return f"WITH {LEDGER_CTES}\n{body}"


def with_far_orders(body: str) -> str:
    """As ``with_ledger``, with the orders of every 97th key dated a thousand years later."""
    moved = ("(SELECT * REPLACE (CASE WHEN o_orderkey % 97 = 0 THEN o_orderdate + INTERVAL 1000 YEAR "
             "ELSE o_orderdate END AS o_orderdate) FROM orders)")
    return f"WITH {LEDGER_CTES.replace('FROM orders)', f'FROM {moved})')}\n{body}"


def with_profiles(body: str) -> str:
    return f"WITH {PROFILE_CTE}\n{body}"
