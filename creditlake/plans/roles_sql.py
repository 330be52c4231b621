"""The driver-table role mapping written in ANSI SQL (DuckDB dialect) for the
oracle queries. It mirrors ``creditlake.sources.driver_roles`` expression by
expression; the two are kept side by side on purpose so a mismatch in the
oracle comparison points at one of them."""

from __future__ import annotations

ROLE_SQL: dict[str, tuple[str, list[str]]] = {}


def _role(name, deps, sql):
    ROLE_SQL[name] = (sql, deps)


_role("order_stats", [], """
SELECT o_custkey AS c_custkey,
  sum(o_totalprice) AS _sum_price, max(o_totalprice) AS _max_price,
  min(o_totalprice) AS _min_price, avg(o_totalprice) AS _avg_price,
  sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE CAST(0 AS DOUBLE) END) AS _open_price,
  sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE CAST(0 AS DOUBLE) END) AS _part_price,
  count(*) FILTER (WHERE o_orderstatus = 'O') AS _n_open,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS _n_urgent,
  count(*) FILTER (WHERE o_orderpriority = '3-MEDIUM' AND o_orderstatus <> 'F') AS _n_med_unfinished,
  count(*) FILTER (WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'P') AS _n_high_partial,
  count(*) FILTER (WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') AS _n_urgent_partial,
  count(*) FILTER (WHERE o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'O') AS _n_ns_open
FROM orders GROUP BY o_custkey""")

_role("applicants", ["order_stats"], """
SELECT c.c_custkey AS SK_ID_CURR, CAST(c.c_acctbal < 0 AS INTEGER) AS TARGET,
  s._sum_price AS AMT_INCOME_TOTAL, s._max_price AS AMT_CREDIT, s._avg_price / 12 AS AMT_ANNUITY,
  s._min_price AS AMT_GOODS_PRICE,
  CAST(c.c_nationkey % 5 + 1 AS DOUBLE) AS CNT_FAM_MEMBERS, CAST(c.c_nationkey % 3 AS INTEGER) AS CNT_CHILDREN,
  CASE WHEN c.c_nationkey % 3 = 0 THEN NULL ELSE CAST(c.c_nationkey AS DOUBLE) / 25 END AS EXT_SOURCE_1,
  CAST(c.c_custkey % 100 AS DOUBLE) / 100 AS EXT_SOURCE_2,
  CASE WHEN c.c_mktsegment = 'BUILDING' THEN NULL ELSE CAST(c.c_custkey % 7 AS DOUBLE) / 7 END AS EXT_SOURCE_3,
  CAST(c.c_nationkey % 2 AS INTEGER) AS FLAG_DOCUMENT_2, CAST(c.c_custkey % 2 AS INTEGER) AS FLAG_DOCUMENT_3,
  CAST(c.c_custkey % 3 = 0 AS INTEGER) AS FLAG_DOCUMENT_4,
  CAST(s._n_urgent AS DOUBLE) AS AMT_REQ_CREDIT_BUREAU_MON, CAST(s._n_open AS DOUBLE) AS AMT_REQ_CREDIT_BUREAU_YEAR,
  CAST(-(7000 + (c.c_custkey * 37) % 18000) AS INTEGER) AS DAYS_BIRTH,
  CAST(CASE WHEN c.c_custkey % 17 = 3 THEN NULL WHEN c.c_custkey % 10 = 0 THEN 365243 ELSE -((c.c_custkey * 13) % 9000) END AS INTEGER) AS DAYS_EMPLOYED,
  CASE WHEN c.c_nationkey % 2 = 0 THEN 'Y' ELSE 'N' END AS FLAG_OWN_CAR,
  CASE WHEN c.c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'Y' ELSE 'N' END AS FLAG_OWN_REALTY,
  CAST(c.c_nationkey % 3 + 1 AS INTEGER) AS REGION_RATING_CLIENT,
  CAST(c.c_custkey % 4 = 0 AS INTEGER) AS REG_CITY_NOT_LIVE_CITY,
  1 AS FLAG_MOBIL, c.c_mktsegment AS NAME_CONTRACT_TYPE
FROM customer c LEFT JOIN order_stats s ON s.c_custkey = c.c_custkey""")

_role("bureau", [], """
SELECT o_orderkey AS SK_ID_BUREAU, o_custkey AS SK_ID_CURR,
  CAST(CASE WHEN o_orderstatus = 'O' THEN dayofmonth(o_orderdate) ELSE 0 END AS INTEGER) AS CREDIT_DAY_OVERDUE,
  CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice * 0.1 END AS AMT_CREDIT_SUM_OVERDUE,
  CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE CAST(0 AS DOUBLE) END AS AMT_CREDIT_SUM_DEBT,
  o_totalprice AS AMT_CREDIT_SUM,
  CASE WHEN o_orderstatus = 'O' THEN 'Active' WHEN o_orderstatus = 'F' THEN 'Closed' ELSE 'Sold' END AS CREDIT_ACTIVE
FROM orders""")

_role("bureau_balance", [], """
SELECT l_orderkey AS SK_ID_BUREAU,
  CASE WHEN l_returnflag = 'R' THEN CAST(2 + l_linenumber % 4 AS VARCHAR)
       WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'X'
       WHEN l_returnflag = 'N' THEN '1' ELSE 'C' END AS STATUS
FROM lineitem""")

_role("line_orders", [], """
SELECT l.*, o.o_custkey, o.o_orderdate, o.o_totalprice
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""")

_role("installments", ["line_orders"], """
SELECT o_custkey AS SK_ID_CURR,
  CASE WHEN l_linestatus = 'O' THEN NULL
       ELSE CAST(date_diff('day', DATE '2000-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) END AS DAYS_ENTRY_PAYMENT,
  CAST(date_diff('day', DATE '2000-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS DAYS_INSTALMENT,
  l_extendedprice * (1 - l_discount) AS AMT_PAYMENT,
  l_extendedprice AS AMT_INSTALMENT
FROM line_orders""")

_role("pos_cash", ["line_orders"], """
SELECT o_custkey AS SK_ID_CURR,
  CAST(greatest(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)), 0) AS INTEGER) AS SK_DPD,
  l_quantity AS CNT_INSTALMENT,
  CASE WHEN l_linestatus = 'F' THEN CAST(0 AS DOUBLE) ELSE CAST(l_linenumber AS DOUBLE) END AS CNT_INSTALMENT_FUTURE
FROM line_orders""")

_role("card_balance", ["line_orders"], """
SELECT o_custkey AS SK_ID_CURR,
  l_extendedprice AS AMT_BALANCE, o_totalprice AS AMT_CREDIT_LIMIT_ACTUAL,
  l_extendedprice * (1 - l_discount) AS AMT_PAYMENT_CURRENT,
  l_quantity * 100 AS AMT_INST_MIN_REGULARITY,
  l_extendedprice * l_tax AS AMT_DRAWINGS_CURRENT,
  CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_extendedprice * l_tax * l_discount END AS AMT_DRAWINGS_ATM_CURRENT,
  CAST(greatest(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) - 30, 0) AS INTEGER) AS SK_DPD
FROM line_orders""")

_role("previous_application", [], """
SELECT o_orderkey AS SK_ID_PREV, o_custkey AS SK_ID_CURR,
  CASE WHEN o_orderstatus = 'F' THEN 'Approved' WHEN o_orderstatus = 'P' THEN 'Refused'
       ELSE 'Unused offer' END AS NAME_CONTRACT_STATUS
FROM orders""")

_role("survey", ["order_stats"], """
SELECT c.c_custkey AS row_id, CAST(c.c_acctbal < 0 AS INTEGER) AS TARGET,
  s._part_price / 100000 AS revolving_util,
  CAST(21 + c.c_custkey % 60 AS INTEGER) AS age_years,
  CAST(s._n_med_unfinished AS INTEGER) AS late_30_59,
  CASE WHEN s._sum_price = 0 THEN NULL ELSE s._open_price / s._sum_price END AS debt_ratio,
  CASE WHEN c.c_nationkey = 7 THEN NULL ELSE s._sum_price / 120 END AS monthly_income,
  CAST(s._n_open AS INTEGER) AS open_credits,
  CAST(s._n_urgent_partial AS INTEGER) AS late_90plus,
  CAST(s._n_ns_open AS INTEGER) AS real_estate_loans,
  CAST(s._n_high_partial AS INTEGER) AS late_60_89,
  CASE WHEN c.c_custkey % 11 = 0 THEN NULL ELSE CAST(c.c_nationkey % 4 AS DOUBLE) END AS dependents
FROM customer c LEFT JOIN order_stats s ON s.c_custkey = c.c_custkey""")

_role("lending", [], """
SELECT o_orderkey AS id, o_totalprice AS loan_amnt,
  CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN ' 60 months' ELSE ' 36 months' END AS term,
  o_totalprice / 36 AS installment,
  CASE o_orderkey % 13 WHEN 0 THEN '< 1 year' WHEN 1 THEN '1 year' WHEN 2 THEN '2 years'
       WHEN 3 THEN '3 years' WHEN 4 THEN '4 years' WHEN 5 THEN '5 years' WHEN 6 THEN '6 years'
       WHEN 7 THEN '7 years' WHEN 8 THEN '8 years' WHEN 9 THEN '9 years' WHEN 10 THEN '10+ years'
       WHEN 11 THEN 'n/a' ELSE NULL END AS emp_length,
  CASE o_orderkey % 4 WHEN 0 THEN 'MORTGAGE' WHEN 1 THEN 'OWN' WHEN 2 THEN 'RENT' ELSE NULL END AS home_ownership,
  CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST((o_orderkey % 97 + 3) * 10000 AS DOUBLE) END AS annual_inc,
  CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN 'Charged Off' ELSE 'Fully Paid' END
       WHEN o_orderstatus = 'O' THEN 'Current'
       ELSE CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'Default' END END AS loan_status,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'medical' WHEN '2-HIGH' THEN 'small_business'
       WHEN '3-MEDIUM' THEN 'debt_consolidation' WHEN '4-NOT SPECIFIED' THEN 'other'
       ELSE 'credit_card' END AS purpose,
  CAST(o_orderkey % 40 AS DOUBLE) AS dti,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 3 ELSE 0 END AS DOUBLE) AS delinq_2yrs,
  CAST(o_orderkey % 20 AS DOUBLE) AS open_acc,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 100 AS VARCHAR) || '.5%'
       WHEN o_orderkey % 5 = 1 THEN CAST(o_orderkey % 100 AS VARCHAR)
       WHEN o_orderkey % 5 = 2 THEN 'n/a'
       ELSE CAST(o_orderkey % 100 AS VARCHAR) || '%' END AS revol_util,
  CAST(o_orderkey % 20 + o_orderkey % 9 AS DOUBLE) AS total_acc,
  o_totalprice / 10 AS revol_bal, o_totalprice * 2 AS tot_cur_bal,
  CAST(o_orderkey % 11 = 0 AS DOUBLE) AS num_accts_ever_120_pd,
  CAST(100 - o_orderkey % 30 AS DOUBLE) AS pct_tl_nvr_dlq,
  CAST(o_orderkey % 3 AS DOUBLE) AS pub_rec
FROM orders""")

_role("bank_loans", [], """
SELECT o_orderkey AS loan_id, o_custkey AS account_id, o_totalprice AS amount,
  CAST(12 * (o_orderkey % 5 + 1) AS INTEGER) AS duration,
  o_totalprice / CAST(12 * (o_orderkey % 5 + 1) AS INTEGER) AS payments,
  CASE WHEN o_orderstatus = 'F' THEN 'A' WHEN o_orderstatus = 'O' THEN 'C'
       WHEN o_orderpriority = '1-URGENT' THEN 'B' ELSE 'D' END AS status
FROM orders""")

_role("bank_transactions", [], """
SELECT event_id AS trans_id, user_id AS account_id,
  CASE WHEN event_type IN ('error', 'signup') THEN 'VYDAJ' ELSE 'PRIJEM' END AS type,
  value AS amount,
  CASE WHEN event_type IN ('error', 'signup') THEN -value * 10 ELSE value * 10 END AS balance
FROM events""")


def with_roles(*names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """WITH clause holding the named roles (and their dependencies) followed
    by extra (name, sql) CTEs."""
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in ROLE_SQL[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({ROLE_SQL[n][0].strip()})" for n in order]
    parts += [f"{n} AS ({s.strip()})" for n, s in (extra or [])]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


_role("score_requests", ["order_stats"], """
SELECT c.c_custkey AS request_id, c.c_custkey % 13 = 0 AS is_new_user,
  s._sum_price / 10 AS annual_income, s._max_price AS loan_amount, s._avg_price / 36 AS monthly_payment,
  CAST(CASE WHEN s._n_urgent > 2 THEN 60 ELSE 36 END AS INTEGER) AS loan_term,
  CAST((c.c_nationkey * 3) % 60 AS DOUBLE) AS dti,
  c.c_custkey % 5 <> 0 AS has_checking, CAST(c.c_nationkey % 5 AS INTEGER) AS checking_tier,
  c.c_acctbal > 1000 AS has_savings, greatest(c.c_acctbal, 0) * 10 AS savings_amount,
  CAST(floor(least(greatest(c.c_acctbal, 0) / 2500, 4)) AS INTEGER) AS savings_tier,
  CAST(21 + c.c_custkey % 50 AS INTEGER) AS age, CAST(1 + c.c_nationkey % 5 AS INTEGER) AS family_size,
  c.c_custkey % 7 <> 0 AS employed, CAST(c.c_custkey % 15 AS DOUBLE) AS employment_years,
  CAST(c.c_custkey % 5 AS INTEGER) AS employment_stability,
  c.c_mktsegment IN ('BUILDING', 'HOUSEHOLD') AS owns_property,
  CAST(c.c_nationkey % 3 + 1 AS INTEGER) AS region_rating,
  s._n_urgent > 2 AS high_risk_purpose, c.c_custkey % 9 = 0 AS has_guarantor,
  CAST(s._n_open AS INTEGER) AS existing_credits,
  CAST(c.c_custkey % 100 AS DOUBLE) / 100 AS cc_utilization,
  CAST(s._n_urgent AS INTEGER) AS enquiries,
  CAST(s._n_med_unfinished AS DOUBLE) / 10 AS late_payment_rate,
  CAST(CASE WHEN s._n_urgent_partial > 0 THEN 90 WHEN s._n_high_partial > 0 THEN 30 ELSE 0 END AS INTEGER) AS max_days_late,
  s._n_urgent_partial + s._n_high_partial > 0 AS has_past_delays,
  CAST(4 - least(s._n_urgent_partial, 4) AS INTEGER) AS credit_history,
  CAST(c.c_custkey % 11 AS DOUBLE) / 10 AS approval_rate,
  CAST(s._n_open + s._n_urgent AS INTEGER) AS prev_applications,
  CAST(c.c_custkey % 10 AS DOUBLE) / 10 AS docs_rate
FROM customer c LEFT JOIN order_stats s ON s.c_custkey = c.c_custkey""")
