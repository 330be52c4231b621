"""Child-table rollups on hand-written rows (FIXTURES 1)."""
import math

from creditlake.operators import rollups as R


def test_installment_rollup_nulls_and_groups(spark):
    rows = [
        # applicant 1: one late, one early, one unpaid (NULL payment day)
        (1, 10.0, 5.0, 100.0, 100.0),
        (1, 3.0, 5.0, 50.0, 99.0),
        (1, None, 5.0, 10.0, 9.0),
        # applicant 2: a single on-time row -> sample std NULL
        (2, 5.0, 5.0, 10.0, 9.0),
    ]
    inst = spark.createDataFrame(rows, "SK_ID_CURR long, DAYS_ENTRY_PAYMENT double, DAYS_INSTALMENT double, "
                                       "AMT_PAYMENT double, AMT_INSTALMENT double")
    keys = spark.createDataFrame([(1,), (2,), (3,)], "SK_ID_CURR long")
    out = {r.SK_ID_CURR: r for r in R.attach(keys, R.installment_rollup(inst)).collect()}
    a = out[1]
    assert a.inst_late_payment_rate == 1 / 4 and a.inst_early_payment_rate == 1 / 4
    assert a.inst_on_time_rate == 0.0
    assert a.inst_days_late_max == 5.0 and a.inst_days_late_mean == 1.5
    ratios = [100 / 101, 50 / 100, 10 / 10]
    m = sum(ratios) / 3
    sd = math.sqrt(sum((x - m) ** 2 for x in ratios) / 2)
    assert abs(a.inst_payment_ratio_std - sd) < 1e-12
    assert abs(a.inst_payment_consistency - 1 / (sd + 0.01)) < 1e-9
    b = out[2]
    assert b.inst_on_time_rate == 0.5 and b.inst_payment_ratio_std is None and b.inst_payment_consistency is None
    c = out[3]
    assert all(getattr(c, f) is None for f in R.INSTALLMENT_FEATURES)


def test_bureau_rollup_all_null_sum_is_zero(spark):
    bureau = spark.createDataFrame(
        [(10, 1, 0, None, 5.0, 10.0, "Active"), (11, 1, 3, None, 0.0, 20.0, "Closed"),
         (12, 2, 1, 7.0, None, None, None)],
        "SK_ID_BUREAU long, SK_ID_CURR long, CREDIT_DAY_OVERDUE int, AMT_CREDIT_SUM_OVERDUE double, "
        "AMT_CREDIT_SUM_DEBT double, AMT_CREDIT_SUM double, CREDIT_ACTIVE string")
    bal = spark.createDataFrame([(10, "2"), (10, "X"), (10, "1"), (11, "5"), (11, "C")],
                                "SK_ID_BUREAU long, STATUS string")
    out = {r.SK_ID_CURR: r for r in R.bureau_rollup(R.bureau_with_status(bureau, bal)).collect()}
    a, b = out[1], out[2]
    assert a.bureau_credit_sum_overdue == 0.0            # all-missing sum -> 0
    assert a.bureau_bad_status_months == 2.0            # '2' and '5'; '1' counts nowhere
    assert a.bureau_dpd_months_mean == 0.5              # X months: 1 and 0
    assert a.bureau_active_credit_ratio == 1 / 3
    assert a.bureau_debt_to_credit_ratio == 5 / 31
    assert b.bureau_dpd_months_mean is None             # credit without monthly rows
    assert b.bureau_active_credit_ratio == 0.0           # NULL status not counted: 0/(0+1)


def test_txn_rollup(spark):
    t = spark.createDataFrame([(1, 7, "PRIJEM", 10.0, 100.0), (2, 7, "VYDAJ", 5.0, -50.0), (3, 8, "PRIJEM", None, 1.0)],
                              "trans_id long, account_id long, type string, amount double, balance double")
    out = {r.account_id: r for r in R.txn_rollup(t).collect()}
    assert out[7].total_credit == 15.0 and out[7].neg_bal_count == 1 and out[7].neg_balance_rate == 1 / 3
    assert out[8].total_credit == 0.0 and out[8].std_balance is None and out[8].balance_consistency is None


def test_one_aggregate_over_lines_gives_the_three_rollups(spark, tmp_path):
    from creditlake.operators import rollups as R
    from creditlake.plans import sources as S
    from creditlake.sources import driver_roles as DR
    d = str(tmp_path)
    spark.createDataFrame([(k, f"c{k}", k % 25, 10.0 * k - 20, "BUILDING") for k in range(6)],
                          "c_custkey long, c_name string, c_nationkey long, c_acctbal double, c_mktsegment string").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame([(k, None if k == 3 else k % 4, "OFP"[k % 3], 100.0 + k, f"2001-0{1 + k % 9}-11", "1-URGENT") for k in range(20)],
                          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string") \
        .selectExpr("* except(o_orderdate)", "cast(o_orderdate as timestamp) o_orderdate").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(k % 22, k % 5, float(k % 9), None if k % 13 == 0 else 10.0 + k, 0.01 * (k % 7), 0.02 * (k % 3), "RNA"[k % 3], "OF"[k % 2],
                            f"2001-0{1 + k % 9}-15") for k in range(120)],
                          "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                          "l_returnflag string, l_linestatus string, l_shipdate string") \
        .selectExpr("* except(l_shipdate)", "cast(l_shipdate as timestamp) l_shipdate").write.parquet(f"{d}/lineitem.parquet")
    got = {r["SK_ID_CURR"]: r for r in R.line_rollup(DR.lines(spark, d)).collect()}
    assert len(got) == 5 and None in got
    for roll in (R.installment_rollup(DR.installments(spark, d)), R.pos_rollup(DR.pos_cash(spark, d)), R.card_rollup(DR.card_balance(spark, d))):
        for r in roll.collect():
            for c, v in r.asDict().items():
                w = got[r["SK_ID_CURR"]][c]
                assert (v is None) == (w is None) and (v is None or abs(v - w) <= 1e-9 * max(1, abs(v))), (r["SK_ID_CURR"], c)
    # the line items are read for the lines and for the monthly status, not once a rollup
    plan = S.hc_features(spark, d)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and sum("lineitem" in x or "l_orderkey" in x for x in plan.splitlines() if "Relation" in x) == 2
