"""Child-table rollups (aggregate before join) and their left joins.

Each rollup is one ``groupBy(key).agg(...)``: Spark runs a partial
aggregate per input partition before the shuffle, so a key that owns a
third of the child rows still ships one partial row per partition. The
rollup output is unique on the key, so the following left joins are
key-unique on the build side and never fan out. All applicant rollups are
keyed by ``SK_ID_CURR``; their outputs are hash-partitioned on that key,
so the chain of left joins re-uses one partitioning of the applicant side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalog import BUREAU_BAD_STATUS, BUREAU_UNKNOWN_STATUS
from ..functions.expr import div, flag, ratio1

KEY = "SK_ID_CURR"


def _d(x):
    return x.cast("double")


def bureau_status_counts(bureau_balance: DataFrame) -> DataFrame:
    """A1: per credit, months in a bad status (2-5) and in status 'X'."""
    st = F.col("STATUS")
    return bureau_balance.groupBy("SK_ID_BUREAU").agg(
        F.count_if(st.isin(BUREAU_BAD_STATUS)).alias("bad_months"),
        F.count_if(st == BUREAU_UNKNOWN_STATUS).alias("dpd_months"),
    )


def bureau_with_status(bureau: DataFrame, bureau_balance: DataFrame) -> DataFrame:
    """Bureau credits left-joined with their monthly-status counts."""
    return bureau.join(bureau_status_counts(bureau_balance), "SK_ID_BUREAU", "left")


BUREAU_FEATURES = ["bureau_credit_day_overdue_max", "bureau_credit_sum_overdue",
                   "bureau_debt_to_credit_ratio", "bureau_bad_status_months",
                   "bureau_dpd_months_mean", "bureau_active_credit_ratio"]


def bureau_rollup(bureau_joined: DataFrame) -> DataFrame:
    """A2: per applicant bureau statistics (sums of all-missing groups are 0)."""
    g = bureau_joined.groupBy(KEY).agg(
        _d(F.max("CREDIT_DAY_OVERDUE")).alias("bureau_credit_day_overdue_max"),
        F.coalesce(F.sum("AMT_CREDIT_SUM_OVERDUE"), F.lit(0.0)).alias("bureau_credit_sum_overdue"),
        F.coalesce(F.sum("AMT_CREDIT_SUM_DEBT"), F.lit(0.0)).alias("_debt_sum"),
        F.coalesce(F.sum("AMT_CREDIT_SUM"), F.lit(0.0)).alias("_credit_sum"),
        _d(F.coalesce(F.sum("bad_months"), F.lit(0))).alias("bureau_bad_status_months"),
        F.avg("dpd_months").alias("bureau_dpd_months_mean"),
        F.count_if(F.col("CREDIT_ACTIVE") == "Active").alias("_active"),
        F.count("CREDIT_ACTIVE").alias("_total"),
    )
    return g.select(
        KEY, "bureau_credit_day_overdue_max", "bureau_credit_sum_overdue",
        ratio1("_debt_sum", "_credit_sum").alias("bureau_debt_to_credit_ratio"),
        "bureau_bad_status_months", "bureau_dpd_months_mean",
        ratio1("_active", "_total").alias("bureau_active_credit_ratio"),
    )


INSTALLMENT_FEATURES = ["inst_late_payment_rate", "inst_early_payment_rate", "inst_on_time_rate",
                        "inst_payment_consistency", "inst_days_late_max", "inst_days_late_mean",
                        "inst_payment_ratio_mean", "inst_payment_ratio_std"]


def _installment_rows(at: str = "") -> list:
    x = lambda name: F.col(at + name)
    late = x("DAYS_ENTRY_PAYMENT") - x("DAYS_INSTALMENT")
    return [
        late.alias("days_late"),
        ratio1(x("AMT_PAYMENT"), x("AMT_INSTALMENT")).alias("pay_ratio"),
        flag(late > 0).alias("late_flag"),
        flag(late < 0).alias("early_flag"),
        flag(late == 0).alias("ontime_flag"),
    ]


def _installment_aggs() -> list:
    return [
        F.sum("late_flag").alias("_late"),
        F.sum("early_flag").alias("_early"),
        F.sum("ontime_flag").alias("_ontime"),
        F.count("late_flag").alias("_n_paid"),
        F.max("days_late").alias("inst_days_late_max"),
        F.avg("days_late").alias("inst_days_late_mean"),
        F.avg("pay_ratio").alias("inst_payment_ratio_mean"),
        F.stddev_samp("pay_ratio").alias("inst_payment_ratio_std"),
    ]


def _installment_out() -> list:
    return [
        ratio1("_late", "_n_paid").alias("inst_late_payment_rate"),
        ratio1("_early", "_n_paid").alias("inst_early_payment_rate"),
        ratio1("_ontime", "_n_paid").alias("inst_on_time_rate"),
        div(F.lit(1.0), F.col("inst_payment_ratio_std") + 0.01).alias("inst_payment_consistency"),
        *[F.col(x) for x in ("inst_days_late_max", "inst_days_late_mean",
                             "inst_payment_ratio_mean", "inst_payment_ratio_std")],
    ]


def installment_rollup(installments: DataFrame) -> DataFrame:
    """A3: per applicant payment punctuality and payment-ratio statistics."""
    return installments.select(KEY, *_installment_rows()).groupBy(KEY).agg(*_installment_aggs()).select(KEY, *_installment_out())


POS_FEATURES = ["pos_dpd_rate", "pos_dpd_occurrences", "pos_sk_dpd_max", "pos_completion_ratio"]


def _pos_rows(at: str = "") -> list:
    return [F.col(at + "SK_DPD").alias("_pos_dpd"), F.col(at + "CNT_INSTALMENT").alias("_pos_inst"),
            F.col(at + "CNT_INSTALMENT_FUTURE").alias("_pos_future")]


def _pos_aggs() -> list:
    return [
        F.sum(flag(F.col("_pos_dpd") > 0)).alias("_dpd"),
        F.count("*").alias("_n_pos"),
        _d(F.max("_pos_dpd")).alias("pos_sk_dpd_max"),
        F.avg("_pos_inst").alias("_inst_mean"),
        F.avg("_pos_future").alias("_future_mean"),
    ]


def _pos_out() -> list:
    return [
        ratio1("_dpd", "_n_pos").alias("pos_dpd_rate"),
        _d(F.col("_dpd")).alias("pos_dpd_occurrences"),
        F.col("pos_sk_dpd_max"),
        (F.lit(1.0) - ratio1("_future_mean", "_inst_mean")).alias("pos_completion_ratio"),
    ]


def pos_rollup(pos: DataFrame) -> DataFrame:
    """A4: per applicant point-of-sale days-past-due and completion."""
    return pos.select(KEY, *_pos_rows()).groupBy(KEY).agg(*_pos_aggs()).select(KEY, *_pos_out())


CARD_FEATURES = ["cc_utilization_mean", "cc_utilization_max", "cc_payment_rate_mean",
                 "cc_payment_rate_std", "cc_dpd_mean", "cc_dpd_max",
                 "cc_drawing_rate_mean", "cc_atm_to_total_drawing"]


def _card_rows(at: str = "") -> list:
    x = lambda name: F.col(at + name)
    return [
        x("SK_DPD").alias("_card_dpd"),
        ratio1(x("AMT_BALANCE"), x("AMT_CREDIT_LIMIT_ACTUAL")).alias("util"),
        ratio1(x("AMT_PAYMENT_CURRENT"), x("AMT_INST_MIN_REGULARITY")).alias("pay_rate"),
        ratio1(x("AMT_DRAWINGS_CURRENT"), x("AMT_CREDIT_LIMIT_ACTUAL")).alias("draw_rate"),
        ratio1(x("AMT_DRAWINGS_ATM_CURRENT"), x("AMT_DRAWINGS_CURRENT")).alias("atm_rate"),
    ]


def _card_aggs() -> list:
    return [
        F.avg("util").alias("cc_utilization_mean"),
        F.max("util").alias("cc_utilization_max"),
        F.avg("pay_rate").alias("cc_payment_rate_mean"),
        F.stddev_samp("pay_rate").alias("cc_payment_rate_std"),
        F.avg("_card_dpd").alias("cc_dpd_mean"),
        _d(F.max("_card_dpd")).alias("cc_dpd_max"),
        F.avg("draw_rate").alias("cc_drawing_rate_mean"),
        F.avg("atm_rate").alias("cc_atm_to_total_drawing"),
    ]


def card_rollup(card: DataFrame) -> DataFrame:
    """A5: per applicant card utilisation, payment and drawing ratios."""
    return card.select(KEY, *_card_rows()).groupBy(KEY).agg(*_card_aggs())


def line_rollup(lines: DataFrame) -> DataFrame:
    """A3 + A4 + A5 over rows that are an installment, a point-of-sale row and a card row at once (structs
    ``inst``, ``pos`` and ``card`` of these sources' columns): one aggregate, so the rows are read, joined
    and shuffled once instead of once a rollup."""
    rows = [*_installment_rows("inst."), *_pos_rows("pos."), *_card_rows("card.")]
    g = lines.select(KEY, *rows).groupBy(KEY).agg(*_installment_aggs(), *_pos_aggs(), *_card_aggs())
    return g.select(KEY, *_installment_out(), *_pos_out(), *CARD_FEATURES)


PREV_FEATURES = ["prev_approval_rate", "prev_refusal_rate", "prev_total_applications"]


def prev_rollup(prev: DataFrame) -> DataFrame:
    """Per applicant approval / refusal rates of earlier applications."""
    st = F.col("NAME_CONTRACT_STATUS")
    g = prev.groupBy(KEY).agg(
        F.count("SK_ID_PREV").alias("_n"),
        F.count_if(st == "Approved").alias("_approved"),
        F.count_if(st == "Refused").alias("_refused"),
    )
    return g.select(
        KEY,
        ratio1("_approved", "_n").alias("prev_approval_rate"),
        ratio1("_refused", "_n").alias("prev_refusal_rate"),
        _d(F.col("_n")).alias("prev_total_applications"),
    )


TXN_COLUMNS = ["trans_count", "mean_balance", "min_balance", "std_balance",
               "neg_bal_count", "total_credit", "balance_consistency", "neg_balance_rate"]


def txn_rollup(trans: DataFrame) -> DataFrame:
    """Per account transaction statistics. ``total_credit`` sums every
    transaction amount, credits and debits alike (kept as in the source)."""
    g = trans.groupBy("account_id").agg(
        F.count("trans_id").alias("trans_count"),
        F.avg("balance").alias("mean_balance"),
        F.min("balance").alias("min_balance"),
        F.stddev_samp("balance").alias("std_balance"),
        F.sum(flag(F.col("balance") < 0)).alias("neg_bal_count"),
        F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total_credit"),
    )
    return g.select(
        "account_id", "trans_count", "mean_balance", "min_balance", "std_balance",
        "neg_bal_count", "total_credit",
        div(F.lit(1.0), F.col("std_balance") + 1).alias("balance_consistency"),
        ratio1("neg_bal_count", "trans_count").alias("neg_balance_rate"),
    )


def attach(base: DataFrame, rollup: DataFrame, key: str = KEY) -> DataFrame:
    """Look the rollup up by key (left outer, unmatched -> NULL)."""
    return base.join(rollup, key, "left")
