"""Query registry: one entry per operator of the blueprint, each a function
(spark, sf_dir) -> DataFrame over the driver tables, plus the equivalent
DuckDB SQL used as the correctness oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.expr import round_doubles
from ..operators import rollups as R
from ..sources import driver_roles as DR
from . import oracle_features as OF
from . import sources as S

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def register(name: str):
    """Register a query. Registered results round double columns to 6
    decimals (ties away from zero, the same steps as the SQL oracle) so that
    engines summing in different orders compare equal; the operators
    themselves return full precision."""
    def deco(fn):
        _QUERIES[name] = lambda spark, sf_dir: round_doubles(fn(spark, sf_dir))
        _QUERIES[name].__doc__ = fn.__doc__
        return fn
    return deco


# ------------------------------------------------------------- rollups
@register("bureau_status_counts")
def q_bureau_status_counts(spark, sf_dir):
    """A1 + J1: bureau credits with their bad / unknown status month counts."""
    b = DR.bureau(spark, sf_dir).select("SK_ID_BUREAU", "SK_ID_CURR")
    return R.bureau_with_status(b, DR.bureau_balance(spark, sf_dir)).select(
        "SK_ID_BUREAU", "SK_ID_CURR", "bad_months", "dpd_months")


def _applicant_rollup(spark, sf_dir, roll, feats):
    return R.attach(S.applicant_keys(spark, sf_dir), roll).select("SK_ID_CURR", *feats)


@register("bureau_rollup")
def q_bureau_rollup(spark, sf_dir):
    """A2 + J2."""
    roll = R.bureau_rollup(R.bureau_with_status(DR.bureau(spark, sf_dir), DR.bureau_balance(spark, sf_dir)))
    return _applicant_rollup(spark, sf_dir, roll, R.BUREAU_FEATURES)


@register("installment_rollup")
def q_installment_rollup(spark, sf_dir):
    """A3 + J3 (flagship): per-applicant payment behaviour."""
    return _applicant_rollup(spark, sf_dir, R.installment_rollup(DR.installments(spark, sf_dir)),
                             R.INSTALLMENT_FEATURES)


@register("pos_rollup")
def q_pos_rollup(spark, sf_dir):
    """A4 + J4."""
    return _applicant_rollup(spark, sf_dir, R.pos_rollup(DR.pos_cash(spark, sf_dir)), R.POS_FEATURES)


@register("card_rollup")
def q_card_rollup(spark, sf_dir):
    """A5 + J5."""
    return _applicant_rollup(spark, sf_dir, R.card_rollup(DR.card_balance(spark, sf_dir)), R.CARD_FEATURES)


@register("prev_rollup")
def q_prev_rollup(spark, sf_dir):
    """A6 + J6."""
    return _applicant_rollup(spark, sf_dir, R.prev_rollup(DR.previous_application(spark, sf_dir)),
                             R.PREV_FEATURES)


@register("txn_rollup")
def q_txn_rollup(spark, sf_dir):
    """A7 + J8: loans with their account's transaction statistics."""
    loans = DR.bank_loans(spark, sf_dir).select("loan_id", "account_id")
    return R.attach(loans, R.txn_rollup(DR.bank_transactions(spark, sf_dir)), key="account_id").select(
        "loan_id", "account_id", *R.TXN_COLUMNS)


# ------------------------------------------------------------- builders
@register("hc_features")
def q_hc_features(spark, sf_dir):
    """Bureau source: P2-P9, P17-P20, J2-J6 -> 84-column catalogue rows."""
    return S.hc_features(spark, sf_dir)


@register("gm_features")
def q_gm_features(spark, sf_dir):
    """Survey source: P1, P7, P9, P11 -> catalogue rows."""
    return S.gm_features(spark, sf_dir)


@register("lc_features")
def q_lc_features(spark, sf_dir):
    """Peer-lending source: S4, F1, P12, P15, P16, P20 -> catalogue rows."""
    return S.lc_features(spark, sf_dir)


@register("cz_features")
def q_cz_features(spark, sf_dir):
    """Bank source: A7, J8, P13, P14, P22 -> catalogue rows."""
    return S.cz_features(spark, sf_dir)


@register("unify_sources")
def q_unify(spark, sf_dir):
    """U1 + P4: the unified 87-column table."""
    return S.unified(spark, sf_dir)


def queries() -> dict[str, Query]:
    from . import more_queries  # noqa: F401  (registers the remaining operators)
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import more_queries
    out = {}
    out.update(OF.rollup_oracles())
    out.update(OF.feature_oracles())
    out.update(more_queries.oracles())
    return out
