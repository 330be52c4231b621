"""Oracle SQL (DuckDB) for profiling and preparation, generated from the
catalogue (one expression per feature; no engine logic is shared with the
Spark side)."""

from __future__ import annotations

from ..functions import catalog as K
from ..operators import profile as P
from ..operators.prep import forced_features
from .oracle_features import round_sql, unified_sql

FEATS = list(K.ALL_FEATURES)
ORD = {f: i for i, f in enumerate(FEATS)}


def _u() -> str:
    return f"WITH u AS ({unified_sql()})\n"


def _union(selects):
    return "\nUNION ALL\n".join(selects)


def _nan_null(x):
    return f"(CASE WHEN isnan({x}) THEN NULL ELSE {x} END)"


def _bin_sql(x, edges, labels):
    parts = [f"WHEN {x} > {lo} AND {x} <= {hi} THEN '{lab}'"
             for lo, hi, lab in zip(edges[:-1], edges[1:], labels)]
    return "(CASE " + " ".join(parts) + " END)"


def profile_oracles() -> dict[str, str]:
    u = _u()
    out = {}
    out["dataset_overview"] = round_sql(
        u + f"SELECT count(*) AS n_rows, avg(TARGET) AS default_rate, CAST({len(FEATS) + 3} AS BIGINT) AS n_columns FROM u",
        ["default_rate"])
    out["source_counts"] = round_sql(
        u + "SELECT source_dataset, count(*) AS n_rows, avg(TARGET) AS default_rate FROM u "
            "WHERE source_dataset IS NOT NULL GROUP BY source_dataset", ["default_rate"])
    late = "(CASE WHEN inst_late_payment_rate IS NULL THEN NULL WHEN inst_late_payment_rate < 0 THEN 0 " \
           "WHEN inst_late_payment_rate > 0.5 THEN 0.5 ELSE inst_late_payment_rate END)"
    keys = {
        "source_dataset": "source_dataset",
        "age_group": _bin_sql("age_years", P.AGE_EDGES, P.AGE_LABELS),
        "employed_flag": "CAST(employed_flag AS VARCHAR)",
        "has_loan_history": "CAST(has_loan_history AS VARCHAR)",
        "has_savings": "CAST(has_savings AS VARCHAR)",
        "checking_account_ordinal": "CAST(checking_account_ordinal AS VARCHAR)",
        "employment_stability": "CAST(employment_stability AS VARCHAR)",
        "late_bucket": f"(CASE WHEN {late} = 0 THEN '{P.LATE_LABELS[0]}' ELSE {_bin_sql(late, P.LATE_EDGES, P.LATE_LABELS)} END)",
    }
    out["default_rate_by_key"] = round_sql(u + _union([
        f"SELECT '{k}' AS dimension, key, count(*) AS n_rows, avg(TARGET) AS default_rate "
        f"FROM (SELECT {e} AS key, TARGET FROM u) t WHERE key IS NOT NULL GROUP BY key"
        for k, e in keys.items()]), ["default_rate"])
    wide = "m AS (SELECT " + ", ".join(f"avg(CAST({f} IS NULL AS DOUBLE)) AS {f}" for f in FEATS) + " FROM u)"
    mr = _union([f"SELECT '{f}' AS feature, {ORD[f]} AS ordinal, {f} AS missing_rate FROM m" for f in FEATS])
    mr_sql = (f"SELECT feature, ordinal, missing_rate, CASE WHEN missing_rate = 0 THEN 'complete' "
              f"WHEN missing_rate = 1 THEN 'empty' ELSE 'partial' END AS status FROM ({mr}) r")
    out["missing_rates"] = round_sql(u.rstrip("\n") + ", " + wide + "\n" + mr_sql, ["missing_rate"])
    out["top_missing"] = round_sql(u.rstrip("\n") + ", " + wide + "\n" +
                                   f"SELECT * FROM ({mr_sql}) s ORDER BY missing_rate DESC, ordinal LIMIT 30",
                                   ["missing_rate"])
    out["coverage_by_source"] = round_sql(u + _union([
        f"SELECT source_dataset, '{f}' AS feature, avg(CAST({f} IS NOT NULL AS DOUBLE)) * 100 AS coverage_pct "
        f"FROM u GROUP BY source_dataset" for f in FEATS]), ["coverage_pct"])
    out["class_balance"] = round_sql(
        u + "SELECT n_negative, n_positive, n_negative / n_rows AS share_negative, n_positive / n_rows AS share_positive, "
            "CASE WHEN n_positive = 0 THEN NULL ELSE n_negative / n_positive END AS imbalance_ratio, "
            "CASE WHEN n_positive = 0 THEN NULL ELSE round(n_negative / n_positive, 2) END AS class_weight "
            "FROM (SELECT count(*) FILTER (WHERE TARGET = 0) AS n_negative, count(*) FILTER (WHERE TARGET = 1) AS n_positive, "
            "count(*) AS n_rows FROM u) c",
        ["share_negative", "share_positive", "imbalance_ratio", "class_weight"])
    out["cohort_rates"] = round_sql(
        u + "SELECT count(*) FILTER (WHERE has_loan_history = 0) AS n_new, count(*) FILTER (WHERE has_loan_history = 1) AS n_existing, "
            "avg(CAST(has_loan_history = 0 AS DOUBLE)) AS share_new, "
            "avg(CASE WHEN has_loan_history = 0 THEN TARGET END) AS default_rate_new, "
            "avg(CASE WHEN has_loan_history = 1 THEN TARGET END) AS default_rate_existing FROM u",
        ["share_new", "default_rate_new", "default_rate_existing"])
    cols = FEATS[:P.CORR_FEATURE_COUNT] + ["TARGET"]
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    cw = "cw AS (SELECT " + ", ".join(
        f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) AS r{i}" for i, (a, b) in enumerate(pairs)) + " FROM u)"
    corr_rows = _union([f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {_nan_null(f'r{i}')} AS corr FROM cw"
                        for i, (a, b) in enumerate(pairs)])
    out["corr_matrix"] = round_sql(u.rstrip("\n") + ", " + cw + "\n" + corr_rows, ["corr"])
    out["label_correlations"] = round_sql(
        u.rstrip("\n") + ", " + cw + "\n" +
        f"SELECT feature_a AS feature, corr FROM ({corr_rows}) c WHERE feature_b = 'TARGET' AND feature_a <> 'TARGET'",
        ["corr"])
    probs = (0.01, 0.25, 0.5, 0.75, 0.99)
    qn = [P._qname(p) for p in probs]
    out["quantiles"] = round_sql(u + _union([
        f"SELECT '{f}' AS feature, " + ", ".join(f"quantile_cont({f}, {p}) AS {n}" for p, n in zip(probs, qn)) +
        f" FROM u HAVING count({f}) > 0" for f in FEATS]), qn)
    out["key_stats"] = round_sql(u + _union([
        f"SELECT '{f}' AS feature, avg({f}) AS mean, quantile_cont({f}, 0.5) AS median, stddev_samp({f}) AS std, "
        f"avg(CAST({f} IS NULL AS DOUBLE)) AS missing_rate, count({f}) AS n_present FROM u"
        for f in P.KEY_STAT_FEATURES]), ["mean", "median", "std", "missing_rate"])
    kf = P.KEY_FEATURES
    hist = (u.rstrip("\n") + ",\n"
            f"lf AS (UNPIVOT (SELECT TARGET, {', '.join(kf)} FROM u) ON {', '.join(kf)} INTO NAME feature VALUE value),\n"
            "pres AS (SELECT feature, count(*) AS _n, quantile_cont(value, 0.99) AS cap FROM lf GROUP BY feature HAVING count(*) > 100),\n"
            "x AS (SELECT lf.feature, lf.TARGET, least(lf.value, pres.cap) AS x FROM lf JOIN pres ON lf.feature = pres.feature WHERE lf.TARGET IS NOT NULL),\n"
            "rng AS (SELECT feature, TARGET, min(x) AS lo0, max(x) AS hi0, count(*) AS n FROM x GROUP BY feature, TARGET),\n"
            "r2 AS (SELECT feature, TARGET, n, CASE WHEN hi0 = lo0 THEN lo0 - 0.5 ELSE lo0 END AS lo, "
            "CASE WHEN hi0 = lo0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM rng),\n"
            "b AS (SELECT x.feature, x.TARGET, CAST(least(floor((x.x - r2.lo) / ((r2.hi - r2.lo) / 50)), 49) AS INTEGER) AS bin, "
            "r2.lo, r2.hi, r2.n FROM x JOIN r2 ON x.feature = r2.feature AND x.TARGET = r2.TARGET)\n"
            "SELECT feature, TARGET, bin, lo + bin * ((hi - lo) / 50) AS bin_lo, lo + (bin + 1) * ((hi - lo) / 50) AS bin_hi, "
            "count(*) AS count, count(*) / (n * ((hi - lo) / 50)) AS density FROM b GROUP BY feature, TARGET, bin, lo, hi, n")
    out["class_histogram"] = round_sql(hist, ["bin_lo", "bin_hi", "density"])
    return out


# ------------------------------------------------------------------ prep
def _prep_ctes() -> str:
    """CTE chain: u -> cleaned -> bw (bounds) -> w (winsorized) -> st (impute
    stats) -> imp (imputed)."""
    fl = ", ".join(FEATS)
    ordx = ("CASE source_dataset " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(K.SOURCE_ORDER))
            + f" ELSE {len(K.SOURCE_ORDER)} END")
    cleaned = (f"cleaned AS (SELECT source_id, TARGET, source_dataset, {fl} FROM (SELECT *, row_number() OVER "
               f"(PARTITION BY {fl} ORDER BY {ordx}, TRY_CAST(split_part(source_id, '_', 1) AS BIGINT), source_id) AS rn "
               f"FROM u WHERE TARGET IS NOT NULL) d WHERE rn = 1)")
    bw = "bw AS (SELECT " + ", ".join(
        f"quantile_cont({f}, {K.WINSOR_LOW}) AS lo_{f}, quantile_cont({f}, {K.WINSOR_HIGH}) AS hi_{f}" for f in FEATS) \
        + " FROM cleaned)"
    wcols = ", ".join(
        f"CASE WHEN lo_{f} < hi_{f} THEN (CASE WHEN {f} < lo_{f} THEN lo_{f} WHEN {f} > hi_{f} THEN hi_{f} ELSE {f} END) "
        f"ELSE {f} END AS {f}" for f in FEATS)
    w = f"w AS (SELECT source_id, TARGET, source_dataset, {wcols} FROM cleaned, bw)"
    st = "st AS (SELECT " + ", ".join(
        f"avg(CAST({f} IS NULL AS DOUBLE)) AS mr_{f}, quantile_cont({f}, 0.5) AS md_{f}" for f in FEATS) + " FROM w)"
    icols = ", ".join(
        f"CASE WHEN mr_{f} = 1 THEN coalesce({f}, 0) WHEN mr_{f} > 0 THEN coalesce({f}, md_{f}) ELSE {f} END AS {f}"
        for f in FEATS)
    imp = f"imp AS (SELECT source_id, TARGET, source_dataset, {icols} FROM w, st)"
    return f"WITH u AS ({unified_sql()}),\n{cleaned},\n{bw},\n{w},\n{st},\n{imp}\n"


def _fscore_sql() -> str:
    forced = forced_features(FEATS)
    rem = [f for f in FEATS if f not in forced]
    parts = []
    for f in rem:
        per = (f"SELECT TARGET, count(*) AS n, avg(coalesce({f}, 0)) AS m, var_pop(coalesce({f}, 0)) AS v, "
               f"min(coalesce({f}, 0)) AS lo, max(coalesce({f}, 0)) AS hi FROM imp GROUP BY TARGET")
        parts.append(
            f"SELECT '{f}' AS feature, {ORD[f]} AS ordinal, CASE WHEN lo_all < hi_all AND ssw > 0 THEN (ssb / (k - 1)) / (ssw / (nn - k)) END AS f_score "
            f"FROM (SELECT sum(p.n * (p.m - t.mu) * (p.m - t.mu)) AS ssb, sum(p.n * p.v) AS ssw, "
            f"max(t.nn) AS nn, max(t.k) AS k, min(p.lo) AS lo_all, max(p.hi) AS hi_all FROM ({per}) p, "
            f"(SELECT sum(n) AS nn, sum(n * m) / sum(n) AS mu, count(*) AS k FROM ({per}) q) t) s")
    return _union(parts)


def _selected_sql() -> str:
    forced = forced_features(FEATS)
    k = min(len(FEATS) - len(forced), K.MAX_FEATURES - len(forced))
    fv = _union([f"SELECT CAST({i + 1} AS INTEGER) AS rank, '{f}' AS feature, CAST(NULL AS DOUBLE) AS f_score, true AS forced"
                 for i, f in enumerate(forced)])
    ranked = (f"SELECT CAST(row_number() OVER (ORDER BY round(f_score * CAST(1000000 AS DOUBLE)) DESC NULLS LAST, ordinal) + {len(forced)} AS INTEGER) AS rank, "
              f"feature, f_score, false AS forced FROM fs QUALIFY rank <= {len(forced) + k}")
    return f"{fv}\nUNION ALL\n{ranked}"


def prep_oracles() -> dict[str, str]:
    ctes = _prep_ctes()
    out = {}
    fl = ", ".join(FEATS)
    out["dedup_keep_first"] = round_sql(ctes + "SELECT * FROM cleaned", FEATS)
    cnt = "cnt AS (SELECT " + ", ".join(
        f"count(*) FILTER (WHERE lo_{f} < hi_{f} AND {f} < lo_{f}) AS nl_{f}, "
        f"count(*) FILTER (WHERE lo_{f} < hi_{f} AND {f} > hi_{f}) AS nh_{f}" for f in FEATS) + " FROM cleaned, bw)"
    rows = _union([f"SELECT '{f}' AS feature, lo_{f} AS lo, hi_{f} AS hi, lo_{f} < hi_{f} AS applied, "
                   f"nl_{f} AS n_clipped_low, nh_{f} AS n_clipped_high FROM bw, cnt WHERE lo_{f} IS NOT NULL" for f in FEATS])
    out["winsorize"] = round_sql(ctes.rstrip("\n") + ",\n" + cnt + "\n" + rows, ["lo", "hi"])
    irows = _union([
        f"SELECT '{f}' AS feature, {ORD[f]} AS ordinal, mr_{f} AS missing_rate, "
        f"CASE WHEN mr_{f} = 0 THEN 'complete' WHEN mr_{f} = 1 THEN 'empty' ELSE 'partial' END AS status, "
        f"CASE WHEN mr_{f} = 1 THEN CAST(0 AS DOUBLE) WHEN mr_{f} > 0 THEN md_{f} END AS fill_value FROM st"
        for f in FEATS])
    out["impute_median"] = round_sql(ctes + irows, ["missing_rate", "fill_value"])
    fs = f"fs AS ({_fscore_sql()})"
    out["anova_f"] = round_sql(ctes.rstrip("\n") + ",\n" + fs + "\nSELECT feature, f_score FROM fs", ["f_score"])
    sel = f"sel AS ({_selected_sql()})"
    out["select_topk"] = round_sql(ctes.rstrip("\n") + ",\n" + fs + ",\n" + sel + "\nSELECT * FROM sel", ["f_score"])
    qrows = _union([
        f"SELECT '{f}' AS feature, quantile_cont({f}, 0.5) AS center, "
        f"CASE WHEN quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) = 0 THEN CAST(1 AS DOUBLE) "
        f"ELSE quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) END AS scale FROM imp HAVING count({f}) > 0"
        for f in FEATS])
    out["robust_scale"] = round_sql(
        ctes.rstrip("\n") + ",\n" + fs + ",\n" + sel + f",\nsc AS ({qrows})\n"
        "SELECT sc.feature, sc.center, sc.scale FROM sc JOIN sel ON sel.feature = sc.feature",
        ["center", "scale"])
    del fl
    return out
