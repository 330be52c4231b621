"""Profile keys at bin edges and the one-pass default-rate table."""
from creditlake.functions import catalog as K
from creditlake.operators import profile as P


def _u(spark, rows):
    data = []
    for i, (t, age, late) in enumerate(rows):
        d = {f: None for f in K.ALL_FEATURES}
        d["age_years"], d["inst_late_payment_rate"] = age, late
        data.append((f"{i}_HC", t, K.SOURCE_HC, *[d[f] for f in K.ALL_FEATURES]))
    return spark.createDataFrame(data, K.UNIFIED_SCHEMA)


def test_default_rate_edges(spark):
    u = _u(spark, [(1, 25.0, 0.0), (0, 25.1, 0.05), (0, None, 0.7), (1, 64.0, None)])
    r = {(x.dimension, x.key): (x.n_rows, x.default_rate) for x in P.default_rate_by_key(u).collect()}
    assert r[("age_group", "<25")] == (1, 1.0)            # right-closed: 25 is in (0, 25]
    assert r[("age_group", "25-35")] == (1, 0.0)
    assert r[("late_bucket", "0-5%")] == (2, 0.5)          # a rate of exactly 0 counts in the first bucket
    assert r[("late_bucket", "30-50%")] == (1, 0.0)        # 0.7 clipped to 0.5
    assert r[("source_dataset", K.SOURCE_HC)] == (4, 0.5)
    assert not any(d == "employed_flag" for d, _ in r)     # all-missing key: no groups
    strict = {(x.dimension, x.key): x.n_rows for x in P.default_rate_by_key(u, include_zero_late=False).collect()}
    assert strict[("late_bucket", "0-5%")] == 1           # source behaviour: 0 falls in no bucket


def test_missing_rates_status(spark):
    u = _u(spark, [(1, 25.0, 0.0), (0, None, 0.1)])
    r = {x.feature: x for x in P.missing_rates(u).collect()}
    assert r["age_years"].status == "partial" and r["age_years"].missing_rate == 0.5
    assert r["inst_late_payment_rate"].status == "complete" and r["income_total"].status == "empty"
    top = [x.feature for x in P.top_missing(u, 3).collect()]
    assert top == K.ALL_FEATURES[:3]                         # ties in catalogue order
