"""Preparation properties: keep-first dedup, bounds, no NULL after impute,
scaled medians, F score against a direct computation."""
import numpy as np
from pyspark.sql import functions as F

from creditlake.functions import catalog as K
from creditlake.operators import features as FE
from creditlake.operators import prep as PR


def _table(spark, rows):
    """rows: (source_id, TARGET, source_dataset, {feature: value})"""
    data = [(sid, t, s, *[d.get(f) for f in K.ALL_FEATURES]) for sid, t, s, d in rows]
    return spark.createDataFrame(data, K.UNIFIED_SCHEMA)


def test_dedup_first_row_wins(spark):
    df = _table(spark, [
        ("5_LC", 1, K.SOURCE_LC, {"income_total": 1.0}),
        ("10_HC", 0, K.SOURCE_HC, {"income_total": 1.0}),
        ("2_HC", 1, K.SOURCE_HC, {"income_total": 1.0}),
        ("3_GMSC", 0, K.SOURCE_GM, {"income_total": 2.0}),
        ("4_GMSC", None, K.SOURCE_GM, {"income_total": 3.0}),
    ])
    out = {r.source_id: r.TARGET for r in PR.clean(df).collect()}
    assert out == {"2_HC": 1, "3_GMSC": 0}    # numeric id order inside the first source; NULL label dropped


def _plain_first(rows):
    best = {}
    for sid, t, src, d in rows:
        if t is None:
            continue
        head = sid.split("_")[0]
        n = int(head) if head.lstrip("-").isdigit() else None
        rank = (K.SOURCE_ORDER.index(src) if src in K.SOURCE_ORDER else len(K.SOURCE_ORDER), n is None, n or 0, sid)
        key = tuple((k, v) for k, v in sorted(d.items()) if v is not None)
        key = tuple((k, v + 0.0) for k, v in key)
        if key not in best or rank < best[key][0]:
            best[key] = (rank, sid, t)
    return sorted((sid, t) for _, sid, t in best.values())


def _duplicated_rows():
    rng = np.random.default_rng(4)
    names = [K.ALL_FEATURES[0], K.ALL_FEATURES[1], K.ALL_FEATURES[70]]
    rows = []
    for i in range(700):
        d = {f: (None if rng.random() < 0.3 else float(rng.integers(0, 4) * rng.choice([1.0, -1.0]))) for f in names}
        src = rng.choice(K.SOURCE_ORDER)
        rows.append((f"{rng.integers(0, 300)}_{src[:2]}" if i % 9 else f"x{i}_HC", [0, 1, None][i % 3], str(src), d))
    rows += [("05_HC", 1, K.SOURCE_HC, {names[0]: 99.0}), ("5_HC", 0, K.SOURCE_HC, {names[0]: 99.0}), ("7_HC", 0, K.SOURCE_HC, {names[1]: 99.0}),
             ("7_HC", 0, K.SOURCE_HC, {names[1]: 99.0}), ("8_HC", 0, "elsewhere", {names[1]: 99.0}), ("1_HC", 1, K.SOURCE_HC, {names[1]: None, names[0]: -0.0})]
    return rows


def test_dedup_like_a_plain_loop(spark):
    rows = _duplicated_rows()
    got = PR.clean(_table(spark, rows).repartition(5))
    assert sorted((r.source_id, r.TARGET) for r in got.collect()) == _plain_first(rows)
    assert "SortAggregate" not in got._jdf.queryExecution().toString()


def test_dedup_keeps_vectors_that_collide(spark, monkeypatch):
    """All rows under a handful of keys: only equal vectors are duplicates."""
    rows = _duplicated_rows()
    few = lambda rows, feats: rows.select("_uid", F.when(F.col(feats[0]).isNull(), 1).otherwise(2).cast("long").alias("_k1"), F.lit(0).cast("long").alias("_k2"))
    monkeypatch.setattr(PR, "row_keys", few)
    got = PR.clean(_table(spark, rows).repartition(3))
    assert sorted((r.source_id, r.TARGET) for r in got.collect()) == _plain_first(rows)


def test_fit_prep_properties(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        d = {f: None for f in K.ALL_FEATURES}
        d["income_total"] = float(rng.lognormal(10, 1))
        d["credit_amount"] = float(rng.normal()) if i % 3 else None
        d["age_years"] = float(20 + i % 50)
        d["has_checking_account"] = 1.0 if i % 2 else None
        rows.append((f"{i}_HC", int(i % 7 == 0), K.SOURCE_HC, d))
    df = _table(spark, rows)
    pm = PR.fit_prep(PR.clean(df))
    b = {r["feature"]: r for r in pm.bounds}
    assert b["income_total"]["applied"] and not b["has_checking_account"]["applied"]
    fills = {r["feature"]: r for r in pm.fills}
    assert fills["present_residence_since"]["status"] == "empty" and fills["present_residence_since"]["fill_value"] == 0.0
    assert fills["credit_amount"]["status"] == "partial"
    assert len(pm.selected) == min(K.MAX_FEATURES, len(K.ALL_FEATURES))
    assert pm.selected[:2] == ["income_total", "credit_amount"]
    out = pm.transform(PR.clean(df))
    nulls = out.select(*[F.sum(F.col(f).isNull().cast("int")).alias(f) for f in pm.selected]).first()
    assert all(v == 0 for v in nulls)
    med = out.select(F.percentile("income_total", 0.5)).first()[0]
    assert abs(med) < 1e-9
    w = PR.apply_winsor(PR.clean(df), pm.bounds).agg(F.min("income_total"), F.max("income_total")).first()
    assert b["income_total"]["lo"] <= w[0] and w[1] <= b["income_total"]["hi"]


def test_anova_matches_direct(spark):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 300)
    x = rng.normal(size=300) + y * 0.5
    df = spark.createDataFrame([(int(a), float(b), 1.0) for a, b in zip(y, x)], "TARGET int, x double, c double")
    out = {r.feature: r.f_score for r in PR.anova_f(df, ["x", "c"]).collect()}
    groups = [x[y == k] for k in (0, 1)]
    mu = x.mean()
    ssb = sum(len(g) * (g.mean() - mu) ** 2 for g in groups)
    ssw = sum(((g - g.mean()) ** 2).sum() for g in groups)
    f = (ssb / 1) / (ssw / (len(x) - 2))
    assert abs(out["x"] - f) < 1e-9 * max(1, f)
    assert out["c"] is None                          # constant -> undefined


def test_label_codes_alphabetical(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",)], "k string")
    out = sorted((r.k or "<missing>", r.code) for r in FE.label_codes(df, "k", "code").collect())
    assert out == [("<missing>", 2.0), ("a", 0.0), ("b", 1.0), ("b", 1.0)]   # 'nan' sorts after 'b'


def test_exact_quantiles_by_radix_selection(spark):
    rng = np.random.default_rng(5)
    vals = np.concatenate([rng.normal(size=3000), np.zeros(1500), -np.zeros(3), rng.integers(0, 5, 500).astype(float), [1e300, -1e300, 5e-324, -5e-324]])
    near = 1.0 + np.arange(len(vals)) * 2**-52                      # keys that differ in their last bits only
    rows = [(float(v), float(v) * 2 if i % 3 else None, float(n), 7.5, None, i % 11) for i, (v, n) in enumerate(zip(vals, near))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f int").repartition(5)
    from creditlake.operators import profile as P
    probs = (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)
    want = {"a": vals, "b": np.array([r[1] for r in rows if r[1] is not None]), "c": near, "d": np.full(len(vals), 7.5), "f": np.arange(len(vals)) % 11}
    got = {r.feature: r for r in P.quantiles(df, list("abcdef"), probs=probs).collect()}
    assert set(got) == set(want)                                       # no value, no row
    for f, v in want.items():
        for p in probs:
            assert abs(got[f][P._qname(p)] - np.percentile(v, p * 100)) <= 1e-12 * max(1, abs(np.percentile(v, p * 100))), (f, p)


def test_radix_select_integers_of_any_size(spark):
    from creditlake.operators import profile as P
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.integers(-2**63, 2**63 - 1, 2000), np.array([-2**63, 2**63 - 1, 0, -1])])
    df = spark.createDataFrame([(int(x),) for x in v], "k long").repartition(3)
    n, found = P.radix_select(df, ["k"], lambda n: [0, 1, n // 3, n - 1])
    s = np.sort(v)
    assert n == {"k": len(v)} and found == {("k", r): s[r] for r in (0, 1, len(v) // 3, len(v) - 1)}


def test_quantiles_plan_has_no_window_and_few_passes(spark, monkeypatch):
    from creditlake.operators import profile as P
    seen = []
    real = P._top_counts
    monkeypatch.setattr(P, "_top_counts", lambda *a: seen.append(a[2]) or real(*a))
    df = spark.range(3000).select((F.rand(3) * 1e6).alias("x"), (F.col("id") % 3).cast("double").alias("y"))
    P.quantiles(df, ["x", "y"])
    assert len(seen) <= 6


def test_selected_ranks_do_not_depend_on_partitions(spark):
    """Equal features keep the catalogue's order however rows and partitions lie."""
    rng = np.random.default_rng(9)
    feats = [f for f in K.ALL_FEATURES if f not in PR.forced_features(list(K.ALL_FEATURES))][:6]
    rows = []
    for i in range(900):
        x, y = float(rng.normal()), float(rng.normal() * 1e5)
        rows.append((f"{i}_HC", int(x + rng.normal() > 0), K.SOURCE_HC, {feats[0]: y, feats[1]: x / 3, feats[2]: x / 3, feats[3]: x, feats[4]: y / 7, feats[5]: x / 3}))
    ranks = set()
    for k in range(10):
        order = rng.permutation(len(rows))
        df = _table(spark, [rows[j] for j in order]).select("source_id", "TARGET", "source_dataset", *feats).repartition(k + 1)
        ranks.add(tuple((r["rank"], r["feature"]) for r in PR.select_features(df).orderBy("rank").collect()))
    assert len(ranks) == 1


def _odd_values(spark, n=700):
    import random
    from creditlake.functions import catalog as K
    from pyspark.sql import functions as F
    rng = random.Random(5)
    feats = K.ALL_FEATURES[:8]

    def row(i):
        g = rng.gauss(0, 1)
        return (f"{i}_HC", i % 2, K.SOURCE_ORDER[0], g, None if i % 3 else g * 100, None if i % 50 else g, float(i % 4), None if i % 7 else 1.0,
                -1.0 if i < 3 else 0.0, None if i % 2 else float(round(g)), None)
    df = spark.createDataFrame([row(i) for i in range(n)], "source_id string, TARGET int, source_dataset string, " + ", ".join(f"{f} double" for f in feats))
    return df.withColumn("split", F.lit("train")), feats


def test_one_selection_serves_bounds_fills_and_scales(spark, monkeypatch):
    df, feats = _odd_values(spark)
    stats = PR.order_stats(df)
    plain = [r.asDict() for r in PR.winsor_bounds(df).collect()]
    assert [r.asDict() for r in PR.winsor_bounds(df, stats=stats).collect()] == plain
    w = PR.apply_winsor(df, plain)
    rows = lambda x: sorted((r.asDict() for r in x.collect()), key=lambda r: r["feature"])
    fills = rows(PR.impute_params(w))
    assert rows(PR.impute_params(w, stats=stats)) == fills
    assert {r["status"] for r in fills} == {"complete", "partial", "empty"}
    imp = PR.apply_impute(w, fills)
    assert rows(PR.robust_params(imp, feats, stats=stats)) == rows(PR.robust_params(imp, feats))
    from creditlake.operators import prep, profile
    calls = []
    real = profile.radix_select
    for m in (prep, profile):
        monkeypatch.setattr(m, "radix_select", lambda *a, **k: calls.append(1) or real(*a, **k), raising=False)
    pm = PR.fit_prep(df)
    assert len(calls) == 1 and pm.bounds == plain


def test_nan_and_infinite_values_take_the_steps_own_selections(spark):
    from pyspark.sql import functions as F
    df, feats = _odd_values(spark, 200)
    for odd in ("NaN", "Infinity", "-Infinity"):
        x = df.withColumn(feats[0], F.when(F.col("source_id") == "7_HC", F.lit(odd).cast("double")).otherwise(F.col(feats[0])))
        assert PR.order_stats(x) is None
        assert len(PR.fit_prep(x).bounds) == len(feats) - 1
    assert PR.order_stats(df.limit(0)) is None


def test_cleaned_rows_are_written_once(spark, monkeypatch):
    from creditlake.operators import prep
    names = []
    real = prep.cut_lineage
    monkeypatch.setattr(prep, "cut_lineage", lambda df, name="stage": names.append(name) or real(df, name))
    df, _ = _odd_values(spark, 60)
    assert PR.clean(df.drop("split"), written=True).count() and "dedup-kept" not in names
    names.clear()
    twice = df.drop("split").unionByName(df.drop("split"))
    assert PR.clean(twice, written=True).count() == PR.clean(df.drop("split")).count() and "dedup-kept" in names


def test_many_duplicates_are_removed_by_one_aggregate(spark, monkeypatch):
    """Rows are written once numbered and once without duplicates, and nothing else is."""
    from creditlake.operators import prep
    names = []
    real = prep.cut_lineage
    monkeypatch.setattr(prep, "cut_lineage", lambda df, name="stage": names.append(name) or real(df, name))
    rows = _duplicated_rows()
    labelled = _table(spark, rows).repartition(3).filter("TARGET IS NOT NULL")
    got = PR.dedup_keep_first(labelled, few=10)
    assert names == ["dedup-rows", "dedup-kept"] and sorted((r.source_id, r.TARGET) for r in got.collect()) == _plain_first(rows)
    feats = {r.source_id: r.asDict() for r in got.collect()}
    by_id = {sid: d for sid, _, _, d in rows if sid[0] == "x"}
    assert all(feats[sid].get(f) == v for sid, d in by_id.items() if sid in feats for f, v in d.items())
    few = PR.dedup_keep_first(labelled)
    assert few.columns == got.columns and not few.exceptAll(got).count() and not got.exceptAll(few).count()
