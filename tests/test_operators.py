"""Property tests and hand fixtures (FIXTURES.md parts C and D)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sample_tables import SF, SF01


def test_to_numeric_fixture(spark):
    from relyframe.functions.missing import to_numeric
    vals = ["1d", "1.5f", " 12 ", "1e3", "inf", "", "#NAME?", "1_000", "True"]
    rows = spark.createDataFrame([(v,) for v in vals], "s string").select(to_numeric(F.col("s")).alias("x")).collect()
    got = [r["x"] for r in rows]
    assert got[:4] == [None, None, 12.0, 1000.0]
    assert got[4] == math.inf and got[5:] == [None, None, None, None]


def test_exact_median_and_average_rank(spark):
    from relyframe.operators.encode import exact_median
    from relyframe.operators.stats import average_rank
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 10])], "row_id long, a double")
    assert exact_median(df, ["a"])["a"] == 2.5
    vals = [1, 1, 2, 3, 3, 3, 5, 8]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(vals)], "row_id long, a double")
    r = {x["row_id"]: x["a"] for x in average_rank(df, ["a"]).collect()}
    assert [r[i] for i in range(8)] == [1.5, 1.5, 3, 5, 5, 5, 7, 8]


def test_spearman_fixture_and_constant(spark):
    from relyframe.operators.stats import spearman_matrix
    a = [1, 1, 2, 3, 3, 3, 5, 8]
    b = [2, 1, 1, 4, 4, 6, 6, 6]
    df = spark.createDataFrame([(i, float(x), float(y), 1.0) for i, (x, y) in enumerate(zip(a, b))],
                               "row_id long, a double, b double, c double")
    m = spearman_matrix(df, ["a", "b", "c"])
    assert abs(m[0, 1] - 0.8726291662545538) < 1e-12
    assert m[0, 2] == 0.0 and m[2, 2] == 0.0


def test_population_std_scaling(spark):
    from relyframe.operators.encode import fit_standardizer
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 2, 3, 3, 3, 5, 8]], "a double")
    assert abs(fit_standardizer(df, ["a"])["a"][1] - 2.165063509461097) < 1e-12


def test_ordinal_unknown(spark):
    from relyframe.operators.encode import encode_ordinal, fit_categories
    codes = fit_categories(spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "v string"), ["v"])
    df = spark.createDataFrame([(0, "z"), (1, "a"), (2, None), (3, "c")], "i int, v string")
    got = [r["v"] for r in encode_ordinal(df, {"v": (F.col("v"), "v")}, codes).orderBy("i").collect()]
    assert got == [-1.0, 0.0, -1.0, 2.0]


def test_two_hundred_thousand_categories(spark):
    from relyframe.operators.encode import label_encode
    n = 200_000
    df = spark.range(n).select("id", F.format_string("k%06d", F.col("id") * 7919 % n).alias("v"))
    out = label_encode(df, ["v"])
    assert out.agg(F.count_distinct("v"), F.min("v"), F.max("v")).first() == (n, 0.0, n - 1.0)
    assert out.where(F.col("v") != F.col("id") * 7919 % n).count() == 0


def test_stratified_split_counts(spark):
    from relyframe.plans.q_split import split_frame
    sp = split_frame(spark, SF01)
    c = {r["split"]: r["count"] for r in sp.groupBy("split").count().collect()}
    assert c == {"train": 11768, "test": 2943}
    # train and test are disjoint, every class keeps >= 1 row in each side
    assert sp.select("row_id").distinct().count() == 14711


def test_split_partition_invariance(spark):
    from relyframe.operators.split import stratified_split
    from relyframe.plans.frame import standard_frame
    ff = standard_frame(spark, SF).where("sum_qty is not null")
    a = {r["row_id"]: r["split"] for r in stratified_split(ff.repartition(1), "n_items").collect()}
    b = {r["row_id"]: r["split"] for r in stratified_split(ff.repartition(13), "n_items").collect()}
    assert a == b


def test_boxcox_roundtrip_and_llf_optimum(spark):
    from relyframe.functions.boxcox import boxcox, inv_boxcox
    from relyframe.operators.encode import boxcox_llf, fit_boxcox
    from relyframe.plans.frame import standard_frame
    ff = standard_frame(spark, SF).where("sum_qty is not null")
    lam, off = fit_boxcox(ff, "c_acctbal")
    assert off > 0
    back = ff.select((inv_boxcox(boxcox(F.col("c_acctbal"), lam, off), lam, off) - F.col("c_acctbal")).alias("d"))
    assert back.agg(F.max(F.abs("d"))).first()[0] < 1e-6
    best = boxcox_llf(ff, "c_acctbal", lam, off)
    for d in (-1e-3, 1e-3):
        assert best >= boxcox_llf(ff, "c_acctbal", lam + d, off) - 1e-9


def test_permutation_preserves_multiset(spark):
    from relyframe.operators.mcr import permute_column
    from relyframe.plans.frame import standard_frame
    ff = standard_frame(spark, SF).select("row_id", "o_totalprice")
    p = permute_column(ff, "o_totalprice", 42)
    assert sorted(r[0] for r in p.select("o_totalprice").collect()) == sorted(r[0] for r in ff.select("o_totalprice").collect())
    assert p.count() == ff.count()


def test_mcr_classes_and_rashomon(spark):
    from relyframe.operators.mcr import classify_reliance, rashomon_set
    m = spark.createDataFrame([("a", 1.2, 1.3), ("b", 1.0, 1.1), ("c", 0.9, 1.0)], "feature string, mcr_min double, mcr_max double")
    assert {r["feature"]: r["class"] for r in classify_reliance(m).collect()} == {"a": "necessary", "b": "neither", "c": "redundant"}
    res = spark.createDataFrame([("m1", 0.50, 1.0), ("m2", 0.495, 1.0), ("m3", 0.489, 1.0)], "model string, test_r2 double, test_rmse double")
    assert sorted(r["model"] for r in rashomon_set(res).collect()) == ["m1", "m2"]


def test_reanchoring(spark):
    from relyframe.operators.fragility import category_probs
    df = spark.createDataFrame([(0.9, 0.5, 0.6, 0.2)], "f1 double, f2 double, f3 double, f4 double")
    ps = df.select(*[p.alias(f"p{i}") for i, p in enumerate(category_probs([F.col(f"f{i}") for i in range(1, 5)]))]).first()
    assert [round(ps[f"p{i}"], 12) for i in range(5)] == [0.1, 0.4, 0.0, 0.3, 0.2]


GOLDEN = {("t6", "EF0"): [0.233950, 0.549831, 0.214291, 0.000000, 0.001928],
          ("t13", "EF2"): [0.000000, 0.002034, 0.139637, 0.632523, 0.225806],
          ("t19", "EF4"): [0.000000, 0.000000, 0.000017, 0.091151, 0.908832]}


def test_pmf_golden(spark):
    from relyframe.operators.fragility import curve_params, ef_bounds, expected_category_pmf
    b = ef_bounds()
    assets = spark.createDataFrame([(i, c, l, *b[l]) for i, (c, l) in enumerate(GOLDEN)], "asset_id long, curve_id string, ef string, lo double, hi double")
    out = expected_category_pmf(assets, curve_params(spark)).collect()
    for r in out:
        want = GOLDEN[(r["curve_id"], r["ef"])]
        got = [r[f"ds{i}"] for i in range(5)]
        assert abs(sum(got) - 1.0) < 1e-9
        assert max(abs(g - w) for g, w in zip(got, want)) < 1.5e-6


def test_linkage_complete_diameter_and_silhouette():
    from relyframe.operators.linkage import cluster_cut, silhouette
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    t = 1.5
    lab = cluster_cut(d, "complete", t)
    for l in set(lab):
        idx = np.where(lab == l)[0]
        assert d[np.ix_(idx, idx)].max() <= t + 1e-12
    s = silhouette(d, lab)
    assert -1.0 <= s <= 1.0


def test_gram_linear_matches_lstsq(spark):
    from relyframe.operators.models import fold_grams, solve_linear
    from relyframe.plans.frame import standard_frame
    ff = standard_frame(spark, SF).where("sum_qty is not null")
    feats = ["o_totalprice", "c_acctbal", "n_items"]
    folds = fold_grams(ff, feats, "sum_qty", 5, 1)
    coef = solve_linear(sum(folds.by_fold.values()), "Linear Regression", {})
    coef[0] += folds.shift[-1] - folds.shift[:-1] @ coef[1:]
    pdf = ff.select(*feats, "sum_qty").toPandas()
    X = np.column_stack([np.ones(len(pdf)), pdf[feats].to_numpy(float)])
    ref = np.linalg.lstsq(X, pdf["sum_qty"].to_numpy(float), rcond=None)[0]
    assert np.allclose(coef, ref, rtol=1e-6, atol=1e-8)


def _psi(v):
    return sum(1.0 / i for i in range(1, int(v))) - 0.5772156649015329


def test_ross_mi_matches_brute_force(spark):
    from relyframe.functions.hashing import uniform
    from relyframe.operators import mi as M
    from relyframe.plans.frame import standard_frame
    ff = standard_frame(spark, SF).where("sum_qty is not null")
    res = {r["feature"]: r["mi"] for r in M.mi_scores(ff, ["n_items"], "sum_qty", 1, 42, discrete={"n_items": True}).collect()}
    pdf = ff.select("row_id", "n_items", "sum_qty").toPandas()
    y = pdf.sum_qty.to_numpy(float)
    amp = M.noise_amplitude(y.std(), np.abs(y).mean())
    u = spark.createDataFrame(pdf[["row_id"]]).select("row_id", uniform(42, "mi_y", F.lit(0), F.col("row_id")).alias("u")).toPandas().set_index("row_id").loc[pdf.row_id].u.to_numpy()
    y = y + amp * (u - 0.5)
    lab = pdf.n_items.to_numpy()
    r = np.zeros(len(y)); kk = np.zeros(len(y)); lc = np.zeros(len(y))
    for l in np.unique(lab):
        m = lab == l; c = m.sum(); lc[m] = c
        if c > 1:
            k = min(3, c - 1); yy = y[m]
            dd = np.abs(yy[:, None] - yy[None]); np.fill_diagonal(dd, np.inf)
            r[m] = np.sort(dd, axis=1)[:, k - 1]; kk[m] = k
    keep = lc > 1
    cnt = (np.abs(y[keep][None] - y[keep][:, None]) < r[keep][:, None]).sum(1)
    want = max(0.0, _psi(keep.sum()) + np.mean([_psi(v) for v in kk[keep]]) - np.mean([_psi(v) for v in lc[keep]])
               - np.mean([_psi(v) for v in cnt]))
    assert abs(res["n_items"] - want) < 1e-9


def test_ksg_mi_matches_brute_force(spark):
    from relyframe.functions.hashing import uniform
    from relyframe.operators import mi as M
    from relyframe.plans.frame import standard_frame
    ff = standard_frame(spark, SF).where("sum_qty is not null")
    got = M.mi_scores(ff, ["o_totalprice"], "sum_qty", 1, 42, discrete={"o_totalprice": False}).first()["mi"]
    pdf = ff.select("row_id", "o_totalprice", "sum_qty").toPandas()
    ids = spark.createDataFrame(pdf[["row_id"]])
    u = ids.select("row_id", uniform(42, "mi_y", F.lit(0), F.col("row_id")).alias("uy"),
                   uniform(42, "mi_x", F.lit("o_totalprice"), F.lit(0), F.col("row_id")).alias("ux")) \
        .toPandas().set_index("row_id").loc[pdf.row_id]
    x = pdf.o_totalprice.to_numpy(float); y = pdf.sum_qty.to_numpy(float)
    x = x / x.std(); y = y / y.std()
    x = x + 1e-10 * max(1.0, np.abs(x).mean()) * (u.ux.to_numpy() - 0.5)
    y = y + 1e-10 * max(1.0, np.abs(y).mean()) * (u.uy.to_numpy() - 0.5)
    d = np.maximum(np.abs(x[:, None] - x[None]), np.abs(y[:, None] - y[None])); np.fill_diagonal(d, np.inf)
    r = np.sort(d, axis=1)[:, 2]
    nx = (np.abs(x[:, None] - x[None]) < r[:, None]).sum(1) - 1
    ny = (np.abs(y[:, None] - y[None]) < r[:, None]).sum(1) - 1
    want = max(0.0, _psi(len(x)) + _psi(3) - np.mean([_psi(v + 1) for v in nx]) - np.mean([_psi(v + 1) for v in ny]))
    assert abs(got - want) < 1e-9


def test_sf001_fixture_values(spark):
    from relyframe.operators.assoc import cramers_v
    from relyframe.operators.stats import spearman_matrix
    from relyframe.sources import load
    o = load(spark, SF01, "orders")
    chi2 = {(a, b): c for a, b, c, _ in cramers_v(o, ["o_orderstatus", "o_orderpriority"])}
    assert abs(chi2[("o_orderstatus", "o_orderpriority")] - 3.931597) < 1e-6
    d = o.select(F.col("o_orderkey").alias("row_id"), "o_totalprice",
                 F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("double").alias("o_orderdate"))
    assert abs(spearman_matrix(d, ["o_totalprice", "o_orderdate"])[0, 1] - 0.010991) < 5e-7


def test_range_positions_are_spread_and_exact(spark):
    """At default settings rows of one hot value don't meet in one partition, and positions are exact."""
    from relyframe.operators.ordered import exact_position, sorted_neighbors
    df = spark.range(4000).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 == 0, F.col("id") * 1.0).otherwise(5.0).alias("v"),
                                  F.when(F.col("id") % 3 > 0, F.lit("g")).alias("g"))
    for groups in ([], ["g"]):
        out = exact_position(df, groups, ["v", "row_id"])
        rows = out.collect()
        for key in {tuple(r[c] for c in groups) for r in rows}:
            own = sorted((r["v"], r["row_id"], r["_pos"], r["_n"]) for r in rows if tuple(r[c] for c in groups) == key)
            assert [x[2] for x in own] == list(range(len(own))) and {x[3] for x in own} == {len(own)}
    cut = df.repartitionByRange(8, "v", "row_id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert cut < 1500
    nb = {r["row_id"]: r for r in sorted_neighbors(df, [], ["v", "row_id"], "row_id", 2, block_rows=100).collect()}
    order = [r["row_id"] for r in df.orderBy("v", "row_id").collect()]
    for i in (0, 1, 99, 100, 101, 2500, 3999):
        r = nb[order[i]]
        assert [r["_nb_p1"], r["_nb_n1"], r["_nb_n2"]] == [order[i - 1] if i else None, *(
            order[i + j] if i + j < 4000 else None for j in (1, 2))]


def test_scans_are_pruned(spark):
    from relyframe.plans.frame import standard_frame
    scan = standard_frame(spark, SF).select("row_id", "o_totalprice")._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" in scan and "o_orderstatus" not in scan and "l_extendedprice" not in scan


def test_split_keeps_rows_without_a_target_and_uses_exact_quotas(spark):
    from relyframe.operators.split import stratified_split
    df = spark.range(40).select(F.col("id").alias("row_id"), F.when(F.col("id") % 5 > 0, (F.col("id") % 4) * 1e14).alias("y"))
    out = stratified_split(df, "y")
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 32, "test": 8}


def test_group_folds(spark):
    from relyframe.operators.split import assign_group_folds
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 > 0, F.floor(F.sqrt("id"))).alias("g"))
    out, k = assign_group_folds(spark, df, "g", 5)
    assert k == 5 and out.count() == 1000
    assert out.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    sizes = [r["count"] for r in out.groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1000 / 5


def test_spatial_groups_keep_rows_without_coordinates(spark):
    from relyframe.operators.split import nearest_centre, spatial_groups
    df = spark.range(40).select("id", F.when(F.col("id") % 5 > 0, F.col("id") * 1.0).alias("a"), (F.col("id") % 7 * 1.0).alias("b"))
    out = spatial_groups(df, ["a", "b"], 3)
    assert out.count() == 40 and out.where("spatial_group is null").count() == 8
    near = {r["id"]: r["spatial_group"] for r in nearest_centre(df, ["a", "b"], [[0.0, 0.0], [30.0, 0.0]]).collect()}
    assert near[1] == 0 and near[39] == 1 and near[5] is None


def test_boxcox_lambda_beyond_ten(spark):
    from relyframe.operators.encode import boxcox_llf, fit_boxcox
    df = spark.range(2000).select((100.0 + 3.0 * F.pow((F.col("id") + 0.5) / 2000.0, 0.2)).alias("x"))
    lam, off = fit_boxcox(df, "x")
    assert off == 0 and abs(lam) > 10
    best = boxcox_llf(df, "x", lam, off)
    assert best >= boxcox_llf(df, "x", 5.26, off) and all(best >= boxcox_llf(df, "x", lam + d, off) - 1e-6 for d in (-0.5, 0.5))


def test_gram_keeps_its_precision_far_from_zero(spark):
    from relyframe.operators.models import cv_linear, fold_grams
    df = spark.range(500).select(F.col("id").alias("row_id"), (1e9 + F.col("id") / 500.0).alias("x"))
    df = df.withColumn("y", 2 * F.col("x")).unionByName(spark.createDataFrame([(999, None, 1.0)], "row_id long, x double, y double"))
    res = cv_linear(fold_grams(df, ["x"], "y", 5, 2), "Linear Regression")
    assert abs(res.coef[1] - 2) < 1e-5


def test_grams_of_given_folds(spark):
    from relyframe.operators.models import fold_grams
    df = spark.range(90).select(F.col("id").alias("row_id"), (F.col("id") * 1.0).alias("x"), (F.col("id") % 7 * 1.0).alias("y"),
                                (F.col("id") % 3).cast("int").alias("fold"))
    g = fold_grams(df, ["x"], "y", 3, fold_col="fold")
    assert {k: v[0, 0] for k, v in g.by_fold.items()} == {(0, f): 30.0 for f in range(3)}


def test_coordinate_descent_meets_its_conditions():
    from relyframe.operators.models import solve_linear
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 6)) @ r.normal(size=(6, 6))
    y = x[:, 0] * 2 - x[:, 3] + r.normal(size=400)
    z = np.column_stack([np.ones(400), x, y])
    for model, p in (("Lasso", {"alpha": 0.3}), ("ElasticNet", {"alpha": 0.4, "l1_ratio": 0.8})):
        b = solve_linear(z.T @ z, model, p)
        l1 = p.get("l1_ratio", 1.0)
        grad = x.T @ (y - b[0] - x @ b[1:]) / 400 - p["alpha"] * (1 - l1) * b[1:]
        on = b[1:] != 0
        assert np.allclose(grad[on], p["alpha"] * l1 * np.sign(b[1:][on]), atol=1e-5)
        assert (np.abs(grad[~on]) <= p["alpha"] * l1 + 1e-5).all()


@pytest.mark.parametrize("method", ["single", "average", "ward"])
def test_linkage_heights_equal_a_naive_version(method):
    from relyframe.operators.linkage import linkage
    x = np.random.default_rng(3).normal(size=(11, 4))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))

    def gap(a, b):
        pair = d[np.ix_(a, b)]
        if method == "ward":
            na, nb = len(a), len(b)
            return math.sqrt(2 * na * nb / (na + nb)) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))
        return pair.min() if method == "single" else pair.mean()

    groups, want = [[i] for i in range(11)], []
    while len(groups) > 1:
        h, i, j = min((gap(groups[i], groups[j]), i, j) for i in range(len(groups)) for j in range(i))
        want.append(h)
        groups = [g for k, g in enumerate(groups) if k not in (i, j)] + [groups[i] + groups[j]]
    assert np.allclose(linkage(d, method)[:, 2], want)


def test_no_threshold_keeps_all_columns(spark):
    from relyframe.operators import select as K
    for fn in (K.select_by_spearman, K.select_by_association, K.select_by_ward, K.select_by_rank_ward):
        assert fn(None, ["b", "a"], None).selected == ["a", "b"]


def test_silhouette_value():
    from relyframe.operators.linkage import silhouette
    d = np.abs(np.subtract.outer([0.0, 1.0, 10.0, 12.0], [0.0, 1.0, 10.0, 12.0]))
    want = np.mean([(11 - 1) / 11, (10 - 1) / 10, (9.5 - 2) / 9.5, (11.5 - 2) / 11.5])
    assert abs(silhouette(d, np.array([1, 1, 2, 2])) - want) < 1e-12


def test_small_faults_stay_mended(spark, tmp_path):
    from relyframe.operators.encode import Preprocessor, onehot_exprs
    from relyframe.operators.mcr import model_reliance, regression_metrics
    from relyframe.sources import load_boxcox_params, read_table, write_table
    df = spark.createDataFrame([(1, "café", 2.0), (2, 'a "b"', 2.0)], "i int, s string, y double")
    back = read_table(spark, write_table(df, str(tmp_path / "t"), "csv"), "csv", schema="i int, s string, y double")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert load_boxcox_params(spark, str(tmp_path / "none")) == (1.0, 0.0)
    m = regression_metrics(df.withColumn("p", F.col("i") * 1.0), "y", "p").first()
    assert m["r2"] is None and m["mae"] == 0.5
    x = spark.createDataFrame([(None,)], "v string").select(*onehot_exprs("v", F.col("v"), ["a", "b"])).first()
    assert tuple(x) == (0.0, 0.0)
    with pytest.raises(TypeError):
        Preprocessor().fit(df.withColumn("t", F.current_timestamp()), ["y", "t"])
    base = spark.createDataFrame([("m", "s", 0.0), ("n", "s", 2.0)], "model string, feature_set string, loss double")
    perm = spark.createDataFrame([("m", "s", "f", 1.0), ("n", "s", "f", 3.0)], "model string, feature_set string, feature string, loss double")
    assert [tuple(r) for r in model_reliance(base, perm).collect()] == [("n", "s", "f", 1.5)]


def test_large_nominal_pair(spark):
    from relyframe.operators.assoc import cramers_v
    df = spark.range(100_000).select(F.col("id").cast("string").alias("a"), (F.col("id") % 3).cast("string").alias("b"))
    (_, _, chi2, _), = cramers_v(df, ["a", "b"])
    assert abs(chi2 - 200_000) < 1e-3  # a determines b: chi2 = n * (k - 1)


def test_knn_radius():
    from relyframe.operators.mi import knn_radius
    r = np.random.default_rng(0)
    x = np.sort(np.round(r.normal(size=300), 1) + 1e-9 * r.random(300))
    y = np.round(r.normal(size=300), 1) + 1e-9 * r.random(300)
    d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
    np.fill_diagonal(d, np.inf)
    assert np.allclose(knn_radius(x, y, 3), np.sort(d, axis=1)[:, 2], rtol=0, atol=0)
    assert np.isinf(knn_radius(x[:3], y[:3], 3)).all()


def test_mi_over_cut_groups_equals_one_partition(spark):
    """Groups that lie in several partitions give the scores of groups that don't."""
    from relyframe.operators import mi as M
    from relyframe.plans.frame import standard_frame
    ff = standard_frame(spark, SF).where("sum_qty is not null").persist()
    got = []
    for parts in ("1", "13"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            rows = M.mi_scores(ff, ["n_items", "o_totalprice"], "sum_qty", 2, 42,
                               discrete={"n_items": True, "o_totalprice": False}).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        got.append({r["feature"]: r["mi"] for r in rows})
    assert got[0].keys() == got[1].keys() and all(abs(got[0][f] - got[1][f]) < 1e-12 for f in got[0])


def test_knn_distances_on_lines_take_few_steps():
    """Points on lines of y, where the gap in x alone stays small for a third of all points: searched strip by strip."""
    import time
    from relyframe.operators import mi as M
    r = np.random.default_rng(0)
    n = 150_000
    y = np.round(r.gamma(4, 25, n)) / 85 + 1e-10 * r.random(n)
    x = np.sort(r.normal(size=n))
    begin = time.process_time()
    got = M.knn_distances(x, y, 3)
    assert time.process_time() - begin < 10  # 0.6 s; place by place it was 30 s and more
    for i in r.integers(0, n, 200):
        d = np.maximum(np.abs(x - x[i]), np.abs(y - y[i]))
        d[i] = np.inf
        assert np.array_equal(got[i], np.sort(np.partition(d, 3)[:3]))


def test_ksg_over_partitions_matches_brute_force(spark):
    """Groups that lie in many partitions, with ties and far points: neighbours and counts come from other partitions too."""
    from relyframe.operators import mi as M
    r = np.random.default_rng(3)
    n = 700
    x = np.round(r.normal(size=n) * 4) / 4 + 1e-10 * r.random(n)
    y = np.round(r.normal(size=n) * 6) / 6 + 1e-10 * r.random(n)
    x[:3], y[:3] = (50, -60, 70), (40, 0, -30)
    pdf = pd.DataFrame({"feature": 0, "rep": np.repeat([0, 1], [n, 2]).astype("int32"), "row_id": np.arange(n + 2),
                        "x": [*x, 0.0, 1.0], "y": [*y, 0.0, 1.0]}).astype({"feature": "int32"})
    d = np.maximum(np.abs(x[:, None] - x), np.abs(y[:, None] - y))
    np.fill_diagonal(d, np.inf)
    rad = np.sort(d, axis=1)[:, 2]
    nx, ny = ((np.abs(v[:, None] - v) < rad[:, None] - M.ULP_SLACK * np.maximum(np.abs(v), rad)[:, None]).sum(1) for v in (x, y))
    want = max(0.0, _psi(n) + _psi(3) - np.mean([_psi(v) for v in nx]) - np.mean([_psi(v) for v in ny]))
    for unique in (True, False):
        got = {r["rep"]: r["mi"] for r in M.ksg_mi(spark.createDataFrame(pdf), 3, unique).collect()}
        assert list(got) == [0]  # two points have no third neighbour
        assert abs(got[0] - want) < 1e-9
