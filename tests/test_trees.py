"""Shared fits, stored models, mixed predictors and the benchmark folder."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from relyframe.operators import benchmark as B
from relyframe.operators import mcr as R
from relyframe.operators import trees as T

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    d = spark.range(1200).select(F.col("id").alias("row_id"), *[
        ((F.xxhash64("id", F.lit(c)) % 1000) / 1000.0).alias(c) for c in FEATS])
    d = d.withColumn("y", F.sin(3 * F.col("a")) + F.col("b") * F.col("b") + 0.1 * ((F.xxhash64("row_id", F.lit(9)) % 1000) / 1000.0))
    d = d.coalesce(2).persist()
    d.count()
    return d


def held_out_mse(spark, frame, model, params):
    rows = T.assembled(frame, FEATS, ["row_id", *FEATS, F.col("y").alias("_label")])
    train, held = rows.where("row_id % 5 != 0"), rows.where("row_id % 5 = 0")
    est = T.estimator(model, 42)
    fitted = est.copy({est.getParam(k): v for k, v in params.items()}).fit(train)
    return fitted, held, fitted.transform(held).agg(F.avg(F.pow(F.col("prediction") - F.col("_label"), 2))).first()[0]


def test_grids_have_the_reference_sizes():
    assert {m: len(T.grid_points(g)) for m, g in T.TREE_GRIDS.items()} == {
        "Decision Tree": 12, "Random Forest": 12, "Gradient Boosting": 48}
    fits = {m: len(T.shared_fits(m, T.grid_points(g))) for m, g in T.TREE_GRIDS.items()}
    assert fits == {"Decision Tree": 3, "Random Forest": 2, "Gradient Boosting": 24}
    for m, g in T.GRIDS.items():
        points = T.grid_points(g)
        assert sorted(i for _, own in T.shared_fits(m, points) for i in own) == list(range(len(points)))


def test_cut_trees_equal_separate_fits(spark, frame):
    points = [{"maxDepth": d, "minInstancesPerNode": 5} for d in (1, 3, 6)]
    fitted, held, _ = held_out_mse(spark, frame, "Decision Tree", points[-1])
    got = T._staged_errors(held, T.nodes_of(spark, fitted), FEATS, points, [0, 1, 2])
    for i, p in enumerate(points):
        assert got[i] == pytest.approx(held_out_mse(spark, frame, "Decision Tree", p)[2], rel=1e-12)


def test_cut_forests_equal_separate_fits_and_prefixes_are_means_of_trees(spark, frame):
    points = [{"numTrees": n, "maxDepth": d} for n in (7, 12) for d in (2, 4)]
    fitted, held, whole = held_out_mse(spark, frame, "Random Forest", {"numTrees": 12, "maxDepth": 4})
    got = T._staged_errors(held, T.nodes_of(spark, fitted), FEATS, points, [0, 1, 2, 3])
    assert got[3] == pytest.approx(whole, rel=1e-12)
    assert got[2] == pytest.approx(held_out_mse(spark, frame, "Random Forest", {"numTrees": 12, "maxDepth": 2})[2], rel=1e-12)
    first = [t.transform(held).select("row_id", "prediction", "_label") for t in fitted.trees[:7]]
    total = first[0]
    for t in first[1:]:
        total = total.unionByName(t)
    mean = total.groupBy("row_id").agg(F.avg("prediction").alias("p"), F.first("_label").alias("y"))
    assert got[1] == pytest.approx(mean.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2))).first()[0], rel=1e-12)


def test_boosting_prefix_equals_a_separate_fit(spark, frame):
    own = {"maxDepth": 2, "subsamplingRate": 0.8, "stepSize": 0.1}
    fitted, held, _ = held_out_mse(spark, frame, "Gradient Boosting", {**own, "maxIter": 12})
    losses = fitted.evaluateEachIteration(held, "squared")
    assert losses[4] == pytest.approx(held_out_mse(spark, frame, "Gradient Boosting", {**own, "maxIter": 5})[2], rel=1e-9)


def test_search_equals_plain_cross_validation(spark, frame):
    grid = [{"maxDepth": d, "minInstancesPerNode": m} for d in (2, 4) for m in (2, 40)]
    found = T.search(frame, FEATS, "y", "Decision Tree", grid, k=3, repeats=2)
    assert found.fits == 2 * 3 * 2
    from relyframe.functions.hashing import uniform
    rows = T.assembled(frame, FEATS, ["row_id", *FEATS, F.col("y").alias("_label")])
    for params, score in found.points:
        est = T.estimator("Decision Tree", 42)
        each = []
        for r in range(2):
            d = rows.withColumn("f", F.floor(uniform(42, f"fold{r}", F.col("row_id")) * 3))
            for f in range(3):
                m = est.copy({est.getParam(k): v for k, v in params.items()}).fit(d.where(F.col("f") != f))
                each.append(m.transform(d.where(F.col("f") == f)).agg(F.avg(F.pow(F.col("prediction") - F.col("_label"), 2))).first()[0])
        assert score == pytest.approx(-np.mean(each), rel=1e-10)
    assert found.cv_neg_mse == max(s for _, s in found.points)


SMALL = {"Decision Tree": [{"maxDepth": 3}], "Random Forest": [{"numTrees": 5, "maxDepth": 3}],
         "Gradient Boosting": [{"maxIter": 3, "maxDepth": 2}]}


def setup_of(frame):
    return B.Setup(frame.where("row_id % 5 != 0"), frame.where("row_id % 5 = 0"), "y", "y", folds=2, repeats=1, grids=dict(SMALL))


def test_failures_are_entered_and_a_second_run_goes_on(spark, frame, tmp_path):
    at = str(tmp_path / "bench")
    models = ["Ridge", "Decision Tree", "No Such Model"]
    with warnings.catch_warnings(record=True) as told:
        warnings.simplefilter("always")
        out = {(r.model, r.feature_set): r for r in B.run(setup_of(frame), {"all": FEATS, "gone": ["zzz"]}, models, at).collect()}
    assert len(out) == 6 and sum("failed" in str(w.message) for w in told) == 4
    assert out["Ridge", "all"].error is None and out["Decision Tree", "all"].test_r2 > 0.5
    assert "no estimator" in out["No Such Model", "all"].error and out["Ridge", "gone"].loss is None
    asked, before = [], B._tree
    B._tree = lambda setup, model, *a: asked.append(model) or before(setup, model, *a)
    try:
        again = B.run(setup_of(frame), {"all": FEATS}, [*models, "Random Forest"], at)
    finally:
        B._tree = before
    assert asked == ["No Such Model", "Random Forest"]
    assert again.count() == 7 and again.where("error is null").count() == 3


def test_stored_models_predict_alike_and_missing_ones_are_skipped(spark, frame, tmp_path):
    at = str(tmp_path / "bench")
    out = B.run(setup_of(frame), {"all": FEATS, "two": ["a", "b"]}, ["Linear Regression", *SMALL], at)
    extra = spark.createDataFrame([("Ridge", "all")], "model string, feature_set string")
    with pytest.warns(UserWarning, match="no stored model"):
        linear, trees = B.load_models(out.select("model", "feature_set").unionByName(extra), at)
    assert len(linear) == 2 and len(trees) == 6
    test = setup_of(frame).test.select("row_id", "y", *FEATS)
    scored = B.scores(B.mixed_models(linear, trees)(test), "y", ["model", "feature_set"]).collect()
    want = {(r.model, r.feature_set): r.loss for r in out.collect()}
    assert {(r.model, r.feature_set) for r in scored} == set(want)
    for r in scored:
        assert r.loss == pytest.approx(want[r.model, r.feature_set], rel=1e-9)
    losses = R.permutation_losses(test, FEATS, "y", B.mixed_models(linear, trees, moved="_feature"), 42, 1,
                                  keys=["model", "feature_set"])
    got = {(r.model, r.feature_set, r.feature) for r in losses.collect()}
    assert got == {(m, s, f) for m, s in want for f in (FEATS if s == "all" else ["a", "b"])}
    mr = R.model_reliance(out.select("model", "feature_set", "loss"), losses)
    by = {r.feature: r.mcr_max for r in R.mcr_intervals(mr).collect()}
    assert by["a"] > by["c"] - 1e-9 and by["b"] > 1
