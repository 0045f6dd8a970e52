"""Boosting of many folds and parameters in tasks against Spark's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relyframe.operators import boosted as Bo
from relyframe.operators import trees as T

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    d = spark.range(1200).select(F.col("id").alias("row_id"), *[
        ((F.xxhash64("id", F.lit(c)) % 1000) / 1000.0).alias(c) for c in FEATS])
    d = d.withColumn("y", F.sin(3 * F.col("a")) + F.col("b") * F.col("b") + 0.1 * ((F.xxhash64("row_id", F.lit(9)) % 1000) / 1000.0))
    return d.coalesce(2).persist()


def both(frame, points, monkeypatch, **more):
    got = T.search(frame, FEATS, "y", "Gradient Boosting", points, k=3, repeats=1, **more)
    monkeypatch.setattr(Bo, "ROWS", 0)
    return got, T.search(frame, FEATS, "y", "Gradient Boosting", points, k=3, repeats=1, **more)


def test_without_draws_scores_are_those_of_sparks_fits(frame, monkeypatch):
    points = T.grid_points({"maxIter": [4, 9], "stepSize": [0.1, 0.4], "maxDepth": [2, 4], "minInstancesPerNode": [5, 30]})
    got, want = both(frame, points, monkeypatch)
    assert [p for p, _ in got.points] == points and got.fits == want.fits == 24
    assert [s for _, s in got.points] == pytest.approx([s for _, s in want.points], rel=1e-9)
    assert got.params == want.params and got.fitted.getNumTrees == want.fitted.getNumTrees


def test_with_draws_scores_are_near_those_of_sparks_fits(frame, monkeypatch):
    points = [{"maxIter": n, "maxDepth": 3, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.5"} for n in (10, 30)]
    got, want = both(frame, points, monkeypatch)
    assert [s for _, s in got.points] == pytest.approx([s for _, s in want.points], rel=0.15)
    assert [s for _, s in got.points] != [s for _, s in want.points]


def test_scores_depend_on_no_partitioning(frame):
    points = [{"maxIter": 8, "maxDepth": 3, "subsamplingRate": 0.7, "featureSubsetStrategy": "0.8"}]
    one, many = (T.search(d, FEATS, "y", "Gradient Boosting", points, k=3, repeats=1) for d in (frame.coalesce(1), frame.repartition(7)))
    assert one.cv_neg_mse == pytest.approx(many.cv_neg_mse, rel=1e-9)


def test_jobs_are_shared_out_whole():
    shares = Bo._shares([5.0, 1.0, 4.0, 1.0, 1.0], 2)
    assert sorted(i for own in shares for i in own) == list(range(5))
    assert sorted(sum([5.0, 1.0, 4.0, 1.0, 1.0][i] for i in own) for own in shares) == [6.0, 6.0]


def test_constant_targets_and_features(spark):
    d = spark.range(40).select(F.col("id").alias("row_id"), F.lit(1.0).alias("a"), (F.col("id") % 2).cast("double").alias("b"),
                               F.lit(0.0).alias("c"), F.lit(3.0).alias("y"))
    found = T.search(d, FEATS, "y", "Gradient Boosting", [{"maxIter": 5}], k=2, repeats=1)
    assert found.cv_neg_mse == pytest.approx(0.0, abs=1e-20)


def test_which_points_are_taken():
    assert all(Bo.takes(p) for g in (T.TREE_GRIDS["Gradient Boosting"], *T.PRESET_GRIDS.values()) for p in T.grid_points(g))
    assert not Bo.takes({"maxBins": 8}) and not Bo.takes({"featureSubsetStrategy": "sqrt"}) and not Bo.takes({"maxDepth": 30})
    assert Bo._tried("0.8", 7) == 6 and Bo._tried("all", 7) == 7
    assert np.isfinite(Bo.BOOST["stepSize"])
