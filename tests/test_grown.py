"""Trees grown side by side against Spark's own, fold by fold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relyframe.operators import grown as G
from relyframe.operators import trees as T

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    d = spark.range(900).select(
        F.col("id").alias("row_id"), ((F.xxhash64("id", F.lit("a")) % 1000) / 1000.0).alias("a"),
        (F.xxhash64("id", F.lit("b")) % 5).cast("double").alias("b"), F.lit(2.0).alias("c"))
    d = d.withColumn("y", F.sin(3 * F.col("a")) + F.col("b") * F.col("b") + (F.xxhash64("row_id", F.lit(9)) % 1000) / 5000.0)
    d = d.coalesce(1).persist()
    d.count()
    return d


def test_a_search_of_single_trees_equals_fits_by_fold_and_makes_none_but_the_last(spark, frame, monkeypatch):
    points = [{"maxDepth": d, "minInstancesPerNode": n} for d in (2, 5) for n in (1, 12)]
    estimator, fitted = T.estimator, []

    def counted(model, seed):
        est = estimator(model, seed)
        plain = type(est).fit
        monkeypatch.setattr(type(est), "fit", lambda *a, **o: fitted.append(1) or plain(*a, **o))
        return est

    monkeypatch.setattr(T, "estimator", counted)
    got = T.search(frame, FEATS, "y", "Decision Tree", points, k=3, repeats=2)
    assert len(fitted) == 1 and got.fits == 12
    monkeypatch.undo()
    monkeypatch.setattr(G, "MAX_DEPTH", 0)  # a fit for each fold
    want = T.search(frame, FEATS, "y", "Decision Tree", points, k=3, repeats=2)
    assert got.params == want.params
    assert [s for _, s in got.points] == pytest.approx([s for _, s in want.points], rel=1e-9)


def test_sums_do_not_depend_on_partitions_and_more_rows_than_thresholds_are_found_on_all_count(spark, frame, monkeypatch):
    monkeypatch.setattr(G, "CHUNK", 50)
    points = [{"maxDepth": 3, "minInstancesPerNode": 2}]
    one = T.search(frame, FEATS, "y", "Decision Tree", points, k=3, repeats=1)
    monkeypatch.setattr(T, "TASK_ROWS", 100)
    many = T.search(frame.repartition(7), FEATS, "y", "Decision Tree", points, k=3, repeats=1)
    assert many.cv_neg_mse == pytest.approx(one.cv_neg_mse, rel=1e-9)
    d = frame.select(*FEATS, F.col("y").alias("_label"), (F.col("row_id") % 3).cast("int").alias("_fold0"))
    monkeypatch.setattr(G, "BINS", 4)
    monkeypatch.setattr(G, "BIN_ROWS", 100)
    tree = G.Tree(0, 0, 1, 2)
    G.grow(d, FEATS, [tree], {(0, 0): 600}, 1)
    mean = d.where("_fold0 != 0").agg(F.avg("_label")).first()[0]
    assert tree.value[0] == pytest.approx(mean, rel=1e-12)
    assert sum(s[0] for n, s in tree.sums.items() if n in (1, 2)) == 600


def test_constant_features_and_pure_targets_leave_a_root(spark):
    d = spark.range(60).select(F.lit(1.0).alias("a"), F.col("id").cast("double").alias("b"), F.lit(3.0).alias("_label"),
                               (F.col("id") % 2).cast("int").alias("_fold0"))
    for features in (["a"], ["a", "b"]):
        tree = G.Tree(0, 1, 1, 2)
        assert G.grow(d, features, [tree], {(0, 1): 30}, 1) == {(0, 0): 0.0, (0, 1): 0.0, (0, 2): 0.0}
        assert tree.feature[0] == -1 and tree.value[0] == 3.0


def test_thresholds_are_those_of_equal_bins():
    assert G.thresholds(np.array([1.0, -0.0, 0.0, 4.0]), 4.0).tolist() == [0.5, 2.5]
    assert len(G.thresholds(np.arange(10_000.0), 10_000.0)) == 31
    assert G.thresholds(np.zeros(3), 3.0).tolist() == []


def test_thresholds_are_found_on_the_rows_that_a_fit_draws(spark):
    d = spark.range(30_000).select(F.col("id").alias("row_id"), *[
        ((F.xxhash64("id", F.lit(c)) % 100_000) / 1000.0).alias(c) for c in FEATS]).withColumn("y", F.sin("a") + F.col("b")).coalesce(3).persist()
    points = [{"maxDepth": 4, "minInstancesPerNode": 2}]
    got = T.search(d, FEATS, "y", "Decision Tree", points, k=2, repeats=1)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(G, "MAX_DEPTH", 0)
        want = T.search(d, FEATS, "y", "Decision Tree", points, k=2, repeats=1)
    assert got.cv_neg_mse == pytest.approx(want.cv_neg_mse, rel=1e-9)
