"""Forests grown side by side: draws, splits and errors against a plain version, and the elimination by their importances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from relyframe.operators import forests as Fo
from relyframe.operators import grown as G
from relyframe.operators import trees as T

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    d = spark.range(1500).select(F.col("id").alias("row_id"), *[
        ((F.xxhash64("id", F.lit(c)) % 1000) / 1000.0).alias(c) for c in FEATS])
    d = d.withColumn("y", F.sin(3 * F.col("a")) + F.col("b") * F.col("b") + (F.xxhash64("row_id", F.lit(9)) % 1000) / 5000.0)
    d = d.coalesce(2).persist()
    d.count()
    return d


def folded(frame):
    return frame.select(*FEATS, F.col("y").alias("_label"), F.xxhash64("row_id").alias("_hash"), (F.col("row_id") % 3).cast("int").alias("_fold0"))


def plain_errors(rows, train_rows, min_rows, trees, depth, tried, seed):
    """Held-out errors by depth and number of trees, a tree at a time, from rows (bins, label, hash, held)."""
    bins, y, h, held = rows
    order = [np.sort(np.random.default_rng([seed, level]).random((trees, 2 ** level, len(bins))).argsort(axis=2)[:, :, :tried], axis=2)
             for level in range(depth)]
    mean = np.zeros((trees, depth + 1, held.sum()))
    gains = np.zeros((trees, len(bins)))
    for t in range(trees):
        w = Fo._poisson()[Fo.draws(h, seed, t // 4)[:, t % 4]].astype(float) * ~held

        def grow(node, level, inside, value):
            mean[t, level:, inside[held]] = value
            if level == depth:
                return
            best = None
            for f in order[level][t, node - 2 ** level + 1]:
                for b in range(bins[f].max()):
                    l, r = inside & (bins[f] <= b), inside & (bins[f] > b)
                    if w[l].sum() < min_rows or w[r].sum() < min_rows:
                        continue
                    sse = [(w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2).sum() for s in (inside, l, r)]
                    if best is None or sse[0] - sse[1] - sse[2] > best[0] + 1e-9:
                        best = sse[0] - sse[1] - sse[2], f, l, r
            if best is not None and best[0] > 1e-12:
                gains[t, best[1]] += best[0]
                for child, s in ((2 * node + 1, best[2]), (2 * node + 2, best[3])):
                    grow(child, level + 1, s, np.average(y[s], weights=w[s]))

        grow(0, 0, np.ones(len(y), bool), np.average(y, weights=w))
    shares = (gains / gains.sum(axis=1)[:, None]).mean(axis=0)
    return lambda d, n: ((mean[:n, d].mean(axis=0) - y[held]) ** 2).mean(), shares


@pytest.mark.parametrize("bytes_,chunk", [(32 << 20, 65_536), (9_000, 100)])
def test_errors_and_importances_equal_a_plain_forest(spark, frame, monkeypatch, bytes_, chunk):
    monkeypatch.setattr(Fo, "PASS_BYTES", bytes_)
    monkeypatch.setattr(G, "CHUNK", chunk)
    monkeypatch.setattr(G, "BINS", 6)
    d = folded(frame)
    rows = Fo.Rows(d if chunk > 100 else d.repartition(5), FEATS, {(0, 1): 1000}, 7)
    grown = Fo.Forests(rows, (0, 1), [0, 1, 2], [1, 60], 6, 3, 2, 7).grow()
    got = grown.held_out([2, 3], [4, 6])
    t = rows.rows.toPandas()
    flat = np.stack([rows.tables[0, 1][i][t[f"c{i}"].to_numpy()] for i in range(3)])
    own = flat, t["_label"].to_numpy(), t["_hash"].to_numpy().view(np.uint64), t["_fold0"].to_numpy() == 1
    for v, least in enumerate((1, 60)):
        error, shares = plain_errors(own, 1000, least, 6, 3, 2, 7)
        for depth in (2, 3):
            for n in (4, 6):
                assert got[v, depth, n] == pytest.approx(error(depth, n), rel=1e-9)
        if not v:
            assert grown.importances() == pytest.approx(shares, rel=1e-9)
    rows.close()


def test_rows_are_drawn_once_on_average_and_equal_rows_apart():
    h = Fo.apart(np.full(40_000, 5, np.int64))
    assert len(np.unique(h)) == 40_000 and Fo.apart(np.array([3, 7, 3], np.int64))[0] == 3
    for four in (0, 3):
        for t in range(4):
            w = Fo._poisson()[Fo.draws(h, 1, four)[:, t]]
            assert w.mean() == pytest.approx(1, abs=0.03) and w.var() == pytest.approx(1, abs=0.05)
            assert (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.02)


def test_a_search_of_forests_makes_one_fit_and_scores_as_well_as_spark(spark, frame, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressor
    plain, fitted = RandomForestRegressor.fit, []
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda *a, **o: fitted.append(1) or plain(*a, **o))
    monkeypatch.setattr(T, "SPARK_ROWS", 0)
    points = [{"numTrees": n, "maxDepth": d, "minInstancesPerNode": m} for n in (20, 40) for d in (2, 5) for m in (1, 30)]
    got = T.search(frame, FEATS, "y", "Random Forest", points, k=3, repeats=1)
    assert len(fitted) == 1 and got.fits == 6
    monkeypatch.setattr(G, "MAX_DEPTH", 0)  # Spark's own fit for each fold
    want = T.search(frame, FEATS, "y", "Random Forest", points, k=3, repeats=1)
    for (p, x), (_, y) in zip(got.points, want.points):
        assert x == pytest.approx(y, rel=0.15), p


def test_elimination_fits_no_forest_of_sparks_and_keeps_the_features_that_matter(spark, frame, monkeypatch):
    from pyspark.ml.regression import RandomForestRegressor
    d = frame.withColumn("one", F.lit(1)).select("row_id", *FEATS, "one", "y")
    with monkeypatch.context() as m:
        m.setattr(RandomForestRegressor, "fit", None)
        m.setattr(T, "SPARK_ROWS", 0)
        got = T.recursive_elimination(d, [*FEATS, "one"], "y", keep=2, num_trees=30)
        twice = T.recursive_elimination(d.repartition(3), [*FEATS, "one"], "y", keep=2, num_trees=30)
    assert got == [("one", 4), ("c", 3), ("a", 0), ("b", 0)] == twice
    assert T.recursive_elimination(d, [*FEATS, "one"], "y", keep=2, num_trees=30)[0] == ("one", 4)  # few rows: by Spark's
    assert T.recursive_elimination(d, FEATS, "y", keep=3) == [("a", 0), ("b", 0), ("c", 0)]
    with pytest.raises(Exception):
        T.recursive_elimination(d.withColumn("a", F.when(F.col("row_id") > 5, F.col("a"))), FEATS, "y", keep=2)
