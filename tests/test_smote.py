"""Synthetic minority rows: exact neighbours over blocks, points on segments, small classes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from relyframe.operators import smote as S


def frame(spark, n=300, seed=5):
    r = np.random.default_rng(seed)
    rows = [(i, "a" if i % 3 else "b", float(np.round(r.normal(), 1)), float(r.integers(0, 5))) for i in range(n)]
    rows += [(n, None, 1.0, 1.0), (n + 1, "b", None, 1.0), (n + 2, "b", math.inf, 1.0), (n + 3, "solo", 0.0, 0.0),
             (n + 4, "pair", 0.0, 0.0), (n + 5, "pair", 9.0, 3.0)]
    return spark.createDataFrame(rows, "row_id long, label string, x double, y double"), rows


@pytest.mark.parametrize("block", [7, 64, 10_000])
def test_neighbors_equal_brute_force(spark, block):
    df, rows = frame(spark)
    got = {r.row_id: [(o["_other"]) for o in r.others] for r in S.class_neighbors(df, "label", ["x", "y"], 4, block_rows=block).collect()}
    good = [r for r in rows if r[1] and r[2] is not None and math.isfinite(r[2])]
    for i, lab, x, y in good:
        near = sorted(((x - u) ** 2 + (y - v) ** 2, j) for j, m, u, v in good if m == lab and j != i)[:4]
        assert got.get(i, []) == [j for _, j in near], (i, block)


def test_rows_lie_on_segments_and_classes_are_levelled(spark):
    df, rows = frame(spark)
    at = {r[0]: r for r in rows}
    out = S.smote(df, "label", ["x", "y"], k=3, seed=7).collect()
    by = {}
    for r in out:
        by.setdefault(r.label, []).append(r.number)
        a, b = at[r.base], at[r.other]
        assert a[1] == b[1] == r.label and 0 <= r.gap < 1 and a[0] != b[0]
        assert r.x == a[2] + r.gap * (b[2] - a[2]) and r.y == a[3] + r.gap * (b[3] - a[3])
    assert {k: sorted(v) for k, v in by.items()} == {"b": list(range(100)), "pair": list(range(198))}
    again = S.smote(df.repartition(5), "label", ["x", "y"], k=3, seed=7, block_rows=16).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_nothing_to_do(spark):
    df, _ = frame(spark)
    assert S.smote(df.where("label = 'a'"), "label", ["x", "y"]).count() == 0
    assert S.smote(df.where("false"), "label", ["x", "y"]).count() == 0


def test_boxes_along_several_features(spark):
    """Neighbours are exact, and boxes are short along each feature that counts, so a row's ball meets few of them."""
    r = np.random.default_rng(6)
    n, k = 4_000, 5
    x = np.round(r.normal(size=(n, 3)), 2) * [1.0, 0.9, 1e-4]
    df = spark.createDataFrame([(i, "a", *map(float, v)) for i, v in enumerate(x)], "row_id long, label string, x double, y double, z double")
    names = df.select("row_id", "label", F.col("x").alias("_x0"), F.col("y").alias("_x1"), F.col("z").alias("_x2"))
    placed, axes = S.in_boxes(names.withColumnsRenamed({"label": "_label", "row_id": "_id"}), ["_x0", "_x1", "_x2"], 64)
    assert axes == ["_x0", "_x1"]  # the third hardly moves a distance
    spans = placed.groupBy("_blk").agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in axes]).toPandas()
    assert spans["n"].max() <= 2 * 64
    assert (spans[axes].median() < 0.3 * (x.max(axis=0) - x.min(axis=0))[:2]).all()
    got = {row.row_id: [o["_other"] for o in row.others] for row in S.class_neighbors(df, "label", ["x", "y", "z"], k, block_rows=64).collect()}
    for i in r.integers(0, n, 100):
        d = ((x - x[i]) ** 2).sum(axis=1)
        d[i] = np.inf
        assert got[i] == np.lexsort((np.arange(n), d))[:k].tolist()
