"""Average ranks against their definition: ties, hot values, missing values and NaN, over any partitioning."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from relyframe.operators import ranks


def brute(vals):
    """Mean place among the present values; NaN is the largest and equals NaN."""
    key = [None if v is None else (math.inf, 1) if math.isnan(v) else (v, 0) for v in vals]
    have = [k for k in key if k is not None]
    return [None if k is None else sum(x < k for x in have) + (have.count(k) + 1) / 2 for k in key]


def rows(n=700, seed=5):
    r = np.random.default_rng(seed)
    hot = np.where(r.random(n) < 0.9, 7.0, r.integers(0, 60, n)).astype(float)
    spread = r.normal(size=n)
    odd = r.choice([0.0, -0.0, math.nan, math.inf, -math.inf, 2.5], n)
    few = r.integers(0, 4, n).astype(float)
    return [(i, float(hot[i]), float(spread[i]), float(odd[i]), None if i % 3 else float(few[i]), None) for i in range(n)]


COLS = ["hot", "spread", "odd", "gaps", "_f"]


@pytest.mark.parametrize("heavy", [2, 40, 10_000])
@pytest.mark.parametrize("parts", ["1", "7", "31"])
def test_ranks_equal_their_definition(spark, monkeypatch, heavy, parts):
    data = rows()
    df = spark.createDataFrame(data, "row_id long, hot double, spread double, odd double, gaps double, _f double").repartition(5)
    monkeypatch.setattr(ranks, "HEAVY_VALUES", heavy)
    monkeypatch.setattr(ranks, "FOUR", 0)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["row_id"]: [r[c] for c in COLS] for r in ranks.average_rank(df, COLS).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = [brute([r[k + 1] for r in data]) for k in range(len(COLS))]
    assert got == {i: [w[i] for w in want] for i in range(len(data))}


def test_a_run_longer_than_a_batch(spark, monkeypatch):
    monkeypatch.setattr(ranks, "HEAVY_VALUES", 1)
    monkeypatch.setattr(ranks, "FOUR", 0)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        df = spark.range(100).select(F.col("id").alias("row_id"), F.when(F.col("id") < 60, 1.0).otherwise(F.col("id").cast("double")).alias("a"))
        got = {r.row_id: r.a for r in ranks.average_rank(df, ["a"]).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: 30.5 if i < 60 else i + 1.0 for i in range(100)}


def test_empty_table_and_text_ids(spark):
    empty = spark.createDataFrame([], "row_id long, a double")
    assert ranks.average_rank(empty, ["a"]).collect() == []
    df = spark.createDataFrame([("x", 2.0), ("y", 1.0), ("z", 2.0), (None, None)], "key string, a double")
    assert {r["key"]: r["a"] for r in ranks.average_rank(df, ["a"], "key").collect()} == {"x": 2.5, "y": 1.0, "z": 2.5, None: None}


def test_heavy_values_are_bounded_and_a_hot_value_is_not_moved_by_value(spark):
    n = 4000
    df = spark.range(n).select(F.col("id").alias("row_id"), F.when(F.col("id") % 10 > 0, 7.0).otherwise(F.rand(1)).alias("a"))
    wide = df.select(F.col("row_id").alias("_id"), F.col("a").alias("0"))
    heavy = ranks.heavy_values(wide, 1, 50).collect()
    assert len(heavy) < 50 and [(r["_v"], r["_w"]) for r in heavy] == [(7.0, n - n // 10)]
    plan = ranks.average_rank(df, ["a"])._jdf.queryExecution().executedPlan().toString()
    moved = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert moved and not any("_v#" in x for x in moved)  # cells move by id only
