"""Group folds dealt by size classes, against the greedy rule itself."""

import heapq
import random

import numpy as np
from pyspark.sql import functions as F

from relyframe.operators.split import _dealt, assign_group_folds


def greedy(sizes, k):
    """sizes: (group, rows) in order; the lightest fold (lowest on ties) takes each."""
    heap, out = [(0, f) for f in range(k)], {}
    for g, c in sizes:
        load, f = heapq.heappop(heap)
        out[g] = f
        heapq.heappush(heap, (load + c, f))
    return out


def test_dealing_equals_the_greedy_rule():
    r = random.Random(1)
    for _ in range(300):
        k, c, m = r.randint(2, 6), r.randint(1, 9), r.randint(1, 40)
        loads = [r.randint(0, 40) for _ in range(k)]
        now, want = list(loads), []
        for _ in range(m):
            f = min(range(k), key=now.__getitem__)
            want.append(f)
            now[f] += c
        assert _dealt(np.array([loads] * m, np.int64), np.full(m, c), np.arange(m))[0].tolist() == want


def test_a_million_groups_in_no_single_task(spark):
    n = 1_000_000
    df = spark.range(n).select(F.when(F.col("id") < 300_000, F.lit(None)).otherwise(
        F.format_string("g%07d", F.when(F.col("id") < 400_000, F.col("id") % 977).otherwise(F.col("id")))).alias("g"))
    folded, k = assign_group_folds(spark, df, "g", 5)
    assert k == 5
    got = folded.groupBy("g").agg(F.min("fold").alias("a"), F.max("fold").alias("b"), F.count("*").alias("c")).toPandas()
    assert (got.a == got.b).all()
    got = got.sort_values(["c", "g"], ascending=[False, True], na_position="first")
    want = greedy([(g if isinstance(g, str) else None, c) for g, c in zip(got.g, got.c)], 5)
    assert all(want[g if isinstance(g, str) else None] == f for g, f in zip(got.g, got.a))
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce 1" not in plan


def test_fewer_groups_than_folds(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "g string")
    folded, k = assign_group_folds(spark, df, "g", 5)
    assert k == 3 and {(r.g, r.fold) for r in folded.collect()} == {("a", 0), (None, 1), ("b", 2)}
    one, k = assign_group_folds(spark, df.where("g = 'a'"), "g", 5)
    assert k == 1 and {r.fold for r in one.collect()} == {None}
