"""Shared statistics primitives: long form, average ranks, Gram matrices,
Pearson / Spearman matrices, distinct-count profiles, fingerprints.

p (features) is small and n (rows) is large: everything n-sized stays in
Spark; only p x p sums reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relyframe.operators.ordered import exact_position
from relyframe.operators.ranks import average_rank


def q(c: str) -> str:
    return f"`{c}`"


def long_form(df: DataFrame, cols: list[str], id_col: str = "row_id",
              feature_col: str = "feature", value_col: str = "value") -> DataFrame:
    """(id, feature, value DOUBLE) -- one row per cell, no shuffle."""
    d = df.select(F.col(id_col), *[F.col(q(c)).cast("double").alias(c) for c in cols])
    return d.unpivot([id_col], cols, feature_col, value_col)


def average_rank_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, n, avg_rank) over distinct non-null values.

    Average rank = (number of smaller values) + (n + 1) / 2. Works on distinct
    values, so a hot value is one row; the running count is range-partitioned,
    so one feature never sits in a single task.
    """
    lf = long_form(df.select(*[F.col(q(c)) for c in cols], F.lit(0).alias("_id")), cols, "_id")
    distinct = lf.where(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    ranked = exact_position(distinct, ["feature"], ["value"], weight_col="n", pos_col="_below",
                            total_col=None)
    return ranked.select("feature", "value", "n",
                         (F.col("_below").cast("double") + (F.col("n").cast("double") + 1.0) / 2.0).alias("avg_rank"))


# ---------------------------------------------------------------- Gram path

def column_means(df: DataFrame, cols: list[str]) -> np.ndarray:
    row = df.agg(*[F.avg(F.col(q(c)).cast("double")).alias(c) for c in cols]).first()
    return np.array([row[c] if row[c] is not None else 0.0 for c in cols], dtype=float)


def gram_complete(df: DataFrame, cols: list[str], shift: np.ndarray | None = None):
    """n, S (p), G (p x p) of shifted columns over rows where every column is present.

    One aggregate job: p + p(p+1)/2 sums, all JVM-side (partial aggregation
    per task, one tiny final shuffle).
    """
    p = len(cols)
    shift = np.zeros(p) if shift is None else shift
    xs = [F.col(q(c)).cast("double") - F.lit(float(shift[i])) for i, c in enumerate(cols)]
    present = F.lit(True)
    for c in cols:
        present = present & F.col(q(c)).isNotNull()
    d = df.where(present)
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.sum(xs[i]).alias(f"s{i}") for i in range(p)]
    aggs += [F.sum(xs[i] * xs[j]).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)]
    row = d.agg(*aggs).first()
    n = row["n"]
    s = np.array([row[f"s{i}"] or 0.0 for i in range(p)])
    g = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return n, s, g


def gram_pairwise(df: DataFrame, cols: list[str], shift: np.ndarray | None = None):
    """Pairwise-complete sums with numpy per Arrow batch (mapInPandas), summed
    elementwise by one small aggregate: N, Si|j, Qi|j, Gij as p x p matrices."""
    p = len(cols)
    shift = np.zeros(p) if shift is None else np.asarray(shift, dtype=float)
    names = [f"c{i}" for i in range(p)]
    d = df.select(*[F.col(q(c)).cast("double").alias(names[i]) for i, c in enumerate(cols)])

    def part(it):
        acc = np.zeros((4, p, p))
        for pdf in it:
            x = pdf[names].to_numpy(dtype=float) - shift
            m = ~np.isnan(x)
            x0 = np.where(m, x, 0.0)
            mf = m.astype(float)
            acc[0] += mf.T @ mf
            acc[1] += x0.T @ mf
            acc[2] += (x0 * x0).T @ mf
            acc[3] += x0.T @ x0
        yield pd.DataFrame({"k": np.arange(acc.size, dtype=np.int64), "v": acc.ravel()})

    sums = d.mapInPandas(part, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(4 * p * p)
    for r in sums:
        flat[r["k"]] = r["v"]
    acc = flat.reshape(4, p, p)
    return acc[0], acc[1], acc[2], acc[3]


def corr_matrix(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Pearson matrix, pairwise-complete; NaN where a variance is zero.

    Two passes over a persisted projection: counts + means, then the Gram
    of mean-shifted columns (shifting keeps the sums from cancelling).
    """
    p = len(cols)
    d = df.select(*[F.col(q(c)).cast("double").alias(c) for c in cols]).persist()
    try:
        row = d.agg(F.count(F.lit(1)).alias("_all"), *[F.count(F.col(q(c))).alias(f"n_{i}") for i, c in enumerate(cols)],
                    *[F.avg(F.col(q(c))).alias(f"m_{i}") for i, c in enumerate(cols)]).first()
        mu = np.array([row[f"m_{i}"] if row[f"m_{i}"] is not None else 0.0 for i in range(p)])
        complete = all(row[f"n_{i}"] == row["_all"] for i in range(p))
        if complete:
            n, s, g = gram_complete(d, cols, mu)
        else:
            nn, si, qi, gij = gram_pairwise(d, cols, mu)
    finally:
        d.unpersist()
    if complete:
        if n == 0:
            return np.full((p, p), np.nan)
        cov = g / n - np.outer(s, s) / (n * n)
        var = np.diag(cov).copy()
        with np.errstate(invalid="ignore", divide="ignore"):
            den = np.sqrt(np.outer(var, var))
            r = np.where(den > 0, cov / np.where(den > 0, den, 1.0), np.nan)
        return np.clip(r, -1.0, 1.0)
    sj = si.T
    qj = qi.T
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = nn * gij - si * sj
        vi = nn * qi - si * si
        vj = nn * qj - sj * sj
        den = np.sqrt(np.maximum(vi, 0) * np.maximum(vj, 0))
        r = np.where((den > 0) & (nn > 1), cov / np.where(den > 0, den, 1.0), np.nan)
    return np.clip(r, -1.0, 1.0)


def spearman_matrix(df: DataFrame, cols: list[str], id_col: str = "row_id") -> np.ndarray:
    """Pearson of column-wise average ranks; undefined entries become 0."""
    ranks = average_rank(df, cols, id_col)
    r = corr_matrix(ranks, cols)
    return np.nan_to_num(r, nan=0.0)


def matrix_to_long(spark: SparkSession, m: np.ndarray, cols: list[str], upper_only: bool = False,
                   value_name: str = "assoc") -> DataFrame:
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if upper_only and j <= i:
                continue
            v = m[i, j]
            rows.append((a, b, None if v is None or (isinstance(v, float) and math.isnan(v)) else float(v)))
    schema = T.StructType([T.StructField("f1", T.StringType()), T.StructField("f2", T.StringType()),
                           T.StructField(value_name, T.DoubleType())])
    return spark.createDataFrame(rows, schema)


# ------------------------------------------------------------ profiles etc.

def profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """(column, n_distinct, n_missing): exact distinct counts (nulls not counted).

    Computed in long form as one groupBy over (column, value) -- a
    partial-aggregate shuffle of distinct values only -- instead of p
    ``countDistinct`` expressions, which Spark would expand into p-way row
    duplication. String and numeric columns are profiled by their text form.
    """
    cols = cols or df.columns
    d = df.select(*[F.col(q(c)).cast("string").alias(c) for c in cols], F.lit(0).alias("_id"))
    lf = d.unpivot(["_id"], cols, "column", "value")
    distinct = lf.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    out = distinct.groupBy("column").agg(
        F.count("value").alias("n_distinct"),
        F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("n_missing"))
    return out


def fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """Order-insensitive content hash: (n_rows, sum of 52-bit md5 row hashes as DECIMAL)."""
    row_text = F.concat_ws("|", *[F.coalesce(F.col(q(c)).cast("string"), F.lit("\\N")) for c in cols])
    h = F.conv(F.substring(F.md5(row_text), 1, 13), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h).cast("decimal(38,0)").cast("string").alias("content_hash"))
