"""Damage-state probabilities from lognormal fragility curves and uniform
exposure intervals, as a table operator over any asset table
``(asset_id, curve_id, lo, hi)``.

Integration is a node table: distinct (curve, lo, hi) rows are exploded into
midpoint nodes, evaluated with column expressions (polynomial erf) and
averaged by one groupBy; the result is joined back to every asset. The work
per asset table is proportional to its distinct intervals, not its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.functions.special import lognorm_cdf

MPH_TO_MS = 0.44704

# Per curve the four log-medians' exponents (the effective mu of
# ln W) and log standard deviations of the exceedance curves LS1..LS4.
CURVES = {
    "t6": ([3.415, 3.625, 3.895, 4.075], [0.11, 0.11, 0.11, 0.21]),
    "t13": ([3.255, 3.655, 3.875, 4.145], [0.12, 0.11, 0.11, 0.17]),
    "t19": ([3.425, 3.675, 3.905, 4.165], [0.12, 0.12, 0.11, 0.17]),
}

# Wind-speed bands in mph per EF level.
EF_MPH = {"EF0": (65.0, 86.0), "EF1": (86.0, 111.0), "EF2": (111.0, 136.0), "EF3": (136.0, 166.0),
          "EF4": (166.0, 200.0)}


def curve_params(spark: SparkSession) -> DataFrame:
    rows = [(k, [float(v) for v in mu], [float(v) for v in sg]) for k, (mu, sg) in CURVES.items()]
    return spark.createDataFrame(rows, "curve_id string, mu array<double>, sigma array<double>")


def exceedance(w: Column, mu: Column, sigma: Column) -> list[Column]:
    """F1..F4 at w for array columns mu, sigma."""
    return [lognorm_cdf(w, mu[i], sigma[i]) for i in range(4)]


def category_probs(fs: list[Column]) -> list[Column]:
    """Re-anchored state probabilities from exceedance values F1..F4:
    p0 = 1 - F1; p_i = max(0, last - F_{i+1}) with last = running minimum;
    p4 = final last (sums to 1)."""
    out = [F.lit(1.0) - fs[0]]
    last = fs[0]
    for f in fs[1:]:
        out.append(F.greatest(F.lit(0.0), last - f))
        last = F.least(last, f)
    out.append(last)
    return out


def expected_category_pmf(assets: DataFrame, params: DataFrame, nodes: int = 512) -> DataFrame:
    """assets (.., curve_id, lo, hi) + ds0..ds4: expected probabilities for w
    uniform on [lo, hi] (midpoint rule on ``nodes`` points)."""
    keys = assets.select("curve_id", "lo", "hi").distinct()
    k = keys.join(params, "curve_id")
    j = F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("j")
    pts = k.select("curve_id", "lo", "hi", "mu", "sigma", j)
    w = F.col("lo") + (F.col("j").cast("double") + 0.5) * (F.col("hi") - F.col("lo")) / F.lit(float(nodes))
    ps = category_probs(exceedance(w, F.col("mu"), F.col("sigma")))
    pmf = pts.select("curve_id", "lo", "hi", *[p.alias(f"p{i}") for i, p in enumerate(ps)]) \
        .groupBy("curve_id", "lo", "hi").agg(*[F.avg(f"p{i}").alias(f"ds{i}") for i in range(5)])
    return assets.join(pmf, ["curve_id", "lo", "hi"], "left")


def fragility_curves(levels: DataFrame, params: DataFrame, n: int = 500) -> DataFrame:
    """(curve_id, ef_level, i, w, f1..f4) on n even points over [0, hi]; F(0) = 0."""
    k = levels.join(params, "curve_id")
    i = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i")
    pts = k.select("curve_id", "ef_level", "hi", "mu", "sigma", i)
    w = F.col("hi") * F.col("i").cast("double") / F.lit(float(n - 1))
    fs = exceedance(w, F.col("mu"), F.col("sigma"))
    return pts.select("curve_id", "ef_level", "i", w.alias("w"), *[f.alias(f"f{j + 1}") for j, f in enumerate(fs)])


def ef_bounds() -> dict[str, tuple[float, float]]:
    return {k: (lo * MPH_TO_MS, hi * MPH_TO_MS) for k, (lo, hi) in EF_MPH.items()}


def uniform_pdf(w: Column, lo: Column, hi: Column) -> Column:
    """Density of a uniform load on [lo, hi]."""
    return F.when((w >= lo) & (w <= hi), F.lit(1.0) / (hi - lo)).otherwise(F.lit(0.0))


def pmf_table(archetypes: DataFrame, params: DataFrame, digits: int = 4, nodes: int = 512) -> DataFrame:
    """archetype, ef_level, ds0..ds4 (rounded): every archetype (archetype, curve_id) at every EF level."""
    spark = archetypes.sparkSession
    levels = spark.createDataFrame([(k, lo, hi) for k, (lo, hi) in ef_bounds().items()], "ef_level string, lo double, hi double")
    both = archetypes.join(levels)  # six fixed levels for each archetype
    pmf = expected_category_pmf(both, params, nodes)
    return pmf.select("archetype", "ef_level", *[F.round(f"ds{i}", digits).alias(f"ds{i}") for i in range(5)])
