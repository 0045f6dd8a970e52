"""Fragility proofs (C8-C11, G1, G2) over an asset table derived from customer:
curve by customer key mod 3, EF level by key mod 5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.functions.special import lognorm_cdf_sql
from relyframe.operators import fragility as G
from relyframe.plans.catalog import register, rounded
from relyframe.sources import load

CURVE_IDS = ["t6", "t13", "t19"]
LEVELS = list(G.EF_MPH)
BOUNDS = G.ef_bounds()


def assets(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("asset_id"))
    curve = F.element_at(F.array(*[F.lit(x) for x in CURVE_IDS]), (F.col("asset_id") % 3 + 1).cast("int"))
    lvl = (F.col("asset_id") % 5).cast("int")
    lo = F.element_at(F.array(*[F.lit(BOUNDS[l][0]) for l in LEVELS]), lvl + 1)
    hi = F.element_at(F.array(*[F.lit(BOUNDS[l][1]) for l in LEVELS]), lvl + 1)
    return c.select("asset_id", curve.alias("curve_id"), F.concat(F.lit("EF"), lvl.cast("string")).alias("ef_level"),
                    lo.alias("lo"), hi.alias("hi"))


_PAR = "(VALUES " + ", ".join(f"('{k}', {mu!r}::DOUBLE[], {sg!r}::DOUBLE[])" for k, (mu, sg) in G.CURVES.items()) \
    + ") t(curve_id, mu, sigma)"
_ASSETS = ("SELECT c_custkey AS asset_id, CASE c_custkey % 3 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CURVE_IDS))
           + " END AS curve_id, 'EF' || CAST(c_custkey % 5 AS VARCHAR) AS ef_level, CASE c_custkey % 5 "
           + " ".join(f"WHEN {i} THEN {BOUNDS[l][0]!r}" for i, l in enumerate(LEVELS)) + " END AS lo, CASE c_custkey % 5 "
           + " ".join(f"WHEN {i} THEN {BOUNDS[l][1]!r}" for i, l in enumerate(LEVELS)) + " END AS hi FROM customer")


def _fs(w: str) -> str:
    return ", ".join(f"{lognorm_cdf_sql(w, f'mu[{i + 1}]', f'sigma[{i + 1}]')} AS f{i + 1}" for i in range(4))


_PMF_SQL = f"""WITH par AS (SELECT * FROM {_PAR}), a AS ({_ASSETS}),
keys AS (SELECT DISTINCT curve_id, lo, hi FROM a),
pts AS (SELECT curve_id, lo, hi, mu, sigma, lo + (CAST(j AS DOUBLE) + 0.5) * (hi - lo) / 512.0 AS w
        FROM keys JOIN par USING (curve_id), (SELECT range AS j FROM range(512))),
f AS (SELECT curve_id, lo, hi, {_fs('w')} FROM pts),
p AS (SELECT curve_id, lo, hi, 1.0 - f1 AS p0, greatest(0.0, f1 - f2) AS p1, least(f1, f2) AS l2,
             f3, f4 FROM f),
p2 AS (SELECT curve_id, lo, hi, p0, p1, greatest(0.0, l2 - f3) AS p2, least(l2, f3) AS l3, f4 FROM p),
p3 AS (SELECT curve_id, lo, hi, p0, p1, p2, greatest(0.0, l3 - f4) AS p3, least(l3, f4) AS p4 FROM p2),
pmf AS (SELECT curve_id, lo, hi, avg(p0) AS ds0, avg(p1) AS ds1, avg(p2) AS ds2, avg(p3) AS ds3, avg(p4) AS ds4
        FROM p3 GROUP BY ALL)
SELECT asset_id, curve_id, ef_level, round(lo, 6) AS lo, round(hi, 6) AS hi, round(ds0, 6) AS ds0, round(ds1, 6) AS ds1,
       round(ds2, 6) AS ds2, round(ds3, 6) AS ds3, round(ds4, 6) AS ds4 FROM a JOIN pmf USING (curve_id, lo, hi)"""


@register("category_pmf", _PMF_SQL)
def q_pmf(spark: SparkSession, sf: str):
    out = G.expected_category_pmf(assets(spark, sf), G.curve_params(spark), 512)
    return rounded(out.select("asset_id", "curve_id", "ef_level", "lo", "hi", *[f"ds{i}" for i in range(5)]))


@register("category_probs", f"""WITH par AS (SELECT * FROM {_PAR}), a AS ({_ASSETS}),
f AS (SELECT asset_id, {_fs('lo')} FROM a JOIN par USING (curve_id))
SELECT asset_id, round(1.0 - f1, 6) AS p0, round(greatest(0.0, f1 - f2), 6) AS p1,
       round(greatest(0.0, least(f1, f2) - f3), 6) AS p2, round(greatest(0.0, least(f1, f2, f3) - f4), 6) AS p3,
       round(least(f1, f2, f3, f4), 6) AS p4 FROM f""")
def q_probs(spark: SparkSession, sf: str):
    a = assets(spark, sf).join(G.curve_params(spark), "curve_id")
    ps = G.category_probs(G.exceedance(F.col("lo"), F.col("mu"), F.col("sigma")))
    return rounded(a.select("asset_id", *[p.alias(f"p{i}") for i, p in enumerate(ps)]))


@register("lognorm_cdf", f"""WITH par AS (SELECT * FROM {_PAR}), a AS ({_ASSETS})
SELECT asset_id, {', '.join(f'round({lognorm_cdf_sql("hi", f"mu[{i + 1}]", f"sigma[{i + 1}]")}, 6) AS f{i + 1}' for i in range(4))}
FROM a JOIN par USING (curve_id)""")
def q_cdf(spark: SparkSession, sf: str):
    a = assets(spark, sf).join(G.curve_params(spark), "curve_id")
    fs = G.exceedance(F.col("hi"), F.col("mu"), F.col("sigma"))
    return rounded(a.select("asset_id", *[f.alias(f"f{i + 1}") for i, f in enumerate(fs)]))


@register("fragility_curves", f"""WITH par AS (SELECT * FROM {_PAR}), a AS ({_ASSETS}),
lv AS (SELECT DISTINCT curve_id, ef_level, hi FROM a),
pts AS (SELECT curve_id, ef_level, CAST(i AS INTEGER) AS i, hi * CAST(i AS DOUBLE) / 499.0 AS w, mu, sigma
        FROM lv JOIN par USING (curve_id), (SELECT range AS i FROM range(500)))
SELECT curve_id, ef_level, i, round(w, 6) AS w, {', '.join(f'round({lognorm_cdf_sql("w", f"mu[{j + 1}]", f"sigma[{j + 1}]")}, 6) AS f{j + 1}' for j in range(4))}
FROM pts""")
def q_curves(spark: SparkSession, sf: str):
    lv = assets(spark, sf).select("curve_id", "ef_level", "hi").distinct()
    return rounded(G.fragility_curves(lv, G.curve_params(spark), 500))


# ------------------------------------------------- archetype x EF level table

_RAW_PMF = _PMF_SQL
for _i in range(5):
    _RAW_PMF = _RAW_PMF.replace(f"round(ds{_i}, 6)", f"ds{_i}")
_ARCH_PMF = _RAW_PMF.replace(_ASSETS, "SELECT a.archetype AS asset_id, a.curve_id, l.ef_level, l.lo, l.hi FROM "
                             "(SELECT DISTINCT p_brand AS archetype, CASE CAST(substr(p_brand, -1) AS INTEGER) % 3 "
                             + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CURVE_IDS)) + " END AS curve_id FROM part) a, (VALUES "
                             + ", ".join(f"('{l}', {BOUNDS[l][0]!r}, {BOUNDS[l][1]!r})" for l in LEVELS) + ") l(ef_level, lo, hi)")


@register("pmf_table", "SELECT asset_id AS archetype, ef_level, " + ", ".join(f"round(ds{i}, 4) AS ds{i}" for i in range(5))
          + f" FROM ({_ARCH_PMF})")
def q_pmf_table(spark: SparkSession, sf: str):
    """Every archetype (part brand, its curve by the brand's last digit) at every EF level, written and read back."""
    from relyframe.session import scratch_path
    from relyframe.sources import write_table
    part = load(spark, sf, "part").select(F.col("p_brand").alias("archetype")).distinct()
    curve = F.element_at(F.array(*[F.lit(x) for x in CURVE_IDS]), (F.substring("archetype", -1, 1).cast("int") % 3 + 1).cast("int"))
    table = G.pmf_table(part.withColumn("curve_id", curve), G.curve_params(spark))
    return spark.read.parquet(write_table(table, scratch_path(spark, "pmf")))


_LO, _HI = "CAST(lo AS DOUBLE)", "CAST(hi AS DOUBLE)"
_W = f"({_LO} + CAST(asset_id % 7 - 1 AS DOUBLE) * ({_HI} - {_LO}) / 4.0)"


@register("uniform_density", f"""SELECT asset_id, ef_level, round({_W}, 6) AS w,
       round(CASE WHEN {_W} >= {_LO} AND {_W} <= {_HI} THEN 1.0 / ({_HI} - {_LO}) ELSE 0.0 END, 6) AS density FROM ({_ASSETS}) a""")
def q_uniform(spark: SparkSession, sf: str):
    """Density of the load at a point in, at the ends of or outside each asset's interval."""
    w = F.col("lo") + (F.col("asset_id") % 7 - 1) * (F.col("hi") - F.col("lo")) / F.lit(4.0)
    return rounded(assets(spark, sf).select("asset_id", "ef_level", w.alias("w"),
                                            G.uniform_pdf(w, F.col("lo"), F.col("hi")).alias("density")))
