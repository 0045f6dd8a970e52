"""Split and fold proofs (L1-L5, F12, A16) on the standard frame, target sum_qty."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.functions.hashing import hash_order_sql, uniform_sql
from relyframe.operators import split as S
from relyframe.operators.clean import drop_missing
from relyframe.plans.catalog import register, rounded
from relyframe.plans.frame import FF_SQL, standard_frame

SEED = 42


def split_frame(spark: SparkSession, sf: str) -> DataFrame:
    """FF rows with a target, rare classes dropped, stratified 80/20 split."""
    ff = drop_missing(standard_frame(spark, sf), ["sum_qty"]).persist()
    # reused by every fit-on-train action downstream: persist once
    return S.stratified_split(S.drop_rare_classes(ff, "sum_qty"), "sum_qty", 0.2, SEED).persist()


SPLIT_SQL = FF_SQL + f""",
d0 AS (SELECT *, sum_qty + 0.0 AS cls FROM ff WHERE sum_qty IS NOT NULL),
c0 AS (SELECT cls, count(*) AS c FROM d0 GROUP BY cls),
d AS (SELECT d0.* FROM d0 JOIN c0 USING (cls) WHERE c0.c >= 2),
cl AS (SELECT cls, count(*) AS c FROM d GROUP BY cls),
tot AS (SELECT sum(c) AS n, CAST(ceil(0.2 * sum(c)) AS BIGINT) AS n_test FROM cl),
q0 AS (SELECT cls, c, (c * (n - n_test)) // n AS fl, (c * (n - n_test)) % n AS rem, n - n_test AS n_train,
              {hash_order_sql(SEED, 'class', 'TRY_CAST(round(cls * 1000000.0) AS DECIMAL(38,0))')} AS h FROM cl, tot),
sh AS (SELECT max(n_train) - sum(fl) AS s FROM q0),
qt AS (SELECT cls, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, h, cls) - 1 < (SELECT s FROM sh)
                        THEN 1 ELSE 0 END AS quota FROM q0),
rk AS (SELECT d.*, row_number() OVER (PARTITION BY cls ORDER BY {hash_order_sql(SEED, 'split', 'row_id')}, row_id) - 1 AS p
       FROM d),
sp AS (SELECT rk.* EXCLUDE (cls, p), CASE WHEN p < quota THEN 'train' ELSE 'test' END AS split
       FROM rk JOIN qt USING (cls))
"""


@register("split_drop_rare", "WITH " + SPLIT_SQL + "SELECT row_id, sum_qty FROM d")
def q_drop_rare(spark: SparkSession, sf: str):
    ff = drop_missing(standard_frame(spark, sf), ["sum_qty"])
    return S.drop_rare_classes(ff, "sum_qty").select("row_id", "sum_qty")


@register("split_stratified", "WITH " + SPLIT_SQL + "SELECT row_id, sum_qty, split FROM sp")
def q_stratified(spark: SparkSession, sf: str):
    return split_frame(spark, sf).select("row_id", "sum_qty", "split")


@register("split_random", "WITH " + FF_SQL + f""",
r AS (SELECT row_id, row_number() OVER (ORDER BY {hash_order_sql(SEED, 'split', 'row_id')}, row_id) - 1 AS p,
             count(*) OVER () AS n FROM ff)
SELECT row_id, CASE WHEN p < n - CAST(ceil(0.2 * n) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM r""")
def q_random(spark: SparkSession, sf: str):
    return S.random_split(standard_frame(spark, sf), 0.2, SEED).select("row_id", "split")


@register("repeated_kfold", "WITH " + FF_SQL + ", reps AS (SELECT range AS rep FROM range(5)) "
          "SELECT row_id, CAST(rep AS INTEGER) AS repeat, CAST(floor(CASE rep " + " ".join(
              f"WHEN {r} THEN {uniform_sql(SEED, f'fold{r}', 'row_id')}" for r in range(5))
          + " END * 5) AS INTEGER) AS fold FROM ff, reps")
def q_kfold(spark: SparkSession, sf: str):
    d = S.assign_folds(standard_frame(spark, sf).select("row_id"), 5, 5, SEED)
    long = d.unpivot(["row_id"], [f"fold_{r}" for r in range(5)], "rep_name", "fold")
    return long.select("row_id", F.regexp_extract("rep_name", r"(\d+)$", 1).cast("int").alias("repeat"),
                       F.col("fold").cast("int").alias("fold"))


_GREEDY = "WITH RECURSIVE " + FF_SQL.strip() + """,
gs AS (SELECT r_name, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, r_name) AS i FROM ff GROUP BY r_name),
st AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS g, CAST(NULL AS INTEGER) AS fold, [0, 0, 0, 0, 0]::BIGINT[] AS load
       UNION ALL
       SELECT n.i, n.r_name, CAST(list_position(s.load, list_min(s.load)) - 1 AS INTEGER),
              [CASE WHEN j = list_position(s.load, list_min(s.load)) THEN s.load[j] + n.c ELSE s.load[j] END FOR j IN range(1, 6)]
       FROM st s JOIN gs n ON n.i = s.i + 1)
SELECT ff.row_id, ff.r_name, st.fold FROM ff JOIN st ON st.g = ff.r_name"""


@register("group_kfold", _GREEDY)
def q_group_kfold(spark: SparkSession, sf: str):
    d, _ = S.assign_group_folds(spark, standard_frame(spark, sf).select("row_id", "r_name"), "r_name", 5)
    return d


_CENTRES = [[0.0, 50_000.0], [5_000.0, 100_000.0], [0.0, 200_000.0], [8_000.0, 300_000.0], [-500.0, 400_000.0]]
_NEAREST = "[" + ", ".join(f"(c_acctbal - {a!r}) * (c_acctbal - {a!r}) + (o_totalprice - {b!r}) * (o_totalprice - {b!r})"
                           for a, b in _CENTRES) + "]"


@register("nearest_centre", "WITH " + FF_SQL + f"""
SELECT row_id, CASE WHEN row_id % 13 <> 0 THEN CAST(list_position({_NEAREST}, list_min({_NEAREST})) - 1 AS INTEGER) END
       AS spatial_group FROM ff""")
def q_nearest(spark: SparkSession, sf: str):
    """Group of each row for given centres; every thirteenth row lacks a coordinate and stays without a group."""
    ff = standard_frame(spark, sf).select("row_id", F.when(F.col("row_id") % 13 != 0, F.col("c_acctbal")).alias("c_acctbal"),
                                          "o_totalprice")
    return S.nearest_centre(ff, ["c_acctbal", "o_totalprice"], _CENTRES).select("row_id", "spatial_group")


@register("spatial_groups")
def q_spatial(spark: SparkSession, sf: str):
    ff = standard_frame(spark, sf).select("row_id", "c_acctbal", "o_totalprice")
    return S.spatial_groups(ff, ["c_acctbal", "o_totalprice"], 5, SEED).select("row_id", "spatial_group")


def histogram(df: DataFrame, col: str, bins: int, lo: float, hi: float, tag: str) -> DataFrame:
    width = (F.col(col) - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))
    b = F.least(F.lit(bins - 1), F.floor(width)).cast("int")
    return df.where(F.col(col).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n")) \
        .select(F.lit(tag).alias("tag"), "bin", "n")


@register("target_histogram", "WITH " + SPLIT_SQL + """,
mm AS (SELECT min(sum_qty) AS lo, max(sum_qty) AS hi FROM sp),
tagged AS (SELECT 'all' AS tag, sum_qty FROM sp UNION ALL SELECT split, sum_qty FROM sp)
SELECT tag, CAST(least(9, floor((sum_qty - lo) / (hi - lo) * 10.0)) AS INTEGER) AS bin, CAST(count(*) AS BIGINT) AS n
FROM tagged, mm GROUP BY ALL""")
def q_histogram(spark: SparkSession, sf: str):
    sp = split_frame(spark, sf).persist()
    mm = sp.agg(F.min("sum_qty").alias("lo"), F.max("sum_qty").alias("hi")).first()
    out = histogram(sp, "sum_qty", 10, mm["lo"], mm["hi"], "all")
    for tag in ("train", "test"):
        out = out.unionByName(histogram(sp.where(F.col("split") == tag), "sum_qty", 10, mm["lo"], mm["hi"], tag))
    return out


_SMOTE = ["o_totalprice", "sum_price", "avg_disc"]


@register("smote", "WITH " + FF_SQL + f""",
e AS (SELECT row_id, CAST(o_orderstatus = 'P' AS INTEGER) AS label, {', '.join(f'CAST({f} AS DOUBLE) AS {f}' for f in _SMOTE)} FROM ff
      WHERE o_orderstatus IS NOT NULL AND {' AND '.join(f'{f} IS NOT NULL' for f in _SMOTE)}),
n AS (SELECT label, count(*) AS n FROM e GROUP BY label),
few AS (SELECT label, n, (SELECT max(n) FROM n) - n AS made, least(5, n - 1) AS k FROM n WHERE n > 1 AND n < (SELECT max(n) FROM n)),
m AS (SELECT e.*, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS p FROM e JOIN few USING (label)),
nb AS (SELECT a.label, a.row_id AS base, b.row_id AS other, row_number() OVER (PARTITION BY a.label, a.row_id ORDER BY
         {' + '.join(f'(a.{f} - b.{f}) * (a.{f} - b.{f})' for f in _SMOTE)}, b.row_id) AS rk
       FROM m a JOIN m b ON a.label = b.label AND a.row_id <> b.row_id),
s AS (SELECT label, n, k, unnest(range(made)) AS number FROM few),
g AS (SELECT label, number, CAST(floor({uniform_sql(SEED, 'smote_row', 'label', 'number')} * n) AS BIGINT) AS p,
             CAST(floor({uniform_sql(SEED, 'smote_other', 'label', 'number')} * k) AS BIGINT) + 1 AS rk,
             {uniform_sql(SEED, 'smote_gap', 'label', 'number')} AS gap FROM s)
SELECT g.label, g.number, nb.base, nb.other, round(gap, 6) AS gap,
       {', '.join(f'round(a.{f} + gap * (b.{f} - a.{f}), 6) AS {f}' for f in _SMOTE)}
FROM g JOIN m a ON a.label = g.label AND a.p = g.p JOIN nb ON nb.base = a.row_id AND nb.rk = g.rk
JOIN m b ON b.row_id = nb.other""")
def q_smote(spark: SparkSession, sf: str):
    """Orders in part delivered are few: drawn up to as many as the others."""
    from relyframe.operators.smote import smote
    ff = standard_frame(spark, sf).where(F.col("o_orderstatus").isNotNull()).select(
        "row_id", (F.col("o_orderstatus") == "P").cast("int").alias("label"), *_SMOTE)
    return rounded(smote(ff, "label", _SMOTE, seed=SEED, block_rows=128))
