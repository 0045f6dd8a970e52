"""Fit-on-train / apply-to-both proofs (E2-E9, C4-C6) over the split frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.functions.boxcox import (boxcox, boxcox_sql, clamp_boxcox_domain, clamp_sql, inv_boxcox,
                                        inv_boxcox_sql)
from relyframe.functions.missing import to_numeric
from relyframe.operators import encode as E
from relyframe.plans.catalog import register, rounded
from relyframe.plans.frame import dirt_expr, dirt_sql
from relyframe.plans.q_split import SPLIT_SQL, split_frame
from relyframe.plans.sqlfrag import to_numeric_sql

BOXCOX_GRID = [i / 10 for i in range(-20, 21)]


def encode_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Split frame plus a dirty numeric (NULL and inf) and a categorical with NULLs."""
    sp = split_frame(spark, sf)
    return sp.select("*", to_numeric(dirt_expr()).alias("wall_num"),
                     F.when(F.col("row_id") % 13 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("seg_dirty"),
                     F.col("o_custkey").cast("string").alias("cust_txt"))


ENC_SQL = SPLIT_SQL + f""",
ef AS (SELECT *, {to_numeric_sql(dirt_sql())} AS wall_num,
              CASE WHEN row_id % 13 = 0 THEN NULL ELSE c_mktsegment END AS seg_dirty,
              CAST(o_custkey AS VARCHAR) AS cust_txt FROM sp),
tr AS (SELECT * FROM ef WHERE split = 'train'),
trf AS (SELECT * FROM tr WHERE wall_num IS NOT NULL AND NOT isnan(wall_num) AND abs(wall_num) < 'inf'::DOUBLE)
"""

_FIN = "(wall_num IS NOT NULL AND NOT isnan(wall_num) AND abs(wall_num) < 'inf'::DOUBLE)"


def _imputed_sql(fill: str) -> str:
    return ("WITH " + ENC_SQL + f"SELECT row_id, split, round(CASE WHEN {_FIN} THEN wall_num ELSE ({fill}) END, 6) "
            "AS wall_imputed FROM ef")


def _imputer_query(strategy: str):
    def run(spark: SparkSession, sf: str):
        ef = encode_frame(spark, sf).persist()
        fill = E.fit_numeric_imputer(ef.where(F.col("split") == "train"), ["wall_num"], strategy)
        return rounded(ef.select("row_id", "split", E.apply_numeric_imputer("wall_num", fill["wall_num"]).alias("wall_imputed")))
    return run


register("impute_train_numeric_median", _imputed_sql("SELECT median(wall_num) FROM trf"))(_imputer_query("median"))
register("impute_train_numeric_mean", _imputed_sql("SELECT avg(wall_num) FROM trf"))(_imputer_query("mean"))
register("impute_train_numeric_most_frequent",
         _imputed_sql("SELECT wall_num FROM trf GROUP BY wall_num ORDER BY count(*) DESC, wall_num LIMIT 1"))(
    _imputer_query("most_frequent"))


@register("impute_train_categorical", "WITH " + ENC_SQL + """
SELECT row_id, split, coalesce(seg_dirty, 'un') AS seg_const,
       coalesce(seg_dirty, (SELECT seg_dirty FROM tr WHERE seg_dirty IS NOT NULL GROUP BY seg_dirty
                            ORDER BY count(*) DESC, seg_dirty LIMIT 1)) AS seg_mode FROM ef""")
def q_impute_cat(spark: SparkSession, sf: str):
    ef = encode_frame(spark, sf).persist()
    tr = ef.where(F.col("split") == "train")
    const = E.fit_categorical_imputer(tr, ["seg_dirty"], "constant", "un")
    mode = E.fit_categorical_imputer(tr, ["seg_dirty"], "most_frequent")
    return ef.select("row_id", "split", F.coalesce("seg_dirty", F.lit(const["seg_dirty"])).alias("seg_const"),
                     F.coalesce("seg_dirty", F.lit(mode["seg_dirty"])).alias("seg_mode"))


@register("standardize", "WITH " + ENC_SQL + """,
st AS (SELECT avg(o_totalprice) AS m1, stddev_pop(o_totalprice) AS s1, avg(c_acctbal) AS m2,
              stddev_pop(c_acctbal) AS s2 FROM tr)
SELECT row_id, split, round((o_totalprice - m1) / s1, 6) AS z_price, round((c_acctbal - m2) / s2, 6) AS z_acct
FROM ef, st""")
def q_standardize(spark: SparkSession, sf: str):
    ef = encode_frame(spark, sf).persist()
    sc = E.fit_standardizer(ef.where(F.col("split") == "train"), ["o_totalprice", "c_acctbal"])
    return rounded(ef.select("row_id", "split",
                             E.apply_standardizer(F.col("o_totalprice"), *sc["o_totalprice"]).alias("z_price"),
                             E.apply_standardizer(F.col("c_acctbal"), *sc["c_acctbal"]).alias("z_acct")))


@register("encode_ordinal", "WITH " + ENC_SQL + """,
cp AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT o_orderpriority AS v FROM tr)),
cc AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT cust_txt AS v FROM tr))
SELECT row_id, split, coalesce(cp.code, -1.0) AS cat__o_orderpriority, coalesce(cc.code, -1.0) AS cat__cust_txt
FROM ef LEFT JOIN cp ON ef.o_orderpriority = cp.v LEFT JOIN cc ON ef.cust_txt = cc.v""")
def q_ordinal(spark: SparkSession, sf: str):
    ef = encode_frame(spark, sf).persist()
    codes = E.fit_categories(ef.where(F.col("split") == "train"), ["o_orderpriority", "cust_txt"])
    out = E.encode_ordinal(ef, {f"cat__{c}": (F.col(c), c) for c in ("o_orderpriority", "cust_txt")}, codes)
    return out.select("row_id", "split", "cat__o_orderpriority", "cat__cust_txt")


_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@register("encode_onehot", "WITH " + ENC_SQL + "SELECT row_id, split, " + ", ".join(
    f"CASE WHEN row_id % 11 <> 0 AND o_orderpriority = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS \"cat__o_orderpriority_{v}\""
    for v in _PRIOS) + " FROM ef")
def q_onehot(spark: SparkSession, sf: str):
    ef = encode_frame(spark, sf).persist()
    codes = E.fit_categories(ef.where(F.col("split") == "train"), ["o_orderpriority"])
    some = F.when(F.col("row_id") % 11 != 0, F.col("o_orderpriority"))  # a missing value is all zeros
    return ef.select("row_id", "split", *E.onehot_exprs("o_orderpriority", some, E.category_list(codes, "o_orderpriority")))


@register("encode_label", "WITH " + ENC_SQL + """,
lv AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code
       FROM (SELECT DISTINCT coalesce(seg_dirty, 'nan') AS v FROM ef))
SELECT row_id, code AS seg_dirty FROM ef JOIN lv ON coalesce(ef.seg_dirty, 'nan') = lv.v""")
def q_label(spark: SparkSession, sf: str):
    ef = encode_frame(spark, sf).select("row_id", "seg_dirty")
    return E.label_encode(ef, ["seg_dirty"])


def preprocessed(spark: SparkSession, sf: str, encoding: str = "ordinal"):
    ef = encode_frame(spark, sf).persist()
    pre = E.Preprocessor(encoding=encoding).fit(ef.where(F.col("split") == "train"),
                                                ["o_totalprice", "c_acctbal", "wall_num", "seg_dirty", "o_orderpriority"])
    return pre.transform(ef, keep=["row_id", "split", "sum_qty"]), pre


@register("preprocess_full", "WITH " + ENC_SQL + """,
med AS (SELECT median(o_totalprice) AS p, median(c_acctbal) AS a, median(wall_num) AS w FROM trf),
med2 AS (SELECT median(o_totalprice) AS p, median(c_acctbal) AS a FROM tr),
imp AS (SELECT ef.row_id, ef.split,
               CASE WHEN o_totalprice IS NOT NULL AND abs(o_totalprice) < 'inf'::DOUBLE THEN o_totalprice ELSE (SELECT p FROM med2) END AS x1,
               CASE WHEN c_acctbal IS NOT NULL AND abs(c_acctbal) < 'inf'::DOUBLE THEN c_acctbal ELSE (SELECT a FROM med2) END AS x2,
               CASE WHEN """ + _FIN + """ THEN wall_num ELSE (SELECT w FROM med) END AS x3,
               coalesce(seg_dirty, 'un') AS c1, coalesce(o_orderpriority, 'un') AS c2 FROM ef),
st AS (SELECT avg(x1) m1, stddev_pop(x1) s1, avg(x2) m2, stddev_pop(x2) s2, avg(x3) m3, stddev_pop(x3) s3
       FROM imp WHERE split = 'train'),
k1 AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT c1 AS v FROM imp WHERE split = 'train')),
k2 AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT c2 AS v FROM imp WHERE split = 'train'))
SELECT imp.row_id, imp.split, ef.sum_qty, round((x1 - m1) / s1, 6) AS num__o_totalprice,
       round((x2 - m2) / s2, 6) AS num__c_acctbal, round((x3 - m3) / s3, 6) AS num__wall_num,
       coalesce(k1.code, -1.0) AS cat__seg_dirty, coalesce(k2.code, -1.0) AS cat__o_orderpriority
FROM imp JOIN ef USING (row_id) CROSS JOIN st LEFT JOIN k1 ON imp.c1 = k1.v LEFT JOIN k2 ON imp.c2 = k2.v""")
def q_preprocess(spark: SparkSession, sf: str):
    out, _ = preprocessed(spark, sf)
    return rounded(out)


# ------------------------------------------------------------------ Box-Cox

_LLF_SQL = ENC_SQL + """,
bx AS (SELECT sum_qty AS x FROM tr WHERE sum_qty IS NOT NULL AND abs(sum_qty) < 'inf'::DOUBLE),
off AS (SELECT CASE WHEN min(x) <= 0 THEN abs(min(x)) + 1.0 ELSE 0.0 END AS o FROM bx),
xs AS (SELECT x + o AS x FROM bx, off),
base AS (SELECT count(*) AS n, sum(ln(x)) AS sl FROM xs),
grid AS (SELECT g / 10.0 AS lam FROM range(-100, 101) t(g)),
ll AS (SELECT lam, (lam - 1.0) * max(sl) - max(n) / 2.0 * ln(var_pop(CASE WHEN lam = 0 THEN ln(x)
                   ELSE (pow(x, lam) - 1.0) / lam END)) AS llf
       FROM grid, xs, base GROUP BY lam),
fit AS (SELECT lam, o FROM ll, off ORDER BY llf DESC LIMIT 1)
"""


def grid_fit(spark: SparkSession, sf: str):
    ef = encode_frame(spark, sf).persist()
    lam, off = E.fit_boxcox(ef.where(F.col("split") == "train"), "sum_qty", grid=BOXCOX_GRID, refine_rounds=0)
    return ef, lam, off


@register("boxcox_fit", "WITH " + _LLF_SQL + "SELECT round(lam, 6) AS lambda, round(o, 6) AS offset FROM fit")
def q_boxcox_fit(spark: SparkSession, sf: str):
    _, lam, off = grid_fit(spark, sf)
    return rounded(spark.createDataFrame([(lam, off)], "lambda double, offset double"))


@register("boxcox_fit_refined", "WITH " + _LLF_SQL + """,
fine AS (SELECT (SELECT lam FROM fit) + g / 1000.0 AS lam FROM range(-100, 101) t(g)),
lf AS (SELECT lam, (lam - 1.0) * max(sl) - max(n) / 2.0 * ln(var_pop(CASE WHEN lam = 0 THEN ln(x) ELSE (pow(x, lam) - 1.0) / lam END)) AS llf
       FROM fine, xs, base GROUP BY lam)
SELECT round((SELECT lam FROM lf ORDER BY llf DESC LIMIT 1), 2) AS lambda, round(max(llf), 2) AS llf FROM lf""")
def q_boxcox_refined(spark: SparkSession, sf: str):
    """The operator's own search (six rounds of refinement), to the two digits that a grid of thousandths proves."""
    train = encode_frame(spark, sf).where(F.col("split") == "train").persist()
    try:
        lam, off = E.fit_boxcox(train, "sum_qty")
        llf = E.boxcox_llf(train, "sum_qty", lam, off)
    finally:
        train.unpersist()
    return rounded(spark.createDataFrame([(lam, llf)], "lambda double, llf double"), 2)


def _bc(x: str) -> str:
    return ("CASE WHEN (fit.lam) = 0 THEN CASE WHEN x + o > 0 THEN ln(x + o) END "
            "ELSE CASE WHEN x + o >= 0 THEN (pow(x + o, fit.lam) - 1.0) / fit.lam END END").replace("x", x)


@register("boxcox_apply", "WITH " + _LLF_SQL + f"SELECT row_id, split, round({_bc('sum_qty')}, 6) AS y_bc FROM ef, fit")
def q_boxcox_apply(spark: SparkSession, sf: str):
    ef, lam, off = grid_fit(spark, sf)
    return rounded(ef.select("row_id", "split", boxcox(F.col("sum_qty"), lam, off).alias("y_bc")))


def _inv(y: str) -> str:
    return (f"(CASE WHEN fit.lam = 0 THEN exp({y}) ELSE CASE WHEN fit.lam * ({y}) + 1.0 >= 0 "
            f"THEN pow(fit.lam * ({y}) + 1.0, 1.0 / fit.lam) END END - o)")


@register("boxcox_inverse", "WITH " + _LLF_SQL + f"SELECT row_id, round({_inv(_bc('sum_qty'))}, 6) AS y_back FROM ef, fit")
def q_boxcox_inverse(spark: SparkSession, sf: str):
    ef, lam, off = grid_fit(spark, sf)
    return rounded(ef.select("row_id", inv_boxcox(boxcox(F.col("sum_qty"), lam, off), lam, off).alias("y_back")))


_CL = ("CASE WHEN fit.lam > 0 THEN greatest(pred, -1.0 / fit.lam + 1e-6) WHEN fit.lam < 0 "
       "THEN least(pred, -1.0 / fit.lam - 1e-6) ELSE pred END")


@register("boxcox_clamp", "WITH " + _LLF_SQL + f""",
pr AS (SELECT row_id, ({_bc('sum_qty')}) * 3.0 - 40.0 AS pred FROM ef, fit)
SELECT row_id, round({_CL}, 6) AS pred_clamped, round({_inv(_CL)}, 6) AS pred_orig FROM pr, fit""")
def q_boxcox_clamp(spark: SparkSession, sf: str):
    ef, lam, off = grid_fit(spark, sf)
    pred = boxcox(F.col("sum_qty"), lam, off) * 3.0 - 40.0
    cl = clamp_boxcox_domain(pred, lam)
    return rounded(ef.select("row_id", cl.alias("pred_clamped"), inv_boxcox(cl, lam, off).alias("pred_orig")))


@register("neg_mse_original", "WITH " + _LLF_SQL + f""",
zt AS (SELECT row_id, split, sum_price, {_bc('sum_qty')} AS z FROM ef, fit),
cf AS (SELECT regr_intercept(z, sum_price) AS a, regr_slope(z, sum_price) AS b FROM zt WHERE split = 'train'),
pr AS (SELECT z, a + b * sum_price AS pred FROM zt, cf WHERE split = 'test')
SELECT round(max(fit.lam), 6) AS lambda, round(-avg(({_inv('z')} - {_inv(_CL)}) * ({_inv('z')} - {_inv(_CL)})), 6) AS neg_mse
FROM pr, fit""")
def q_neg_mse_original(spark: SparkSession, sf: str):
    """-MSE on the original scale of a model fitted on the Box-Cox target:
    prediction clamped into the inverse's domain, truth inverted exactly."""
    from relyframe.operators.mcr import neg_mse_original
    from relyframe.plans.q_mcr import univariate_ols
    ef, lam, off = grid_fit(spark, sf)
    d = ef.withColumn("z", boxcox(F.col("sum_qty"), lam, off))
    a, b = univariate_ols(d.where(F.col("split") == "train").select("z", "sum_price"), ["sum_price"], "z")["sum_price"]
    te = d.where(F.col("split") == "test")
    v = neg_mse_original(te, "z", F.lit(a) + F.lit(b) * F.col("sum_price"), lam, off)
    return rounded(spark.createDataFrame([(lam, v)], "lambda double, neg_mse double"))
