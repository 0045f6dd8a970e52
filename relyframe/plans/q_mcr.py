"""Reliance proofs (R1-R7, A7, A8, A15, S10, J3, T2-T4, C7): least-squares models of the Box-Cox order
quantity over every pair of seven features, scaled on the train split; metrics
and reliance on the original scale of the test split. The benchmark's results
and fitted models are written; the Rashomon set's models are looked up there."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.functions.boxcox import boxcox
from relyframe.functions.hashing import hash_order_sql, uniform_sql
from relyframe.functions.labels import MCR_LABELS, MI_LABELS, label_table, labels_sql, map_labels
from relyframe.operators import encode as E
from relyframe.operators import mcr as R
from relyframe.operators.clean import add_random_feature
from relyframe.operators.stats import column_means, gram_complete
from relyframe.plans.catalog import register, rounded
from relyframe.plans.q_split import SPLIT_SQL, split_frame
from relyframe.session import scratch_path

SEED = 42
FEATS = ["o_totalprice", "c_acctbal", "n_items", "sum_price", "avg_disc", "avg_tax", "random_feature"]
PAIRS = [(a, b) for i, a in enumerate(FEATS) for b in FEATS[i + 1:]]
Y = "sum_qty"


def reliance_frame(spark: SparkSession, sf: str, sp: DataFrame | None = None) -> DataFrame:
    sp = split_frame(spark, sf) if sp is None else sp
    return add_random_feature(sp, SEED).select("row_id", "split", F.col(Y).alias("y"),
                                               *[F.col(f).cast("double").alias(f) for f in FEATS]).persist()


def scaled_frame(spark: SparkSession, sf: str, sp: DataFrame | None = None):
    """(frame with scaled features and the Box-Cox target y_t, lambda, offset), fitted on train.

    ``sp`` is the split frame, where the caller has it.
    """
    from relyframe.plans.q_encode import BOXCOX_GRID
    rf = reliance_frame(spark, sf, sp)
    train = rf.where(F.col("split") == "train")
    lam, off = E.fit_boxcox(train, "y", grid=BOXCOX_GRID, refine_rounds=0)
    scale = E.fit_standardizer(train, FEATS)
    return rf.select("row_id", "split", "y", boxcox(F.col("y"), lam, off).alias("y_t"),
                     *[E.apply_standardizer(F.col(f), *scale[f]).alias(f) for f in FEATS]).persist(), lam, off


def univariate_ols(train: DataFrame, feats: list[str], y: str = "y") -> dict[str, tuple[float, float]]:
    """{feature: (intercept, slope)} for y ~ a + b x, all from one shifted Gram."""
    cols = [*feats, y]
    mu = column_means(train, cols)
    n, s, g = gram_complete(train, cols, mu)
    cov = g / n - np.outer(s, s) / (n * n)
    out = {}
    p = len(feats)
    for j, f in enumerate(feats):
        b = cov[j, p] / cov[j, j] if cov[j, j] > 0 else 0.0
        mx, my = mu[j] + s[j] / n, mu[p] + s[p] / n
        out[f] = (my - b * mx, b)
    return out


def pair_models(train: DataFrame) -> list[tuple]:
    """Rows of MODEL_SCHEMA: y_t ~ a + b x + c z for every pair, all from one shifted Gram."""
    cols = [*FEATS, "y_t"]
    mu = column_means(train, cols)
    n, s, g = gram_complete(train, cols, mu)
    cov, mean = g / n - np.outer(s, s) / (n * n), mu + s / n
    out = []
    for a, b in PAIRS:
        i = [FEATS.index(a), FEATS.index(b)]
        beta = np.linalg.lstsq(cov[np.ix_(i, i)], cov[i, -1], rcond=None)[0]
        out.append(("ols", f"{a}+{b}", [a, b], float(mean[-1] - mean[i] @ beta), [float(x) for x in beta]))
    return out


def benchmark(spark: SparkSession, sf: str):
    """(frame, scale of predictions, path): results of all models, written with the models, read back by the callers."""
    rf, lam, off = scaled_frame(spark, sf)
    models = pair_models(rf.where(F.col("split") == "train"))
    scale = lambda p: R.original_scale(p, lam, off)
    e = F.col("y") - F.col("prediction")
    met = R.linear_models(models, scale)(rf).groupBy("model", "feature_set", "split").agg(
        (F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop("y"))).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("loss"))
    test, train = (met.where(F.col("split") == s).drop("split") for s in ("test", "train"))
    res = test.join(train.select("model", "feature_set", F.col("r2").alias("train_r2")), ["model", "feature_set"]).select(
        "model", "feature_set", F.lit(2).alias("n_features"), F.lit("{}").alias("best_params"), "train_r2",
        F.col("r2").alias("test_r2"), F.col("rmse").alias("test_rmse"), F.col("mae").alias("test_mae"), "loss")
    path = R.save_benchmark(res, models, scratch_path(spark, "benchmark"))
    return rf, scale, path


def results_table(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{benchmark(spark, sf)[2]}/results")


def _base_sql() -> str:
    from relyframe.plans.q_encode import _LLF_SQL, _inv, _CL, _bc
    z = ", ".join(f"(CAST({f} AS DOUBLE) - (SELECT avg({f}) FROM rt)) / (SELECT stddev_pop({f}) FROM rt) AS {f}" for f in FEATS)
    feats = ", ".join(f"CAST({f} AS DOUBLE) AS {f}" for f in FEATS if f != "random_feature")
    cf = " UNION ALL ".join(
        f"SELECT 'ols' AS model, '{a}+{b}' AS feature_set, '{a}' AS f, '{b}' AS g, avg({a}) AS m1, avg({b}) AS m2, avg(y_t) AS m0, "
        f"var_pop({a}) AS a11, covar_pop({a}, {b}) AS a12, var_pop({b}) AS a22, covar_pop({a}, y_t) AS c1, covar_pop({b}, y_t) AS c2 "
        f"FROM rs WHERE split = 'train'" for a, b in PAIRS)
    pick = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{f}' THEN {f}" for f in FEATS) + " END"
    back = _inv(_CL)
    return "WITH " + _LLF_SQL + f""",
rf AS (SELECT row_id, split, sum_qty AS y, {feats}, {uniform_sql(SEED, 'random_feature', 'row_id')} AS random_feature FROM sp),
rt AS (SELECT * FROM rf WHERE split = 'train'),
rs AS (SELECT row_id, split, y, {_bc('y')} AS y_t, {z} FROM rf, fit),
cv AS ({cf}),
coef AS (SELECT *, (c1 * a22 - c2 * a12) / (a11 * a22 - a12 * a12) AS b1, (c2 * a11 - c1 * a12) / (a11 * a22 - a12 * a12) AS b2 FROM cv),
md AS (SELECT model, feature_set, f, g, m0 - b1 * m1 - b2 * m2 AS b0, b1, b2 FROM coef),
pt AS (SELECT model, feature_set, split, y, b0 + b1 * {pick('f')} + b2 * {pick('g')} AS pred FROM rs, md),
pr AS (SELECT model, feature_set, split, y, {back} AS p FROM pt, fit),
met AS (SELECT model, feature_set, split, 1.0 - avg((y - p) * (y - p)) / var_pop(y) AS r2, sqrt(avg((y - p) * (y - p))) AS rmse,
               avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS e_orig FROM pr GROUP BY ALL),
res AS (SELECT t.model, t.feature_set, 2 AS n_features, '{{}}' AS best_params, tr.r2 AS train_r2, t.r2 AS test_r2,
               t.rmse AS test_rmse, t.mae AS test_mae, t.e_orig
        FROM met t JOIN met tr USING (model, feature_set) WHERE t.split = 'test' AND tr.split = 'train'),
rash AS (SELECT * FROM res WHERE test_r2 >= (SELECT max(test_r2) FROM res) - 0.01),
te AS (SELECT * FROM rs WHERE split = 'test'),
lt AS (UNPIVOT (SELECT row_id, {', '.join(FEATS)} FROM te) ON {', '.join(FEATS)} INTO NAME feature VALUE x),
ri AS (SELECT *, row_number() OVER (ORDER BY row_id) AS r FROM te),
rh AS (SELECT feature, x AS xp, row_number() OVER (PARTITION BY feature ORDER BY
         CAST(('0x' || substr(md5('{SEED}|perm|' || feature || '|' || CAST(row_id AS VARCHAR)), 1, 13)) AS BIGINT), row_id) AS r FROM lt),
qm AS (SELECT model, feature_set, feature, y, b0 + b1 * CASE WHEN f = feature THEN xp ELSE {pick('f')} END
              + b2 * CASE WHEN g = feature THEN xp ELSE {pick('g')} END AS pred
       FROM ri JOIN rh USING (r) JOIN md ON feature IN (f, g)),
qp AS (SELECT model, feature_set, feature, y, {back} AS p FROM qm, fit),
eperm AS (SELECT model, feature_set, feature, avg((y - p) * (y - p)) AS e_perm FROM qp GROUP BY ALL),
mr AS (SELECT model, feature_set, feature, e_perm / e_orig AS mr FROM eperm JOIN res USING (model, feature_set) WHERE e_orig <> 0),
mcr AS (SELECT feature, min(mr) AS mcr_min, max(mr) AS mcr_max FROM mr JOIN rash USING (model, feature_set) GROUP BY feature)
"""


_BASE = _base_sql()
_RES_COLS = ("model, feature_set, n_features, best_params, round(train_r2, 6) AS train_r2, round(test_r2, 6) AS test_r2, "
             "round(test_rmse, 6) AS test_rmse, round(test_mae, 6) AS test_mae")


def _res(res):
    return rounded(res.select("model", "feature_set", "n_features", "best_params", "train_r2", "test_r2",
                              "test_rmse", "test_mae"))


@register("ols_coefficients", _BASE + " SELECT model, feature_set, round(b0, 6) AS intercept, round(b1, 6) AS slope_1, "
          "round(b2, 6) AS slope_2 FROM md")
def q_ols(spark: SparkSession, sf: str):
    """The fitted models, read back from the table that the benchmark wrote."""
    saved = spark.read.parquet(f"{benchmark(spark, sf)[2]}/models")
    return rounded(saved.select("model", "feature_set", "intercept", F.col("coefficients")[0].alias("slope_1"),
                                F.col("coefficients")[1].alias("slope_2")))


@register("regression_metrics", _BASE + f" SELECT {_RES_COLS} FROM res")
def q_metrics(spark: SparkSession, sf: str):
    return _res(results_table(spark, sf))


@register("rashomon_r2", _BASE + f" SELECT {_RES_COLS} FROM rash")
def q_rash_r2(spark: SparkSession, sf: str):
    return _res(R.rashomon_set(results_table(spark, sf), "r2", 0.01))


@register("rashomon_rmse", _BASE + f" SELECT {_RES_COLS} FROM res WHERE test_rmse <= (SELECT min(test_rmse) FROM res) * 1.1")
def q_rash_rmse(spark: SparkSession, sf: str):
    return _res(R.rashomon_set(results_table(spark, sf), "rmse", 0.10))


@register("best_model", _BASE + f" SELECT {_RES_COLS} FROM res ORDER BY test_r2 DESC, feature_set LIMIT 1")
def q_best(spark: SparkSession, sf: str):
    return _res(R.best_model(results_table(spark, sf), "test_r2", tie="feature_set"))


@register("top_models", _BASE + f" SELECT {_RES_COLS} FROM res ORDER BY test_r2 DESC, feature_set LIMIT 3")
def q_top(spark: SparkSession, sf: str):
    return _res(results_table(spark, sf).orderBy(F.desc("test_r2"), "feature_set").limit(3))


@register("permute_column", "WITH " + SPLIT_SQL + f""",
pt AS (SELECT row_id, CAST(sum_price AS DOUBLE) AS x FROM sp WHERE split = 'test'),
pi AS (SELECT row_id, row_number() OVER (ORDER BY row_id) AS r FROM pt),
ph AS (SELECT x, row_number() OVER (ORDER BY {hash_order_sql(SEED, 'perm|sum_price', 'row_id')}, row_id) AS r FROM pt)
SELECT row_id, x AS sum_price FROM pi JOIN ph USING (r)""")
def q_permute(spark: SparkSession, sf: str):
    rf = reliance_frame(spark, sf).where(F.col("split") == "test").select("row_id", "sum_price")
    return R.permute_column(rf, "sum_price", SEED, "perm|sum_price")


def reliance_table(spark: SparkSession, sf: str, survivors=lambda results: results):
    """(results, reliance of each surviving model on each feature it uses)."""
    rf, scale, path = benchmark(spark, sf)
    results = survivors(spark.read.parquet(f"{path}/results"))
    models = R.load_models(results, path)
    te = rf.where(F.col("split") == "test").select("row_id", "y", *FEATS)
    losses = R.permutation_losses(te, FEATS, "y", R.linear_models(models, scale, "_feature"), SEED, 1, keys=["model", "feature_set"])
    return results, R.model_reliance(results.select("model", "feature_set", "loss"), losses)


@register("model_reliance", _BASE + " SELECT model, feature_set, feature, round(mr, 6) AS mr FROM mr")
def q_mr(spark: SparkSession, sf: str):
    return rounded(reliance_table(spark, sf)[1])


def mcr_table(spark: SparkSession, sf: str) -> DataFrame:
    return R.mcr_intervals(reliance_table(spark, sf, lambda r: R.rashomon_set(r, "r2", 0.01))[1])


@register("mcr_intervals", _BASE + " SELECT feature, round(mcr_min, 6) AS mcr_min, round(mcr_max, 6) AS mcr_max FROM mcr")
def q_mcr(spark: SparkSession, sf: str):
    return rounded(mcr_table(spark, sf))


@register("mcr_classes", _BASE + """ SELECT feature, round(mcr_min, 6) AS mcr_min, round(mcr_max, 6) AS mcr_max,
  CASE WHEN mcr_min > 1.0 THEN 'necessary' WHEN mcr_min < 1.0 THEN 'redundant' ELSE 'neither' END AS class FROM mcr""")
def q_classes(spark: SparkSession, sf: str):
    return rounded(R.classify_reliance(mcr_table(spark, sf)))


@register("mcr_top10", _BASE + f""", lab AS (SELECT * FROM {labels_sql(MCR_LABELS)})
  SELECT feature, round(mcr_min, 6) AS mcr_min, round(mcr_max, 6) AS mcr_max, coalesce(name, feature) AS display
  FROM (SELECT * FROM mcr ORDER BY mcr_min DESC, mcr_max DESC, feature LIMIT 10) LEFT JOIN lab ON feature = code""")
def q_top10(spark: SparkSession, sf: str):
    return rounded(R.top_reliance(mcr_table(spark, sf), 10, label_table(spark, MCR_LABELS)))


@register("map_labels", "WITH " + SPLIT_SQL + f""", lab AS (SELECT * FROM {labels_sql(MI_LABELS)}),
  codes AS (SELECT DISTINCT 'cat__' || r_name AS code0 FROM sp UNION ALL SELECT 'num__random_feature' UNION ALL SELECT 'num__latitude')
  SELECT code0 AS feature, coalesce(name, code0) AS display FROM codes LEFT JOIN lab ON code0 = code""")
def q_map_labels(spark: SparkSession, sf: str):
    sp = split_frame(spark, sf)
    codes = sp.select(F.concat(F.lit("cat__"), F.col("r_name")).alias("feature")).distinct() \
        .unionByName(spark.createDataFrame([("num__random_feature",), ("num__latitude",)], "feature string"))
    return map_labels(codes, "feature", label_table(spark, MI_LABELS))


# --------------------------------------------------- Spark ML reliance (rows)

@register("permutation_importance")
def q_perm_importance(spark: SparkSession, sf: str):
    """Decision tree (whole grid, five folds) on the scaled features and Box-Cox target, then every
    feature permuted three times on the test split, scored on the original scale: all
    copies by one transform and one groupBy."""
    from relyframe.operators import trees as T
    rf, lam, off = scaled_frame(spark, sf)
    train, test = rf.where(F.col("split") == "train"), rf.where(F.col("split") == "test")
    fitted = T.search(train, FEATS, "y_t", "Decision Tree", repeats=1).fitted

    def predict(d):
        out = T.predict(fitted, d, FEATS, list(d.columns))
        return out.withColumn("prediction", R.original_scale(F.col("prediction"), lam, off)).withColumn("model", F.lit("tree"))
    te = test.select("row_id", "y", *FEATS)
    base = predict(te).groupBy("model").agg(F.avg((F.col("y") - F.col("prediction")) ** 2).alias("loss"))
    losses = R.permutation_losses(te, FEATS, "y", predict, SEED, 3, keys=["model"])
    return rounded(R.model_reliance(base, losses, ["model"]).drop("model"))


@register("mcr_both_families")
def q_mcr_both(spark: SparkSession, sf: str):
    """Reliance intervals over linear models and trees: benchmarked, stored, looked up again for the Rashomon set
    (R2 within 0.05 of the best), each model scored with its own features permuted."""
    from relyframe.operators import benchmark as B
    from relyframe.operators.models import LINEAR_GRIDS
    rf, lam, off = scaled_frame(spark, sf)
    scale = lambda p: R.original_scale(p, lam, off)
    test = rf.where(F.col("split") == "test")
    path = scratch_path(spark, "both")
    found = B.run(B.Setup(rf.where(F.col("split") == "train"), test, "y", "y_t", scale, repeats=1),
                  {"all": FEATS, "prices": ["o_totalprice", "n_items", "sum_price"]}, [*LINEAR_GRIDS, "Decision Tree"], path)
    near = R.rashomon_set(found.where("error IS NULL"), "r2", 0.05)
    linear, trees = B.load_models(near, path)
    losses = R.permutation_losses(test.select("row_id", "y", *FEATS), FEATS, "y", B.mixed_models(linear, trees, scale, "_feature"),
                                  SEED, 1, keys=["model", "feature_set"])
    mr = R.model_reliance(near.select("model", "feature_set", "loss"), losses)
    by = R.classify_reliance(R.mcr_intervals(mr))
    return rounded(by.join(mr.groupBy("feature").agg(F.count("*").alias("n_models")), "feature"))
