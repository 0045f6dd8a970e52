"""Metrics, Rashomon set, permutation importance, model reliance (MR) and
model class reliance (MCR) intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relyframe.functions.boxcox import clamp_boxcox_domain, inv_boxcox
from relyframe.functions.hashing import hash_order
from relyframe.operators.ordered import exact_position
from relyframe.operators.stats import q


def regression_metrics(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """One aggregate: r2 = 1 - SSE/SST (null for a constant truth), rmse, mae (rows with both values)."""
    d = df.where(F.col(q(y)).isNotNull() & F.col(q(yhat)).isNotNull())
    e = F.col(q(y)) - F.col(q(yhat))
    # var_pop is updated around the running mean, so one pass keeps its precision
    return d.agg((F.lit(1.0) - F.try_divide(F.avg(e * e), F.var_pop(F.col(q(y)).cast("double")))).alias("r2"),
                 F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def original_scale(pred: Column, lam: float | None, offset: float = 0.0) -> Column:
    """Prediction back on the original scale: clamp into the inverse's domain,
    then inverse Box-Cox (identity when no transform was fitted)."""
    if lam is None:
        return pred
    return inv_boxcox(clamp_boxcox_domain(pred, lam), lam, offset)


def neg_mse_original(df: DataFrame, y_t: str, pred_t: Column, lam: float | None, offset: float = 0.0) -> float:
    """-MSE on the original scale: prediction clamped, truth inverted exactly."""
    truth = F.col(q(y_t)) if lam is None else inv_boxcox(F.col(q(y_t)), lam, offset)
    e = truth - original_scale(pred_t, lam, offset)
    return -float(df.agg(F.avg(e * e)).first()[0])


# ---------------------------------------------------------------- Rashomon

def rashomon_set(results: DataFrame, criterion: str = "r2", tol: float = 0.01,
                 r2_col: str = "test_r2", rmse_col: str = "test_rmse") -> DataFrame:
    """Models within tolerance of the best: R2 >= max - tol, or RMSE <= (1 + tol) * min.
    One-row aggregate cross-joined (broadcast) with the results table."""
    if criterion == "r2":
        best = results.agg(F.max(r2_col).alias("_b"))
        return results.crossJoin(F.broadcast(best)).where(F.col(r2_col) >= F.col("_b") - F.lit(tol)).drop("_b")
    best = results.agg(F.min(rmse_col).alias("_b"))
    return results.crossJoin(F.broadcast(best)).where(F.col(rmse_col) <= F.col("_b") * F.lit(1.0 + tol)).drop("_b")


def best_model(results: DataFrame, metric: str = "test_r2", maximize: bool = True, tie: str = "model") -> DataFrame:
    """Arg-max (or arg-min) row; ties go to the smallest ``tie`` value."""
    order = F.desc(metric) if maximize else F.asc(metric)
    return results.orderBy(order, F.asc(tie)).limit(1)


# ---------------------------------------------------------- permutations

def permute_column(df: DataFrame, col: str, seed: int, purpose: str = "perm", id_col: str = "row_id") -> DataFrame:
    """Shuffle one column: row at id-rank i takes the value of the row at
    hash-rank i (hash of seed|purpose|id). Exact global ranks from range
    partitions, so no single-task window; the multiset is unchanged."""
    base = df.select(id_col, col)
    by_id = exact_position(base.select(id_col), [], [id_col], pos_col="_r", total_col=None)
    by_h = exact_position(base.withColumn("_h", hash_order(seed, purpose, F.col(id_col))), [], ["_h", id_col],
                          pos_col="_r", total_col=None) \
        .select("_r", F.col(col).alias("_perm"))
    mapping = by_id.join(by_h, "_r").select(id_col, "_perm")
    return df.join(mapping, id_col).drop(col).withColumnRenamed("_perm", col)


def permuted_values(df: DataFrame, features: list[str], seed: int = 42, repeats: int = 1,
                    id_col: str = "row_id") -> DataFrame:
    """(id, feature, repeat, value): each feature shuffled over the rows, in every repeat.

    Row at id-rank i takes the value of the row at hash-rank i. The id ranks
    are found once; the hash ranks of all features and repeats come from one
    long table ranked by (feature, repeat).
    """
    by_id = exact_position(df.select(id_col), [], [id_col], pos_col="_r", total_col=None)
    cells = F.explode(F.array(*[
        F.struct(F.lit(f).alias("_feature"), F.lit(r).alias("_repeat"), F.col(q(f)).cast("double").alias("_value"),
                 hash_order(seed + r, f"perm|{f}", F.col(id_col)).alias("_h")) for f in features for r in range(repeats)]))
    long = df.select(id_col, cells.alias("c")).select(id_col, "c.*")
    by_h = exact_position(long, ["_feature", "_repeat"], ["_h", id_col], pos_col="_r", total_col=None).drop(id_col, "_h")
    return by_id.join(by_h, "_r").select(id_col, F.col("_feature").alias("feature"), F.col("_repeat").alias("repeat"),
                                         F.col("_value").alias("value"))


def permutation_losses(df: DataFrame, features: list[str], y: str, predict: Callable[[DataFrame], DataFrame],
                       seed: int = 42, repeats: int = 1, id_col: str = "row_id",
                       loss: Callable[[Column, Column], Column] | None = None, keys: list[str] = ()) -> DataFrame:
    """(keys, feature, repeat, loss) with each feature permuted in turn.

    All (feature, repeat) copies are one DataFrame, made by one join, scored by
    ``predict`` once (one ``transform`` for a Spark ML model, one projection for
    linear models) and reduced by one groupBy. ``predict`` must return the input
    columns plus ``prediction`` and, with several models, the ``keys`` columns.
    """
    loss = loss or (lambda t, p: (t - p) * (t - p))
    moved = permuted_values(df, features, seed, repeats, id_col).select(
        F.col(id_col).alias("_id"), F.col("feature").alias("_feature"), F.col("repeat").alias("_repeat"), F.col("value").alias("_v"))
    copies = moved.join(df, F.col("_id") == F.col(q(id_col))).select("_feature", "_repeat", *[
        F.when(F.col("_feature") == c, F.col("_v")).otherwise(F.col(q(c))).alias(c) if c in features else F.col(q(c))
        for c in df.columns])
    scored = predict(copies)
    return scored.groupBy(*keys, F.col("_feature").alias("feature"), F.col("_repeat").alias("repeat")) \
        .agg(F.avg(loss(F.col(q(y)), F.col("prediction"))).alias("loss"))


# ------------------------------------------------- fitted models as a table

MODEL_SCHEMA = "model string, feature_set string, features array<string>, intercept double, coefficients array<double>"


def save_benchmark(results: DataFrame, models: list[tuple], path: str) -> str:
    """Write the result table and the fitted linear models (rows of MODEL_SCHEMA, feature lists included)."""
    results.write.mode("overwrite").parquet(f"{path}/results")
    results.sparkSession.createDataFrame(models, MODEL_SCHEMA).write.mode("overwrite").parquet(f"{path}/models")
    return path


def load_models(results: DataFrame, path: str) -> list[tuple]:
    """The fitted models of the rows of ``results`` (a few, such as a Rashomon set), looked up by model and feature set."""
    saved = results.sparkSession.read.parquet(f"{path}/models")
    found = saved.join(results.select("model", "feature_set"), ["model", "feature_set"], "left_semi")
    return [tuple(r) for r in found.orderBy("model", "feature_set").collect()]


def linear_models(models: list[tuple], scale: Callable[[Column], Column] = lambda p: p,
                  moved: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """predict for several linear models: rows of the input for each model, with model, feature_set, used, prediction.

    With ``moved`` (a column that names the feature a row has permuted) a row is copied only for
    the models that use this feature.
    """
    def predict(d: DataFrame) -> DataFrame:
        out = []
        for model, feature_set, features, b0, coef in models:
            p = F.lit(float(b0))
            for f, b in zip(features, coef):
                p = p + F.lit(float(b)) * F.col(q(f)).cast("double")
            one = F.struct(F.lit(model).alias("model"), F.lit(feature_set).alias("feature_set"),
                           F.array(*[F.lit(f) for f in features]).alias("used"), scale(p).alias("prediction"))
            out.append(one if moved is None else F.when(F.col(moved).isin(*features), one))
        each = F.array(*out) if moved is None else F.array_compact(F.array(*out))
        return d.select("*", F.explode(each).alias("_m")).select(*[F.col(q(c)) for c in d.columns], "_m.*")
    return predict


def model_reliance(base: DataFrame, perm: DataFrame, keys: list[str] = ["model", "feature_set"]) -> DataFrame:
    """MR = e_perm / e_orig for each model and feature (mean over repeats).

    ``base`` holds (keys, loss), ``perm`` (keys, feature, loss). A model
    without baseline loss is skipped: its reliance is undefined.
    """
    per = perm.groupBy(*keys, "feature").agg(F.avg("loss").alias("_perm"))
    return per.join(base.where(F.col("loss") != 0).withColumnRenamed("loss", "_base"), keys).select(
        *keys, "feature", (F.col("_perm") / F.col("_base")).alias("mr"))


def mcr_intervals(mr: DataFrame) -> DataFrame:
    """MCR interval per feature over the models that used it."""
    return mr.groupBy("feature").agg(F.min("mr").alias("mcr_min"), F.max("mr").alias("mcr_max"))


def classify_reliance(mcr: DataFrame) -> DataFrame:
    """necessary: min > 1; redundant: min < 1; neither at exactly 1."""
    return mcr.withColumn("class", F.when(F.col("mcr_min") > 1.0, "necessary")
                          .when(F.col("mcr_min") < 1.0, "redundant").otherwise("neither"))


def top_reliance(mcr: DataFrame, n: int = 10, labels: DataFrame | None = None) -> DataFrame:
    """Top n by (mcr_min desc, mcr_max desc, feature asc) with display names
    (label table joined, falling back to the code itself)."""
    top = mcr.orderBy(F.desc("mcr_min"), F.desc("mcr_max"), F.asc("feature")).limit(n)
    if labels is not None:
        top = top.join(labels, top.feature == labels.code, "left") \
            .withColumn("display", F.coalesce(F.col("name"), F.col("feature"))).drop("code", "name")
    return top
