"""Seeded train/test splits and cross-validation folds.

All draws are md5 uniforms of (seed, purpose, row_id): the same rows land
in the same split for any partitioning, rerun or engine.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.functions.hashing import hash_order, uniform
from relyframe.functions.missing import is_finite
from relyframe.operators.ordered import exact_position
from relyframe.operators.stats import q


def class_key(col: str) -> F.Column:
    """The stratification class of a double target: the value itself
    (-0.0 and 0.0 are one class)."""
    return (F.col(col).cast("double") + F.lit(0.0)).alias("_class")


def drop_rare_classes(df: DataFrame, key: str, min_count: int = 2) -> DataFrame:
    """Drop rows whose class has fewer than ``min_count`` rows (anti-join on the
    small list of rare classes; the class count is a partial aggregate)."""
    d = df.withColumn("_class", class_key(key))
    rare = d.groupBy("_class").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") < min_count).select("_class")
    return d.join(rare, on="_class", how="left_anti").drop("_class")


def _test_count(n: int, test_size: float) -> int:
    return int(math.ceil(test_size * n))


def stratified_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42,
                     id_col: str = "row_id") -> DataFrame:
    """Exact stratified split; adds ``split`` in {'train','test'}.

    n_test = ceil(test_size * n). Per class train quota = floor(c * n_train / n),
    then the classes with the largest remainders (exact integer remainders,
    ties by a hash of the class) get one more until quotas sum to n_train.
    Inside each class, rows ordered by md5(seed|split|row_id) fill the quota.
    Quotas are exact integers of 38 digits. Rows without a target are a class of
    their own. Hot classes are numbered over range partitions, never in one task.
    """
    d = df.withColumn("_class", class_key(key))
    classes = d.groupBy("_class").agg(F.count(F.lit(1)).alias("_c")).persist()
    tot = classes.agg(F.sum("_c").alias("n"), F.count(F.lit(1)).alias("k")).first()
    n = int(tot["n"] or 0)
    n_test = _test_count(n, test_size)
    n_train = n - n_test
    if n_test < tot["k"] or n_train < tot["k"]:
        classes.unpersist()
        raise ValueError("stratified split impossible: fewer test/train rows than classes")
    num = F.col("_c").cast("decimal(19,0)") * F.lit(n_train).cast("decimal(19,0)")
    whole = F.lit(n).cast("decimal(38,0)")
    rem = num.cast("decimal(38,0)") % whole
    cls = classes.select("_class", "_c", num.alias("_num"), rem.alias("_rem"),
                         hash_order(seed, "class", F.expr("try_cast(round(_class * 1e6) AS decimal(38,0))")).alias("_h"))
    cls = cls.withColumn("_fl", F.expr(f"cast(_num AS decimal(38,0)) div cast({n} AS decimal(38,0))").cast("bigint"))
    short = n_train - int(cls.agg(F.sum("_fl")).first()[0] or 0)
    ranked = exact_position(cls.withColumn("_neg", -F.col("_rem")), [], ["_neg", "_h", "_class"],
                            pos_col="_r", total_col=None)
    quota = ranked.select(F.col("_class").alias("_q"), (F.col("_fl") + F.when(F.col("_r") < F.lit(short), 1).otherwise(0))
                          .alias("_quota"))
    rows = d.withColumn("_h", hash_order(seed, "split", F.col(id_col)))
    rows = exact_position(rows, ["_class"], ["_h", id_col], pos_col="_p", total_col=None)
    out = rows.join(quota, F.col("_class").eqNullSafe(F.col("_q")), "inner") \
        .withColumn("split", F.when(F.col("_p") < F.col("_quota"), F.lit("train")).otherwise(F.lit("test"))) \
        .drop("_class", "_h", "_p", "_quota", "_q")
    classes.unpersist()
    return out


def random_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, id_col: str = "row_id") -> DataFrame:
    """Exact-size random split: global rank by md5 hash; the first n_train are train."""
    n = df.count()
    n_train = n - _test_count(n, test_size)
    rows = df.withColumn("_h", hash_order(seed, "split", F.col(id_col)))
    rows = exact_position(rows, [], ["_h", id_col], pos_col="_p", total_col=None)
    return rows.withColumn("split", F.when(F.col("_p") < F.lit(n_train), F.lit("train")).otherwise(F.lit("test"))) \
        .drop("_h", "_p")


def split_with_fallback(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42,
                        id_col: str = "row_id") -> DataFrame:
    """Stratified when possible (explicit precondition check), else random."""
    try:
        return stratified_split(df, key, test_size, seed, id_col)
    except ValueError:
        return random_split(df, test_size, seed, id_col)


def assign_folds(df: DataFrame, k: int = 5, repeats: int = 5, seed: int = 42,
                 id_col: str = "row_id") -> DataFrame:
    """Repeated K-fold as columns fold_0..fold_{repeats-1}: floor(u(seed,repeat,row_id) * k).
    A projection only -- no sort, no shuffle; fold sizes are binomial."""
    return df.select("*", *[F.floor(uniform(seed, f"fold{r}", F.col(id_col)) * F.lit(k)).cast("int").alias(f"fold_{r}")
                            for r in range(repeats)])


def _dealt(loads: np.ndarray, size: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the greedy rule puts a group: (fold, load of that fold before).

    Groups of one size are dealt one after another to the lightest fold (the lowest on ties), so fold f
    takes one whenever its load, load[f] + i * size, is the next in the order of (load, fold). The group at
    ``place`` meets the load t that is the (place + 1)-th smallest of these, found by bisection. One row of
    ``loads`` for each group.
    """
    low, high = loads.min(axis=1), loads.min(axis=1) + size * place
    one = size[:, None]

    def upto(t):  # loads met at or below t
        return np.where(loads <= t[:, None], (t[:, None] - loads) // one + 1, 0)

    while (low < high).any():
        mid = (low + high) // 2
        enough = upto(mid).sum(axis=1) > place
        low, high = np.where(enough, low, mid + 1), np.where(enough, mid, high)
    below = upto(low - 1).sum(axis=1)
    meets = (loads <= low[:, None]) & ((low[:, None] - loads) % one == 0)
    return ((np.cumsum(meets, axis=1) <= (place - below)[:, None]).sum(axis=1)), low


def assign_group_folds(spark: SparkSession, df: DataFrame, group_col: str, k: int = 5) -> tuple[DataFrame, int]:
    """Group K-fold: n_splits = min(k, groups); groups by size desc go to the
    currently lightest fold (lowest index on ties).

    Groups of equal size are dealt by a rule (see ``_dealt``), so only the distinct sizes come
    to the driver, with the loads that each of them meets: at most the root of twice the rows. A group's
    place among its equals is its exact position over all partitions. The fold map is joined back
    by group. Rows without a group are a group of their own.
    """
    sizes = df.groupBy(F.col(q(group_col)).alias("_g")).agg(F.count(F.lit(1)).alias("_c"))
    sizes = sizes.checkpoint(eager=True)
    classes = sizes.groupBy("_c").agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("_c")).collect()
    splits = min(k, sum(r["m"] for r in classes))
    if splits < 2:
        return df.withColumn("fold", F.lit(None).cast("int")), splits
    loads, rows = np.zeros((1, splits), np.int64), []
    for r in classes:
        c, m = np.array([r["_c"]], np.int64), r["m"]
        rows.append((r["_c"], loads[0].tolist()))
        # the load of the last group dealt tells how many every fold has had
        fold, t = _dealt(loads, c, np.array([m - 1], np.int64))
        n = np.where(loads[0] < t, (t - 1 - loads[0]) // c + 1, 0)
        n += (loads[0] <= t) & ((t - loads[0]) % c == 0) & (np.arange(splits) <= fold)
        loads = loads + n * c
    gtype = df.schema[group_col].dataType.simpleString()
    table = spark.createDataFrame(rows, "_c long, _loads array<long>")
    placed = exact_position(sizes.withColumn("_s", F.col("_g").cast("string")), ["_c"], ["_s"], pos_col="_at", total_col=None)

    def deal(batches):
        for pdf in batches:
            if len(pdf):
                fold, _ = _dealt(np.stack(pdf["_loads"].to_numpy()).astype(np.int64), pdf["_c"].to_numpy(np.int64),
                                 pdf["_at"].to_numpy(np.int64))
                yield pdf[["_g"]].assign(fold=fold.astype(np.int32))

    fmap = placed.join(table, "_c").select("_g", "_c", "_at", "_loads").mapInPandas(deal, f"_g {gtype}, fold int")
    return df.join(fmap, F.col(q(group_col)).eqNullSafe(F.col("_g")), "left").drop("_g"), splits


def nearest_centre(df: DataFrame, cols: list[str], centres: list[list[float]], out_col: str = "spatial_group") -> DataFrame:
    """Index of the nearest centre (lowest on ties); null where a coordinate is missing."""
    dist = F.array(*[sum(((F.col(q(c)).cast("double") - F.lit(float(v))) ** 2 for c, v in zip(cols, centre)), F.lit(0.0))
                     for centre in centres])
    present = F.lit(True)
    for c in cols:
        present = present & is_finite(F.col(q(c)).cast("double"))
    return df.withColumn(out_col, F.when(present, (F.array_position(dist, F.array_min(dist)) - 1).cast("int")))


def spatial_groups(df: DataFrame, cols: list[str], k: int = 5, seed: int = 42,
                   out_col: str = "spatial_group") -> DataFrame:
    """k-means cluster id on raw coordinates: Spark ML fits the centres on the
    complete rows, a projection assigns every row; rows with a missing
    coordinate stay, without a group."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    present = df.where(~F.greatest(*[(~is_finite(F.col(q(c)).cast("double"))).cast("int") for c in cols]).cast("boolean"))
    va = VectorAssembler(inputCols=cols, outputCol="_xy", handleInvalid="skip")
    model = KMeans(k=k, seed=seed, featuresCol="_xy").fit(va.transform(present.select(*[F.col(q(c)).cast("double").alias(c) for c in cols])))
    return nearest_centre(df, cols, [list(map(float, c)) for c in model.clusterCenters()], out_col)
