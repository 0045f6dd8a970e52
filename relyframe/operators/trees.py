"""Tree models: grid search that shares fits, recursive elimination, stored models.

Several grid points are read off one fit. A tree grown to depth 8 cut off at
depth 4 is the tree grown to depth 4, since nodes are split level by level; the
first 100 rounds of a boosted ensemble are the ensemble of 100 rounds; the first
200 trees of a forest are a forest of 200 trees (drawn as independently as any
other, though not with the draws that a separate fit of 200 would make). So a
search fits each fold once for each combination of the other parameters,
and scores all points of the combination on the held-out rows in one pass.
Over more than ``SPARK_ROWS`` rows forests of the folds and of recursive elimination are grown by
``forests``, with draws of their own; the forest that a search returns is Spark's. Boosting of the folds is done by ``boosted``, with draws
of its own, up to its number of rows; the ensemble that a search returns is Spark's.

Rows need finite features and target; with others Spark's own fits are made. A fold without rows on either side counts
for nothing.
"""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.functions.hashing import uniform
from relyframe.functions.missing import is_finite
from relyframe.operators import boosted as Bo
from relyframe.operators import forests as Fo
from relyframe.operators import grown as G
from relyframe.operators.stats import q
from relyframe.session import scratch_path

# The benchmark's hyper-parameter grids for the tree family.
TREE_GRIDS = {
    "Decision Tree": {"maxDepth": [3, 4, 6, 8], "minInstancesPerNode": [2, 5, 10]},
    "Random Forest": {"numTrees": [200, 300], "maxDepth": [4, 5, 6], "minInstancesPerNode": [5, 8]},
    "Gradient Boosting": {"maxIter": [100, 200], "stepSize": [0.05, 0.1], "maxDepth": [3, 4, 5],
                          "minInstancesPerNode": [5, 10], "subsamplingRate": [0.8, 0.9]},
}
#: Settings of other boosting libraries as far as Spark's boosting has them (no leaf penalties, no leaf count).
PRESET_GRIDS = {
    "GBT (histogram settings)": {"maxIter": [100], "stepSize": [0.05, 0.1], "maxDepth": [3, 4, 5], "minInstancesPerNode": [5, 10]},
    "GBT (row and column samples)": {"maxIter": [100, 200], "stepSize": [0.05, 0.1], "maxDepth": [3, 4, 5],
                                     "subsamplingRate": [0.8, 0.9], "featureSubsetStrategy": ["0.8", "0.9"]},
    "GBT (column samples)": {"maxIter": [100, 200], "stepSize": [0.05, 0.1], "minInstancesPerNode": [5, 10],
                             "featureSubsetStrategy": ["0.8", "0.9"]},
}
GRIDS = TREE_GRIDS | PRESET_GRIDS
BOOSTING = ["Gradient Boosting", *PRESET_GRIDS]
#: Parameters whose smaller values are read off the fit with the largest.
SHARED = {"Decision Tree": ("maxDepth",), "Random Forest": ("maxDepth", "numTrees"), "boosting": ("maxIter",)}
#: Rows that are scored at once, and rows for which a fit gets a task of its own.
SLICE, TASK_ROWS = 2_000, 20_000
#: Up to so many rows folds and elimination take Spark's forests, with its draws.
SPARK_ROWS = 20_000
#: What a forest has where a point doesn't say it.
FOREST = {"numTrees": 20, "maxDepth": 5, "minInstancesPerNode": 1}


def estimator(model: str, seed: int):
    from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
    cols = {"seed": seed, "featuresCol": "_features", "labelCol": "_label"}
    if model == "Decision Tree":
        return DecisionTreeRegressor(**cols)
    if model == "Random Forest":
        return RandomForestRegressor(featureSubsetStrategy="sqrt", **cols)
    if model == "Gradient Boosting" or model.startswith("GBT"):
        return GBTRegressor(**cols)
    raise ValueError(f"no estimator is known for {model!r}")


def grid_points(grid: dict) -> list[dict]:
    keys = sorted(grid)
    return [dict(zip(keys, v)) for v in itertools.product(*[grid[k] for k in keys])]


def shared_fits(model: str, points: list[dict]) -> list[tuple[dict, list[int]]]:
    """(parameters of one fit, the points that are read off it), over all points."""
    shared = SHARED.get(model, SHARED["boosting"])
    groups: dict[str, list[int]] = {}
    for i, p in enumerate(points):
        groups.setdefault(json.dumps({k: v for k, v in p.items() if k not in shared}, sort_keys=True), []).append(i)
    out = []
    for own in groups.values():
        top = dict(points[own[0]])
        for k in shared:
            values = [points[i][k] for i in own if k in points[i]]
            if values:
                top[k] = max(values)
        out.append((top, own))
    return out


# ------------------------------------------------------------ nodes of a fit

@dataclass
class Nodes:
    """All trees of a fit as arrays; ``roots`` has the first node of each tree. Leaves are their own children."""
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


def nodes_of(spark, model) -> Nodes:
    """The nodes of a fitted tree or forest, by way of its saved form (which also has the means of inner nodes)."""
    at = scratch_path(spark, "tree")
    model.write().save(at)
    saved = spark.read.parquet(f"{at}/data")
    if "nodeData" in saved.columns:
        saved = saved.select("treeID", "nodeData.*")
    else:
        saved = saved.withColumn("treeID", F.lit(0))
    t = saved.select("treeID", "id", "leftChild", "rightChild", "prediction", F.col("split.featureIndex").alias("feature"),
                     F.try_element_at("split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold")) \
        .orderBy("treeID", "id").toArrow()
    tree, node = t.column("treeID").to_numpy(), t.column("id").to_numpy()
    roots = np.flatnonzero(node == 0)
    base = roots[np.searchsorted(tree[roots], tree)]
    own = np.arange(len(node))
    left, right = t.column("leftChild").to_numpy(), t.column("rightChild").to_numpy()
    leaf = left < 0
    return Nodes(roots, np.where(leaf, 0, t.column("feature").to_numpy()),
                 np.where(leaf, 0.0, t.column("threshold").to_numpy(zero_copy_only=False)),
                 np.where(leaf, own, base + left), np.where(leaf, own, base + right), t.column("prediction").to_numpy())


def staged_predictions(nodes: Nodes, x: np.ndarray, depths: list[int], counts: list[int]):
    """(depth, count, predictions): the mean of the first ``count`` trees cut off at ``depth``, for each of both."""
    at = np.repeat(nodes.roots[:, None], len(x), axis=1)
    rows = np.arange(len(x))[None, :]
    for step in range(max(depths) + 1):
        if step in depths:
            values = nodes.value[at]
            for n in counts:
                yield step, n, values[:n].mean(axis=0)
        at = np.where(x[rows, nodes.feature[at]] <= nodes.threshold[at], nodes.left[at], nodes.right[at])


def _staged_errors(held: DataFrame, nodes: Nodes, features: list[str], points: list[dict], own: list[int]) -> dict[int, float]:
    """Mean squared error on ``held`` of each point that is read off one fit."""
    depths = sorted({points[i]["maxDepth"] for i in own if "maxDepth" in points[i]}) or [64]
    counts = sorted({points[i].get("numTrees", len(nodes.roots)) for i in own})
    place = {(points[i].get("maxDepth", depths[0]), points[i].get("numTrees", len(nodes.roots))): i for i in own}

    def run(batches):
        sums, n = dict.fromkeys(place.values(), 0.0), 0
        for pdf in batches:
            for at in range(0, len(pdf), SLICE):
                part = pdf.iloc[at:at + SLICE]
                x, y = part[features].to_numpy(float), part["_label"].to_numpy(float)
                for depth, count, p in staged_predictions(nodes, x, depths, counts):
                    if (i := place.get((depth, count))) is not None:
                        sums[i] += float(((p - y) ** 2).sum())
                n += len(part)
        yield pd.DataFrame({"point": list(sums), "sse": list(sums.values()), "n": n})

    rows = held.select(*features, "_label").mapInPandas(run, "point long, sse double, n long") \
        .groupBy("point").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n")).collect()
    return {r["point"]: r["sse"] / r["n"] for r in rows if r["n"]}


# ------------------------------------------------------------------- search

@dataclass
class Search:
    model: str
    features: list[str]
    fitted: object
    params: dict
    cv_neg_mse: float
    #: (parameters, mean -MSE) of every point.
    points: list[tuple[dict, float]]
    fits: int


def assembled(df: DataFrame, features: list[str], keep: list) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=features, outputCol="_features").transform(df.select(*keep))


def _not_finite(features: list[str]):
    bad = ~is_finite(F.col("_label"))
    for f in features:
        bad = bad | ~is_finite(F.col(q(f)))
    return F.coalesce(bad, F.lit(True))


def _forest_errors(rows: Fo.Rows, fold: tuple[int, int], features: list[str], fits: list, points: list[dict], seed: int) -> dict[int, float]:
    """Mean squared error of each point on a fold, from the forests of all ``fits``."""
    full = [FOREST | p for p in points]
    min_rows = [(FOREST | top)["minInstancesPerNode"] for top, _ in fits]
    depths, counts = (sorted({p[c] for p in full}) for c in ("maxDepth", "numTrees"))
    grown = Fo.Forests(rows, fold, list(range(len(features))), min_rows, counts[-1], depths[-1],
                       math.ceil(math.sqrt(len(features))), seed).grow()
    mse = grown.held_out(depths, counts)
    return {i: mse[v, full[i]["maxDepth"], full[i]["numTrees"]] for v, (_, own) in enumerate(fits) for i in own}


def search(train: DataFrame, features: list[str], target: str, model: str, grid: list[dict] | None = None, k: int = 5,
           repeats: int = 5, seed: int = 42, id_col: str = "row_id", parallelism: int = 8) -> Search:
    """Repeated cross-validation of a grid over hashed folds; the best point (the first of equals) is fitted on all rows.

    Fits of a fold run side by side, ``parallelism`` at a time; single trees of all folds are grown together (``grown``), and so are
    the forests of a fold (``forests``); fits of boosting are shared out over the cores (``boosted``). A point's score is the mean of its folds' -MSE.
    """
    spark = train.sparkSession
    est = estimator(model, seed)
    points = grid_points(GRIDS[model]) if grid is None else grid
    keep = [id_col, *[F.col(q(f)).cast("double").alias(f) for f in features], F.col(q(target)).cast("double").alias("_label"),
            *[F.floor(uniform(seed, f"fold{r}", F.col(q(id_col))) * F.lit(k)).cast("int").alias(f"_fold{r}") for r in range(repeats)]]
    # fits run side by side, so a small table needs few tasks in each
    d = assembled(train, features, keep).coalesce(max(1, -(-train.count() // TASK_ROWS))).persist()
    try:
        sizes = d.groupBy().agg(*[F.count_if(F.col(f"_fold{r}") == f).alias(f"n{r}_{f}") for r in range(repeats) for f in range(k)],
                                F.count("*").alias("all"), F.count_if(_not_finite(features)).alias("bad")).first()
        folds = [(r, f) for r in range(repeats) for f in range(k) if 0 < sizes[f"n{r}_{f}"] < sizes["all"]]

        def one(job):
            (r, f), (top, own) = job
            fitted = est.copy({est.getParam(name): v for name, v in top.items()}).fit(d.where(F.col(f"_fold{r}") != f))
            held = d.where(F.col(f"_fold{r}") == f)
            if "maxIter" in top:
                losses = fitted.evaluateEachIteration(held, "squared")
                return {i: losses[min(points[i]["maxIter"], len(losses)) - 1] for i in own}
            return _staged_errors(held, nodes_of(spark, fitted), features, points, own)

        def coded_rows():
            hashed = d.withColumn("_hash", F.xxhash64(F.lit(seed), F.col(q(id_col)), *[F.col(q(f)) for f in features], F.col("_label")))
            return Fo.Rows(hashed, features, {(r, f): sizes["all"] - sizes[f"n{r}_{f}"] for r, f in folds}, seed)

        jobs = list(itertools.product(folds, shared_fits(model, points)))
        scores: list[list[float]] = [[] for _ in points]
        if model == "Decision Tree" and not sizes["bad"] and jobs and all(
                set(p) == {"maxDepth", "minInstancesPerNode"} and 0 < p["maxDepth"] <= G.MAX_DEPTH for p in points):
            grown = [G.Tree(r, f, top["minInstancesPerNode"], top["maxDepth"]) for (r, f), (top, _) in jobs]
            mse = G.grow(d, features, grown, {(r, f): sizes["all"] - sizes[f"n{r}_{f}"] for r, f in folds}, seed)
            for j, (_, (_, own)) in enumerate(jobs):
                for i in own:
                    scores[i].append(mse[j, points[i]["maxDepth"]])
        elif model == "Random Forest" and sizes["all"] > SPARK_ROWS and not sizes["bad"] and jobs and all(
                set(p) <= set(FOREST) and 0 < (FOREST | p)["maxDepth"] <= G.MAX_DEPTH for p in points):
            rows = coded_rows()
            try:
                with ThreadPool(max(1, parallelism)) as pool:
                    fits = shared_fits(model, points)
                    for found in pool.imap(lambda fold: _forest_errors(rows, fold, features, fits, points, seed), folds):
                        for i, mse in found.items():
                            scores[i].append(mse)
            finally:
                rows.close()
        elif model in BOOSTING and sizes["all"] <= Bo.ROWS and not sizes["bad"] and jobs and all(Bo.takes(p) for p in points):
            rows = coded_rows()
            rounds = [(Bo.BOOST | p)["maxIter"] for p in points]
            try:
                found = Bo.held_out(rows, [(fold, top, sorted({rounds[i] for i in own})) for fold, (top, own) in jobs], seed)
                for mse, (_, (_, own)) in zip(found, jobs):
                    for i in own:
                        scores[i].append(mse[rounds[i]])
            finally:
                rows.close()
        else:
            with ThreadPool(max(1, parallelism)) as pool:
                for found in pool.imap(one, jobs):
                    for i, mse in found.items():
                        scores[i].append(mse)
        mean = [float(np.mean(s)) if s else float("inf") for s in scores]
        best = int(np.argmin(mean))
        fitted = est.copy({est.getParam(name): v for name, v in points[best].items()}).fit(d)
    finally:
        d.unpersist()
    return Search(model, list(features), fitted, points[best], -mean[best], [(p, -m) for p, m in zip(points, mean)], len(jobs))


def predict(fitted, df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """``keep`` columns and prediction."""
    rows = assembled(df, features, [*keep, *[f for f in features if f not in keep]])
    return fitted.transform(rows).select(*keep, F.col("prediction"))


def recursive_elimination(train: DataFrame, features: list[str], target: str, keep: int, step: int = 1,
                          num_trees: int = 150, seed: int = 42) -> list[tuple[str, int]]:
    """(feature, features left when it went; 0 for the kept ones): forest importances,
    the ``step`` least important features (name order on ties) go in each round."""
    left, gone = list(features), []
    rows = train.select(*[F.col(q(f)) for f in features], F.col(q(target)).cast("double").alias("_label"),
                        F.xxhash64(F.lit(seed), *[F.col(q(c)) for c in train.columns]).alias("_hash"), F.lit(1).alias("_fold0")).persist()
    try:
        n, bad = rows.agg(F.count("*"), F.count_if(_not_finite(features))).first()
        if bad or n <= SPARK_ROWS:  # rows that aren't finite are for Spark's fit to take or refuse
            importances, close = lambda left: _spark_importances(rows, left, num_trees, seed), lambda: None
        elif len(left) > keep:
            own = [F.col(q(f)).cast("double").alias(f) for f in features]
            data = Fo.Rows(rows.select(*own, "_label", "_hash", "_fold0"), features, {(0, 0): n}, seed)
            rows.unpersist()
            importances, close = lambda left: _importances(data, features, left, num_trees, seed), data.close
        else:
            close = lambda: None
        try:
            while len(left) > keep:
                by = dict(zip(left, importances(left)))
                for f in sorted(left, key=lambda f: (by[f], f))[: min(step, len(left) - keep)]:
                    gone.append((f, len(left)))
                    left.remove(f)
        finally:
            close()
    finally:
        rows.unpersist()
    return gone + [(f, 0) for f in left]


def _importances(data: Fo.Rows, features: list[str], left: list[str], num_trees: int, seed: int) -> np.ndarray:
    """By a forest with Spark's settings: depth 5, a third of the features for a node."""
    own = [features.index(f) for f in left]
    return Fo.Forests(data, (0, 0), own, [FOREST["minInstancesPerNode"]], num_trees, FOREST["maxDepth"], -(-len(left) // 3), seed) \
        .grow().importances()


def _spark_importances(rows: DataFrame, left: list[str], num_trees: int, seed: int) -> np.ndarray:
    from pyspark.ml.regression import RandomForestRegressor
    return RandomForestRegressor(numTrees=num_trees, seed=seed, featuresCol="_features", labelCol="_label").fit(
        assembled(rows, left, [*left, "_label"])).featureImportances.toArray()
