"""Single decision trees of all folds and parameters, grown side by side: a pass over the rows for each level.

One fit by fold and parameters reads, bins and caches its rows anew, so a search of 75 fits holds many copies of the
table. Here the rows are kept once, with one code for each feature (its place among the thresholds of all folds); a
pass adds up the bins of every open node of every tree, and each tree's best splits are found where its sums
meet. Rows are never copied by fold; nodes and thresholds come to the driver, rows don't.

Trees are those of Spark's ``DecisionTreeRegressor``: thresholds between about 32 bins of equal size, found on each
fold's own training rows (as there, on about 10,000 of them if there are more; the sums are over all rows), the split with the largest fall
of the variance (the first of equals), no child of fewer than ``minInstancesPerNode`` rows, none without gain.
"""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bins of a feature, rows on which thresholds are found, deepest tree that is grown here, rows added up at once.
BINS, BIN_ROWS, MAX_DEPTH, CHUNK = 32, 10_000, 10, 65_536
EPSILON = 2.0 ** -52
SPLIT = "tree int, node int, feature int, bin int, ln double, ls double, lq double, rn double, rs double, rq double"
SPLIT_NAMES = [c.split()[0] for c in SPLIT.split(", ")]


@dataclass
class Tree:
    """A tree by heap places (children of i: 2i + 1, 2i + 2); ``feature`` is -1 where a node isn't split."""
    repeat: int
    fold: int
    min_rows: int
    depth: int

    def __post_init__(self):
        size = 2 ** (self.depth + 1) - 1
        self.feature, self.bin = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.value, self.sums, self.open = np.zeros(size), {0: None}, [0]


def thresholds(values: np.ndarray, rows: float) -> np.ndarray:
    """Cuts of one feature: midpoints of all values, or of those that end a bin of about rows / BINS rows.

    As in Spark's fit, what lacks in the expected number of rows counts as zeros.
    """
    v, n = np.unique(values[values != 0], return_counts=True)
    n = n.astype(float)
    zeros = rows - n.sum()
    if zeros > 1e-9 * rows:
        at = np.searchsorted(v, 0.0)
        v, n = np.insert(v, at, 0.0), np.insert(n, at, zeros)
    mid = (v[:-1] + v[1:]) / 2.0
    splits = min(BINS, int(rows)) - 1
    if len(mid) <= splits:
        return mid
    stride = rows / (splits + 1)
    upto, goal, out = np.cumsum(n), stride, []
    for i in range(1, len(v)):
        if abs(upto[i - 1] - goal) < abs(upto[i] - goal):
            out.append(mid[i - 1])
            goal += stride
    return np.array(out)


def _drawn(d: DataFrame, share: float, seed: int) -> DataFrame:
    """The rows that Spark's fit with this seed draws for its thresholds: the same call on the same partitions."""
    spark = d.sparkSession
    number = spark.sparkContext._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    rows = d._jdf.toJavaRDD().sample(False, share, number)
    return DataFrame(spark._jsparkSession.createDataFrame(rows, d._jdf.schema()), spark)


def fold_thresholds(d: DataFrame, features: list[str], train_rows: dict, seed: int) -> dict:
    """{(repeat, fold): thresholds by feature}, on the rows outside the fold; about BIN_ROWS of them come to the driver."""
    most = max(BINS ** 2, BIN_ROWS)

    def one(key):
        r, f = key
        own, n = d.where(F.col(f"_fold{r}") != f).select(*features), train_rows[key]
        got = (own if n <= most else _drawn(own, most / n, seed)).toArrow()
        return [thresholds(got.column(i).to_numpy(), float(min(n, most))) for i in range(len(features))]

    with ThreadPool(8) as pool:
        return dict(zip(train_rows, pool.map(one, train_rows)))


def _chunks(batches, p: int, repeats: list[int]):
    """(codes by feature and row, label, folds by repeat) of about CHUNK rows."""
    held, n = [], 0

    def out():
        t = pa.Table.from_batches(held)
        return (np.stack([t.column(i).to_numpy() for i in range(p)]), t.column("_label").to_numpy(),
                {r: t.column(f"_fold{r}").to_numpy() for r in repeats})

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= CHUNK:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _step(at: np.ndarray, bins: np.ndarray, tree: Tree) -> np.ndarray:
    feature = tree.feature[at]
    right = bins[feature, np.arange(len(at))] > tree.bin[at]
    return np.where(feature < 0, at, 2 * at + 1 + right)


def _binned(codes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    return np.stack([t[c] for t, c in zip(tables, codes)])


def _best_splits(stats: np.ndarray, total, cuts: list[int], min_rows: int):
    """Best split of one node from its bins' (rows, sum, sum of squares): ((feature, bin, left, right) or None, the node's sums)."""
    best = None
    for f, m in enumerate(cuts):
        if not m:
            continue
        upto = np.cumsum(stats[f, :m + 1], axis=0)
        left, right = upto[:-1], upto[-1] - upto[:-1]
        if total is None:
            total = left[0] + right[0]
        with np.errstate(divide="ignore", invalid="ignore"):
            spread = [np.where(s[:, 0] > 0, (s[:, 2] - s[:, 1] * s[:, 1] / s[:, 0]) / s[:, 0], 0.0) for s in (left, right)]
            whole = left[:, 0] + right[:, 0]
            gain = (total[2] - total[1] * total[1] / total[0]) / total[0] \
                - left[:, 0] / whole * spread[0] - right[:, 0] / whole * spread[1]
        gain[(left[:, 0] < min_rows) | (right[:, 0] < min_rows) | ~(gain >= 0)] = -np.inf
        i = int(np.argmax(gain))
        if best is None or gain[i] > best[0]:
            best = (gain[i], f, i, left[i], right[i])
    return (best[1:] if best is not None and best[0] > 0 else None), total


def _spread(s: np.ndarray) -> float:
    return (s[2] - s[1] * s[1] / s[0]) / s[0]


def grow(d: DataFrame, features: list[str], trees: list[Tree], train_rows: dict, seed: int) -> dict[tuple[int, int], float]:
    """{(place in ``trees``, depth): mean squared error, on the fold left out, of the tree cut off at the depth}.

    Fills in ``trees``. ``d`` has the features, ``_label`` (all finite) and ``_fold0``... ; ``train_rows`` the rows outside each fold.
    """
    p, repeats = len(features), sorted({t.repeat for t in trees})
    cuts = fold_thresholds(d, features, train_rows, seed)
    union = [np.unique(np.concatenate([c[i] for c in cuts.values()])) for i in range(p)]
    # from the code of a row to its bin in a fold
    tables = {k: [np.concatenate(([0], np.cumsum(np.isin(u, c[i])))) for i, u in enumerate(union)] for k, c in cuts.items()}
    ends = {k: [len(x) for x in c] for k, c in cuts.items()}
    width = 1 + max(max(e) for e in ends.values())
    others = ["_label", *[f"_fold{r}" for r in repeats]]

    def coded(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(np.searchsorted(u, b.column(i).to_numpy(), "left").astype(np.int32)) for i, u in enumerate(union)],
                 *[b.column(c) for c in others]], [*[f"c{i}" for i in range(p)], *others])

    # few tasks, as each sends the bins of all open nodes
    tasks = max(1, 2 * d.sparkSession.sparkContext.defaultParallelism)
    rows = d.select(*features, *others).mapInArrow(
        coded, ", ".join([*[f"c{i} int" for i in range(p)], "_label double", *[f"_fold{r} int" for r in repeats]])).coalesce(tasks).persist()
    try:
        for level in range(max(t.depth for t in trees)):
            if not any(t.open for t in trees):
                break
            _one_level(rows, p, repeats, trees, tables, ends, width, level)
        return _held_out(rows, p, repeats, trees, tables)
    finally:
        rows.unpersist()


def _one_level(rows: DataFrame, p: int, repeats: list[int], trees: list[Tree], tables: dict, ends: dict, width: int,
               level: int) -> None:
    """Split the open nodes of all trees, which are on one level."""
    # trees of a fold that are equal so far share their sums
    alike: dict = {}
    for i, t in enumerate(trees):
        if t.open:
            alike.setdefault((t.repeat, t.fold, tuple(t.open), t.feature.tobytes(), t.bin.tobytes()), []).append(i)
    members, by_fold = {own[0]: own for own in alike.values()}, {}
    for i in members:
        by_fold.setdefault((trees[i].repeat, trees[i].fold), []).append(i)

    def add(batches):
        sums = {i: np.zeros((3, p, len(trees[i].open) * width)) for i in members}
        for codes, y, fold in _chunks(batches, p, repeats):
            for (r, f), own in by_fold.items():
                inside = fold[r] != f
                bins, label = _binned(codes[:, inside], tables[r, f]), y[inside]
                for i in own:
                    at = np.zeros(len(label), np.int64)
                    for _ in range(level):
                        at = _step(at, bins, trees[i])
                    slot = np.full(len(trees[i].feature), -1, np.int64)
                    slot[trees[i].open] = np.arange(len(trees[i].open))
                    slot = slot[at]
                    keep = slot >= 0
                    first, z = slot[keep] * width, label[keep]
                    weights = (None, z, z * z)
                    for c in range(p):
                        own_bin = first + bins[c, keep]
                        for s, w in enumerate(weights):
                            sums[i][s, c] += np.bincount(own_bin, w, sums[i].shape[2])
        part = TaskContext.get().partitionId()
        for i, s in sums.items():
            if s[0].any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([s.tobytes()], pa.binary())],
                                                 ["tree", "part", "sums"])

    def pick(key, table):
        own, stats = members[key[0].as_py()], 0.0
        for _, data in sorted(zip(table.column("part").to_pylist(), table.column("sums").to_pylist())):
            stats = stats + np.frombuffer(data)
        stats = stats.reshape(3, p, -1, width).transpose(2, 1, 3, 0)  # by node, feature, bin
        out = []
        for i in own:
            t = trees[i]
            for j, node in enumerate(t.open):
                found, total = _best_splits(stats[j], t.sums[node], ends[t.repeat, t.fold], t.min_rows)
                if found is not None:
                    out.append((i, node, *found[:2], *found[2].tolist(), *found[3].tolist()))
                if not node:  # the root's own sums
                    total = stats[j, 0].sum(axis=0) if total is None else total
                    out.append((i, -1, -1, -1, *total.tolist(), 0.0, 0.0, 0.0))
        cols = list(zip(*out)) if out else [[]] * len(SPLIT_NAMES)
        return pa.table([pa.array(c, pa.int32() if k < 4 else pa.float64()) for k, c in enumerate(cols)], names=SPLIT_NAMES)

    found = rows.mapInArrow(add, "tree int, part int, sums binary").groupBy("tree").applyInArrow(pick, SPLIT).collect()
    for t in trees:
        t.open = []
    for r in found:
        t = trees[r["tree"]]
        left, right = (np.array([r[f"{side}{c}"] for c in "nsq"]) for side in "lr")
        if r["node"] < 0:
            t.value[0] = left[1] / left[0]
            continue
        t.feature[r["node"]], t.bin[r["node"]] = r["feature"], r["bin"]
        for child, s in ((2 * r["node"] + 1, left), (2 * r["node"] + 2, right)):
            t.value[child], t.sums[child] = s[1] / s[0], s
            if level + 1 < t.depth and abs(_spread(s)) >= EPSILON:
                t.open.append(child)
    for t in trees:
        t.open.sort()


def _held_out(rows: DataFrame, p: int, repeats: list[int], trees: list[Tree], tables: dict) -> dict[int, list[float]]:
    depth = max(t.depth for t in trees)

    def run(batches):
        sums, n = np.zeros((len(trees), depth + 1)), np.zeros(len(trees), np.int64)
        for codes, y, fold in _chunks(batches, p, repeats):
            for i, t in enumerate(trees):
                held = fold[t.repeat] == t.fold
                bins, label = _binned(codes[:, held], tables[t.repeat, t.fold]), y[held]
                n[i] += len(label)
                at = np.zeros(len(label), np.int64)
                for level in range(t.depth + 1):
                    sums[i, level] += ((t.value[at] - label) ** 2).sum()
                    if level < t.depth:
                        at = _step(at, bins, t)
        i, level = np.indices(sums.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (i, level, sums, n[i])], ["tree", "level", "sse", "n"])

    got = rows.mapInArrow(run, "tree long, level long, sse double, n long").groupBy("tree", "level").agg(
        F.sum("sse").alias("sse"), F.sum("n").alias("n")).collect()
    return {(r["tree"], r["level"]): r["sse"] / r["n"] for r in got if r["n"]}
