"""Random forests of a fold, grown together: a pass over the rows for each level of all their trees.

Spark ML's fit keeps one count for each row and tree (1.2 KB a row for 300 trees) and every fold's fit keeps its own, so
a search over folds spills long before its rows are many. Here rows are kept once, as bin codes with one 64-bit hash; how often a tree draws a row
follows from the hash and the tree and is never stored. A pass adds up the bins of every open node in numpy, each tree's best
splits are found where its sums meet, and only splits come to the driver. A pass takes as many trees as ``PASS_BYTES`` hold.

A forest is that of Spark's ``RandomForestRegressor``: Poisson(1) draws of the rows (to 1 / 65,536), some features drawn
for each node, thresholds between about 32 bins of equal size found as by that fit, the split with the largest fall of the variance,
no child of fewer than ``min_rows`` drawn rows, none without gain. The draws are others than Spark's (those depend on the
partitions); they depend on the seed and the row's values alone. Equal rows of a chunk draw apart.
"""

from __future__ import annotations

import math
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.operators import grown as G

#: Bytes of sums that a task holds in one pass, and trees whose sums are sent as one row.
PASS_BYTES, BLOCK = 32 << 20, 8
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
SPLITS = "tree int, node int, feature int, bin int, ln double, ls double, rn double, rs double, gain double"
SPLIT_NAMES = [c.split()[0] for c in SPLITS.split(", ")]


def _poisson() -> np.ndarray:
    """How often a row is drawn, by 16 random bits."""
    upto = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(upto, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


def draws(h: np.ndarray, seed: int, four: int) -> np.ndarray:
    """(row, tree): 16 bits for each of the trees 4 * four ... 4 * four + 3."""
    with np.errstate(over="ignore"):
        v = h + MIX[0] * np.uint64((seed * 1_000_003 + four + 1) % (1 << 64))
        v = (v ^ (v >> np.uint64(30))) * MIX[1]
        v = (v ^ (v >> np.uint64(27))) * MIX[2]
        v = v ^ (v >> np.uint64(31))
    return v.view(np.uint16).reshape(len(h), 4)


def apart(h: np.ndarray) -> np.ndarray:
    """Hashes in which equal ones differ by their number among equals."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.zeros(0, bool)
    place = np.arange(len(s))
    number = place - np.maximum.accumulate(np.where(first, place, 0)) if len(s) else place
    out = np.empty(len(h), np.uint64)
    with np.errstate(over="ignore"):
        out[order] = s.view(np.uint64) + number.astype(np.uint64) * MIX[2]
    return out


class Rows:
    """Rows as codes, with the thresholds of every fold; kept until ``close``.

    ``d`` has the features and ``_label`` (finite), ``_hash`` (long) and ``_fold0``...; ``train_rows`` the rows outside each (repeat, fold).
    """

    def __init__(self, d: DataFrame, features: list[str], train_rows: dict, seed: int):
        cuts = G.fold_thresholds(d, features, train_rows, seed)
        p = len(features)
        union = [np.unique(np.concatenate([c[i] for c in cuts.values()])) for i in range(p)]
        self.tables = {k: [np.concatenate(([0], np.cumsum(np.isin(u, c[i])))).astype(np.uint8) for i, u in enumerate(union)]
                       for k, c in cuts.items()}
        self.width = 1 + max(len(x) for c in cuts.values() for x in c)
        self.p, self.repeats = p, sorted({r for r, _ in train_rows})
        others = ["_label", *[f"_fold{r}" for r in self.repeats]]

        def coded(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(np.searchsorted(u, b.column(i).to_numpy(), "left").astype(np.int16)) for i, u in enumerate(union)],
                     *[b.column(c) for c in others], pa.array(apart(b.column("_hash").to_numpy()).view(np.int64))],
                    [*[f"c{i}" for i in range(p)], *others, "_hash"])

        # few tasks, as each sends the bins of all open nodes
        tasks = max(1, 2 * d.sparkSession.sparkContext.defaultParallelism)
        self.rows = d.select(*features, *others, "_hash").mapInArrow(coded, ", ".join(
            [*[f"c{i} short" for i in range(p)], "_label double", *[f"_fold{r} int" for r in self.repeats], "_hash long"])) \
            .coalesce(tasks).persist()
        n, mean = self.rows.agg(F.count("*"), F.avg("_label")).first()
        self.mean = mean or 0.0

    def close(self):
        self.rows.unpersist()


def _chunks(batches, p: int, r: int, keep, tables: list[np.ndarray], features: list[int]):
    """(bins by feature and row, label, hash) of the rows that ``keep`` takes by their fold, about ``G.CHUNK`` read at a time."""
    held, n = [], 0

    def out():
        t = pa.Table.from_batches(held)
        rows = np.flatnonzero(keep(t.column(f"_fold{r}").to_numpy()))
        return (np.stack([tables[f][t.column(f).to_numpy()[rows]] for f in features]), t.column("_label").to_numpy()[rows],
                t.column("_hash").to_numpy()[rows].view(np.uint64))

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= G.CHUNK:
            yield out()
            held, n = [], 0
    if n:
        yield out()


class Forests:
    """Forests of one fold's training rows that differ in ``min_rows``, by heap places (children of i: 2i + 1, 2i + 2).

    Tree t of variant v is row v * trees + t of ``feature`` (-1: not split), ``bin`` and ``value``; ``gains`` has the summed fall
    of the squared error by tree and feature.
    """

    def __init__(self, rows: Rows, fold: tuple[int, int], features: list[int], min_rows: list[int], trees: int, depth: int,
                 tried: int, seed: int):
        self.data, self.fold, self.features, self.min_rows = rows, fold, features, min_rows
        self.trees, self.depth, self.tried, self.seed = trees, depth, tried, seed
        size, count = 2 ** (depth + 1) - 1, trees * len(min_rows)
        self.feature, self.bin = np.full((count, size), -1, np.int16), np.zeros((count, size), np.uint8)
        self.value, self.gains = np.zeros((count, size)), np.zeros((count, len(features)))
        self.open = np.zeros((count, size), bool)
        self.open[:, 0] = True

    def grow(self) -> Forests:
        for level in range(self.depth):
            self._level(level)
        return self

    def alike(self) -> np.ndarray:
        """For each tree the first with its draws and splits (of another variant, or itself)."""
        own = np.arange(len(self.feature))
        for i in own[self.trees:]:
            for j in range(i % self.trees, i, self.trees):
                if np.array_equal(self.feature[i], self.feature[j]) and np.array_equal(self.bin[i], self.bin[j]) \
                        and np.array_equal(self.open[i], self.open[j]):
                    own[i] = j
                    break
        return own

    def _level(self, level: int) -> None:
        first, end = 2 ** level - 1, 2 ** (level + 1) - 1
        own, open_ = self.alike(), self.open[:, first:end]
        # features that a node tries: the same for a tree of all variants
        order = np.random.default_rng([self.seed, level]).random((self.trees, end - first, len(self.features))).argsort(axis=2)
        tried = np.sort(order[:, :, :self.tried], axis=2)
        todo = sorted((i for i in set(own.tolist()) if open_[i].any()), key=lambda i: (i % self.trees, i))
        each = self.tried * self.data.width * 16
        start, size, passes = 0, 0, []
        for at, i in enumerate(todo):
            own_size = int(open_[i].sum()) * each
            if size and size + own_size > PASS_BYTES:
                passes.append(todo[start:at])
                start, size = at, 0
            size += own_size
        passes.append(todo[start:])
        found = [self._pass(level, own, part, tried) for part in passes if part]
        self.open[:] = False
        for t in found:
            self._enter(level, {c: t.column(c).to_numpy() for c in SPLIT_NAMES})

    def _enter(self, level: int, s: dict) -> None:
        root = s["node"] < 0
        self.value[s["tree"][root], 0] = s["ls"][root] / s["ln"][root] + self.data.mean
        s = {c: v[~root] for c, v in s.items()}
        tree, node = s["tree"], s["node"]
        self.feature[tree, node], self.bin[tree, node] = s["feature"], s["bin"]
        np.add.at(self.gains, (tree, s["feature"]), s["gain"])
        for child, n, total in ((2 * node + 1, s["ln"], s["ls"]), (2 * node + 2, s["rn"], s["rs"])):
            self.value[tree, child] = total / n + self.data.mean
            if level + 1 < self.depth:
                self.open[tree, child] = n >= 2 * np.array(self.min_rows)[tree // self.trees]

    def _pass(self, level: int, own: np.ndarray, todo: list[int], tried: np.ndarray) -> pa.Table:
        p, trees, seed, k, width, (r, f) = self.data.p, self.trees, self.seed, self.tried, self.data.width, self.fold
        features, tables, mean, first = self.features, self.data.tables[self.fold], self.data.mean, 2 ** level - 1
        open_ = {i: np.flatnonzero(self.open[i]) for i in todo}
        inner = {i: (self.feature[i, :first].tolist(), self.bin[i, :first].tolist()) for i in todo}
        asks = {i: tried[i % trees][open_[i] - first] for i in todo}  # (open node, feature tried)
        fours = [(g, list(ii)) for g, ii in groupby(todo, lambda i: i % trees // 4)]

        def add(batches):
            times = _poisson()
            sums = {i: np.zeros((2, k, len(open_[i]) * width)) for i in todo}
            for bins, y, h in _chunks(batches, p, r, lambda fold: fold != f, tables, features):
                flat, n, y = bins.ravel(), len(y), y - mean
                for four, ii in fours:
                    bits = draws(h, seed, four)
                    for i in ii:
                        w = times[bits[:, i % trees % 4]]
                        _sums(sums[i], flat, n, y, w, *inner[i], level, open_[i], asks[i], width)
            part = TaskContext.get().partitionId()
            for at in range(0, len(todo), BLOCK):
                data = b"".join(sums[i].tobytes() for i in todo[at:at + BLOCK])
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary())],
                                                 ["block", "part", "sums"])

        variants = {i: [j for j in np.flatnonzero(own == i).tolist()] for i in todo}
        min_rows = self.min_rows

        def pick(key, table):
            at, total = key[0].as_py(), 0.0
            for _, data in sorted(zip(table.column("part").to_pylist(), table.column("sums").to_pylist())):
                total = total + np.frombuffer(data)
            out, start = [], 0
            for i in todo[at:at + BLOCK]:
                size = 2 * k * len(open_[i]) * width
                stats = total[start:start + size].reshape(2, k, len(open_[i]), width).transpose(0, 2, 1, 3)
                start += size
                for j in variants[i]:
                    out += best_splits(j, stats, open_[i], asks[i], min_rows[j // trees])
            cols = list(zip(*out)) if out else [[]] * len(SPLIT_NAMES)
            return pa.table([pa.array(c, pa.int32() if n < 4 else pa.float64()) for n, c in enumerate(cols)], names=SPLIT_NAMES)

        return self.data.rows.mapInArrow(add, "block int, part int, sums binary").groupBy("block").applyInArrow(pick, SPLITS).toArrow()

    def importances(self) -> np.ndarray:
        """Shares of the features in each tree's gains, the mean of the trees that split; by the first variant."""
        gains = self.gains[:self.trees]
        total = gains.sum(axis=1)
        shares = (gains[total > 0] / total[total > 0, None]).sum(axis=0)
        return shares / shares.sum() if shares.sum() > 0 else shares

    def held_out(self, depths: list[int], counts: list[int]) -> dict[tuple[int, int, int], float]:
        """{(variant, depth, count): mean squared error on the fold of the first ``count`` trees cut off at ``depth``}."""
        p, trees, (r, f), tables, features = self.data.p, self.trees, self.fold, self.data.tables[self.fold], self.features
        own, variants, depth = self.alike(), len(self.min_rows), max(depths)
        feature, cut, value = np.maximum(self.feature, 0).astype(np.int64), self.bin, self.value
        leaf = self.feature < 0

        def run(batches):
            sums, rows = np.zeros((variants, len(depths), len(counts))), 0
            for bins, y, _ in _chunks(batches, p, r, lambda fold: fold == f, tables, features):
                flat, n = bins.ravel(), len(y)
                place, total = np.arange(n), np.zeros((variants, len(depths), n))
                rows += n
                for t in range(trees):
                    seen = {}
                    for v in range(variants):
                        i = v * trees + t
                        if own[i] in seen:
                            got = seen[own[i]]
                        else:
                            at, got = np.zeros(n, np.int64), []
                            for level in range(depth + 1):
                                if level in depths:
                                    got.append(value[i][at])
                                if level < depth:
                                    right = flat[feature[i][at] * n + place] > cut[i][at]
                                    at = np.where(leaf[i][at], at, 2 * at + 1 + right)
                            seen[i] = got
                        for d, x in enumerate(got):
                            total[v, d] += x
                    if t + 1 in counts:
                        sums[:, :, counts.index(t + 1)] += ((total / (t + 1) - y) ** 2).sum(axis=2)
            at = np.indices(sums.shape)
            yield pa.RecordBatch.from_arrays([*[pa.array(x.ravel()) for x in (*at, sums)], pa.array(np.full(sums.size, rows))],
                                             ["variant", "depth", "count", "sse", "n"])

        got = self.data.rows.mapInArrow(run, "variant long, depth long, count long, sse double, n long") \
            .groupBy("variant", "depth", "count").agg(F.sum("sse").alias("sse"), F.sum("n").alias("n")).collect()
        return {(g["variant"], depths[g["depth"]], counts[g["count"]]): g["sse"] / g["n"] for g in got if g["n"]}


def _sums(out: np.ndarray, flat: np.ndarray, n: int, y: np.ndarray, w: np.ndarray, feature: list[int], cut: list[int], level: int,
          nodes: np.ndarray, asks: np.ndarray, width: int) -> None:
    """Add the drawn rows of a chunk to the (count, sum) of one tree's open nodes, by feature tried and bin."""
    parts = {0: np.flatnonzero(w)}
    for _ in range(level):
        below = {}
        for node, rows in parts.items():
            if (c := feature[node]) >= 0:
                left = flat[c * n:(c + 1) * n][rows] <= cut[node]
                below[2 * node + 1], below[2 * node + 2] = rows[left], rows[~left]
        parts = below
    rows = [parts[node] for node in nodes.tolist()]
    sizes = np.array([len(x) for x in rows])
    rows = np.concatenate(rows)
    times = w[rows].astype(float)
    total = y[rows] * times
    slot = np.repeat(np.arange(len(nodes)) * width, sizes)
    for k in range(asks.shape[1]):
        own = slot + flat[np.repeat(asks[:, k] * n, sizes) + rows]
        out[0, k] += np.bincount(own, times, out.shape[2])
        out[1, k] += np.bincount(own, total, out.shape[2])


def best_splits(tree: int, stats: np.ndarray, nodes: np.ndarray, asks: np.ndarray, min_rows: int) -> list[tuple]:
    """Rows of ``SPLITS`` from (count or sum, node, feature tried, bin); the root's own sums stand at node -1."""
    upto = np.cumsum(stats, axis=3)
    whole = upto[:, :, :1, -1:]
    left, right = upto[..., :-1], upto[:, :, :, -1:] - upto[..., :-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - whole[1] ** 2 / whole[0]
    gain = np.where((left[0] >= max(min_rows, 1)) & (right[0] >= max(min_rows, 1)), gain, -np.inf).reshape(len(nodes), -1)
    out = []
    if len(nodes) and nodes[0] == 0 and whole[0, 0, 0, 0] > 0:
        out.append((tree, -1, -1, -1, whole[0, 0, 0, 0], whole[1, 0, 0, 0], 0.0, 0.0, 0.0))
    if not gain.shape[1]:
        return out
    at = gain.argmax(axis=1)
    k, b = np.divmod(at, left.shape[3])
    for i, node in enumerate(nodes.tolist()):
        n, s = left[:, i, k[i], b[i]], right[:, i, k[i], b[i]]
        # what rounding leaves of a pure node's sums isn't a gain
        if gain[i, at[i]] > G.EPSILON * 8 * (n[1] ** 2 / max(n[0], 1) + s[1] ** 2 / max(s[0], 1)):
            out.append((tree, node, int(asks[i, k[i]]), int(b[i]), n[0], n[1], s[0], s[1], gain[i, at[i]]))
    return out
