"""Boosted trees of many folds and parameters: each fit runs in numpy in one task, many fits side by side.

Spark ML's fit makes a job for each level of each round, so a grid over 25 folds makes hundreds of thousands of jobs. Here the rows
are kept once as bin codes (``forests.Rows``) and handed whole to as many tasks as there are cores; a task makes its
share of the fits. Only squared errors come back. A task holds about 50 bytes a row, so this is for up to ``ROWS`` rows.

A fit is that of Spark's ``GBTRegressor`` with squared loss: the first tree is fitted to the target and counts whole, each further one to
twice the residual and counts by the step; thresholds between about 32 bins of equal size found as by that fit; the split with the
largest fall of the variance, no child of fewer than ``minInstancesPerNode`` drawn rows, none without gain. Where each round draws rows
(without replacement, to 1 / 65,536) or each node features, the draws are others than Spark's; they follow from the seed and the
row's hash. Of two children the smaller one's bins are added up, the other's are the difference.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from relyframe.operators import forests as Fo
from relyframe.operators import grown as G
from relyframe.operators.ordered import separate_keys

#: Rows of a table that every task can hold.
ROWS = 4_000_000
#: What a fit has where a point doesn't say it.
BOOST = {"maxIter": 20, "stepSize": 0.1, "maxDepth": 5, "minInstancesPerNode": 1, "subsamplingRate": 1.0, "featureSubsetStrategy": "all"}
ERRORS = "job int, rounds int, sse double, n long"


def takes(point: dict) -> bool:
    """Whether fits of the point can be made here."""
    p = BOOST | point
    return set(p) == set(BOOST) and 0 < p["maxDepth"] <= G.MAX_DEPTH and p["maxIter"] > 0 and 0 < p["subsamplingRate"] <= 1 \
        and (p["featureSubsetStrategy"] == "all" or re.fullmatch(r"0?\.\d*[1-9]\d*", p["featureSubsetStrategy"]) is not None)


def _tried(strategy: str, p: int) -> int:
    return p if strategy == "all" else math.ceil(float(strategy) * p)


class Table:
    """All rows with the bins of one fold; features in pairs, since the bins of two are added up at once."""

    def __init__(self, codes: list[np.ndarray], tables: list[np.ndarray], label: np.ndarray, hashes: np.ndarray, held: np.ndarray, width: int):
        self.bins = [t[c] for t, c in zip(tables, codes)]
        self.width, self.label, self.hashes, self.held = width, label, hashes, np.flatnonzero(held).astype(np.int32)
        self.train = np.flatnonzero(~held).astype(np.int32)
        self.pairs = [self.bins[f].astype(np.uint16) * np.uint16(width) + self.bins[f + 1] if f + 1 < len(self.bins)
                      else self.bins[f].astype(np.uint16) for f in range(0, len(self.bins), 2)]

    def sums(self, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
        """(count and sum, feature, bin) of the rows."""
        own, w, p = target[rows], self.width, len(self.bins)
        out = np.empty((2, p, w))
        for a, codes in enumerate(self.pairs):
            f, at = 2 * a, codes[rows]
            size = w * w if f + 1 < p else w
            for s, both in enumerate((np.bincount(at, minlength=size), np.bincount(at, own, size))):
                if f + 1 < p:
                    both = both.reshape(w, w)
                    out[s, f], out[s, f + 1] = both.sum(axis=1), both.sum(axis=0)
                else:
                    out[s, f] = both
        return out


def _best(stats: np.ndarray, asks: np.ndarray | None, min_rows: int):
    """(gain, feature, bin, sums on the left, sums on the right) of each node's best split, the first of equals; gain 0 where there is none.

    ``stats`` are (node, count or sum, feature, bin), ``asks`` which features a node tries.
    """
    upto = np.cumsum(stats, axis=3)
    left, whole = upto[..., :-1], upto[..., -1:]
    right = whole - left
    least = max(min_rows, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[:, 1] ** 2 / left[:, 0] + right[:, 1] ** 2 / right[:, 0] - whole[:, 1] ** 2 / whole[:, 0]
    good = (left[:, 0] >= least) & (right[:, 0] >= least)
    if asks is not None:
        good &= asks[:, :, None]
    gain = np.where(good, gain, -np.inf).reshape(len(stats), -1)
    # splits of the same rows by other features are equal but for rounding
    at, node = (gain >= gain.max(axis=1, keepdims=True) * (1 - 1e-10)).argmax(axis=1), np.arange(len(stats))
    f, b = np.divmod(at, left.shape[3])
    gain, l, r = gain[node, at], left[node, :, f, b], right[node, :, f, b]
    # what rounding leaves of a pure node's sums isn't a gain
    size = l[:, 1] ** 2 / np.maximum(l[:, 0], 1) + r[:, 1] ** 2 / np.maximum(r[:, 0], 1)
    return np.where(gain > 8 * G.EPSILON * size, gain, 0.0), f, b, l, r


def boost(t: Table, params: dict, marks: list[int], seed: int) -> dict[int, float]:
    """{rounds: squared error on the rows held out} of one fit, after each number of rounds of ``marks``."""
    rate, depth, p = params["subsamplingRate"], params["maxDepth"], len(t.bins)
    tried = _tried(params["featureSubsetStrategy"], p)
    guess, out = np.zeros(len(t.label)), {}
    for m in range(max(marks)):
        target, step = (t.label, 1.0) if not m else (2.0 * (t.label - guess), params["stepSize"])
        drawn, others = t.train, t.held
        if rate < 1:
            if not m % 4:
                bits = Fo.draws(t.hashes[t.train], seed, m // 4)
            inside = bits[:, m % 4] < round(rate * 65536)
            drawn, others = t.train[inside], np.concatenate((t.train[~inside], t.held))
        if not len(drawn):
            drawn, others = t.train, t.held
        asks = None
        if tried < p:
            order = np.random.default_rng([seed, m]).random((2 ** depth, p)).argsort(axis=1)
            asks = order < tried  # the places of a node's features in its own order
        # open nodes of a level: (drawn rows, other rows, sums by bin, heap place)
        first = t.sums(drawn, target)
        value = first[1, 0].sum() / first[0, 0].sum()
        nodes = [(drawn, others, first, 0, value)]
        for level in range(depth):
            stats = np.stack([n[2] for n in nodes])
            own = None if asks is None else asks[[n[3] for n in nodes]]
            gain, f, b, l, r = _best(stats, own, params["minInstancesPerNode"])
            below = []
            for i, (ins, outs, sums, at, value) in enumerate(nodes):
                if not gain[i]:
                    _add(guess, ins, outs, step * value)
                    continue
                codes, cut = t.bins[f[i]], b[i]
                to, to_out = codes[ins] <= cut, codes[outs] <= cut
                parts = [(ins[to], outs[to_out], l[i]), (ins[~to], outs[~to_out], r[i])]
                values = [s[1] / s[0] for _, _, s in parts]
                if level + 1 == depth:
                    for (a, o, _), v in zip(parts, values):
                        _add(guess, a, o, step * v)
                    continue
                small = int(len(parts[1][0]) < len(parts[0][0]))
                each: list = [None, None]
                each[small] = t.sums(parts[small][0], target)
                each[1 - small] = sums - each[small]
                below += [(parts[s][0], parts[s][1], each[s], 2 * at + 1 + s, values[s]) for s in (0, 1)]
            nodes = below
            if not nodes:
                break
        if m + 1 in marks:
            out[m + 1] = float(((guess[t.held] - t.label[t.held]) ** 2).sum())
    return out


def _add(guess: np.ndarray, ins: np.ndarray, outs: np.ndarray, value: float) -> None:
    guess[ins] += value
    guess[outs] += value


def _shares(costs: list[float], tasks: int) -> list[list[int]]:
    """The jobs of each task, the dearest first to the task with the least so far."""
    load, own = [0.0] * tasks, [[] for _ in range(tasks)]
    for i in sorted(range(len(costs)), key=lambda i: (-costs[i], i)):
        t = load.index(min(load))
        own[t].append(i)
        load[t] += costs[i]
    return [o for o in own if o]


def held_out(data: Fo.Rows, jobs: list[tuple[tuple[int, int], dict, list[int]]], seed: int) -> list[dict[int, float]]:
    """For each job (fold, parameters, numbers of rounds): {rounds: mean squared error on the fold}."""
    spark, p, repeats, width, tables = data.rows.sparkSession, data.p, data.repeats, data.width, data.tables
    jobs = [(fold, BOOST | params, sorted(marks)) for fold, params, marks in jobs]
    shares = _shares([max(marks) * (1.0 + params["maxDepth"]) for _, params, marks in jobs], max(1, spark.sparkContext.defaultParallelism))
    n = len(shares)
    keys = separate_keys(spark, n)
    by_key = dict(zip(keys, shares))

    def run(key, table):
        codes = [table.column(f"c{f}").to_numpy() for f in range(p)]
        label, hashes = table.column("_label").to_numpy(), table.column("_hash").to_numpy().view(np.uint64)
        folds, out, at = {r: table.column(f"_fold{r}").to_numpy() for r in repeats}, [], None
        for j in sorted(by_key[key[0].as_py()], key=lambda j: jobs[j][0]):
            (r, f), params, marks = jobs[j]
            if at != (r, f):
                at, rows = (r, f), Table(codes, tables[r, f], label, hashes, folds[r] == f, width)
            out += [(j, m, sse, len(rows.held)) for m, sse in boost(rows, params, marks, seed).items()]
        cols = list(zip(*out))
        return pa.table([pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.float64(), pa.int64()))],
                        names=[c.split()[0] for c in ERRORS.split(", ")])

    copies = data.rows.select("*", F.explode(F.array(*[F.lit(k).cast("long") for k in keys])).alias("_task"))
    found: list[dict] = [{} for _ in jobs]
    for r in copies.repartition(n, "_task").groupBy("_task").applyInArrow(run, ERRORS).collect():
        if r["n"]:
            found[r["job"]][r["rounds"]] = r["sse"] / r["n"]
    return found
