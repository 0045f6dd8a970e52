"""Synthetic minority rows: points drawn on segments between a row and one of its nearest rows of the same class.

Neighbours are exact. Rows of a class are cut into boxes: strips along the feature
with the widest spread, these along the next one, and so on. Each box finds its rows'
neighbours inside it; the k-th distance bounds how far closer rows can lie, so a row then
visits only the boxes that this ball meets. Boxes that no ball of a box can meet are
left out for all its rows at once, strips first. A box is searched with
numpy, a slice of rows at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.functions.hashing import uniform
from relyframe.functions.missing import is_finite
from relyframe.operators.ordered import exact_position
from relyframe.operators.stats import q
from relyframe.session import checkpoint_dir

#: Rows of a block, and rows that are compared with a block at once.
BLOCK_ROWS, SLICE = 2_048, 256
#: Features that boxes are cut along, at most, and the least spread of one, as a share of the widest.
AXES, LEAST_SPREAD = 3, 0.01


def _closest(x: np.ndarray, ids: np.ndarray, others: np.ndarray, other_ids: np.ndarray, k: int) -> pd.DataFrame:
    """(_id, _other, _d2): the k nearest of ``others`` to each row of x, itself left out; ties by id."""
    out = []
    for at in range(0, len(x), SLICE):
        own = slice(at, at + SLICE)
        d2 = np.zeros((len(x[own]), len(others)))
        for j in range(x.shape[1]):
            diff = x[own, j][:, None] - others[:, j][None, :]
            d2 += diff * diff
        d2[ids[own][:, None] == other_ids[None, :]] = np.inf
        kk = min(k, len(others))
        bound = np.partition(d2, kk - 1, axis=1)[:, kk - 1]
        row, col = np.nonzero((d2 <= bound[:, None]) & np.isfinite(d2))
        by = np.lexsort((other_ids[col], d2[row, col], row))
        row, col = row[by], col[by]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        out.append(pd.DataFrame({"_id": ids[own][row[keep]], "_other": other_ids[col[keep]], "_d2": d2[row[keep], col[keep]]}))
    none = pd.DataFrame({"_id": np.zeros(0, np.int64), "_other": np.zeros(0, np.int64), "_d2": np.zeros(0)})
    return pd.concat(out, ignore_index=True) if out else none


def in_boxes(rows: DataFrame, names: list[str], block_rows: int) -> tuple[DataFrame, list[str]]:
    """(rows with _strip and _blk, the features that boxes are cut along); a box has about ``block_rows`` rows of a label."""
    spread = rows.agg(*[F.stddev_pop(n).alias(n) for n in names]).first()
    axes = sorted(names, key=lambda n: -(spread[n] or 0.0))
    axes = [n for i, n in enumerate(axes[:AXES]) if not i or (spread[n] or 0.0) > LEAST_SPREAD * (spread[axes[0]] or 0.0)]
    placed = rows.withColumn("_blk", F.lit(0).cast("long"))
    for i, axis in enumerate(axes):
        placed = exact_position(placed, ["_label", "_blk"], [axis, "_id"], pos_col="_at", total_col="_n")
        if not i:  # pieces along each axis
            placed = placed.withColumn("_c", F.ceil(F.pow(F.ceil(F.col("_n") / F.lit(block_rows)), F.lit(1.0 / len(axes)))))
        placed = placed.withColumn("_blk", F.col("_blk") * F.col("_c") + F.floor(F.col("_at") * F.col("_c") / F.col("_n"))).drop("_at", "_n")
        if not i:
            placed = placed.withColumn("_strip", F.col("_blk"))
    placed = placed.drop("_c").checkpoint(eager=True)
    return placed, axes


def class_neighbors(df: DataFrame, label: str, features: list[str], k: int = 5, id_col: str = "row_id",
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(label, id, others array<struct<_d2, _other>>): the k nearest other rows of the class by squared distance,
    ties by id. Rows need a label and finite features; ids are unique integers."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    names = [f"_x{j}" for j in range(len(features))]
    rows = df.select(F.col(q(label)).alias("_label"), F.col(q(id_col)).cast("long").alias("_id"),
                     *[F.col(q(f)).cast("double").alias(n) for f, n in zip(features, names)])
    good = F.col("_label").isNotNull()
    for n in names:
        good = good & is_finite(F.col(n))
    rows = rows.where(good)
    placed, axes = in_boxes(rows, names, block_rows)

    def table(pdf):
        pdf = pdf.sort_values("_id")
        return pdf[names].to_numpy(float), pdf["_id"].to_numpy(np.int64)

    schema = "_id long, _other long, _d2 double"

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = table(pdf)
        return _closest(x, ids, x, ids, k)

    near = placed.groupBy("_label", "_blk").applyInPandas(inside, schema).checkpoint(eager=True)
    reach = near.groupBy("_id").agg(F.max("_d2").alias("_far"), F.count("*").alias("_have"))
    # a little more than the distance, for its rounding
    radius = F.when(F.col("_have") < k, F.lit(float("inf"))).otherwise(F.sqrt("_far") * (1 + 1e-9))
    asking = placed.join(reach, "_id", "left").withColumn("_r", F.coalesce(radius, F.lit(float("inf"))))
    ends = [f(n).alias(f"_{side}{i}") for i, n in enumerate(axes) for side, f in (("lo", F.min), ("hi", F.max))]
    boxes = asking.groupBy("_label", "_strip", "_blk").agg(*ends, F.max("_r").alias("_far")).checkpoint(eager=True)
    others = boxes.select("_label", F.col("_strip").alias("_to_strip"), F.col("_blk").alias("_to"),
                          *[F.col(f"_{side}{i}").alias(f"_to_{side}{i}") for i in range(len(axes)) for side in ("lo", "hi")])
    strips = boxes.groupBy("_label", "_strip").agg(F.min("_lo0").alias("_lo"), F.max("_hi0").alias("_hi"), F.max("_far").alias("_far"))
    ways = strips.join(strips.select("_label", F.col("_strip").alias("_to_strip"), F.col("_lo").alias("_a"), F.col("_hi").alias("_b")), "_label")
    ways = ways.where((F.col("_a") <= F.col("_hi") + F.col("_far")) & (F.col("_b") >= F.col("_lo") - F.col("_far"))).select(
        "_label", "_strip", "_to_strip")
    met = F.col("_to") != F.col("_blk")
    for i in range(len(axes)):
        met = met & (F.col(f"_to_lo{i}") <= F.col(f"_hi{i}") + F.col("_far")) & (F.col(f"_to_hi{i}") >= F.col(f"_lo{i}") - F.col("_far"))
    pairs = boxes.join(ways, ["_label", "_strip"]).join(others, ["_label", "_to_strip"]).where(met).select(
        "_label", "_blk", "_to", *[f"_to_{side}{i}" for i in range(len(axes)) for side in ("lo", "hi")])
    gap2 = F.lit(0.0)
    for i, n in enumerate(axes):
        gap = F.greatest(F.lit(0.0), F.col(f"_to_lo{i}") - F.col(n), F.col(n) - F.col(f"_to_hi{i}"))
        gap2 = gap2 + gap * gap
    visits = asking.join(pairs, ["_label", "_blk"]).where(gap2 <= F.col("_r") * F.col("_r"))

    def visit(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return _closest(np.zeros((0, len(names))), np.zeros(0, np.int64), np.zeros((0, len(names))), np.zeros(0, np.int64), k)
        others, other_ids = table(right)
        return _closest(left[names].to_numpy(float), left["_id"].to_numpy(np.int64), others, other_ids, k)

    # columns of their own names again, so that both sides of the group differ
    coming = visits.select(F.col("_to").alias("_blk"), *[F.col(c).alias(c) for c in ("_label", "_id", *names)])
    more = coming.groupBy("_label", "_blk").cogroup(
        placed.groupBy("_label", "_blk")).applyInPandas(visit, schema)
    every = near.unionByName(more).groupBy("_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("_d2", "_other"))), 1, k).alias("others"))
    return every.join(placed.select("_label", "_id"), "_id").select(
        F.col("_label").alias(label), F.col("_id").alias(id_col), "others")


def smote(df: DataFrame, label: str, features: list[str], k: int = 5, seed: int = 42, id_col: str = "row_id",
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Synthetic rows (label, number, base, other, gap, features) that bring every class to the size of the largest.

    Number n of a class lies at ``gap`` of the way from a drawn row to one of its ``k`` nearest of
    the class (all there are, in smaller classes). Draws are hashes of (seed, label, number). Rows
    without a label or with a feature that isn't finite take no part; a class of one row
    has no segments and stays as it is.
    """
    spark = df.sparkSession
    good = F.col(q(label)).isNotNull()
    for f in features:
        good = good & is_finite(F.col(q(f)).cast("double"))
    d = df.where(good).select(F.col(q(label)).alias(label), F.col(q(id_col)).cast("long").alias(id_col),
                              *[F.col(q(f)).cast("double").alias(f) for f in features])
    sizes = d.groupBy(label).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    wanted = sizes.where((F.col("_n") > 1) & (F.col("_n") < most)).orderBy(label).collect()  # one row a class
    total, rows = 0, []
    for r in wanted:
        rows.append((r[label], total, most - r["_n"], r["_n"], min(k, r["_n"] - 1)))
        total += most - r["_n"]
    kind = dict(d.dtypes)[label]
    classes = spark.createDataFrame(rows, f"_label {kind}, _start long, _new long, _n long, _k int")
    number = F.col("id") - F.col("_start")
    draw = lambda what: uniform(seed, f"smote_{what}", F.col("_label"), F.col("number"))
    made = spark.range(total).join(F.broadcast(classes), (F.col("id") >= F.col("_start")) & (number < F.col("_new"))) \
        .withColumn("number", number).select(
            "_label", "number", F.floor(draw("row") * F.col("_n")).alias("_at"),
            (F.floor(draw("other") * F.col("_k")) + 1).cast("int").alias("_which"), draw("gap").alias("gap"))
    few = d.join(F.broadcast(classes.select(F.col("_label").alias(label))), label)
    placed = exact_position(few.select(label, id_col), [label], [id_col], pos_col="_at", total_col=None)
    near = class_neighbors(few, label, features, k, id_col, block_rows)
    base = placed.join(near, [label, id_col]).select(F.col(label).alias("_label"), "_at", F.col(id_col).alias("base"), "others")
    made = made.join(base, ["_label", "_at"]).withColumn("other", F.element_at("others", F.col("_which"))["_other"])
    one = few.select(F.col(id_col).alias("base"), *[F.col(q(f)).alias(f"_a{j}") for j, f in enumerate(features)])
    two = few.select(F.col(id_col).alias("other"), *[F.col(q(f)).alias(f"_b{j}") for j, f in enumerate(features)])
    return made.join(one, "base").join(two, "other").select(
        F.col("_label").alias(label), "number", "base", "other", "gap",
        *[(F.col(f"_a{j}") + F.col("gap") * (F.col(f"_b{j}") - F.col(f"_a{j}"))).alias(f) for j, f in enumerate(features)])
