"""Column-wise average ranks of wide rows, with frequent values set apart.

Cells (id, feature, value) are sorted by (feature, value) once, over all
features. A value that many rows have would put its cells in one task, so
values above a fixed share of the cells are counted and stand in that order as
one row with a weight; their rank goes to their rows by a table of bounded
size. Every other run of equal values is short against a partition. So a cell
moves at most twice: to its place in the order, and with its rank to its row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relyframe.session import checkpoint_dir, scratch_path

#: Values counted apart, over all features: fewer than this, or than FOUR a partition where there are many partitions.
HEAVY_VALUES = 10_000
FOUR = 4


def _cells(wide: DataFrame, p: int) -> DataFrame:
    """(_id, _f, _v): a row for each cell; features are numbered."""
    return wide.unpivot(["_id"], [str(i) for i in range(p)], "_f", "_v").withColumn("_f", F.col("_f").cast("int"))


def heavy_values(wide: DataFrame, p: int, entries: int) -> DataFrame:
    """(_f, _v, _w): values, with their counts, that more than one in ``entries`` cells have; fewer than ``entries`` rows."""
    seen = _cells(wide, p).where(F.col("_v").isNotNull()).groupBy("_f", "_v").agg(F.count(F.lit(1)).alias("_w"))
    return seen.where(F.col("_w") * F.lit(entries) > F.lit(wide.count() * p))


def _rank_runs(batches):
    """Adds to sorted cells what precedes their run in their partition and feature (_below), and its weight (_n)."""
    total, feature, base, held = 0, None, 0, None

    def done(t: pa.Table):
        nonlocal total, feature, base
        f, v = t["_f"].to_numpy(), t["_v"].to_numpy()
        w = np.nan_to_num(t["_w"].to_numpy().astype(float), nan=1.0).astype(np.int64)
        start = np.flatnonzero(_starts(f, v))
        after = total + np.cumsum(w)
        before = after[start] - w[start]
        size = np.diff(np.append(before, after[-1]))
        first = np.diff(f[start], prepend=f[0] if f[0] == feature else f[0] - 1) != 0
        below = before - np.maximum.accumulate(np.where(first, before, base))
        total, feature, base = int(after[-1]), f[-1], int(before[-1] - below[-1])
        length = np.diff(np.append(start, len(f)))
        t = t.append_column("_below", pa.array(np.repeat(below, length)))
        return t.append_column("_n", pa.array(np.repeat(size, length))).combine_chunks().to_batches()

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if held is not None:
            t = pa.concat_tables([held, t]).combine_chunks()
        last = int(np.flatnonzero(_starts(t["_f"].to_numpy(), t["_v"].to_numpy()))[-1])
        if last:
            yield from done(t.slice(0, last))
        held = t.slice(last)  # the last run may go on in the next batch
    if held is not None:
        yield from done(held)


def _starts(f: np.ndarray, v: np.ndarray) -> np.ndarray:
    """True at the first cell of each run; NaNs are equal, as in Spark's order."""
    out = np.ones(len(f), bool)
    out[1:] = (f[1:] != f[:-1]) | ~((v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1])))
    return out


def average_rank(df: DataFrame, cols: list[str], id_col: str = "row_id") -> DataFrame:
    """Wide frame (id, col...) with every value replaced by its column-wise average rank.

    Ties share the mean of their places, missing values stay missing, NaN comes last. Rows of an equal id
    become one row with the highest rank of each column.
    """
    spark, p = df.sparkSession, len(cols)
    checkpoint_dir(spark)
    at = scratch_path(spark, "rank-rows")
    df.select(F.col(f"`{id_col}`").alias("_id"), *[F.col(f"`{c}`").cast("double").alias(str(i)) for i, c in enumerate(cols)]
              ).write.parquet(at)
    wide = spark.read.parquet(at)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = scratch_path(spark, "rank-heavy")
    heavy_values(wide, p, max(HEAVY_VALUES, FOUR * parts)).write.parquet(at)
    heavy = spark.read.parquet(at)

    cells = _cells(wide, p)
    light = cells.where(F.col("_v").isNotNull()).join(F.broadcast(heavy.select("_f", "_v")), ["_f", "_v"], "left_anti")
    id_type = wide.schema["_id"].dataType
    order = light.select("_f", "_v", "_id", F.lit(None).cast("long").alias("_w")).unionByName(
        heavy.select("_f", "_v", F.lit(None).cast(id_type).alias("_id"), "_w"))
    order = order.repartitionByRange(parts, "_f", "_v").sortWithinPartitions("_f", "_v").select(
        "*", F.spark_partition_id().alias("_part"))
    schema = f"_f int, _v double, _id {id_type.simpleString()}, _w long, _part int, _below long, _n long"
    # written, so a row's partition stays what it was when its place in it was found
    runs = order.mapInArrow(_rank_runs, schema).checkpoint(eager=True)
    weight = F.coalesce("_w", F.lit(1).cast("long"))
    before = Window.partitionBy("_f").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each feature and partition that occurs: at most features + partitions
    offset = runs.groupBy("_f", "_part").agg(F.sum(weight).alias("_all")).select(
        "_f", "_part", F.coalesce(F.sum("_all").over(before), F.lit(0).cast("long")).alias("_off"))
    ranked = runs.join(F.broadcast(offset), ["_f", "_part"]).withColumn(
        "_r", (F.col("_off") + F.col("_below")).cast("double") + (F.col("_n").cast("double") + 1.0) / 2.0)
    marks = ranked.where(F.col("_w").isNotNull()).select("_f", "_v", "_r")  # as many as heavy values
    placed = cells.join(F.broadcast(marks), ["_f", "_v"], "left").select("_id", "_f", "_r").unionByName(
        ranked.where(F.col("_w").isNull()).select("_id", "_f", "_r"))
    return placed.groupBy(F.col("_id").alias(id_col)).agg(
        *[F.max(F.when(F.col("_f") == i, F.col("_r"))).alias(c) for i, c in enumerate(cols)])
