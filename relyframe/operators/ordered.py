"""Exact ordered positions within groups, without one-task windows.

Rows are range-partitioned by (group, order key), sorted inside partitions and
checkpointed, so a group that holds a third of all rows is spread over
partitions by its order key. A row's position is its place in its partition
less the place of its group's first row there, plus the group's rows in the
partitions before. The last two come from a table with a row for each
(group, partition) that occurs: at most groups + partitions rows.

The same plan serves every size. The checkpoint keeps the partition of a row
fixed: range bounds are sampled, and a second evaluation could cut elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relyframe.session import checkpoint_dir

#: Positions in one neighbour window; rows at its ends are copied to the next.
BLOCK_ROWS = 200_000


def _cols(cs):
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def separate_keys(spark, n: int) -> list[int]:
    """``n`` longs of which each lies in a partition of its own when rows are dealt over ``n`` partitions by them."""
    found = spark.range(100 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("part")).agg(F.min("id").alias("id")).collect()
    return sorted(r["id"] for r in found) if len(found) == n else list(range(n))


def _same(left: DataFrame, right: DataFrame, cols: list[str]):
    """Join condition on columns of equal names that lets missing values match."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & left[f"`{c}`"].eqNullSafe(right[f"`_g_{c}`"])
    return cond


def exact_position(df: DataFrame, group_cols: list[str], order_cols: list[str | Column],
                   weight_col: str | None = None, pos_col: str = "_pos", total_col: str | None = "_n",
                   partitions: int | None = None) -> DataFrame:
    """Sum of weights of strictly preceding rows within the group (0-based
    position when weights are 1), by the lexicographic ``order_cols``; missing
    values come first and are one group.

    Callers make the full order key unique (e.g. add ``row_id``) where ties
    matter. ``partitions`` defaults to the session's shuffle partitions.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*_cols(group_cols), *_cols(order_cols)]
    d = df.withColumn("_w", F.col(weight_col).cast("bigint") if weight_col else F.lit(1).cast("bigint"))
    d = d.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    # the id is partition * 2**33 + place in the partition
    d = d.withColumn("_at", F.monotonically_increasing_id()).checkpoint(eager=True)
    part = F.shiftright("_at", 33)
    d = d.withColumn("_part", part)
    per = d.groupBy(*group_cols, "_part").agg(F.sum("_w").alias("_pw"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("_off", F.coalesce(F.sum("_pw").over(before), F.lit(0).cast("bigint")))
    if total_col:
        per = per.withColumn("_tot", F.sum("_pw").over(Window.partitionBy(*group_cols)))
    names = [*group_cols, "_part"]
    per = per.select(*[F.col(f"`{c}`").alias(f"_g_{c}") for c in names], "_off", "_first", *(["_tot"] if total_col else []))
    out = d.join(per, _same(d, per, names), "left")
    if weight_col:
        run = Window.partitionBy(*group_cols, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
        inside = F.coalesce(F.sum("_w").over(run), F.lit(0).cast("bigint"))
    else:
        inside = F.col("_at") - F.col("_first")
    keep = [c for c in df.columns if c not in (pos_col, total_col)]
    return out.select(*[F.col(f"`{c}`") for c in keep], (F.col("_off") + inside).alias(pos_col),
                      *([F.col("_tot").alias(total_col)] if total_col else []))


def sorted_neighbors(df: DataFrame, group_cols: list[str], order_cols: list[str], value_col: str, k: int,
                     prefix: str = "_nb", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Values of the k preceding and k following rows in sort order, per group.

    Adds ``{prefix}_p1..pk`` (previous) and ``{prefix}_n1..nk`` (next) plus
    ``_pos`` and ``_n``. Rows are cut into blocks of ``block_rows`` positions,
    and the k rows on each side of a block boundary are copied into the
    neighbouring block as halo rows, so lag/lead inside (group, block) windows
    is exact while no window partition exceeds one block.
    """
    size = max(block_rows, 2 * k + 1)
    pos = exact_position(df, group_cols, order_cols, pos_col="_pos", total_col="_n")
    blk = F.floor(F.col("_pos") / F.lit(size)).cast("bigint")
    off = F.col("_pos") % F.lit(size)
    # a row goes to its own block and, near an edge, to the one beside it
    at = F.array_compact(F.array(
        F.struct(blk.alias("b"), F.lit(False).alias("halo")),
        F.when((off >= F.lit(size - k)) & (F.col("_pos") + 1 < F.col("_n")), F.struct((blk + 1).alias("b"), F.lit(True).alias("halo"))),
        F.when((off < F.lit(k)) & (blk > 0), F.struct((blk - 1).alias("b"), F.lit(True).alias("halo")))))
    rows = pos.select("*", F.explode(at).alias("_at")).select(*[F.col(f"`{c}`") for c in pos.columns],
                                                              F.col("_at.b").alias("_blk"), F.col("_at.halo").alias("_halo"))
    w = Window.partitionBy(*group_cols, "_blk").orderBy("_pos")
    near = {f"{prefix}_{side}{j}": fn(value_col, j).over(w) for j in range(1, k + 1)
            for side, fn in (("p", F.lag), ("n", F.lead))}
    return rows.withColumns(near).where(~F.col("_halo")).drop("_blk", "_halo")
