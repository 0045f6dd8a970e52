"""The standard analysis frame built from the driver's tables, plus its SQL twin.

FF: one row per order -- orders LEFT JOIN per-order lineitem aggregates,
JOIN customer, nation, region. ``row_id = o_orderkey``. Double aggregates
are rounded (money to 2 places, means to 8) so summation order cannot move
ties between engines or runs.

Plan shape at scale: lineitem is reduced by ``l_orderkey`` with a partial
(map-side) aggregate, so the join with orders reuses that hash partitioning
and only orders is shuffled; customer is joined by key (AQE turns it into a
broadcast only when its runtime size is under the threshold); nation and
region are fixed 25- and 5-row tables and are broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relyframe.sources import load

NUMERIC_FEATURES = ["o_totalprice", "c_acctbal", "n_items", "sum_qty", "sum_price", "avg_disc", "avg_tax"]
CATEGORICAL_FEATURES = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "r_name"]


def standard_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                                   "o_totalprice", "o_orderpriority")
    li = (load(spark, sf_dir, "lineitem")
          .groupBy("l_orderkey")
          .agg(F.count(F.lit(1)).alias("n_items"), F.sum("l_quantity").alias("sum_qty"),
               F.round(F.sum("l_extendedprice"), 2).alias("sum_price"),
               F.round(F.avg("l_discount"), 8).alias("avg_disc"),
               F.round(F.avg("l_tax"), 8).alias("avg_tax")))
    cust = load(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey")
    nation = F.broadcast(load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    region = F.broadcast(load(spark, sf_dir, "region").select("r_regionkey", "r_name"))
    ff = (orders.join(li, orders.o_orderkey == li.l_orderkey, "left")
          .join(cust, orders.o_custkey == cust.c_custkey, "inner")
          .join(nation, cust.c_nationkey == nation.n_nationkey, "inner")
          .join(region, nation.n_regionkey == region.r_regionkey, "inner"))
    return ff.select(F.col("o_orderkey").alias("row_id"), "o_custkey", "o_totalprice", "c_acctbal",
                     "n_items", "sum_qty", "sum_price", "avg_disc", "avg_tax",
                     "o_orderstatus", "o_orderpriority", "c_mktsegment", "r_name")


FF_SQL = """
li AS (
  SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_items, sum(l_quantity) AS sum_qty,
         round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 8) AS avg_disc,
         round(avg(l_tax), 8) AS avg_tax
  FROM lineitem GROUP BY l_orderkey),
ff AS (
  SELECT o.o_orderkey AS row_id, o.o_custkey, o.o_totalprice, c.c_acctbal, li.n_items, li.sum_qty,
         li.sum_price, li.avg_disc, li.avg_tax, o.o_orderstatus, o.o_orderpriority,
         c.c_mktsegment, r.r_name
  FROM orders o LEFT JOIN li ON o.o_orderkey = li.l_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)
"""


def dirt_expr(key: str = "row_id", value: str = "o_custkey"):
    """Injected dirt: the same CASE in Spark and in the oracle (integers only)."""
    k = F.col(key)
    return (F.when(k % 17 == 0, F.lit("un")).when(k % 19 == 0, F.lit("not_applicable"))
            .when(k % 23 == 0, F.lit("#NAME?")).when(k % 29 == 0, F.lit("inf"))
            .otherwise(F.col(value).cast("string")))


def dirt_sql(key: str = "row_id", value: str = "o_custkey") -> str:
    return (f"CASE WHEN {key} % 17 = 0 THEN 'un' WHEN {key} % 19 = 0 THEN 'not_applicable' "
            f"WHEN {key} % 23 = 0 THEN '#NAME?' WHEN {key} % 29 = 0 THEN 'inf' "
            f"ELSE CAST({value} AS VARCHAR) END")


def raw_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FF widened with the column shapes the cleaning rules act on.

    ``wall_dirty`` gets value replacement, ``area_dirty`` keeps its text
    until the invalid-row filter; ``price_o``/``price_u`` is a superseded
    pair; ``photos_n`` and ``unnamed_0`` match drop keywords; ``notes`` is a
    named drop; ``const_flag`` and ``empty_col`` have no variation.
    """
    ff = standard_frame(spark, sf_dir)
    return ff.select(
        "row_id", F.col("sum_qty").alias("target"), "o_totalprice", "c_acctbal", "n_items",
        "sum_price", "avg_disc", "avg_tax", "o_orderstatus", "o_orderpriority", "c_mktsegment",
        "r_name",
        dirt_expr().alias("wall_dirty"),
        dirt_expr("o_custkey", "row_id").alias("area_dirty"),
        F.col("o_totalprice").alias("price_o"), F.col("sum_price").alias("price_u"),
        F.col("avg_disc").alias("disc_o"),
        F.col("n_items").alias("photos_n"), F.col("row_id").alias("unnamed_0"),
        F.col("c_mktsegment").alias("notes"),
        F.lit("x").alias("const_flag"), F.lit(None).cast("double").alias("empty_col"),
    )


RAW_SQL = FF_SQL + """,
raw AS (
  SELECT row_id, sum_qty AS target, o_totalprice, c_acctbal, n_items, sum_price, avg_disc, avg_tax,
         o_orderstatus, o_orderpriority, c_mktsegment, r_name,
         """ + dirt_sql() + """ AS wall_dirty,
         """ + dirt_sql("o_custkey", "row_id") + """ AS area_dirty,
         o_totalprice AS price_o, sum_price AS price_u, avg_disc AS disc_o,
         n_items AS photos_n, row_id AS unnamed_0, c_mktsegment AS notes,
         'x' AS const_flag, CAST(NULL AS DOUBLE) AS empty_col
  FROM ff)
"""
