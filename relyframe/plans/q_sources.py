"""Source / sink proofs (S1-S8, U1, J1, F14, F15): round trips through the
shared checkpoint folder (never a machine-local path on a cluster)."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from relyframe.functions.hashing import uniform_sql
from relyframe.operators.clean import add_random_feature, assemble_features, partition_features
from relyframe.operators.encode import Preprocessor
from relyframe.plans.catalog import register, rounded
from relyframe.plans.frame import FF_SQL, standard_frame
from relyframe.plans.q_split import SPLIT_SQL, split_frame
from relyframe.session import scratch_path
from relyframe.sources import (load_boxcox_params, read_table, save_boxcox_params, table_path, write_split,
                               write_table)

_CSV_COLS = "row_id BIGINT, o_totalprice DOUBLE, c_acctbal DOUBLE, n_items BIGINT, o_orderstatus STRING, r_name STRING"


@register("src_csv_roundtrip", "WITH " + FF_SQL + "SELECT row_id, o_totalprice, c_acctbal, n_items, o_orderstatus, r_name FROM ff")
def q_csv(spark: SparkSession, sf: str):
    ff = standard_frame(spark, sf).select("row_id", "o_totalprice", "c_acctbal", "n_items", "o_orderstatus", "r_name")
    path = write_table(ff, scratch_path(spark, "csv"), "csv")
    return read_table(spark, path, "csv", schema=_CSV_COLS)


@register("src_pruned", "SELECT o_orderkey, o_totalprice FROM orders")
def q_pruned(spark: SparkSession, sf: str):
    return read_table(spark, table_path(sf, "orders"), columns=["o_orderkey", "o_totalprice"])


@register("split_persisted", "WITH " + SPLIT_SQL + "SELECT row_id, split, sum_qty FROM sp")
def q_split_persisted(spark: SparkSession, sf: str):
    path = write_split(split_frame(spark, sf).select("row_id", "sum_qty", "split"), scratch_path(spark, "split"))
    return spark.read.parquet(path).select("row_id", "split", "sum_qty")


@register("residual_dataset", "WITH " + SPLIT_SQL + f""",
st AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM sp WHERE split = 'train'),
rg AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT r_name AS v FROM sp WHERE split = 'train'))
SELECT row_id, split, round((o_totalprice - m) / s, 6) AS num__o_totalprice, code AS cat__r_name,
       round({uniform_sql(42, 'random_feature', 'row_id')}, 6) AS random_feature
FROM sp, st JOIN rg ON rg.v = sp.r_name""")
def q_residual(spark: SparkSession, sf: str):
    """Full-feature (building + hazard + random) encoded set, persisted by split."""
    sp = split_frame(spark, sf)
    cols = ["o_totalprice", "c_acctbal", "n_items", "o_orderstatus", "r_name"]
    pre = Preprocessor().fit(sp.where(F.col("split") == "train"), cols)
    enc = add_random_feature(pre.transform(sp, keep=["row_id", "split"]))
    _, residual = assemble_features(pre.feature_names() + ["random_feature"], ["r_name"], keep_hazard=False)
    path = write_split(enc.select("row_id", "split", *residual), scratch_path(spark, "residual"))
    return rounded(spark.read.parquet(path).select("row_id", "split", "num__o_totalprice", "cat__r_name", "random_feature"))


@register("preprocessor_persisted", "WITH " + SPLIT_SQL + """,
st AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM sp WHERE split = 'train'),
rg AS (SELECT v, CAST(row_number() OVER (ORDER BY v) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT r_name AS v FROM sp WHERE split = 'train'))
SELECT row_id, round((o_totalprice - m) / s, 6) AS num__o_totalprice, code AS cat__r_name FROM sp, st JOIN rg ON rg.v = sp.r_name""")
def q_preprocessor(spark: SparkSession, sf: str):
    """A fitted preprocessor, written, read back and applied."""
    sp = split_frame(spark, sf)
    path = Preprocessor().fit(sp.where(F.col("split") == "train"), ["o_totalprice", "r_name"]).save(
        scratch_path(spark, "preprocessor"), spark)
    return rounded(Preprocessor.load(path, spark).transform(sp, keep=["row_id"]))


@register("boxcox_params", "WITH " + __import__("relyframe.plans.q_encode", fromlist=["_LLF_SQL"])._LLF_SQL
          + "SELECT round(lam, 6) AS lambda, round(o, 6) AS offset FROM fit")
def q_boxcox_params(spark: SparkSession, sf: str):
    from relyframe.plans.q_encode import grid_fit
    _, lam, off = grid_fit(spark, sf)
    path = save_boxcox_params(spark, lam, off, scratch_path(spark, "boxcox"))
    lam2, off2 = load_boxcox_params(spark, path)
    return rounded(spark.createDataFrame([(lam2, off2)], "lambda double, offset double"))


@register("union_whole", "WITH " + SPLIT_SQL + "SELECT row_id, split, sum_qty FROM sp")
def q_union(spark: SparkSession, sf: str):
    sp = split_frame(spark, sf).select("row_id", "split", "sum_qty").persist()
    return sp.where("split = 'train'").unionByName(sp.where("split = 'test'"))


@register("align_raw_target", "WITH " + SPLIT_SQL + "SELECT sp.row_id, sp.split, ff.sum_qty AS y_raw FROM sp JOIN ff USING (row_id)")
def q_align_target(spark: SparkSession, sf: str):
    sp = split_frame(spark, sf).select("row_id", "split")
    raw = standard_frame(spark, sf).select("row_id", F.col("sum_qty").alias("y_raw"))
    return sp.join(raw, "row_id", "inner")


# names come from the columns and categories that the tables have: a one-hot column for each status and region
_NAMES_SQL = "WITH " + SPLIT_SQL + """,
nm AS (SELECT 'num__o_totalprice' AS feature UNION ALL SELECT 'num__c_acctbal' UNION ALL SELECT 'random_feature'
       UNION ALL SELECT DISTINCT 'cat__o_orderstatus_' || o_orderstatus FROM sp WHERE split = 'train'
       UNION ALL SELECT DISTINCT 'cat__r_name_' || r_name FROM sp WHERE split = 'train')"""


def _names(spark: SparkSession, sf: str) -> list[str]:
    sp = split_frame(spark, sf)
    pre = Preprocessor(encoding="onehot").fit(sp.where(F.col("split") == "train"),
                                              ["o_totalprice", "c_acctbal", "o_orderstatus", "r_name"])
    return pre.feature_names() + ["random_feature"]


@register("feature_groups", _NAMES_SQL + """ SELECT feature, CASE WHEN contains(feature, 'r_name') THEN 'hazard'
  WHEN contains(feature, 'random_feature') THEN 'random' ELSE 'building' END AS grp FROM nm""")
def q_groups(spark: SparkSession, sf: str):
    hz, rnd, bld = partition_features(_names(spark, sf), ["r_name"])
    rows = [(f, "hazard") for f in hz] + [(f, "random") for f in rnd] + [(f, "building") for f in bld]
    return spark.createDataFrame(rows, "feature string, grp string")


@register("feature_assembly", _NAMES_SQL + """ SELECT feature, 'main' AS feature_set FROM nm WHERE NOT contains(feature, 'r_name')
  UNION ALL SELECT feature, 'residual' FROM nm""")
def q_assembly(spark: SparkSession, sf: str):
    main, residual = assemble_features(_names(spark, sf), ["r_name"])
    rows = [(f, "main") for f in main] + [(f, "residual") for f in residual]
    return spark.createDataFrame(rows, "feature string, feature_set string")
