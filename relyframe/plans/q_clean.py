"""Cleaning proofs (F-series, C1-C3, A1, A2, A4, A6) over the dirty frame."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from relyframe.functions.missing import to_numeric
from relyframe.operators import clean as C
from relyframe.operators.encode import fill_median
from relyframe.operators.stats import fingerprint, profile
from relyframe.plans.catalog import register, rounded
from relyframe.plans.frame import FF_SQL, RAW_SQL, raw_frame, standard_frame
from relyframe.plans.pipeline import CleanConfig, clean_stage, prepare_stage
from relyframe.plans.sqlfrag import CLEAN_SQL, PREP_SQL, WALL, to_numeric_sql
from relyframe.functions.hashing import uniform_sql

CFG = CleanConfig()
RAW_COLS = ["row_id", "target", "o_totalprice", "c_acctbal", "n_items", "sum_price", "avg_disc", "avg_tax",
            "o_orderstatus", "o_orderpriority", "c_mktsegment", "r_name", "wall_dirty", "area_dirty",
            "price_o", "price_u", "disc_o", "photos_n", "unnamed_0", "notes", "const_flag", "empty_col"]


def _sel(cols, src="raw", where=""):
    return f"SELECT {', '.join(cols)} FROM {src} {where}"


def _round_sql(cols_types: list[tuple[str, str]]) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" if t == "d" else c for c, t in cols_types)


@register("clean_drop_missing_target", "WITH " + RAW_SQL + _sel(RAW_COLS, where="WHERE target IS NOT NULL"))
def q_drop_missing_target(spark: SparkSession, sf: str):
    return C.drop_missing(raw_frame(spark, sf), ["target"])


_PROFILE_PARTS = " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, count(DISTINCT {c}) > 1 AS keep FROM d"
    for c in RAW_COLS)


@register("clean_low_variation", "WITH " + RAW_SQL + ", d AS (SELECT * FROM raw WHERE target IS NOT NULL) "
          + _PROFILE_PARTS)
def q_low_variation(spark: SparkSession, sf: str):
    return C.low_variation_profile(C.drop_missing(raw_frame(spark, sf), ["target"]), 1)


_KW_KEEP = [c for c in RAW_COLS if c not in ("photos_n", "unnamed_0")]


@register("clean_keyword_drop", "WITH " + RAW_SQL + _sel(_KW_KEEP))
def q_keyword_drop(spark: SparkSession, sf: str):
    return C.drop_columns_matching(raw_frame(spark, sf), CFG.keywords_to_drop)


@register("clean_specific_drop", "WITH " + RAW_SQL + _sel([c for c in RAW_COLS if c != "notes"]))
def q_specific_drop(spark: SparkSession, sf: str):
    return C.drop_columns(raw_frame(spark, sf), CFG.specific_drop)


@register("clean_superseded_drop", "WITH " + RAW_SQL + _sel([c for c in RAW_COLS if c != "price_o"]))
def q_superseded_drop(spark: SparkSession, sf: str):
    return C.drop_superseded(raw_frame(spark, sf))


@register("clean_value_replace", "WITH " + RAW_SQL + f"SELECT row_id, {WALL} AS wall_dirty FROM raw")
def q_value_replace(spark: SparkSession, sf: str):
    return C.replace_values(raw_frame(spark, sf), CFG.value_replacement).select("row_id", "wall_dirty")


@register("to_numeric", "WITH " + RAW_SQL + f"SELECT row_id, area_dirty, {to_numeric_sql('area_dirty')} AS area_num, "
          f"{to_numeric_sql('wall_dirty')} AS wall_num FROM raw")
def q_to_numeric(spark: SparkSession, sf: str):
    r = raw_frame(spark, sf)
    return r.select("row_id", "area_dirty", to_numeric(F.col("area_dirty")).alias("area_num"),
                    to_numeric(F.col("wall_dirty")).alias("wall_num"))


@register("force_categorical", "WITH " + FF_SQL + "SELECT row_id, CAST(n_items AS VARCHAR) AS n_items, "
          "CAST(o_custkey AS VARCHAR) AS o_custkey FROM ff")
def q_force_categorical(spark: SparkSession, sf: str):
    return C.force_categorical(standard_frame(spark, sf), ["n_items", "o_custkey"]).select("row_id", "n_items", "o_custkey")


@register("random_feature", "WITH " + FF_SQL + f"SELECT row_id, round({uniform_sql(42, 'random_feature', 'row_id')}, 6) "
          "AS random_feature FROM ff")
def q_random_feature(spark: SparkSession, sf: str):
    return rounded(C.add_random_feature(standard_frame(spark, sf), 42).select("row_id", "random_feature"))


_CLEAN_ROUNDED = ("row_id, round(target, 6) AS target, round(o_totalprice, 6) AS o_totalprice, round(c_acctbal, 6) AS c_acctbal, "
                  "n_items, round(sum_price, 6) AS sum_price, round(avg_disc, 6) AS avg_disc, round(avg_tax, 6) AS avg_tax, "
                  "o_orderstatus, o_orderpriority, c_mktsegment, r_name, round(wall_dirty, 6) AS wall_dirty, area_dirty, "
                  "round(price_u, 6) AS price_u, round(disc_o, 6) AS disc_o, round(random_feature, 6) AS random_feature")


@register("clean_pipeline", "WITH " + CLEAN_SQL + f"SELECT {_CLEAN_ROUNDED} FROM clean")
def q_clean_pipeline(spark: SparkSession, sf: str):
    return rounded(clean_stage(raw_frame(spark, sf), CFG))


@register("clean_drop_any_missing", "WITH " + CLEAN_SQL + f"SELECT {_CLEAN_ROUNDED} FROM clean "
          "WHERE wall_dirty IS NOT NULL AND area_dirty IS NOT NULL")
def q_drop_any_missing(spark: SparkSession, sf: str):
    cfg = CleanConfig(missing_strategy="drop_rows")
    return rounded(clean_stage(raw_frame(spark, sf), cfg))


@register("clean_drop_invalid", "WITH " + PREP_SQL.split(",\nfixed AS")[0] + f" SELECT {_CLEAN_ROUNDED} FROM valid")
def q_drop_invalid(spark: SparkSession, sf: str):
    return rounded(C.drop_invalid_rows(clean_stage(raw_frame(spark, sf), CFG), CFG.sentinels))


_REPL = _CLEAN_ROUNDED.replace("round(wall_dirty, 6) AS wall_dirty",
                               "round(CASE WHEN abs(wall_dirty) = 'inf'::DOUBLE THEN -100.0 ELSE wall_dirty END, 6) AS wall_dirty") \
    .replace("area_dirty,", "CASE WHEN area_dirty = '#NAME?' THEN '-100.0' ELSE area_dirty END AS area_dirty,")


@register("clean_replace_invalid", "WITH " + CLEAN_SQL + f"SELECT {_REPL} FROM clean")
def q_replace_invalid(spark: SparkSession, sf: str):
    return rounded(C.replace_invalid(clean_stage(raw_frame(spark, sf), CFG), -100.0, CFG.sentinels))


_KEEP = _CLEAN_ROUNDED.replace("area_dirty,", "CASE WHEN area_dirty = '#NAME?' THEN '-inf' ELSE area_dirty END AS area_dirty,")


@register("clean_keep_inf", "WITH " + CLEAN_SQL + f"SELECT {_KEEP} FROM clean")
def q_keep_inf(spark: SparkSession, sf: str):
    return rounded(C.replace_invalid(clean_stage(raw_frame(spark, sf), CFG), float("-inf"), CFG.sentinels,
                                     only_sentinels=True))


@register("impute_global_median", "WITH " + PREP_SQL + "SELECT row_id, round(area_dirty, 6) AS area_dirty FROM fixed")
def q_impute_global_median(spark: SparkSession, sf: str):
    d = C.drop_invalid_rows(clean_stage(raw_frame(spark, sf), CFG), CFG.sentinels)
    return rounded(fill_median(d, ["area_dirty"]).select("row_id", "area_dirty"))


_PREP_COLS = [c for c in ["row_id", "target", "o_totalprice", "c_acctbal", "n_items", "sum_price", "avg_disc",
                          "avg_tax", "o_orderstatus", "o_orderpriority", "c_mktsegment", "r_name", "wall_dirty",
                          "area_dirty", "price_u", "random_feature"]]
_PREP_ROUNDED = ", ".join(f"round({c}, 6) AS {c}" if c not in ("row_id", "n_items", "o_orderstatus", "o_orderpriority",
                                                                 "c_mktsegment", "r_name") else c for c in _PREP_COLS)


@register("prepare_pipeline", "WITH " + PREP_SQL + f"SELECT {_PREP_ROUNDED} FROM prep")
def q_prepare(spark: SparkSession, sf: str):
    return rounded(prepare_stage(clean_stage(raw_frame(spark, sf), CFG), CFG))


@register("filter_finite", "WITH " + CLEAN_SQL + "SELECT row_id, round(wall_dirty, 6) AS wall_dirty FROM clean "
          "WHERE wall_dirty IS NOT NULL AND NOT isnan(wall_dirty) AND abs(wall_dirty) < 'inf'::DOUBLE")
def q_filter_finite(spark: SparkSession, sf: str):
    return rounded(C.filter_finite(clean_stage(raw_frame(spark, sf), CFG), "wall_dirty").select("row_id", "wall_dirty"))


_FF_COLS = ["row_id", "o_custkey", "o_totalprice", "c_acctbal", "n_items", "sum_qty", "sum_price", "avg_disc",
            "avg_tax", "o_orderstatus", "o_orderpriority", "c_mktsegment", "r_name"]


@register("profile_nunique", "WITH " + FF_SQL + " SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column, CAST(count(DISTINCT {c}) AS BIGINT) AS n_distinct, "
    f"CAST(count(*) - count({c}) AS BIGINT) AS n_missing FROM ff" for c in _FF_COLS) + ")")
def q_profile(spark: SparkSession, sf: str):
    return profile(standard_frame(spark, sf)).withColumn("n_missing", F.col("n_missing").cast("bigint"))


@register("value_counts", "WITH " + FF_SQL + "SELECT sum_qty, CAST(count(*) AS BIGINT) AS n FROM ff "
          "WHERE sum_qty IS NOT NULL GROUP BY sum_qty")
def q_value_counts(spark: SparkSession, sf: str):
    return standard_frame(spark, sf).where(F.col("sum_qty").isNotNull()).groupBy("sum_qty") \
        .agg(F.count(F.lit(1)).alias("n"))


_FP_COLS = ["row_id", "o_custkey", "o_orderstatus", "n_items", "c_mktsegment"]
_FP_TEXT = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in _FP_COLS)


@register("fingerprint", "WITH " + FF_SQL + "SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(CAST(sum(CAST(('0x' || "
          f"substr(md5({_FP_TEXT}), 1, 13)) AS BIGINT)) AS DECIMAL(38,0)) AS VARCHAR) AS content_hash FROM ff")
def q_fingerprint(spark: SparkSession, sf: str):
    return fingerprint(standard_frame(spark, sf), _FP_COLS)


@register("align_columns", "WITH " + FF_SQL + "SELECT row_id, round(o_totalprice, 6) AS o_totalprice, "
          "0.0 AS num__absent_feature, round(c_acctbal, 6) AS c_acctbal FROM ff")
def q_align(spark: SparkSession, sf: str):
    return rounded(C.align_columns(standard_frame(spark, sf),
                                   ["row_id", "o_totalprice", "num__absent_feature", "c_acctbal"]))


@register("stage_audit", "WITH " + PREP_SQL + """
SELECT * FROM (
  SELECT 'raw' AS stage, CAST(count(*) AS BIGINT) AS n_rows, 22 AS n_cols FROM raw UNION ALL
  SELECT 'clean', CAST(count(*) AS BIGINT), 17 FROM clean UNION ALL
  SELECT 'valid', CAST(count(*) AS BIGINT), 17 FROM valid UNION ALL
  SELECT 'prepared', CAST(count(*) AS BIGINT), 16 FROM prep)""")
def q_stage_audit(spark: SparkSession, sf: str):
    raw = raw_frame(spark, sf)
    cleaned = clean_stage(raw, CFG)
    valid = C.drop_invalid_rows(cleaned, CFG.sentinels)
    prep = prepare_stage(cleaned, CFG)
    parts = [(n, d) for n, d in [("raw", raw), ("clean", cleaned), ("valid", valid), ("prepared", prep)]]
    out = None
    for name, d in parts:
        one = d.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("stage"), "n_rows",
                                                              F.lit(len(d.columns)).alias("n_cols"))
        out = one if out is None else out.unionByName(one)
    return out
