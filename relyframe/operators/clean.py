"""Schema- and row-level cleaning (F-series). Column drops are metadata
only; row filters are single predicates Catalyst pushes toward the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relyframe.functions.hashing import uniform
from relyframe.functions.missing import is_finite, to_numeric
from relyframe.operators.distinct import distinct_up_to
from relyframe.operators.stats import profile, q


def drop_missing(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a missing value in ``subset`` (all columns when None)."""
    return df.dropna(how="any", subset=subset)


def low_variation_profile(df: DataFrame, threshold: int = 1) -> DataFrame:
    """(column, n_distinct, keep) with keep = n_distinct > threshold (nulls not counted)."""
    return profile(df).select("column", "n_distinct", (F.col("n_distinct") > threshold).alias("keep"))


def drop_low_variation(df: DataFrame, threshold: int = 1) -> DataFrame:
    """Keep columns with more than ``threshold`` distinct values.

    For threshold 1 that is min < max, one aggregate without a shuffle of
    values; other thresholds count distinct values up to the threshold.
    """
    if threshold == 1:
        texts = {c: F.col(q(c)).cast("string") for c in df.columns}
        row = df.agg(*[(F.min(x) < F.max(x)).alias(f"v{i}") for i, x in enumerate(texts.values())]).first()
        return df.select(*[F.col(q(c)) for i, c in enumerate(df.columns) if row[f"v{i}"]])
    keep = {r["column"] for r in distinct_up_to(df, df.columns, threshold + 1).where(F.col("n_distinct") > threshold).collect()}
    return df.select(*[F.col(q(c)) for c in df.columns if c in keep])


def columns_matching(cols: list[str], keywords: list[str], case_sensitive: bool = False) -> list[str]:
    if case_sensitive:
        return [c for c in cols if any(k in c for k in keywords)]
    return [c for c in cols if any(k.lower() in c.lower() for k in keywords)]


def drop_columns_matching(df: DataFrame, keywords: list[str]) -> DataFrame:
    """Drop columns whose name contains any keyword (case-insensitive substring)."""
    return df.drop(*columns_matching(df.columns, keywords))


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop listed columns; absent names are ignored."""
    return df.drop(*[c for c in names if c in df.columns])


def drop_superseded(df: DataFrame, old: str = "_o", new: str = "_u") -> DataFrame:
    """Drop ``x_o`` when ``x_u`` is also present."""
    cols = set(df.columns)
    gone = [c[: -len(new)] + old for c in df.columns if c.endswith(new) and c[: -len(new)] + old in cols]
    return df.drop(*gone)


def replace_values(df: DataFrame, mapping: dict[str, dict]) -> DataFrame:
    """Exact per-column value replacement on the text form, then a lenient
    numeric cast of the replaced columns ('' and unparsable text become NULL)."""
    out = []
    for c in df.columns:
        if c in mapping:
            x = F.col(q(c)).cast("string")
            e = x
            for old, new in mapping[c].items():
                e = F.when(x == F.lit(str(old)), F.lit(str(new))).otherwise(e)
            out.append(to_numeric(e).alias(c))
        else:
            out.append(F.col(q(c)))
    return df.select(*out)


def invalid_row(df: DataFrame, sentinels: list[str] = ("#NAME?",)) -> Column:
    """True when a numeric column holds +/-inf or any column holds a sentinel text."""
    conds = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            conds.append(F.coalesce(F.abs(c) == F.lit(float("inf")), F.lit(False)))
        if isinstance(f.dataType, T.StringType) and sentinels:
            conds.append(F.coalesce(c.isin(list(sentinels)), F.lit(False)))
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def drop_invalid_rows(df: DataFrame, sentinels: list[str] = ("#NAME?",)) -> DataFrame:
    return df.where(~invalid_row(df, sentinels))


def replace_invalid(df: DataFrame, value: float = -100.0, sentinels: list[str] = ("#NAME?",),
                    only_sentinels: bool = False) -> DataFrame:
    """Replace +/-inf (numeric columns) and sentinel texts with ``value``.

    A sentinel in a text column becomes the value's text form; with
    ``only_sentinels`` infinities are kept (the keep-inf mode uses -inf).
    """
    out = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and not only_sentinels:
            out.append(F.when(F.abs(c) == F.lit(float("inf")), F.lit(float(value))).otherwise(c).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            txt = "-inf" if value == float("-inf") else str(value)
            out.append(F.when(c.isin(list(sentinels)), F.lit(txt)).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def filter_finite(df: DataFrame, col: str) -> DataFrame:
    return df.where(is_finite(F.col(q(col))))


def partition_features(cols: list[str], hazard_keywords: list[str],
                       random_keyword: str = "random_feature") -> tuple[list[str], list[str], list[str]]:
    """(hazard, random, building) by case-sensitive substring."""
    hazard = columns_matching(cols, hazard_keywords, case_sensitive=True)
    rnd = columns_matching(cols, [random_keyword], case_sensitive=True)
    excl = set(hazard) | set(rnd)
    return hazard, rnd, [c for c in cols if c not in excl]


def assemble_features(cols: list[str], hazard_keywords: list[str], keep_hazard: bool = False) -> tuple[list[str], list[str]]:
    """Main set (building [+ hazard] + random) and residual set (all three, sorted)."""
    hazard, rnd, building = partition_features(cols, hazard_keywords)
    main = building + (hazard if keep_hazard else []) + rnd
    residual = sorted(set(building) | set(hazard) | set(rnd))
    return main, residual


def align_columns(df: DataFrame, cols: list[str], fill: float = 0.0) -> DataFrame:
    """Project to ``cols`` in order; absent columns are filled with ``fill``."""
    have = set(df.columns)
    return df.select(*[F.col(q(c)) if c in have else F.lit(fill).cast("double").alias(c) for c in cols])


def add_random_feature(df: DataFrame, seed: int = 42, id_col: str = "row_id",
                       name: str = "random_feature") -> DataFrame:
    return df.withColumn(name, uniform(seed, "random_feature", F.col(id_col)))


def force_categorical(df: DataFrame, cols: list[str]) -> DataFrame:
    """Cast listed columns to text (NULL stays NULL)."""
    return df.select(*[F.col(q(c)).cast("string").alias(c) if c in cols else F.col(q(c)) for c in df.columns])
