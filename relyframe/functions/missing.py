"""Missing values and lenient numeric parsing (NaN -> NULL once, at ingest)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The text spellings a CSV reader treats as missing by default.
NA_SPELLINGS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Numbers as a lenient parser accepts them: optional sign, digits with an
# optional fraction, optional exponent, or inf / infinity / nan, blanks around.
NUMERIC_PATTERN = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\s*$"

FLOAT_TYPES = (T.DoubleType, T.FloatType)
NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType,
                 T.ByteType, T.DecimalType)


def to_numeric(c: Column | str) -> Column:
    """String -> DOUBLE; anything a lenient parser rejects becomes NULL.

    ``try_cast`` alone accepts Java suffixes such as ``'1d'``; the regex
    guard keeps only plain decimal / exponent / inf spellings. NaN is missing.
    """
    col = F.col(c) if isinstance(c, str) else c
    s = F.trim(col.cast("string"))
    parsed = F.when(s.rlike(NUMERIC_PATTERN), s.try_cast("double"))
    return F.when(F.isnan(parsed), F.lit(None).cast("double")).otherwise(parsed)


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def normalize_missing(df: DataFrame, na_spellings: list[str] | None = None) -> DataFrame:
    """NaN -> NULL on float columns; NA spellings -> NULL on string columns.

    One projection, no shuffle. Infinities are kept (handled later by the
    invalid-row operators).
    """
    spell = NA_SPELLINGS if na_spellings is None else na_spellings
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, FLOAT_TYPES):
            out.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        elif isinstance(f.dataType, T.StringType) and spell:
            out.append(F.when(F.trim(c).isin(spell), F.lit(None).cast("string")).otherwise(c).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def is_finite(c: Column | str) -> Column:
    """True when the value is present, not NaN and not +/-inf."""
    col = F.col(c) if isinstance(c, str) else c
    d = col.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf")))
