"""Registry of named queries: a Spark builder plus, where SQL can express the
same result, an equivalent DuckDB query over the same Parquet tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column (oracles round the same way)."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(F.round(c.cast("double"), digits).alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def all_queries() -> dict[str, Callable]:
    _load()
    return {k: v[0] for k, v in REGISTRY.items()}


def all_sql() -> dict[str, str]:
    _load()
    return {k: v[1] for k, v in REGISTRY.items() if v[1]}


def _load():
    # importing the query modules fills REGISTRY
    from relyframe.plans import (q_flagship, q_clean, q_encode, q_split, q_assoc,  # noqa: F401
                                 q_mi, q_models, q_mcr, q_fragility, q_sources)
