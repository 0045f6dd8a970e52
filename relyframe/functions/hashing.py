"""Seeded, partition-independent pseudo-random numbers.

``F.rand(seed)`` depends on how rows fall into partitions, so reruns after
a lost executor or a different partition count draw other numbers. Here a
uniform is a pure function of (seed, purpose, key): the first 13 hex digits
(52 bits) of ``md5(seed|purpose|key)`` divided by 2**52. DuckDB computes the
same bits with ``md5`` + hex parsing, so oracles see identical draws.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2 ** 52)


def hash_key(seed: int, purpose: str, *keys: Column | str) -> Column:
    parts = [F.lit(str(seed)), F.lit(purpose)]
    for k in keys:
        parts.append((F.col(k) if isinstance(k, str) else k).cast("string"))
    return F.concat_ws("|", *parts)


def uniform(seed: int, purpose: str, *keys: Column | str) -> Column:
    """Uniform [0, 1) from md5 of ``seed|purpose|key...``."""
    h = F.md5(hash_key(seed, purpose, *keys))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(TWO_52)


def uniform_sql(seed: int, purpose: str, *key_sql: str) -> str:
    """DuckDB spelling of :func:`uniform` (for oracles)."""
    parts = " || '|' || ".join([f"'{seed}'", f"'{purpose}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql])
    return f"(CAST(('0x' || substr(md5({parts}), 1, 13)) AS BIGINT)::DOUBLE / {TWO_52!r})"


def hash_order(seed: int, purpose: str, *keys: Column | str) -> Column:
    """A 52-bit integer sort key (ties broken by the caller's id)."""
    h = F.md5(hash_key(seed, purpose, *keys))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint")


def hash_order_sql(seed: int, purpose: str, *key_sql: str) -> str:
    parts = " || '|' || ".join([f"'{seed}'", f"'{purpose}'"] + [f"CAST({k} AS VARCHAR)" for k in key_sql])
    return f"CAST(('0x' || substr(md5({parts}), 1, 13)) AS BIGINT)"


def uniform_of(seed: int, *parts: Column) -> Column:
    """Uniform [0, 1) from md5 of ``seed|part...`` where parts are columns."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(TWO_52)
