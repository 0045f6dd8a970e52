"""Box-Cox family as column expressions (lambda and offset are fitted scalars)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relyframe.functions.missing import is_finite


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def boxcox(c: Column | str, lam: float, offset: float = 0.0) -> Column:
    """Forward transform of ``x + offset``; non-finite input passes unchanged.

    lam == 0 gives ln; otherwise (x**lam - 1)/lam. A shifted value below zero
    has no transform and becomes NULL.
    """
    x = _c(c).cast("double")
    xs = x + F.lit(float(offset))
    if lam == 0:
        t = F.when(xs > 0, F.ln(xs))
    else:
        t = F.when(xs >= 0, (F.pow(xs, F.lit(float(lam))) - F.lit(1.0)) / F.lit(float(lam)))
    return F.when(is_finite(x), t).otherwise(x)


def clamp_boxcox_domain(c: Column | str, lam: float) -> Column:
    """Keep a predicted transformed value inside the inverse's domain."""
    y = _c(c).cast("double")
    if lam > 0:
        return F.greatest(y, F.lit(-1.0 / lam + 1e-6))
    if lam < 0:
        return F.least(y, F.lit(-1.0 / lam - 1e-6))
    return y


def inv_boxcox(c: Column | str, lam: float, offset: float = 0.0) -> Column:
    """Inverse transform, then subtract the offset."""
    y = _c(c).cast("double")
    if lam == 0:
        x = F.exp(y)
    else:
        base = F.lit(float(lam)) * y + F.lit(1.0)
        x = F.when(base >= 0, F.pow(base, F.lit(1.0 / lam)))
    return x - F.lit(float(offset))


def boxcox_sql(x: str, lam: float, offset: float) -> str:
    xs = f"(({x}) + {float(offset)!r})"
    if lam == 0:
        return f"CASE WHEN {xs} > 0 THEN ln({xs}) END"
    return f"CASE WHEN {xs} >= 0 THEN (pow({xs}, {float(lam)!r}) - 1.0) / {float(lam)!r} END"


def inv_boxcox_sql(y: str, lam: float, offset: float) -> str:
    if lam == 0:
        return f"(exp({y}) - {float(offset)!r})"
    base = f"({float(lam)!r} * ({y}) + 1.0)"
    return f"(CASE WHEN {base} >= 0 THEN pow({base}, {1.0 / lam!r}) END - {float(offset)!r})"


def clamp_sql(y: str, lam: float) -> str:
    if lam > 0:
        return f"greatest({y}, {(-1.0 / lam + 1e-6)!r})"
    if lam < 0:
        return f"least({y}, {(-1.0 / lam - 1e-6)!r})"
    return y
