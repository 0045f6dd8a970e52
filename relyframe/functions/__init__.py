"""Column-level functions (all JVM-side expressions)."""

from relyframe.functions.missing import (normalize_missing, to_numeric, is_finite,
                                         numeric_columns, string_columns)
from relyframe.functions.hashing import uniform, hash_order
from relyframe.functions.boxcox import boxcox, inv_boxcox, clamp_boxcox_domain
from relyframe.functions.special import erf, norm_cdf, lognorm_cdf, digamma_int

__all__ = ["normalize_missing", "to_numeric", "is_finite", "numeric_columns",
           "string_columns", "uniform", "hash_order", "boxcox", "inv_boxcox",
           "clamp_boxcox_domain", "erf", "norm_cdf", "lognorm_cdf", "digamma_int"]
