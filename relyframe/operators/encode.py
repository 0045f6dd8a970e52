"""Imputation, scaling, encoding and the Box-Cox fit: fit on train, apply to both.

Fits return one value per column, and a table of category codes; an apply
is a projection of column expressions, plus a join with the code table for
each ordinal column -- on batch or streaming DataFrames alike.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relyframe.functions.boxcox import boxcox
from relyframe.functions.missing import is_finite, to_numeric
from relyframe.operators.ordered import exact_position
from relyframe.operators.stats import long_form, q
from relyframe.session import scratch_path


# --------------------------------------------------------------- quantiles

def exact_quantiles(df: DataFrame, cols: list[str], prob: float = 0.5, finite_only: bool = True) -> dict[str, float | None]:
    """Exact linear-interpolated quantile of each column over finite values
    (``finite_only=False``: over all non-missing values, infinities included).

    Distinct (feature, value, count) rows get exact positions from a
    running count; the one or two values covering index (N-1)*prob are picked
    by a filter and an aggregate. No value list is gathered in one buffer.
    """
    lf = long_form(df.select(*[F.col(q(c)) for c in cols], F.lit(0).alias("_id")), cols, "_id")
    present = is_finite(F.col("value")) if finite_only else (F.col("value").isNotNull() & ~F.isnan("value"))
    distinct = lf.where(present).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    pos = exact_position(distinct, ["feature"], ["value"], weight_col="n", pos_col="_below",
                         total_col="_n")
    idx = (F.col("_n") - 1).cast("double") * F.lit(float(prob))
    lo = F.floor(idx)
    hi = F.ceil(idx)
    covers = lambda k: (F.col("_below") <= k) & (k < F.col("_below") + F.col("n"))
    picked = (pos.where(covers(lo) | covers(hi))
              .groupBy("feature")
              .agg(F.max(F.when(covers(lo), F.col("value"))).alias("v_lo"),
                   F.max(F.when(covers(hi), F.col("value"))).alias("v_hi"),
                   F.first(idx - lo).alias("frac")))
    out = {c: None for c in cols}
    for r in picked.collect():
        out[r["feature"]] = r["v_lo"] if r["frac"] == 0 or r["v_hi"] == r["v_lo"] else \
            r["v_lo"] + r["frac"] * (r["v_hi"] - r["v_lo"])
    return out


def exact_median(df: DataFrame, cols: list[str], **kw) -> dict[str, float | None]:
    return exact_quantiles(df, cols, 0.5, **kw)


def most_frequent(df: DataFrame, cols: list[str], as_string: bool = False) -> dict:
    """Mode per column (largest count, smallest value on ties); two aggregates,
    both partial-aggregated."""
    if as_string:
        d = df.select(*[F.col(q(c)).cast("string").alias(c) for c in cols], F.lit(0).alias("_id"))
        lf = d.unpivot(["_id"], cols, "feature", "value").where(F.col("value").isNotNull())
    else:
        lf = long_form(df.select(*[F.col(q(c)) for c in cols], F.lit(0).alias("_id")), cols, "_id")
        lf = lf.where(is_finite(F.col("value")))
    counts = lf.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("feature").agg(F.max("n").alias("n"))
    best = counts.join(top, ["feature", "n"]).groupBy("feature").agg(F.min("value").alias("mode"))
    out = {c: None for c in cols}
    for r in best.collect():
        out[r["feature"]] = r["mode"]
    return out


# ----------------------------------------------------------------- imputers

def fill_median(df: DataFrame, cols: list[str]) -> DataFrame:
    """Whole-table lenient-numeric cast + exact median fill (runs before any split).
    Infinities count as values here, as in a plain column median."""
    d = df.select(*[to_numeric(F.col(q(c))).alias(c) if c in cols else F.col(q(c)) for c in df.columns])
    med = exact_median(d, cols, finite_only=False)
    return d.select(*[F.coalesce(F.col(q(c)), F.lit(med[c]).cast("double")).alias(c) if c in cols
                      else F.col(q(c)) for c in d.columns])


def fit_numeric_imputer(df: DataFrame, cols: list[str], strategy: str = "median") -> dict[str, float]:
    if strategy == "median":
        return exact_median(df, cols)
    if strategy == "mean":
        row = df.agg(*[F.avg(F.when(is_finite(F.col(q(c))), F.col(q(c)).cast("double"))).alias(c)
                       for c in cols]).first()
        return {c: row[c] for c in cols}
    if strategy == "most_frequent":
        return most_frequent(df, cols)
    raise ValueError(f"unknown strategy {strategy}")


def apply_numeric_imputer(c: str, value) -> Column:
    """NULL, NaN, +inf and -inf are all replaced by the fitted value."""
    x = F.col(q(c)).cast("double")
    return F.when(is_finite(x), x).otherwise(F.lit(value).cast("double"))


def fit_categorical_imputer(df: DataFrame, cols: list[str], strategy: str = "constant",
                            fill_value: str = "un") -> dict[str, str]:
    if strategy == "constant":
        return {c: fill_value for c in cols}
    return most_frequent(df, cols, as_string=True)


# ------------------------------------------------------------------ scaling

def fit_standardizer(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column; zero std scales by 1."""
    row = df.agg(*[F.avg(F.col(q(c))).alias(f"m_{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(F.col(q(c))).alias(f"s_{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m = row[f"m_{i}"] or 0.0
        s = row[f"s_{i}"]
        if s is None or not math.isfinite(s) or s < 10 * np.finfo(float).eps * max(1.0, abs(m)):
            s = 1.0
        out[c] = (m, s)
    return out


def apply_standardizer(x: Column, mean: float, std: float) -> Column:
    return (x.cast("double") - F.lit(float(mean))) / F.lit(float(std))


# ----------------------------------------------------------------- encoders

def fit_categories(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, code): distinct non-null categories of each column, coded by their sort order.

    The codes are exact positions over range partitions, and the table is
    written: its size is known when it is joined, so Spark broadcasts it only
    if it is small. Any number of categories passes.
    """
    spark = df.sparkSession
    d = df.select(*[F.col(q(c)).cast("string").alias(c) for c in cols], F.lit(0).alias("_id"))
    cats = d.unpivot(["_id"], cols, "feature", "value").where(F.col("value").isNotNull()) \
        .select("feature", "value").distinct()
    coded = exact_position(cats, ["feature"], ["value"], pos_col="code", total_col=None)
    path = scratch_path(spark, "categories")
    coded.select("feature", "value", F.col("code").cast("double").alias("code")).write.parquet(path)
    return spark.read.parquet(path)


def encode_ordinal(df: DataFrame, columns: dict[str, tuple[Column, str]], codes: DataFrame, unknown: float = -1.0) -> DataFrame:
    """``df`` with a column ``name`` for each ``name: (text, feature)``: the code of the text among the
    feature's categories, ``unknown`` for others and for missing text. One join a column."""
    out = df
    for i, (name, (text, feature)) in enumerate(columns.items()):
        one = codes.where(F.col("feature") == feature).select(F.col("value").alias(f"_v{i}"), F.col("code").alias(f"_c{i}"))
        out = out.withColumn(f"_t{i}", text.cast("string")).join(one, F.col(f"_t{i}") == F.col(f"_v{i}"), "left")
        out = out.withColumn(name, F.coalesce(F.col(f"_c{i}"), F.lit(float(unknown)))).drop(f"_t{i}", f"_v{i}", f"_c{i}")
    return out


def category_list(codes: DataFrame, feature: str) -> list[str]:
    """The categories of one feature in code order (they become columns of a one-hot table)."""
    return [r["value"] for r in codes.where(F.col("feature") == feature).orderBy("code").select("value").collect()]


def onehot_exprs(c: str, x: Column, categories: list[str], prefix: str = "cat__") -> list[Column]:
    """A 0/1 column for each category; unknown and missing values are all zeros."""
    return [F.coalesce((x.cast("string") == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{prefix}{c}_{v}")
            for v in categories]


def label_encode(df: DataFrame, cols: list[str]) -> DataFrame:
    """Whole-table label encoding of the text form; missing becomes the text 'nan'."""
    filled = df.select(*[F.coalesce(F.col(q(c)).cast("string"), F.lit("nan")).alias(c) if c in cols
                         else F.col(q(c)) for c in df.columns])
    if not cols:
        return filled
    coded = encode_ordinal(filled, {c: (F.col(q(c)), c) for c in cols}, fit_categories(filled, cols))
    return coded.select(*[F.col(q(c)) for c in df.columns])


# --------------------------------------------------------------- Box-Cox fit

def _llf_aggs(x: Column, lams: list[float], log_mean: float) -> list[Column]:
    """Variance of the transform of x over its geometric mean, for each lambda: powers stay near 1."""
    out = []
    u = F.ln(x) - F.lit(log_mean)
    for i, lam in enumerate(lams):
        z = u if lam == 0 else (F.exp(F.lit(float(lam)) * u) - 1.0) / F.lit(float(lam))
        out.append(F.var_pop(z).alias(f"v{i}"))
    return out


def _llf(n: int, sum_log: float, var: float | None) -> float:
    """(lambda - 1) * sum(ln x) - n/2 * ln(var_pop(boxcox(x))), written with the scaled variance."""
    return -math.inf if var is None or not 0 < var < math.inf else -sum_log - n / 2.0 * math.log(var)


def fit_boxcox(df: DataFrame, col: str, grid: list[float] | None = None, refine_rounds: int = 6,
               points: int = 41) -> tuple[float, float]:
    """Maximum-likelihood lambda and offset for a finite, shifted-positive column.

    offset = |min| + 1 when min <= 0, else 0. llf(l) = (l-1) * sum(ln x) -
    n/2 * ln(var_pop(boxcox(x, l))). Each round evaluates a whole lambda grid in
    one aggregate job over the (cached) column, then narrows the grid around
    the best point. While the best point is an end of the grid, the grid moves
    on beyond it, so the maximum is interior (the likelihood has one peak).
    ``refine_rounds=0`` returns the best point at the step of ``grid``.
    """
    x0 = df.select(F.col(q(col)).cast("double").alias("x")).where(is_finite(F.col("x")))
    mn = x0.agg(F.min("x")).first()[0]
    if mn is None:
        raise ValueError("no finite values to fit Box-Cox")
    offset = abs(mn) + 1.0 if mn <= 0 else 0.0
    x = x0.select((F.col("x") + F.lit(offset)).alias("x")).persist()
    base = x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.ln("x")).alias("sl")).first()
    n, sl = base["n"], base["sl"]

    def llfs(lams):
        row = x.agg(*_llf_aggs(F.col("x"), lams, sl / n)).first()
        return [_llf(n, sl, row[f"v{i}"]) for i in range(len(lams))]

    lams = grid if grid is not None else list(np.linspace(-5.0, 5.0, points))
    vals = llfs(lams)
    best = int(np.argmax(vals))
    step = (lams[1] - lams[0]) if len(lams) > 1 else 0.25
    lam, val = lams[best], vals[best]
    while best in (0, len(lams) - 1) and math.isfinite(val):
        sign = -1 if best == 0 else 1
        lams = sorted(lam + sign * step * i for i in range(points))
        vals = llfs(lams)
        best = int(np.argmax(vals))
        if vals[best] <= val:
            break
        lam, val = lams[best], vals[best]
    for _ in range(refine_rounds):
        lo, hi = lam - step, lam + step
        lams = list(np.linspace(lo, hi, points))
        vals = llfs(lams)
        lam = lams[int(np.argmax(vals))]
        step = (hi - lo) / (points - 1)
    x.unpersist()
    return float(lam), float(offset)


def boxcox_llf(df: DataFrame, col: str, lam: float, offset: float) -> float:
    x = df.select((F.col(q(col)).cast("double") + F.lit(offset)).alias("x")).where(is_finite(F.col("x")))
    base = x.agg(F.count(F.lit(1)).alias("n"), F.sum(F.ln("x")).alias("sl")).first()
    return _llf(base["n"], base["sl"], x.agg(*_llf_aggs(F.col("x"), [lam], base["sl"] / base["n"])).first()[0])


# ------------------------------------------------------------- preprocessor

@dataclass
class Preprocessor:
    """Column-wise preprocessing: numeric impute + standardize, categorical
    impute + ordinal / one-hot encode, booleans passed through.

    Output names: ``num__<c>``, ``cat__<c>`` (one-hot: ``cat__<c>_<value>``),
    ``remainder__<c>``.
    """
    num_strategy: str = "median"
    cat_strategy: str = "constant"
    encoding: str = "ordinal"
    fill_value: str = "un"
    impute: bool = True
    num_cols: list = field(default_factory=list)
    cat_cols: list = field(default_factory=list)
    bool_cols: list = field(default_factory=list)
    num_fill: dict = field(default_factory=dict)
    cat_fill: dict = field(default_factory=dict)
    scale: dict = field(default_factory=dict)
    codes: DataFrame | None = None
    _lists: dict = field(default_factory=dict)

    def fit(self, train: DataFrame, cols: list[str]) -> "Preprocessor":
        sch = {f.name: f.dataType for f in train.schema.fields}
        self.num_cols = [c for c in cols if isinstance(sch[c], (T.DoubleType, T.FloatType, T.LongType,
                                                                  T.IntegerType, T.ShortType, T.ByteType,
                                                                  T.DecimalType))]
        self.cat_cols = [c for c in cols if isinstance(sch[c], T.StringType)]
        self.bool_cols = [c for c in cols if isinstance(sch[c], T.BooleanType)]
        other = [f"{c} ({sch[c].simpleString()})" for c in cols if c not in self.num_cols + self.cat_cols + self.bool_cols]
        if other:
            raise TypeError(f"neither number, text nor boolean, cast first: {', '.join(other)}")
        if self.impute and self.num_cols:
            self.num_fill = fit_numeric_imputer(train, self.num_cols, self.num_strategy)
        if self.impute and self.cat_cols:
            self.cat_fill = fit_categorical_imputer(train, self.cat_cols, self.cat_strategy, self.fill_value)
        imputed = train.select(*self._num_imputed(), *self._cat_imputed())
        if self.num_cols:
            self.scale = fit_standardizer(imputed, self.num_cols)
        if self.cat_cols:
            self.codes = fit_categories(imputed, self.cat_cols)
        return self

    def _num_imputed(self) -> list[Column]:
        if self.impute:
            return [apply_numeric_imputer(c, self.num_fill.get(c)).alias(c) for c in self.num_cols]
        return [F.col(q(c)).cast("double").alias(c) for c in self.num_cols]

    def _cat_imputed(self) -> list[Column]:
        if self.impute:
            return [F.coalesce(F.col(q(c)).cast("string"), F.lit(self.cat_fill.get(c))).alias(c)
                    for c in self.cat_cols]
        return [F.col(q(c)).cast("string").alias(c) for c in self.cat_cols]

    def _categories(self, c: str) -> list[str]:
        if c not in self._lists:
            self._lists[c] = category_list(self.codes, c)
        return self._lists[c]

    def feature_names(self) -> list[str]:
        names = [f"num__{c}" for c in self.num_cols]
        if self.encoding == "onehot":
            names += [f"cat__{c}_{v}" for c in self.cat_cols for v in self._categories(c)]
        else:
            names += [f"cat__{c}" for c in self.cat_cols]
        names += [f"remainder__{c}" for c in self.bool_cols]
        return names

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        out = [F.col(q(k)) for k in (keep or [])]
        for c, x in zip(self.num_cols, self._num_imputed()):
            m, s = self.scale[c]
            out.append(apply_standardizer(x, m, s).alias(f"num__{c}"))
        for c, x in zip(self.cat_cols, self._cat_imputed()):
            if self.encoding == "onehot":
                out += onehot_exprs(c, x, self._categories(c))
            else:
                out.append(x.alias(f"cat__{c}"))
        out += [F.col(q(c)).cast("double").alias(f"remainder__{c}") for c in self.bool_cols]
        flat = df.select(*out)
        if self.encoding == "onehot" or not self.cat_cols:
            return flat
        coded = encode_ordinal(flat, {f"cat__{c}": (F.col(q(f"cat__{c}")), c) for c in self.cat_cols}, self.codes)
        return coded.select(*[F.col(q(c)) for c in flat.columns])

    # persistence: the fitted parameters as a JSON document, the codes as a table
    def save(self, path: str, spark: SparkSession) -> str:
        params = {k: getattr(self, k) for k in self.__dataclass_fields__ if k not in ("codes", "_lists")}
        spark.createDataFrame([(json.dumps(params),)], "params string").coalesce(1).write.mode("overwrite").json(f"{path}/params")
        if self.codes is not None:
            self.codes.write.mode("overwrite").parquet(f"{path}/codes")
        return path

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> "Preprocessor":
        d = json.loads(spark.read.schema("params string").json(f"{path}/params").first()["params"])
        d["scale"] = {k: tuple(v) for k, v in d["scale"].items()}
        out = cls(**d)
        if out.cat_cols:
            out.codes = spark.read.parquet(f"{path}/codes")
        return out
