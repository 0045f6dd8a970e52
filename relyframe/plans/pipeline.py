"""Stage functions chaining the operators in the order the analysis needs.

clean_stage:   F1 -> F3 -> F4 -> F5 -> F6 -> F7 -> (F2) -> C3 -> C2
prepare_stage: F8 | F9 -> E1 (whole-table median fix) -> F11 -> F4 (X keywords)
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relyframe.functions.missing import to_numeric
from relyframe.operators import clean as C
from relyframe.operators.encode import fill_median


@dataclass
class CleanConfig:
    target: str = "target"
    id_col: str = "row_id"
    low_variation_threshold: int = 1
    keywords_to_drop: list = field(default_factory=lambda: ["Unnamed", "photos", "details"])
    specific_drop: list = field(default_factory=lambda: ["notes", "town", "completed_by"])
    value_replacement: dict = field(default_factory=lambda: {"wall_dirty": {"un": "", "not_applicable": 0}})
    missing_strategy: str = "impute"          # or 'drop_rows'
    force_categorical: list = field(default_factory=lambda: ["n_items"])
    seed: int = 42
    # stage 2
    drop_inf: bool = True
    inf_replacement: float = -100.0
    sentinels: list = field(default_factory=lambda: ["#NAME?"])
    median_fix: list = field(default_factory=lambda: ["area_dirty"])
    # medians over all rows before the split, as the analysis did at first; else train's medians fill them later
    fill_before_split: bool = True
    x_keywords_to_drop: list = field(default_factory=lambda: ["disc_o"])


def clean_stage(raw: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    df = C.drop_missing(raw, [cfg.target])
    df = C.drop_low_variation(df, cfg.low_variation_threshold)
    df = C.drop_columns_matching(df, cfg.keywords_to_drop)
    df = C.drop_columns(df, cfg.specific_drop)
    df = C.drop_superseded(df)
    df = C.replace_values(df, {k: v for k, v in cfg.value_replacement.items() if k in df.columns})
    if cfg.missing_strategy == "drop_rows":
        df = C.drop_missing(df)
    df = C.add_random_feature(df, cfg.seed, cfg.id_col)
    return C.force_categorical(df, [c for c in cfg.force_categorical if c in df.columns])


def prepare_stage(cleaned: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    if cfg.drop_inf:
        df = C.drop_invalid_rows(cleaned, cfg.sentinels)
    else:
        df = C.replace_invalid(cleaned, cfg.inf_replacement, cfg.sentinels)
    fix = [c for c in cfg.median_fix if c in df.columns]
    if cfg.fill_before_split and fix:
        df = fill_median(df, fix)
    else:
        df = df.withColumns({c: to_numeric(F.col(c)) for c in fix})
    df = df.withColumn(cfg.target, to_numeric(F.col(cfg.target))).where(F.col(cfg.target).isNotNull())
    return C.drop_columns_matching(df, cfg.x_keywords_to_drop)
