"""DuckDB fragments shared by oracle queries."""

from __future__ import annotations

from relyframe.functions.hashing import uniform_sql
from relyframe.functions.missing import NUMERIC_PATTERN
from relyframe.plans.frame import RAW_SQL, dirt_sql  # noqa: F401


def to_numeric_sql(x: str) -> str:
    s = f"trim(CAST({x} AS VARCHAR))"
    v = f"TRY_CAST({s} AS DOUBLE)"
    return f"(CASE WHEN regexp_full_match({s}, '{NUMERIC_PATTERN[1:-1]}') AND NOT isnan({v}) THEN {v} END)"


def replace_sql(x: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN CAST({x} AS VARCHAR) = '{old}' THEN '{new}'" for old, new in mapping.items())
    return f"(CASE {whens} ELSE CAST({x} AS VARCHAR) END)"


WALL = to_numeric_sql(replace_sql("wall_dirty", {"un": "", "not_applicable": 0}))

CLEAN_SQL = RAW_SQL + f""",
clean AS (
  SELECT row_id, target, o_totalprice, c_acctbal, CAST(n_items AS VARCHAR) AS n_items, sum_price,
         avg_disc, avg_tax, o_orderstatus, o_orderpriority, c_mktsegment, r_name,
         {WALL} AS wall_dirty, area_dirty, price_u, disc_o,
         {uniform_sql(42, 'random_feature', 'row_id')} AS random_feature
  FROM raw WHERE target IS NOT NULL)
"""

CLEAN_COLS = ["row_id", "target", "o_totalprice", "c_acctbal", "n_items", "sum_price", "avg_disc",
              "avg_tax", "o_orderstatus", "o_orderpriority", "c_mktsegment", "r_name", "wall_dirty",
              "area_dirty", "price_u", "disc_o", "random_feature"]

PREP_SQL = CLEAN_SQL + """,
valid AS (
  SELECT * FROM clean
  WHERE NOT (coalesce(abs(target) = 'inf'::DOUBLE, false) OR coalesce(abs(o_totalprice) = 'inf'::DOUBLE, false)
     OR coalesce(abs(c_acctbal) = 'inf'::DOUBLE, false) OR coalesce(abs(sum_price) = 'inf'::DOUBLE, false)
     OR coalesce(abs(avg_disc) = 'inf'::DOUBLE, false) OR coalesce(abs(avg_tax) = 'inf'::DOUBLE, false)
     OR coalesce(abs(wall_dirty) = 'inf'::DOUBLE, false) OR coalesce(abs(price_u) = 'inf'::DOUBLE, false)
     OR coalesce(abs(disc_o) = 'inf'::DOUBLE, false) OR coalesce(abs(random_feature) = 'inf'::DOUBLE, false)
     OR coalesce(n_items = '#NAME?', false) OR coalesce(o_orderstatus = '#NAME?', false)
     OR coalesce(o_orderpriority = '#NAME?', false) OR coalesce(c_mktsegment = '#NAME?', false)
     OR coalesce(r_name = '#NAME?', false) OR coalesce(area_dirty = '#NAME?', false))),
fixed AS (
  SELECT * REPLACE (coalesce(""" + to_numeric_sql("area_dirty") + """,
         (SELECT median(""" + to_numeric_sql("area_dirty") + """) FROM valid)) AS area_dirty)
  FROM valid),
prep AS (SELECT * EXCLUDE (disc_o) FROM fixed WHERE target IS NOT NULL)
"""
