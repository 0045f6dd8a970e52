"""Code -> display-name lookups (fallback: the code itself)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Display names of encoded features used by the MI ranking.
MI_LABELS = {
    "cat__EF_scale": "EF Scale",
    "cat__archetype": "Building Archetype",
    "num__distance": "Distance",
    "cat__const_material_h_othr": "Horizontal Construction Material\n(Other)",
    "num__building_area_m2": "Building Area (m²)",
    "cat__shared_wall": "Shared Wall",
    "num__wall_fenesteration_per_back": "Wall Fenestration (Back, %)",
    "cat__retrofit_type_u": "Retrofit Type",
    "num__foundation_type_u_unc": "Uncertainty Level of Foundation Type",
    "cat__const_material_h_rglr_stone": "Horizontal Construction Material\n(Regular Stone)",
    "cat__prop_val_communal": "Communal Property Value",
    "cat__foundation_type_u": "Foundation Type",
    "cat__buidling_use_before_tornado": "Building in Use or Not (Pre-tornado)",
    "num__overhang_length_u": "Overhang Length",
    "num__number_stories": "Number of Stories",
    "cat__wall_anchorage_type_u": "Wall Anchorage Type",
    "cat__prop_val_historical": "Historical Property Value",
    "num__random_feature": "Random Feature",
    "cat__wall_cladding_u": "Wall Cladding",
    "num__first_floor_elevation_m": "First Floor Elevation (m)",
    "cat__const_material_h_brick": "Horizontal Construction Material\n(Brick)",
    "cat__prop_val_evidential": "Evidential Property Value",
    "num__roof_system_u_unc": "Uncertainty Level of Roof System",
    "num__wall_substrate_u_unc": "Wall Substrate (Uncertainty Level)",
    "cat__owner_business": "Owner Type (Business)",
    "cat__mwfrs_u_wall": "MWFRS (Wall)",
    "cat__mwfrs_u_moment_frame": "MWFRS (Moment Frame)",
    "cat__owner_government": "Owner Type (Government)",
    "num__latitude": "Latitude",
    "num__longitude": "Longitude",
}

# Display names used by the MCR range table.
MCR_LABELS = {
    "cat__EF_scale": "EF Scale",
    "cat__archetype": "Building Archetype",
    "num__distance": "Distance",
    "cat__const_material_h_othr": "Horizontal Construction Material\n(Other)",
    "num__building_area_m2": "Building Area (m²)",
    "cat__shared_wall": "Shared Wall",
    "num__wall_fenesteration_per_back": "Wall Fenestration (Back, %)",
    "cat__retrofit_type_u": "Retrofit Type",
    "num__foundation_type_u_unc": "Uncertainty Level of Foundation Type",
    "cat__const_material_h_rglr_stone": "Horizontal Construction Material\n(Regular Stone)",
    "cat__prop_val_communal": "Communal Property Value",
    "cat__foundation_type_u": "Foundation Type",
    "cat__buidling_use_before_tornado": "Building in Use or Not (Pre-tornado)",
    "num__overhang_length_u": "Overhang Length",
    "num__number_stories": "Number of Stories",
    "cat__wall_anchorage_type_u": "Wall Anchorage Type",
    "cat__prop_val_historical": "Historical Property Value",
    "num__wall_substrate_u_unc": "Wall Substrate (Uncertainty Level)",
    "cat__owner_business": "Owner Type (Business)",
    "cat__mwfrs_u_wall": "MWFRS (Wall)",
    "cat__mwfrs_u_moment_frame": "MWFRS (Moment Frame)",
    "cat__owner_government": "Owner Type (Government)",
    "num__random_feature": "Random Feature",
}


def label_table(spark: SparkSession, mapping: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(mapping.items()), "code string, name string")


def map_labels(df: DataFrame, col: str, labels: DataFrame, out: str = "display") -> DataFrame:
    """Broadcast left join (the label table is a fixed few dozen rows) + coalesce."""
    j = df.join(labels, df[col] == labels.code, "left")
    return j.withColumn(out, F.coalesce(F.col("name"), F.col(col))).drop("code", "name")


def labels_sql(mapping: dict[str, str]) -> str:
    def esc(s):
        return s.replace("'", "''").replace("\n", "' || chr(10) || '")
    return "(VALUES " + ", ".join(f"('{esc(k)}', '{esc(v)}')" for k, v in sorted(mapping.items())) + ") t(code, name)"
