"""The published queue: which rows, thinned how, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import col_or, number, text
from .spatial import thin

# Fixed values.
KNOWN_RADIUS_M, SPACING_M, PER_ROAD = 15.0, 100.0, 250
SCORE_COLUMNS = ("discovery_score", "culvert_likelihood_score", "culvert_probability")
PUBLISHED = (
    "candidate_id",
    "discovery_rank",
    "discovery_score",
    "discovery_status",
    "is_known_field_match",
    "evidence_score",
    "model_probability_score",
    "model_rank_score",
    "priority_rank",
    "priority_bucket",
    "culvert_likelihood_score",
    "culvert_probability",
    "road_name",
    "stream_name",
    "matched_route",
    "road_id",
    "stream_id",
    "source",
    "evidence_summary",
    "google_earth_url",
    "latitude",
    "longitude",
    "road_stream_distance_m",
    "crossing_angle_degrees",
    "road_stream_proximity_score",
    "drainage_strength_score",
    "valley_position_score",
    "crossing_geometry_score",
    "terrain_break_score",
    "road_context_score",
    "dem_route_drainage_score",
    "osm_culvert_tag_score",
    "field_report_support_score",
    "field_corridor_support_score",
    "non_culvert_structure_penalty",
    "dist_to_known_culvert_m",
    "is_culvert",
    "stream_order",
    "road_highway",
    "road_bridge",
    "road_tunnel",
    "stream_waterway",
    "stream_tunnel",
    "stream_culvert",
    "field_report_source_file",
    "field_report_date",
    "nearest_field_report_date",
    "nearest_field_report_route",
    "nearest_field_report_culvert_id",
    "nearest_field_report_source_file",
    "slope_degrees",
    "valley_depth_9x9_m",
    "valley_depth_31x31_m",
    "topographic_position_9x9_m",
    "topographic_wetness_proxy_9x9",
    "topographic_wetness_proxy_31x31",
    "low_slope_valley_score_9x9",
    "terrain_break_score_proxy_9x9",
    "flow_accumulation_log",
    "flow_accumulation_rank_pct",
    "drainage_area_log",
    "drainage_area_rank_pct",
    "terrain_roughness_9x9_m",
    "stream_density_250m_m_per_sqkm",
    "road_density_250m_m_per_sqkm",
)


def pool(df: DataFrame) -> DataFrame:
    """Rows that are neither known, denied, near a known site nor reported; an unknown distance stays."""
    if "discovery_status" in df.columns:
        df = df.where(~text("discovery_status").isin("known_field_match", "field_denied"))
    if "is_known_field_match" in df.columns:
        df = df.where(F.coalesce(number("is_known_field_match"), F.lit(0.0)).cast("long") != 1)
    if "dist_to_known_culvert_m" in df.columns:
        df = df.where(F.coalesce(number("dist_to_known_culvert_m") > KNOWN_RADIUS_M, F.lit(True)))
    if "source" in df.columns:
        df = df.where(text("source") != "field_report_observed_culvert")
    return df


def score_column(df: DataFrame) -> str | None:
    return next((c for c in SCORE_COLUMNS if c in df.columns), None)


def preferred_order(df: DataFrame) -> list:
    """How published rows are ordered before their id: by discovery_rank, else by falling score, else by priority_rank."""
    score = score_column(df)
    if "discovery_rank" in df.columns:
        return ["discovery_rank"]
    if score:
        return [(-F.coalesce(number(score), F.lit(float("-inf")))).alias("_score")]
    return ["priority_rank"] if "priority_rank" in df.columns else []


def road_key(df: DataFrame) -> Column:
    """The route, road name or road id, whichever says something first, with its kind in front."""
    def said(name: str) -> Column:
        v = F.trim(F.regexp_replace(F.lower(text(col_or(df, name))), r"(?U)\s+", " "))
        return F.when((v != "") & ~v.isin("nan", "none", "<na>"), F.concat(F.lit(f"{name}:"), v))
    return F.coalesce(*map(said, ("matched_route", "road_name", "road_id")), F.lit("road:unknown"))


def declutter(df: DataFrame, order: list, limit: int | None = None, spacing: float = SPACING_M, per_road: int = PER_ROAD, row: str = "candidate_id") -> DataFrame:
    """Rows a walk by ``order`` would publish: per road first, then by spacing, at most ``limit``."""
    kept = thin(df.withColumn("_road", road_key(df)), row, order, spacing, "_road", per_road).drop("_road")
    return kept.orderBy(*order, row).limit(limit) if limit else kept


def published(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in PUBLISHED if c in df.columns])


def known_count(df: DataFrame) -> Column:
    if "is_known_field_match" in df.columns:
        return F.coalesce(F.sum(F.coalesce(number("is_known_field_match"), F.lit(0.0))), F.lit(0.0)).cast("long")
    if "discovery_status" in df.columns:
        return F.count_if(text("discovery_status") == "known_field_match")
    return F.coalesce(F.sum(F.coalesce(number("is_culvert"), F.lit(0.0))), F.lit(0.0)).cast("long") if "is_culvert" in df.columns else F.lit(0).cast("long")


def summary(df: DataFrame, score: str | None = None) -> DataFrame:
    """One row: rows, candidates, known matches, highest and mean score of the others, buckets and bounds."""
    score = score or score_column(df)
    open_ = ~text("discovery_status").eqNullSafe("known_field_match") if "discovery_status" in df.columns else F.lit(True)
    value = F.when(open_, number(score)) if score else F.lit(None).cast("double")
    totals = df.agg(F.count("*").alias("rows"), known_count(df).alias("known_field_matches"), F.max(value).alias("max_score"), F.avg(value).alias("mean_score"), *[f(c).alias(f"{n}_{c}") for c in ("longitude", "latitude") for n, f in (("min", F.min), ("max", F.max))])
    counts = df.groupBy(F.coalesce("priority_bucket", F.lit("unknown")).alias("b")).agg(F.count("*").alias("n"))
    buckets = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("b", "n")))).alias("priority_buckets"))
    out = totals.join(buckets, F.lit(True))  # one row each
    return out.withColumn("discovery_candidates", F.col("rows") - F.col("known_field_matches"))


def cell_declutter(df: DataFrame, size: float, order: list[Column], keep: Column) -> DataFrame:
    """The best row of each square cell, and all rows that must stay."""
    w = Window.partitionBy(F.floor(F.col("x") / size), F.floor(F.col("y") / size)).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | keep).drop("_n")


def kml(df: DataFrame, limit: int = 250) -> DataFrame:
    """Placemarks of the first rows by rank, one string each (the sink joins them)."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    score = F.coalesce(*[number(c) for c in SCORE_COLUMNS[:2] if c in df.columns], F.lit(0.0))
    parts = [
        F.format_string("<name>Rank %d: %s</name>", F.col("priority_rank").cast("long"), esc(col_or(df, "priority_bucket", "candidate"))),
        F.format_string("<description>Score: %.1f<br/>Status: %s<br/>Evidence: %s<br/>Road: %s<br/>Stream/drainage: %s</description>", score, *[esc(col_or(df, c, d)) for c, d in (("discovery_status", "candidate"), ("evidence_summary", ""), ("road_name", "unknown"), ("stream_name", "unknown"))]),
        F.format_string("<Point><coordinates>%.8f,%.8f,0</coordinates></Point>", F.col("longitude"), F.col("latitude")),
    ]
    return df.orderBy("priority_rank").limit(limit).select("priority_rank", F.concat(F.lit("<Placemark>"), *parts, F.lit("</Placemark>")).alias("placemark"))
