"""Evidence scores of candidate sites, and the queue that ranks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bucket, clip, col_or, flag_is_one, number, number_or, row_mean, text, truthy
from ..functions.ranking import global_rank, pct_ranks, percentile

# Component weights, the columns each component reads, and the evidence rules.
WEIGHTS = {
    "road_stream_proximity_score": 0.16,
    "drainage_strength_score": 0.16,
    "valley_position_score": 0.15,
    "crossing_geometry_score": 0.05,
    "terrain_break_score": 0.12,
    "road_context_score": 0.05,
    "dem_route_drainage_score": 0.18,
    "osm_culvert_tag_score": 0.04,
}
STREAM_DENSITIES = ("stream_density_100m_m_per_sqkm", "stream_density_250m_m_per_sqkm", "stream_density_500m_m_per_sqkm", "stream_density_m_per_sqkm")
DRAINAGE = ("stream_order", "flow_accumulation_log", "flow_accumulation_rank_pct", "drainage_area_log", "drainage_area_rank_pct", *STREAM_DENSITIES)
VALLEY = ("valley_depth_9x9_m", "topographic_wetness_proxy_9x9", "valley_depth_15x15_m", "topographic_wetness_proxy_15x15", "negative_tpi_31x31_m")
VALLEY_INVERSE = ("topographic_position_9x9_m", "topographic_position_15x15_m")
VALLEY_RAW = ("low_slope_valley_score_9x9",)
TERRAIN = (
    "slope_degrees",
    "elevation_relief_3x3_m",
    "terrain_roughness_3x3_m",
    "elevation_relief_9x9_m",
    "terrain_roughness_9x9_m",
    "terrain_break_score_proxy_9x9",
    "elevation_relief_15x15_m",
    "terrain_roughness_15x15_m",
    "terrain_break_score_proxy_15x15",
    "elevation_relief_31x31_m",
    "terrain_roughness_31x31_m",
    "terrain_break_score_proxy_31x31",
)
ROAD_DENSITIES = ("road_density_100m_m_per_sqkm", "road_density_250m_m_per_sqkm", "road_density_500m_m_per_sqkm", "road_density_m_per_sqkm")
DEM_ROUTE_SCORES = ("valley_position_score", "terrain_break_score", "drainage_strength_score")
DEM_ROUTE = (
    "topographic_wetness_proxy_9x9",
    "topographic_wetness_proxy_15x15",
    "topographic_wetness_proxy_31x31",
    "low_slope_valley_score_9x9",
    "low_slope_valley_score_15x15",
    "low_slope_valley_score_31x31",
    "negative_tpi_9x9_m",
    "negative_tpi_15x15_m",
    "negative_tpi_31x31_m",
)
EVIDENCE = (
    ("road_stream_proximity_score", "road-drainage crossing", 0.6),
    ("drainage_strength_score", "strong drainage signal", 0.6),
    ("valley_position_score", "valley/low-point terrain", 0.6),
    ("crossing_geometry_score", "culvert-like crossing angle", 0.6),
    ("terrain_break_score", "terrain break or relief", 0.6),
    ("road_context_score", "road corridor context", 0.6),
    ("dem_route_drainage_score", "DEM road low point or drainage dip", 0.6),
    ("osm_culvert_tag_score", "mapped culvert/tunnel signal", 0.6),
    ("field_report_support_score", "field report match", 0.6),
    ("field_corridor_support_score", "field-confirmed culvert corridor", 0.3),
)
WEAK_EVIDENCE = "weak evidence; review only if nearby"
#: Scores that differ beyond this digit only, by the order of a sum, are tied in the queue.
RANK_DIGITS = 9


def proximity(df: DataFrame) -> Column:
    """0.75 / (1 + d / 20) + 0.25 for an exact crossing; null for an unknown distance, which weighs as 0."""
    if "road_stream_distance_m" not in df.columns:
        return F.lit(0.0)
    d = clip(number("road_stream_distance_m"), 0)
    return clip(0.75 / (1 + d / 20.0) + 0.25 * number_or(df, "is_exact_road_stream_intersection", 0.0), 0, 1)


def crossing_geometry(df: DataFrame) -> Column:
    if "crossing_angle_degrees" not in df.columns:
        return F.lit(0.0)
    return F.coalesce(clip(1 - F.abs(90 - number("crossing_angle_degrees")) / 90, 0, 1), F.lit(0.0))


def route_signal(df: DataFrame) -> Column:
    flag = clip(number_or(df, "source_route_interval_sample", 0.0), 0, 1)
    by_source = F.when(F.lower(text(col_or(df, "source"))) == "route_interval_sample", 1.0).otherwise(0.0)
    return F.greatest(flag, by_source)


def map_tags(df: DataFrame) -> Column:
    pieces = [F.when(truthy("stream_culvert", "score"), 1.0).otherwise(0.0)] if "stream_culvert" in df.columns else []
    if "stream_tunnel" in df.columns:
        pieces.append(F.when(truthy("stream_tunnel", "stream_tunnel"), 1.0).otherwise(0.0))
    return row_mean(pieces)


def structure_penalty(df: DataFrame) -> Column:
    return row_mean([F.when(truthy(c, "score"), 1.0).otherwise(0.0) for c in ("road_bridge", "road_tunnel") if c in df.columns])


def search_url(df: DataFrame) -> Column:
    if not {"latitude", "longitude"} <= set(df.columns):
        return F.lit("")
    lat, lon = number("latitude"), number("longitude")
    return F.when(lat.isNull() | lon.isNull(), "").otherwise(F.format_string("https://earth.google.com/web/search/%.7f,%.7f", lat, lon))


def weighted_score(df: DataFrame, weights: dict[str, float]) -> Column:
    """Weighted mean of the components the table has, over the sum of all weights, in percent, less 20 times the penalty."""
    total = sum(weights.values())
    if total <= 0:
        raise ValueError("scoring weights must sum to more than zero")
    score = sum((clip(F.coalesce(number(c), F.lit(0.0)), 0, 1) * w for c, w in weights.items() if c in df.columns), F.lit(0.0))
    return clip(100 * score / total - 20 * F.col("non_culvert_structure_penalty"), 0, 100)


def evidence_summary(df: DataFrame) -> Column:
    found = F.array_compact(F.array(*[F.when(F.coalesce(number(c), F.lit(0.0)) >= least, label) for c, label, least in EVIDENCE if c in df.columns]))
    return F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise(WEAK_EVIDENCE)


def component_scores(df: DataFrame) -> DataFrame:
    """Add the eleven component scores.  Each percentile is computed once, whichever components share it."""
    ranked = [c for c in dict.fromkeys((*DRAINAGE, *VALLEY, *VALLEY_INVERSE, *TERRAIN, *ROAD_DENSITIES)) if c in df.columns]
    given = df.columns
    out = pct_ranks(df, {f"pr_{c}": F.col(c) for c in ranked})
    pct = {c: percentile(f"pr_{c}") for c in ranked}
    have = lambda names: [pct[c] for c in names if c in pct]
    valley = have(VALLEY) + [1 - pct[c] for c in VALLEY_INVERSE if c in pct] + [clip(number_or(df, c, 0.0), 0, 1) for c in VALLEY_RAW if c in given]
    out = out.withColumns(
        {
            "road_stream_proximity_score": proximity(df),
            "drainage_strength_score": row_mean(have(DRAINAGE)),
            "valley_position_score": row_mean(valley),
            "crossing_geometry_score": crossing_geometry(df),
            "terrain_break_score": row_mean(have(TERRAIN)),
            "road_context_score": row_mean(have(ROAD_DENSITIES)),
            "osm_culvert_tag_score": map_tags(df),
            "field_report_support_score": clip(number_or(df, "is_culvert", 0.0), 0, 1) if "is_culvert" in given else F.lit(0.0),
            "field_corridor_support_score": F.lit(0.0),
            "non_culvert_structure_penalty": structure_penalty(df),
        }
    ).drop(*[f"pr_{c}" for c in ranked])
    return dem_route_score(out)


def dem_route_score(df: DataFrame) -> DataFrame:
    """Add dem_route_drainage_score: the route signal times the mean of terrain pieces; 0 everywhere without any route row.

    A piece whose values all lie in [0, 1], null as 0, counts as it is; any other by its percentile.
    """
    signal = route_signal(df)
    columns = [c for c in (*DEM_ROUTE_SCORES, *DEM_ROUTE) if c in df.columns]
    filled = {c: number_or(df, c, 0.0) for c in columns}
    ends = df.agg(F.sum(signal).alias("signal"), *[a for c in columns for a in (F.min(filled[c]).alias(f"a_{c}"), F.max(filled[c]).alias(f"b_{c}"))]).first()
    if not ends["signal"] or not columns:
        return df.withColumn("dem_route_drainage_score", F.lit(0.0))
    wide = [c for c in columns if ends[f"a_{c}"] < 0 or ends[f"b_{c}"] > 1]
    out = pct_ranks(df, {f"pr_{c}": filled[c] for c in wide})
    pieces = [percentile(f"pr_{c}") if c in wide else filled[c] for c in columns]
    return out.withColumn("dem_route_drainage_score", clip(signal * row_mean(pieces), 0, 1)).drop(*[f"pr_{c}" for c in wide])


def score_candidates(df: DataFrame, weights: dict[str, float] | None = None, tie_break: str = "candidate_id") -> DataFrame:
    """The queue without supervised labels: components, likelihood (0 for known or denied sites), rank, bucket and summary."""
    out = component_scores(df)
    score = F.when(flag_is_one(df, "is_culvert") | flag_is_one(df, "field_denied"), 0.0).otherwise(weighted_score(out, weights or WEIGHTS))
    out = out.withColumn("culvert_likelihood_score", score)
    out = global_rank(out, F.round("culvert_likelihood_score", RANK_DIGITS), [F.col(tie_break)], "priority_rank")
    out = out.crossJoin(F.broadcast(out.agg(F.count("*").alias("_all"))))  # one row, counted from the table that ranking wrote
    return out.withColumns(
        {
            "priority_percentile": 1 - (F.col("priority_rank") - 1) / F.col("_all"),
            "priority_bucket": bucket(F.col("culvert_likelihood_score")),
            "evidence_summary": evidence_summary(out),
            "google_earth_url": search_url(df),
        }
    ).drop("_all")
