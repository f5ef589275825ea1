"""Numeric features of candidate sites: geometry, line density and terrain."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip, number, text, truthy
from ..functions.geometry import chord
from ..functions.ranking import pct_ranks, percentile, robust_0_to_1
from .spatial import by_cell, cell, nearest, segment_cells

# Fixed values.
DENSITY_RADII, WINDOWS = (50.0, 100.0, 250.0), (3, 9, 15, 31)
ONE_HOTS = {
    "source_exact_intersection": "exact_road_stream_intersection",
    "source_nearest_approach": "nearest_road_stream_approach",
    "source_route_interval_sample": "route_interval_sample",
    "source_field_report_observed": "field_report_observed_culvert",
}


def derived(df: DataFrame) -> DataFrame:
    """Distance, angle, source and flag features of the columns that the table has."""
    new: dict = {}
    have = set(df.columns)
    if "road_stream_distance_m" in have:
        d = clip(number("road_stream_distance_m"), 0)
        new["log_road_stream_distance_m"] = F.log1p(d)
        new["is_exact_road_stream_intersection"] = F.coalesce((d <= 0.01).cast("int"), F.lit(0))
        new["road_stream_proximity_signal"] = F.coalesce(1 / (1 + d / 20.0), F.lit(0.0))
    if "crossing_angle_degrees" in have:
        off = F.abs(90 - number("crossing_angle_degrees"))
        new["crossing_angle_abs_from_90"] = off
        new["crossing_angle_perpendicularity"] = clip(1 - off / 90.0, 0, 1)
    if {"road_stream_distance_m", "crossing_angle_degrees"} <= have:
        new["crossing_geometry_signal"] = clip(0.65 * new["road_stream_proximity_signal"] + 0.35 * F.coalesce(new["crossing_angle_perpendicularity"], F.lit(0.0)), 0, 1)
    if "source" in have:
        new |= {name: (F.lower(text("source")) == value).cast("int") for name, value in ONE_HOTS.items()}
    new |= {f"has_{c}": (F.trim(text(c)) != "").cast("int") for c in ("road_name", "stream_name", "matched_route") if c in have}
    new |= {f"{c}_flag": truthy(c, "feature").cast("int") for c in ("road_bridge", "road_tunnel", "stream_culvert", "stream_tunnel") if c in have}
    return df.withColumns(new)


def density_column(layer: str, radius: float) -> str:
    label = int(radius) if float(radius).is_integer() else radius
    return f"{layer}_density_{label}m_m_per_sqkm"


def density_radii(base: float = 75.0, extra: tuple[float, ...] = ()) -> list[float]:
    return sorted({r for r in (float(base), *DENSITY_RADII, *map(float, extra)) if r > 0})


def line_density(points: DataFrame, lines: DataFrame, row: str, radii: list[float], layer: str) -> DataFrame:
    """(row, a column per radius): metres of line inside the circle by square kilometre of it.

    One grid join at the largest radius serves all radii, on cells of half of it: fewer segments beyond the circle than on
    whole ones.  A segment meets a point once, in the point's own cell.
    """
    most = max(radii)
    size = most / 2
    a = points.select(F.col(row), F.col("x"), F.col("y"), cell(F.col("x"), size).alias("gx"), cell(F.col("y"), size).alias("gy"))
    near = by_cell(a, segment_cells(lines.select("x1", "y1", "x2", "y2"), size, most))
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    # Step by step, so that no step is computed again by the next.
    near = near.select(row, (x2 - x1).alias("dx"), (y2 - y1).alias("dy"), (x1 - x).alias("fx"), (y1 - y).alias("fy"))
    dx, dy, fx, fy = (F.col(c) for c in ("dx", "dy", "fx", "fy"))
    near = near.select(row, (dx * dx + dy * dy).alias("a"), (2 * (fx * dx + fy * dy)).alias("b"), (fx * fx + fy * fy).alias("f"))
    for i, r in enumerate(radii):
        near = near.withColumn(f"disc{i}", F.col("b") * F.col("b") - 4 * F.col("a") * (F.col("f") - r * r))
    sums = near.groupBy(row).agg(*[F.sum(chord(F.col("a"), F.col("b"), F.col(f"disc{i}"))).alias(density_column(layer, r)) for i, r in enumerate(radii)])
    filled = [(F.coalesce(F.col(density_column(layer, r)), F.lit(0.0)) / (math.pi * r * r / 1e6)).alias(density_column(layer, r)) for r in radii]
    return points.select(row).join(sums, row, "left").select(row, *filled)


def line_features(points: DataFrame, lines: DataFrame, row: str, layer: str, base: float = 75.0, extra: tuple[float, ...] = ()) -> DataFrame:
    """Add distance_to_nearest_<layer>_m and the densities, with the base radius's also as <layer>_density_m_per_sqkm."""
    radii = density_radii(base, extra)
    near = nearest(points.select(row, "x", "y"), lines.select("seg_id", "x1", "y1", "x2", "y2"), row, "seg_id", lines=True)
    near = near.select(F.col(f"l_{row}").alias(row), F.col("d").alias(f"distance_to_nearest_{layer}_m"))
    out = points.join(near, row, "left").join(line_density(points, lines, row, radii, layer), row, "left")
    return out.withColumn(f"{layer}_density_m_per_sqkm", F.col(density_column(layer, base)))


def hydrology_proxies(df: DataFrame) -> DataFrame:
    """Wetness, valley and break proxies for each terrain window that the table has whole."""
    if "slope_degrees" not in df.columns:
        return df
    damping = 1 / (1 + clip(number("slope_degrees"), 0))
    for n in WINDOWS:
        w = f"{n}x{n}"
        names = [f"{kind}_{w}_m" for kind in ("elevation_relief", "terrain_roughness", "topographic_position", "valley_depth")]
        if not set(names) <= set(df.columns):
            continue
        relief, rough, tpi, valley = (number(c) for c in names)
        relief, rough, valley = clip(relief, 0), clip(rough, 0), clip(valley, 0)
        df = robust_0_to_1(df.withColumn("_valley", valley), "_valley", "_scaled")
        df = df.withColumns(
            {
                f"valley_depth_relief_ratio_{w}": F.when(relief > 0, valley / relief),
                f"topographic_wetness_proxy_{w}": F.log1p(valley) * damping,
                f"low_slope_valley_score_{w}": F.col("_scaled") * damping,
                f"terrain_break_score_proxy_{w}": F.log1p(relief) * F.log1p(rough),
                f"negative_tpi_{w}_m": clip(-tpi, 0),
            }
        ).drop("_valley", "_scaled")
    return df


def hydrology_raster(df: DataFrame, prefix: str) -> DataFrame:
    """From <prefix>_value: its log and percentile, null as 0."""
    if f"{prefix}_value" not in df.columns:
        return df
    v = clip(number(f"{prefix}_value"), 0)
    out = pct_ranks(df, {"_pct": v}).withColumn(f"{prefix}_log", F.log1p(v))
    return out.withColumn(f"{prefix}_rank_pct", percentile("_pct")).drop("_pct")
