"""The feature table of candidates: every step of features, labels, terrain and weights, in one order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import from_utm
from ..storage import materialize
from . import features, labels, raster


@dataclass(frozen=True)
class Surface:
    """A raster's cells, its grid and coordinate system."""

    cells: DataFrame
    grid: raster.Grid
    epsg: int


@dataclass(frozen=True)
class Inputs:
    """Layers beside the candidates, all in the same metres but for rasters; those that are None are left out.

    Known and negative sites have x and y; roads and streams are segments with seg_id.
    """

    known: DataFrame | None = None
    negatives: DataFrame | None = None
    roads: DataFrame | None = None
    streams: DataFrame | None = None
    dem: Surface | None = None
    flow_accumulation: Surface | None = None
    drainage_area: Surface | None = None
    landcover: Surface | None = None
    positive_radius_m: float = 10.0
    negative_radius_m: float = 10.0
    density_radius_m: float = 75.0
    density_radii_m: tuple[float, ...] = field(default=())


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """With a number for each row that stays the same, as ties between equal distances are broken by it."""
    return df if name in df.columns else df.withColumn(name, F.monotonically_increasing_id())


def in_raster(points: DataFrame, surface: Surface, zone: int, row: str) -> DataFrame:
    """(row, x, y) of points in a raster's coordinates."""
    from ..sources.vector import zone_of

    theirs = zone_of(surface.epsg)
    if theirs == zone:
        return points.select(row, "x", "y")
    lon, lat = from_utm(F.col("x"), F.col("y"), zone)
    if theirs is None:
        return points.select(row, lon.alias("x"), lat.alias("y"))
    from ..functions.geometry import to_utm

    x, y = to_utm(lon, lat, theirs)
    return points.select(row, x.alias("x"), y.alias("y"))


def add_raster(points: DataFrame, surface: Surface, zone: int, prefix: str, row: str = "row") -> DataFrame:
    """The value of a raster at each point: elevation_m and the terrain windows for ``dem``, else <prefix>_value alone."""
    at = in_raster(points, surface, zone, row)
    if prefix != "dem":
        return points.join(raster.sample(at, surface.cells, surface.grid, f"{prefix}_value").drop("x", "y"), row, "left")
    found = raster.window_stats(raster.sample(at, surface.cells, surface.grid, "elevation_m"), surface.cells, surface.grid, row)
    return points.join(found.drop("x", "y"), row, "left")


def build(candidates: DataFrame, zone: int, inputs: Inputs, row: str = "row") -> DataFrame:
    """Candidates (x, y in metres of a UTM zone) with all features, labels and weights that the inputs give.

    The order is: derived columns, positives, negatives, roads, streams, elevation, flow accumulation, drainage area,
    landcover, training weights, longitude and latitude.
    """
    out = features.derived(_numbered(candidates, row).withColumns({"x_m": F.col("x"), "y_m": F.col("y")}))
    out, _ = materialize(out, "feature-candidates")
    if inputs.known is not None:
        out = labels.label_known(out, _numbered(inputs.known, "known_row"), inputs.positive_radius_m, row)
    if inputs.negatives is not None:
        out = labels.label_denied(out, _numbered(inputs.negatives, "negative_row"), inputs.negative_radius_m, row)
    for name, lines in (("road", inputs.roads), ("stream", inputs.streams)):
        if lines is not None:
            out = features.line_features(out, lines, row, name, inputs.density_radius_m, inputs.density_radii_m)
    out, _ = materialize(out, "feature-lines")
    if inputs.dem is not None:
        out, _ = materialize(add_raster(out, inputs.dem, zone, "dem", row), "feature-terrain")
        out = features.hydrology_proxies(out)
    for prefix in ("flow_accumulation", "drainage_area"):
        surface = getattr(inputs, prefix)
        if surface is not None:
            out = features.hydrology_raster(add_raster(out, surface, zone, prefix, row), prefix)
    if inputs.landcover is not None:
        out = add_raster(out, inputs.landcover, zone, "landcover", row)
    lon, lat = from_utm(F.col("x"), F.col("y"), zone)
    return labels.sample_weights(out).withColumns({"longitude": lon, "latitude": lat})
