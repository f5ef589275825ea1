"""From layers in files to a published queue: each step takes layers and gives the next one's.

A layer is what :func:`terralane.sources.vector.read_vector` gives.  Steps after the candidates are tables of points with row,
x, y (metres in one UTM zone), epsg, longitude and latitude; :func:`layer_of` makes a layer of one again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import reports
from .functions.geometry import from_utm
from .operators import candidates as cand
from .operators import discovery, evaluate, featuretable, models, observations, pointqc, scoring
from .operators.featuretable import Inputs, Surface
from .sources import maps, regions, vector
from .storage import materialize


def _places(found: DataFrame, zone: int) -> DataFrame:
    """Points in metres as a table of steps: numbered rows, their zone, longitude and latitude."""
    lon, lat = from_utm(F.col("x"), F.col("y"), zone)
    table = found.drop("row").withColumns({"longitude": lon, "latitude": lat, "epsg": F.lit(vector.UTM_BASES[0] + zone), "row": F.monotonically_increasing_id()})
    return materialize(table, "places")[0]


def layer_of(table: DataFrame) -> DataFrame:
    """A layer of points in longitude and latitude, with the table's other columns as attributes."""
    return vector.of_points(table.drop("epsg", *[c for c in ("x", "y") if c in table.columns]))


def points_of(layer: DataFrame) -> tuple[DataFrame, int]:
    """A layer, or a table of an earlier step, as (table of points, zone)."""
    if "parts" not in layer.columns:
        code = layer.select("epsg").first()
        return layer, vector.zone_of(code["epsg"]) if code else 1
    (moved,), zone = vector.to_metres(layer)
    return _places(vector.points(moved).drop("longitude", "latitude"), zone), zone


def _in_zone(layer: DataFrame, zone: int) -> DataFrame:
    """A layer in metres of a given zone."""
    frame = layer.sparkSession.createDataFrame([(0, "Point", [[(500_000.0, 4_000_000.0)]], vector.UTM_BASES[0] + zone)], f"row long, geometry_type string, parts {vector.PARTS}, epsg int")
    return vector.to_metres(frame, layer)[0][1]


def build_candidates(roads: DataFrame, streams: DataFrame, snap: float = 20.0, spacing: float = 25.0) -> DataFrame:
    """Where roads meet streams, from two layers of lines."""
    (r, s), zone = vector.to_metres(roads, streams)
    (road_rows, road_lines), (stream_rows, stream_lines) = vector.lines(r), vector.lines(s)
    road_lines, _ = materialize(road_lines, "road-segments")
    stream_lines, _ = materialize(stream_lines, "stream-segments")
    found = cand.generate(road_lines, stream_lines, cand.road_attributes(road_rows), cand.stream_attributes(stream_rows), snap, spacing)
    return _places(found, zone)


def sample_routes(roads: DataFrame, routes: list[str] | None = None, interval: float = 75.0, numbered: bool = False, lateral: tuple[float, ...] = (0.0,)) -> DataFrame:
    """Samples along the roads of a layer that belong to numbered routes."""
    (r,), zone = vector.to_metres(roads)
    rows, lines = vector.lines(r)
    return _places(cand.route_samples(lines, rows, routes, interval, numbered, tuple(lateral)), zone)


def merge_candidates(*tables: DataFrame) -> DataFrame:
    """Candidate tables one behind the other, numbered anew, in the first one's zone."""
    first, zone = points_of(tables[0])
    rest = [points_of(t) for t in tables[1:]]
    if any(z != zone for _, z in rest):
        raise ValueError("candidate tables lie in different zones")
    return _places(cand.union([first.withColumn("n", F.col("row")), *(t.withColumn("n", F.col("row")) for t, _ in rest)]).drop("n"), zone)


def add_reports(candidates: DataFrame, found: DataFrame, boundary: DataFrame | None = None) -> DataFrame:
    """Reported points (a layer or records with longitude and latitude) as candidates, within a boundary if one is given."""
    base, zone = points_of(candidates)
    layer = found if "parts" in found.columns else vector.of_points(found)
    points = vector.points(_in_zone(layer, zone)).withColumnRenamed("row", "point_row")
    edges = vector.edges(_in_zone(boundary, zone)) if boundary is not None else None
    return _places(cand.append_field(base.drop("row", "longitude", "latitude", "epsg"), points.drop("longitude", "latitude"), "point_row", edges), zone)


def _segments(layer: DataFrame | None, zone: int, name: str) -> DataFrame | None:
    return None if layer is None else materialize(vector.lines(_in_zone(layer, zone))[1], name)[0]


def build_features(
    candidates: DataFrame, known: DataFrame | None = None, negatives: DataFrame | None = None, roads: DataFrame | None = None, streams: DataFrame | None = None, dem: Surface | None = None, flow_accumulation: Surface | None = None,
    drainage_area: Surface | None = None, landcover: Surface | None = None, positive_radius_m: float = 10.0, negative_radius_m: float = 10.0, density_radius_m: float = 75.0, density_radii_m: tuple[float, ...] = (),
) -> DataFrame:
    """The feature table of candidates from the layers and rasters that there are."""
    base, zone = points_of(candidates)
    site = lambda layer: None if layer is None else vector.points(_in_zone(layer, zone)).withColumnRenamed("row", "known_row")
    gone = None if negatives is None else vector.points(_in_zone(negatives, zone)).withColumnRenamed("row", "negative_row")
    inputs = Inputs(site(known), gone, _segments(roads, zone, "roads"), _segments(streams, zone, "streams"), dem, flow_accumulation, drainage_area, landcover, positive_radius_m, negative_radius_m, density_radius_m, tuple(density_radii_m))
    return materialize(featuretable.build(base, zone, inputs), "features")[0]


def label_layers(log: DataFrame, known: DataFrame | None = None, threshold_m: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """(known sites with confirmed observations, negatives) as layers, from an observation layer."""
    rows = vector.points(vector.to_lon_lat(log))
    base = None if known is None else vector.points(vector.to_lon_lat(known))
    sites = observations.merge_known(base, rows)
    return vector.of_points(sites, "x", "y"), vector.of_points(observations.negatives(rows, threshold_m), "x", "y")


def evidence_queue(features: DataFrame) -> DataFrame:
    return scoring.score_candidates(features)


def supervised(features: DataFrame, family: str = "hist_gradient_boosting", scale: float = 1.0) -> tuple[DataFrame, object, dict]:
    """(predictions, model, report) of a feature table with labels."""
    model, report = models.train(features, family=family, scale=scale)
    return models.predict(features, model, report["feature_columns"]), model, report


def field_queue(evidence: DataFrame, predictions: DataFrame | None = None, known_radius_m: float = 75.0) -> DataFrame:
    """The blended queue for field work."""
    return discovery.discovery_ranking(evidence, predictions, known_radius_m=known_radius_m)


def import_reports(lines: DataFrame) -> tuple[DataFrame, dict]:
    """(records with longitude and latitude, counts) of report lines."""
    return reports.imported(lines)


def check_points(points: DataFrame, roads: DataFrame | None = None, streams: DataFrame | None = None, candidates: DataFrame | None = None, boundary: DataFrame | None = None, match_radius_m: float = 75.0, cluster_radius_m: float = 750.0) -> tuple[DataFrame, dict]:
    layer = None if candidates is None else candidates if "parts" in candidates.columns else layer_of(candidates)
    return pointqc.run(points if "parts" in points.columns else vector.of_points(points), roads, streams, layer, boundary, match_radius_m, cluster_radius_m)


def to_region(layer: DataFrame, key: str = "ulster_poughkeepsie", boundary: DataFrame | None = None, clip: bool = True) -> DataFrame:
    """The features of a layer that meet a region or a boundary layer, lines cut to it, in longitude and latitude."""
    area = regions.boundary(layer.sparkSession, key) if boundary is None else vector.to_lon_lat(boundary)
    return regions.filter_to_region(vector.to_lon_lat(layer), vector.edges(area), clip)


def evaluated(predictions: DataFrame, known: DataFrame, threshold: float = 0.7, radius: float = 30.0) -> DataFrame:
    """Precision and recall of predictions near a layer of known sites."""
    table, zone = points_of(predictions)
    return evaluate.threshold_evaluation(table, vector.points(_in_zone(known, zone)).withColumnRenamed("row", "known_row"), threshold, radius)


def success(predictions: DataFrame, actual: DataFrame, max_distance: float = 15.0, rank_limit: int | None = None) -> DataFrame:
    """The nearest prediction of each site of a layer."""
    table, zone = points_of(predictions)
    return evaluate.success(table, vector.points(_in_zone(actual, zone)).withColumnRenamed("row", "actual_row"), max_distance, True, rank_limit)


def census_layer(layer: DataFrame, kind: str) -> DataFrame:
    """A census layer's lines with the columns that candidates are made of."""
    return maps.census_roads(layer) if kind == "roads" else maps.census_streams(layer)
