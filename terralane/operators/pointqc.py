"""Quality control of reported points against roads, streams, candidates and a boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import truthy
from ..functions.geometry import inside_ring
from ..functions.ranking import global_rank
from .spatial import clusters, nearest

# The decision tree's distances, and the flags that make a training point.
FLAG_MATCH_M, FLAG_ROAD_M, FLAG_STREAM_M, FLAG_FAR_M, EXTENT_MARGIN = 75, 50, 100, 250, 0.02
TRAINING_FLAGS = ("matched_existing_candidate",)


def analysis_flag(inside: Column, candidate: Column, road: Column, stream: Column, match_m: float = FLAG_MATCH_M) -> Column:
    """An unknown distance fails every comparison."""
    return (
        F.when(~inside, "outside_current_analysis_extent")
        .when(candidate <= match_m, "matched_existing_candidate")
        .when((road <= FLAG_ROAD_M) & (stream <= FLAG_STREAM_M), "road_stream_context_no_candidate_match")
        .when(road > FLAG_FAR_M, "far_from_current_road_layer")
        .otherwise("needs_manual_review")
    )


def inside_extent(points: DataFrame, layers: list[DataFrame], lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Add inside_analysis_extent: within the layers' common bounds and a margin; true without layers."""
    if not layers:
        return points.withColumn("inside_analysis_extent", F.lit(True))
    box = None
    for layer in layers:
        b = layer.select(F.col(lon).alias("_x"), F.col(lat).alias("_y"))
        box = b if box is None else box.unionByName(b)
    ends = box.agg(F.min("_x").alias("x0"), F.max("_x").alias("x1"), F.min("_y").alias("y0"), F.max("_y").alias("y1"))  # one row
    m = EXTENT_MARGIN
    within = F.col(lon).between(F.col("x0") - m, F.col("x1") + m) & F.col(lat).between(F.col("y0") - m, F.col("y1") + m)
    return points.join(F.broadcast(ends), F.lit(True), "left").withColumn("inside_analysis_extent", F.coalesce(within, F.lit(False))).drop("x0", "x1", "y0", "y1")


def inside_boundary(points: DataFrame, edges: list[tuple[float, float, float, float]], lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Add inside_analysis_extent: covered by a polygon, whose border counts.  A boundary's edges are a small parameter."""
    ring = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(e, ("x1", "y1", "x2", "y2"), strict=True)]) for e in edges])
    return points.withColumn("inside_analysis_extent", inside_ring(F.col(lon), F.col(lat), ring))


def analyze(points: DataFrame, row: str, roads: DataFrame | None = None, streams: DataFrame | None = None, candidates: DataFrame | None = None, match_radius_m: float = 75.0, cluster_radius_m: float = 750.0) -> DataFrame:
    """Add nearest road, stream and candidate, matched_existing_candidate, cluster_id and analysis_flag.

    The match uses the radius; the flag its own fixed distance.  ``points`` has x, y and inside_analysis_extent.
    """
    out = points
    for layer, name in ((roads, "road"), (streams, "stream")):
        if layer is None:
            out = out.withColumns({f"nearest_{name}_distance_m": F.lit(None).cast("double"), f"nearest_{name}_name": F.lit("")})
            continue
        near = nearest(points.select(row, "x", "y"), layer.select("seg_id", "name", "x1", "y1", "x2", "y2"), row, "seg_id", lines=True)
        out = out.join(near.select(F.col(f"l_{row}").alias(row), F.col("d").alias(f"nearest_{name}_distance_m"), F.coalesce("r_name", F.lit("")).alias(f"nearest_{name}_name")), row, "left")
    if candidates is None:
        out = out.withColumns({"nearest_candidate_distance_m": F.lit(None).cast("double"), "nearest_candidate_id": F.lit(""), "nearest_candidate_score": F.lit(None).cast("double"), "nearest_candidate_status": F.lit("")})
    else:
        scores = [F.col(c).cast("double") for c in ("discovery_score", "culvert_likelihood_score", "culvert_probability") if c in candidates.columns]
        c = candidates.select("row", "x", "y", "candidate_id", (F.coalesce(*scores) if scores else F.lit(None).cast("double")).alias("score"), (F.col("discovery_status") if "discovery_status" in candidates.columns else F.lit("")).alias("status"))
        near = nearest(points.select(row, "x", "y"), c, row, "row")
        out = out.join(near.select(F.col(f"l_{row}").alias(row), F.col("d").alias("nearest_candidate_distance_m"), F.col("r_candidate_id").alias("nearest_candidate_id"), F.col("r_score").alias("nearest_candidate_score"), F.col("r_status").alias("nearest_candidate_status")), row, "left")
    d = F.col("nearest_candidate_distance_m")
    out = out.withColumn("matched_existing_candidate", F.coalesce(d <= match_radius_m, F.lit(False)))
    flag = analysis_flag(F.col("inside_analysis_extent"), d, F.col("nearest_road_distance_m"), F.col("nearest_stream_distance_m"))
    return clusters(out, row, cluster_radius_m).withColumn("analysis_flag", flag)


def number_points(points: DataFrame, order: str) -> DataFrame:
    """Add point_id, pt_0001 and on by the input's order."""
    numbered = global_rank(points, F.lit(0.0), [F.col(order)], "_n")
    return numbered.withColumn("point_id", F.format_string("pt_%04d", F.col("_n"))).drop("_n")


def point_only(points: DataFrame) -> DataFrame:
    """Points alone, without what reports say of them: row (from 1, by latitude and longitude), point_id, latitude, longitude.

    ``points`` has row, by which they are numbered, longitude and latitude.
    """
    slim = number_points(points.select("row", "longitude", "latitude"), "row")
    placed = global_rank(slim.withColumnRenamed("row", "_row"), -F.col("latitude"), [F.col("longitude"), F.col("_row")], "row")
    return placed.select("row", "point_id", "latitude", "longitude")


def training_points(points: DataFrame, accepted: tuple[str, ...] = TRAINING_FLAGS) -> DataFrame:
    """Points inside the extent with an accepted flag, labelled; a matched candidate gives more confidence."""
    chosen = points.where(truthy("inside_analysis_extent", "point") & F.col("analysis_flag").isin(*accepted))
    confidence = F.when(F.col("analysis_flag") == "matched_existing_candidate", 0.95).otherwise(0.85)
    return chosen.withColumns({"training_label": F.lit("culvert"), "label_source": F.lit("field_report_coordinate_geospatial_qc"), "label_confidence": confidence})


def distance_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: min, median, mean, p90, max of the finite values (nulls without any)."""
    v = F.when(~F.isnan(column) & (F.abs(column) != float("inf")), F.col(column))
    return df.agg(F.min(v).alias("min"), F.percentile(v, 0.5).alias("median"), F.avg(v).alias("mean"), F.percentile(v, 0.9).alias("p90"), F.max(v).alias("max"))


def cluster_sizes(df: DataFrame, lon: str = "longitude", lat: str = "latitude") -> DataFrame:
    """Clusters by falling size: cluster_id, points and centroid."""
    return df.where("cluster_id >= 0").groupBy("cluster_id").agg(F.count("*").alias("points"), F.avg(lat).alias("centroid_latitude"), F.avg(lon).alias("centroid_longitude")).orderBy(F.desc("points"), "cluster_id")


def summary(df: DataFrame, match_radius_m: float = 75.0, cluster_radius_m: float = 750.0) -> dict:
    """Counts, bounds, distances, flags and clusters of analysed points; the few clusters and flags come to the driver."""
    inside, matched = F.col("inside_analysis_extent"), F.col("matched_existing_candidate")
    bounds = [f(c) for f, c in ((F.min, "longitude"), (F.min, "latitude"), (F.max, "longitude"), (F.max, "latitude"))]
    n, *rest = df.agg(F.count("*"), *bounds, F.count_if(inside), F.count_if(~inside), F.count_if(matched), F.count_if(~matched)).first()
    names = ("inside_analysis_extent", "outside_analysis_extent", "matched_existing_candidates", "unmatched_existing_candidates")

    def stats(column: str) -> dict:
        found = distance_stats(df, column).first().asDict()
        return {} if found["min"] is None else found

    flags = {r["analysis_flag"]: r["count"] for r in df.groupBy("analysis_flag").count().orderBy(F.desc("count"), "analysis_flag").collect()}
    return {
        "rows": n, "match_radius_m": float(match_radius_m), "cluster_radius_m": float(cluster_radius_m), "bounds": list(rest[:4]), **dict(zip(names, rest[4:], strict=True)),
        **{c: stats(c) for c in ("nearest_road_distance_m", "nearest_stream_distance_m", "nearest_candidate_distance_m")},
        "analysis_flags": flags, "clusters": [r.asDict() for r in cluster_sizes(df).collect()],
    }


# Columns of the analysis and of training points.
ANALYZED = (
    "point_id",
    "latitude",
    "longitude",
    "inside_analysis_extent",
    "nearest_road_distance_m",
    "nearest_road_name",
    "nearest_stream_distance_m",
    "nearest_stream_name",
    "nearest_candidate_distance_m",
    "nearest_candidate_id",
    "nearest_candidate_score",
    "nearest_candidate_status",
    "matched_existing_candidate",
    "cluster_id",
    "analysis_flag",
)


def run(points: DataFrame, roads: DataFrame | None = None, streams: DataFrame | None = None, candidates: DataFrame | None = None, boundary: DataFrame | None = None, match_radius_m: float = 75.0, cluster_radius_m: float = 750.0) -> tuple[DataFrame, dict]:
    """Analyse a layer of points against the layers there are: (analysed points, summary).  All are vector layers.

    A boundary decides what is inside, else the bounds of the other layers and a margin, else everything is.
    """
    from ..sources import maps, vector
    from ..storage import materialize

    places = point_only(vector.points(vector.to_lon_lat(points)).drop("longitude", "latitude").withColumnsRenamed({"x": "longitude", "y": "latitude"}))
    places, _ = materialize(places, "qc-points")
    if places.isEmpty():
        raise ValueError("no points to analyse")
    others = {k: v for k, v in (("roads", roads), ("streams", streams), ("candidates", candidates)) if v is not None and not v.isEmpty()}
    if boundary is not None and not boundary.isEmpty():
        marked = inside_boundary(places, vector.edges(vector.to_lon_lat(boundary)))
    else:
        ends = lambda layer: vector.to_lon_lat(layer).select(F.explode(F.flatten("parts")).alias("p")).select(F.col("p.x").alias("longitude"), F.col("p.y").alias("latitude"))
        marked = inside_extent(places, [ends(v) for v in others.values()])
    (own, *rest), _ = vector.to_metres(vector.of_points(marked.drop("row"), "longitude", "latitude").drop("row").withColumn("row", F.substring("point_id", 4, 20).cast("long")), *others.values())
    found = dict(zip(others, rest, strict=True))
    made: dict[str, DataFrame] = {}
    for name in ("roads", "streams"):
        if name in found:
            attributes, segments = vector.lines(found[name])
            made[name] = segments.join(attributes.select("line", maps.named(attributes).alias("name")), "line")
    if "candidates" in found:
        made["candidates"] = vector.points(found["candidates"])
    metric = vector.points(own).drop("row").join(places.select("row", "point_id"), "point_id")
    out, _ = materialize(analyze(metric, "row", made.get("roads"), made.get("streams"), made.get("candidates"), match_radius_m, cluster_radius_m), "qc-analysis")
    return out.select("row", *[c for c in ANALYZED if c in out.columns]), summary(out, match_radius_m, cluster_radius_m)


def write_outputs(analyzed: DataFrame, found: dict, folder: str) -> dict[str, str]:
    """The analysis as GeoJSON, CSV, JSON and Markdown files."""
    import json

    from ..sources import vector
    from .serving import quality_report

    layer = vector.of_points(analyzed.drop("row"))
    paths = {kind: f"{folder}/point_analysis.{kind}" for kind in ("geojson", "csv", "json", "md")}
    vector.write_vector(layer, paths["geojson"])
    analyzed.drop("row").write.mode("overwrite").csv(paths["csv"], header=True)
    vector.write_file(paths["json"], iter([json.dumps(found, indent=2)]))
    vector.write_file(paths["md"], iter([quality_report(found)]))
    return paths


def high_confidence(analyzed: DataFrame, accepted: tuple[str, ...] = TRAINING_FLAGS) -> tuple[DataFrame, dict]:
    """(training points, counts); an analysis without its flags, and one of which no point passes, are errors."""
    missing = [c for c in ("analysis_flag", "inside_analysis_extent") if c not in analyzed.columns]
    if missing:
        raise ValueError(f"the analysis lacks {', '.join(missing)}")
    out = training_points(analyzed, accepted)
    flags = {r["analysis_flag"]: r["count"] for r in analyzed.groupBy("analysis_flag").count().orderBy(F.desc("count"), "analysis_flag").collect()}
    kept, n = out.count(), sum(flags.values())
    if not kept:
        raise ValueError("no point passes the high-confidence filter")
    return out, {"rows": kept, "accepted_flags": list(accepted), "rejected_rows": n - kept, "analysis_flags": flags}
