"""Command line: each verb reads tables, runs one operator and writes a table; results are printed as JSON.

    python -m terralane.cli VERB --in PATH [--with PATH ...] --out PATH [--set name=value ...]
"""

from __future__ import annotations

import argparse
import inspect
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import workflow
from .functions import reports, reviews
from .operators import candidates, discovery, evaluate, export, features, feedback, labels, metrics, models, observations, pointqc, scoring
from .operators.featuretable import Surface
from .sources import demo, documents, elevation, geojson, geotiff, maps, regions, sinks, vector


def _train(df: DataFrame, family: str = "auto", bundle: str = "", scale: float = 1.0) -> DataFrame:
    model, report = models.train(df, family=family, scale=scale)
    print(json.dumps(sinks.save_bundle(model, report, bundle) if bundle else report, default=str))
    return models.predict(df, model, report["feature_columns"])


def _predict(df: DataFrame, bundle: str) -> DataFrame:
    model, about = sinks.load_bundle(bundle)
    return models.predict(df, model, about["feature_columns"])


def _merge_layers(first: DataFrame, *rest: DataFrame) -> DataFrame:
    return candidates.union([first, *rest])


def _check(points: DataFrame, report: str = "", **options) -> DataFrame:
    found, summary = workflow.check_points(points, **options)
    if report:
        pointqc.write_outputs(found, summary, report)
    print(json.dumps(summary))
    return found


def _point_only(points: DataFrame) -> DataFrame:
    places = vector.points(vector.to_lon_lat(points)).drop("longitude", "latitude").withColumnsRenamed({"x": "longitude", "y": "latitude"})
    return pointqc.point_only(places).drop("row")


def _reports(lines: DataFrame) -> DataFrame:
    found, counts = reports.imported(lines)
    print(json.dumps(counts))
    return found


def _publish(df: DataFrame, folder: str, limit: int | None = None) -> DataFrame:
    print(json.dumps(sinks.export_web(df, folder, limit)))
    return export.published(export.pool(df))


def _negatives(log: DataFrame, threshold_m: float = 10.0) -> DataFrame:
    return workflow.label_layers(log, None, threshold_m)[1]


def _known(log: DataFrame, base: DataFrame | None = None) -> DataFrame:
    return workflow.label_layers(log, base)[0]


#: Verb: (function over tables, in the order of --in and --with, what it does).
VERBS: dict[str, tuple[Callable[..., DataFrame], str]] = {
    "census-roads": (maps.census_roads, "road layer from census rows"),
    "census-streams": (maps.census_streams, "stream layer from census rows"),
    "select-county": (maps.county, "one county's boundary"),
    "clip-to-region": (workflow.to_region, "features of a layer within a region or a boundary"),
    "server-lines": (maps.server_lines, "ways of map-server answers"),
    "server-roads": (maps.server_roads, "road layer from ways"),
    "server-streams": (maps.server_streams, "stream layer from ways"),
    "import-reports": (_reports, "coordinate records of report lines, one a place, with counts"),
    "report-records": (reports.records, "all coordinate records of report lines"),
    "dedupe-reports": (reports.merge_records, "one record per place"),
    "review-queue": (reviews.review_queue, "what a reviewer is asked about each record"),
    "import-reviews": (reviews.reviewed_records, "records that a reviewer accepts"),
    "build-candidates": (workflow.build_candidates, "sites from a road and a stream layer"),
    "generate-candidates": (candidates.generate, "sites from road and stream segments and their attributes"),
    "sample-routes": (workflow.sample_routes, "samples along the numbered roads of a layer"),
    "merge-candidates": (workflow.merge_candidates, "candidate tables one behind the other"),
    "union-candidates": (_merge_layers, "candidate tables with a column n one behind the other"),
    "add-field-candidates": (workflow.add_reports, "reported points as candidates"),
    "point-only": (_point_only, "the points of a layer alone, numbered"),
    "check-points": (_check, "quality control of reported points"),
    "analyze-points": (pointqc.training_points, "points that pass quality control"),
    "merge-known": (_known, "known sites and confirmed observations"),
    "negative-labels": (_negatives, "denials and missed predictions"),
    "build-features": (workflow.build_features, "the feature table of candidates"),
    "label-known": (labels.label_known, "positive labels from known sites"),
    "label-denied": (labels.label_denied, "negative labels from denials"),
    "derive-features": (features.derived, "features of distance, angle and source"),
    "terrain-features": (features.hydrology_proxies, "hydrology proxies of terrain windows"),
    "sample-weights": (labels.sample_weights, "training weights"),
    "score-unlabeled": (scoring.score_candidates, "the evidence queue"),
    "train": (_train, "train, report, save and predict"),
    "predict": (_predict, "predictions of a saved model"),
    "discovery-ranking": (discovery.discovery_ranking, "the blended queue for field work"),
    "evaluate": (workflow.evaluated, "precision and recall near a layer of known sites"),
    "success-rate": (workflow.success, "nearest prediction of each actual site"),
    "success-summary": (evaluate.success_summary, "how many of the actual sites have one"),
    "metrics": (metrics.binary_metrics, "classification metrics"),
    "export-pool": (export.pool, "rows that may be published"),
    "export-web": (_publish, "the published pair of files"),
    "export-declutter": (export.declutter, "the published rows"),
    "export-summary": (export.summary, "their summary"),
    "export-kml": (export.kml, "placemarks"),
    "apply-feedback": (feedback.apply, "the queue after observations"),
    "observation-labels": (observations.confirmed_sites, "confirmed sites of an observation table"),
}

#: Options that name a file: of a layer, and of a raster.
LAYERS, RASTERS = ("known", "negatives", "roads", "streams", "boundary", "candidates", "base"), ("dem", "flow_accumulation", "drainage_area", "landcover")


def read(spark: SparkSession, path: str) -> DataFrame:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("shp", "zip", "gpkg", "geojson"):
        return vector.read_vector(spark, path)
    if kind == "csv":
        return spark.read.csv(path, header=True, inferSchema=True)
    if kind in ("json", "jsonl", "geojsonl"):
        return spark.read.json(path)
    if kind in ("docx", "pdf", "txt"):
        return documents.read_lines(spark, path)
    return spark.read.parquet(path)


def write(df: DataFrame, path: str) -> None:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("geojson", "gpkg"):
        vector.write_vector(df if "parts" in df.columns else workflow.layer_of(df), path)
    elif kind == "kml":
        sinks.write_kml(df, path)
    elif kind == "csv":
        if "parts" in df.columns:
            vector.write_vector(df, path)
        else:
            df.write.mode("overwrite").csv(path, header=True)
    elif kind == "geojsonl":
        geojson.write_features(df, path)
    elif kind in ("json", "jsonl"):
        sinks.write_jsonl(df, path)
    else:
        df.write.mode("overwrite").parquet(path)


def _value(text: str) -> object:
    try:
        return json.loads(text)
    except ValueError:
        return text


def options_of(f: Callable, given: list[str], spark: SparkSession | None = None) -> dict:
    """Values of --set that the operator knows; another name is an error.  Files of layers and rasters are opened."""
    known = inspect.signature(f).parameters
    if any(p.kind is p.VAR_KEYWORD for p in known.values()):
        known = known | dict(inspect.signature(workflow.check_points).parameters)
    out = {}
    for item in given:
        name, _, value = item.partition("=")
        if name not in known:
            raise SystemExit(f"unknown option {name}; this verb has {', '.join(known)}")
        v = _value(value)
        if spark is not None and name in LAYERS and isinstance(v, str):
            v = read(spark, v)
        elif spark is not None and name in RASTERS:
            v = Surface(*geotiff.open_raster(spark, str(v)))
        out[name] = tuple(v) if isinstance(v, list) and name != "routes" else v
    return out


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="terralane", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    verbs = parser.add_subparsers(dest="verb", required=True)
    for name, (_, says) in VERBS.items():
        p = verbs.add_parser(name, help=says)
        p.add_argument("--in", dest="source", required=True)
        p.add_argument("--with", dest="others", nargs="*", default=[])
        p.add_argument("--out", required=True)
        p.add_argument("--set", dest="given", nargs="*", default=[])
    p = verbs.add_parser("demo", help="the made-up study area's queue")
    p.add_argument("--out", required=True)
    p.add_argument("--files", default="", help="a folder for its layers and terrain as well")
    p = verbs.add_parser("region-boundary", help="a region's bounds as a layer")
    p.add_argument("--out", required=True)
    p.add_argument("--region", default="ulster_poughkeepsie")
    for name, says in (("fetch-census", "a county's roads, streams and boundary from the census"), ("fetch-map", "the same from a map server")):
        p = verbs.add_parser(name, help=says)
        p.add_argument("--out", required=True, help="a folder")
        p.add_argument("--state", default="36")
        p.add_argument("--county", default="111")
    p = verbs.add_parser("fetch-elevation", help="elevations over a boundary")
    p.add_argument("--in", dest="source", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--folder", required=True)
    p.add_argument("--resolution", default="1")
    p.add_argument("--overwrite", action="store_true")
    p = verbs.add_parser("model-summary", help="what the published page says about the model")
    for name in ("metrics", "points", "training", "out"):
        p.add_argument(f"--{name}", required=True)
    p = verbs.add_parser("pull-observations", help="a checked copy of an observation collection")
    p.add_argument("--in", dest="source", required=True)
    p.add_argument("--out", required=True)
    a = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("terralane").getOrCreate()
    done = run(spark, a)
    print(json.dumps(done, default=str))
    return done


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    if a.verb == "region-boundary":
        return {"verb": a.verb, "out": regions.write_boundary(spark, a.out, a.region)}
    if a.verb in ("fetch-census", "fetch-map"):
        layers = (maps.fetch_census if a.verb == "fetch-census" else maps.fetch_server)(spark, f"{a.out}/sources", a.state, a.county)
        for name, layer in layers.items():
            flat = layer.drop("tags") if "tags" in layer.columns else layer
            vector.write_vector(flat, f"{a.out}/{name}.gpkg")
        return {"verb": a.verb, "out": a.out, "rows": {name: layer.count() for name, layer in layers.items()}}
    if a.verb == "fetch-elevation":
        return {"verb": a.verb} | elevation.fetch_elevation(spark, read(spark, a.source), a.out, a.folder, a.resolution, overwrite=a.overwrite)
    if a.verb == "model-summary":
        return {"verb": a.verb} | sinks.summarize_model(spark, a.metrics, a.points, a.training, a.out)
    if a.verb == "pull-observations":
        from .service import pull_observations

        return {"verb": a.verb, "out": a.out, "rows": pull_observations(a.out, a.source)}
    if a.verb == "demo":
        if a.files:
            print(json.dumps(demo.write_files(spark, a.files)))
        out = demo.queue(spark)
    else:
        f = VERBS[a.verb][0]
        out = f(*[read(spark, p) for p in (a.source, *a.others)], **options_of(f, a.given, spark))
    write(out, a.out)
    return {"verb": a.verb, "out": a.out, "rows": out.count() if a.out.endswith((".kml", ".geojson", ".gpkg")) else read(spark, a.out).count()}


if __name__ == "__main__":
    main()
