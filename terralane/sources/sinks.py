"""Files for people and other programs: placemarks, the published pair, review queues, model bundles, counts of tables."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import export
from . import vector


def write_kml(df: DataFrame, path: str, limit: int = 250, title: str = "Priority review") -> str:
    """A KML document of the first placemarks by rank."""

    def pieces() -> Iterator[str]:
        yield f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n  <Document>\n    <name>{title}</name>\n'
        for r in export.kml(df, limit).orderBy("priority_rank").collect():  # at most ``limit`` rows
            yield f"    {r['placemark']}\n"
        yield "  </Document>\n</kml>\n"

    vector.write_file(path, pieces())
    return path


def export_web(predictions: DataFrame, folder: str, limit: int | None = None) -> dict:
    """findings.geojson and summary.json of what may be published: the pool, in its order, decluttered if there is a limit.

    ``predictions`` has longitude and latitude, and x and y in metres where a limit is given.
    """
    if predictions.isEmpty():
        raise ValueError("no predictions to publish")
    known = predictions.agg(export.known_count(predictions).alias("n")).first()["n"]
    pool = export.pool(predictions)
    if pool.isEmpty():
        raise ValueError("no candidate is left after known matches")
    order = export.preferred_order(pool)
    chosen = export.declutter(pool, order, limit) if limit else pool
    score = export.score_column(pool)
    web = export.published(chosen)
    layer = vector.of_points(chosen).select(*vector.OWN, *web.columns)
    vector.write_document((r["value"] for r in vector.feature_json(layer.orderBy(*order, "candidate_id")).toLocalIterator()), f"{folder}/findings.geojson")
    found = export.summary(web, score).first().asDict()
    found["known_field_matches"] = known
    vector.write_file(f"{folder}/summary.json", iter([json.dumps(found, indent=2, default=str)]))
    return {"findings_geojson": f"{folder}/findings.geojson", "summary_json": f"{folder}/summary.json", "rows": found["rows"], "score_column": score or ""}


def write_jsonl(df: DataFrame, path: str) -> str:
    """One JSON object a line, keys in order, nulls said, in parallel."""
    row = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
    return path


def save_bundle(model: PipelineModel, report: dict, folder: str) -> dict[str, str]:
    """A trained model with what prediction needs to know, its metrics, and its features by importance."""
    spark = SparkSession.getActiveSession()
    model.write().overwrite().save(f"{folder}/model")
    kept = ("family", "feature_columns", "target", "fill_value", "seed", "rows", "class_counts", "sample_weight", "operating_threshold")
    vector.write_file(f"{folder}/bundle.json", iter([json.dumps({k: report.get(k) for k in kept}, indent=2, default=str)]))
    vector.write_file(f"{folder}/metrics.json", iter([json.dumps(report, indent=2, default=str)]))
    rows = [(str(i["feature"]), float(i["importance"]), float(i["normalized_importance"]), str(i["method"])) for i in report["importance"]]
    spark.createDataFrame(rows, "feature string, importance double, normalized_importance double, method string").coalesce(1).write.mode("overwrite").csv(f"{folder}/importance.csv", header=True)
    return {"model": f"{folder}/model", "bundle": f"{folder}/bundle.json", "metrics": f"{folder}/metrics.json", "importance": f"{folder}/importance.csv"}


def load_bundle(folder: str) -> tuple[PipelineModel, dict]:
    with open(f"{folder.removeprefix('file://')}/bundle.json", encoding="utf-8") as f:
        return PipelineModel.load(f"{folder}/model"), json.load(f)


def read_json(path: str) -> dict | None:
    """A JSON document, None if there is no such file."""
    try:
        with open(path.removeprefix("file://"), encoding="utf-8") as f:
            return json.load(f)
    except FileNotFoundError:
        return None


def csv_rows(spark: SparkSession, path: str) -> int | None:
    """How many rows a CSV file has, its header not counted; None if there is no such file."""
    return spark.read.csv(path, header=True, multiLine=True).count() if vector.exists(spark, path) else None


def summarize_model(spark: SparkSession, metrics: str, point_analysis: str, training: str, out: str) -> dict:
    """What the published page says about the model, from the files that training and quality control left."""
    from ..operators.serving import model_summary

    found = model_summary(read_json(metrics), read_json(point_analysis), csv_rows(spark, training))
    vector.write_file(out, iter([json.dumps(found, indent=2, default=str)]))
    return found
