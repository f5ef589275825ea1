from __future__ import annotations

import io
import json
import sqlite3
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from terralane.functions import reports, reviews
from terralane.operators import evaluate, export, feedback, models, observations, pointqc
from terralane.sources import documents, geojson, maps, shapes
from terralane.streaming import feedback as stream


def values(spark, rows, expression, columns="v string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {columns}")
    return [r["o"] for r in df.select("i", expression.alias("o")).orderBy("i").collect()]


def test_route_tokens(spark):
    assert values(spark, ["US Hwy 9w", "State Rte 32A", "R-8 NY-9G", "Local", None], reports.route_tokens(F.col("v"))) == [["9W"], ["32A"], ["9G"], [], []]
    assert values(spark, ["NY 9 and US 44", "trail 12b", "none"], reports.route_token(F.col("v"))) == ["44", "12B", ""]


def test_dates_in_names(spark):
    names = ["NY 5.21.26.docx", "x 6_04_2026.pdf", "Jun 1, 2026.pdf", "June 17, 2026.pdf", "18 JUNE 2026.pdf", "13.45.20.pdf", "no date"]
    assert values(spark, names, reports.report_date(F.col("v"))) == ["2026-05-21", "2026-06-04", "2026-06-01", "2026-06-17", "2026-06-18", "", ""]


def test_records_of_lines(spark):
    text = ["R-8​NY-9G (CID: 149980) 73.898 W 42.056 N", "", "1 8 28 Ulster County 42.036358 N 74.108094 W", "State Route 212 42.1, -74.2", "b 42.11 -74.21", "c 42.12 -74.22", "12.5 13.5"]
    rows = [("May 2, 2026.pdf", n, t) for n, t in enumerate(text)]
    got = reports.records(spark.createDataFrame(rows, "source_file string, line_no long, line string")).orderBy("line_no").collect()
    assert [(r["nysdot_region"], r["route"], r["latitude"], r["longitude"], r["culvert_id"]) for r in got] == [
        ("8", "NY9G", 42.056, -73.898, "CID149980"), ("8", "NY28", 42.036358, -74.108094, "CID149980"), ("", "NY212", 42.1, -74.2, "CID149980"), ("", "", 42.11, -74.21, "CID149980"), ("", "", 42.12, -74.22, ""),
    ]
    assert {r["report_date"] for r in got} == {"2026-05-02"}


def test_site_ids(spark):
    assert values(spark, ["CID: 149980 SC 150237 cid not  assigned"], reports.site_ids(F.col("v"))) == [["CID149980", "SC150237", "CID-NOTASSIGNED"]]


def test_records_merge(spark):
    cols = "source_file string, report_date string, nysdot_region string, route string, latitude double, longitude double, raw_coordinate_text string, culvert_id string, context_text string, label string, label_confidence double"
    df = spark.createDataFrame([("a", "", "", "NY212", 42.0000001, -74.0, "r1", "", "long text", "l", 0.8), ("b", "2026-01-01", "8", "", 42.0, -74.0, "r2", "SC150332", "t", "l", 0.85), ("b", "", "", "", 43.0, -74.0, "r", "", "", "l", 0.1)], cols)
    got = reports.merge_records(df).orderBy("latitude").collect()
    assert len(got) == 2
    assert (got[0]["source_file"], got[0]["route"], got[0]["culvert_id"], got[0]["raw_coordinate_text"], got[0]["label_confidence"]) == ("b; a", "NY212", "SC150332", "r2", 0.85)


def test_review_round(spark):
    row = {"review_id": "r1", "source": {"source_file": "f"}, "extracted": {"latitude": 42.0, "longitude": -74.0, "route": "NY9"}}
    answers = [row | {"review": {"accepted": "true", "latitude": 42.0561, "label_confidence": 0.95}}, row | {"review": {"accepted": False}}, row | {"response": {"latitude": None}}, row | {"review": {"latitude": 10.0}}]
    lines = spark.createDataFrame([(json.dumps(a),) for a in answers], "value string")
    got = reviews.reviewed_records(lines).collect()
    assert [(r["latitude"], r["longitude"], r["route"], r["label_confidence"]) for r in got] == [(42.0561, -74.0, "NY9", 0.95)]
    assert reviews.reviewed_records(lines, null_rejects=False).count() == 2
    queue = reviews.review_queue(spark.createDataFrame([("f", 42.0, -74.0)], "source_file string, latitude double, longitude double")).first()
    import hashlib

    assert queue["review_id"] == hashlib.sha1(b"f||42.0|-74.0|").hexdigest()[:16] and queue["extracted"]["label_confidence"] == 0.85


OBS = "row long, observation_id string, observed_at string, status string, candidate_id string, field_culvert_id string, missed_candidate_id string, missed_candidate_distance_m double, notes string, x double, y double"


def test_observation_labels(spark):
    df = spark.createDataFrame(
        [
            (0, "o1", "2026-06-17T01", "confirmed_culvert", "cand-1", "FC-1", "cand_000001", 100.0, "wet", 0.0, 0.0),
            (1, "o2", "2026-06-18", "confirmed_culvert", "", "FC-1", "cand_000001", 100.0, "", 0.0, 0.0),
            (2, "o3", "2026-06-18", "no_culvert", "cand-2", "", "", None, "", 5.0, 5.0),
            (3, "o4", "2026-06-19", "confirmed_culvert", "", "", "route_1", 100.0, "", 9.0, 9.0),
        ],
        OBS,
    )
    known = observations.merge_known(spark.createDataFrame([(9, 1.0, 1.0, "base")], "row long, x double, y double, label string"), df).orderBy("row").collect()
    assert [(r["row"], r["culvert_id"]) for r in known] == [(0, "FC-1"), (3, "o4"), (9, None)]
    assert known[0]["report_date"] == "2026-06-17"
    assert observations.merge_known(df.limit(0).select("row", "x", "y"), df, exclude_confirmed=True).count() == 0
    negatives = observations.negatives(df).orderBy("row").collect()
    assert [(r["label"], r["candidate_id"], r["miss_distance_m"]) for r in negatives] == [("missed_prediction", "cand_000001", 100.0), ("no_culvert", "cand-2", None)]
    assert negatives[0]["notes"] == "wet; confirmed culvert was 100.0 m from this prediction"


def test_fingerprint_ignores_order(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "observation_id string, status string")
    assert observations.fingerprint(df).first() == observations.fingerprint(df.orderBy(F.desc("status"))).first()
    assert len(observations.fingerprint(df).first()[0]) == 24


def test_validation(spark):
    df = spark.createDataFrame([("a" * 200, "maybe", 42.0, -74.0, "x"), ("b", "no_culvert", 95.0, 0.0, "1.5")], "observation_id string, status string, latitude double, longitude double, prediction_score string")
    got = observations.validated(df).collect()
    assert len(got) == 1 and len(got[0]["observation_id"]) == 80 and got[0]["status"] == "uncertain" and got[0]["prediction_score"] is None and got[0]["source"] == "field_review"
    assert observations.validated(df, null_is_zero=True).first()["prediction_score"] == 0.0


def test_feedback_on_the_queue(spark):
    base = spark.createDataFrame(
        [(f"c{i}", i, 50.0 + i, "undiscovered_candidate", 0, "", -74.0 + i / 100, 42.0) for i in range(4)],
        "candidate_id string, rank long, discovery_score double, discovery_status string, is_known_field_match int, evidence_summary string, longitude double, latitude double",
    )
    cols = "observation_id string, observed_at string, status string, candidate_id string, field_culvert_id string, missed_candidate_id string, nearest_candidate_id string, missed_candidate_distance_m double, nearest_candidate_distance_m double, longitude double, latitude double"
    obs = spark.createDataFrame(
        [
            ("o0", "2026-01-01", "no_culvert", "c0", "", "", "", None, None, -74.0, 42.0),
            ("o1", "2026-01-02", "confirmed_culvert", "", "", "", "", None, None, -73.99, 42.00005),
            ("o2", "2026-01-03", "confirmed_culvert", "", "FC-9", "c2", "", 40.0, None, -70.0, 42.0),
        ],
        cols,
    )
    got = feedback.apply(base, obs).orderBy("discovery_rank").collect()
    by = {r["candidate_id"]: r for r in got}
    assert [r["candidate_id"] for r in got] == ["c3", "c2", "FC-9", "c1", "c0"]
    assert (by["c0"]["discovery_score"], by["c0"]["discovery_status"]) == (0.0, "field_denied")
    assert (by["c1"]["discovery_score"], by["c1"]["is_known_field_match"]) == (98.0, 1)
    assert (by["c2"]["discovery_score"], by["c2"]["discovery_status"]) == (15.0, "field_missed_prediction") and "40.0 m" in by["c2"]["evidence_summary"]


def test_point_quality(spark):
    got = spark.createDataFrame([(0, 40.0), (1, 80.0)], "i int, d double").select("i", pointqc.analysis_flag(F.lit(True), F.col("d"), F.lit(10.0), F.lit(20.0)).alias("f"), (F.col("d") <= 10).alias("m")).orderBy("i").collect()
    assert [(r["f"], r["m"]) for r in got] == [("matched_existing_candidate", False), ("road_stream_context_no_candidate_match", False)]
    p = spark.createDataFrame([("a", "true", "matched_existing_candidate"), ("b", "false", "matched_existing_candidate"), ("c", "true", "needs_manual_review")], "point_id string, inside_analysis_extent string, analysis_flag string")
    assert [(r["point_id"], r["label_confidence"]) for r in pointqc.training_points(p).collect()] == [("a", 0.95)]
    square = [(0.0, 0.0, 4.0, 0.0), (4.0, 0.0, 4.0, 4.0), (4.0, 4.0, 0.0, 4.0), (0.0, 4.0, 0.0, 0.0)]
    q = spark.createDataFrame([(0, 1.0, 1.0), (1, 9.0, 9.0)], "i int, longitude double, latitude double")
    assert [r["inside_analysis_extent"] for r in pointqc.inside_boundary(q, square).orderBy("i").collect()] == [True, False]
    assert [r["inside_analysis_extent"] for r in pointqc.inside_extent(q, [q.where("i = 0")]).orderBy("i").collect()] == [True, False]


def test_success_rate(spark):
    p = spark.createDataFrame([(0, 10.0, 0.0, "near", None), (1, 100.0, 0.0, "far", None), (2, 70.0, 0.0, "known", "known_field_match")], "row long, x double, y double, candidate_id string, discovery_status string")
    actual = spark.createDataFrame([(0, 0.0, 0.0, "A"), (1, 70.0, 0.0, "B")], "actual_row long, x double, y double, culvert_id string")
    m = evaluate.success(p, actual)
    s = evaluate.success_summary(m).first()
    assert (s["hits_within_distance"], s["actual_culverts"], [x["actual_id"] for x in s["misses"]]) == (1, 2, ["B"])
    with pytest.raises(ValueError):
        evaluate.success(p.limit(0), actual)


def test_export_pool_and_markup(spark):
    rows = [("discovery", "undiscovered_candidate", 0, 800.0, "x"), ("near", "undiscovered_candidate", 0, 12.0, "x"), ("known", "known_field_match", 1, 3.0, "x"), ("denied", "field_denied", 0, None, "x"), ("field", None, 0, None, "field_report_observed_culvert"), ("open", None, None, None, None)]
    df = spark.createDataFrame(rows, "candidate_id string, discovery_status string, is_known_field_match int, dist_to_known_culvert_m double, source string")
    assert {r["candidate_id"] for r in export.pool(df).collect()} == {"discovery", "open"}
    k = spark.createDataFrame([(1, "A & B <x>", 50.0, -74.0, 42.0)], "priority_rank long, road_name string, discovery_score double, longitude double, latitude double")
    assert "A &amp; B &lt;x&gt;" in export.kml(k).first()["placemark"]


def test_feature_columns_and_models(spark):
    df = spark.range(60).select(F.col("id").alias("candidate_id"), (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 2 == 0, F.col("id") % 3).cast("double").alias("b"), (F.col("id") % 7 > 3).cast("int").alias("is_culvert"), F.lit(True).alias("flag"), (F.col("id") % 5 * 3000.0).alias("x_m"), F.lit(1.0).alias("y_m"), F.lit(1).alias("road_id"), F.lit(1.0).alias("priority_seed"))
    assert models.feature_columns(df) == ["a", "b"]
    model, report = models.train(df, family="logistic")
    assert report["random_holdout"]["roc_auc"] > 0.9 and report["spatial_holdout"] and report["operating_threshold"]["source"] == "spatial_holdout"
    assert [r["priority_rank"] for r in models.predict(df, model, ["a", "b"]).orderBy("priority_rank").limit(3).collect()] == [1, 2, 3]
    assert models.cross_validated(df, ["a", "b"], "logistic", "is_culvert", "candidate_id", 2)["average_precision"] > 0.9
    assert models.permutation_importance(model, df, ["a", "b"], "is_culvert", "candidate_id", 1)[0][0] == "a"
    assert models.prior(df) == pytest.approx(24 / 60)
    assert models.random_holdout(df.limit(5), "candidate_id", "is_culvert") is None
    assert {r["fold"] for r in models.folds(df, 5, "candidate_id", "is_culvert").select("fold").distinct().collect()} == set(range(5))
    with pytest.raises(ValueError):
        models.fit(df.where("is_culvert = 1"), ["a"], "logistic")
    with pytest.raises(ValueError):
        models.estimator("other", 1.0)


# --- Sources ---


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"name": "p"}, "geometry": {"type": "Point", "coordinates": [-74.0, 42.0]}}, {"type": "Feature", "properties": {"name": "l"}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [3, 4]], [[9, 9]]]}}, {"type": "Feature", "properties": {}, "geometry": None}]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    f = geojson.read_features(spark, f"{tmp_path}/a.geojson", "name string")
    assert f.count() == 2
    p, zone = geojson.in_metres(geojson.with_points(f))
    assert zone == 18 and abs(p.first()["y"] - 4_649_776) < 5_000
    parts = geojson.with_parts(f).collect()
    assert [(r["part"], r["points"][1]["y"]) for r in parts] == [(0, 4.0)]
    out = json.loads(geojson.collection(p.select("name", "longitude", "latitude"), "name"))
    assert out["features"][0]["geometry"]["coordinates"] == [-74.0, 42.0]
    with pytest.raises(ValueError):
        (tmp_path / "b.geojson").write_text("{}")
        geojson.read_features(spark, f"{tmp_path}/b.geojson", "name string")


def test_jsonl_reports_the_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r["a"] for r in geojson.read_jsonl(spark, f"{tmp_path}/a.jsonl", "a int").collect()) == [1, 2]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n{"a": \n')
    with pytest.raises(ValueError, match="b.jsonl:2"):
        geojson.read_jsonl(spark, f"{tmp_path}/b.jsonl", "a int")


def test_map_layers(spark):
    answer = {"elements": [{"type": "way", "id": 5, "tags": {"highway": "primary", "ref": "NY 9", "bridge": "yes"}, "geometry": [{"lat": 42.0, "lon": -74.0}, {"lat": 42.1, "lon": -74.0}]}, {"type": "way", "id": 6, "tags": {"waterway": "stream", "tunnel": "culvert"}, "geometry": [{"lat": 42.0, "lon": -74.0}, {"lat": 42.0, "lon": -74.1}]}, {"type": "node", "id": 7}, {"type": "way", "id": 8, "geometry": [{"lat": 1.0, "lon": 1.0}]}]}
    ways = maps.server_lines(spark.createDataFrame([(0, json.dumps(answer)), (1, json.dumps(answer))], "tile int, value string"))
    assert sorted(r["osm_id"] for r in ways.collect()) == [5, 6]
    road = maps.server_roads(ways).where("osm_id = 5").first()
    assert (road["name"], road["road_bridge"]) == ("NY 9", True) and maps.server_streams(ways).where("osm_id = 6").first()["stream_culvert"]
    assert maps.map_tiles(spark, -74.4, 41.5, -74.0, 41.7).count() == 6
    assert '"highway"~"^(a|b)$"' in maps.server_query("highway", "a|b", 1, 2, 3, 4)
    census = spark.createDataFrame([("1", " ", "S1100"), ("2", "Main", "S1200")], "LINEARID string, FULLNAME string, MTFCC string")
    assert [r["name"] for r in maps.census_roads(census).orderBy("id").collect()] == ["1", "Main"]
    with pytest.raises(ValueError):
        maps.county(spark.createDataFrame([("36", "111")], "STATEFP string, COUNTYFP string"), "36", "001")


def _shapefile(folder):
    points = [(0.0, 0.0), (3.0, 4.0)]
    body = struct.pack("<i4d2ii", 3, 0, 0, 3, 4, 1, 2, 0) + b"".join(struct.pack("<2d", *p) for p in points)
    records = struct.pack(">2i", 1, len(body) // 2) + body + struct.pack(">2i", 2, 2) + struct.pack("<i", 0)
    (folder / "a.shp").write_bytes(b"\0" * 100 + records)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6]) + b"\0" * 15
    (folder / "a.dbf").write_bytes(struct.pack("<4BIHH", 3, 0, 0, 0, 2, 65, 7) + b"\0" * 20 + field + b"\r" + b" Main  " + b"       ")


def test_shapefile_and_package(spark, tmp_path):
    shapes.register(spark)
    _shapefile(tmp_path)
    row = spark.read.format("shapes").load(f"{tmp_path}/a.shp").collect()
    assert [(r["kind"], json.loads(r["parts"]), r["attributes"]["NAME"]) for r in row] == [("LineString", [[[0.0, 0.0], [3.0, 4.0]]], "Main")]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.write(tmp_path / "a.shp", "a.shp")
        z.write(tmp_path / "a.dbf", "a.dbf")
    assert spark.read.format("shapes").load(f"{tmp_path}/z.zip").count() == 1
    with sqlite3.connect(tmp_path / "p.gpkg") as db:
        db.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT, column_name TEXT)")
        db.execute("INSERT INTO gpkg_geometry_columns VALUES ('sites', 'geom')")
        db.execute("CREATE TABLE sites (id INTEGER, geom BLOB)")
        db.execute("INSERT INTO sites VALUES (7, ?), (8, NULL)", (b"GP\0\1" + struct.pack("<i", 4326) + struct.pack("<BI2d", 1, 1, -74.0, 42.0),))
    got = spark.read.format("geopackage").load(f"{tmp_path}/p.gpkg").collect()
    assert [(r["kind"], json.loads(r["parts"]), r["attributes"]["id"]) for r in got] == [("Point", [[[-74.0, 42.0]]], "7")]


def test_report_documents(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = "<w:tc><w:p><w:r><w:t>SC 1</w:t></w:r></w:p></w:tc>"
    xml = f"<w:document {w}><w:body><w:tbl><w:tr>{cell}{cell}</w:tr></w:tbl><w:p><w:r><w:t>42.05 N 73.9 W</w:t></w:r></w:p></w:body></w:document>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "May 2, 2026.docx").write_bytes(data.getvalue())
    (tmp_path / "~$lock.docx").write_bytes(b"x")
    lines = documents.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r["line"] for r in lines] == ["SC 1 SC 1", "SC 1", "SC 1", "42.05 N 73.9 W"]
    assert reports.records(documents.read_lines(spark, str(tmp_path))).first()["culvert_id"] == "SC1"


# --- Streams ---


def _line(i, at, status="no_culvert", **more):
    return json.dumps({"observation_id": i, "observed_at": at, "status": status, "latitude": 42.0, "longitude": -74.0} | more)


def test_stream_equals_batch(spark, tmp_path):
    source, folder = tmp_path / "in", f"{tmp_path}/state"
    source.mkdir()
    published = []

    def run():
        stream.upsert_stream(stream.read_observations(spark, str(source)), folder, lambda df, n: published.append({r["observation_id"]: r["status"] for r in df.collect()})).awaitTermination()

    (source / "1.json").write_text("\n".join([_line("a", "2026-01-01"), _line("b", "2026-01-02", "confirmed_culvert"), _line("bad", "2026-01-02", latitude=99.0)]))
    run()
    assert published[-1] == {"a": "no_culvert", "b": "confirmed_culvert"}
    (source / "2.json").write_text("\n".join([_line("a", "2026-01-03", "confirmed_culvert"), _line("b", "2026-01-04", deleted=True)]))
    run()
    assert published[-1] == {"a": "confirmed_culvert"}
    (source / "3.json").write_text("\n".join([_line("a", "2026-01-01"), _line("b", "2026-01-02", "confirmed_culvert"), _line("c", "2026-01-01", "odd")]))
    run()  # late and replayed rows change nothing
    assert published[-1] == {"a": "confirmed_culvert", "c": "uncertain"}
    assert stream.live(stream.latest_snapshot(spark, folder, 99)).count() == 2


def test_retrain_decisions():
    sent = []
    ok, bad = lambda p: sent.append(p) or True, lambda p: False
    state, made = stream.trigger(None, "f1", 1000.0, ok)
    assert made.status == "queued" and len(sent) == 1
    assert stream.trigger(state, "f1", 5000.0, ok)[1].status == "unchanged"
    assert stream.trigger(state, "f2", 1500.0, ok)[1] == stream.Decision("debounced", 1900.0)
    assert stream.trigger(state, "f1", 1001.0, ok, force=True)[1].status == "queued"
    failed, made = stream.trigger(state, "f2", 1900.0, bad)
    assert made.status == "failed" and stream.trigger(failed, "f2", 1901.0, ok)[1].status == "queued"
    assert stream.decide(None, "f", 0, persisted=False).status == "not_persisted" and stream.decide(None, "f", 0, configured=False).status == "not_configured"


def test_retrain_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text("\n".join(json.dumps({"region": "r", "at": f"2026-01-01T00:{m:02d}:00Z", "fingerprint": f}) for m, f in ((0, "a"), (5, "b"), (20, "b"), (40, "b"))))
    changes = spark.readStream.schema("region string, at timestamp, fingerprint string").json(str(source))
    q = stream.retrain_requests(changes).writeStream.format("memory").queryName("decisions").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["status"] for r in spark.table("decisions").orderBy("at").collect()] == ["queued", "debounced", "queued", "unchanged"]


def test_positions(spark):
    df = spark.createDataFrame([("d", 1, 42.0, -74.0, 9.0), ("d", 2, 42.00001, -74.0, 9.0), ("d", 3, 42.00001, -74.0, 5.0), ("d", 4, 42.001, -74.0, 9.0)], "device string, at int, latitude double, longitude double, accuracy double")
    got = stream.throttled_positions(df.withColumn("at", F.timestamp_seconds("at"))).orderBy("at").collect()
    assert [r["at"].second for r in got] == [1, 3, 4]


# --- Command line and registry ---


def test_command_line(spark, tmp_path):
    from terralane import cli

    spark.createDataFrame([(1, 0.9), (0, 0.2)], "target int, probability double").write.parquet(f"{tmp_path}/p")
    assert cli.main(["metrics", "--in", f"{tmp_path}/p", "--out", f"{tmp_path}/m"], spark)["rows"] == 1
    assert spark.read.parquet(f"{tmp_path}/m").first()["average_precision"] == 1.0
    with pytest.raises(SystemExit):
        cli.main(["metrics", "--in", f"{tmp_path}/p", "--out", f"{tmp_path}/m", "--set", "nothing=1"], spark)


def test_registry():
    from terralane.plans import workload

    assert set(workload.oracle_sql()) <= set(workload.queries()) and len(workload.queries()) >= 50
