"""From files to a published queue, and what stands around it: service, settings, bundles, streams."""

from __future__ import annotations

import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from terralane import cli, config, service, workflow
from terralane.functions import reports
from terralane.operators import candidates, discovery, export, models, pointqc
from terralane.sources import demo, geotiff, sinks, vector
from terralane.storage import materialize, scope, scratch, settle
from terralane.streaming import feedback as stream

ZONE = 18


def layer(df, kind="LineString"):
    """A layer in metres of lines given as points."""
    return df.select(F.col("line").alias("row"), F.lit(kind).alias("geometry_type"), F.array("points").cast(vector.PARTS).alias("parts"), F.lit(32600 + ZONE).alias("epsg"), "name", "rank")


@pytest.fixture(scope="module")
def area(spark, tmp_path_factory):
    """The made-up area in files: roads as GeoJSON, streams as a package, terrain as a raster, known sites, a boundary."""
    folder = tmp_path_factory.mktemp("area")
    vector.write_vector(layer(demo.roads(spark)), f"{folder}/roads.geojson")
    vector.write_vector(layer(demo.streams(spark)).withColumnRenamed("rank", "stream_order"), f"{folder}/streams.gpkg")
    cells, grid = demo.terrain(spark)
    geotiff.write_raster(cells, grid, 32600 + ZONE, f"{folder}/dem.tif")
    return folder


@pytest.fixture(scope="module")
def built(spark, area):
    """Candidates and features through the command line."""
    run = lambda *a: cli.main([str(x) for x in a], spark)
    found = run("build-candidates", "--in", f"{area}/roads.geojson", "--with", f"{area}/streams.gpkg", "--out", f"{area}/candidates", "--set", "snap=30", "spacing=20")
    rows = spark.read.parquet(f"{area}/candidates").orderBy("candidate_id").collect()
    known = [(r["longitude"] + 2e-5, r["latitude"], f"K{i}", f"2026-05-0{i % 9 + 1}") for i, r in enumerate(rows) if r["stream_order"] >= 3]
    vector.write_vector(vector.of_points(spark.createDataFrame(known, "longitude double, latitude double, culvert_id string, report_date string")), f"{area}/known.geojson")
    run("build-features", "--in", f"{area}/candidates", "--out", f"{area}/features", "--set", f"known={area}/known.geojson", f"roads={area}/roads.geojson", f"streams={area}/streams.gpkg", f"dem={area}/dem.tif", f"landcover={area}/dem.tif", f"drainage_area={area}/dem.tif", "density_radii_m=[500]")
    assert found["rows"] == len(rows) >= 10
    return area


def test_candidates_equal_those_of_segments(spark, built):
    """The same sites as the operators give for the same lines in metres."""
    from terralane.functions.geometry import segments

    r, s = demo.roads(spark), demo.streams(spark)
    want = candidates.generate(segments(r, "line"), segments(s, "line"), candidates.road_attributes(r), candidates.stream_attributes(s.withColumn("stream_order", F.col("rank"))), 30.0, 20.0).collect()
    got = spark.read.parquet(f"{built}/candidates").collect()
    key = lambda rows: sorted((r["road_name"], r["stream_name"], round(r["x"], 1), round(r["y"], 1)) for r in rows)
    assert key(got) == key(want)


def test_demo_files(spark, tmp_path):
    found = cli.main(["demo", "--out", f"{tmp_path}/queue", "--files", f"{tmp_path}/files"], spark)
    assert found["rows"] > 10
    counts = [vector.read_vector(spark, f"{tmp_path}/files/{n}.gpkg").count() for n in ("roads", "streams", "known")]
    assert counts[:2] == [6, 4] and counts[2] > 3 and geotiff.open_raster(spark, f"{tmp_path}/files/dem.tif")[1].height == demo.SIZE


def test_features_have_every_step(spark, built):
    df = spark.read.parquet(f"{built}/features")
    assert {"dist_to_known_culvert_m", "is_culvert", "distance_to_nearest_road_m", "road_density_500m_m_per_sqkm", "stream_density_m_per_sqkm", "elevation_m", "slope_degrees", "valley_depth_31x31_m", "topographic_wetness_proxy_9x9", "drainage_area_log", "drainage_area_rank_pct", "landcover_value", "training_sample_weight", "longitude", "x_m"} <= set(df.columns)
    assert "landcover_local_slope_degrees" not in df.columns
    r = df.agg(F.sum("is_culvert"), F.count("*"), F.max("distance_to_nearest_road_m"), F.count("elevation_m"), F.max(F.abs(F.col("elevation_m") - F.col("landcover_value")))).first()
    assert 0 < r[0] < r[1] and r[2] < 31 and r[3] == r[1] and r[4] == 0
    labels = df.where("is_culvert = 1").select("nearest_field_report_culvert_id", "dist_to_known_culvert_m").collect()
    assert all(x[0].startswith("K") and x[1] < 3 for x in labels)


def test_files_to_a_published_queue(spark, built, capsys):
    run = lambda *a: cli.main([str(x) for x in a], spark)
    run("train", "--in", f"{built}/features", "--out", f"{built}/predictions", "--set", "family=logistic", f"bundle={built}/bundle")
    run("predict", "--in", f"{built}/features", "--out", f"{built}/again", "--set", f"bundle={built}/bundle")
    p, q = (sorted((r["candidate_id"], r["priority_rank"], round(r["culvert_probability"], 9)) for r in spark.read.parquet(f"{built}/{n}").collect()) for n in ("predictions", "again"))
    assert p == q
    bundle = json.loads((built / "bundle" / "bundle.json").read_text())
    assert bundle["family"] == "logistic" and bundle["sample_weight"]["positive_weight_sum"] > 0
    assert spark.read.csv(f"{built}/bundle/importance.csv", header=True).columns == ["feature", "importance", "normalized_importance", "method"]
    run("score-unlabeled", "--in", f"{built}/features", "--out", f"{built}/evidence")
    run("discovery-ranking", "--in", f"{built}/evidence", "--with", f"{built}/predictions", "--out", f"{built}/queue")
    done = run("export-web", "--in", f"{built}/queue", "--out", f"{built}/web.json", "--set", f"folder={built}/web", "limit=8")
    assert done["rows"] > 0
    findings = json.loads((built / "web" / "findings.geojson").read_text())["features"]
    ranks = [f["properties"]["discovery_rank"] for f in findings]
    assert ranks == sorted(ranks) and 0 < len(ranks) <= 8 and all(f["properties"]["discovery_status"] == "undiscovered_candidate" for f in findings)
    summary = json.loads((built / "web" / "summary.json").read_text())
    assert summary["rows"] == len(ranks) and summary["known_field_matches"] > 0
    run("export-kml", "--in", f"{built}/queue", "--out", f"{built}/rows.json", "--set", "limit=3")
    run("export-pool", "--in", f"{built}/queue", "--out", f"{built}/pool.kml")
    text = (built / "pool.kml").read_text()
    assert text.startswith("<?xml") and text.count("<Placemark>") == spark.read.parquet(f"{built}/queue").where("discovery_status = 'undiscovered_candidate'").count()
    run("evaluate", "--in", f"{built}/predictions", "--with", f"{built}/known.geojson", "--out", f"{built}/evaluation", "--set", "threshold=0.0")
    assert spark.read.parquet(f"{built}/evaluation").first()["known_culvert_recall_at_threshold"] == 1.0
    run("model-summary", "--metrics", f"{built}/bundle/metrics.json", "--points", f"{built}/none.json", "--training", f"{built}/none.csv", "--out", f"{built}/model.json")
    assert json.loads((built / "model.json").read_text())["selected_model"] == "logistic"


def test_routes_reports_and_clips(spark, built):
    run = lambda *a: cli.main([str(x) for x in a], spark)
    run("sample-routes", "--in", f"{built}/roads.geojson", "--out", f"{built}/routes", "--set", 'routes=["NY 21"]', "interval=500")
    assert {r[0] for r in spark.read.parquet(f"{built}/routes").select("road_name").distinct().collect()} == {"State Rte 21"}
    run("merge-candidates", "--in", f"{built}/candidates", "--with", f"{built}/routes", "--out", f"{built}/merged")
    a, b = (spark.read.parquet(f"{built}/{n}").count() for n in ("candidates", "routes"))
    merged = spark.read.parquet(f"{built}/merged")
    assert merged.count() == a + b == merged.select("candidate_id").distinct().count()
    run("region-boundary", "--out", f"{built}/region.geojson")
    run("add-field-candidates", "--in", f"{built}/merged", "--with", f"{built}/known.geojson", "--out", f"{built}/all", "--set", f"boundary={built}/region.geojson")
    new = spark.read.parquet(f"{built}/all").where("source = 'field_report_observed_culvert'")
    assert new.count() == vector.read_vector(spark, f"{built}/known.geojson").count() and {r["road_name"] for r in new.collect()} <= {"Field report", None} | {r["stream_name"] for r in new.collect()}
    run("clip-to-region", "--in", f"{built}/streams.gpkg", "--out", f"{built}/clipped.gpkg")
    assert vector.read_vector(spark, f"{built}/clipped.gpkg").count() == 4


def test_point_quality_control(spark, built, tmp_path):
    points = vector.read_vector(spark, f"{built}/known.geojson")
    far = vector.of_points(spark.createDataFrame([(-80.0, 40.0), (-74.3, 41.7)], "longitude double, latitude double"))
    mixed = points.select(*vector.OWN).unionByName(far.select(*vector.OWN).withColumn("row", F.col("row") + 1000))
    roads, streams = vector.read_vector(spark, f"{built}/roads.geojson"), vector.read_vector(spark, f"{built}/streams.gpkg")
    found, summary = workflow.check_points(mixed, roads, streams, spark.read.parquet(f"{built}/candidates"))
    n = points.count()
    assert summary["rows"] == n + 2 and summary["matched_existing_candidates"] == n and summary["outside_analysis_extent"] == 2
    assert summary["analysis_flags"] == {"matched_existing_candidate": n, "outside_current_analysis_extent": 2} and summary["nearest_road_distance_m"]["min"] < 5
    rows = found.orderBy("row").collect()
    assert [(r["latitude"], r["longitude"]) for r in rows] == sorted((r["latitude"], r["longitude"]) for r in rows) and {r["point_id"] for r in rows} == {f"pt_{i + 1:04d}" for i in range(n + 2)}
    paths = pointqc.write_outputs(found, summary, f"{tmp_path}/qc")
    assert json.loads(open(paths["json"]).read())["rows"] == n + 2 and "# " in open(paths["md"]).read() and vector.read_vector(spark, paths["geojson"]).count() == n + 2
    training, counts = pointqc.high_confidence(found)
    assert counts["rows"] == n == training.count() and counts["rejected_rows"] == 2
    with pytest.raises(ValueError, match="lacks"):
        pointqc.high_confidence(found.drop("analysis_flag"))
    with pytest.raises(ValueError, match="no point"):
        pointqc.high_confidence(found, ("none",))
    inside, summary = workflow.check_points(mixed, boundary=vector.read_vector(spark, f"{built}/region.geojson") if (built / "region.geojson").exists() else None)
    assert summary["nearest_road_distance_m"] == {} and summary["rows"] == n + 2
    with pytest.raises(ValueError, match="no points"):
        workflow.check_points(points.limit(0))


# --- Small operators ---


def test_an_empty_set_has_a_digest(spark):
    import hashlib

    from terralane.operators import observations

    none = spark.createDataFrame([], "observation_id string, status string")
    assert observations.fingerprint(none).first()["fingerprint"] == hashlib.sha256(b"").hexdigest()[:24]


def test_probabilities_by_place(spark):
    a = spark.createDataFrame([(i, i * 10) for i in range(20)], "n int, v int")
    b = spark.createDataFrame([(i, i / 20) for i in range(20)], "n int, culvert_probability double")
    got = {r["n"]: r["culvert_probability"] for r in discovery.attach_probability(a, b, "n").collect()}
    assert got == {i: i / 20 for i in range(20)}
    assert {r["v"]: r["culvert_probability"] for r in discovery.attach_probability(a.coalesce(1), b.coalesce(1)).collect()} == {i * 10: i / 20 for i in range(20)}
    assert "culvert_probability" not in discovery.attach_probability(a, b.limit(5)).columns


def test_import_counts(spark):
    lines = spark.createDataFrame([("a.pdf", 1, "SC 12 at 42.10000, -73.90000"), ("b.pdf", 1, "42.10000, -73.90000"), ("b.pdf", 2, "41.50000, -74.10000")], "source_file string, line_no long, line string")
    found, counts = reports.imported(lines)
    assert counts["rows"] == found.count() == 2
    with pytest.raises(ValueError):
        reports.imported(lines.where("line_no = 9"))


def test_published_order(spark):
    df = spark.createDataFrame([("a", 2, 50.0, 9), ("b", 1, 40.0, 8), ("c", 3, 60.0, 7)], "candidate_id string, discovery_rank int, discovery_score double, priority_rank int")
    by = lambda d: [r["candidate_id"] for r in d.orderBy(*export.preferred_order(d), "candidate_id").collect()]
    assert by(df) == ["b", "a", "c"] and by(df.drop("discovery_rank")) == ["c", "a", "b"] and by(df.select("candidate_id", "priority_rank")) == ["c", "b", "a"] and by(df.select("candidate_id")) == ["a", "b", "c"]


def test_jsonl_has_sorted_keys(spark, tmp_path):
    sinks.write_jsonl(spark.createDataFrame([(2, None, "x")], "b int, a string, c string").coalesce(1), f"{tmp_path}/q")
    assert spark.read.text(f"{tmp_path}/q").first()["value"] == '{"a":null,"b":2,"c":"x"}'


def test_settings(tmp_path):
    text = """
# a pilot
project:
  name: "north # side"   # quoted
  region_key: ulster_poughkeepsie
paths:
  roads: data/roads.gpkg
  nothing:
candidate_generation:
  snap_tolerance_m: 15
features:
  density_radii_m: [50, 100.5]
model:
  model_family: auto
  test_size: 0.2
"""
    (tmp_path / "p.yml").write_text(text)
    p = config.load(f"{tmp_path}/p.yml")
    assert (p.name, p.snap_tolerance_m, p.min_spacing_m, p.density_radii_m, p.test_size, p.paths["roads"]) == ("north # side", 15, 25.0, (50, 100.5), 0.2, "data/roads.gpkg")
    assert config.parse("a:\n  - 1\n  - x\nb: true\nc:\n    d: null\n    e: 1.5\n") == {"a": [1, "x"], "b": True, "c": {"d": None, "e": 1.5}}
    for bad in ("oops:\n  x: 1\n", "model:\n  typo: 1\n"):
        (tmp_path / "bad.yml").write_text(bad)
        with pytest.raises(ValueError, match="unknown"):
            config.load(f"{tmp_path}/bad.yml")
    with pytest.raises(ValueError, match="line 1"):
        config.parse("no value here")


def test_tables_are_removed(spark, tmp_path):
    from pathlib import Path

    there = lambda p: Path(p.removeprefix("file://")).exists()
    with scope() as made:
        materialize(spark.range(3), "a")
        out, path = settle(lambda: materialize(spark.range(5), "b")[0].where("id > 1"), "c")
        with scratch(spark) as kept:
            _, gone = materialize(spark.range(2), "d")
            _, stays = materialize(spark.range(2), "e")
            kept.add(stays)
    assert out.count() == 3 and there(path) and there(stays) and not there(gone) and len(made) == 5 and sum(map(there, made)) == 3


# --- Models ---


@pytest.fixture(scope="module")
def labelled(spark):
    rows = spark.range(240).select(F.format_string("c%03d", "id").alias("candidate_id"), (F.col("id") % 5 == 0).cast("int").alias("is_culvert"), ((F.col("id") * 37 % 100) / 50.0).alias("noise"), ((F.col("id") % 12) * 2000.0).alias("x_m"), ((F.col("id") % 7) * 2600.0).alias("y_m"), F.lit(1.5).alias("training_sample_weight"))
    return rows.withColumn("signal", F.col("is_culvert") * 2 + F.col("noise") * 0.3).cache()


def test_holdouts_are_whole_and_stratified(spark, labelled):
    a, b = (models.random_holdout(labelled.repartition(n), "candidate_id", "is_culvert") for n in (2, 5))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    counts = {(r["is_culvert"], r["is_test"]): r["count"] for r in a.groupBy("is_culvert", "is_test").count().collect()}
    assert counts == {(1, True): 12, (1, False): 36, (0, True): 48, (0, False): 144}
    by = models.folds(labelled, 5, "candidate_id", "is_culvert").groupBy("fold", "is_culvert").count().collect()
    assert sorted((r["is_culvert"], r["count"]) for r in by) == sorted([(0, n) for n in (39, 39, 38, 38, 38)] + [(1, n) for n in (10, 10, 10, 9, 9)])


def test_every_family_fits(spark, labelled):
    for family in models.FAMILIES:
        model = models.fit(labelled, ["signal", "noise"], family, scale=0.005)
        assert models.predict(labelled.limit(5), model, ["signal", "noise"]).count() == 5 and models.importance(model, ["signal", "noise"])[0][0] == "signal"


def test_training_compares_families(spark, labelled, monkeypatch):
    monkeypatch.setattr(models, "FAMILIES", {f: models.FAMILIES[f] for f in ("logistic", "extra_trees")})
    model, report = models.train(labelled, scale=0.01)
    assert set(report["model_comparison"]) == {"baseline", *models.FAMILIES} and report["family"] in models.FAMILIES
    assert report["model_comparison"]["baseline"]["average_precision"] == pytest.approx(0.2)
    assert report["class_counts"] == {"0": 192, "1": 48} and report["sample_weight"]["positive_weight_sum"] == 72.0 and report["importance"][0]["feature"] == "signal"
    assert report["spatial_holdout"]["average_precision"] > 0.9 and report["operating_threshold"]["source"] == "spatial_holdout"
    assert models.selected({"baseline": {"average_precision": 2.0}, "a": {"average_precision": None}, "b": {"spatial_holdout_average_precision": 0.1}, "c": {"spatial_holdout_average_precision": 0.1, "average_precision": 0.2}}) == "c"
    with pytest.raises(ValueError, match="both classes"):
        models.train(labelled.where("is_culvert = 1"), family="logistic")
    with pytest.raises(ValueError, match="no target"):
        models.train(labelled.drop("is_culvert"))
    with pytest.raises(ValueError, match="unknown model family"):
        models.train(labelled, family="other")


# --- Streams ---

TRACK = "device string, at timestamp, latitude double, longitude double, accuracy double"


def _track():
    """20 steps of 3 m to the north, a second apart; then a more accurate fix without a move, and a worse one."""
    import datetime as dt

    t0 = dt.datetime(2026, 1, 1)
    rows = [("d", t0 + dt.timedelta(seconds=i), 42.0 + i * 3 / 111_195, -74.0, 9.0) for i in range(20)]
    rows += [("d", t0 + dt.timedelta(seconds=20), rows[-1][2], -74.0, 5.0), ("d", t0 + dt.timedelta(seconds=20.2), rows[-1][2], -74.0, 4.0), ("d", t0 + dt.timedelta(seconds=21), rows[-1][2], -74.0, 8.0), ("e", t0, 10.0, 10.0, None), ("e", t0, None, 1.0, 1.0)]
    return rows


def test_positions_are_compared_with_the_last_that_counted(spark):
    got = stream.throttled_positions(spark.createDataFrame(_track(), TRACK)).where("device = 'd'").orderBy("at").collect()
    # Each second step is 6 m from the last that counted.
    assert [(r["at"].minute * 60 + r["at"].second) for r in got] == [0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 20]
    assert [r["lists"] for r in got] == [True] * 11 + [False]  # 0.2 s after the last list
    assert stream.throttled_positions(spark.createDataFrame(_track(), TRACK)).where("device = 'e'").count() == 1


def test_position_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = _track()
    for n, part in enumerate((rows[:7], rows[7:15], rows[15:])):
        (source / f"{n}.json").write_text("\n".join(json.dumps({"device": d, "at": at.isoformat(), "latitude": a, "longitude": b, "accuracy": c}) for d, at, a, b, c in part))
        q = stream.throttle_stream(spark.readStream.schema(TRACK).json(str(source))).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination()
    key = lambda df: sorted(map(str, df.collect()))
    assert key(spark.read.parquet(f"{tmp_path}/out")) == key(stream.throttled_positions(spark.createDataFrame(rows, TRACK)))


def test_snapshots_rewrite_only_touched_parts(spark, tmp_path):
    source, folder = tmp_path / "in", f"{tmp_path}/state"
    source.mkdir()
    want = {}
    for n in range(6):
        lines = []
        for i in range(3):
            key = f"o{(n * 2 + i) % 9}"
            want[key] = f"2026-01-{n + 1:02d}"
            lines.append(json.dumps({"observation_id": key, "observed_at": want[key], "status": "no_culvert", "latitude": 42.0, "longitude": -74.0}))
        (source / f"{n}.json").write_text("\n".join(lines))
        stream.upsert_stream(stream.read_observations(spark, str(source)), folder, parts=16).awaitTermination()
    assert {r["observation_id"]: r["observed_at"] for r in stream.latest_snapshot(spark, folder, 99).collect()} == want
    from pathlib import Path

    assert sorted(p.name for p in Path(f"{folder}/manifests").glob("batch-*")) == ["batch-3", "batch-4", "batch-5"]
    folders = {p for p in Path(f"{folder}/parts").glob("batch-*/part=*")}
    named = {p for n in (3, 4, 5) for p in stream.latest_manifest(spark, folder, n).values()}
    assert {str(p) for p in folders} == named


def test_scheduled_checks():
    ok = lambda p: True
    assert stream.scheduled_check(None, "f", 0.0, ok, production=True)[0] == 500
    assert stream.scheduled_check(None, "f", 0.0, ok, "Bearer no", "s")[0] == 401
    status, state, answer = stream.scheduled_check(None, "f", 1000.0, ok, "Bearer s", "s")
    assert status == 200 and answer["retraining"]["status"] == "queued"
    assert stream.scheduled_check(state, "f", 1001.0, ok, "Bearer s", "s")[2]["retraining"]["status"] == "unchanged"
    assert stream.scheduled_check(state, "f", 1001.0, ok, "Bearer s", "s", force=True)[2]["retraining"]["status"] == "queued"


# --- Service ---


@pytest.fixture
def deployed(spark, tmp_path):
    rows = [(f"cand_{i:06d}", i, 90.0 - i, "undiscovered_candidate", 0, "text", -74.0 + i / 100, 42.0, "low") for i in range(1, 6)]
    base = spark.createDataFrame(rows, "candidate_id string, rank long, discovery_score double, discovery_status string, is_known_field_match int, evidence_summary string, longitude double, latitude double, priority_bucket string").cache()
    sent = []
    return service.Service(spark, base, str(tmp_path), lambda p: sent.append(p) or True, tasks={"demo": lambda: "done"}, now=lambda: 1000.0), sent


def test_service(deployed, tmp_path):
    s, sent = deployed
    assert s.handle("GET", "/api/observations")[:2] == (200, {"type": "FeatureCollection", "features": []})
    assert len(s.handle("GET", "/api/findings")[1]["features"]) == 5 and s.handle("GET", "/api/summary")[1]["rows"] == 5
    body = {"observation_id": "o1", "candidate_id": "cand_000002", "status": "no_culvert", "observed_at": "2026-01-01", "latitude": 42.0, "longitude": -73.98, "notes": "x" * 3000}
    status, said, _ = s.handle("POST", "/api/observations", json.dumps(body).encode())
    assert status == 201 and said["status"] == "saved" and len(said["feature"]["properties"]["notes"]) == 2000 and said["retraining"]["status"] == "queued" and len(sent) == 1
    by = {f["properties"]["candidate_id"]: f["properties"] for f in said["findings"]["features"]}
    assert by["cand_000002"]["discovery_status"] == "field_denied" and by["cand_000002"]["discovery_rank"] == 5 and said["summary"]["denied_culverts"] == 1
    assert s.handle("GET", "/api/findings")[1] == said["findings"]  # from the cache
    body["status"] = "confirmed_culvert"
    assert s.handle("POST", "/api/observations", json.dumps(body).encode())[1]["retraining"]["status"] == "debounced"
    assert len(s.observations()["features"]) == 1
    for bad in (b"{", b"[1]", json.dumps(body | {"latitude": 99}).encode(), json.dumps(body | {"observation_id": ""}).encode(), b"x" * 1_000_001):
        assert s.handle("POST", "/api/observations", bad)[0] == 400
    assert s.handle("DELETE", "/api/observations?id=none")[0] == 400 and s.handle("DELETE", "/api/observations")[0] == 400
    status, said, _ = s.handle("DELETE", "/api/observations?id=o1")
    assert status == 200 and said["observations"]["features"] == [] and said["summary"]["observations"] == 0
    assert s.handle("PUT", "/api/findings")[0] == 405 and s.handle("PUT", "/api/findings")[2]["allow"] == "GET" and s.handle("GET", "/api/none")[0] == 404
    assert s.handle("GET", "/api/cron/retrain?force=1")[1]["retraining"]["status"] == "queued"
    health = s.handle("GET", "/api/health")[1]
    assert health["status"] == "ok" and health["data"]["field_observations"]["exists"]
    n = service.pull_observations(f"{tmp_path}/copy.geojson", f"{tmp_path}/field_observations.geojson")
    assert n == 0
    (tmp_path / "bad.json").write_text('{"type": "Feature"}')
    with pytest.raises(ValueError, match="FeatureCollection"):
        service.pull_observations(f"{tmp_path}/copy.geojson", f"{tmp_path}/bad.json")


def test_the_cache_belongs_to_its_queue(deployed):
    s, _ = deployed
    first = s.published()[1]["base_fingerprint"]
    s.base = s.base.where("rank < 5")
    assert s.published()[1]["base_fingerprint"] != first and len(s.published()[0]["features"]) == 4


def test_one_task_at_a_time(deployed):
    s, _ = deployed
    gate, begun = threading.Event(), threading.Event()
    s.tasks["slow"] = lambda: (begun.set(), gate.wait(20))[1]
    s.tasks["bad"] = lambda: 1 / 0
    answers = []
    t = threading.Thread(target=lambda: answers.append(s.handle("POST", "/api/run-slow")))
    t.start()
    begun.wait(20)
    busy = s.handle("POST", "/api/run-demo")
    gate.set()
    t.join()
    assert busy[0] == 409 and busy[1]["active_task"] == "slow" and answers[0][0] == 200
    assert s.handle("POST", "/api/run-demo")[1]["result"] == "done" and s.handle("POST", "/api/run-bad")[0] == 500 and s.handle("POST", "/api/run-none")[0] == 404 and s.handle("GET", "/api/run-demo")[0] == 405


def test_server(deployed):
    s, _ = deployed
    http = service.server(s)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{http.server_address[1]}"
        with urllib.request.urlopen(f"{url}/api/health") as answer:
            assert json.loads(answer.read())["status"] == "ok" and answer.headers["cache-control"] == "no-store"
        with pytest.raises(urllib.error.HTTPError) as wrong:
            urllib.request.urlopen(urllib.request.Request(f"{url}/api/observations", data=b"{}", method="POST"))
        assert wrong.value.code == 400
    finally:
        http.shutdown()
