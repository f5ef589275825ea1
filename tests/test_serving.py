from __future__ import annotations

import io

import pytest
from pyspark.sql import functions as F

from terralane.operators import serving
from terralane.sources import regions


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(
        [("cand_1", 1, 80.0, "State Rte 9W", False, 42.0, -74.0), ("cand_2", 2, 40.0, "Co Rd 6", False, 42.0005, -74.0), ("cand_3", 3, 90.0, "Mill Ln", True, 42.1, -74.0)],
        "candidate_id string, discovery_rank int, discovery_score double, road_name string, is_known_field_match boolean, latitude double, longitude double",
    )


def test_search_and_order(rows):
    n = serving.normalized(rows)
    ids = lambda df: [r["candidate_id"] for r in df.collect()]
    assert ids(serving.listed(serving.filtered(n))) == ["cand_1", "cand_2"]
    assert ids(serving.filtered(n, "ny 9w")) == ["cand_1"] and ids(serving.filtered(n, "county road")) == ["cand_2"]
    assert ids(serving.filtered(n, "mill", show_known=True)) == ["cand_3"] and ids(serving.filtered(n, least_score=50)) == ["cand_1"]
    assert ids(serving.listed(n, 42.0005, -74.0)) == ["cand_2", "cand_1", "cand_3"]


def test_union_by_id(spark):
    a, b = (spark.createDataFrame(r, "candidate_id string, v int") for r in ([("x", 1), ("y", 1)], [("y", 2)]))
    assert {(r["candidate_id"], r["v"]) for r in serving.union_by_id(a, b).collect()} == {("x", 1), ("y", 2)}


def test_canvas(spark):
    df = spark.createDataFrame([("a", 2, 1.0, 10.0, 10.0), ("b", 1, 1.0, 20.0, 20.0), ("c", 9, 1.0, 30.0, 30.0)], "candidate_id string, rank int, score double, px double, py double")
    got = lambda zoom: {r["candidate_id"] for r in serving.on_canvas(df, zoom, F.col("candidate_id") == "c").collect()}
    assert got(14) == {"b", "c"} and got(18) == {"a", "b", "c"} and [serving.cell_size(z) for z in (17, 15, 13, 5)] == [36, 52, 66, 82]


def test_point_context(rows):
    hit = serving.point_context(rows, 42.0, -74.0).first()
    assert (hit["candidate_id"], hit["prediction_hit"], hit["missed_candidate_id"], hit["road_name"]) == ("cand_1", True, "", "State Rte 9W")
    miss = serving.point_context(rows, 42.0002, -74.0).first()
    assert (miss["within_radius"], miss["missed_candidate_id"]) == (True, "cand_1") and 20 < miss["distance_m"] < 25
    far = serving.point_context(rows, 42.05, -74.0).first()
    assert (far["within_radius"], far["layout_source"], far["road_name"]) == (False, "manual_map_point", "")


def test_counts_and_summaries(spark, rows):
    o = spark.createDataFrame([("no_culvert",), ("confirmed_culvert",), ("x",), (None,)], "status string")
    assert serving.status_counts(o).first().asDict() == {"observations": 4, "confirmed_culverts": 1, "denied_culverts": 1, "uncertain": 2}
    assert serving.base_fingerprint(rows, "discovery_rank").first()[0] == "3:cand_1:cand_3"
    report = {"family": "logistic", "class_counts": {"0": 3, "1": 2}, "feature_columns": ["a"], "spatial_holdout": {"average_precision": 0.5, "top_k": [{"k": 10, "precision_at_k": 0.9}]}}
    s = serving.model_summary(report, {"rows": 4}, 7)
    assert (s["rows"], s["spatial_holdout_top10_precision"], s["random_holdout_roc_auc"], s["training_points"]) == (5, 0.9, None, 7)
    assert serving.model_summary(None)["available"] is False
    text = serving.quality_report({"rows": 2, "match_radius_m": 10.0, "matched_existing_candidates": 1, "outside_analysis_extent": 0, "nearest_road_distance_m": {"median": 1.0, "p90": 2.0, "max": 3.0}, "analysis_flags": {"f": 2}, "clusters": []})
    assert "median 1.0 m" in text and "Nearest stream: unavailable" in text


def test_regions(spark):
    r = regions.region("ulster_poughkeepsie")
    p = spark.createDataFrame([(0, -73.96, 41.72), (1, -75.2, 42.8)], "i int, longitude double, latitude double")
    assert [x["i"] for x in regions.points_inside(p, r).collect()] == [0]
    box = regions.Region("box", 0.0, 0.0, 10.0, 10.0)
    s = spark.createDataFrame([(0, -5.0, 5.0, 5.0, 5.0), (1, 20.0, 0.0, 30.0, 0.0), (2, 3.0, -1.0, 3.0, 20.0), (3, -1.0, 5.0, 5.0, 20.0)], "i int, x1 double, y1 double, x2 double, y2 double")
    assert {(x["i"], x["x1"], x["y1"], x["x2"], x["y2"]) for x in regions.clip_segments(s, box).collect()} == {(0, 0.0, 5.0, 5.0, 5.0), (2, 3.0, 0.0, 3.0, 10.0), (3, 0.0, 7.5, 1.0, 10.0)}
    with pytest.raises(ValueError):
        regions.region("nowhere")


def test_fetching_once(tmp_path):
    calls = []
    get = lambda url, timeout: calls.append(url) or io.BytesIO(b"data")
    for _ in range(2):
        assert open(regions.fetched("https://example.org/a/b.zip", str(tmp_path), opener=get), "rb").read() == b"data"
    assert len(calls) == 1
