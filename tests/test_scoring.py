from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terralane.functions.columns import bucket
from terralane.functions.ranking import global_rank, pct_ranks, robust_0_to_1
from terralane.operators import discovery, metrics, scoring


def test_average_ranks_and_quantiles(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 3.0, 3.0, None, 9.0])], "i int, v double")
    got = [r["p"] for r in pct_ranks(df, {"p": F.col("v")}).orderBy("i").collect()]
    assert got == [0.25, 0.625, 0.625, None, 1.0]
    assert df.agg(F.percentile("v", 0.05), F.percentile("v", 0.95)).first()[:] == pytest.approx((1.3, 8.1))
    assert [r["s"] for r in robust_0_to_1(df, "v", "s").orderBy("i").collect()][3] == 0.0
    one = pct_ranks(df.where("i = 0"), {"p": F.col("v")}).first()
    assert one["p"] is None


def test_bucket_edges(spark):
    values = [0.0, 35.0, 35.0001, 55.0, 75.0, 75.1, -0.02, None]
    got = [r["b"] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", bucket(F.col("v")).alias("b")).orderBy("i").collect()]
    assert got == ["low", "low", "medium", "medium", "high", "very_high", "nan", "nan"]


def test_global_rank_is_total(spark):
    df = spark.range(500).select("id", (F.col("id") * 7919 % 10).cast("double").alias("v"))
    got = {r["id"]: r["rank"] for r in global_rank(df, F.col("v"), [F.col("id")]).collect()}
    order = sorted(got, key=lambda i: (-(i * 7919 % 10), i))
    assert [got[i] for i in order] == list(range(1, 501))


def test_strong_evidence_comes_first(spark):
    cols = "candidate_id string, road_stream_distance_m double, is_exact_road_stream_intersection int, stream_order int, stream_density_250m_m_per_sqkm double, valley_depth_9x9_m double, crossing_angle_degrees double, slope_degrees double, road_density_250m_m_per_sqkm double, latitude double, longitude double"
    df = spark.createDataFrame([("low", 80.0, 0, 1, 10.0, 0.0, 20.0, 0.2, 5.0, 42.0, -74.0), ("high", 0.0, 1, 3, 100.0, 2.0, 85.0, 4.0, 50.0, 42.0, -74.0)], cols)
    got = scoring.score_candidates(df).orderBy("priority_rank").collect()
    assert [r["candidate_id"] for r in got] == ["high", "low"]
    assert got[0]["google_earth_url"].endswith("42.0000000,-74.0000000") and "road-drainage crossing" in got[0]["evidence_summary"]
    assert got[0]["field_corridor_support_score"] == 0.0


def test_rounding_errors_are_ties(spark):
    """scores that differ in their last bits rank by id, as they do in the query's SQL."""
    df = spark.createDataFrame([("b", 10.0), ("a", 10.0 + 1e-11), ("c", 9.0)], "candidate_id string, road_stream_distance_m double")
    got = scoring.score_candidates(df).orderBy("priority_rank").collect()
    assert got[1]["culvert_likelihood_score"] < got[2]["culvert_likelihood_score"]
    assert [r["candidate_id"] for r in got] == ["c", "a", "b"]


def test_known_and_denied_score_nothing(spark):
    df = spark.createDataFrame([("a", 0.0, 1, 0), ("b", 0.0, 0, 1), ("c", 0.0, 0, 0)], "candidate_id string, road_stream_distance_m double, is_culvert int, field_denied int")
    got = {r["candidate_id"]: r["culvert_likelihood_score"] for r in scoring.score_candidates(df).collect()}
    assert got["a"] == got["b"] == 0.0 < got["c"]


def test_route_dips_lead(spark):
    df = spark.createDataFrame([("dip", "route_interval_sample", 3.0, 2.0), ("flat", "route_interval_sample", 0.0, 0.0)], "candidate_id string, source string, valley_depth_9x9_m double, negative_tpi_31x31_m double")
    got = scoring.score_candidates(df).orderBy("priority_rank").collect()
    assert got[0]["candidate_id"] == "dip" and got[0]["dem_route_drainage_score"] > got[1]["dem_route_drainage_score"]
    deep = scoring.score_candidates(df.withColumns({f"low_slope_valley_score_{w}": F.when(F.col("candidate_id") == "dip", 1.0).otherwise(0.0) for w in ("15x15", "31x31")})).orderBy("priority_rank").first()
    assert "DEM road low point" in deep["evidence_summary"]


def test_weights_must_be_positive(spark):
    with pytest.raises(ValueError):
        scoring.score_candidates(spark.createDataFrame([("a",)], "candidate_id string"), {"x": 0.0})


RANKED = "candidate_id string, culvert_likelihood_score double, is_culvert int, dist_to_known_culvert_m double"


def test_unknown_sites_come_before_known(spark):
    df = spark.createDataFrame([("known", 95.0, 1, 8.0), ("new", 72.0, 0, 800.0)], RANKED)
    p = spark.createDataFrame([("known", 0.98), ("new", 0.74), ("new", 0.1)], "candidate_id string, culvert_probability double")
    got = discovery.discovery_ranking(df, p).orderBy("discovery_rank").collect()
    assert [(r["candidate_id"], r["discovery_status"]) for r in got] == [("new", "undiscovered_candidate"), ("known", "known_field_match")]
    assert got[1]["discovery_score"] == 0


def test_without_model_the_evidence_stands(spark):
    got = discovery.discovery_ranking(spark.createDataFrame([("a", 35.0, 0, 500.0), ("b", 48.0, 0, 500.0)], RANKED)).orderBy("discovery_rank").collect()
    assert [r["discovery_score"] for r in got] == [48.0, 35.0]


def test_one_probability_is_used_raw_and_missing_ones_rank_zero(spark):
    df = spark.createDataFrame([("a", 50.0, 0, None), ("b", 50.0, 0, None), ("c", 50.0, 0, None)], RANKED)
    one = spark.createDataFrame([("a", 0.5)], "candidate_id string, culvert_probability double")
    got = {r["candidate_id"]: r for r in discovery.discovery_ranking(df, one).collect()}
    assert got["a"]["model_rank_score"] == 50.0 and got["b"]["discovery_score"] == 50.0
    two = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "candidate_id string, culvert_probability double")
    assert {r["candidate_id"]: r for r in discovery.discovery_ranking(df, two).collect()}["c"]["discovery_score"] == pytest.approx(100 * (0.25 * 0.5 + 0.2 * 0.4 * 0.5))
    assert {r["candidate_id"]: r for r in discovery.discovery_ranking(df, two, missing_probability_as_zero=False).collect()}["c"]["discovery_score"] == 50.0


def test_denied_flag_beats_distance(spark):
    df = spark.createDataFrame([("a", 60.0, 1, 0, 5.0), ("b", 60.0, 0, 1, 900.0)], "candidate_id string, culvert_likelihood_score double, is_culvert int, field_denied int, dist_to_denied_culvert_m double")
    got = {r["candidate_id"]: r["discovery_status"] for r in discovery.discovery_ranking(df, known_radius_m=10.0).collect()}
    assert got == {"a": "known_field_match", "b": "field_denied"}


def test_bad_blend(spark):
    with pytest.raises(ValueError):
        discovery.discovery_ranking(spark.createDataFrame([("a", 1.0, 0, None)], RANKED), evidence_weight=-1)


def test_metrics_on_ties(spark):
    y, p = [1, 0, 1, 0, 1, 0, 0, 1], [0.9, 0.9, 0.8, 0.7, 0.7, 0.6, 0.5, 0.5]
    df = spark.createDataFrame(list(zip(range(8), y, p, strict=True)), "id int, target int, probability double")
    got = metrics.binary_metrics(df).first()
    pairs = [(a > b) + (a == b) / 2 for a, s in zip(p, y, strict=True) if s for b, t in zip(p, y, strict=True) if not t]
    assert got["average_precision"] == pytest.approx(0.5666667) and got["roc_auc"] == pytest.approx(sum(pairs) / len(pairs))
    top = metrics.top_k(df, (2, 100)).orderBy("k").collect()
    assert [(r["k"], r["hits"]) for r in top] == [(2, 1), (8, 4)]
    none = metrics.binary_metrics(df.where("target = 1")).first()
    assert none["roc_auc"] is None


def test_precision_floor(spark):
    df = spark.createDataFrame(list(zip([1, 0, 1, 0, 1, 0], [0.95, 0.9, 0.8, 0.7, 0.65, 0.1], strict=True)), "target int, probability double")
    got = metrics.precision_floor(df, floor=0.6).first()
    assert (got["threshold"], got["predicted_positive_count"]) == (0.65, 5)
    assert metrics.precision_floor(df.where("target = 0")).count() == 0


def test_percentiles_beyond_what_is_sent(spark, monkeypatch):
    """Few values, many values, and many with hot ones give the same ranks."""
    from terralane.functions import ranking

    rows = [(i, float(i % 3) if i % 5 else None, float(i * 7 % 101), None) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double").repartition(3)
    columns = {"ra": F.col("a"), "rb": F.col("b"), "rc": F.col("c")}
    want = sorted(map(tuple, ranking.pct_ranks(df, columns).collect()), key=str)
    for sent, hot in ((0, 100_000), (0, 50)):
        monkeypatch.setattr(ranking, "SENT_VALUES", sent)
        monkeypatch.setattr(ranking, "HOT_ROWS", hot)
        assert sorted(map(tuple, ranking.pct_ranks(df, columns).collect()), key=str) == want
    a = sorted(r[1] for r in rows if r[1] is not None)
    by = {v: (sum(x < v for x in a) + (sum(x == v for x in a) + 1) / 2) / len(a) for v in set(a)}
    assert all(r[4] == (None if r[1] is None else pytest.approx(by[r[1]])) and r[6] is None for r in want)
