from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from terralane.functions import geometry
from terralane.operators import candidates, export, features, labels, raster
from terralane.operators.spatial import clusters, grid_join, nearest, thin
from terralane.sources import demo


def points(spark, xy, columns="id"):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], f"{columns} long, x double, y double")


@pytest.fixture(scope="module")
def cloud():
    rng = random.Random(4)
    return [(rng.uniform(-500, 500), rng.uniform(-500, 500)) for _ in range(300)] + [(0.0, 0.0), (0.0, 0.0), (25.0, 0.0)]


def lines(spark, rows):
    df = spark.createDataFrame([(i, n, [(float(a), float(b)) for a, b in p]) for i, (n, p) in enumerate(rows)], "line long, name string, points array<struct<x:double,y:double>>")
    return df, geometry.segments(df, "line")


def test_grid_join_equals_all_pairs(spark, cloud):
    got = {(r["l_id"], r["r_id"]) for r in grid_join(points(spark, cloud), points(spark, cloud), 25.0).collect()}
    assert got == {(i, j) for i, a in enumerate(cloud) for j, b in enumerate(cloud) if math.dist(a, b) <= 25.0}


def test_nearest_equals_all_pairs(spark, cloud):
    others = cloud[:40]
    got = {r["l_id"]: (r["r_id"], r["d"]) for r in nearest(points(spark, cloud), points(spark, others), "id", "id").collect()}
    for i, a in enumerate(cloud):
        d, j = min((math.dist(a, b), j) for j, b in enumerate(others))
        assert got[i][0] == j and got[i][1] == pytest.approx(d)
    far = nearest(points(spark, [(0, 0), (1e6, 1e6)]), points(spark, [(3, 4)]), "id", "id", max_distance=10.0).orderBy("l_id").collect()
    assert [r["d"] for r in far] == [5.0, None]
    assert nearest(points(spark, [(0, 0)]), points(spark, []), "id", "id").first()["d"] is None


@pytest.mark.parametrize(("spacing", "cap"), [(60.0, 0), (60.0, 3), (0.0, 2)])
def test_thin_equals_the_walk(spark, cloud, spacing, cap):
    taken, per = [], {}
    for i, a in sorted(enumerate(cloud), key=lambda t: (t[0] * 7 % 11, t[0])):
        if (not cap or per.get(i % 5, 0) < cap) and all(math.dist(a, cloud[j]) >= spacing for j in taken):
            taken.append(i)
            per[i % 5] = per.get(i % 5, 0) + 1
    df = points(spark, cloud).withColumns({"o": F.col("id") * 7 % 11, "g": F.col("id") % 5})
    assert {r["id"] for r in thin(df, "id", ["o"], spacing, "g", cap).collect()} == set(taken)


def test_clusters(spark):
    got = [r["cluster_id"] for r in clusters(points(spark, [(0, 0), (1000, 0), (5, 0), (10, 0), (1004, 0), (9999, 0)]), "id", 6.0).orderBy("id").collect()]
    assert got == [0, 1, 0, 0, 1, -1]


def test_segment_kernels(spark):
    one = spark.range(1)
    c = lambda *v: tuple(F.lit(float(x)) for x in v)
    meet = lambda a, b: one.select(geometry.crossing(c(*a), c(*b)).alias("p")).first()["p"]
    assert tuple(meet((0, 0, 10, 10), (0, 10, 10, 0))) == (5.0, 5.0)
    assert tuple(meet((0, 0, 10, 0), (10, 0, 10, 5))) == (10.0, 0.0)
    assert tuple(meet((0, 0, 10, 0), (4, 0, 20, 0))) == (7.0, 0.0)
    assert meet((0, 0, 10, 0), (0, 1, 10, 1)) is None
    near = one.select(geometry.nearest_on_first(c(0, 0, 10, 0), c(3, 4, 3, 9)).alias("p")).first()["p"]
    assert (near["d"], near["x"], near["y"]) == (4.0, 3.0, 0.0)
    inside = one.select(geometry.length_in_circle(*c(0, 0), 5.0, *c(-100, 3, 100, 3)).alias("n")).first()["n"]
    assert inside == pytest.approx(8.0)


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(-74.0, 42.0), (-75.0, 41.5), (-72.3, 44.9)], "lon double, lat double")
    x, y = geometry.to_utm(F.col("lon"), F.col("lat"), 18)
    out = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = geometry.from_utm(F.col("x"), F.col("y"), 18)
    for r in out.select("*", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert r["lon2"] == pytest.approx(r["lon"], abs=1e-8) and r["lat2"] == pytest.approx(r["lat"], abs=1e-8)
    middle = spark.range(1).select(*[v.alias(n) for n, v in zip("xy", geometry.to_utm(F.lit(-75.0), F.lit(0.0), 18), strict=True)]).first()
    assert middle["x"] == pytest.approx(500_000) and middle["y"] == pytest.approx(0, abs=1e-6)


def test_border_counts_as_inside(spark):
    square = [(0, 0, 4, 0), (4, 0, 4, 4), (4, 4, 0, 4), (0, 4, 0, 0)]
    edges = F.array(*[F.struct(*[F.lit(float(v)).alias(n) for v, n in zip(e, ("x1", "y1", "x2", "y2"), strict=True)]) for e in square])
    got = points(spark, [(2, 2), (4, 2), (0, 0), (5, 2)]).select("id", geometry.inside_ring(F.col("x"), F.col("y"), edges).alias("in")).orderBy("id").collect()
    assert [r["in"] for r in got] == [True, True, True, False]


def test_candidates_cross_and_approach(spark):
    r, rs = lines(spark, [("Main", [(0, 0), (50, 0), (100, 0)]), ("Side", [(0, 200), (100, 200)])])
    s, ss = lines(spark, [("Brook", [(50, -50), (50, 50)]), ("Creek", [(0, 210), (100, 210)]), ("Far", [(0, 500), (9, 500)])])
    got = {(x["road_name"], x["stream_name"]): x for x in candidates.generate(rs, ss, candidates.road_attributes(r), candidates.stream_attributes(s)).collect()}
    assert set(got) == {("Main", "Brook"), ("Side", "Creek")}
    hit = got["Main", "Brook"]
    assert (hit["x"], hit["y"], hit["source"], hit["crossing_angle_degrees"]) == (50.0, 0.0, candidates.EXACT, 90.0)
    assert got["Side", "Creek"]["road_stream_distance_m"] == 10.0 and got["Side", "Creek"]["priority_seed"] == pytest.approx(1 / 11)


def test_route_samples(spark):
    r, rs = lines(spark, [("US Hwy 9w", [(0, 0), (120, 0)]), ("Local Rd", [(0, 100), (120, 100)])])
    got = candidates.route_samples(rs, r, interval=40.0, numbered=True).collect()
    assert len(got) == 3 and {x["matched_route"] for x in got} == {"9W"} and {x["road_name"] for x in got} == {"US Hwy 9w"}
    wide = candidates.route_samples(rs.where("line = 0"), r.where("line = 0"), interval=60.0, numbered=True, lateral=(0.0, -8.0, 8.0)).collect()
    assert len(wide) == 6 and {round(x["y"], 6) for x in wide} == {-8.0, 0.0, 8.0}
    typed, ts = lines(spark, [("Co Rd 6", [(0, 0), (120, 0)]), ("State Rte 32", [(0, 9), (120, 9)])])
    typed = typed.withColumn("RTTYP", F.when(F.col("line") == 0, "C").otherwise("S"))
    assert {x["road_name"] for x in candidates.route_samples(ts, typed, interval=40.0, numbered=True).collect()} == {"State Rte 32"}
    asked = candidates.route_samples(ts, typed, ["Co Rd 6"], interval=500.0).collect()
    assert [x["route_sample_distance_m"] for x in asked] == [60.0]
    with pytest.raises(ValueError, match="at least one usable route"):
        candidates.route_samples(rs, r)
    with pytest.raises(ValueError):
        candidates.route_samples(rs, r, ["9W"], interval=0)


def test_union_and_field_ids(spark):
    a = spark.createDataFrame([(2, "x"), (1, "y")], "n long, candidate_id string")
    got = candidates.union([a, a]).orderBy("candidate_id").collect()
    assert [(r["candidate_id"], r["n"]) for r in got] == [("cand_000001", 1), ("cand_000002", 2), ("cand_000003", 1), ("cand_000004", 2)]
    have = spark.createDataFrame([("cand_000001",), ("field_000012",)], "candidate_id string")
    new = candidates.append_field(have, spark.createDataFrame([(0, 1.0, 2.0)], "point_row long, x double, y double"))
    assert sorted(r["candidate_id"] for r in new.collect()) == ["cand_000001", "field_000012", "field_000013"]
    with pytest.raises(ValueError):
        candidates.union([])


def test_one_label_per_known_site(spark):
    df = spark.createDataFrame([(0, 4.0, 0.0, "route_interval_sample"), (1, 2.0, 0.0, "exact_road_stream_intersection"), (2, 0.0, 0.0, "field_report_observed_culvert"), (3, 50.0, 0.0, "exact_road_stream_intersection")], "row long, x double, y double, source string")
    known = spark.createDataFrame([(0, 0.0, 0.0, "K1")], "known_row long, x double, y double, culvert_id string")
    got = labels.label_known(df, known).orderBy("row").collect()
    assert [r["is_culvert"] for r in got] == [0, 0, 1, 0] and got[3]["nearest_field_report_culvert_id"] == "K1" and got[3]["dist_to_known_culvert_m"] == 50.0


def test_denials(spark):
    base = spark.createDataFrame([(0, "bad", 0.0, 0.0, 1), (1, "other", 3.0, 0.0, 1), (2, "far", 500.0, 0.0, 1)], "row long, candidate_id string, x double, y double, is_culvert int")
    fields = "negative_row long, x double, y double, candidate_id string, miss_distance_m double, label string, observation_id string, notes string"
    near = labels.label_denied(base, spark.createDataFrame([(0, 4.0, 0.0, "", None, "no_culvert", "obs", "n")], fields)).orderBy("row").collect()
    assert [(r["field_denied"], r["is_culvert"], r["nearest_denied_observation_id"]) for r in near] == [(1, 0, "obs"), (1, 0, "obs"), (0, 1, "")]
    named = labels.label_denied(base, spark.createDataFrame([(0, 900.0, 0.0, "bad", 100.0, "missed_prediction", "m", "")], fields)).orderBy("row").collect()
    assert [r["field_denied"] for r in named] == [1, 0, 0] and named[0]["dist_to_denied_culvert_m"] == 100.0
    missed = labels.label_denied(base, spark.createDataFrame([(0, 0.0, 0.0, "", None, "missed_prediction", "m", "")], fields)).orderBy("row").collect()
    assert [r["field_denied"] for r in missed] == [0, 0, 0]
    none = labels.label_denied(base, spark.createDataFrame([], fields)).collect()
    assert {(r["field_denied"], r["dist_to_denied_culvert_m"]) for r in none} == {(0, None)}


def test_sample_weights(spark):
    rows = [(0, 0, 0, "", ""), (1, 1, 0, "report.pdf", ""), (2, 1, 0, "x/Field_Observations.geojson", ""), (3, 1, 1, "", "no"), (4, 0, 1, "", "Confirmed culvert was 100.0 m away")]
    df = spark.createDataFrame(rows, "i int, is_culvert int, field_denied int, nearest_field_report_source_file string, nearest_denied_notes string")
    assert [r["training_sample_weight"] for r in labels.sample_weights(df).orderBy("i").collect()] == [0.25, 6.0, 24.0, 12.0, 16.0]


def test_density_and_distance(spark):
    _, s = lines(spark, [("a", [(-1000, 30), (1000, 30)])])
    got = features.line_features(points(spark, [(0, 0), (0, 5000)], "row"), s.withColumn("seg_id", F.col("line")), "row", "road").orderBy("row").collect()
    assert got[0]["distance_to_nearest_road_m"] == 30.0
    assert got[0]["road_density_50m_m_per_sqkm"] == pytest.approx(80 / (math.pi * 2500 / 1e6)) and got[1]["road_density_250m_m_per_sqkm"] == 0.0
    assert got[0]["road_density_m_per_sqkm"] == got[0]["road_density_75m_m_per_sqkm"]
    assert features.density_radii(75.0, (500.0,)) == [50.0, 75.0, 100.0, 250.0, 500.0]


def test_terrain_window(spark):
    cells = spark.createDataFrame([(r, c, 100 + 0.2 * r + 0.8 * abs(c - 22)) for r in range(45) for c in range(45)], "row int, col int, v double")
    grid = raster.Grid(0.0, 45.0, 1.0, 1.0, 45, 45)
    df = points(spark, [(22.5, 22.5), (0.5, 0.5)], "row")
    out = features.hydrology_proxies(raster.window_stats(raster.sample(df, cells, grid, "elevation_m"), cells, grid, "row")).orderBy("row").collect()
    window = [100 + 0.2 * r + 0.8 * abs(c - 22) for r in range(18, 27) for c in range(18, 27)]
    assert out[0]["elevation_m"] == pytest.approx(104.4) and out[0]["elevation_mean_9x9_m"] == pytest.approx(sum(window) / 81)
    assert out[0]["valley_depth_9x9_m"] > 0 and out[0]["topographic_wetness_proxy_9x9"] > 0 and out[0]["terrain_break_score_proxy_31x31"] > 0
    assert out[0]["slope_degrees"] == pytest.approx(math.degrees(math.atan(0.2)))
    assert out[1]["elevation_mean_3x3_m"] is None and out[1]["elevation_m"] is not None


def test_tiles():
    assert raster.tile_ids(-74.75, 41.58, -73.92, 42.17) == ["n41w075", "n41w074", "n42w075", "n42w074"]
    assert raster.tile_ids(-75.0, 41.0, -74.0, 42.0) == ["n41w075"]
    assert raster.tile_url("n41w075").endswith("/Elevation/1/TIFF/current/n41w075/USGS_1_n41w075.tif")


def test_mosaic_takes_the_first_tile_with_data(spark):
    t = spark.createDataFrame([(0, 0, 0, None), (1, 0, 0, 5.0), (0, 0, 1, 1.0), (1, 0, 1, 2.0)], "tile_order int, row int, col int, v double")
    assert {(r["col"], r["v"]) for r in raster.mosaic(t).collect()} == {(0, 5.0), (1, 1.0)}


def test_declutter(spark):
    df = spark.createDataFrame([("a1", 1, 0.0, "road-a"), ("a2", 2, 10.0, "road-a"), ("a3", 3, 1000.0, "road-a"), ("b1", 4, 2000.0, "road-b")], "candidate_id string, discovery_rank int, x double, road_name string").withColumn("y", F.lit(0.0))
    assert [r["candidate_id"] for r in export.declutter(df, ["discovery_rank"], 10, 50.0, 1).collect()] == ["a1", "b1"]
    assert [r["candidate_id"] for r in export.declutter(df, ["discovery_rank"], 2, 50.0, 0).collect()] == ["a1", "a3"]


def test_demo_area(spark):
    got = demo.queue(spark).collect()
    assert len(got) >= 10 and sorted(r["priority_rank"] for r in got) == list(range(1, len(got) + 1))
    assert any(r["is_culvert"] for r in got) and all(r["elevation_m"] is not None for r in got)


def test_a_group_of_any_size_is_counted_by_runs(spark, monkeypatch):
    """The cap of a road that most rows share, with runs of a few places, equals the walk."""
    from terralane.operators import spatial

    monkeypatch.setattr(spatial, "RUN", 7)
    rng = random.Random(3)
    rows = [(i, rng.randrange(20), rng.uniform(0, 400), rng.uniform(0, 400), rng.choice(["r", "r", "r", "s", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, k int, x double, y double, road string")
    for cap, spacing in ((5, 0.0), (12, 40.0), (0, 40.0)):
        taken = []
        for r in sorted(rows, key=lambda r: (r[1], r[0])):
            if cap and sum(t[4] == r[4] for t in taken) >= cap:
                continue
            if any(math.hypot(t[2] - r[2], t[3] - r[3]) < spacing for t in taken):
                continue
            taken.append(r)
        assert {r["id"] for r in spatial.thin(df, "id", ["k"], spacing, "road", cap).collect()} == {t[0] for t in taken}


def test_segments_go_to_the_cells_near_them(spark):
    """every cell that a segment comes within the margin of, and not the whole box of a slanted one."""
    from terralane.operators.spatial import segment_cells

    rng = random.Random(8)
    rows = [tuple(rng.uniform(-90, 90) for _ in range(4)) for _ in range(20)] + [(5.0, -60.0, 5.0, 70.0), (-60.0, 10.0, 70.0, 10.0), (3.0, 3.0, 3.0, 3.0), (-100.0, -100.0, 100.0, 100.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seg_id int, x1 double, y1 double, x2 double, y2 double")
    for margin in (0.0, 7.0):
        got = [(r["seg_id"], r["gx"], r["gy"]) for r in segment_cells(df, 10.0, margin).collect()]
        assert len(got) == len(set(got))
        for i, (x1, y1, x2, y2) in enumerate(rows):
            mine = {(gx, gy) for j, gx, gy in got if j == i}
            for n in range(201):
                for a in range(8):
                    x, y = x1 + n / 200 * (x2 - x1) + margin * math.cos(a * math.pi / 4), y1 + n / 200 * (y2 - y1) + margin * math.sin(a * math.pi / 4)
                    assert (math.floor(x / 10), math.floor(y / 10)) in mine
        assert sum(i == len(rows) - 1 for i, _, _ in got) < 150  # its box has 441 cells


def test_nearest_segment_equals_all_pairs(spark, cloud):
    rng = random.Random(9)
    rows = [(i, x, y, x + rng.uniform(-80, 80), y + rng.uniform(-80, 80)) for i, (x, y) in enumerate(cloud[40:90])]
    rows += [(100 + r[0], *r[1:]) for r in rows[:10]]  # ties go to the least
    df = spark.createDataFrame(rows, "seg_id long, x1 double, y1 double, x2 double, y2 double")
    got = {r["l_id"]: (r["r_seg_id"], r["d"]) for r in nearest(points(spark, cloud), df, "id", "seg_id", lines=True).collect()}

    def away(p, s):
        dx, dy = s[3] - s[1], s[4] - s[2]
        t = max(0.0, min(1.0, ((p[0] - s[1]) * dx + (p[1] - s[2]) * dy) / (dx * dx + dy * dy)))
        return math.dist(p, (s[1] + t * dx, s[2] + t * dy))

    for i, p in enumerate(cloud):
        d, j = min((round(away(p, s), 9), s[0]) for s in rows)
        assert got[i][0] == j and got[i][1] == pytest.approx(d)


def test_density_pairs_have_a_stage_of_their_own(spark, cloud):
    """a small table is no reason to join in the one task that reads it; sums equal those of all pairs."""
    rng = random.Random(10)
    rows = [(x, y, x + rng.uniform(-80, 80), y + rng.uniform(-80, 80)) for x, y in cloud[:60]]
    df = spark.createDataFrame(rows, "x1 double, y1 double, x2 double, y2 double")
    out = features.line_density(points(spark, cloud), df, "id", [20.0, 90.0], "road")
    assert "SortMergeJoin [gx" in out._jdf.queryExecution().executedPlan().toString()
    got = {r["id"]: r for r in out.collect()}
    assert len(got) == len(cloud)
    pairs = points(spark, cloud).crossJoin(df)
    for r in (20.0, 90.0):
        inside = geometry.length_in_circle(F.col("x"), F.col("y"), r, *[F.col(c) for c in ("x1", "y1", "x2", "y2")])
        for w in pairs.groupBy("id").agg(F.sum(inside).alias("n")).collect():
            assert got[w["id"]][features.density_column("road", r)] == pytest.approx(w["n"] / (math.pi * r * r / 1e6), abs=1e-6)


def test_crossings_count_once_in_their_cell(spark):
    """segments over many cells meet once, with no comparison of all pairs; shared points of several segments once too."""
    rng = random.Random(12)
    ends = [[[(rng.uniform(0, 900), rng.uniform(0, 900)) for _ in range(n)] for n in (2, 2, 2, 4)] for _ in "ab"]
    ends[0] += [[(0, 0), (400, 400), (800, 0)], [(0, 500), (700, 500)]]
    ends[1] += [[(400, 0), (400, 400), (400, 800)], [(300, 500), (900, 500)]]
    (_, rs), (_, ss) = (lines(spark, [("n", p) for p in side]) for side in ends)
    pairs = candidates.segment_pairs(rs, ss, 5.0)
    assert pairs.count() > pairs.select("a_line", "a_seg", "b_line", "b_seg").distinct().count()
    met = candidates.meetings(rs, ss, 5.0).where(F.col("source") == candidates.EXACT)
    got = [(r["road_line"], r["stream_line"], r["x"], r["y"]) for r in met.collect()]
    all_pairs = rs.select("line", *[F.col(c).alias(f"a{c}") for c in ("x1", "y1", "x2", "y2")]).crossJoin(ss.select(F.col("line").alias("s"), *[F.col(c).alias(f"b{c}") for c in ("x1", "y1", "x2", "y2")]))
    c = geometry.crossing(*(tuple(F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")) for p in "ab"))
    want = {(r["line"], r["s"], round(r["c"]["x"], 6), round(r["c"]["y"], 6)) for r in all_pairs.select("line", "s", c.alias("c")).where("c is not null").collect()}
    assert len(got) == len(set(got)) and set(got) == want and (5, 5, 500.0, 500.0) in want
    plan = candidates.segment_pairs(rs, ss, 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "HashAggregate" not in plan


def test_angles_of_straight_lines_need_no_join(spark):
    """crossings of lines of one segment carry their angles and are not written; all angles are those of the chords."""
    rng = random.Random(13)
    ends = [[[(rng.uniform(0, 700), rng.uniform(0, 700)) for _ in range(n)] for n in (2, 2, 2, 2, 3, 5)] for _ in "ab"]
    ends[0] += [[(0, 300.0), (650, 300.0)], [(0, 400), (700, 400.0000001)]]
    ends[1] += [[(650, 300.0), (0, 300.0)], [(0, 400.0000001), (700, 400)]]
    (_, rs), (_, ss) = (lines(spark, [("n", p) for p in side]) for side in ends)
    met = candidates.meetings(rs, ss, 5.0)
    got = candidates.crossing_angles(met, rs, ss).withColumn("n", F.struct("road_line", "stream_line", "x", "y"))
    chords = [candidates.local_direction(got, df, "n", f"{side}_line").withColumnRenamed("angle", side) for df, side in ((rs, "road"), (ss, "stream"))]
    want = {tuple(r["n"]): r["angle"] for r in chords[0].join(chords[1], "n").select("n", geometry.fold_angle(F.col("road"), F.col("stream")).alias("angle")).collect()}
    rows = got.select("n", "angle", "straight").collect()
    assert len(rows) == len(want) and {r["straight"] for r in rows} == {True, False}
    assert all(r["angle"] == pytest.approx(want[tuple(r["n"])], abs=1e-6) for r in rows) and max(want.values()) > 10
    plan = candidates.straight(candidates.dealt(rs, ss, 5.0), candidates.EXACT, 5.0)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "Aggregate" not in plan


def test_candidates_are_thinned_in_shares(spark, monkeypatch):
    """shares of the walk, found one after the other, take and number what the whole walk does."""
    monkeypatch.setattr(candidates, "PLAIN", 0)
    monkeypatch.setattr(candidates, "AROUND", 0.5)
    rng = random.Random(14)
    ends = [[[(rng.uniform(0, 200), rng.uniform(0, 200)) for _ in range(n)] for n in [2] * 30 + [3]] for _ in "ab"]
    (_, rs), (_, ss) = (lines(spark, [("n", p) for p in side]) for side in ends)
    met = sorted((r["road_line"], r["stream_line"], r["x"], r["y"], r["d"]) for r in candidates.meetings(rs, ss, 20.0).collect())
    want, places = set(), []
    for _, n, m in sorted((m[4], n, m) for n, m in enumerate(met, 1)):
        if all(math.hypot(m[2] - x, m[3] - y) >= 25.0 for x, y in places):
            places.append(m[2:4])
            want.add((n, *m))
    got = candidates.thinned(rs, ss, 20.0, 25.0).select("n", "road_line", "stream_line", "x", "y", "d").collect()
    assert len(met) > 200 and len(got) == len(want) and {tuple(r) for r in got} == want
