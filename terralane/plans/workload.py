"""Registered queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bucket, row_mean
from ..functions.ranking import pct_ranks, robust_0_to_1
from ..functions.reports import coordinates, report_date, route_tokens
from ..operators import candidates as cand
from ..operators import discovery, evaluate, export, feedback, labels, metrics, observations, pointqc, raster, scoring, serving
from ..operators import features as feat
from ..operators.spatial import clusters, grid_join, nearest, thin
from .inputs import FEATURES, KNOWN, LINES, OBSERVATIONS, SCORED, SITES, pct_sql, segment_distance_sql, table
from .inputs import features as feature_table
from .inputs import known as known_table
from .inputs import lines as line_table
from .inputs import observations as observation_log
from .inputs import scored as scored_table
from .inputs import sites as site_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def r6(c, name: str | None = None):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6).alias(name) if name else F.round(c.cast("double"), 6)


# --- Ranks and scores ---------------------------------------------------------------------------------------------------


@query(f"WITH {SCORED} SELECT id, round({pct_sql('probability')}, 6) AS pct FROM scored")
def pct_rank_ties(spark, d):
    return pct_ranks(scored_table(spark, d), {"pct": F.col("probability")}).select("id", r6("pct", "pct"))


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.05) AS a, quantile_cont(o_totalprice, 0.95) AS b FROM orders)
SELECT o_orderkey, round(greatest(0.0, least(1.0, (o_totalprice - a) / (b - a))), 6) AS scaled FROM orders, q""")
def robust_scale(spark, d):
    return robust_0_to_1(table(spark, d, "orders"), "o_totalprice", "scaled").select("o_orderkey", r6("scaled", "scaled"))


_COMPONENTS = f"""{FEATURES}, p AS (SELECT *, coalesce({pct_sql('stream_order')}, 0) AS p1, coalesce({pct_sql('stream_density')}, 0) AS p2, coalesce({pct_sql('valley_depth')}, 0) AS p3,
  coalesce({pct_sql('tpi')}, 0) AS p4, coalesce({pct_sql('slope')}, 0) AS p5, coalesce({pct_sql('road_density')}, 0) AS p6 FROM features),
c AS (SELECT *, 0.75 / (1 + road_stream_distance_m / 20.0) + 0.25 * is_exact AS prox, (p1 + p2) / 2 AS drain, (p3 + (1 - p4)) / 2 AS valley,
  coalesce(1 - abs(90 - crossing_angle_degrees) / 90, 0) AS cross_, p5 AS terrain, p6 AS road, CASE WHEN tagged THEN 1.0 ELSE 0.0 END AS tag, CASE WHEN bridge THEN 1.0 ELSE 0.0 END AS pen FROM p),
s AS (SELECT *, CASE WHEN source = 'route_interval_sample' THEN (valley + terrain + drain) / 3 ELSE 0 END AS dem FROM c),
t AS (SELECT *, CASE WHEN is_culvert OR denied THEN 0.0 ELSE greatest(0.0, least(100.0, 100 * (0.16 * coalesce(prox, 0) + 0.16 * drain + 0.15 * valley + 0.05 * cross_ + 0.12 * terrain + 0.05 * road + 0.18 * dem + 0.04 * tag) / 0.91 - 20 * pen)) END AS score FROM s)"""


def _scored_sites(spark: SparkSession, d: str) -> DataFrame:
    return scoring.score_candidates(feature_table(spark, d))


@query(f"""WITH {_COMPONENTS} SELECT candidate_id, round(score, 6) AS score, round(dem, 6) AS dem_route, round(valley, 6) AS valley, round(drain, 6) AS drainage FROM t""")
def evidence_score(spark, d):
    s = _scored_sites(spark, d)
    return s.select("candidate_id", r6("culvert_likelihood_score", "score"), r6("dem_route_drainage_score", "dem_route"), r6("valley_position_score", "valley"), r6("drainage_strength_score", "drainage"))


@query(f"""WITH {_COMPONENTS} SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN score <= 35 THEN 'low' WHEN score <= 55 THEN 'medium' WHEN score <= 75 THEN 'high' ELSE 'very_high' END AS bucket FROM t) GROUP BY bucket""")
def priority_buckets(spark, d):
    return _scored_sites(spark, d).groupBy(F.col("priority_bucket").alias("bucket")).agg(F.count("*").alias("n"))


@query(f"""WITH {_COMPONENTS} SELECT candidate_id, row_number() OVER (ORDER BY round(score, 9) DESC, candidate_id) AS rank FROM t""")
def evidence_queue(spark, d):
    return _scored_sites(spark, d).select("candidate_id", F.col("priority_rank").cast("long").alias("rank"))


@query("""SELECT c_custkey, round(greatest(0.0, least(1.0, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / nullif(CAST(a IS NOT NULL AS INT) + CAST(b IS NOT NULL AS INT) + CAST(c IS NOT NULL AS INT), 0))), 6) AS mean_score
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 != 0 THEN (c_custkey % 10) / 10.0 END AS a, CASE WHEN c_custkey % 5 != 0 THEN (c_custkey % 7) / 7.0 END AS b, CASE WHEN c_custkey % 2 != 0 OR c_custkey % 3 = 0 THEN (c_custkey % 4) / 4.0 END AS c FROM customer)""")
def weighted_mean_missing(spark, d):
    k = F.col("c_custkey")
    pieces = [F.when(k % 3 != 0, k % 10 / F.lit(10.0)), F.when(k % 5 != 0, k % 7 / F.lit(7.0)), F.when((k % 2 != 0) | (k % 3 == 0), k % 4 / F.lit(4.0))]
    t = table(spark, d, "customer")
    n = sum((F.when(p.isNotNull(), 1).otherwise(0) for p in pieces), F.lit(0))
    return t.select("c_custkey", F.when(n > 0, r6(row_mean(pieces))).alias("mean_score"))


@query(f"""WITH {FEATURES}, b AS (SELECT candidate_id, row, CAST(row*37%10001 AS DOUBLE)/100 AS ev, is_culvert, denied, CASE WHEN row % 7 != 0 THEN (row*613%1000)/1000.0 END AS p FROM features),
m AS (SELECT *, ev/100 AS e, coalesce({pct_sql('p')}, 0) AS m FROM b),
s AS (SELECT *, CASE WHEN denied THEN 'field_denied' WHEN is_culvert THEN 'known_field_match' ELSE 'undiscovered_candidate' END AS discovery_status,
  CASE WHEN denied OR is_culvert THEN 0 ELSE 100 * (0.55 * sqrt(e*m) + 0.25*e + 0.2*(0.4*e + 0.6*m)) END AS score FROM m)
SELECT candidate_id, discovery_status, round(score, 6) AS discovery_score, CASE WHEN score <= 35 THEN 'low' WHEN score <= 55 THEN 'medium' WHEN score <= 75 THEN 'high' ELSE 'very_high' END AS priority_bucket,
  round(CASE WHEN denied THEN 0 ELSE 100*m END, 6) AS model_rank_score FROM s""")
def discovery_rank(spark, d):
    f = feature_table(spark, d).withColumn("culvert_likelihood_score", (F.col("row") * 37 % 10001).cast("double") / 100)
    p = f.where("row % 7 != 0").select("candidate_id", (F.col("row") * 613 % 1000 / F.lit(1000.0)).alias("culvert_probability"))
    out = discovery.discovery_ranking(f, p)
    return out.select("candidate_id", "discovery_status", r6("discovery_score", "discovery_score"), "priority_bucket", r6("model_rank_score", "model_rank_score"))


@query(f"""WITH {FEATURES}, b AS (SELECT row, candidate_id, CAST(row % 50 AS DOUBLE) AS score, is_culvert AND NOT denied AS known, denied FROM features)
SELECT candidate_id, row_number() OVER (ORDER BY CASE WHEN known THEN 1 ELSE 0 END, CASE WHEN denied OR known THEN 0 ELSE 0.45*score END DESC, score DESC, candidate_id) AS discovery_rank FROM b""")
def discovery_order(spark, d):
    f = feature_table(spark, d).withColumn("culvert_likelihood_score", (F.col("row") % 50).cast("double"))
    return discovery.discovery_ranking(f).select("candidate_id", "discovery_rank")


@query("""SELECT o_custkey AS candidate_id, CAST(min_by(o_totalprice, o_orderkey) AS DOUBLE) AS culvert_probability FROM orders GROUP BY 1""")
def attach_probability(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("candidate_id"), "o_orderkey", F.col("o_totalprice").alias("culvert_probability"))
    return discovery.attach_probability(o.select("candidate_id").distinct(), o, "o_orderkey")


@query(f"""WITH {FEATURES} SELECT candidate_id, CASE WHEN denied THEN 'field_denied' WHEN is_culvert OR road_stream_distance_m <= 10 THEN 'known_field_match' ELSE 'undiscovered_candidate' END AS status FROM features""")
def known_denied_status(spark, d):
    f = feature_table(spark, d).withColumn("dist_to_known_culvert_m", F.col("road_stream_distance_m"))
    denied, known = discovery.masks(f, 10.0)
    return f.select("candidate_id", F.when(denied, "field_denied").when(known, "known_field_match").otherwise("undiscovered_candidate").alias("status"))


# --- Metrics ------------------------------------------------------------------------------------------------------------

_THRESHOLDS = f"""{SCORED}, t AS (SELECT probability AS threshold, count(*) AS n, sum(target) AS hits FROM scored GROUP BY 1),
u AS (SELECT *, sum(n) OVER (ORDER BY threshold DESC) AS predicted, sum(hits) OVER (ORDER BY threshold DESC) AS tp FROM t)"""


@query(f"""WITH {_THRESHOLDS}, z AS (SELECT sum(hits) AS pos, sum(n) AS total FROM t) SELECT round(sum(hits * tp / predicted) / any_value(pos), 6) AS average_precision,
round(sum((n - hits) * (tp - hits / 2.0)) / (any_value(pos) * (any_value(total) - any_value(pos))), 6) AS roc_auc,
(SELECT round(avg((probability - target) * (probability - target)), 6) FROM scored) AS brier_score, (SELECT round(avg(CASE WHEN (probability >= 0.5) = (target = 1) THEN 1.0 ELSE 0.0 END), 6) FROM scored) AS accuracy FROM u, z""")
def average_precision(spark, d):
    return metrics.binary_metrics(scored_table(spark, d)).select(*[r6(c, c) for c in ("average_precision", "roc_auc", "brier_score", "accuracy")])


@query(f"""WITH {_THRESHOLDS}, z AS (SELECT sum(hits) AS pos FROM t), m AS (SELECT threshold, CAST(predicted AS BIGINT) AS predicted_positive_count, CAST(tp AS BIGINT) AS hits, tp/predicted AS precision, tp/pos AS recall FROM u, z)
SELECT precision >= 0.5 AS meets_precision_floor, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, predicted_positive_count, hits FROM m
ORDER BY (precision >= 0.5) DESC, CASE WHEN precision >= 0.5 THEN recall ELSE precision END DESC, CASE WHEN precision >= 0.5 THEN predicted_positive_count ELSE recall END DESC LIMIT 1""")
def precision_floor(spark, d):
    out = metrics.precision_floor(scored_table(spark, d), floor=0.5)
    return out.select("meets_precision_floor", "threshold", r6("precision", "precision"), r6("recall", "recall"), "predicted_positive_count", "hits")


@query(f"""WITH {SCORED}, r AS (SELECT target, row_number() OVER (ORDER BY probability DESC, id) AS r FROM scored), k AS (SELECT unnest([5, 10, 25]) AS k)
SELECT CAST(k AS BIGINT) AS k, CAST(sum(target) FILTER (r <= k) AS BIGINT) AS hits, round(sum(target) FILTER (r <= k) / k, 6) AS precision_at_k, round((sum(target) FILTER (r <= k)) / sum(target), 6) AS recall_at_k FROM r, k GROUP BY k""")
def top_k_metrics(spark, d):
    return metrics.top_k(scored_table(spark, d)).select("k", "hits", r6("precision_at_k", "precision_at_k"), r6("recall_at_k", "recall_at_k"))


# --- Spatial joins ------------------------------------------------------------------------------------------------------


@query(f"""WITH {SITES}, {KNOWN} SELECT s.candidate_id, k.culvert_id, round(sqrt((s.x-k.x)*(s.x-k.x)+(s.y-k.y)*(s.y-k.y)), 6) AS d FROM sites s, known k WHERE sqrt((s.x-k.x)*(s.x-k.x)+(s.y-k.y)*(s.y-k.y)) <= 250""")
def distance_join(spark, d):
    return grid_join(site_table(spark, d), known_table(spark, d), 250.0).select(F.col("l_candidate_id").alias("candidate_id"), F.col("r_culvert_id").alias("culvert_id"), r6("d", "d"))


@query(f"""WITH {SITES}, {KNOWN} SELECT s.candidate_id, arg_min(k.culvert_id, [sqrt((s.x-k.x)*(s.x-k.x)+(s.y-k.y)*(s.y-k.y)), k.known_row]) AS culvert_id, round(min(sqrt((s.x-k.x)*(s.x-k.x)+(s.y-k.y)*(s.y-k.y))), 6) AS d FROM sites s, known k GROUP BY 1""")
def nearest_known(spark, d):
    n = nearest(site_table(spark, d), known_table(spark, d), "row", "known_row")
    return n.select(F.col("l_candidate_id").alias("candidate_id"), F.col("r_culvert_id").alias("culvert_id"), r6("d", "d"))


@query(f"""WITH {SITES}, {LINES} SELECT s.candidate_id, round(min({segment_distance_sql('s.x', 's.y')}), 6) AS d FROM sites s, roads GROUP BY 1""")
def nearest_road(spark, d):
    n = nearest(site_table(spark, d), line_table(spark, d, 0), "row", "seg_id", lines=True)
    return n.select(F.col("l_candidate_id").alias("candidate_id"), r6("d", "d"))


@query(f"""WITH {SITES}, {KNOWN}, p AS (SELECT k.known_row, s.row, sqrt((s.x-k.x)*(s.x-k.x)+(s.y-k.y)*(s.y-k.y)) AS d, CASE WHEN s.row % 4 = 0 THEN 0 WHEN s.row % 4 = 1 THEN 1 ELSE 5 END AS prio FROM sites s, known k),
b AS (SELECT known_row, row, row_number() OVER (PARTITION BY known_row ORDER BY d, prio, row) AS n FROM p WHERE d <= 250)
SELECT candidate_id, CASE WHEN row IN (SELECT row FROM b WHERE n = 1) THEN 1 ELSE 0 END AS is_culvert FROM sites""")
def best_match_label(spark, d):
    k = F.col("row") % 4
    s = site_table(spark, d).withColumn("source", F.when(k == 0, "field_report_observed_culvert").when(k == 1, "exact_road_stream_intersection").otherwise("other"))
    return labels.label_known(s, known_table(spark, d), 250.0).select("candidate_id", "is_culvert")


@query(f"""WITH {SITES}, {KNOWN}, n AS (SELECT s.row, arg_min(k.known_row, [round(sqrt((s.x-k.x)*(s.x-k.x)+(s.y-k.y)*(s.y-k.y)), 9), k.known_row]) AS known_row FROM sites s, known k GROUP BY 1)
SELECT candidate_id, culvert_id AS nearest_id, 'R' || (n.known_row % 7) AS nearest_route, '' AS nearest_file FROM sites JOIN n ON sites.row = n.row JOIN known USING (known_row)""")
def label_metadata(spark, d):
    known = known_table(spark, d).withColumn("route", F.concat(F.lit("R"), (F.col("known_row") % 7).cast("string")))
    out = labels.label_known(site_table(spark, d), known, 60.0)
    return out.select("candidate_id", F.col("nearest_field_report_culvert_id").alias("nearest_id"), F.col("nearest_field_report_route").alias("nearest_route"), F.col("nearest_field_report_source_file").alias("nearest_file"))


_NEGATIVES = "negatives AS (SELECT known_row AS negative_row, x, y, CASE WHEN known_row % 5 = 0 THEN printf('cand_%06d', known_row % 37) ELSE '' END AS cid, CASE WHEN known_row % 10 = 0 THEN CAST(known_row AS DOUBLE) END AS miss, CASE WHEN known_row % 3 = 0 THEN 'missed_prediction' ELSE 'no_culvert' END AS label, 'obs-' || known_row AS oid FROM known)"


@query(f"""WITH {SITES}, {KNOWN}, {_NEGATIVES}, near AS (SELECT s.row, arg_min(n.negative_row, [sqrt((s.x-n.x)*(s.x-n.x)+(s.y-n.y)*(s.y-n.y)), n.negative_row]) AS nr, min(sqrt((s.x-n.x)*(s.x-n.x)+(s.y-n.y)*(s.y-n.y))) AS d FROM sites s, negatives n GROUP BY 1),
e AS (SELECT cid, max(negative_row) AS nr FROM negatives WHERE cid != '' GROUP BY 1),
j AS (SELECT s.candidate_id, near.d, en.negative_row AS exact, en.miss, en.oid AS eoid, nn.oid AS noid, nn.label FROM sites s JOIN near USING (row) JOIN negatives nn ON nn.negative_row = near.nr LEFT JOIN e ON e.cid = s.candidate_id LEFT JOIN negatives en ON en.negative_row = e.nr)
SELECT candidate_id, CASE WHEN exact IS NOT NULL OR (d <= 500 AND label != 'missed_prediction') THEN 1 ELSE 0 END AS field_denied, round(coalesce(miss, d), 6) AS distance,
CASE WHEN exact IS NOT NULL THEN eoid WHEN d <= 500 AND label != 'missed_prediction' THEN noid ELSE '' END AS observation_id FROM j""")
def negative_labels(spark, d):
    k = F.col("known_row")
    n = known_table(spark, d).select(k.alias("negative_row"), "x", "y", F.when(k % 5 == 0, F.format_string("cand_%06d", k % 37)).otherwise("").alias("candidate_id"), F.when(k % 10 == 0, k.cast("double")).alias("miss_distance_m"), F.when(k % 3 == 0, "missed_prediction").otherwise("no_culvert").alias("label"), F.concat(F.lit("obs-"), k.cast("string")).alias("observation_id"))
    out = labels.label_denied(site_table(spark, d), n, 500.0)
    return out.select("candidate_id", "field_denied", r6("dist_to_denied_culvert_m", "distance"), F.col("nearest_denied_observation_id").alias("observation_id"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 10 = 0 THEN 16.0 WHEN c_custkey % 5 = 0 THEN 12.0 WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 24.0 WHEN c_custkey % 3 = 0 THEN 6.0 ELSE 0.25 END AS weight FROM customer""")
def sample_weights(spark, d):
    k = F.col("c_custkey")
    t = table(spark, d, "customer").withColumns({"is_culvert": (k % 3 == 0).cast("int"), "field_denied": (k % 5 == 0).cast("int"), "nearest_field_report_source_file": F.when(k % 2 == 0, "data/Field_Observations.geojson").otherwise("r.pdf"), "nearest_denied_notes": F.when(k % 10 == 0, "Confirmed culvert was 20.0 m").otherwise("")})
    return labels.sample_weights(t).select("c_custkey", F.col("training_sample_weight").alias("weight"))


_CHORD = """greatest(0.0, CASE WHEN disc <= 0 OR a = 0 THEN 0.0 ELSE (greatest(0.0, least(1.0, (-b + sqrt(greatest(disc, 0.0))) / (2*a))) - greatest(0.0, least(1.0, (-b - sqrt(greatest(disc, 0.0))) / (2*a)))) * sqrt(a) END)"""


def _density_sql(r: float) -> str:
    return f"""SELECT candidate_id, round(coalesce(sum({_CHORD}), 0) / {math.pi * r * r / 1e6!r}, 4) AS density FROM (SELECT *, b*b - 4*a*c AS disc FROM (SELECT s.candidate_id, (x2-x1)*(x2-x1)+(y2-y1)*(y2-y1) AS a,
 2*((x1-s.x)*(x2-x1)+(y1-s.y)*(y2-y1)) AS b, (x1-s.x)*(x1-s.x)+(y1-s.y)*(y1-s.y)-{r * r} AS c FROM sites s, roads)) GROUP BY 1"""


@query(f"WITH {SITES}, {LINES} {_density_sql(250.0)}")
def line_density(spark, d):
    s = site_table(spark, d)
    out = feat.line_density(s, line_table(spark, d, 0), "row", [100.0, 250.0], "road")
    return s.select("row", "candidate_id").join(out, "row").select("candidate_id", F.round("road_density_250m_m_per_sqkm", 4).alias("density"))


_CROSS = f"""{LINES}, pairs AS (SELECT r.line AS road, s.line AS stream, r.x1, r.y1, r.x2-r.x1 AS rx, r.y2-r.y1 AS ry, s.x2-s.x1 AS sx, s.y2-s.y1 AS sy, s.x1-r.x1 AS qx, s.y1-r.y1 AS qy FROM roads r, streams s
 WHERE least(r.x1, r.x2) <= greatest(s.x1, s.x2) AND least(s.x1, s.x2) <= greatest(r.x1, r.x2) AND least(r.y1, r.y2) <= greatest(s.y1, s.y2) AND least(s.y1, s.y2) <= greatest(r.y1, r.y2)),
 dets AS (SELECT *, rx*sy-ry*sx AS det FROM pairs), tu AS (SELECT *, (qx*sy-qy*sx)/det AS t, (qx*ry-qy*rx)/det AS u FROM dets WHERE det != 0), hits AS (SELECT * FROM tu WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1)"""


@query(f"WITH {_CROSS} SELECT road, stream, round(x1 + t*rx, 3) AS x, round(y1 + t*ry, 3) AS y FROM hits")
def segment_crossings(spark, d):
    m = cand.meetings(line_table(spark, d, 0), line_table(spark, d, 1), 5.0)
    return m.where(F.col("source") == cand.EXACT).select(F.col("road_line").alias("road"), F.col("stream_line").alias("stream"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"WITH {_CROSS}, g AS (SELECT road, stream, abs((degrees(atan2(ry, rx)) + 360) % 180 - (degrees(atan2(sy, sx)) + 360) % 180) AS dif FROM hits) SELECT road, stream, round(least(dif % 180, 180 - dif % 180), 4) AS angle FROM g")
def crossing_angle(spark, d):
    roads, streams = (line_table(spark, d, i) for i in (0, 1))
    met = cand.crossing_angles(cand.meetings(roads, streams, 0.0).where(F.col("source") == cand.EXACT), roads, streams)
    return met.select(F.col("road_line").alias("road"), F.col("stream_line").alias("stream"), F.round("angle", 4).alias("angle"))


def _end_sql(px: str, py: str, x1: str, y1: str, x2: str, y2: str) -> tuple[str, str, str]:
    """Distance of a point to a segment, and the place on it."""
    t = f"greatest(0.0, least(1.0, (({px}-{x1})*({x2}-{x1})+({py}-{y1})*({y2}-{y1})) / nullif(({x2}-{x1})*({x2}-{x1})+({y2}-{y1})*({y2}-{y1}), 0)))"
    x, y = f"({x1}+coalesce({t}, 0)*({x2}-{x1}))", f"({y1}+coalesce({t}, 0)*({y2}-{y1}))"
    return f"sqrt(power({px}-{x}, 2)+power({py}-{y}, 2))", x, y


def _approach_sql() -> str:
    """The least of four distances between ends and segments, as [distance, which, x, y] on the road."""
    road, stream = tuple(f"r.{c}" for c in ("x1", "y1", "x2", "y2")), tuple(f"s.{c}" for c in ("x1", "y1", "x2", "y2"))
    ends = [(_end_sql(*road[:2], *stream)[0], *road[:2]), (_end_sql(*road[2:], *stream)[0], *road[2:]), _end_sql(*stream[:2], *road), _end_sql(*stream[2:], *road)]
    return "list_sort([" + ", ".join(f"[{d}, {i}, {x}, {y}]" for i, (d, x, y) in enumerate(ends)) + "])[1]"


@query(f"""WITH RECURSIVE {_CROSS}, crossed AS (SELECT road, stream, round(x1 + t*rx, 6) AS x, round(y1 + t*ry, 6) AS y, CAST(0 AS DOUBLE) AS d, 'exact_road_stream_intersection' AS source FROM hits),
close_ AS (SELECT r.line AS road, s.line AS stream, {_approach_sql()} AS a FROM roads r, streams s WHERE least(r.x1, r.x2) - 20 <= greatest(s.x1, s.x2) AND least(s.x1, s.x2) <= greatest(r.x1, r.x2) + 20
 AND least(r.y1, r.y2) - 20 <= greatest(s.y1, s.y2) AND least(s.y1, s.y2) <= greatest(r.y1, r.y2) + 20 AND (r.line, s.line) NOT IN (SELECT (road, stream) FROM crossed)),
met AS (SELECT * FROM crossed UNION ALL SELECT road, stream, a[3], a[4], a[1], 'nearest_road_stream_approach' FROM close_ WHERE a[1] <= 20),
numbered AS (SELECT *, row_number() OVER (ORDER BY road, stream, x, y) AS n FROM met), o AS (SELECT *, row_number() OVER (ORDER BY d, n) AS k FROM numbered),
w(k, taken, xs, ys) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS DOUBLE[]), CAST([] AS DOUBLE[]) UNION ALL
 SELECT k, CASE WHEN free THEN list_append(taken, n) ELSE taken END, CASE WHEN free THEN list_append(xs, x) ELSE xs END, CASE WHEN free THEN list_append(ys, y) ELSE ys END
 FROM (SELECT o.k, o.n, o.x, o.y, w.taken, w.xs, w.ys, len(list_filter(list_zip(w.xs, w.ys), lambda p: sqrt((p[1]-o.x)*(p[1]-o.x)+(p[2]-o.y)*(p[2]-o.y)) < 25)) = 0 AS free FROM w JOIN o ON o.k = w.k + 1)),
kept AS (SELECT unnest(taken) AS n FROM w WHERE k = (SELECT max(k) FROM o)),
g AS (SELECT m.*, abs((degrees(atan2(r.y2-r.y1, r.x2-r.x1)) + 360) % 180 - (degrees(atan2(s.y2-s.y1, s.x2-s.x1)) + 360) % 180) AS dif FROM numbered m JOIN kept USING (n) JOIN roads r ON r.line = m.road JOIN streams s ON s.line = m.stream)
SELECT printf('cand_%06d', n) AS candidate_id, CAST(road AS VARCHAR) AS road_id, CAST(stream AS VARCHAR) AS stream_id, source, round(x, 6) AS x, round(y, 6) AS y, round(d, 6) AS d, round(least(dif % 180, 180 - dif % 180), 4) AS angle FROM g""")
def candidate_generation(spark, d):
    roads, streams = (line_table(spark, d, i) for i in (0, 1))
    out = cand.generate(roads, streams, cand.road_attributes(roads), cand.stream_attributes(streams))
    return out.select("candidate_id", "road_id", "stream_id", "source", r6("x", "x"), r6("y", "y"), r6("road_stream_distance_m", "d"), F.round("crossing_angle_degrees", 4).alias("angle"))


@query(f"""WITH {LINES}, l AS (SELECT line, x1, y1, x2, y2, sqrt((x2-x1)*(x2-x1)+(y2-y1)*(y2-y1)) AS len FROM roads), n AS (SELECT *, greatest(CAST(ceil((len - 37.5)/75) AS BIGINT), 0) AS n FROM l WHERE len > 0),
m AS (SELECT *, unnest(CASE WHEN n > 0 THEN list_transform(range(0, n), lambda i: i*75 + 37.5) ELSE [len/2] END) AS m FROM n), o AS (SELECT *, unnest(CAST([0.0, -8.0, 8.0] AS DOUBLE[])) AS off FROM m)
SELECT line, round(m, 4) AS m, off, round(x1 + m/len*(x2-x1) - off * (CASE WHEN y2-y1 > 0 OR (y2 = y1 AND x2 < x1) THEN 1 ELSE CASE WHEN y2 = y1 THEN 1 ELSE -1 END END) * (y2-y1)/len, 3) AS x FROM o""")
def route_sampling(spark, d):
    return _samples(line_table(spark, d, 0))


def _samples(roads: DataFrame) -> DataFrame:
    attrs = roads.select("line", F.concat(F.lit("State Rte "), F.col("line").cast("string")).alias("name"))
    out = cand.route_samples(roads, attrs, interval=75.0, numbered=True, lateral=(0.0, -8.0, 8.0))
    return out.select(F.col("road_id").cast("long").alias("line"), F.round("route_sample_distance_m", 4).alias("m"), F.col("route_lateral_offset_m").alias("off"), F.round("x", 3).alias("x"))


@query(f"""WITH {SITES}, {KNOWN} SELECT printf('cand_%06d', row_number() OVER (ORDER BY layer, n)) AS candidate_id, x, y, culvert_id FROM (SELECT 0 AS layer, row AS n, x, y, NULL AS culvert_id FROM sites UNION ALL SELECT 1, known_row, x, y, culvert_id FROM known)""")
def candidate_union(spark, d):
    a = site_table(spark, d).select(F.col("row").alias("n"), "candidate_id", "x", "y")
    b = known_table(spark, d).select(F.col("known_row").alias("n"), "x", "y", "culvert_id")
    return cand.union([a, b]).select("candidate_id", "x", "y", "culvert_id")


@query(f"""WITH {SITES}, {KNOWN} SELECT candidate_id FROM (SELECT CASE WHEN row % 100 = 7 THEN printf('field_%06d', row) ELSE candidate_id END AS candidate_id FROM sites)
UNION ALL SELECT printf('field_%06d', (SELECT max(row) FROM sites WHERE row % 100 = 7) + row_number() OVER (ORDER BY known_row)) FROM known""")
def field_id_continue(spark, d):
    s = site_table(spark, d).withColumn("candidate_id", F.when(F.col("row") % 100 == 7, F.format_string("field_%06d", F.col("row"))).otherwise(F.col("candidate_id"))).select("candidate_id", "x", "y")
    return cand.append_field(s, known_table(spark, d).select(F.col("known_row").alias("point_row"), "x", "y")).select("candidate_id")


@query(f"WITH {SITES} SELECT CAST(floor(x/2500) AS BIGINT) || '_' || CAST(floor(y/2500) AS BIGINT) AS spatial_block_id, count(*) AS n FROM sites GROUP BY 1")
def spatial_blocks(spark, d):
    from ..operators.models import spatial_block

    return site_table(spark, d).groupBy(spatial_block(F.col("x"), F.col("y")).alias("spatial_block_id")).agg(F.count("*").alias("n"))


@query(f"""WITH {SITES}, {KNOWN}, h AS (SELECT row, x, y FROM sites WHERE (row*613%1000)/1000.0 >= 0.7), p AS (SELECT h.row, k.known_row FROM h, known k WHERE sqrt((h.x-k.x)*(h.x-k.x)+(h.y-k.y)*(h.y-k.y)) <= 400)
SELECT (SELECT count(*) FROM h) AS high_priority_predictions, (SELECT count(*) FROM known) AS known_culverts, round((SELECT count(DISTINCT row) FROM p) / (SELECT count(*) FROM h), 6) AS precision, round((SELECT count(DISTINCT known_row) FROM p) / (SELECT count(*) FROM known), 6) AS recall""")
def threshold_eval_semi(spark, d):
    s = site_table(spark, d).withColumn("culvert_probability", F.col("row") * 613 % 1000 / F.lit(1000.0))
    out = evaluate.threshold_evaluation(s, known_table(spark, d), 0.7, 400.0)
    return out.select("high_priority_predictions", "known_culverts", r6("precision_at_threshold", "precision"), r6("known_culvert_recall_at_threshold", "recall"))


@query(f"""WITH {SITES}, {KNOWN}, n AS (SELECT k.known_row, min(sqrt((s.x-k.x)*(s.x-k.x)+(s.y-k.y)*(s.y-k.y))) AS d FROM sites s, known k WHERE s.row % 9 != 0 GROUP BY 1)
SELECT count(*) AS actual_culverts, CAST(sum(CASE WHEN d <= 150 THEN 1 ELSE 0 END) AS BIGINT) AS hits_within_distance, round(avg(CASE WHEN d <= 150 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(d), 6) AS mean_nearest_distance_m FROM n""")
def success_rate(spark, d):
    s = site_table(spark, d).withColumn("discovery_status", F.when(F.col("row") % 9 == 0, "known_field_match"))
    out = evaluate.success_summary(evaluate.success(s, known_table(spark, d).withColumnRenamed("known_row", "actual_row"), 150.0))
    return out.select("actual_culverts", "hits_within_distance", r6("success_rate", "success_rate"), r6("mean_nearest_distance_m", "mean_nearest_distance_m"))


@query(f"""WITH RECURSIVE {SITES}, o AS (SELECT row, x, y, row_number() OVER (ORDER BY c_nationkey, row) AS k FROM sites),
w(k, taken, xs, ys) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS DOUBLE[]), CAST([] AS DOUBLE[]) UNION ALL
 SELECT k, CASE WHEN free THEN list_append(taken, row) ELSE taken END, CASE WHEN free THEN list_append(xs, x) ELSE xs END, CASE WHEN free THEN list_append(ys, y) ELSE ys END
 FROM (SELECT o.k, o.row, o.x, o.y, w.taken, w.xs, w.ys, len(list_filter(list_zip(w.xs, w.ys), lambda p: sqrt((p[1]-o.x)*(p[1]-o.x)+(p[2]-o.y)*(p[2]-o.y)) < 120)) = 0 AS free FROM w JOIN o ON o.k = w.k + 1))
SELECT row, candidate_id, x, y FROM sites WHERE row IN (SELECT unnest(taken) FROM w WHERE k = (SELECT max(k) FROM o))""")
def greedy_thin(spark, d):
    return thin(site_table(spark, d), "row", ["c_nationkey"], 120.0).select("row", "candidate_id", "x", "y")


@query(f"""WITH RECURSIVE {SITES}, o AS (SELECT row, x, y, 'NY-' || (row % 40) AS road, row_number() OVER (ORDER BY c_nationkey, row) AS k FROM sites),
w(k, taken, xs, ys, roads) AS (SELECT CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS DOUBLE[]), CAST([] AS DOUBLE[]), CAST([] AS VARCHAR[]) UNION ALL
 SELECT k, CASE WHEN free THEN list_append(taken, row) ELSE taken END, CASE WHEN free THEN list_append(xs, x) ELSE xs END, CASE WHEN free THEN list_append(ys, y) ELSE ys END, CASE WHEN free THEN list_append(roads, road) ELSE roads END
 FROM (SELECT o.k, o.row, o.x, o.y, o.road, w.taken, w.xs, w.ys, w.roads, len(list_filter(w.roads, lambda r: r = o.road)) < 250 AND len(list_filter(list_zip(w.xs, w.ys), lambda p: sqrt((p[1]-o.x)*(p[1]-o.x)+(p[2]-o.y)*(p[2]-o.y)) < 100)) = 0 AS free FROM w JOIN o ON o.k = w.k + 1)),
t AS (SELECT unnest(taken) AS row FROM w WHERE k = (SELECT max(k) FROM o))
SELECT row, candidate_id, 'NY-' || (row % 40) AS road_name FROM sites JOIN t USING (row) ORDER BY c_nationkey, row LIMIT 2000""")
def declutter_fold(spark, d):
    s = site_table(spark, d).join(feature_table(spark, d).select("row", "road_name"), "row")
    return export.declutter(s, ["c_nationkey"], limit=2000, spacing=100.0, row="row").select("row", "candidate_id", "road_name")


@query(f"""WITH RECURSIVE {SITES}, e AS (SELECT a.row AS a, b.row AS b FROM sites a, sites b WHERE a.row != b.row AND sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 120),
r AS (SELECT a AS row, a AS reach FROM e UNION SELECT r.row, e.b FROM r JOIN e ON r.reach = e.a), c AS (SELECT row, min(reach) AS root FROM r GROUP BY 1)
SELECT sites.row, candidate_id, CASE WHEN root IS NULL THEN -1 ELSE CAST(dense_rank() OVER (ORDER BY root NULLS LAST) - 1 AS INT) END AS cluster_id FROM sites LEFT JOIN c ON sites.row = c.row""")
def cluster_points(spark, d):
    return clusters(site_table(spark, d), "row", 120.0).select("row", "candidate_id", "cluster_id")


@query(f"""WITH {SITES} SELECT candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY floor(x/500), floor(y/500) ORDER BY c_nationkey, row) AS n FROM sites) WHERE n = 1 OR row % 50 = 0""")
def cell_declutter(spark, d):
    return export.cell_declutter(site_table(spark, d), 500.0, [F.col("c_nationkey"), F.col("row")], F.col("row") % 50 == 0).select("candidate_id")


# --- Export -------------------------------------------------------------------------------------------------------------


@query(f"""WITH {FEATURES} SELECT candidate_id FROM features WHERE NOT (is_culvert OR denied) AND (road_stream_distance_m IS NULL OR road_stream_distance_m > 15) AND source != 'field_report_observed_culvert'""")
def web_pool_filter(spark, d):
    f = feature_table(spark, d).withColumns({"discovery_status": F.when(F.col("is_culvert") == 1, "known_field_match").when(F.col("field_denied") == 1, "field_denied"), "dist_to_known_culvert_m": F.col("road_stream_distance_m"), "is_known_field_match": F.col("is_culvert")})
    return export.pool(f).select("candidate_id")


@query(f"""WITH {FEATURES}, t AS (SELECT *, CAST(row*37%10001 AS DOUBLE)/100 AS s FROM features), b AS (SELECT *, CASE WHEN s <= 35 THEN 'low' WHEN s <= 55 THEN 'medium' WHEN s <= 75 THEN 'high' ELSE 'very_high' END AS bk FROM t)
SELECT count(*) AS rows, CAST(sum(CAST(is_culvert AS INT)) AS BIGINT) AS known_field_matches, round(max(s) FILTER (NOT is_culvert), 6) AS max_score, round(avg(s) FILTER (NOT is_culvert), 6) AS mean_score,
count(*) FILTER (bk = 'low') AS low, count(*) FILTER (bk = 'very_high') AS very_high, round(min(longitude), 6) AS min_longitude, round(max(latitude), 6) AS max_latitude FROM b""")
def export_summary(spark, d):
    f = feature_table(spark, d).withColumn("discovery_score", (F.col("row") * 37 % 10001).cast("double") / 100)
    f = f.withColumns({"priority_bucket": bucket(F.col("discovery_score")), "is_known_field_match": F.col("is_culvert"), "discovery_status": F.when(F.col("is_culvert") == 1, "known_field_match").otherwise("undiscovered_candidate")})
    s = export.summary(f)
    return s.select("rows", "known_field_matches", r6("max_score", "max_score"), r6("mean_score", "mean_score"), F.col("priority_buckets")["low"].alias("low"), F.col("priority_buckets")["very_high"].alias("very_high"), r6("min_longitude", "min_longitude"), r6("max_latitude", "max_latitude"))


@query(f"""WITH {FEATURES}, b AS (SELECT *, CAST(row*37%10001 AS DOUBLE)/100 AS s FROM features), c AS (SELECT *, CASE WHEN s <= 35 THEN 'low' WHEN s <= 55 THEN 'medium' WHEN s <= 75 THEN 'high' ELSE 'very_high' END AS bk FROM b)
SELECT candidate_id FROM c WHERE NOT is_culvert AND s >= 40 AND bk IN ('high', 'very_high') AND (contains('route ' || (row % 40), 'route 1') OR row % 40 = 1)""")
def ui_filter_search(spark, d):
    f = feature_table(spark, d).withColumn("discovery_score", (F.col("row") * 37 % 10001).cast("double") / 100)
    shown = serving.normalized(f.withColumn("priority_bucket", bucket(F.col("discovery_score"))).select("candidate_id", "discovery_score", "priority_bucket", "is_culvert", "road_name"))
    return serving.filtered(shown, "NY 1", 40.0, ("high", "very_high")).select("candidate_id")


@query(f"""WITH {FEATURES}, a AS (SELECT candidate_id, 1 AS v FROM features), b AS (SELECT candidate_id, 2 AS v FROM features WHERE is_culvert OR denied) SELECT candidate_id, max(v) AS v FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1""")
def union_by_id(spark, d):
    f = feature_table(spark, d)
    told = f.where("is_culvert = 1 OR field_denied = 1")  # what crews said stands over the base layer
    return serving.union_by_id(f.select("candidate_id", F.lit(1).alias("v")), told.select("candidate_id", F.lit(2).alias("v")))


@query(f"""WITH {FEATURES}, m AS (SELECT candidate_id, row, 2*6371008.8*atan2(sqrt(a), sqrt(1-a)) AS d FROM (SELECT candidate_id, row, power(sin(radians(latitude-41.9)/2),2)+cos(radians(41.9))*cos(radians(latitude))*power(sin(radians(longitude+74.0)/2),2) AS a FROM features))
SELECT candidate_id, round(d, 3) AS d FROM m ORDER BY round(d, 6), row LIMIT 250""")
def list_order(spark, d):
    f = feature_table(spark, d).withColumn("rank", F.col("row"))
    return serving.listed(f, 41.9, -74.0).select("candidate_id", F.round("distance_to_user_m", 3).alias("d"))


@query(f"""WITH {OBSERVATIONS} SELECT count(*) AS observations, count(*) FILTER (status = 'confirmed_culvert') AS confirmed_culverts, count(*) FILTER (status = 'no_culvert') AS denied_culverts, count(*) FILTER (status NOT IN ('confirmed_culvert', 'no_culvert')) AS uncertain FROM observations""")
def status_counts(spark, d):
    return serving.status_counts(observation_log(spark, d))


@query(f"""WITH {FEATURES} SELECT candidate_id FROM (SELECT *, row_number() OVER (PARTITION BY is_culvert, floor(x/66), floor(y/66) ORDER BY row*37%10001, row) AS n FROM features) WHERE n = 1 OR is_culvert""")
def canvas_declutter(spark, d):
    f = feature_table(spark, d).withColumns({"rank": F.col("row") * 37 % 10001, "score": F.lit(0.0), "px": F.col("x"), "py": F.col("y")})
    return serving.on_canvas(f, 14, F.col("is_culvert") == 1).select("candidate_id")


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'route ' || (s_suppkey % 90) || 'w' WHEN 1 THEN 'county road ' || (s_suppkey % 90) ELSE 'mill ln 5' END AS search_text FROM supplier""")
def search_text(spark, d):
    k = F.col("s_suppkey")
    n = (k % 90).cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("US-"), n, F.lit("W"))).when(k % 3 == 1, F.concat(F.lit("Co Rd  "), n)).otherwise("Mill Ln. #5")
    return table(spark, d, "supplier").select("s_suppkey", serving.search_text(name).alias("search_text"))


# --- Text ---------------------------------------------------------------------------------------------------------------


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN (s_suppkey % 90) || 'W' WHEN 1 THEN (s_suppkey % 90) || 'A' WHEN 2 THEN CAST(s_suppkey % 90 AS VARCHAR) ELSE '' END AS tokens FROM supplier""")
def route_tokens_from_names(spark, d):
    k = F.col("s_suppkey")
    n = (k % 90).cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("US Hwy "), n, F.lit("w"))).when(k % 4 == 1, F.concat(F.lit("State Rte "), n, F.lit("A"))).when(k % 4 == 2, F.concat(F.lit("R-8 NY-"), n)).otherwise("Local Rd")
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(route_tokens(name), ",").alias("tokens"))




@query("""SELECT s_suppkey, round(CASE WHEN s_suppkey % 3 = 0 THEN 41 + (s_suppkey % 1000) / 1000.0 ELSE 42 + (s_suppkey % 1000) / 4000.0 END, 6) AS latitude,
round(CASE WHEN s_suppkey % 3 = 0 THEN -74 - (s_suppkey % 1000) / 2000.0 ELSE -74 - (s_suppkey % 1000) / 2000.0 END, 6) AS longitude FROM supplier WHERE s_suppkey % 3 != 2""")
def coord_extract(spark, d):
    k = F.col("s_suppkey") % 1000
    a = F.format_string("8 NY %d %.6f N %.6f W", F.col("s_suppkey") % 90 + 1, 41 + k / 1000.0, 74 + k / 2000.0)
    b = F.format_string("%.6f, %.6f", -74 - k / 2000.0, 42 + k / 4000.0)
    line = F.when(F.col("s_suppkey") % 3 == 0, a).when(F.col("s_suppkey") % 3 == 1, b).otherwise("no place 12.5 13.5")
    return table(spark, d, "supplier").select("s_suppkey", F.explode(coordinates(line)).alias("m")).select("s_suppkey", r6("m.latitude", "latitude"), r6("m.longitude", "longitude"))


@query("""WITH l AS (SELECT c_nationkey AS file, c_custkey AS n, CASE WHEN c_custkey % 6 = 0 THEN 'SC' || c_custkey END AS id FROM customer), q AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY n) AS r FROM l)
SELECT n, coalesce(last_value(id IGNORE NULLS) OVER (PARTITION BY file ORDER BY r ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), '') AS culvert_id FROM q""")
def carry_forward_id(spark, d):
    from ..functions.reports import records

    k = F.col("c_custkey")
    line = F.concat(F.when(k % 6 == 0, F.concat(F.lit("SC "), k.cast("string"), F.lit("  "))).otherwise("site "), F.lit(" 42.050000 N 73.900000 W"))
    t = table(spark, d, "customer").select(F.concat(F.lit("f"), F.col("c_nationkey").cast("string")).alias("source_file"), k.alias("line_no"), line.alias("line"))
    return records(t).select(F.col("line_no").alias("n"), "culvert_id")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 2 THEN '' ELSE strftime(make_date(2020 + CAST(s_suppkey % 7 AS INT), 1 + CAST(s_suppkey % 12 AS INT), 1 + CAST(s_suppkey % 28 AS INT)), '%Y-%m-%d') END AS report_date FROM supplier""")
def report_date_parse(spark, d):
    from ..functions.reports import MONTHS

    k = F.col("s_suppkey")
    month, day, year = 1 + k % 12, 1 + k % 28, 2020 + k % 7
    a = F.format_string("NY %d.%d.%d report.pdf", month, day, year % 100)
    b = F.concat(F.lit("report "), day.cast("string"), F.lit("th "), F.initcap(F.get(F.array(*map(F.lit, MONTHS)), (k % 12).cast("int"))), F.lit(", "), year.cast("string"), F.lit(".docx"))
    return table(spark, d, "supplier").select("s_suppkey", report_date(F.when(k % 3 == 0, a).when(k % 3 == 1, b).otherwise("x 13.45.20.pdf")).alias("report_date"))


@query("""WITH t AS (SELECT c_custkey, round(42 + c_nationkey / 100.0, 6) AS lat, round(-74 - c_nationkey / 100.0, 6) AS lon, CASE WHEN c_custkey % 4 = 0 THEN 'SC' || c_custkey ELSE '' END AS id, CASE WHEN c_custkey % 3 = 0 THEN 'NY' || (c_custkey % 9) ELSE '' END AS route, 'f' || (c_custkey % 2) AS f, repeat('x', CAST(c_custkey % 5 AS INT)) AS ctx FROM customer),
r AS (SELECT *, row_number() OVER (PARTITION BY lat, lon ORDER BY (id = ''), (route = ''), length(ctx) DESC, f, id, route, c_custkey) AS n FROM t)
SELECT lat AS latitude, lon AS longitude, count(*) AS n, max(CASE WHEN n = 1 THEN length(ctx) END) AS context_length FROM r GROUP BY 1, 2""")
def report_dedup(spark, d):
    from ..functions.reports import merge_records

    k = F.col("c_custkey")
    t = table(spark, d, "customer").select(
        F.concat(F.lit("f"), (k % 2).cast("string")).alias("source_file"), F.lit("").alias("report_date"), F.lit("").alias("nysdot_region"), F.when(k % 3 == 0, F.concat(F.lit("NY"), (k % 9).cast("string"))).otherwise("").alias("route"),
        F.round(42 + F.col("c_nationkey") / 100.0, 6).alias("latitude"), F.round(-74 - F.col("c_nationkey") / 100.0, 6).alias("longitude"), F.lit("raw").alias("raw_coordinate_text"), F.when(k % 4 == 0, F.concat(F.lit("SC"), k.cast("string"))).otherwise("").alias("culvert_id"),
        F.repeat(F.lit("x"), (k % 5).cast("int")).alias("context_text"), F.lit("l").alias("label"), F.lit(0.85).alias("label_confidence"),
    )
    counts = t.groupBy("latitude", "longitude").agg(F.count("*").alias("n"))
    return merge_records(t).select("latitude", "longitude", F.length("context_text").cast("long").alias("context_length")).join(counts, ["latitude", "longitude"]).select("latitude", "longitude", "n", "context_length")


# --- Point quality ------------------------------------------------------------------------------------------------------


@query(f"""WITH {SITES}, {KNOWN}, {LINES}, c AS (SELECT k.known_row, min(sqrt((s.x-k.x)*(s.x-k.x)+(s.y-k.y)*(s.y-k.y))) AS cd FROM known k, sites s GROUP BY 1),
r AS (SELECT k.known_row, min({segment_distance_sql('k.x', 'k.y')}) AS rd FROM known k, roads GROUP BY 1), w AS (SELECT k.known_row, min({segment_distance_sql('k.x', 'k.y')}) AS sd FROM known k, streams GROUP BY 1)
SELECT known_row, CASE WHEN known_row % 10 = 0 THEN 'outside_current_analysis_extent' WHEN cd <= 75 THEN 'matched_existing_candidate' WHEN rd <= 50 AND sd <= 100 THEN 'road_stream_context_no_candidate_match' WHEN rd > 250 THEN 'far_from_current_road_layer' ELSE 'needs_manual_review' END AS analysis_flag,
cd <= 10 AS matched_existing_candidate FROM c JOIN r USING (known_row) JOIN w USING (known_row)""")
def analysis_flags(spark, d):
    points = known_table(spark, d).withColumn("inside_analysis_extent", F.col("known_row") % 10 != 0)
    out = pointqc.analyze(points, "known_row", line_table(spark, d, 0), line_table(spark, d, 1), site_table(spark, d), match_radius_m=10.0)
    return out.select("known_row", "analysis_flag", "matched_existing_candidate")


@query("""SELECT round(min(o_totalprice), 6) AS min, round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(avg(o_totalprice), 4) AS mean, round(quantile_cont(o_totalprice, 0.9), 6) AS p90, round(max(o_totalprice), 6) AS max FROM orders""")
def distance_stats(spark, d):
    s = pointqc.distance_stats(table(spark, d, "orders"), "o_totalprice")
    return s.select(r6("min", "min"), r6("median", "median"), F.round("mean", 4).alias("mean"), r6("p90", "p90"), r6("max", "max"))


# --- Observations and feedback ------------------------------------------------------------------------------------------


@query(f"""WITH {OBSERVATIONS}, v AS (SELECT *, CASE WHEN status IN ('confirmed_culvert', 'no_culvert', 'uncertain') THEN status ELSE 'uncertain' END AS st FROM observations WHERE latitude BETWEEN -90 AND 90)
SELECT observation_id, arg_max(st, arrival) AS status, max(arrival) AS arrival FROM v GROUP BY 1""")
def observation_upsert(spark, d):
    log = observations.validated(observation_log(spark, d)).select("observation_id", "status", "arrival")
    return observations.upsert(log.withColumn("at", F.col("arrival")), "at").select("observation_id", "status", "arrival")


@query(f"""WITH {OBSERVATIONS} SELECT observation_id, max(arrival) AS arrival FROM observations GROUP BY 1 HAVING arg_max(arrival % 9 = 0, arrival) = false""")
def observation_delete(spark, d):
    log = observation_log(spark, d).select("observation_id", "arrival", (F.col("arrival") % 9 == 0).alias("deleted"))
    return observations.upsert(log.withColumn("at", F.col("arrival")), "at", "deleted").select("observation_id", "arrival")


_DEDUPED = f"""{OBSERVATIONS}, d AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN field_culvert_id != '' THEN 'field:' || field_culvert_id ELSE printf('point:%.6f:%.6f', x, y) END ORDER BY arrival) AS n FROM observations WHERE status = 'confirmed_culvert'), o AS (SELECT * FROM d WHERE n = 1)"""


@query(f"""WITH {_DEDUPED} SELECT arrival, nearest_candidate_id AS candidate_id, nearest_candidate_distance_m AS miss_distance_m, CASE WHEN notes = '' THEN '' ELSE notes || '; ' END || printf('confirmed culvert was %.1f m from this prediction', nearest_candidate_distance_m) AS notes FROM o WHERE starts_with(nearest_candidate_id, 'cand_') AND nearest_candidate_distance_m > 10""")
def missed_predictions(spark, d):
    return observations.missed_predictions(observation_log(spark, d), 10.0, "arrival").select("arrival", "candidate_id", "miss_distance_m", "notes")


@query(f"""WITH {_DEDUPED} SELECT arrival, CASE WHEN field_culvert_id != '' THEN field_culvert_id WHEN candidate_id != '' THEN candidate_id ELSE observation_id END AS culvert_id, substr(observed_at, 1, 10) AS report_date, road_name AS route FROM o""")
def confirmed_sites(spark, d):
    return observations.confirmed_sites(observation_log(spark, d), "arrival").select("arrival", "culvert_id", "report_date", "route")


@query(f"""WITH {OBSERVATIONS} SELECT substr(sha256(string_agg(r, '|' ORDER BY r)), 1, 24) AS fingerprint FROM (SELECT observation_id || ':' || status || ':' || observed_at || ':' || field_culvert_id || ':' || candidate_id || '::' AS r FROM observations)""")
def set_fingerprint(spark, d):
    return observations.fingerprint(observation_log(spark, d).drop("longitude", "latitude"))


@query(f"""WITH {FEATURES}, o AS (SELECT row AS k, longitude + 0.00003 AS lo, latitude - 0.00002 AS la FROM features WHERE row % 20 = 0), p AS (SELECT o.k, f.row, f.candidate_id, 2*6371000.0*atan2(sqrt(a), sqrt(1-a)) AS m FROM (SELECT o.k, f.row, f.candidate_id, power(sin(radians(f.latitude-o.la)/2),2)+cos(radians(o.la))*cos(radians(f.latitude))*power(sin(radians(f.longitude-o.lo)/2),2) AS a FROM o, features f) f JOIN o USING (k))
SELECT 'o' || k AS observation_id, arg_min(candidate_id, [round(m, 6), row]) AS candidate_id, round(min(m), 4) AS d FROM p WHERE m <= 10 GROUP BY k""")
def haversine_nearest(spark, d):
    f = feature_table(spark, d).select("candidate_id", F.col("row").alias("rank"), "longitude", "latitude")
    o = f.where("rank % 20 = 0").select(F.concat(F.lit("o"), F.col("rank").cast("string")).alias("observation_id"), (F.col("longitude") + 0.00003).alias("longitude"), (F.col("latitude") - 0.00002).alias("latitude"))
    return feedback.nearest_by_haversine(o, f).select("observation_id", "candidate_id", F.round("d", 4).alias("d"))


@query(f"""WITH {FEATURES}, s AS (SELECT *, CAST(row*37%10001 AS DOUBLE)/100 AS score, CASE WHEN row % 31 = 0 THEN 'no_culvert' WHEN row % 31 = 1 THEN 'confirmed_culvert' END AS st FROM features),
a AS (SELECT candidate_id, row, CASE WHEN st = 'no_culvert' THEN 0.0 WHEN st = 'confirmed_culvert' THEN greatest(score, 98.0) ELSE score END AS score, CASE WHEN st = 'no_culvert' THEN 2 WHEN st = 'confirmed_culvert' THEN 1 ELSE 0 END AS grp FROM s)
SELECT candidate_id, round(score, 6) AS discovery_score, row_number() OVER (ORDER BY grp, score DESC, row) AS discovery_rank FROM a""")
def feedback_rerank(spark, d):
    f = feature_table(spark, d)
    base = f.select("candidate_id", F.col("row").alias("rank"), (F.col("row") * 37 % 10001 / F.lit(100.0)).alias("discovery_score"), F.lit("undiscovered_candidate").alias("discovery_status"), F.lit(0).alias("is_known_field_match"), F.lit("").alias("evidence_summary"), "longitude", "latitude")
    k = F.col("row") % 31
    obs = f.where(k < 2).select(F.concat(F.lit("o"), F.col("row").cast("string")).alias("observation_id"), F.lit("2024-01-01").alias("observed_at"), F.when(k == 0, "no_culvert").otherwise("confirmed_culvert").alias("status"), "candidate_id", F.lit("").alias("field_culvert_id"), F.lit("").alias("missed_candidate_id"), F.lit("").alias("nearest_candidate_id"), F.lit(None).cast("double").alias("missed_candidate_distance_m"), F.lit(None).cast("double").alias("nearest_candidate_distance_m"), "longitude", "latitude")
    return feedback.apply(base, obs).select("candidate_id", r6("discovery_score", "discovery_score"), "discovery_rank")


@query(f"""WITH {FEATURES}, s AS (SELECT *, CAST(row*37%10001 AS DOUBLE)/100 AS score FROM features),
-- Confirmed sites: of rows 5 of 31 far from the row they name as missed, of 6 of 31 at the row itself, without its name, of 7 of 31 far from all.
a AS (SELECT candidate_id, row, row % 31 = 5 AS missed, row % 31 = 6 AS near FROM s),
b AS (SELECT s.candidate_id, CASE WHEN near THEN greatest(score, 98.0) WHEN missed THEN least(score, 15.0) ELSE score END AS score, CASE WHEN near THEN 1 ELSE 0 END AS known, CASE WHEN near THEN 'confirmed_field_observation' WHEN missed THEN 'field_missed_prediction' ELSE 'undiscovered_candidate' END AS status, s.row AS rank
 FROM s JOIN a USING (candidate_id)
 UNION ALL SELECT 'new' || row, 100.0, 1, 'confirmed_field_observation', 0 FROM s WHERE row % 31 = 7 UNION ALL SELECT 'o' || row, 100.0, 1, 'confirmed_field_observation', 0 FROM s WHERE row % 31 = 5)
SELECT candidate_id, round(score, 6) AS discovery_score, status AS discovery_status, row_number() OVER (ORDER BY known, score DESC, rank, candidate_id) AS discovery_rank FROM b""")
def feedback_missed_and_new(spark, d):
    # Places apart from each other: a feature per cell of 0.01 degrees in an order of its own.
    place = {"longitude": F.lit(-74.0) + F.col("row") % 1000 / 100.0, "latitude": F.lit(30.0) + F.floor(F.col("row") / 1000) / 100.0}
    f = feature_table(spark, d).withColumns(place)
    base = f.select("candidate_id", F.col("row").alias("rank"), (F.col("row") * 37 % 10001 / F.lit(100.0)).alias("discovery_score"), F.lit("undiscovered_candidate").alias("discovery_status"), F.lit(0).alias("is_known_field_match"), F.lit("").alias("evidence_summary"), "longitude", "latitude")
    k = F.col("row") % 31
    name = F.concat(F.lit("o"), F.col("row").cast("string"))
    obs = f.where(k.isin(5, 6, 7)).select(
        name.alias("observation_id"), F.lit("2024-01-01").alias("observed_at"), F.lit("confirmed_culvert").alias("status"), F.lit("").alias("candidate_id"), F.when(k == 7, F.concat(F.lit("new"), F.col("row").cast("string"))).otherwise("").alias("field_culvert_id"),
        F.when(k == 5, F.col("candidate_id")).otherwise("").alias("missed_candidate_id"), F.lit("").alias("nearest_candidate_id"), F.when(k == 5, 40.0).alias("missed_candidate_distance_m"), F.lit(None).cast("double").alias("nearest_candidate_distance_m"),
        "longitude", (F.col("latitude") + F.when(k == 6, 0.00003).otherwise(0.004)).alias("latitude"),
    )
    return feedback.apply(base, obs).select("candidate_id", r6("discovery_score", "discovery_score"), "discovery_status", "discovery_rank")


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, CAST(event_id % 3 AS VARCHAR) AS fp, row_number() OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id % 3 AS VARCHAR)) AS k FROM events),
r AS (SELECT user_id, k, t AS asked, fp AS held, 'queued' AS status FROM e WHERE k = 1 UNION ALL
 SELECT e.user_id, e.k, CASE WHEN e.fp != r.held AND e.t - r.asked >= 900000000 THEN e.t ELSE r.asked END, CASE WHEN e.fp != r.held AND e.t - r.asked >= 900000000 THEN e.fp ELSE r.held END,
 CASE WHEN e.fp = r.held THEN 'unchanged' WHEN e.t - r.asked < 900000000 THEN 'debounced' ELSE 'queued' END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT CAST(user_id AS VARCHAR) AS region, count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'debounced') AS debounced FROM r GROUP BY 1""")
def quiet_period_runs(spark, d):
    from ..streaming.feedback import retrain_log

    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("region"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 3).cast("string").alias("fingerprint"))
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return retrain_log(e).groupBy("region").agg(count("queued"), count("unchanged"), count("debounced"))


# --- Rasters ------------------------------------------------------------------------------------------------------------


def _cells(spark: SparkSession, d: str, hole: int = 211) -> tuple[DataFrame, raster.Grid]:
    """A 100 x 100 raster of 100 m cells over the sites, with every ``hole``-th cell of a slanted count missing."""
    cells = spark.range(10_000).select((F.col("id") / 100).cast("int").alias("row"), (F.col("id") % 100).cast("int").alias("col"))
    v = F.when((F.col("row") * 7 + F.col("col")) % hole != 0, (F.col("row") * F.col("row") * 3 + F.col("col") * 17) % 101).cast("double")
    return cells.withColumn("v", v), raster.Grid(0.0, 10010.0, 100.1, 100.1, 100, 100)


def _raster_sql(hole: int) -> str:
    return f"""{SITES}, cells AS (SELECT r.range AS row, c.range AS col, CASE WHEN (r.range*7 + c.range) % {hole} != 0 THEN CAST((r.range*r.range*3 + c.range*17) % 101 AS DOUBLE) END AS v FROM range(100) r, range(100) c),
spots AS (SELECT candidate_id, row AS site, CAST(floor((10010.0 - y)/100.1) AS INT) AS r, CAST(floor(x/100.1) AS INT) AS c FROM sites)"""


def _window_sql(n: int) -> str:
    """w<n>: the statistics of each site's window of n x n cells, null unless it is whole."""
    h = n // 2
    return f"""w{n} AS (SELECT site, CASE WHEN n = {n * n} THEN m END AS mean, CASE WHEN n = {n * n} THEN relief END AS relief, CASE WHEN n = {n * n} THEN s END AS rough, CASE WHEN n = {n * n} THEN mid - m END AS tpi, CASE WHEN n = {n * n} THEN greatest(0.0, m - mid) END AS valley,
 CASE WHEN n = {n * n} THEN degrees(atan(sqrt(power((down - up) / 200.2, 2) + power((rite - lft) / 200.2, 2)))) END AS slope FROM (SELECT site, count(v) AS n, avg(v) AS m, max(v) - min(v) AS relief, stddev_pop(v) AS s, max(v) FILTER (row = r AND col = c) AS mid,
 max(v) FILTER (row = r + 1 AND col = c) AS down, max(v) FILTER (row = r - 1 AND col = c) AS up, max(v) FILTER (row = r AND col = c + 1) AS rite, max(v) FILTER (row = r AND col = c - 1) AS lft
 FROM spots LEFT JOIN cells ON row BETWEEN r-{h} AND r+{h} AND col BETWEEN c-{h} AND c+{h} GROUP BY 1))"""


_RASTER, _WHOLE = _raster_sql(211), _raster_sql(5003)
_STATS = ("mean", "relief", "rough", "tpi", "valley")


@query(f"WITH {_RASTER}, {_window_sql(3)} SELECT candidate_id, round(mean, 6) AS mean, round(relief, 6) AS relief, round(rough, 6) AS roughness, round(tpi, 6) AS tpi, round(valley, 6) AS valley, round(slope, 6) AS slope FROM spots JOIN w3 USING (site)")
def raster_window_stats(spark, d):
    cells, grid = _cells(spark, d)
    out = raster.window_stats(site_table(spark, d), cells, grid, "row")
    return out.select("candidate_id", r6("elevation_mean_3x3_m", "mean"), r6("elevation_relief_3x3_m", "relief"), r6("terrain_roughness_3x3_m", "roughness"), r6("topographic_position_3x3_m", "tpi"), r6("valley_depth_3x3_m", "valley"), r6("slope_degrees", "slope"))


@query(f"""WITH {_WHOLE}, {", ".join(map(_window_sql, (9, 15, 31)))} SELECT candidate_id, {", ".join(f"round(w{n}.{c}, 6) AS {c}{n}" for n in (9, 15, 31) for c in _STATS)} FROM spots JOIN w9 USING (site) JOIN w15 USING (site) JOIN w31 USING (site)""")
def raster_wide_windows(spark, d):
    cells, grid = _cells(spark, d, 5003)
    out = raster.window_stats(site_table(spark, d), cells, grid, "row")
    return out.select("candidate_id", *[r6(f"{kind}_{n}x{n}_m", f"{c}{n}") for n in (9, 15, 31) for c, kind in zip(_STATS, ("elevation_mean", "elevation_relief", "terrain_roughness", "topographic_position", "valley_depth"), strict=True)])


@query(f"""WITH {_WHOLE}, {_window_sql(3)}, {_window_sql(9)}, t AS (SELECT candidate_id, w3.slope, w9.* FROM spots JOIN w3 USING (site) JOIN w9 USING (site)),
q AS (SELECT quantile_cont(valley, 0.05) AS a, quantile_cont(valley, 0.95) AS b FROM t)
SELECT candidate_id, round(CASE WHEN relief > 0 THEN valley / relief END, 6) AS ratio, round(ln(1 + valley) / (1 + slope), 6) AS wetness, round(coalesce(least(greatest((valley - a) / (b - a), 0.0), 1.0), 0.0) / (1 + slope), 6) AS low_slope,
round(ln(1 + relief) * ln(1 + rough), 6) AS terrain_break, round(CASE WHEN tpi IS NOT NULL THEN greatest(-tpi, 0.0) END, 6) AS negative_tpi FROM t, q""")
def hydrology_proxies(spark, d):
    cells, grid = _cells(spark, d, 5003)
    out = feat.hydrology_proxies(raster.window_stats(site_table(spark, d), cells, grid, "row", (3, 9)))
    return out.select("candidate_id", r6("valley_depth_relief_ratio_9x9", "ratio"), r6("topographic_wetness_proxy_9x9", "wetness"), r6("low_slope_valley_score_9x9", "low_slope"), r6("terrain_break_score_proxy_9x9", "terrain_break"), r6("negative_tpi_9x9_m", "negative_tpi"))


@query(f"WITH {_RASTER} SELECT candidate_id, v AS elevation_m FROM spots LEFT JOIN cells ON row = r AND col = c")
def raster_sample(spark, d):
    cells, grid = _cells(spark, d)
    return raster.sample(site_table(spark, d), cells, grid, "elevation_m").select("candidate_id", "elevation_m")


@query("""SELECT 'n' || printf('%02d', la.range) || 'w' || printf('%03d', 75 - (lo.range)) AS tile FROM range(41, 43) la, range(0, 2) lo""")
def dem_tiles(spark, d):
    return spark.createDataFrame([(t,) for t in raster.tile_ids(-74.75, 41.58, -73.92, 42.17)], "tile string")


@query("""SELECT CAST(c_custkey % 3 = 0 AS INT) AS target, count(*) AS n, round((SELECT count(*) FROM customer) / (2.0 * count(*)), 6) AS class_weight FROM customer GROUP BY 1""")
def class_weights(spark, d):
    from ..operators.models import class_weight_table

    t = table(spark, d, "customer").select((F.col("c_custkey") % 3 == 0).cast("int").alias("target"))
    return class_weight_table(t, "target").select("target", "n", r6("class_weight", "class_weight"))


@query()
def model_predictions(spark, d):
    from ..operators.models import fit_and_predict

    f = feature_table(spark, d).withColumn("is_culvert", (F.col("row") * 7 % 101 + F.col("row") * 13 % 91 < 40).cast("int"))
    return fit_and_predict(f, ["road_stream_distance_m", "crossing_angle_degrees", "valley_depth_9x9_m"], family="logistic").select("candidate_id", r6("culvert_probability", "culvert_probability"), "priority_rank")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hundred sites to look at first."""
    s = _scored_sites(spark, sf_dir)
    return s.where("priority_rank <= 100").select("priority_rank", "candidate_id", "culvert_likelihood_score", "priority_bucket", "evidence_summary")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


