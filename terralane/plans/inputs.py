"""Sites, lines, observations and report lines derived from the driver's tables, in DataFrames and in SQL alike.

Coordinates come from whole-number arithmetic, so both give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mix(k: Column, a: int, b: int, m: int) -> Column:
    return (k * k * a + k * b) % m / F.lit(2.0)


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from customer: row, candidate_id, x, y."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("row"), F.format_string("cand_%06d", k).alias("candidate_id"), _mix(k, 37, 7919, 20011).alias("x"), _mix(k, 101, 104729, 20021).alias("y"), "c_nationkey", "c_acctbal", "c_mktsegment")


SITES = """sites AS (SELECT c_custkey AS row, printf('cand_%06d', c_custkey) AS candidate_id, ((c_custkey*c_custkey*37+c_custkey*7919)%20011)/2.0 AS x,
  ((c_custkey*c_custkey*101+c_custkey*104729)%20021)/2.0 AS y, c_nationkey, c_acctbal, c_mktsegment FROM customer)"""


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known sites from supplier: known_row, culvert_id, x, y."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("known_row"), F.format_string("K%05d", k).alias("culvert_id"), _mix(k, 43, 6007, 20011).alias("x"), _mix(k, 97, 15013, 20021).alias("y"))


KNOWN = """known AS (SELECT s_suppkey AS known_row, printf('K%05d', s_suppkey) AS culvert_id, ((s_suppkey*s_suppkey*43+s_suppkey*6007)%20011)/2.0 AS x,
  ((s_suppkey*s_suppkey*97+s_suppkey*15013)%20021)/2.0 AS y FROM supplier)"""


def lines(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    """One-segment lines from part, roads for even keys and streams for odd ones: line, seg_id, part, seg, x1..y2, m0, length, name."""
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").where(k % 2 == odd).select(k.alias("line"), k.alias("seg_id"), F.lit(0).alias("part"), F.lit(0).alias("seg"), _mix(k, 53, 4201, 20011).alias("x1"), _mix(k, 89, 9973, 20021).alias("y1"), "p_name", "p_brand", "p_size")
    t = t.withColumns({"x2": F.col("x1") + (F.col("line") * 31 % 801) - 400, "y2": F.col("y1") + (F.col("line") * 57 % 801) - 400})
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return t.withColumns({"m0": F.lit(0.0), "length": F.sqrt(dx * dx + dy * dy), "name": F.col("p_name")})


LINES = """part_lines AS (SELECT p_partkey AS line, ((p_partkey*p_partkey*53+p_partkey*4201)%20011)/2.0 AS x1, ((p_partkey*p_partkey*89+p_partkey*9973)%20021)/2.0 AS y1, p_name AS name, p_brand, p_size FROM part),
all_lines AS (SELECT *, x1 + (line*31%801) - 400 AS x2, y1 + (line*57%801) - 400 AS y2 FROM part_lines),
roads AS (SELECT * FROM all_lines WHERE line % 2 = 0), streams AS (SELECT * FROM all_lines WHERE line % 2 = 1)"""

#: Squared distance to a segment, as SQL over px, py, x1, y1, x2, y2.
SEGMENT_DISTANCE = """sqrt(power({px} - (x1 + {t} * (x2 - x1)), 2) + power({py} - (y1 + {t} * (y2 - y1)), 2))"""
PROJECT = "greatest(0.0, least(1.0, (({px} - x1) * (x2 - x1) + ({py} - y1) * (y2 - y1)) / nullif((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1), 0)))"


def segment_distance_sql(px: str, py: str) -> str:
    t = PROJECT.format(px=px, py=py)
    return SEGMENT_DISTANCE.format(px=px, py=py, t=t)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary targets with tied probabilities from orders: id, target, probability."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.when(k * 7919 % 11 < 2 + (k * 613 % 1000) / 200, 1).otherwise(0).alias("target"), (k * 613 % 1000 / F.lit(1000.0)).alias("probability"))


SCORED = """scored AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey*7919%11 < 2 + (o_orderkey*613%1000)/200.0 THEN 1 ELSE 0 END AS target, (o_orderkey*613%1000)/1000.0 AS probability FROM orders)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature table over the candidate sites, with nulls and ties on purpose."""
    k = F.col("row")
    mod = lambda a, m: (k * a % m).cast("double")
    return sites(spark, sf_dir).select(
        "row", "candidate_id", "x", "y",
        F.when(k % 13 != 0, mod(7, 101)).alias("road_stream_distance_m"),
        F.when(k * 7 % 101 == 0, 1).otherwise(0).alias("is_exact_road_stream_intersection"),
        F.when(k % 17 != 0, mod(13, 91)).alias("crossing_angle_degrees"),
        F.when(k % 5 == 0, "route_interval_sample").otherwise("exact_road_stream_intersection").alias("source"),
        (k % 6).alias("stream_order"),
        F.when(k % 11 != 0, mod(31, 997)).alias("stream_density_250m_m_per_sqkm"),
        F.when(k % 19 != 0, mod(17, 53) / 10).alias("valley_depth_9x9_m"),
        (mod(23, 61) - 30).alias("topographic_position_9x9_m"),
        F.col("c_acctbal").alias("slope_degrees"),
        mod(29, 1009).alias("road_density_250m_m_per_sqkm"),
        F.when(k % 23 == 0, "culvert").otherwise("no").alias("stream_tunnel"),
        F.when(k % 29 == 0, "yes").otherwise("").alias("road_bridge"),
        (k % 37 == 0).cast("int").alias("is_culvert"),
        (k % 41 == 0).cast("int").alias("field_denied"),
        (F.lit(-74.2) + k % 1000 / F.lit(2000.0)).alias("longitude"), (F.lit(41.6) + k % 700 / F.lit(1400.0)).alias("latitude"),
        F.concat(F.lit("NY-"), (k % 40).cast("string")).alias("road_name"),
    )


FEATURES = f"""{SITES}, features AS (SELECT row, candidate_id, x, y, CASE WHEN row % 13 != 0 THEN CAST(row*7%101 AS DOUBLE) END AS road_stream_distance_m,
  CASE WHEN row*7%101 = 0 THEN 1 ELSE 0 END AS is_exact, CASE WHEN row % 17 != 0 THEN CAST(row*13%91 AS DOUBLE) END AS crossing_angle_degrees,
  CASE WHEN row % 5 = 0 THEN 'route_interval_sample' ELSE 'exact_road_stream_intersection' END AS source, CAST(row % 6 AS DOUBLE) AS stream_order,
  CASE WHEN row % 11 != 0 THEN CAST(row*31%997 AS DOUBLE) END AS stream_density, CASE WHEN row % 19 != 0 THEN CAST(row*17%53 AS DOUBLE)/10 END AS valley_depth,
  CAST(row*23%61 AS DOUBLE) - 30 AS tpi, c_acctbal AS slope, CAST(row*29%1009 AS DOUBLE) AS road_density, row % 23 = 0 AS tagged, row % 29 = 0 AS bridge,
  row % 37 = 0 AS is_culvert, row % 41 = 0 AS denied, -74.2 + (row % 1000)/2000.0 AS longitude, 41.6 + (row % 700)/1400.0 AS latitude, 'NY-' || (row % 40) AS road_name FROM sites)"""


def pct_sql(v: str) -> str:
    """Average-rank percentile of a column as a window expression; null for null."""
    return f"CASE WHEN {v} IS NOT NULL THEN (rank() OVER (ORDER BY {v} NULLS LAST) + (count(*) OVER (PARTITION BY {v}) - 1) / 2.0) / count({v}) OVER () END"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An observation log from events: one id per user and day of month, in order of arrival."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "confirmed_culvert").when(F.col("event_type") == "error", "no_culvert").otherwise("maybe")
    u = F.col("user_id")
    return e.select(
        F.col("event_id").alias("arrival"), F.format_string("obs-%d-%d", u, F.col("event_id") % 5).alias("observation_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("observed_at"), status.alias("status"),
        F.when(u % 3 != 0, F.format_string("cand_%06d", u)).otherwise("").alias("candidate_id"), F.when(F.col("event_id") % 7 == 0, F.format_string("FC-%d", u)).otherwise("").alias("field_culvert_id"),
        F.when(F.col("event_id") % 4 == 0, F.format_string("cand_%06d", u + 1)).when(F.col("event_id") % 4 == 1, "route_1").otherwise("").alias("nearest_candidate_id"), (F.col("event_id") % 40).cast("double").alias("nearest_candidate_distance_m"),
        F.when(F.col("event_id") % 2 == 0, "wet").otherwise("").alias("notes"), F.concat(F.lit("Rt "), (u % 50).cast("string")).alias("road_name"),
        (F.lit(-74.2) + u % 100 / F.lit(200.0)).alias("longitude"), F.when(F.col("event_id") % 97 != 0, F.lit(41.6) + u % 70 / F.lit(140.0)).otherwise(F.lit(95.0)).alias("latitude"),
        (u % 100).cast("double").alias("x"), (u % 70).cast("double").alias("y"),
    )


OBSERVATIONS = """observations AS (SELECT event_id AS arrival, printf('obs-%d-%d', user_id, event_id % 5) AS observation_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS observed_at,
  CASE WHEN event_type = 'purchase' THEN 'confirmed_culvert' WHEN event_type = 'error' THEN 'no_culvert' ELSE 'maybe' END AS status,
  CASE WHEN user_id % 3 != 0 THEN printf('cand_%06d', user_id) ELSE '' END AS candidate_id, CASE WHEN event_id % 7 = 0 THEN printf('FC-%d', user_id) ELSE '' END AS field_culvert_id,
  CASE WHEN event_id % 4 = 0 THEN printf('cand_%06d', user_id + 1) WHEN event_id % 4 = 1 THEN 'route_1' ELSE '' END AS nearest_candidate_id, CAST(event_id % 40 AS DOUBLE) AS nearest_candidate_distance_m,
  CASE WHEN event_id % 2 = 0 THEN 'wet' ELSE '' END AS notes, 'Rt ' || (user_id % 50) AS road_name, -74.2 + (user_id % 100)/200.0 AS longitude,
  CASE WHEN event_id % 97 != 0 THEN 41.6 + (user_id % 70)/140.0 ELSE 95.0 END AS latitude, CAST(user_id % 100 AS DOUBLE) AS x, CAST(user_id % 70 AS DOUBLE) AS y FROM events)"""
