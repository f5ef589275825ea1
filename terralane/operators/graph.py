"""Connected components of a graph of links, by rounds of joins with tables written between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, remove

#: Links of a node from which it is a hub, and hubs (two numbers each) up to which they are sent to every executor.
HUB_LINKS, SENT_HUBS = 10_000, 200_000


def with_least(edges: DataFrame, own: bool) -> tuple[DataFrame, str]:
    """Edges (u, v) with m, the least v of their u (or u itself, if ``own`` and that is less); and the path of a table behind it.

    Least values are aggregated before they are shuffled, however many links a node has.  To join them back, hubs' edges stay
    where they are and meet their few values by broadcast; if there are too many hubs for that, no hub holds much of the table,
    and the join that Spark chooses, which splits skewed partitions, takes all.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    if own:
        least = least.withColumn("m", F.least("u", "m"))
    hubs, path = materialize(least.where(F.col("n") >= HUB_LINKS).select(F.col("u").alias("hub"), F.col("m").alias("hub_m")), "hubs")
    if not 0 < hubs.count() <= SENT_HUBS:
        return edges.join(least.select("u", "m"), "u"), path
    marked = edges.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    others = marked.where("hub is null").select("u", "v").join(least.where(F.col("n") < HUB_LINKS).select("u", "m"), "u")
    return marked.where("hub is not null").select("u", "v", F.col("hub_m").alias("m")).unionByName(others), path


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of ``links``; component is the smallest node that can be reached.

    Alternating large-star and small-star rounds: every node's larger, then smaller, neighbours are linked to its smallest one
    until nothing changes.  The number of links never grows.  Links with a null end are left out, links of a node to itself
    and repeated links change nothing, no links give no rows.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    edges, path = materialize(edges, "edges")
    state = lambda e: e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
    before = state(edges)
    while before[0]:
        # Large star: link each node's larger neighbours to the smallest of the node and its neighbours.
        both, hubs = with_least(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), own=True)
        large, large_path = materialize(both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "large-star")
        # Small star: link each node's smaller neighbours, and itself, to the smallest of them.
        small, more_hubs = with_least(large, own=False)
        links_of = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        new, new_path = materialize(small.select(links_of).select("e.u", "e.v").where("u != v").distinct(), "edges")
        now = state(new)
        remove(spark, path, large_path, hubs, more_hubs)
        edges, path = new, new_path
        if now == before:
            break
        before = now
    roots = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("component").alias("node"), "component").distinct())
