"""Ranks over a whole table without a window over a single partition.

Rows are dealt into ranges of the value; counts by range give each range its first rank, and only within a range are rows
ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, scratch, shuffle_partitions
from .columns import number

RANGES = 64


def _cell(value: Column, bounds: list[float]) -> Column:
    if not bounds:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < value))


def value_ranges(df: DataFrame, values: dict[str, Column], ranges: int = RANGES) -> tuple[dict[str, list[float]], dict[str, int]]:
    """Range bounds and counts of non-null values of several columns, from one pass."""
    if not values:
        return {}, {}
    at = [i / ranges for i in range(1, ranges)]
    aggs = [a for n, v in values.items() for a in (F.percentile_approx(v, at, 20 * ranges).alias(f"q_{n}"), F.count(v).alias(f"n_{n}"))]
    row = df.agg(*aggs).first()
    return {n: sorted(set(row[f"q_{n}"] or [])) for n in values}, {n: row[f"n_{n}"] for n in values}


#: Different values (three numbers each) up to which ranks are sent to every executor; rows of a value from which it is hot, and
#: how many hot ones are sent where there are more values than that.
SENT_VALUES, HOT_ROWS, SENT_HOT = 500_000, 100_000, 200_000


def pct_ranks(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add, for each name, the average rank of its value among the non-null ones, divided by how many there are.

    Null stays null.  If at most one value is not null, all ranks are null: see :func:`percentile`.  All columns are ranked
    together, as (name, value) pairs; ties fold into one pair, so a value that many rows share is ranked once.  Ranks go back
    to rows that stay as they are, a lookup per column, as long as the counted pairs are few enough to send.  Else rows and
    pairs meet by value, but for hot values, whose rows stay where they are.
    """
    if not columns:
        return df
    spark = df.sparkSession
    values = {n: number(c) for n, c in columns.items()}
    with scratch(spark) as kept:
        table, _ = materialize(df.withColumns({f"_v_{n}": v for n, v in values.items()} | {"_rid": F.monotonically_increasing_id()}), "ranks")
        bounds, counts = value_ranges(table, {n: F.col(f"_v_{n}") for n in values})
        live = [n for n in values if counts[n] > 1]
        out = table.drop(*[n for n in values if n in table.columns])
        if live:
            long = table.select("_rid", F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"_v_{n}").alias("v")) for i, n in enumerate(live)])).alias("x")).where("x.v is not null").select("_rid", "x.c", "x.v")
            cut = F.element_at(F.array(*[F.array(*[F.lit(b) for b in bounds[n]]).cast("array<double>") for n in live]), F.col("c") + 1)
            distinct = long.groupBy("c", "v").agg(F.count("*").alias("n")).withColumn("cell", F.size(F.filter(cut, lambda b: b < F.col("v"))))
            distinct, _ = materialize(distinct, "distinct")
            totals = distinct.groupBy("c", "cell").agg(F.sum("n").alias("t"))
            before = Window.partitionBy("c").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
            starts = totals.select("c", "cell", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"), F.sum("t").over(Window.partitionBy("c")).alias("all"))
            upto = F.sum("n").over(Window.partitionBy("c", "cell").orderBy("v"))
            ranked = distinct.join(F.broadcast(starts), ["c", "cell"]).select("c", "v", "n", ((F.col("start") + upto - (F.col("n") - 1) / 2) / F.col("all")).alias("r"))
            ranked, _ = materialize(ranked, "ranked-values")
            if ranked.count() <= SENT_VALUES:
                for i, n in enumerate(live):
                    found = ranked.where(F.col("c") == i).select(F.col("v").alias(f"_k_{n}"), F.col("r").alias(n))
                    out = out.join(F.broadcast(found), F.col(f"_v_{n}") == F.col(f"_k_{n}"), "left").drop(f"_k_{n}")
            else:
                out = out.join(_met(long, ranked, live), "_rid", "left")
        out = out.drop("_rid", *[f"_v_{n}" for n in values])
        out, path = materialize(out.withColumns({n: F.lit(None).cast("double") for n in values if n not in live}), "ranked")
        kept.add(path)
    return out


def _met(long: DataFrame, ranked: DataFrame, names: list[str]) -> DataFrame:
    """_rid and a rank for each name, by joining rows (_rid, c, v) with ranked values."""
    hot = ranked.where(F.col("n") >= HOT_ROWS).select(F.col("c").alias("h_c"), F.col("v").alias("h_v"), F.col("r").alias("h_r"))
    if 0 < hot.count() <= SENT_HOT:
        marked = long.join(F.broadcast(hot), (F.col("c") == F.col("h_c")) & (F.col("v") == F.col("h_v")), "left")
        cold = marked.where("h_c is null").select("_rid", "c", "v").join(ranked.where(F.col("n") < HOT_ROWS).select("c", "v", "r"), ["c", "v"]).select("_rid", "c", "r")
        found = marked.where("h_c is not null").select("_rid", "c", F.col("h_r").alias("r")).unionByName(cold)
    else:
        found = long.join(ranked.select("c", "v", "r"), ["c", "v"]).select("_rid", "c", "r")
    return found.groupBy("_rid").agg(*[F.max(F.when(F.col("c") == i, F.col("r"))).alias(n) for i, n in enumerate(names)])


def percentile(rank: str) -> Column:
    """A column of :func:`pct_ranks` with null as 0."""
    return F.coalesce(F.col(rank), F.lit(0.0))


def global_rank(df: DataFrame, lead: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """Number all rows from 1 by ``lead`` (a double, falling, nulls last) and then ``order``, which must make it total.

    Rows are dealt by ranges of the whole key, so a value of ``lead`` that many rows share still fills several ranges; the
    ranges' sizes, from the table as written, give each range's first number.
    """
    parts = shuffle_partitions(df.sparkSession)
    rows = df.withColumn("_lead", F.coalesce(number(lead), F.lit(float("-inf"))))
    placed, _ = materialize(rows.repartitionByRange(parts, F.col("_lead").desc(), *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part").agg(F.count("*").alias("_t")).select("_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_from"))  # one row per range
    within = Window.partitionBy("_part").orderBy(F.col("_lead").desc(), *order)
    return placed.join(F.broadcast(starts), "_part").withColumn(name, (F.col("_from") + F.row_number().over(within)).cast("long")).drop("_lead", "_part", "_from")


def robust_0_to_1(df: DataFrame, column: str, name: str) -> DataFrame:
    """Scale to [0, 1] between the exact 5 % and 95 % quantiles; null as 0; all 0 if they are equal or missing."""
    v = number(column)
    low, high = df.agg(F.percentile(v, 0.05), F.percentile(v, 0.95)).first()
    if low is None or high is None or high <= low:
        return df.withColumn(name, F.lit(0.0))
    return df.withColumn(name, F.coalesce(F.least(F.greatest((v - low) / (high - low), F.lit(0.0)), F.lit(1.0)) * F.when(v.isNotNull(), 1.0), F.lit(0.0)))
