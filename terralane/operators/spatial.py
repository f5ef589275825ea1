"""Distance joins, nearest joins, thinning and clusters over grids of equi-joined cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, project
from ..functions.ranking import global_rank
from ..storage import materialize, remove, scratch, shuffle_partitions
from .graph import components


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("long")


def around(x: Column, y: Column, size: float) -> Column:
    """The point's cell and its eight neighbours, as an array of structs gx, gy."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return F.array(*[F.struct((cell(x, size) + i).alias("gx"), (cell(y, size) + j).alias("gy")) for i, j in steps])


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}{c}") for c in df.columns])


def grid_join(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of points (columns x, y) at most ``radius`` apart: l_*, r_*, d.  Each pair once."""
    a = left.withColumn("_g", F.explode(around(F.col("x"), F.col("y"), radius))).select(*[F.col(c).alias(f"l_{c}") for c in left.columns], "_g.gx", "_g.gy")
    b = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns], cell(F.col("x"), radius).alias("gx"), cell(F.col("y"), radius).alias("gy"))
    pairs = a.join(b, ["gx", "gy"]).withColumn("d", distance(F.col("l_x"), F.col("l_y"), F.col("r_x"), F.col("r_y")))
    return pairs.where(F.col("d") <= radius).drop("gx", "gy")


def segment_cells(lines: DataFrame, size: float, margin: float) -> DataFrame:
    """Segments with each grid cell (gx, gy) that lies within ``margin`` of them, and few others: none of their box's corners.

    In each column of cells, the part of a segment whose x is within the margin of the column gives the rows.  The margin grows
    by more than rounding can move a place.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    grow = F.lit(margin + size * 1e-6) + (F.abs(x1) + F.abs(x2) + F.abs(y1) + F.abs(y2)) * 4e-15
    span = lambda p, q: F.sequence(cell(F.least(p, q) - F.col("_m"), size), cell(F.greatest(p, q) + F.col("_m"), size))
    y = lambda x, none: F.when(x1 == x2, none).otherwise(y1 + F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - x1) / (x2 - x1))) * (y2 - y1))
    dealt = lines.repartition(shuffle_partitions(lines.sparkSession))  # a table in one small file would grow in one task
    columns = dealt.withColumn("_m", grow).withColumn("gx", F.explode(span(x1, x2)))
    parts = columns.withColumns({"_a": y(F.col("gx") * float(size) - F.col("_m"), y1), "_b": y((F.col("gx") + 1) * float(size) + F.col("_m"), y2)})
    return parts.withColumn("gy", F.explode(span(F.col("_a"), F.col("_b")))).drop("_m", "_a", "_b")


def by_cell(a: DataFrame, b: DataFrame) -> DataFrame:
    """Join on gx, gy with both sides shuffled: a stage of its own for the pairs, in code short enough to be compiled, on all cores."""
    return a.hint("merge").join(b, ["gx", "gy"])


def points_near_segments(points: DataFrame, lines: DataFrame, radius: float) -> DataFrame:
    """Pairs of a point (x, y) and a segment: l_*, r_*, d; all at most ``radius`` away and others beyond, for the caller to leave out.

    A filter here would become a condition of the join, too long for the compiler; aggregates may come first.
    """
    size = 2 * radius
    a = points.select(*[F.col(c).alias(f"l_{c}") for c in points.columns], cell(F.col("x"), size).alias("gx"), cell(F.col("y"), size).alias("gy"))
    b = segment_cells(lines, size, radius)
    b = b.select(*[F.col(c).alias(f"r_{c}") for c in lines.columns], "gx", "gy")
    px, py, x1, y1, x2, y2 = (F.col(c) for c in ("l_x", "l_y", "r_x1", "r_y1", "r_x2", "r_y2"))
    # Step by step, so that no step is computed again by the next.
    on = by_cell(a, b).withColumn("_t", project(px, py, x1, y1, x2, y2))
    return on.withColumn("d", distance(px, py, x1 + F.col("_t") * (x2 - x1), y1 + F.col("_t") * (y2 - y1))).drop("gx", "gy", "_t")


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_order: str, lines: bool = False, max_distance: float | None = None) -> DataFrame:
    """For each left point the nearest right row (point, or segment with ``lines``), ties by ``right_order``: l_*, r_*, d.

    Rings of cells of doubling size: a point is settled once its best is within the ring; the others go on.  The first size
    comes from the mean density, so the rounds are few and each round's joins are local.  Left rows stay, with nulls, where
    ``right`` is empty or nothing is within ``max_distance``.
    """
    if lines:
        ends = right.agg(F.min(F.least("x1", "x2")), F.max(F.greatest("x1", "x2")), F.min(F.least("y1", "y2")), F.max(F.greatest("y1", "y2")), F.count("*")).first()
    else:
        ends = right.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    mine = left.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
    empty = [F.lit(None).cast(f.dataType).alias(f"r_{f.name}") for f in right.schema] + [F.lit(None).cast("double").alias("d")]
    if not ends[4] or not mine[4]:
        return prefixed(left, "l_").select("*", *empty)
    wide = max(max(ends[1], mine[1]) - min(ends[0], mine[0]), max(ends[3], mine[3]) - min(ends[2], mine[2]), 1e-6)
    limit = max_distance if max_distance is not None else 2 * wide
    radius = min(max(wide / math.sqrt(ends[4]), wide / 4096), limit)
    # Rows are copied to many cells, so they carry ids and places only.
    right, _ = materialize(right.withColumn("_rid", F.monotonically_increasing_id()), "nearest-right")
    slim = right.select("_rid", F.col(right_order).alias("_o"), *(("x1", "y1", "x2", "y2") if lines else ("x", "y")))
    rest, settled = left.select(left_id, "x", "y"), []
    while True:
        pairs = points_near_segments(rest, slim, radius) if lines else grid_join(rest, slim, radius)
        best = pairs.groupBy(F.col(f"l_{left_id}").alias("_id")).agg(F.min(F.struct("d", "r__o", "r__rid")).alias("_b"))
        found, _ = materialize(best.select("_id", "_b.d", "_b.r__rid").where(F.col("d") <= radius), "nearest")
        settled.append(found)
        if radius >= limit:
            break
        rest = rest.join(found.select("_id"), rest[left_id] == found["_id"], "left_anti")
        if rest.isEmpty():
            break
        radius = min(radius * 4, limit)
    matched = settled[0]
    for more in settled[1:]:
        matched = matched.unionByName(more)
    matched = matched.join(prefixed(right, "r_"), "r__rid").drop("r__rid")
    base = prefixed(left, "l_")
    out = base.join(matched, base[f"l_{left_id}"] == matched["_id"], "left")
    return out.select(*base.columns, *[f"r_{c}" for c in right.columns if c != "_rid"], "d")


def thin(df: DataFrame, row_id: str, order: list[str], spacing: float, group: str | None = None, cap: int = 0) -> DataFrame:
    """Exactly the rows that a walk in ``order`` (with ``row_id`` as the last key) would take.

    A row is taken unless one taken before it is nearer than ``spacing``, or ``cap`` rows of its ``group`` are taken already.
    Rounds decide, at once, every row whose earlier neighbours and group mates leave no doubt; the first undecided row always
    is one, and the set is the walk's, whatever the order of rounds.
    """
    spark = df.sparkSession
    rows = df.select(F.col(row_id).alias("id"), F.struct(*order, row_id).alias("_key"), "x", "y", (F.col(group) if group else F.lit(None)).cast("string").alias("grp"))
    with scratch(spark) as kept:
        placed = global_rank(rows, F.lit(0.0), [F.col("_key")], "ord").drop("_key")
        state, path = materialize(placed.withColumn("s", F.lit(0)), "thin")
        pairs = None
        if spacing > 0:
            slim = state.select("id", "ord", "x", "y")
            near = grid_join(slim, slim, spacing).where((F.col("d") < spacing) & (F.col("l_ord") < F.col("r_ord")))
            pairs, _ = materialize(near.select(F.col("l_id").alias("a"), F.col("r_id").alias("b")), "thin-pairs")
        while not state.where("s = 0").isEmpty():
            judged = state
            if pairs is not None:
                marks = pairs.join(state.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").groupBy(F.col("b").alias("id")).agg(F.max("sa").alias("taken"), F.max(F.when(F.col("sa") == 0, 1).otherwise(0)).alias("open"))
                judged = judged.join(marks, "id", "left").na.fill({"taken": -1, "open": 0})
            else:
                judged = judged.withColumns({"taken": F.lit(-1), "open": F.lit(0)})
            judged = _room(judged, cap) if cap > 0 else judged.withColumns({"full": F.lit(False), "may_fill": F.lit(False)})
            new = F.when(F.col("s") != 0, F.col("s")).when((F.col("taken") == 1) | F.col("full"), -1).when((F.col("open") == 0) & ~F.col("may_fill"), 1).otherwise(0)
            # Rows that are not taken matter to none that is open, so they leave the table.
            after, new_path = materialize(judged.select("id", "ord", "x", "y", "grp", new.alias("s")).where("s >= 0"), "thin")
            remove(spark, path)
            state, path = after, new_path
        kept.add(path)
    return df.join(state.select(F.col("id").alias(row_id)), row_id, "left_semi")


#: Places in the walk that are counted together for the cap of a group.
RUN = 100_000


def _room(state: DataFrame, cap: int) -> DataFrame:
    """Add full (``cap`` rows of the group are taken before) and may_fill (taken or open ones before make as many).

    Counts by group and run of the walk are added up first, so a group of any size is never ordered in one task.
    """
    runs = state.withColumn("_run", F.floor((F.col("ord") - 1) / RUN))
    taken, open_ = F.when(F.col("s") == 1, 1).otherwise(0), F.lit(1)  # rows that are not taken are gone
    sums = runs.groupBy("grp", "_run").agg(F.sum(taken).alias("t"), F.sum(open_).alias("o"))
    before = Window.partitionBy("grp").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # one row per run of a group
    starts = sums.select(F.col("grp").alias("_g"), F.col("_run").alias("_r"), F.coalesce(F.sum("t").over(before), F.lit(0)).alias("_t"), F.coalesce(F.sum("o").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy("grp", "_run").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    here = lambda c: F.coalesce(F.sum(c).over(within), F.lit(0))
    counted = runs.withColumns({"_ht": here(taken), "_ho": here(open_)}).join(starts, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("_run") == F.col("_r")))
    return counted.withColumns({"full": F.col("_t") + F.col("_ht") >= cap, "may_fill": F.col("_o") + F.col("_ho") >= cap}).drop("_run", "_g", "_r", "_t", "_o", "_ht", "_ho")


def clusters(points: DataFrame, row_id: str, radius: float) -> DataFrame:
    """Add cluster_id: groups of two or more points linked by steps of at most ``radius``, numbered from 0 by their least id; -1 alone.

    This is density clustering with two points to a core: every point that has a neighbour is a core point.
    """
    slim = points.select(F.col(row_id).alias("id"), "x", "y")
    links = grid_join(slim, slim, radius).where("l_id < r_id").select(F.col("l_id").alias("a"), F.col("r_id").alias("b"))
    found = components(links)
    numbers = global_rank(found.select("component").distinct(), -F.col("component").cast("double"), [F.col("component")], "_n")
    numbers = numbers.select("component", (F.col("_n") - 1).cast("int").alias("cluster_id"))
    named = found.join(numbers, "component").select(F.col("node").alias(row_id), "cluster_id")
    return points.join(named, row_id, "left").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(-1)))
