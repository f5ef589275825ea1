"""Mixing sources to target weights by hash-threshold histograms (operator 2).

A document's place in its source is a 60-bit hash of its id.  Sizes are summed by source and the hash's leading bits; running
sums over that histogram show in which bucket the budget ends; that bucket alone is summed again by the next bits, and so on.
What comes out is one threshold per source, and a document is in if its hash is not above it: nothing is sorted, and a rerun
takes the same documents.  Budgets are nested: a larger one only raises the threshold, and one of several times the source
takes every document whole times before the threshold shares out the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import global_rank
from ..storage import materialize, scope, scratch

#: Bits of the hash that one histogram resolves, and histograms in all: 12 x 5 = 60 bits.
BITS, LEVELS = 12, 5
MAX_REPEATS = 3
#: Sources up to which their sizes are summed on the driver; beyond, in as many jobs as it takes.
FEW_SOURCES = 100_000


def word_count(text: str | Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for null."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.filter(F.split(plain, " "), lambda w: w != "")), F.lit(0)).cast("long")


def place_hash(doc_id: str) -> Column:
    """60 bits of an MD5 digest of the id (null: of an empty string) as a long."""
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, source: str = "source", cycle: int = 3, most: int = MAX_REPEATS) -> DataFrame:
    """From (source, source_size): the target of each source.

    Weights 1..cycle go round the sources by code point, null last.  The budget is the sum of all sizes; no target is above
    ``most`` times its source, and what it can't take goes to the others by weight.  Poured like water: those whose share is
    above their limit are full, and the rest share what is left, until none more is; each step is one sum over the sources,
    and a full one stays full, so there are few.
    """
    few = sizes.count() <= FEW_SOURCES
    if few:
        ranked = sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())))  # counted
    else:
        ranked = global_rank(sizes, F.lit(0.0), [F.col(source).asc_nulls_last()], "_n")
    s = ranked.select(source, "source_size", ((F.col("_n") - 1) % cycle + 1).cast("long").alias("_w"), (F.col("source_size") * most).alias("_cap"))
    if few:
        rows = [(r["_w"], r["_cap"], r["source_size"]) for r in s.collect()]  # counted
        total, rest = sum(r[2] for r in rows), sum(r[0] for r in rows)
    else:
        s, _ = materialize(s, "mix-weights")
        total, rest = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    full, share = 0, F.lit(0.0)
    while rest:
        share = (F.lit(total - full) * F.col("_w")).cast("double") / F.lit(rest)
        if few:
            over = [float((total - full) * w) / float(rest) > cap for w, cap, _ in rows]
            now, left = sum(r[1] for r, o in zip(rows, over, strict=True) if o), sum(r[0] for r, o in zip(rows, over, strict=True) if not o)
        else:
            above = share > F.col("_cap")
            now, left = s.agg(F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("_w"))), F.lit(0))).first()
        if left == rest:
            break
        full, rest = now, left
    poured = share if rest else F.col("_cap").cast("double")
    return s.select(source, "source_size", F.least(poured, F.col("_cap").cast("double")).alias("target"))


def thresholds(docs: DataFrame, goals: DataFrame, source: str = "_s") -> DataFrame:
    """From (source, size, hash) and (source, source_size, target): copies that all documents get, and the last hash that gets one more."""
    size = F.col("source_size")
    goals = goals.withColumn("copies", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0)).withColumn("budget", F.col("target") - F.col("copies") * size)
    # Per source: hashes below `low` are in; the budget ends among those that share the leading bits `lead`.
    state = goals.select(source, "copies", "budget", F.lit(0).cast("long").alias("lead"), F.lit(0).cast("long").alias("before"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        bucket = F.shiftright(F.col("hash"), shift)
        inside = docs if level == 1 else docs.join(state.select(source, "lead"), source).where(F.shiftright(bucket, BITS) == F.col("lead"))
        histogram = inside.groupBy(source, bucket.alias("bucket")).agg(F.sum("size").alias("held"))
        upto = Window.partitionBy(source).orderBy("bucket")
        sums = histogram.withColumn("upto", F.sum("held").over(upto))
        sums = sums.join(state.select(source, "copies", "budget", "before"), source).withColumn("upto", F.col("upto") + F.col("before"))
        # The boundary bucket: the first that passes the budget; the last one if none does.
        over = F.col("upto") > F.col("budget")
        pick = F.struct(F.when(over, 0).otherwise(1).alias("late"), F.when(over, F.col("bucket")).otherwise(-F.col("bucket")).alias("at"), "bucket", "upto", "held")
        state, _ = materialize(
            sums.groupBy(source).agg(F.first("copies").alias("copies"), F.first("budget").alias("budget"), F.min(pick).alias("p"))
            .select(source, "copies", "budget", F.col("p.bucket").alias("lead"), (F.col("p.upto") - F.col("p.held")).alias("before"), F.col("p.upto").alias("upto")),
            "mix-thresholds",
        )
    # The last bucket is one hash; it is in if that comes nearer to the budget.
    nearer = F.col("upto") - F.col("budget") <= F.col("budget") - F.col("before")
    last = F.when(F.col("budget") <= 0, -1).when(nearer, F.col("lead")).otherwise(F.col("lead") - 1)  # no hash is below 0
    return state.select(source, "copies", last.cast("long").alias("last"))


def plan(docs: DataFrame) -> DataFrame:
    """From (_s, size, hash), one row per source: _s (a struct that holds the source), source_size, target, copies, last."""
    with scratch(docs.sparkSession) as kept:
        sizes, _ = materialize(docs.groupBy("_s").agg(F.sum("size").alias("source_size")), "mix-sources")
        goals = targets(sizes.withColumn("_v", F.col("_s.v")), "_v").withColumn("_s", F.struct(F.col("_v").alias("v"))).drop("_v")
        goals, _ = materialize(goals, "mix-targets")
        limits = thresholds(docs, goals)
        out, path = materialize(goals.join(limits, "_s"), "mix-plan")
        kept.add(path)
    return out


def narrow(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """What a plan needs of each document, written to the shared folder: doc_id, _s, size, hash."""
    return materialize(df.select(F.col(doc_id).alias("doc_id"), F.struct(F.col(source).alias("v")).alias("_s"), word_count(text).alias("size"), place_hash(doc_id).alias("hash")), "mix-sizes")[0]


def _copies(hash_: Column) -> Column:
    return (F.col("copies") + F.when(hash_ <= F.col("last"), 1).otherwise(0)).cast("long")


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """How often the mix takes each document: doc_id, size, source_size, target, taken (words, repeats counted), copies.

    Rows of one source and id share a hash, so they are taken together; a null source is one of its own, null ids hash like
    an empty string, a null or empty text has size 0 and takes 0 words (it goes with its hash), a long one is counted whole.
    Other columns are not read.  An empty table gives no rows.
    """
    docs = narrow(df, doc_id, text, source)
    copies = _copies(F.col("hash"))
    return docs.join(plan(docs), "_s").select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``df`` with all their columns, whatever these are called, each as often as the mix takes it: 0 to 3 times.

    Nulls, ties, repeated rows and empty tables are as in :func:`mix`; a text without words goes with its hash like others.
    The plan is joined by source; no text is shuffled for it.
    """
    with scratch(df.sparkSession) as kept:
        with scope() as made:
            limits = plan(narrow(df, doc_id, text, source))
        kept.add(made[-1])  # the plan
    wide = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.struct(F.col(source).alias("v")).alias("_s"), place_hash(doc_id).alias("hash"))
    times = F.explode(F.array_repeat(F.lit(0), _copies(F.col("hash")).cast("int"))).alias("time")
    return wide.join(limits, "_s").select("row", times).select("row.*")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
n AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w,
             row_number() OVER (ORDER BY source NULLS LAST) AS rn, 3 * source_size AS cap FROM s),
f AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
             CAST(coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS full_,
             CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest_w FROM n),
l AS (SELECT full_, rest_w FROM f WHERE CAST((total - full_) * w AS DOUBLE) / rest_w <= cap ORDER BY full_, rest_w LIMIT 1),
t AS (SELECT f.source, source_size, least(CAST((total - l.full_) * w AS DOUBLE) / l.rest_w, CAST(cap AS DOUBLE)) AS target FROM f, l),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS copies FROM t),
b AS (SELECT source, h, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto, sum(size) AS held FROM d GROUP BY source, h),
c AS (SELECT b.source, max(CASE WHEN upto <= g.target - g.copies * g.source_size THEN h ELSE -1 END) AS last_in,
             min(CASE WHEN upto > g.target - g.copies * g.source_size THEN h END) AS next_h,
             min(CASE WHEN upto > g.target - g.copies * g.source_size THEN upto END) AS next_upto,
             coalesce(max(CASE WHEN upto <= g.target - g.copies * g.source_size THEN upto END), 0) AS in_upto
      FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source GROUP BY b.source)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, g.source_size, g.target,
       CAST(d.size * (g.copies + CASE WHEN d.h <= CASE WHEN g.target - g.copies * g.source_size <= 0 THEN -1 WHEN c.next_h IS NOT NULL
              AND c.next_upto - (g.target - g.copies * g.source_size) <= (g.target - g.copies * g.source_size) - c.in_upto
              THEN c.next_h ELSE c.last_in END THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(g.copies + CASE WHEN d.h <= CASE WHEN g.target - g.copies * g.source_size <= 0 THEN -1 WHEN c.next_h IS NOT NULL
              AND c.next_upto - (g.target - g.copies * g.source_size) <= (g.target - g.copies * g.source_size) - c.in_upto
              THEN c.next_h ELSE c.last_in END THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""
