"""Classification metrics as aggregates over distinct scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import _cell, value_ranges

TARGET_PRECISION = 0.60


def threshold_table(df: DataFrame, target: str = "target", probability: str = "probability") -> DataFrame:
    """One row per distinct probability: rows and hits at it (n, hits) and at it or above (predicted, true_positives).

    Sums run within ranges of the probability, on top of the ranges' totals, so no task orders all values.
    """
    p = F.col(probability).cast("double")
    bounds, _ = value_ranges(df, {"p": p})
    rows = df.where(p.isNotNull()).groupBy(p.alias("threshold")).agg(F.count("*").alias("n"), F.sum(F.col(target).cast("long")).alias("hits"))
    rows = rows.withColumn("_cell", _cell(F.col("threshold"), bounds["p"]))
    above = Window.orderBy(F.col("_cell").desc()).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = rows.groupBy("_cell").agg(F.sum("n").alias("_n"), F.sum("hits").alias("_h"))
    starts = starts.select("_cell", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}0") for c in ("_n", "_h")])
    within = Window.partitionBy("_cell").orderBy(F.col("threshold").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(starts), "_cell")
    return out.select("threshold", "n", "hits", (F.col("_n0") + F.sum("n").over(within)).alias("predicted"), (F.col("_h0") + F.sum("hits").over(within)).alias("true_positives"))


def binary_metrics(df: DataFrame, target: str = "target", probability: str = "probability", cutoff: float = 0.5) -> DataFrame:
    """One row: accuracy, precision, recall, f1, average_precision (sum of recall steps), brier_score, roc_auc (null for one class)."""
    y, p = F.col(target).cast("double"), F.col(probability).cast("double")
    said = (p >= cutoff).cast("double")
    simple = df.agg(
        F.avg((said == y).cast("double")).alias("accuracy"), F.sum(said * y).alias("tp"), F.sum(said).alias("pp"), F.sum(y).alias("pos"), F.count("*").cast("double").alias("all"), F.avg((p - y) * (p - y)).alias("brier_score")
    )
    t = threshold_table(df, target, probability)
    steps = t.agg(
        F.sum(F.col("hits") * F.col("true_positives") / F.col("predicted")).alias("_ap"),
        # Pairs (positive above negative), ties as half.
        F.sum((F.col("n") - F.col("hits")) * (F.col("true_positives") - F.col("hits") / 2.0)).alias("_pairs"),
    )
    precision, recall = F.when(F.col("pp") > 0, F.col("tp") / F.col("pp")).otherwise(0.0), F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(0.0)
    negatives = F.col("all") - F.col("pos")
    # Both sides have one row.
    return simple.join(F.broadcast(steps), F.lit(True)).select(
        "accuracy",
        precision.alias("precision"),
        recall.alias("recall"),
        F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0).alias("f1"),
        F.when(F.col("pos") > 0, F.col("_ap") / F.col("pos")).otherwise(0.0).alias("average_precision"),
        "brier_score",
        F.when((F.col("pos") > 0) & (negatives > 0), F.col("_pairs") / (F.col("pos") * negatives)).alias("roc_auc"),
    )


def precision_floor(df: DataFrame, target: str = "target", probability: str = "probability", floor: float = TARGET_PRECISION) -> DataFrame:
    """The operating point: of thresholds with enough precision that of most (recall, rows, f1), else that of most (precision, recall).

    No row comes back if there are no rows or no positives.
    """
    t = threshold_table(df, target, probability)
    positives = df.agg(F.sum(F.col(target).cast("long")).alias("positives")).where("positives > 0")
    t = t.join(F.broadcast(positives), F.lit(True))  # one row
    precision, recall = F.col("true_positives") / F.col("predicted"), F.col("true_positives") / F.col("positives")
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    rows = t.select(
        (precision >= floor).alias("meets_precision_floor"), "threshold", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), F.col("predicted").alias("predicted_positive_count"), F.col("true_positives").alias("hits")
    )
    meets = F.col("meets_precision_floor")
    keys = [meets.desc(), F.when(meets, F.col("recall")).otherwise(F.col("precision")).desc(), F.when(meets, F.col("predicted_positive_count").cast("double")).otherwise(F.col("recall")).desc(), F.when(meets, F.col("f1")).desc(), F.col("threshold").desc()]
    return rows.orderBy(*keys).limit(1)


def top_k(df: DataFrame, ks: tuple[int, ...] = (5, 10, 25), target: str = "target", probability: str = "probability", tie_break: str = "id") -> DataFrame:
    """Per k (at most the number of rows): hits, precision_at_k and recall_at_k of the k most probable rows."""
    first = df.orderBy(F.col(probability).desc(), tie_break).limit(max(ks)).select(F.col(target).cast("long").alias("t"), F.col(probability).alias("p"), F.col(tie_break).alias("i"))
    ranked = first.withColumn("r", F.row_number().over(Window.orderBy(F.col("p").desc(), "i")))  # max(ks) rows
    total = df.agg(F.sum(F.col(target).cast("long")).alias("positives"), F.count("*").alias("rows"))
    wanted = df.sparkSession.createDataFrame([(k,) for k in ks], "k0 long").join(F.broadcast(total), F.lit(True)).withColumn("k", F.least("k0", "rows")).where("k > 0")
    hits = wanted.join(ranked, F.col("r") <= F.col("k")).groupBy("k0", "k", "positives").agg(F.sum("t").alias("hits"))
    return hits.select("k", "hits", (F.col("hits") / F.col("k")).alias("precision_at_k"), F.when(F.col("positives") > 0, F.col("hits") / F.col("positives")).otherwise(0.0).alias("recall_at_k"))
