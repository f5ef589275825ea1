"""Supervised probability of a site: families, splits, selection, holdouts and predictions with MLlib."""

from __future__ import annotations

import math
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import number
from ..functions.ranking import global_rank
from ..storage import materialize, scratch
from . import metrics

FILL, BLOCK_M, TEST_SHARE, TRIES, LEAST_WEIGHT = -9999.0, 2500.0, 0.25, 25, 0.01
# Columns that are never features.
EXCLUDED = (
    "is_culvert",
    "dist_to_known_culvert_m",
    "longitude",
    "latitude",
    "x_m",
    "y_m",
    "culvert_probability",
    "priority_rank",
    "priority_percentile",
    "priority_seed",
    "culvert_likelihood_score",
    "discovery_score",
    "evidence_score",
    "model_probability_score",
    "model_rank_score",
    "label_confidence",
    "nearest_field_report_label_confidence",
    "training_sample_weight",
    "field_denied",
    "dist_to_denied_culvert_m",
    "spatial_block_id",
    "route_sample_distance_m",
    "route_lateral_offset_m",
    "route_part_index",
    "source_exact_intersection",
    "source_nearest_approach",
    "source_route_interval_sample",
    "source_field_report_observed",
    "has_matched_route",
)


def feature_columns(df: DataFrame, target: str = "is_culvert", extra: tuple[str, ...] = ()) -> list[str]:
    """Numeric columns but for labels, places, scores and ids."""
    out = {*EXCLUDED, target, *extra}
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in out and not f.name.lower().endswith("_id")]


def prepared(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles, missing or infinite as FILL; columns that the table lacks are all FILL."""
    def clean(c: str) -> Column:
        if c not in df.columns:
            return F.lit(FILL)
        v = number(c)
        return F.coalesce(F.when(F.abs(v) != float("inf"), v), F.lit(FILL))
    return df.withColumns({f"f_{c}": clean(c) for c in columns})


def spatial_block(x: Column, y: Column, size: float = BLOCK_M) -> Column:
    return F.concat_ws("_", F.floor(x / size).cast("long").cast("string"), F.floor(y / size).cast("long").cast("string"))


def class_weight_table(df: DataFrame, target: str) -> DataFrame:
    """n / (2 n_class) for each class."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    return counts.withColumn("class_weight", F.sum("n").over(Window.partitionBy()) / (2 * F.col("n")))  # one row per class


def with_weights(df: DataFrame, target: str, balanced: bool) -> DataFrame:
    w = F.greatest(F.coalesce(number("training_sample_weight"), F.lit(1.0)), F.lit(LEAST_WEIGHT)) if "training_sample_weight" in df.columns else F.lit(1.0)
    out = df.withColumn("_w", w)
    if balanced:
        out = out.join(F.broadcast(class_weight_table(df, target)), target).withColumn("_w", F.col("_w") * F.col("class_weight")).drop("n", "class_weight")
    return out


#: Families: (what it is, whether classes weigh the same).
FAMILIES = {
    "logistic": ("logistic regression on standardised features", True),
    "random_forest": ("800 trees", True),
    "extra_trees": ("800 trees without bootstrap", True),
    "spatial_regularized_extra_trees": ("600 trees without bootstrap, larger leaves, more features a split", True),
    "gradient_boosting": ("350 shallow boosted trees", False),
    "hist_gradient_boosting": ("300 boosted trees over 255 bins", False),
    "balanced_hist_gradient_boosting": ("450 boosted trees over 255 bins, larger leaves", True),
}


def estimator(family: str, total_weight: float, scale: float = 1.0) -> list:
    """Stages of a family, with ``scale`` of its trees or rounds.

    MLlib has no extra trees and no boosting by histograms with a bound on leaves.  Forests without bootstrap, over many
    candidate splits, and boosted trees of depth 4 over 255 bins stand in for them; their splits are the best of all bins
    where extra trees draw them, and leaves are bounded by depth and size, not by number.
    """
    tree = {"featuresCol": "features", "labelCol": "label", "weightCol": "_w", "seed": 42}
    n = lambda k: max(1, round(k * scale))
    match family:
        case "logistic":
            return [StandardScaler(inputCol="features", outputCol="scaled", withMean=True), LogisticRegression(featuresCol="scaled", labelCol="label", weightCol="_w", regParam=1 / max(total_weight, 1.0), maxIter=2000)]
        case "random_forest":
            return [RandomForestClassifier(numTrees=n(800), minInstancesPerNode=2, featureSubsetStrategy="sqrt", maxDepth=12, **tree)]
        case "extra_trees":
            return [RandomForestClassifier(numTrees=n(800), minInstancesPerNode=2, featureSubsetStrategy="sqrt", bootstrap=False, subsamplingRate=0.8, maxDepth=12, **tree)]
        case "spatial_regularized_extra_trees":
            return [RandomForestClassifier(numTrees=n(600), minInstancesPerNode=6, featureSubsetStrategy="0.7", bootstrap=False, subsamplingRate=0.8, maxDepth=12, **tree)]
        case "gradient_boosting":
            return [GBTClassifier(maxIter=n(350), maxDepth=2, stepSize=0.035, minInstancesPerNode=8, subsamplingRate=0.8, **tree)]
        case "hist_gradient_boosting":
            return [GBTClassifier(maxIter=n(300), maxDepth=4, stepSize=0.05, maxBins=255, **tree)]
        case "balanced_hist_gradient_boosting":
            return [GBTClassifier(maxIter=n(450), maxDepth=4, stepSize=0.035, minInstancesPerNode=12, maxBins=255, **tree)]
    raise ValueError(f"unknown model family: {family}; there are auto, {', '.join(sorted(FAMILIES))}")


def fit(df: DataFrame, columns: list[str], family: str = "hist_gradient_boosting", target: str = "is_culvert", scale: float = 1.0) -> PipelineModel:
    rows = with_weights(prepared(df, columns).withColumn("label", F.col(target).cast("double")), target, FAMILIES.get(family, ("", False))[1])
    ends = rows.agg(F.sum("_w"), F.countDistinct("label")).first()
    if ends[1] < 2:
        raise ValueError("training needs rows of both classes")
    assembler = VectorAssembler(inputCols=[f"f_{c}" for c in columns], outputCol="features")
    return Pipeline(stages=[assembler, *estimator(family, ends[0], scale)]).fit(rows)


def predict(df: DataFrame, model: PipelineModel, columns: list[str], tie_break: str = "candidate_id") -> DataFrame:
    """Add culvert_probability, priority_rank, priority_percentile and priority_bucket (cut at .35, .65, .85)."""
    out = model.transform(prepared(df, columns)).withColumn("culvert_probability", vector_to_array("probability")[1]).select(*df.columns, "culvert_probability")
    p = F.col("culvert_probability")
    name = F.when(p <= 0.35, "low").when(p <= 0.65, "medium").when(p <= 0.85, "high").otherwise("very_high")
    ranked = global_rank(out, p, [F.col(tie_break)], "priority_rank")  # a stored table, so that its rows are counted without another prediction
    n = ranked.agg(F.count("*").alias("_all"))  # one row
    return ranked.crossJoin(F.broadcast(n)).withColumns({"priority_percentile": 1 - (F.col("priority_rank") - 1) / F.col("_all"), "priority_bucket": name}).drop("_all")


def fit_and_predict(df: DataFrame, columns: list[str], family: str = "hist_gradient_boosting", target: str = "is_culvert") -> DataFrame:
    return predict(df, fit(df, columns, family, target), columns)


def _shuffled(df: DataFrame, row_id: str, target: str, seed: int) -> DataFrame:
    """Add _place, from 0, of each row in its class by the hash of its id; no class is ordered in one task."""
    u = F.xxhash64(F.col(row_id), F.lit(seed))
    classes = [r[target] for r in df.select(target).distinct().orderBy(target).collect()]  # two
    nth = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(target))
    ranked = global_rank(df.withColumns({"_class": nth, "_u": u}), -F.col("_class"), [F.col("_u"), F.col(row_id)], "_rank")
    firsts = F.broadcast(ranked.groupBy("_class").agg(F.min("_rank").alias("_first"), F.count("*").alias("_size")))  # one row per class
    return ranked.join(firsts, "_class").withColumn("_place", F.col("_rank") - F.col("_first")).drop("_class", "_u", "_rank", "_first")


def folds(df: DataFrame, k: int, row_id: str, target: str, seed: int = 42) -> DataFrame:
    """Add fold: the rank of the id's hash within its class, modulo k; the same on every run."""
    return _shuffled(df, row_id, target, seed).withColumn("fold", (F.col("_place") % k).cast("int")).drop("_place", "_size")


def random_holdout(df: DataFrame, row_id: str, target: str, seed: int = 42, share: float = TEST_SHARE) -> DataFrame | None:
    """Add is_test, a share of each class; None for fewer than 8 rows or 2 of a class."""
    counts = [r["count"] for r in df.groupBy(target).count().collect()]  # one per class
    if sum(counts) < 8 or len(counts) < 2 or min(counts) < 2:
        return None
    return _shuffled(df, row_id, target, seed).withColumn("is_test", F.col("_place") < F.greatest(F.lit(1.0), F.round(F.col("_size") * share))).drop("_place", "_size")


def spatial_holdout(df: DataFrame, target: str, seed: int = 42, share: float = TEST_SHARE, size: float = BLOCK_M) -> DataFrame | None:
    """Add is_test by whole blocks: the first of 25 hash orders of the blocks with both classes on both sides; else None."""
    rows = df.withColumn("spatial_block_id", spatial_block(F.col("x_m"), F.col("y_m"), size))
    blocks = rows.groupBy("spatial_block_id").agg(F.min(target).alias("a"), F.max(target).alias("b"))
    n = blocks.count()
    if n < 3:
        return None
    for attempt in range(TRIES):
        order = F.row_number().over(Window.orderBy(F.xxhash64(F.col("spatial_block_id"), F.lit(seed), F.lit(attempt)), "spatial_block_id"))  # one row per block
        cut = blocks.withColumn("is_test", order <= max(1, round(n * share)))
        sides = cut.groupBy("is_test").agg(F.min("a").alias("a"), F.max("b").alias("b")).collect()  # two rows
        if len(sides) == 2 and all(s["a"] != s["b"] for s in sides):
            return rows.join(cut.select("spatial_block_id", "is_test"), "spatial_block_id")
    return None


def evaluate_split(split: DataFrame, columns: list[str], family: str, target: str, row_id: str, scale: float = 1.0) -> dict:
    model = fit(split.where(~F.col("is_test")), columns, family, target, scale)
    scored = model.transform(prepared(split.where("is_test"), columns)).select(F.col(target).alias("target"), vector_to_array("probability")[1].alias("probability"), F.col(row_id).alias("id"))
    with scratch(split.sparkSession):
        scored, _ = materialize(scored, "holdout")  # metrics read it several times
        found = metrics.binary_metrics(scored).first().asDict()
        floor = metrics.precision_floor(scored).first()
        top = [r.asDict() for r in metrics.top_k(scored).orderBy("k").collect()]
    return found | {"precision_floor_60": floor.asDict() if floor else None, "top_k": top}


def prior(df: DataFrame, target: str = "is_culvert") -> float:
    """The baseline: the weighted share of positives, the same for every row."""
    w = with_weights(df, target, False).agg(F.sum(F.col("_w") * F.col(target)), F.sum("_w")).first()
    return w[0] / w[1] if w[1] else 0.0


def cross_validated(df: DataFrame, columns: list[str], family: str, target: str, row_id: str, k: int = 5, scale: float = 1.0) -> dict:
    """Means over stratified folds (at most ``k``, at most the rarer class's rows) of the metrics that have a value."""
    rarer = min(r["count"] for r in df.groupBy(target).count().collect())  # one row per class
    k = min(k, rarer)
    if k < 2:
        return {}
    rows = folds(df, k, row_id, target)
    found = [evaluate_split(rows.withColumn("is_test", F.col("fold") == i), columns, family, target, row_id, scale) for i in range(k)]
    mean = lambda name: (lambda v: sum(v) / len(v) if v else None)([f[name] for f in found if f[name] is not None])
    return {name: mean(name) for name in ("accuracy", "precision", "recall", "f1", "average_precision", "brier_score", "roc_auc")} | {"folds": k}


def permutation_importance(model: PipelineModel, df: DataFrame, columns: list[str], target: str, row_id: str, repeats: int = 10, seed: int = 42) -> list[tuple[str, float]]:
    """How much average precision falls when a column's values are dealt anew among the rows, as a share of all falls.

    Rows are put in the order of their ids' hashes once and stored.  For each column and repeat a row gets the value of the
    row that stands a fixed random number of places further on, the last being followed by the first, so a repeat is one join
    on numbers, and no value is lost or doubled.
    """

    def precision(t: DataFrame) -> float:
        scored = model.transform(prepared(t, columns)).select(F.col(target).alias("target"), vector_to_array("probability")[1].alias("probability"))
        return metrics.binary_metrics(scored).first()["average_precision"]

    with scratch(df.sparkSession):
        u = F.xxhash64(F.col(row_id), F.lit(seed))
        ranked, _ = materialize(global_rank(df.select(row_id, target, *[c for c in columns if c in df.columns]), F.lit(0.0), [u, F.col(row_id)], "_rank"), "shuffled")
        n = ranked.count()
        base, falls, chance = precision(ranked), {}, random.Random(seed)
        for c in columns:
            if c not in ranked.columns or n < 2:
                falls[c] = 0.0
                continue
            drops = []
            for _ in range(repeats):
                step = chance.randrange(1, n)
                other = ranked.select(((F.col("_rank") - 1 + step) % n + 1).alias("_rank"), F.col(c).alias("_other"))
                drops.append(base - precision(ranked.join(other, "_rank").withColumn(c, F.col("_other")).drop("_other")))
            falls[c] = max(0.0, sum(drops) / len(drops))
    total = sum(falls.values()) or 1.0
    return sorted(((c, v / total) for c, v in falls.items()), key=lambda x: (-x[1], x[0]))


def weight_summary(df: DataFrame, target: str = "is_culvert") -> dict:
    """Least, greatest and mean training weight, and their sums by class."""
    w = with_weights(df, target, False)
    positive = F.col(target).cast("int") == 1
    r = w.agg(F.min("_w"), F.max("_w"), F.avg("_w"), F.sum(F.when(positive, F.col("_w")).otherwise(0.0)), F.sum(F.when(positive, 0.0).otherwise(F.col("_w")))).first()
    return {"column": "training_sample_weight", "min": r[0], "max": r[1], "mean": r[2], "positive_weight_sum": r[3], "negative_weight_sum": r[4]}


def compared(df: DataFrame, columns: list[str], spatial: DataFrame | None, target: str, row_id: str, families: tuple[str, ...], scale: float = 1.0) -> dict[str, dict]:
    """Per family its cross-validated means and its spatial holdout's; a family that fails says so and takes no part.

    The baseline, the same probability for all, is listed first and never chosen.
    """
    share = prior(df, target)
    positives = df.agg(F.avg(F.col(target).cast("double"))).first()[0]
    out: dict[str, dict] = {"baseline": {"probability": share, "average_precision": positives, "f1": None}}
    counts = [r["count"] for r in df.groupBy(target).count().collect()]  # one row per class
    if sum(counts) < 8 or min(counts) < 2:
        return out | {f: {"note": "not enough labelled rows to compare", "average_precision": None, "f1": None} for f in families}
    for f in families:
        try:
            out[f] = cross_validated(df, columns, f, target, row_id, scale=scale)
            if spatial is not None:
                held = evaluate_split(spatial, columns, f, target, row_id, scale)
                out[f] |= {f"spatial_holdout_{k}": held[k] for k in ("average_precision", "f1", "roc_auc")}
        except ValueError as wrong:  # a fold or holdout of one class
            out[f] = {"error": str(wrong), "average_precision": None, "f1": None}
    return out


def selected(comparison: dict[str, dict]) -> str:
    """The family with the best spatial, then cross-validated average precision, then f1; the first of equals."""
    value = lambda r, k: -1.0 if r.get(k) is None or math.isnan(r[k]) else r[k]
    real = {f: r for f, r in comparison.items() if f != "baseline"}
    return max(real, key=lambda f: tuple(value(real[f], k) for k in ("spatial_holdout_average_precision", "average_precision", "f1")))


def train(df: DataFrame, target: str = "is_culvert", row_id: str = "candidate_id", family: str = "auto", scale: float = 1.0) -> tuple[PipelineModel, dict]:
    """Compare the families asked for, hold out at random and by space, refit the best on all rows.

    The table is stored once, with the features alone; all fits and splits read that.  The report has what a bundle needs.
    """
    if target not in df.columns:
        raise ValueError(f"no target column {target}")
    columns = feature_columns(df, target)
    if not columns:
        raise ValueError("no numeric feature columns to train on")
    if family != "auto" and family not in FAMILIES:
        estimator(family, 1.0)
    with scratch(df.sparkSession):
        extra = [c for c in ("x_m", "y_m", "training_sample_weight") if c in df.columns and c not in columns]
        df, _ = materialize(df.select(row_id, target, *columns, *extra), "training")
        counts = {str(r[target]): r["count"] for r in df.groupBy(target).count().collect()}  # one row per class
        if len(counts) < 2:
            raise ValueError("training needs rows of both classes")
        random_, spatial = random_holdout(df, row_id, target), spatial_holdout(df, target) if {"x_m", "y_m"} <= set(df.columns) else None
        comparison = compared(df, columns, spatial, target, row_id, tuple(FAMILIES), scale) if family == "auto" else {}
        family = selected(comparison) if comparison else family
        report = {"family": family, "feature_columns": columns, "target": target, "fill_value": FILL, "seed": 42, "rows": sum(counts.values()), "class_counts": counts, "sample_weight": weight_summary(df, target), "model_comparison": comparison}
        report["random_holdout"] = evaluate_split(random_, columns, family, target, row_id, scale) if random_ is not None else None
        report["spatial_holdout"] = evaluate_split(spatial, columns, family, target, row_id, scale) if spatial is not None else None
        if random_ is None:
            report["note"] = "too few rows for a holdout; trained on all"
        points = [(s, (report[s] or {}).get("precision_floor_60")) for s in ("spatial_holdout", "random_holdout")]
        report["operating_threshold"] = next(({**p, "source": s} for s, p in points if p), None)
        model = fit(df, columns, family, target, scale)
        report["importance"] = importances(model, df, columns, target, row_id)
    return model, report


def importance(model: PipelineModel, columns: list[str]) -> list[tuple[str, float]] | None:
    """Share of each feature: a tree's importances or a linear model's absolute coefficients, largest first; None for others."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        raw = last.featureImportances.toArray()
    elif hasattr(last, "coefficients"):
        raw = abs(last.coefficients.toArray())
    else:
        return None
    total = float(raw.sum()) or 1.0
    return sorted(((c, float(v) / total) for c, v in zip(columns, raw, strict=True)), key=lambda x: (-x[1], x[0]))


def importances(model: PipelineModel, df: DataFrame, columns: list[str], target: str, row_id: str) -> list[dict]:
    """Features by importance with the way it was found: the model's own, its coefficients, or by permutation."""
    own = importance(model, columns)
    method = "permutation_average_precision" if own is None else "model_feature_importance" if hasattr(model.stages[-1], "featureImportances") else "absolute_logistic_coefficient"
    found = permutation_importance(model, df, columns, target, row_id) if own is None else own
    return [{"feature": c, "importance": v, "normalized_importance": v, "method": method} for c, v in found]
