"""Classification metrics as DataFrame aggregates (binary and multiclass).

Binary metrics follow MLlib's ``BinaryClassificationMetrics`` without binning: one
threshold per distinct score, cumulative true/false positive counts in descending score
order. The cumulative counts are computed without a global sort in one task: scores are
aggregated first (one row per distinct score), dealt into ``P`` score ranges, each range
computes its running sums in its own task, and the per-range offsets (``P`` rows) are added.
Reports that need several tables compute the cumulative counts once and hand them over. Curve areas need the
previous point of the curve; it follows from the cumulative counts minus the row's own
counts, so the trapezoids are a plain sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def _as_double(c):
    return F.col(c).cast("double")


def confusion_counts(pred: DataFrame, prediction: str = "prediction", label: str = "label",
                     threshold: float | None = None) -> DataFrame:
    """``(prediction, label, n double)``; with ``threshold`` the prediction is first turned
    into ``1.0 if p > threshold else 0.0`` (the reference's zero threshold)."""
    p = _as_double(prediction)
    if threshold is not None:
        p = F.when(p > F.lit(float(threshold)), F.lit(1.0)).otherwise(F.lit(0.0))
    return (pred.select(p.alias("prediction"), _as_double(label).alias("label"))
            .groupBy("prediction", "label").agg(F.count(F.lit(1)).cast("double").alias("n")))


def confusion_matrix(pred: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """``(prediction, label, n double)`` for every pair of classes, also those that never occur together
    (``n`` = 0). Classes are the true labels and the predicted ones, nulls left out; the matrix has as many rows
    as pairs of classes, whatever the size of ``pred``."""
    counts = cut_lineage(confusion_counts(pred, prediction, label).where("prediction is not null and label is not null"))
    classes = counts.select(F.explode(F.array("prediction", "label")).alias("label")).distinct()
    # each class carries the list of all classes: an explode in place of a product of two tables
    every = classes.agg(F.array_sort(F.collect_list("label")).alias("all")).select(F.explode("all").alias("prediction"), F.col("all"))
    cells = every.select("prediction", F.explode("all").alias("label"))
    return cells.join(counts, ["prediction", "label"], "left").select("prediction", "label", F.coalesce("n", F.lit(0.0)).alias("n"))


def multiclass_metrics(pred: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    """Long table ``(metric, label, value)`` with MLlib's ``MulticlassMetrics`` rules:
    ``accuracy``, per label ``precision`` / ``recall`` / ``fpr`` / ``f1`` (label set =
    true labels; 0 when a denominator is empty, FPR NaN with one class) and the
    label-frequency weighted ``weighted_precision``, ``weighted_recall``, ``weighted_f1``,
    ``weighted_fpr``. Everything after the first aggregate works on ``classes^2`` rows."""
    cm = confusion_counts(pred, prediction, label)
    by_label = cm.groupBy("label").agg(F.sum("n").alias("n_label"),
                                       F.sum(F.when(F.col("prediction") == F.col("label"), F.col("n"))
                                             .otherwise(0.0)).alias("tp"))
    by_pred = cm.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("n_pred"))
    per = (by_label.join(by_pred, "label", "left")      # one row per class from here on
           .select("label", "tp", "n_label", F.coalesce("n_pred", F.lit(0.0)).alias("n_pred"),
                   F.sum("n_label").over(Window.partitionBy()).alias("total")))
    precision = F.when(F.col("n_pred") == 0, F.lit(0.0)).otherwise(F.col("tp") / F.col("n_pred"))
    recall = F.col("tp") / F.col("n_label")
    fp = F.col("n_pred") - F.col("tp")
    neg = F.col("total") - F.col("n_label")
    fpr = F.when(neg == 0, F.lit(float("nan"))).otherwise(fp / neg)
    per = per.select("label", precision.alias("precision"), recall.alias("recall"), fpr.alias("fpr"),
                     (F.col("n_label") / F.col("total")).alias("share"), "tp", "total")
    f1 = F.when(F.col("precision") + F.col("recall") == 0, F.lit(0.0)).otherwise(
        F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    per = per.withColumn("f1", f1)
    long_rows = per.select("label", F.explode(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("precision", "recall", "fpr", "f1")]
    )).alias("m")).select("m.metric", "label", "m.value")
    overall = per.agg(
        (F.sum("tp") / F.first("total")).alias("accuracy"),
        F.sum(F.col("precision") * F.col("share")).alias("weighted_precision"),
        F.sum(F.col("recall") * F.col("share")).alias("weighted_recall"),
        F.sum(F.col("f1") * F.col("share")).alias("weighted_f1"),
        F.sum(F.col("fpr") * F.col("share")).alias("weighted_fpr"))
    overall_rows = overall.select(F.explode(F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
          for m in ("accuracy", "weighted_precision", "weighted_recall", "weighted_f1", "weighted_fpr")]
    )).alias("m")).select("m.metric", F.lit(None).cast("double").alias("label"), "m.value")
    return long_rows.unionByName(overall_rows)


def cumulative_label_counts(scored: DataFrame, score: str = "score", label: str = "label",
                            num_ranges: int | None = None) -> DataFrame:
    """One row per distinct score, descending order implied by the cumulative columns:
    ``(threshold, pos, neg, cum_pos, cum_neg, total_pos, total_neg)``."""
    spark = scored.sparkSession
    P = int(num_ranges or int(spark.conf.get("spark.sql.shuffle.partitions")))
    per_score = (scored.select(_as_double(score).alias("threshold"), _as_double(label).alias("y"))
                 .groupBy("threshold")
                 .agg(F.sum(F.when(F.col("y") > 0.5, 1).otherwise(0)).cast("bigint").alias("pos"),
                      F.sum(F.when(F.col("y") > 0.5, 0).otherwise(1)).cast("bigint").alias("neg")))
    # written once with its range number (ranges descend; NaN sorts highest): the ranged rows and
    # the range totals read it instead of scanning the scored table twice
    ranged = cut_lineage(per_score.repartitionByRange(P, F.col("threshold").desc_nulls_first())
                         .withColumn("rng", F.spark_partition_id()))
    totals = ranged.groupBy("rng").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))   # <= P rows
    wo = Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("rng", F.coalesce(F.sum("rp").over(wo), F.lit(0)).alias("op"),
                            F.coalesce(F.sum("rn").over(wo), F.lit(0)).alias("on"),
                            F.sum("rp").over(Window.partitionBy()).alias("total_pos"),
                            F.sum("rn").over(Window.partitionBy()).alias("total_neg"))
    wr = (Window.partitionBy("rng").orderBy(F.col("threshold").desc_nulls_first())
          .rowsBetween(Window.unboundedPreceding, 0))
    return (ranged.join(F.broadcast(offsets), "rng")       # offsets: one row per range
            .select("threshold", "pos", "neg",
                    (F.sum("pos").over(wr) + F.col("op")).alias("cum_pos"),
                    (F.sum("neg").over(wr) + F.col("on")).alias("cum_neg"),
                    "total_pos", "total_neg"))


def _rates(cum_pos, cum_neg, P, N):
    precision = F.when(cum_pos + cum_neg == 0, F.lit(1.0)).otherwise(cum_pos / (cum_pos + cum_neg))
    recall = F.when(P == 0, F.lit(0.0)).otherwise(cum_pos / P)
    fpr = F.when(N == 0, F.lit(0.0)).otherwise(cum_neg / N)
    return precision, recall, fpr


def _fmeasure(p, r, beta):
    b2 = beta * beta
    return F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(1.0 + b2) * p * r / (F.lit(b2) * p + r))


def binary_metrics(scored: DataFrame, score: str = "score", label: str = "label",
                   cumulative: DataFrame | None = None) -> DataFrame:
    """Per threshold: ``(threshold, precision, recall, fpr, f1, f05)``; ``cumulative``:
    ``cumulative_label_counts`` of the same rows, where it exists already."""
    c = cumulative_label_counts(scored, score, label) if cumulative is None else cumulative
    P, N = F.col("total_pos").cast("double"), F.col("total_neg").cast("double")
    p, r, fpr = _rates(F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double"), P, N)
    return c.select("threshold", p.alias("precision"), r.alias("recall"), fpr.alias("fpr")).select(
        "*", _fmeasure(F.col("precision"), F.col("recall"), 1.0).alias("f1"),
        _fmeasure(F.col("precision"), F.col("recall"), 0.5).alias("f05"))


def _curve_terms(scored, score, label, cumulative=None):
    c = cumulative_label_counts(scored, score, label) if cumulative is None else cumulative
    P, N = F.col("total_pos").cast("double"), F.col("total_neg").cast("double")
    cp, cn = F.col("cum_pos").cast("double"), F.col("cum_neg").cast("double")
    pp, pn = cp - F.col("pos"), cn - F.col("neg")          # the previous curve point
    p, r, fpr = _rates(cp, cn, P, N)
    p0, r0, fpr0 = _rates(pp, pn, P, N)
    first = (pp + pn) == 0
    p0 = F.when(first, p).otherwise(p0)                    # PR curve starts at (0, p_first)
    return c.select("threshold", p.alias("precision"), r.alias("recall"), fpr.alias("fpr"),
                    ((r - r0) * (p + p0) / 2).alias("pr_area"),
                    ((fpr - fpr0) * (r + r0) / 2).alias("roc_area"),
                    first.alias("is_first"))


def binary_areas(scored: DataFrame, score: str = "score", label: str = "label",
                 cumulative: DataFrame | None = None) -> DataFrame:
    """``(metric, value)`` rows ``area_under_roc`` and ``area_under_pr`` (trapezoids)."""
    t = _curve_terms(scored, score, label, cumulative)
    a = t.agg(F.sum("roc_area").alias("area_under_roc"), F.sum("pr_area").alias("area_under_pr"))
    return a.select(F.explode(F.array(
        F.struct(F.lit("area_under_roc").alias("metric"), F.col("area_under_roc").alias("value")),
        F.struct(F.lit("area_under_pr").alias("metric"), F.col("area_under_pr").alias("value")))).alias("m")
    ).select("m.metric", "m.value")


def roc_curve(scored: DataFrame, score: str = "score", label: str = "label",
              cumulative: DataFrame | None = None) -> DataFrame:
    """``(fpr, tpr)``: (0,0), one point per threshold, then (1,1) (kept even if repeated)."""
    t = _curve_terms(scored, score, label, cumulative).select("fpr", F.col("recall").alias("tpr"))
    ends = scored.sparkSession.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "fpr double, tpr double")
    return t.unionByName(ends)


def pr_curve(scored: DataFrame, score: str = "score", label: str = "label",
             cumulative: DataFrame | None = None) -> DataFrame:
    """``(recall, precision)``: (0, precision at the highest threshold), then one point per threshold."""
    t = _curve_terms(scored, score, label, cumulative)
    start = t.filter(F.col("is_first")).select(F.lit(0.0).alias("recall"), "precision")
    return t.select("recall", "precision").unionByName(start)
