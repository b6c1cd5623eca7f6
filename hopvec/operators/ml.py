"""Classifiers on embeddings: scale, split, train, predict, score.

The split is a hash of the id (``md5(id:seed)``), so it is the same on any partitioning
and can be written in SQL; ``random_split`` keeps Spark's Bernoulli sampler as an option.
The scaler is fitted on all rows before the split, as in the reference.
"""

from __future__ import annotations

from pyspark.ml.classification import (LinearSVC, LogisticRegression, NaiveBayes,
                                       RandomForestClassifier)
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .metrics import binary_areas, binary_metrics, confusion_counts, cumulative_label_counts, multiclass_metrics
from .ordered import global_row_number
from .stats import standardize
from .svm import fit_svm, svm_margin


def hash_bucket(id_col="id", seed: int = 42) -> "F.Column":
    """``int(first 8 hex digits of md5('<id>:<seed>'), 16) % 10000`` in [0, 10000)."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    h = F.substring(F.md5(F.concat(c.cast("string"), F.lit(f":{seed}"))), 1, 8)
    return (F.conv(h, 16, 10).cast("bigint") % F.lit(10000)).cast("int")


def hash_split(df: DataFrame, fractions=(0.7, 0.3), seed: int = 42, id_col: str = "id"):
    """Deterministic split by id into ``len(fractions)`` parts (cumulative cut points)."""
    tot = float(sum(fractions))
    cuts, acc = [], 0.0
    for f in fractions:
        acc += f / tot
        cuts.append(int(round(acc * 10000)))
    b = hash_bucket(id_col, seed)
    parts, lo = [], 0
    for hi in cuts:
        parts.append(df.filter((b >= F.lit(lo)) & (b < F.lit(hi))))
        lo = hi
    return parts


def split_assignment(df: DataFrame, fractions=(0.7, 0.3), seed: int = 42, id_col: str = "id") -> DataFrame:
    """``(id, split)`` with ``split`` = index of the part (0 = train)."""
    tot = float(sum(fractions))
    b = hash_bucket(id_col, seed)
    expr, acc = None, 0.0
    for i, f in enumerate(fractions):
        acc += f / tot
        cond = b < F.lit(int(round(acc * 10000)))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return df.select(F.col(id_col).alias("id"), expr.otherwise(F.lit(len(fractions) - 1)).alias("split"))


def random_split(df: DataFrame, fractions=(0.7, 0.3), seed: int = 42):
    return df.randomSplit(list(fractions), seed)


def labelled_points(embeddings: DataFrame, labels: DataFrame, x_col: str = "x", label_col: str = "label",
                    num_classes: int | None = None) -> DataFrame:
    """Inner join (unlabelled vertices dropped): ``(id, label double, features vector)``.
    With ``num_classes`` the label carries nominal metadata, so classifiers take the class
    count from it (no inference limit of 100 classes)."""
    label = F.col(label_col).cast("double")
    if num_classes is not None:
        label = label.alias("label", metadata={"ml_attr": {"type": "nominal", "num_vals": int(num_classes)}})
    else:
        label = label.alias("label")
    return (embeddings.select("id", x_col).join(labels.select("id", label_col), "id")
            .select("id", label, array_to_vector(F.col(x_col).cast("array<double>")).alias("features")))


def scale_features(points: DataFrame) -> DataFrame:
    model = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(points)
    return model.transform(points).drop("features").withColumnRenamed("scaled", "features")


def make_model(kind: str, num_classes: int = 2, max_iter: int = 400, seed: int = 42,
               num_trees: int = 16, max_depth: int = 8, max_bins: int = 32):
    if kind == "linear_svc":
        return LinearSVC(maxIter=max_iter, regParam=0.01, fitIntercept=False, standardization=False)
    if kind == "logreg":
        return LogisticRegression(maxIter=max_iter, family="multinomial" if num_classes > 2 else "binomial")
    if kind == "forest":
        return RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, maxBins=max_bins, impurity="gini",
                                      featureSubsetStrategy="auto", seed=seed)
    if kind == "bayes":
        return NaiveBayes(modelType="gaussian")
    raise ValueError(f"unknown model {kind!r}")


def train_and_predict(points: DataFrame, kind: str, num_classes: int = 2, seed: int = 42, **kw) -> DataFrame:
    """Scale on all rows, hash split 0.7 / 0.3, fit on train, predict test:
    ``(id, label, prediction, score)``; ``score`` is the margin / probability of class 1
    where the model has one, else the prediction. ``svm`` is trained by subgradient descent
    (``max_iter`` rounds), every other kind by ``pyspark.ml``."""
    if kind == "svm":
        x = points.select("id", "label", vector_to_array("features").alias("x"))
        train, test = hash_split(cut_lineage(standardize(x)), (0.7, 0.3), seed)
        score = svm_margin("x", fit_svm(train, kw.get("max_iter", 400)))
        return test.select("id", "label", F.when(score > 0, 1.0).otherwise(0.0).alias("prediction"), score.alias("score"))
    scaled = cut_lineage(scale_features(points))       # every training pass and the prediction read it
    train, test = hash_split(scaled, (0.7, 0.3), seed)
    model = make_model(kind, num_classes, seed=seed, **kw).fit(train)
    out = model.transform(test)
    if "rawPrediction" in out.columns and num_classes == 2:
        raw = vector_to_array("rawPrediction")
        score = F.element_at(raw, 2) - F.element_at(raw, 1) if kind == "linear_svc" else F.element_at(raw, 2)
    else:
        score = F.col("prediction")
    return out.select("id", "label", "prediction", score.cast("double").alias("score"))


def classify_binary(embeddings: DataFrame, labels: DataFrame, kind: str = "svm", seed: int = 42,
                    label_col: str = "label", **kw) -> dict:
    """Binary chain of the social pipeline. Returns the predictions and the metric tables."""
    # predicted once and counted once for all tables of the report
    pred = cut_lineage(train_and_predict(labelled_points(embeddings, labels, label_col=label_col), kind, 2, seed, **kw))
    counts = cumulative_label_counts(pred, "prediction", "label")
    return {
        "predictions": pred,
        "threshold_metrics": binary_metrics(pred, "prediction", "label", counts),
        "areas": binary_areas(pred, "prediction", "label", counts),
        "multiclass": multiclass_metrics(pred),
        "confusion": confusion_counts(pred, threshold=0.0),
    }


def classify_multiclass(embeddings: DataFrame, labels: DataFrame, kind: str = "forest", seed: int = 42,
                        label_col: str = "label", num_classes: int | None = None, **kw) -> dict:
    """Multiclass chain of the host pipeline (labels already indexed 0..n-1)."""
    if num_classes is None:
        num_classes = int(labels.agg(F.max(label_col)).first()[0]) + 1
    points = labelled_points(embeddings, labels, label_col=label_col, num_classes=num_classes)
    pred = cut_lineage(train_and_predict(points, kind, num_classes, seed, **kw))
    return {"predictions": pred, "multiclass": multiclass_metrics(pred)}


def class_share(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``(label, n, share)``: count per label over the total (one row per class)."""
    from pyspark.sql import Window
    c = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("label", "n", (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def label_index(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``(label, label_idx double)``: labels numbered 0..n-1 in alphabetical order (a
    deterministic version of ``distinct().zipWithIndex()``). Nulls get no number. Any number of
    labels: they are numbered where they are, and no label reaches the driver."""
    d = df.select(F.col(label_col).alias("label")).filter(F.col("label").isNotNull()).distinct()
    return global_row_number(d, [F.col("label")], "_k", 0).select("label", F.col("_k").cast("double").alias("label_idx"))
