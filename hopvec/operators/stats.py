"""Column statistics of a vector table, z-score and standard scaling."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STAT_NAMES = ("max", "min", "variance", "mean", "norm_l1", "norm_l2")


def column_stats(vectors: DataFrame, x_col: str = "x") -> DataFrame:
    """``(pos, max, min, variance, mean, norm_l1, norm_l2)``: per dimension max, min, sample variance
    (n-1; 0 for a single row), mean, L1 norm, L2 norm.

    Each task keeps one row of mergeable moments per dimension (count, mean, squared deviations, extremes, sums);
    those rows are merged by dimension, so no task ever holds the moments of all dimensions.
    """
    v = F.col("v")
    return (vectors.select(F.posexplode(F.col(x_col).cast("array<double>")).alias("pos", "v"))
            .groupBy("pos").agg(F.max(v).alias("max"), F.min(v).alias("min"), F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"),
                                F.avg(v).alias("mean"), F.sum(F.abs(v)).alias("norm_l1"), F.sqrt(F.sum(v * v)).alias("norm_l2")))


def column_stats_row(vectors: DataFrame, x_col: str = "x") -> DataFrame:
    """``column_stats`` as one row of six ``array<double>`` (``6 d`` numbers)."""
    rows = F.array_sort(F.collect_list(F.struct("pos", *STAT_NAMES))).alias("s")
    return column_stats(vectors, x_col).agg(rows).select(*[F.col(f"s.{c}").alias(c) for c in STAT_NAMES])


def zscore(vectors: DataFrame, x_col: str = "x", stats: dict | None = None, zero_var: str = "nan") -> DataFrame:
    """``(x - mean) / sqrt(variance)`` per dimension. The statistics are one bounded row
    (``2 d`` numbers) that enter the plan as literals, like a broadcast. A constant
    dimension gives 0/0 = NaN (``zero_var="nan"``, the reference) or 0 (``"zero"``)."""
    if zero_var not in ("nan", "zero"):
        raise ValueError("zero_var must be 'nan' or 'zero'")
    if stats is None:
        r = column_stats_row(vectors, x_col).select("mean", "variance").first()
        stats = {"mean": r["mean"], "variance": r["variance"]}
    mean = F.array(*[F.lit(float(v)) for v in stats["mean"]])
    sd = F.array(*[F.lit(float(v) ** 0.5) for v in stats["variance"]])
    pairs = F.arrays_zip(F.col(x_col).cast("array<double>").alias("x"), mean.alias("m"), sd.alias("s"))

    def one(e):
        num = e["x"] - e["m"]
        if zero_var == "zero":
            return F.when(e["s"] == 0, F.lit(0.0)).otherwise(num / e["s"])
        return (F.when(e["s"] != 0, num / e["s"])
                .when(num == 0, F.lit(float("nan")))
                .when(num > 0, F.lit(float("inf")))
                .otherwise(F.lit(float("-inf"))))

    others = [c for c in vectors.columns if c != x_col]
    return vectors.select(*others, F.transform(pairs, one).alias(x_col))


def standardize(vectors: DataFrame, x_col: str = "x", with_mean: bool = True, with_std: bool = True) -> DataFrame:
    """``pyspark.ml.feature.StandardScaler`` on the vector column (sample std; a constant
    dimension becomes 0.0). Fitted on all rows given."""
    v = vectors.withColumn("_v", array_to_vector(F.col(x_col).cast("array<double>")))
    model = StandardScaler(inputCol="_v", outputCol="_s", withMean=with_mean, withStd=with_std).fit(v)
    others = [c for c in vectors.columns if c != x_col]
    return model.transform(v).select(*others, vector_to_array("_s").alias(x_col))
