"""Table jobs over vector tables ``(id, x array<double>)`` built from the column helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import (cosine_distance, euclidean_distance, vec_normalize, vec_scale,
                                 vec_to_text, same_length)

METRICS = {"cosine": cosine_distance, "euclidean": euclidean_distance}


def normalize_embeddings(vectors: DataFrame, x_col: str = "x") -> DataFrame:
    """L2-normalise each vector (zero vectors unchanged)."""
    others = [c for c in vectors.columns if c != x_col]
    return vectors.select(*others, vec_normalize(F.col(x_col).cast("array<double>")).alias(x_col))


def combine_embeddings(a: DataFrame, b: DataFrame, wa: float = 1.0, wb: float = 1.0, x_col: str = "x",
                       how: str = "inner") -> DataFrame:
    """``wa * a + wb * b`` per id (inner join; ``how="left"`` keeps ``wa * a`` where ``b``
    has no row, the reference's outer-join-and-add)."""
    ja = a.select("id", F.col(x_col).cast("array<double>").alias("_a"))
    jb = b.select("id", F.col(x_col).cast("array<double>").alias("_b"))
    j = ja.join(jb, "id", how)
    summed = F.when(same_length("_a", "_b"),
                    F.zip_with("_a", "_b", lambda x, y: F.lit(float(wa)) * x + F.lit(float(wb)) * y))
    out = F.when(F.col("_b").isNull(), vec_scale("_a", wa)).otherwise(summed) if how != "inner" else summed
    return j.select("id", out.alias(x_col))


def pairwise_distance(pairs: DataFrame, vectors: DataFrame, metric: str = "cosine", a: str = "a", b: str = "b",
                      x_col: str = "x") -> DataFrame:
    """``(a, b, dist)`` for each pair whose two ends have a vector. Pairs without go first, by the ids alone (the
    planner takes these joins below a distinct or a join that makes the pairs), so only pairs of the result meet
    vectors; these travel as they are stored and become doubles after the joins."""
    f = METRICS[metric]
    ids = vectors.select("id").distinct()
    known = (pairs.select(a, b).join(ids.withColumnRenamed("id", a), a, "left_semi")
             .join(ids.withColumnRenamed("id", b), b, "left_semi"))
    va = vectors.select(F.col("id").alias(a), F.col(x_col).alias("_xa"))
    vb = vectors.select(F.col("id").alias(b), F.col(x_col).alias("_xb"))
    return (known.join(va, a).join(vb, b)
            .select(a, b, f(F.col("_xa").cast("array<double>"), F.col("_xb").cast("array<double>")).alias("dist")))


def embeddings_as_text(vectors: DataFrame, x_col: str = "x", with_id: bool = True, sep: str = " ") -> DataFrame:
    """One text line per vector: ``id<sep>v1<sep>v2...`` (or only the values)."""
    line = vec_to_text(x_col, sep)
    if with_id:
        line = F.concat_ws(sep, F.col("id").cast("string"), line)
    return vectors.select(line.alias("value"))
