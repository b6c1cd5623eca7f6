"""Edge layout for loops that join edges with a vertex state: parallel edges shipped once, hot sources dealt out.

The state is hash-partitioned by its key and the edges by theirs, into the same number of partitions, so a
hop's join needs no exchange. Of a source with more rows than an even share (``rows / partitions``) only
that share stays with the state: the source gets ``ceil(rows / share)`` salts, each edge one of them (by hash of
its end), and the rows beyond salt 0 are partitioned by source and salt. For those the source's state is
repeated once for each salt and shuffled; there are fewer than two salts for each partition, whatever the number of
partitions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import fixed


def compress_edges(edges: DataFrame) -> DataFrame:
    """``(src, dst, weight, n)``: one row for parallel edges, with the sum of their weights and their number, so
    means over edges follow exactly. A null weight counts as 1.0; weights of 0 and below count as edges."""
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0))
    return (edges.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), weight.alias("w"))
            .groupBy("src", "dst").agg(F.sum("w").alias("weight"), F.count("*").alias("n")))


def even_share(rows: int, partitions: int) -> int:
    """Rows that one partition would hold if all held as many."""
    return max(1, math.ceil(rows / max(1, partitions)))


def salt_counts(degrees: DataFrame, share: int) -> DataFrame:
    """``(src, salts)`` of the sources of ``degrees (src, rows)`` above ``share`` rows. At most
    ``sum(rows) / share`` of them, with fewer than twice as many salts together."""
    return degrees.where(F.col("rows") > share).select("src", F.ceil(F.col("rows") / share).cast("int").alias("salts"))


@dataclass
class EdgeLayout:
    """``light`` edges (partitioned by source and ``by``) and, if there are hot sources, ``heavy`` edges (by source, salt and
    ``by``) with the ``salts (src, salt)`` beyond 0."""

    light: DataFrame
    heavy: DataFrame | None
    salts: DataFrame | None
    by: tuple[str, ...]

    def messages(self, state: DataFrame) -> DataFrame:
        """Every edge with the columns of ``state (id, *by, ..)`` of its source."""
        at = state.withColumnRenamed("id", "src")
        out = self.light.join(at, ["src", *self.by])
        if self.heavy is not None:
            copies = at.join(self.salts, "src")
            out = out.unionByName(self.heavy.join(copies, ["src", "salt", *self.by]).drop("salt"))
        return out


def lay_out(edges: DataFrame, partitions: int, by: dict | None = None, copies: int = 1, share: int | None = None) -> EdgeLayout:
    """Layout of ``edges (src, dst, ..)``, a table that is cheap to read again. ``by`` names further key columns and the
    expressions that make them (``copies`` rows for each edge). ``share``: rows of a source that may stay together,
    by default an even share of all."""
    by = by or {}
    degrees = fixed(edges.groupBy("src").agg(F.count("*").alias("rows")))
    rows = degrees.agg(F.sum("rows")).first()[0] or 0
    salted = fixed(salt_counts(degrees, share or even_share(rows * copies, partitions)))
    hot = salted.count() > 0
    keys = [expr.alias(name) for name, expr in by.items()]
    if not hot:
        light = edges.select("*", *keys)
    else:
        # fewer rows than partitions: the planner broadcasts them while they are small
        dealt = edges.join(salted, "src", "left")
        dealt = dealt.withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("dst"), "salts")).cast("int")).drop("salts")
        light = dealt.where("salt = 0").drop("salt").select("*", *keys)
    light = fixed(light.repartition(partitions, "src", *by).sortWithinPartitions("src", *by))
    if not hot:
        return EdgeLayout(light, None, None, tuple(by))
    heavy = fixed(dealt.where("salt > 0").select("*", *keys).repartition(partitions, "src", "salt", *by).sortWithinPartitions("src", "salt", *by))
    salts = fixed(salted.select("src", F.explode(F.sequence(F.lit(1), F.col("salts") - 1)).alias("salt")))
    return EdgeLayout(light, heavy, salts, tuple(by))
