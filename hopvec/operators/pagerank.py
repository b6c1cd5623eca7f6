"""Static PageRank (fixed number of rounds) as a loop of join + ``groupBy(dst).sum``.

Rule per round: ``rank(v) = reset + (1 - reset) * sum_{u->v} rank(u) / outdeg(u)`` with
parallel edges counted separately and 0 for a vertex without messages. Ranks start at
1.0 and are finally scaled so that they sum to the number of vertices (0/0 gives NaN
when every rank is 0, e.g. on a DAG shorter than the number of rounds).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import conf_override, fixed, stored_input
from .edge_layout import compress_edges, lay_out
from .fastrp import hop_partitions


def pagerank(edges: DataFrame, num_iter: int = 5, reset: float = 0.0, num_partitions: int | None = None,
             share: int | None = None) -> DataFrame:
    """``(id, rank)`` for every endpoint of ``edges``. Parallel edges are shipped once, with their number; sources
    with more than ``share`` rows (by default an even share) are salted (see ``edge_layout``)."""
    spark = edges.sparkSession
    e = stored_input(compress_edges(edges.select("src", "dst").withColumn("weight", F.lit(1.0))).select("src", "dst", "n"))  # input computed once
    P = hop_partitions(spark, e.count(), 1, num_partitions)
    # a vertex carries its out-degree, so the edges need no join before they are laid out
    ends = e.select(F.col("src").alias("id"), "n").unionByName(e.select(F.col("dst").alias("id"), F.lit(0).cast("bigint").alias("n")))
    with conf_override(spark, {"spark.sql.shuffle.partitions": P}):
        layout = lay_out(e, P, share=share)
        verts = fixed(ends.groupBy("id").agg(F.sum("n").alias("out")))
        ranks = verts.withColumn("rank", F.lit(1.0))
        for _ in range(num_iter):
            contrib = layout.messages(ranks).select("dst", (F.col("rank") * (F.col("n") / F.col("out"))).alias("c"))
            sums = contrib.groupBy(F.col("dst").alias("id")).agg(F.sum("c").alias("s"))
            ranks = fixed(verts.join(sums, "id", "left").select(
                "id", "out", (F.lit(reset) + F.lit(1.0 - reset) * F.coalesce(F.col("s"), F.lit(0.0))).alias("rank")))
        return _normalized(ranks.select("id", "rank"))


def _normalized(ranks: DataFrame) -> DataFrame:
    # one global aggregate, two numbers to the driver
    tot = ranks.agg(F.sum("rank").alias("s"), F.count(F.lit(1)).alias("n")).first()
    if not tot["n"]:
        factor = 1.0                                     # no vertices: nothing to scale
    else:
        factor = float("inf") if tot["s"] == 0 else float(tot["n"]) / float(tot["s"])
    return fixed(ranks.select("id", (F.col("rank") * F.lit(factor)).alias("rank")))


def top_ranked(ranks: DataFrame, n: int = 25) -> DataFrame:
    """Global top ``n`` by rank (ties by id): a bounded per-partition heap, then one merge."""
    return ranks.orderBy(F.col("rank").desc(), F.col("id").asc()).limit(n)
