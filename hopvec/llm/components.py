"""Connected components of a link table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` for every id in ``links (a, b)``; ``root`` is the smallest id reachable.

    Each round takes the smallest root among the neighbours and then follows the root's own
    root (pointer jumping), so long chains need few rounds. Rounds end in a written
    table. Links with a null end and self-links add nothing; no links give no rows.
    """
    links = links.where("a is not null and b is not null and a <> b")
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    state = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")))
    while True:
        near = (both.join(state.select(F.col("id").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near")))
        met = state.join(near, state.id == near.a, "left").select("id", "root", F.least("root", "near").alias("m"))
        jump = state.select(F.col("id").alias("m"), F.col("root").alias("up"))
        step = stored(met.join(jump, "m", "left").select("id", F.col("root").alias("was"), F.least("m", "up").alias("root")))
        state = step.select("id", "root")
        if step.where("root <> was").isEmpty():
            return state
