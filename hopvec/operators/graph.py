"""Graph shape operators on an edge table ``(src bigint, dst bigint, weight double)`` and
a vertex table ``(id bigint, ...)``. A graph is just those two DataFrames.

Edges form a directed multigraph: parallel edges and self-loops are kept unless an
operator says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EDGE_COLS = ("src", "dst", "weight")


def as_edges(df: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = "weight",
             default_weight: float = 1.0) -> DataFrame:
    """Normalise column names/types; a missing weight column becomes ``default_weight``."""
    w = F.col(weight).cast("double") if weight and weight in df.columns else F.lit(float(default_weight))
    return df.select(F.col(src).cast("bigint").alias("src"), F.col(dst).cast("bigint").alias("dst"),
                     w.alias("weight"))


def symmetrize(edges: DataFrame) -> DataFrame:
    """``edges UNION ALL reversed(edges)``: no dedupe, so a self-loop or an edge present in
    both directions appears twice (as in the reference)."""
    rev = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"),
                       *[c for c in edges.columns if c not in ("src", "dst")])
    return edges.unionByName(rev)


def cast_weight(edges: DataFrame, to: str = "double") -> DataFrame:
    return edges.withColumn("weight", F.col("weight").cast(to))


def vertices_from_edges(edges: DataFrame) -> DataFrame:
    """All endpoints, once each (``Graph.fromEdges``). ``distinct`` pre-aggregates per map
    task, so a hub endpoint costs one row per task before the shuffle."""
    return (edges.select(F.explode(F.array("src", "dst")).alias("id"))
            .distinct())


def complete_vertices(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Given vertex rows, one for each id, plus every endpoint without a row (its attributes
    null). Of several rows of an id the smallest stays (by the columns in order, nulls first)."""
    rest = [c for c in vertices.columns if c != "id"]
    if rest:
        vertices = vertices.groupBy("id").agg(F.min(F.struct(*rest)).alias("_r")).select("id", *[F.col(f"_r.{c}").alias(c) for c in rest])
    else:
        vertices = vertices.distinct()
    missing = vertices_from_edges(edges).join(vertices.select("id"), "id", "left_anti")
    return vertices.unionByName(missing, allowMissingColumns=True)


def degrees(edges: DataFrame) -> DataFrame:
    """In+out degree; a self-loop counts twice; vertices with degree 0 are absent."""
    return (edges.select(F.explode(F.array("src", "dst")).alias("id"))
            .groupBy("id").agg(F.count(F.lit(1)).alias("degree")))


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))


def out_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))


def drop_isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Keep vertices that touch at least one edge (semi join, no degree column kept)."""
    return vertices.join(vertices_from_edges(edges), "id", "left_semi")


def dedupe_edges(edges: DataFrame, weight: float = 1.0) -> DataFrame:
    """One edge per (src, dst), attribute set to ``weight`` (the subset job's ``distinct``)."""
    return edges.select("src", "dst").distinct().withColumn("weight", F.lit(float(weight)))


def rank_filter(ranks: DataFrame, limit: int) -> DataFrame:
    """``hc_pos <= limit`` (pushed into the scan when ranks come from Parquet)."""
    return ranks.filter(F.col("hc_pos") <= F.lit(int(limit)))


def ranked_vertices(vertices: DataFrame, ranks: DataFrame, limit: int,
                    name_col: str = "host") -> DataFrame:
    """Vertices whose name is among the top ``limit`` ranks (each vertex once, also when
    names repeat). The ranks side is bounded by ``limit`` rows; AQE broadcasts it when it
    measures small."""
    top = rank_filter(ranks, limit).select(F.col("host_rev").alias(name_col))
    return vertices.join(top, name_col, "left_semi").select("id", name_col)


def edges_within(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """Edges whose two ends are both in ``keep(id)``: two semi joins (skewed hubs are split
    by AQE's skew-join handling)."""
    ids = keep.select("id")
    return (edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi")
            .join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
            .select(*edges.columns))


def induced_subgraph(vertices: DataFrame, edges: DataFrame, ranks: DataFrame, limit: int,
                     name_col: str = "host"):
    """Top-``limit`` ranked hosts, the distinct edges among them, isolated hosts dropped.
    Returns ``(vertices(id, name), edges(src, dst, weight=1.0))``."""
    kept = ranked_vertices(vertices, ranks, limit, name_col)
    sub_edges = dedupe_edges(edges_within(edges.select("src", "dst"), kept))
    sub_vertices = drop_isolated(kept, sub_edges)
    return sub_vertices, sub_edges


def nested_subsets(vertices: DataFrame, edges: DataFrame, ranks: DataFrame, limits, name_col: str = "host"):
    """``induced_subgraph`` for all ``limits`` from one pass: ``(vertices(id, name, level), edges(src, dst, weight,
    level))``, where ``level`` is the smallest limit whose subgraph holds the row. The subgraph of a limit is the
    rows with ``level <= limit``, so the subsets are stored once, as prefixes of levels.

    A host's level is the smallest limit that its best rank reaches, an edge's the larger of its ends'. A vertex is
    isolated until its first edge: its level is the larger of its host's and the least of its edges'. Rows beyond
    the largest limit go before any join. Null ranks, names and ends match nothing; without limits all is empty."""
    steps = sorted({int(n) for n in limits})
    if not steps:
        none = vertices.select("id", name_col, F.lit(0).cast("bigint").alias("level")).limit(0)
        return none, dedupe_edges(edges.limit(0)).withColumn("level", F.lit(0).cast("bigint"))

    def level_of(pos):
        reached = F.coalesce(*[F.when(pos <= n, F.lit(n)) for n in steps])
        return reached.cast("bigint")

    top = (rank_filter(ranks, steps[-1]).where(F.col("host_rev").isNotNull()).groupBy(F.col("host_rev").alias(name_col))
           .agg(level_of(F.min("hc_pos")).alias("_host")))
    hosts = vertices.join(top, name_col).select("id", name_col, "_host")
    ids = hosts.groupBy("id").agg(F.min("_host").alias("_id"))
    ends = (edges.select("src", "dst").join(ids.select(F.col("id").alias("src"), F.col("_id").alias("_s")), "src")
            .join(ids.select(F.col("id").alias("dst"), F.col("_id").alias("_d")), "dst"))
    # the level follows from the two ends, so parallel edges agree on it
    kept = ends.groupBy("src", "dst").agg(F.min(F.greatest("_s", "_d")).alias("level"))
    first = (kept.select(F.explode(F.array("src", "dst")).alias("id"), "level")
             .groupBy("id").agg(F.min("level").alias("_edge")))
    sub_vertices = hosts.join(first, "id").select("id", name_col, F.greatest("_host", "_edge").alias("level"))
    return sub_vertices, kept.select("src", "dst", F.lit(1.0).alias("weight"), "level")


def graph_summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """One row ``(n_vertices, n_edges)``: one aggregate over both tables, no join."""
    tagged = (vertices.select(F.lit(1).alias("v"), F.lit(0).alias("e"))
              .unionByName(edges.select(F.lit(0).alias("v"), F.lit(1).alias("e"))))
    return tagged.agg(F.sum("v").cast("bigint").alias("n_vertices"),
                      F.sum("e").cast("bigint").alias("n_edges"))


def tld_label(name_col: str = "host") -> "F.Column":
    """First dotted part of a reversed host (``com.nytimes`` -> ``com``)."""
    return F.get(F.split(F.col(name_col), r"\."), 0)
