"""The four end-to-end jobs, from input files to results, built from the operators.

Each returns a dict of DataFrames (lazy unless stated) instead of printing, so a caller
can ``show``, write or test them. Paths are arguments; nothing is fixed to a machine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.fastrp import fastrp
from ..operators.knn import knn_by_name
from ..operators.ml import classify_binary, classify_multiclass, label_index
from ..operators.pagerank import pagerank, top_ranked
from ..operators.stats import column_stats, column_stats_row, zscore
from ..session import materialize
from ..sources import io

# The host job's default settings and its 17 query sites, as given.
HOST_WEIGHTS = [0.0, 0.0, 1.0, 1.0, 0.5, 0.1, 0.025]
HOST_DIM = 256
HOST_R0 = 0.0001
HOST_SITES = ["com.nytimes", "com.arsenal", "com.delta", "com.latimes", "com.mckinsey", "com.wikihow",
              "com.hardrock", "com.renegadehealth", "com.google", "org.python", "com.twitter", "org.4chan",
              "com.apple", "org.scala-lang", "org.apache.spark", "org.scikit-learn", "org.tensorflow"]
SUBSET_LIMITS = [10_000, 200_000, 500_000, 1_000_000, 5_000_000]
SOCIAL_WEIGHTS = [0.0, 0.0, 1.0, 1.0]
SOCIAL_DIM = 32
KG_WEIGHTS = [0.75, 0.5, 0.25]
KG_R0 = 1.0


def host_subsets(spark: SparkSession, ranks_path: str, vertices_path: str, edges_path: str, out_root: str,
                 limits=SUBSET_LIMITS) -> DataFrame:
    """Induced subgraphs of the top-``limit`` hosts for several limits, each saved as
    Parquet under ``out_root/top<limit>``. The inputs are parsed and joined once for all limits: rows are
    stored by the smallest limit that holds them (``out_root/nested``), and each limit reads a prefix of that.
    Returns ``(limit, n_vertices, n_edges)``."""
    root = out_root.rstrip("/")
    vertices, edges = G.nested_subsets(io.read_vertices_tsv(spark, vertices_path), io.read_edges_tsv(spark, edges_path),
                                       io.read_ranks(spark, ranks_path, limit=None), limits)
    io.save_nested(vertices, edges, f"{root}/nested")
    rows = []
    for limit in limits:
        v, e = io.load_nested(spark, f"{root}/nested", limit)
        io.save_graph(v.withColumnRenamed("name", "host"), e, f"{root}/top{limit}")
        sv, se = io.load_graph(spark, f"{root}/top{limit}", undirected=False)
        s = G.graph_summary(sv, se).first()
        rows.append((int(limit), int(s["n_vertices"]), int(s["n_edges"])))
    return spark.createDataFrame(rows, "limit long, n_vertices long, n_edges long")


def host_embeddings(spark: SparkSession, graph_path: str, d: int = HOST_DIM, weights=HOST_WEIGHTS,
                    r0: float = HOST_R0, sites=HOST_SITES, k: int = 10, classify: bool = True,
                    zero_var: str = "zero", **fastrp_kw) -> dict:
    """Saved host graph -> symmetrised -> FastRP -> column statistics -> z-score ->
    TLD classification (random forest) -> k nearest hosts of each query site.

    A constant dimension z-scores to 0 here (``zero_var="zero"``): as NaN (the plain
    operator's default) it would make every cosine distance NaN and the classifier
    rejects NaN features."""
    vertices, edges = io.load_graph(spark, graph_path, undirected=True)
    emb = fastrp(vertices.select("id"), edges, d, weights, r0=r0, **fastrp_kw)
    stats_row = column_stats_row(emb).first()
    stats = {"mean": stats_row["mean"], "variance": stats_row["variance"]}
    normed = materialize(zscore(emb, stats=stats, zero_var=zero_var))
    out = {"embeddings": emb, "stats": column_stats(emb), "zscored": normed}
    names = vertices.select("id", F.col("host").alias("name"))
    if classify:
        labelled = names.select("id", G.tld_label("name").alias("tld"))
        idx = label_index(labelled, "tld")
        labels = labelled.join(idx.withColumnRenamed("label", "tld"), "tld").select(
            "id", F.col("label_idx").alias("label"))
        n_classes = idx.count()
        out["classification"] = classify_multiclass(normed, labels, kind="forest", num_classes=n_classes)
    if sites:
        present = names.filter(F.col("name").isin(list(sites))).select("name")
        out["neighbours"] = knn_by_name(names, normed, present, k)
    return out


def social_graph(spark: SparkSession, edges_csv: str, features_csv: str, d: int = SOCIAL_DIM,
                 weights=SOCIAL_WEIGHTS, svm_iterations: int = 400, **fastrp_kw) -> dict:
    """Directed member graph -> counts -> PageRank(5, 0) top 25 -> group counts ->
    FastRP -> binary classification of the ``affiliate`` flag with all metrics."""
    edges = io.read_edges_csv(spark, edges_csv)
    vertices = G.vertices_from_edges(edges)
    feats = io.read_member_features(spark, features_csv)
    ranks = pagerank(edges, 5, 0.0)
    emb = fastrp(vertices, edges, d, weights, **fastrp_kw)
    labels = feats.select(F.col("numeric_id").alias("id"), F.col("affiliate").cast("double").alias("label"))
    return {
        "summary": G.graph_summary(vertices, edges),
        "pagerank_top25": top_ranked(ranks, 25),
        "by_language": feats.groupBy("language").agg(F.count(F.lit(1)).cast("double").alias("n")),
        "by_english": feats.groupBy("english").agg(F.count(F.lit(1)).cast("double").alias("n")),
        "embeddings": emb,
        "classification": classify_binary(emb, labels, kind="svm", max_iter=svm_iterations),
    }


def knowledge_graph(spark: SparkSession, features_path: str, edges_path: str, out_path: str | None = None,
                    weights=KG_WEIGHTS, r0: float = KG_R0, init: bool = True, d: int | None = None,
                    **fastrp_kw) -> dict:
    """Text vectors as initial embeddings (id = line number) over the symmetrised edge
    file -> FastRP -> first 10 ids -> embeddings written as text lines with the id."""
    vertices, edges = io.load_kg_graph(spark, features_path, edges_path, undirected=True)
    if d is None:
        if init:
            first = vertices.select(F.size("x")).first()      # the width of one vector
            d = int(first[0])
        else:
            d = 8
    emb = fastrp(vertices if init else vertices.select("id"), edges, d, weights, r0=r0, init=init, **fastrp_kw)
    out = {"embeddings": emb, "first10": emb.orderBy("id").limit(10)}
    if out_path:
        io.save_embeddings(emb, out_path, fmt="text", with_id=True)
        out["path"] = out_path
    return out
