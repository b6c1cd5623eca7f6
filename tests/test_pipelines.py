"""The four jobs from files. The input files are written from the sf0.001 driver tables in
the reference's file formats."""

import tempfile

from pyspark.sql import functions as F

from hopvec.plans import fixtures as fx
from hopvec.plans import pipelines as P
from hopvec.sources import io

SF = "/root/testdata/sf0.001"


def _tsv(df, path, header=False, sep="\t"):
    df.coalesce(1).write.mode("overwrite").option("header", header).option("sep", sep).csv(path)


def test_host_jobs(spark):
    d = tempfile.mkdtemp(prefix="hopvec-pipe-")
    names = fx.names_cp(spark, SF).select("id", F.col("name").alias("host"))
    _tsv(fx.ranks_cp(spark, SF), f"{d}/ranks", header=True)
    _tsv(names, f"{d}/vertices")
    _tsv(fx.edges_cp(spark, SF).select("src", "dst"), f"{d}/edges")
    sizes = {r.limit: r for r in P.host_subsets(spark, f"{d}/ranks", f"{d}/vertices", f"{d}/edges", f"{d}/out",
                                                  limits=[50, 100]).collect()}
    assert sizes[50].n_edges <= sizes[100].n_edges and sizes[100].n_vertices > 0
    v, e = io.load_graph(spark, f"{d}/out/top100", undirected=False)
    assert e.count() == sizes[100].n_edges and e.select("src", "dst").distinct().count() == e.count()

    sites = [r.host for r in v.orderBy("id").limit(2).collect()]
    out = P.host_embeddings(spark, f"{d}/out/top100", d=16, weights=[0.0, 1.0, 1.0], sites=sites, k=3)
    assert out["stats"].count() == 16
    nb = out["neighbours"].collect()
    assert len(nb) == 2 * 4 and {r.query for r in nb} == set(sites)
    acc = [r.value for r in out["classification"]["multiclass"].collect() if r.metric == "accuracy"][0]
    assert 0.0 <= acc <= 1.0


def test_social_and_kg_jobs(spark):
    d = tempfile.mkdtemp(prefix="hopvec-pipe-")
    _tsv(fx.edges_cp(spark, SF).select(F.col("src").alias("numeric_id_1"), F.col("dst").alias("numeric_id_2")),
         f"{d}/edges", header=True, sep=",")
    c = fx.table(spark, SF, "customer")
    feats = c.select(F.col("c_nationkey").alias("views"), (F.col("c_custkey") % 2).alias("mature"),
                     F.lit("a").alias("c2"), F.lit("b").alias("c3"), F.lit("c").alias("c4"),
                     F.col("c_custkey").alias("numeric_id"), F.lit("0").alias("c6"),
                     F.when(F.col("c_mktsegment") == "BUILDING", "EN").otherwise("DE").alias("language"),
                     (F.col("c_acctbal") > 4500).cast("int").alias("affiliate"))
    _tsv(feats, f"{d}/features", header=True, sep=",")
    out = P.social_graph(spark, f"{d}/edges", f"{d}/features", d=8, svm_iterations=20)
    s = out["summary"].first()
    assert s.n_edges == fx.edges_cp(spark, SF).count()
    assert out["pagerank_top25"].count() == 25
    assert out["by_english"].agg(F.sum("n")).first()[0] == c.count()
    assert out["classification"]["areas"].count() == 2

    vec = fx.vec(spark, SF).orderBy("id")
    n = vec.count()
    vec.select(F.concat_ws(" ", F.transform("x", lambda v: v.cast("string"))).alias("value")) \
        .coalesce(1).write.mode("overwrite").text(f"{d}/nodes")
    pairs = fx.copurchase_pairs(spark, SF).filter((F.col("a") < n) & (F.col("b") < n))
    pairs.select(F.concat_ws(" ", "a", "b", F.lit("x")).alias("value")).coalesce(1).write.mode("overwrite") \
        .text(f"{d}/kg_edges")
    kg = P.knowledge_graph(spark, f"{d}/nodes", f"{d}/kg_edges", f"{d}/emb" + io.embedding_suffix(P.KG_WEIGHTS))
    assert [r.id for r in kg["first10"].collect()] == list(range(10))
    lines = spark.read.text(kg["path"]).collect()
    assert len(lines) == n and len(lines[0].value.split(" ")) == 65
