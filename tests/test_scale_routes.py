"""Nested subsets, the replicated query scan and line numbers: equal results on every route, and plan shapes."""

import math
import tempfile
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopvec.operators import graph as G
from hopvec.operators import knn as K
from hopvec.session import conf_override
from hopvec.sources import io

LIMITS = [1, 3, 6, 20]


def _hosts(spark):
    v = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (4, "e"), (5, None), (6, "f"), (7, "f"), (None, "a")], "id bigint, host string")
    r = spark.createDataFrame([(1, "a"), (9, "a"), (2, "b"), (3, "c"), (5, "d"), (6, "e"), (15, "f"), (30, "z"), (2, None), (None, "c")], "hc_pos bigint, host_rev string")
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (3, 3), (1, 4), (4, 6), (6, 7), (5, 1), (None, 1), (9, 1)], "src bigint, dst bigint")
    return v, e, r


def test_nested_subsets_equal_single_runs(spark):
    v, e, r = _hosts(spark)
    path = f"{tempfile.mkdtemp(prefix='hopvec-nested-')}/{uuid.uuid4().hex}"
    io.save_nested(*G.nested_subsets(v, e, r, LIMITS), path)
    for n in LIMITS:
        got_v, got_e = io.load_nested(spark, path, n)
        want_v, want_e = G.induced_subgraph(v, e.withColumn("weight", F.lit(5.0)), r, n)
        assert sorted(map(tuple, got_v.collect())) == sorted(map(tuple, want_v.collect())), n
        assert sorted(map(tuple, got_e.collect())) == sorted(map(tuple, want_e.collect())), n


def test_nested_subsets_of_nothing(spark):
    v, e, r = _hosts(spark)
    for args in ((v.limit(0), e, r, LIMITS), (v, e.limit(0), r, LIMITS), (v, e, r.limit(0), LIMITS), (v, e, r, [])):
        sub_v, sub_e = G.nested_subsets(*args)
        assert sub_v.columns == ["id", "host", "level"] and sub_e.columns == ["src", "dst", "weight", "level"]
        assert sub_v.count() == 0 and sub_e.count() == 0


def _vectors(spark, n=400, d=6):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, d)).round(1)
    x[5] = 0.0
    x[50:60] = x[40:50]             # ties
    rows = [(i, [float(t) for t in x[i]]) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, x array<double>").repartition(7)


def _rows(df):
    return sorted((r.query, r.query_id, r["rank"], "nan" if math.isnan(r.dist) else round(r.dist, 9), r.id, r.name) for r in df.collect())


@pytest.mark.parametrize("unnamed", [K.UNNAMED_ROWS, 3])
def test_replicated_scan_equals_blocks(spark, monkeypatch, unnamed):
    monkeypatch.setattr(K, "UNNAMED_ROWS", unnamed)
    monkeypatch.setattr(K, "SCAN_CELLS", 50)        # several parts in every batch
    v = _vectors(spark)
    names = v.select("id", F.concat(F.lit("n"), F.col("id")).alias("name")).where("id % 3 <> 1")
    sites = ["n0", "n3", "n5", "n44", "n399"]
    a = K.knn_by_name(names, v, sites, 6)
    b = K.knn_by_name(names, v, sites, 6, block_rows=90, replicated_bytes=0)
    assert len(_rows(a)) == 5 * 7 and _rows(a) == _rows(b)
    for route in ({}, {"replicated_bytes": 0}):
        with pytest.raises(ValueError, match="n1'"):
            K.knn_by_name(names, v, ["n0", "n1"], 6, **route)


def test_replicated_scan_of_nothing(spark):
    v = _vectors(spark, 20)
    names = v.select("id", F.col("id").cast("string").alias("name"))
    assert K.knn_by_name(names, v, spark.createDataFrame([], "name string"), 3).count() == 0
    with pytest.raises(ValueError):
        K.knn_by_name(names, v.limit(0), ["3"], 3)


def test_replicated_scan_moves_no_vectors(spark):
    v = _vectors(spark)
    names = v.select("id", F.concat(F.lit("n"), F.col("id")).alias("name"))
    path = f"{tempfile.mkdtemp(prefix='hopvec-scan-')}/v"
    v.write.parquet(path)
    with conf_override(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        r = K.knn_by_name(names, spark.read.parquet(path), ["n1", "n2"], 4)
        tree = r._jdf.queryExecution().executedPlan().toString()
    below = tree[tree.index("MapInArrow"):].split("Scan parquet")[0]
    assert "Exchange" not in below and "Scan parquet" in tree, tree


@pytest.mark.parametrize("bound", [io.OFFSET_ROWS, 0])
def test_line_numbers_over_files_and_blocks(spark, monkeypatch, bound):
    monkeypatch.setattr(io, "OFFSET_ROWS", bound)
    path = tempfile.mkdtemp(prefix="hopvec-lines-")
    want = []
    for f, n in (("b", 900), ("a", 1), ("c", 0), ("d", 2500), ("e e", 3)):
        with open(f"{path}/{f}.txt", "w") as out:
            for i in range(n):
                out.write(f"{f}-{i}-{'x' * (i % 17)}\n")
    for f, n in (("a", 1), ("b", 900), ("d", 2500), ("e e", 3)):
        want += [f"{f}-{i}-{'x' * (i % 17)}" for i in range(n)]
    with conf_override(spark, {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "512"}):
        got = {r.line: r.value for r in io.line_numbers(spark, path).collect()}
    assert [got[i] for i in range(len(want))] == want and len(got) == len(want)


def test_edge_text_mode(spark):
    path = f"{tempfile.mkdtemp(prefix='hopvec-text-')}/e.txt"
    with open(path, "w") as out:
        out.write("  1 2 rest\n\n3 x\n4\n5 6\n")
    assert sorted((r.src, r.dst) for r in io.read_edges_text(spark, path, mode="DROPMALFORMED").collect()) == [(1, 2), (5, 6)]
    with pytest.raises(Exception, match="fewer than 2 fields|CAST_INVALID_INPUT"):
        io.read_edges_text(spark, path).collect()


def test_all_pairs_blocks_grow_with_the_table(spark):
    """Blocks of a fixed size shipped every vector n / 200 times and made (n / 200)^2 groups."""
    assert K.block_count(2000, 200, 64) == 10 and K.block_count(0, 200, 64) == 1
    assert K.block_count(400_000, 200, 64) == 16
    most = K.BLOCK_BYTES // (8 * 64)
    assert K.block_count(100 * most, 200, 64) == 100
    assert K.block_count(1000, 5, 6) == 16


def test_nearest_keeps_order_of_ties_and_nan():
    rng = np.random.default_rng(5)
    D = rng.integers(0, 6, size=(60, 40)).astype(float)
    D[rng.random(D.shape) < 0.3] = np.nan
    D[3] = np.nan
    for k in (1, 7, 40):
        rows, cols = K._nearest(D, k)
        want = np.argsort(D, axis=1, kind="stable")[:, :k]
        assert rows.tolist() == np.repeat(np.arange(60), k).tolist() and cols.tolist() == want.reshape(-1).tolist()


def test_pairs_without_vectors_never_meet_vectors(spark):
    from hopvec.operators.vector_tables import pairwise_distance
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [3.0, 0.0]), (None, [1.0, 1.0])], "id bigint, x array<float>")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 7), (7, 1), (2, 1), (9, 1), (None, 1), (7, 8)], "a bigint, b bigint")
    d = pairwise_distance(pairs, v, "euclidean")
    got = sorted((r.a, r.b, round(r.dist, 6)) for r in d.collect())
    assert got == [(1, 2, 1.414214), (1, 2, 1.414214), (1, 2, 2.0), (1, 2, 2.0), (2, 1, 1.414214), (2, 1, 2.0)]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftSemi") == 2, plan


def test_seeds_are_computed_once_for_each_vertex(spark):
    """The filter that a plain posexplode implies was pushed below the distinct, with the seed in it."""
    from hopvec.functions.seed import sparse_seed
    from hopvec.functions.vectors import long_form
    v = G.vertices_from_edges(spark.createDataFrame([(1, 2), (2, 3)], "src bigint, dst bigint"))
    out = long_form(v.select("id", sparse_seed("id", 4).alias("x")), "id", "x", None)
    assert out.count() == 12
    below = out._jdf.queryExecution().optimizedPlan().toString()
    below = below[below.index("Aggregate"):].split("\n", 1)[1]
    assert "transform(" not in below and "size(" not in below, below
    odd = spark.createDataFrame([(1, None), (2, []), (3, [0.5, None])], "id bigint, x array<double>")
    assert sorted(map(tuple, long_form(odd, digits=None).collect()), key=str) == [(3, 0, 0.5), (3, 1, None)]


def test_input_is_cut_finer_than_the_session(spark, monkeypatch):
    """Edges are grouped in as many tasks as their size needs, whatever the session's shuffle partitions."""
    from hopvec import session
    monkeypatch.setattr(session, "ADVISORY", "512k")
    df = spark.range(0, 400_000, 1, 4).select((F.xxhash64("id") % 1_000_000_007).alias("src"), F.xxhash64("id", F.lit(1)).alias("dst")).distinct()
    with conf_override(spark, {"spark.sql.shuffle.partitions": "1", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.enabled": "false"}):
        out = session.stored_input(df)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "1" and spark.conf.get("spark.sql.adaptive.enabled") == "false"
    assert out.count() == 400_000 and len(out.inputFiles()) > 4
