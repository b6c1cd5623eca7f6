import os
import re
import tempfile

import pytest
from pyspark.errors import AnalysisException

from hopvec.sources import io


def _write(folder, name, text):
    p = os.path.join(folder, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_readers_by_position(spark):
    d = tempfile.mkdtemp(prefix="hopvec-io-")
    edges = _write(d, "edges.csv", "numeric_id_1,numeric_id_2\n0,1\n1,2\n")
    feats = _write(d, "features.csv", "views,mature,c2,c3,c4,numeric_id,c6,language,affiliate\n"
                                      "7879,1,a,b,c,0,0,EN,1\n12,0,a,b,c,1,0,DE,0\n")
    ranks = _write(d, "ranks.txt", "#hc_pos\thc_val\tpr_pos\tpr_val\thost_rev\n1\t2.5E7\t1\t0.01\tcom.example\n"
                                   "2\t1.0E7\t5\t0.001\torg.example\n")
    verts = _write(d, "vertices.txt", "0\tcom.example\n1\torg.example\n")
    tsv = _write(d, "edges.txt", "0\t1\n1\t0\n")
    kg_e = _write(d, "kg_edges.txt", "0 1 extra\n1 2 x y\n")
    kg_v = _write(d, "nodes_feature.txt", "0.5 -0.25 1.0\n1 2 3\n-1 0 0\n")

    e = io.read_edges_csv(spark, edges).collect()
    assert [(r.src, r.dst, r.weight) for r in e] == [(0, 1, 1.0), (1, 2, 1.0)]
    f = {r.numeric_id: r for r in io.read_member_features(spark, feats).collect()}
    assert f[0].views == 7879 and f[0].english == 1 and f[1].english == 0 and f[1].affiliate == 0
    r = io.read_ranks(spark, ranks, limit=1).collect()
    assert len(r) == 1 and r[0].host_rev == "com.example" and r[0].hc_val == 2.5e7
    assert {x.id: x.host for x in io.read_vertices_tsv(spark, verts).collect()} == {0: "com.example", 1: "org.example"}
    assert io.read_edges_tsv(spark, tsv).count() == 2
    ke = io.read_edges_text(spark, kg_e, undirected=True).collect()
    assert sorted((x.src, x.dst) for x in ke) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    kv = {x.id: x.x for x in io.read_vectors_text(spark, kg_v).collect()}
    assert kv == {0: [0.5, -0.25, 1.0], 1: [1.0, 2.0, 3.0], 2: [-1.0, 0.0, 0.0]}

    bad = _write(d, "bad.tsv", "0\t1\nx\t2\n")
    with pytest.raises(Exception):
        io.read_edges_tsv(spark, bad).collect()
    assert io.read_edges_tsv(spark, bad, mode="DROPMALFORMED").count() == 1


def test_line_numbers_many_blocks(spark):
    d = tempfile.mkdtemp(prefix="hopvec-io-")
    lines = [f"{i} {i * 0.5}" for i in range(20000)]
    _write(d, "a.txt", "\n".join(lines[:12000]) + "\n")
    _write(d, "b.txt", "\n".join(lines[12000:]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = io.read_vectors_text(spark, d).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert all(r.x[0] == float(r.id) for r in got) and len(got) == 20000


def test_graph_and_embedding_round_trip(spark):
    d = tempfile.mkdtemp(prefix="hopvec-io-")
    v = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    e = spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, weight double")
    io.save_graph(v, e, d + "/g")
    v2, e2 = io.load_graph(spark, d + "/g")
    assert v2.count() == 2 and sorted((r.src, r.dst) for r in e2.collect()) == [(1, 2), (2, 1)]
    emb = spark.createDataFrame([(1, [0.5, 1.0])], "id long, x array<double>")
    io.save_embeddings(emb, d + "/p")
    with pytest.raises(AnalysisException):
        io.save_embeddings(emb, d + "/p")
    with pytest.raises(AnalysisException):
        io.save_graph(v, e, d + "/g")
    io.save_embeddings(emb, d + "/p", mode="overwrite")
    assert spark.read.parquet(d + "/p").first().x == [0.5, 1.0]
    io.save_embeddings(emb, d + "/t", fmt="text")
    assert spark.read.text(d + "/t").first().value == "1 0.5 1.0"
    assert io.embedding_suffix([0.75, 0.5, 0.25]) == "_fastRP_(0.75_0.5_0.25)"


def test_driver_contract(spark):
    import __spark_entry__ as ent
    df = ent.entry(spark)
    rows = df.collect()
    assert df.columns == ["dist", "id", "name"] and len(rows) == 11 and rows[0].id == 0
    q, s = ent.queries(), ent.oracle_sql()
    assert set(s) <= set(q)
    own = {k for k in q if not re.match(r"op[0-9]+_|pipeline$", k)}
    assert own - set(s) == {"classify_binary", "classify_multiclass"}


def test_some_queries_against_duckdb(spark):
    """A fast subset of the oracle check at sf0.001 (the full one is tools/check_oracle.py)."""
    import duckdb

    import __spark_entry__ as ent
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("customer", "part", "orders", "lineitem", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    q, s = ent.queries(), ent.oracle_sql()
    for name in ("fastrp_carry", "fastrp_freeze", "pagerank", "induced_subgraph", "knn_all_pairs", "binary_areas",
                 "seed_sparse", "column_stats"):
        df = q[name](spark, sf)
        a = sorted(map(tuple, df.collect()))
        res = con.execute(s[name])
        cols = [c[0] for c in res.description]
        b = sorted(tuple(r[cols.index(c)] for c in df.columns) for r in res.fetchall())
        assert len(a) == len(b), name
        for x, y in zip(a, b):
            for u, w in zip(x, y):
                if isinstance(u, float):
                    assert abs(u - float(w)) < 1e-9, (name, x, y)
                else:
                    assert u == w, (name, x, y)


def test_short_rows_fail_and_quotes_stay(spark, tmp_path):
    p = tmp_path / "v.tsv"
    p.write_text('1\t"com.b\n2\tcom."c"\n')
    assert sorted((r.id, r.host) for r in io.read_vertices_tsv(spark, str(p)).collect()) == [(1, '"com.b'), (2, 'com."c"')]
    q = tmp_path / "e.tsv"
    q.write_text("1\t2\n5\n")
    with pytest.raises(Exception, match="fewer than 2 fields"):
        io.read_edges_tsv(spark, str(q)).collect()
    assert io.read_edges_tsv(spark, str(q), mode="DROPMALFORMED").count() == 1
