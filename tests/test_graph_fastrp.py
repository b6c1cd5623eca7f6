import math

import pytest
from pyspark.sql import functions as F

from hopvec.operators.edge_layout import compress_edges, even_share, lay_out, salt_counts
from hopvec.operators.fastrp import fastrp, init_vectors, neighbor_mean
from hopvec.operators.graph import (complete_vertices, dedupe_edges, degrees, drop_isolated, graph_summary,
                                    induced_subgraph, symmetrize, vertices_from_edges)
from hopvec.operators.pagerank import pagerank, top_ranked

E_SCHEMA = "src long, dst long, weight double"
V_SCHEMA = "id long, x array<double>"


def _emb(df):
    return {r.id: [round(v, 6) for v in r.x] for r in df.collect()}


@pytest.fixture(scope="module")
def tiny(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 4.0])], V_SCHEMA)
    e = spark.createDataFrame([(1, 2, 1.0), (3, 2, 1.0), (2, 3, 1.0)], E_SCHEMA)
    return v, e


def test_fastrp_carry_and_freeze(spark, tiny):
    v, e = tiny
    carry = _emb(fastrp(v, e, 2, [1.0, 0.5], r0=0.25, mode="carry"))
    freeze = _emb(fastrp(v, e, 2, [1.0, 0.5], r0=0.25, mode="freeze"))
    assert carry == {1: [1.75, 0.0], 2: [0.930714, 1.40432], 3: [0.503553, 1.553553]}
    assert freeze == {1: [0.25, 0.0], 2: [0.930714, 1.40432], 3: [0.503553, 1.553553]}


def test_fastrp_parallel_edge_and_symmetric(spark, tiny):
    v, e = tiny
    e2 = e.unionByName(spark.createDataFrame([(1, 2, 1.0)], E_SCHEMA))
    assert _emb(fastrp(v, e2, 2, [1.0, 0.5], r0=0.25)) == {
        1: [1.75, 0.0], 2: [1.134422, 1.228248], 3: [0.540434, 1.512348]}
    want = {1: [0.579252, 1.376288], 2: [0.658505, 1.502577], 3: [0.479252, 1.576288]}
    for mode in ("carry", "freeze"):
        assert _emb(fastrp(v, symmetrize(e), 2, [1.0, 0.5], r0=0.25, mode=mode)) == want


def test_fastrp_negative_zero_weights_self_loop(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 4.0])], V_SCHEMA)
    e = spark.createDataFrame([(1, 2, 1.0), (2, 2, 1.0), (3, 2, -2.0)], E_SCHEMA)
    assert _emb(fastrp(v, e, 2, [1.0])) == {1: [0.0, 0.0], 2: [-0.707107, -0.707107], 3: [0.6, 0.8]}
    v5 = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 4.0])], V_SCHEMA)
    e5 = spark.createDataFrame([(1, 2, 0.0), (3, 2, 1.0)], E_SCHEMA)
    assert _emb(fastrp(v5, e5, 2, [1.0])) == {1: [1.0, 0.0], 2: [0.6, 0.8], 3: [0.6, 0.8]}
    m = {r.id: (r.x, r.n) for r in neighbor_mean(v5, e5).collect()}
    assert m[2] == ([1.5, 2.0], 2)


def test_fastrp_errors(spark, tiny):
    v, e = tiny
    with pytest.raises(ValueError):
        fastrp(v, e, 2, [])
    bad = spark.createDataFrame([(1, [1.0, 0.0, 1.0])], V_SCHEMA)
    with pytest.raises(Exception, match="dimensions"):
        fastrp(bad, e, 2, [1.0]).collect()


def _edges_cp(spark, sf):
    from hopvec.plans import fixtures as fx
    return fx.edges_cp(spark, sf)


def test_fastrp_properties(spark):
    """Hub split, partition count and linearity in the weights do not change the result."""
    e = symmetrize(_edges_cp(spark, "/root/testdata/sf0.001"))
    v = vertices_from_edges(e)
    base = _emb(fastrp(v, e, 8, [0.0, 1.0, 1.0]))
    hub = _emb(fastrp(v, e, 8, [0.0, 1.0, 1.0], share=5, num_partitions=3))
    assert base == hub
    a = _emb(fastrp(v, e, 8, [0.0, 1.0, 0.0]))
    b = _emb(fastrp(v, e, 8, [0.0, 0.0, 1.0]))
    for k in base:
        assert all(abs(x - (y + z)) < 2e-6 for x, y, z in zip(base[k], a[k], b[k]))
    # freeze = carry when every vertex has an in-edge
    assert _emb(fastrp(v, e, 8, [0.5, 1.0], mode="freeze")) == _emb(fastrp(v, e, 8, [0.5, 1.0]))


def test_fastrp_id_permutation_with_given_vectors(spark):
    """Relabelling ids moves the embedding with them when initial vectors are given."""
    v = spark.createDataFrame([(i, [float(i), 1.0, -float(i % 3)]) for i in range(6)], V_SCHEMA)
    e = spark.createDataFrame([(i, (i + 1) % 6, 1.0) for i in range(6)] + [(0, 3, 2.0)], E_SCHEMA)
    perm = {i: 100 - 7 * i for i in range(6)}
    pv = spark.createDataFrame([(perm[i], [float(i), 1.0, -float(i % 3)]) for i in range(6)], V_SCHEMA)
    pe = spark.createDataFrame([(perm[i], perm[(i + 1) % 6], 1.0) for i in range(6)] + [(perm[0], perm[3], 2.0)],
                               E_SCHEMA)
    a = _emb(fastrp(v, e, 3, [1.0, 0.5]))
    b = _emb(fastrp(pv, pe, 3, [1.0, 0.5]))
    assert all(a[i] == b[perm[i]] for i in range(6))


def test_graph_shape_ops(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (1, 2, 1.0), (3, 3, 1.0)], E_SCHEMA)
    assert sorted(r.id for r in vertices_from_edges(e).collect()) == [1, 2, 3]
    assert {r.id: r.degree for r in degrees(e).collect()} == {1: 2, 2: 2, 3: 2}
    assert symmetrize(e).count() == 6
    assert dedupe_edges(e).count() == 2
    vs = spark.createDataFrame([(1, "a"), (9, "z")], "id long, name string")
    cv = {r.id: r.name for r in complete_vertices(vs, e).collect()}
    assert cv == {1: "a", 9: "z", 2: None, 3: None}
    assert sorted(r.id for r in drop_isolated(vs, e).collect()) == [1]
    s = graph_summary(vertices_from_edges(e), e).first()
    assert (s.n_vertices, s.n_edges) == (3, 3)


def test_induced_subgraph_case(spark):
    ranks = spark.createDataFrame([(1, 9.0, 1, 1.0, "com.a"), (2, 8.0, 2, 1.0, "com.b"), (3, 7.0, 3, 1.0, "com.c"),
                                   (4, 6.0, 4, 1.0, "com.d")],
                                  "hc_pos long, hc_val double, pr_pos long, pr_val double, host_rev string")
    verts = spark.createDataFrame([(0, "com.a"), (1, "com.b"), (2, "com.c"), (3, "com.d")], "id long, host string")
    edges = spark.createDataFrame([(0, 1, 1.0), (0, 1, 1.0), (1, 2, 1.0)], E_SCHEMA)
    v, e = induced_subgraph(verts, edges, ranks, 2)
    assert sorted(r.id for r in v.collect()) == [0, 1]
    assert [(r.src, r.dst, r.weight) for r in e.collect()] == [(0, 1, 1.0)]
    # host 3 is ranked but has no edge -> dropped; a self-loop keeps its host
    edges2 = edges.unionByName(spark.createDataFrame([(2, 2, 1.0)], E_SCHEMA))
    v, e = induced_subgraph(verts, edges2, ranks, 4)
    assert sorted(r.id for r in v.collect()) == [0, 1, 2]
    assert e.count() == 3


def test_pagerank_fixture(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 1.0), (5, 1, 1.0), (1, 2, 1.0)], E_SCHEMA)
    r = {x.id: round(x.rank, 6) for x in pagerank(e, 5, 0.0).collect()}
    assert r == {1: 0.714286, 2: 2.142857, 3: 1.428571, 4: 0.714286, 5: 0.0}
    hub = {x.id: round(x.rank, 6) for x in pagerank(e, 5, 0.0, share=2, num_partitions=3).collect()}
    assert hub == r                                      # sources 1 and 3 are salted
    top = [x.id for x in top_ranked(pagerank(e, 5, 0.0), 2).collect()]
    assert top == [2, 3]
    dag = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], E_SCHEMA)
    assert all(math.isnan(x.rank) for x in pagerank(dag, 5, 0.0).collect())
    # with reset: ranks still sum to the vertex count
    s = pagerank(e, 5, 0.15).agg(F.sum("rank")).first()[0]
    assert abs(s - 5) < 1e-9


def test_empty_graphs(spark):
    e = spark.createDataFrame([], E_SCHEMA)
    assert pagerank(e, 3, 0.0).count() == 0
    v = spark.createDataFrame([(1, [1.0, 0.0])], V_SCHEMA)
    assert _emb(fastrp(v, e, 2, [1.0], r0=0.5)) == {1: [1.5, 0.0]}


def test_chunks_agree_with_narrow_vectors(spark):
    """Dimensions are independent but for the norm: 70 given dimensions (three chunks, the last filled) with zeros beyond the
    first 8 give the result of 8 dimensions."""
    e = symmetrize(_edges_cp(spark, "/root/testdata/sf0.001"))
    v = init_vectors(vertices_from_edges(e), 8)
    wide = v.select("id", F.concat("x", F.array_repeat(F.lit(0.0), 62)).alias("x"))
    for mode in ("carry", "freeze"):
        a = _emb(fastrp(v, e, 8, [0.0, 1.0, 0.5], r0=0.1, mode=mode))
        b = _emb(fastrp(wide, e, 70, [0.0, 1.0, 0.5], r0=0.1, mode=mode, share=7, num_partitions=5))
        assert a.keys() == b.keys()
        assert all(len(b[k]) == 70 and not any(b[k][8:]) and all(abs(x - y) < 2e-6 for x, y in zip(a[k], b[k])) for k in a)
    v, a = vertices_from_edges(e), _emb(fastrp(vertices_from_edges(e), e, 8, [0.0, 1.0, 0.5]))
    h = _emb(fastrp(v, e, 8, [1.0], rng="hash"))
    assert h.keys() == a.keys() and h != _emb(fastrp(v, e, 8, [1.0]))


def _numpy_fastrp(n, edges, x0, weights, r0, mode):
    """Brute-force FastRP on a small graph (independent of the Spark code)."""
    import numpy as np

    def norm(m):
        nn = np.linalg.norm(m, axis=1, keepdims=True)
        return np.where(nn == 0, m, m / np.where(nn == 0, 1, nn))

    x = np.array(x0, dtype=float)
    has_in = np.zeros(n, bool)
    for _, v, _ in edges:
        has_in[v] = True
    acc = r0 * norm(x)
    for w in weights:
        s = np.zeros_like(x)
        c = np.zeros(n)
        for u, v, ew in edges:
            s[v] += ew * x[u]
            c[v] += 1
        x = np.where(has_in[:, None], s / np.maximum(c, 1)[:, None], x)
        term = w * norm(x)
        acc = acc + (term if mode == "carry" else np.where(has_in[:, None], term, 0))
    return acc


@pytest.mark.parametrize("seed", [1, 2])
def test_fastrp_against_numpy(spark, seed):
    import numpy as np
    rng = np.random.default_rng(seed)
    n, d = 12, 3
    edges = [(int(rng.integers(n)), int(rng.integers(n)), float(rng.choice([-1.0, 0.0, 0.5, 1.0, 2.0])))
             for _ in range(30)]
    edges += [(3, 3, 1.0), (4, 5, 1.0), (4, 5, 1.0)]        # a self-loop and a parallel edge
    x0 = rng.normal(size=(n, d)).round(3)
    v = spark.createDataFrame([(i, x0[i].tolist()) for i in range(n)], V_SCHEMA)
    e = spark.createDataFrame(edges, E_SCHEMA)
    for mode in ("carry", "freeze"):
        want = _numpy_fastrp(n, edges, x0, [0.5, 1.0, 0.25], 0.3, mode)
        got = _emb(fastrp(v, e, d, [0.5, 1.0, 0.25], r0=0.3, mode=mode))
        for i in range(n):
            assert np.allclose(got[i], want[i], atol=2e-6), (mode, i, got[i], want[i])


def test_salts_keep_tasks_even(spark):
    """No source and salt holds more than an even share, at any number of partitions; in fact too."""
    degrees = [3_000_000, 40_000, 5000] + [7] * 20_000
    for partitions in (8, 4096, 4097, 20_000, 100_000):
        share = even_share(sum(degrees), partitions)
        table = spark.createDataFrame(list(enumerate(degrees)), "src long, rows long")
        salts = {r.src: r.salts for r in salt_counts(table, share).collect()}
        assert sum(salts.values()) < 2 * partitions
        assert all(math.ceil(n / salts.get(k, 1)) <= share for k, n in enumerate(degrees))
    hub = spark.range(1, 4001).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"), F.lit(1.0).alias("weight"))
    rest = spark.range(1, 4001).select(F.col("id").alias("src"), (F.col("id") % 4000 + 1).alias("dst"), F.lit(1.0).alias("weight"))
    layout = lay_out(hub.union(rest), 8)
    assert layout.salts.count() == 3 and {r.src for r in layout.salts.collect()} == {0}
    counts = [sum(1 for _ in p) for df in (layout.light, layout.heavy) for p in df.rdd.glom().collect()]
    cells = [r["count"] for r in layout.heavy.groupBy("src", "salt").count().collect()] + [layout.light.where("src = 0").count()]
    assert sum(counts) == 8000 and max(cells) < 1.2 * 1000
    assert max(counts) < 2.5 * 1000


def test_star_hub_is_exact(spark):
    """A source holding half of all edges is salted automatically; results are unchanged."""
    edges = [(0, i, 1.0) for i in range(1, 201)] + [(i, i % 200 + 1, 1.0) for i in range(1, 201)]
    e = spark.createDataFrame(edges, E_SCHEMA)
    v = vertices_from_edges(e)
    assert lay_out(e, 8).heavy is not None and lay_out(e, 8, share=10 ** 9).heavy is None
    auto = _emb(fastrp(v, e, 4, [1.0, 1.0], num_partitions=8))
    plain = _emb(fastrp(v, e, 4, [1.0, 1.0], num_partitions=8, share=10 ** 9))
    assert auto == plain


def test_parallel_edges_are_shipped_once(spark):
    """Weights of 0 and below and null weights keep their count when parallel edges become one row."""
    e = spark.createDataFrame([(1, 2, 2.0), (1, 2, -3.0), (1, 2, 0.0), (3, 2, None), (3, 2, 1.0), (2, 2, 4.0)], "src long, dst long, weight double")
    assert {(r.src, r.dst): (r.weight, r.n) for r in compress_edges(e).collect()} == {(1, 2): (-1.0, 3), (3, 2): (2.0, 2), (2, 2): (4.0, 1)}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 3.0]), (3, [5.0, 1.0])], V_SCHEMA)
    m = {r.id: (r.x, r.n) for r in neighbor_mean(v, e).collect()}
    assert m == {2: ([(-1.0 + 10.0) / 6, (2.0 + 12.0) / 6], 6)}


def test_pagerank_against_numpy(spark):
    import numpy as np
    rng = np.random.default_rng(7)
    edges = [(int(rng.integers(15)), int(rng.integers(15)), 1.0) for _ in range(60)]
    ids = sorted({u for u, _, _ in edges} | {v for _, v, _ in edges})
    pos = {v: i for i, v in enumerate(ids)}
    outdeg = np.zeros(len(ids))
    for u, _, _ in edges:
        outdeg[pos[u]] += 1
    e = spark.createDataFrame(edges, E_SCHEMA)
    for reset in (0.0, 0.15):
        r = np.ones(len(ids))
        for _ in range(5):
            s = np.zeros(len(ids))
            for u, v, _ in edges:
                s[pos[v]] += r[pos[u]] / outdeg[pos[u]]
            r = reset + (1 - reset) * s
        r = r * len(ids) / r.sum()
        got = {x.id: x.rank for x in pagerank(e, 5, reset).collect()}
        assert all(abs(got[v] - r[pos[v]]) < 1e-9 for v in ids)


def test_one_row_per_vertex_and_null_weights(spark):
    v = spark.createDataFrame([(1,), (1,), (2,)], "id long")
    e = spark.createDataFrame([(1, 2, 1.0), (3, 2, None), (2, 3, 2.0)], "src long, dst long, weight double")
    full = spark.createDataFrame([(1, 2, 1.0), (3, 2, 1.0), (2, 3, 2.0)], "src long, dst long, weight double")
    a = {r.id: r.x for r in fastrp(v, e, 4, [1.0, 1.0]).collect()}
    b = {r.id: r.x for r in fastrp(v.distinct(), full, 4, [1.0, 1.0]).collect()}
    assert sorted(a) == [1, 2, 3] and all(max(abs(x - y) for x, y in zip(a[i], b[i])) < 1e-12 for i in a)
    assert fastrp(v, e, 4, [1.0]).count() == 3
