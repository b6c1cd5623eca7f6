"""FastRP over blocks of vertices: seeds in numpy, sums of a pack, sizes that bound a task, and equal results however the input is cut."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopvec.functions.seed import seed_block, sparse_seed
from hopvec.operators import edge_blocks as B
from hopvec.operators.fastrp import fastrp


@pytest.mark.parametrize("rng, sparsity, seed", [("java", 3, 42), ("java", 1, 42), ("hash", 3, 42), ("hash", 2, 1 << 40)])
def test_seeds_in_numpy_equal_the_column(spark, rng, sparsity, seed):
    ids = [0, 1, -1, 7, 1 << 40, -(1 << 62), *range(1000, 1100)]
    want = {r.id: r.x for r in spark.createDataFrame([(i,) for i in ids], "id long").select("id", sparse_seed("id", 19, sparsity, rng, seed).alias("x")).collect()}
    got = seed_block(np.array(ids), 0, 19, sparsity, rng, seed)
    assert [want[i] for i in ids] == got.tolist()
    assert seed_block(np.array(ids), 5, 12, sparsity, rng, seed).tolist() == got[:, 5:12].tolist()


@pytest.mark.parametrize("run, lines, size", [(2, 3, 50), (64, 4096, 1 << 17)])
def test_sums_of_packs(monkeypatch, run, lines, size):
    """Ends with more edges than a line holds, cut packs, and weights that are 1, whole or not."""
    for name, value in (("RUN", run), ("LINES", lines), ("PACK_EDGES", size)):
        monkeypatch.setattr(B, name, value)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 5))
    for weight in (np.ones(400), rng.integers(-2, 3, 400).astype(float), rng.normal(size=400), np.full(400, 200.0)):
        src, dst = rng.integers(0, 20, 400), np.minimum(rng.integers(0, 30, 400), 11)
        want, got = np.zeros((12, 5)), np.zeros((12, 5))
        np.add.at(want, dst, x[src] * weight[:, None])
        for several, u, v, w, z in B.packs_of(src, dst, weight):
            s = np.frombuffer(u, np.int32)
            z = np.frombuffer(z, np.int8 if len(z) * 4 == len(u) else np.float64) if z else None
            at, sums = B.pack_sums(x, s, np.frombuffer(v, np.int32), np.frombuffer(w, np.uint8), z, several)
            assert len(set(at.tolist())) == len(at)
            got[at] += sums
        assert np.allclose(got, want)


@pytest.mark.parametrize("d", [8, 64, 576])
def test_sizes_bound_a_task(d):
    """Of 1 GB, 6 GB and far more: blocks stay as large as they are. Cells of the grid held four million edges and 192 MB of vectors twice."""
    for vertices, edges, tasks in ((2_100_000, 36_000_000, 6), (12_600_000, 432_000_000, 6), (10**9, 3 * 10**10, 400)):
        plan = B.sizes(d, vertices, vertices, edges, tasks)
        assert vertices / plan.parts * 8 * plan.width <= B.BLOCK_BYTES
        assert edges / plan.parts ** 2 / plan.slices <= B.SLICE_EDGES
        assert plan.sub * plan.width * 8 <= B.ROW_BYTES and plan.sub * d * 8 <= max(B.VERTEX_BYTES, 256 * d * 8)
        plan.counts = np.tile([0, vertices // plan.parts, 0, 0], (plan.parts, 1))
        plan.outs = np.full(plan.parts, edges // plan.parts)
        for chunks in plan.groups():
            waves = plan.waves(len(chunks))
            assert sorted(p for w in waves for p in w) == list(range(plan.parts))
            for w in waves:
                size = len(chunks) * sum(plan.sent(p) for p in w)
                assert size <= B.JOB_BYTES or len(w) * len(chunks) <= tasks / 2 + 1
        first, many = plan.dealt(B.TASK_EDGES, 1)
        assert (plan.outs / many <= max(B.TASK_EDGES, B.SPLIT_EDGES)).all() and first.tolist() == (np.cumsum(many) - many).tolist()


def _graph(spark):
    rng = np.random.default_rng(11)
    edges = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 60, 400), np.minimum(rng.integers(20, 140, 400), 90), rng.choice([-1.0, 0.0, 0.5, 1.0, 1.0, 2.0], 400))]
    edges += [(3, i, 1.0) for i in range(20, 90)] + [(None, 200, 1.0), (None, 30, 1.0), (5, None, 1.0), (5, 5, 1.0)]
    given = [(i, [float(t) for t in rng.normal(size=9).round(2)]) if i % 3 else (i, None) for i in (*range(0, 100, 2), 300, 301)]
    return (spark.createDataFrame(given, "id long, x array<double>"), spark.createDataFrame(edges, "src long, dst long, weight double"),
            {i: x for i, x in given if x}, edges)


def _plain(given, edges, ids, d, weights, r0, mode, seeds):
    x = {i: np.array(given.get(i, seeds[i])) for i in ids}
    fed, into = {b for _, b, _ in edges}, {}
    for a, b, w in edges:
        if a is not None and b is not None:
            into.setdefault(b, []).append((a, w))

    def unit(v):
        n = np.linalg.norm(v)
        return v / n if n else v

    acc = {i: r0 * unit(x[i]) for i in ids}
    for weight in weights:
        x = {i: sum(w * x[a] for a, w in into[i]) / len(into[i]) if i in into else x[i] for i in ids}
        for i in ids:
            if mode == "carry" or i in fed:
                acc[i] = acc[i] + weight * unit(x[i])
    return acc


@pytest.mark.parametrize("mode", ["carry", "freeze"])
def test_results_do_not_depend_on_how_the_input_is_cut(spark, monkeypatch, mode):
    v, e, given, edges = _graph(spark)
    ids = {i for a, b, _ in edges for i in (a, b) if i is not None} | {r.id for r in v.collect()}
    seeds = {i: seed_block(np.array([i]), 0, 9)[0] for i in ids}
    want = _plain(given, edges, ids, 9, [0.5, 0.0, 1.0], 0.3, mode, seeds)
    for cut in (False, True):
        if cut:
            for name, value in (("BLOCK_BYTES", 900), ("JOB_BYTES", 3000), ("ROW_BYTES", 200), ("VERTEX_BYTES", 1), ("SLICE_EDGES", 20), ("WIDTHS", (2,))):
                monkeypatch.setattr(B, name, value)
            plan = B.sizes(9, 60, 80, 400, 2)
            assert plan.parts > 1 and plan.chunks > 1 and plan.slices > 1
        rows = fastrp(v, e, 9, [0.5, 0.0, 1.0], r0=0.3, mode=mode, num_partitions=2).collect()
        assert sorted(r.id for r in rows) == sorted(ids)
        for r in rows:
            assert np.allclose(r.x, want[r.id], atol=1e-9), (cut, r.id)


def test_null_ids_stay_where_one_term_counts(spark):
    v = spark.createDataFrame([(None, [3.0, 4.0]), (1, [0.0, 2.0])], "id long, x array<double>")
    e = spark.createDataFrame([(1, 2, 1.0)], "src long, dst long, weight double")
    for mode, want in (("carry", [0.6, 0.8]), ("freeze", [0.0, 0.0])):
        got = [r.x for r in fastrp(v, e, 2, [1.0], mode=mode).where("id is null").collect()]
        assert len(got) == 1 and np.allclose(got[0], want), (mode, got)
    assert fastrp(v, e, 2, [1.0], r0=0.5).where("id is null").count() == 0


def test_a_wide_run_has_no_job_for_each_chunk_and_hop(spark):
    """Each 32 dimensions of each hop were a job of their own, with a join and an aggregate of 32 columns."""
    e = spark.range(60).select("id", ((F.col("id") * 7) % 60).alias("dst")).select(F.col("id").alias("src"), "dst", F.lit(1.0).alias("weight"))
    jobs = []
    for d in (32, 512):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, group)
        assert fastrp(e.select(F.col("src").alias("id")), e, d, [0.5, 1.0], num_partitions=2).count() == 60
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 2, jobs
