"""FastRP over a grid of edge cells: bounds of the grid, the sums of a cell, and what a wide run leaves on disk."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hopvec.operators import edge_cells as C
from hopvec.operators.edge_layout import compress_edges
from hopvec.operators.fastrp import fastrp
from hopvec.session import checkpoint_dir, stored


def test_grid_bounds_what_a_cell_holds():
    for vertices, edges, most_out, most_in, tasks in ((10, 20, 3, 3, 1), (2_100_000, 72_000_000, 50, 60, 24), (10**8, 10**10, 10**9, 10**9, 400)):
        rows, columns = C.grid(vertices, edges, most_out, most_in, 32, tasks)
        assert rows * columns >= tasks and edges / (rows * columns) <= C.CELL_EDGES
        assert max(vertices / rows, vertices / columns) * 264 <= C.CELL_BYTES
        assert most_out / columns <= C.CELL_EDGES and most_in / rows <= C.CELL_EDGES
    assert C.grid(100, 1000, 500, 5, 8, 2, share=5)[1] == 100


@pytest.mark.parametrize("size", [3, C.SLICE])
def test_sums_of_a_cell(monkeypatch, size):
    """Slices that cut an end's edges, ends and sources in any order, sources that are not there."""
    monkeypatch.setattr(C, "SLICE", size)
    rng = np.random.default_rng(4)
    ids, x = rng.permutation(np.arange(0, 40, 2)), rng.normal(size=(20, 5))
    src, dst, w, n = rng.integers(0, 45, 300), rng.integers(-5, 9, 300), rng.normal(size=300), rng.integers(1, 4, 300)
    want = {}
    for a, b, k, m in zip(src, dst, w, n):
        for v in x[ids == a]:
            s, c = want.get(b, (0.0, 0))
            want[b] = (s + k * v, c + m)
    cut = [slice(0, 120), slice(120, 300)]
    packs = pa.table({k: pa.array([v[c].tolist() for c in cut]) for k, v in (("src", src), ("dst", dst), ("weight", w), ("n", n))})
    got = C.cell_sums(5)(pa.table({"id": pa.array(ids), "x": pa.array(x.tolist())}), packs).to_pylist()
    assert [r["id"] for r in got] == sorted(want)
    for r in got:
        s, c = want[r["id"]]
        assert r["n"] == c and np.allclose([r[f"s{i}"] for i in range(5)], s)
    for none in (packs.slice(0, 0), packs):
        assert C.cell_sums(5)(pa.table({"id": pa.array([], pa.int64()), "x": pa.array([], pa.list_(pa.float64()))}), none).num_rows == 0


def test_cells_hold_every_edge_once(spark):
    e = spark.createDataFrame([(i % 7, i % 11, 1.0) for i in range(200)] + [(None, 1, 1.0), (1, None, 1.0)], "src long, dst long, weight double")
    small = stored(compress_edges(e))
    at = C.cells(small, 11, 4, 6)
    rows = [(r.cell, p) for r in at.packs.collect() for p in zip(r.src, r.dst, r.weight, r.n)]
    assert sorted(p for _, p in rows) == sorted(map(tuple, small.where("src is not null and dst is not null").collect()))
    reach = {r.id: set(r.cells) for r in C.reached(small, at).collect()}
    assert reach == {k: {c for c, p in rows if p[0] == k} for k in range(7)}


def _bytes(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files)


def test_wide_vectors_leave_no_rows_for_each_edge_and_chunk(spark):
    """The layout held each edge once for each 32 dimensions, and every iterate stayed."""
    pairs = spark.range(80).crossJoin(spark.range(80).withColumnRenamed("id", "dst"))
    e = pairs.where("id <> dst").select(F.col("id").alias("src"), "dst", F.lit(1.0).alias("weight"))
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = _bytes(folder)
    out = fastrp(e.select(F.col("src").alias("id")).distinct(), e, 256, [0.5, 1.0])
    kept = _bytes(folder) - before
    assert out.count() == 80 and kept < 400_000, kept
