"""The form before ``edge_blocks``, which ``fastrp`` uses now. Edges in a grid of cells: by hash of the source into ``rows``, by hash of the end into ``columns``.

A hop sends the vector of a source once to each cell with an edge of it, sums there in numpy, and adds up at most ``rows``
sums for each end. So a hop moves at most ``columns`` copies of the state and ``rows`` copies of the result, and never more
than a vector for each edge; edges travel as packed arrays. The edges of a hot source lie in all columns, those of
a hot end in all rows. The grid follows the input: what a cell holds is bounded, and every core has cells to do.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored, table_path

CELL_BYTES = 192 * 1024 * 1024      # vectors of the sources, or of the ends, of a cell
CELL_EDGES = 4_000_000
SLICE = 8192                        # edges summed at a time
PACKED = "cell int, src array<bigint>, dst array<bigint>, weight array<double>, n array<bigint>"


@dataclass
class EdgeCells:
    """``packs`` (see ``PACKED``) of ``rows * columns`` cells, stored at ``path``."""

    packs: DataFrame
    path: str
    rows: int
    columns: int


def grid(vertices: int, edges: int, most_out: int, most_in: int, width: int, tasks: int, share: int | None = None) -> tuple[int, int]:
    """``(rows, columns)`` for vectors of ``width`` dimensions. ``share``: edges of a source that may lie in one cell."""
    side = max(1, math.ceil(vertices * (8 * width + 8) / CELL_BYTES))
    least = max(1, tasks, math.ceil(edges / CELL_EDGES))        # a square grid copies least
    rows = max(side, math.ceil(most_in / CELL_EDGES), math.isqrt(least))
    columns = max(side, math.ceil(most_out / (share or CELL_EDGES)), math.ceil(least / rows))
    return rows, columns


def _part(key: str, seed: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(parts)).cast("int")


def _pack(batches):
    """A row of arrays for each run of equal cells in a batch."""
    names = ("src", "dst", "weight", "n")
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        if len(cell):
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            ends = pa.array(np.r_[first, len(cell)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(cell[first]), *[pa.ListArray.from_arrays(ends, batch.column(k)) for k in names]], ["cell", *names])


def cells(edges: DataFrame, vertices: int, width: int, tasks: int, share: int | None = None) -> EdgeCells:
    """Cells of compressed ``edges (src, dst, weight, n)``, a table that is cheap to read again."""
    spark = edges.sparkSession
    edges = edges.where("src is not null and dst is not null")
    most = [edges.groupBy(k).agg(F.count("*").alias("k")).agg(F.max("k")).first()[0] or 0 for k in ("src", "dst")]
    rows, columns = grid(vertices, edges.count(), *most, width, tasks, share)
    dealt = edges.withColumn("cell", _part("src", 1, rows) * columns + _part("dst", 2, columns))
    dealt = dealt.repartition(rows * columns, "cell").sortWithinPartitions("cell").select("cell", "src", "dst", "weight", "n")
    path = table_path(spark)
    return EdgeCells(stored(dealt.mapInArrow(_pack, PACKED), path), path, rows, columns)


def reached(edges: DataFrame, at: EdgeCells) -> DataFrame:
    """``(id, cells)``: the cells that hold edges of a source."""
    cell = _part("src", 1, at.rows) * at.columns + _part("dst", 2, at.columns)
    return edges.where("src is not null and dst is not null").groupBy(F.col("src").alias("id")).agg(F.collect_set(cell).alias("cells"))


def _flat(table: pa.Table, name: str) -> np.ndarray:
    """The values of a list column, one list after the other."""
    parts = [c.flatten() for c in table.column(name).chunks]
    return np.concatenate([p.to_numpy(zero_copy_only=False) for p in parts]) if parts else np.empty(0)


def cell_sums(width: int):
    """Function of the sources ``(id, x)`` and the packs of a cell: ``(id, n, s0 ..)`` of each end, the weighted sum of its
    in-neighbours and their number."""
    names = ["id", "n", *[f"s{i}" for i in range(width)]]

    def sums(sources: pa.Table, packs: pa.Table) -> pa.Table:
        src, dst, weight, n = (_flat(packs, k) for k in ("src", "dst", "weight", "n"))
        ids = sources.column("id").to_numpy()
        if len(ids) and len(src):
            by = np.argsort(ids, kind="stable")
            where = by[np.minimum(np.searchsorted(ids, src, sorter=by), len(ids) - 1)]
            order = np.argsort(dst, kind="stable")
            order = order[(ids[where] == src)[order]]
            src, dst, weight, n, where = None, dst[order], weight[order], n[order], where[order]
        else:
            dst = dst[:0]
        new = np.r_[True, dst[1:] != dst[:-1]][:len(dst)]
        first, rank = np.flatnonzero(new), np.cumsum(new) - 1
        out = np.zeros((len(first), width))
        if len(first):
            x = _flat(sources, "x").reshape(-1, width)
            some = np.empty((SLICE, width))
            for a in range(0, len(dst), SLICE):
                b = min(a + SLICE, len(dst))
                rows = np.take(x, where[a:b], axis=0, out=some[:b - a], mode="clip")
                rows *= weight[a:b, None]
                part = np.add.reduceat(rows, np.r_[0, 1 + np.flatnonzero(new[a + 1:b])], axis=0)
                out[rank[a]:rank[a] + len(part)] += part
            n = np.add.reduceat(n, first)
        else:
            n = np.empty(0)
        turned = np.ascontiguousarray(out.T)
        return pa.table([pa.array(dst[first].astype(np.int64)), pa.array(n.astype(np.int64)), *[pa.array(turned[i]) for i in range(width)]], names=names)

    return sums


def cell_means(state: DataFrame, at: EdgeCells, width: int) -> DataFrame:
    """``(id, m0 ..)``: weighted in-neighbour sums over the number of in-edges, of ``state (id, cells, v0 ..)``."""
    senders = state.where("cells is not null").select("id", F.array(*[f"v{i}" for i in range(width)]).alias("x"), F.explode("cells").alias("cell"))
    schema = "id bigint, n bigint, " + ", ".join(f"s{i} double" for i in range(width))
    sums = senders.groupBy("cell").cogroup(at.packs.groupBy("cell")).applyInArrow(cell_sums(width), schema)
    total = sums.groupBy("id").agg(F.sum("n").alias("n"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    return total.select("id", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(width)])
