"""FastRP hops over blocks of vertices: packed edges between blocks, summed in numpy.

Vertices lie in ``parts`` blocks by hash of their id; a vertex is a block and a place in it. Edges are kept as packs, each
of one pair of blocks, by place and sorted by end. A hop of a chunk of dimensions has two steps, each one exchange:

* push: a task holds the sources of a block and reads packs one by one; it sends one sum for each end of a pack;
* add: a task holds the sums of a block's ends, adds what comes and divides by the number of in-edges.

A task holds ``BLOCK_BYTES`` of vectors and a few rows of bounded size, whatever the input. Seeds are made where they are
needed from the ids, so vectors of the start are not stored. Dimensions are independent but for the norms: chunk after chunk
goes through all hops, and ``finish`` puts the chunks of some vertices together. Jobs are cut by chunks and by blocks of ends,
so that one shuffles about ``JOB_BYTES``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seed import seed_block
from ..session import conf_override, stored

BLOCK_BYTES = 96 * 1024 * 1024      # vectors of the sources, or of the ends, of a task
JOB_BYTES = 1024 * 1024 * 1024  # vectors that a job shuffles: one chunk and one block at least
ROW_BYTES = 1024 * 1024             # vectors in a row
VERTEX_BYTES = 8 * 1024 * 1024     # whole vectors that are put together at a time
SPLIT_EDGES = 1 << 20               # edges dealt to pairs of blocks at a time
SLICE_EDGES = 1 << 19               # edges of a pair of blocks between some of their ends; twice as many are sorted at a time
PACK_EDGES = 1 << 17
INDEX_EDGES = 4_000_000             # edges that a task indexes
TASK_EDGES = 32_000_000             # edges that a task sums, of a chunk
RUN = 64                            # edges of an end summed one after the other; more are split
LINES = 4096                        # ends summed at a time
WIDTHS = (8, 16, 32)
SOURCE, BOTH, END, NONE = range(4)  # classes: order of the vertices in a block

ROW = "task int, part int, kind int, a int, b int, u binary, v binary, w binary, x binary"
NAMES = ("task", "part", "kind", "a", "b", "u", "v", "w", "x")
BLOCK_ROW = "part int, sub int, kind int, b int, u binary, v binary"
STATE_ROW = "part int, sub int, chunk int, v binary"


def _rows(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    types = {"int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows), kinds)], list(names))


def _each(batches, *names):
    """Rows of a stream as tuples, one at a time; binary values stay views of the batch."""
    for batch in batches:
        columns = [batch.column(k) for k in names]
        plain = [c if pa.types.is_binary(c.type) else c.to_pylist() for c in columns]
        for i in range(batch.num_rows):
            yield tuple(c[i].as_buffer() if isinstance(c, pa.Array) and c[i].is_valid else None if isinstance(c, pa.Array) else c[i] for c in plain)


def _array(buffer, kind) -> np.ndarray:
    return np.frombuffer(buffer, kind) if buffer is not None and buffer.size else np.empty(0, kind)


def part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("bigint"), F.lit(1)), F.lit(parts)).cast("int")


def edge_ends(edges: DataFrame) -> DataFrame:
    """``(id, n, ins, outs, fed)`` of the ends of compressed edges: ``n`` in-edges as rows ``ins``, ``outs`` rows that leave;
    only edges with two ends count. ``fed``: the end of any edge."""
    whole = F.col("src").isNotNull() & F.col("dst").isNotNull()
    none, one = F.lit(0).cast("bigint"), F.when(whole, F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    side = F.explode(F.array(F.struct(F.col("src").alias("id"), none.alias("n"), none.alias("ins"), one.alias("outs"), F.lit(False).alias("fed")),
                             F.struct(F.col("dst").alias("id"), F.when(whole, F.col("n")).otherwise(none).alias("n"), one.alias("ins"), none.alias("outs"), F.lit(True).alias("fed"))))
    return edges.select(side.alias("e")).select("e.*").groupBy("id").agg(F.sum("n").alias("n"), F.sum("ins").alias("ins"), F.sum("outs").alias("outs"), F.max("fed").alias("fed"))


def class_of() -> Column:
    out, into = F.col("outs") > 0, F.col("ins") > 0
    return F.when(out & ~into, F.lit(SOURCE)).when(out, F.lit(BOTH)).when(into, F.lit(END)).otherwise(F.lit(NONE))


@dataclass
class Plan:
    """Sizes that follow from the input: ``chunks`` of ``width`` dimensions, ``sub`` vertices in a row of a block."""

    d: int
    width: int
    parts: int
    sub: int
    tasks: int
    slices: int = 1                 # of the ends of a block, by hash: all edges of an end from a block are sorted together
    apart: bool = False             # every slice in a task of its own
    seeds: tuple = (3, "java", 42)
    given: bool = False
    counts: np.ndarray = None       # vertices of each block by class
    outs: np.ndarray = None         # edges that leave each block

    @property
    def chunks(self) -> int:
        return math.ceil(self.d / self.width)

    def size(self, p: int) -> int:
        return int(self.counts[p].sum())

    def sources(self, p: int) -> int:
        return int(self.counts[p, :END].sum())

    def ends(self, p: int) -> tuple[int, int]:
        """Places of the first end and after the last."""
        return int(self.counts[p, SOURCE]), int(self.counts[p, :NONE].sum())

    def dims(self, k: int) -> tuple[int, int]:
        return k * self.width, min(self.d, (k + 1) * self.width)

    def dealt(self, most: int, chunks: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first task of each block of sources, and its tasks, each with some slices of ends: at most about
        ``most`` edges in each, and some tasks for every core if ``chunks`` run at once."""
        limit = min(most, max(SPLIT_EDGES, int(self.outs.sum()) * chunks // (3 * self.tasks)))
        all_slices = self.parts * self.slices
        many = np.full(self.parts, all_slices) if self.apart else np.clip(-(-self.outs // limit), 1, all_slices)
        return np.cumsum(many) - many, many

    def sent(self, p: int) -> int:
        """Most bytes of sums of a chunk that are sent to a block."""
        low, high = self.ends(p)
        return 8 * self.width * (high - low) * self.parts

    def groups(self) -> list[list[int]]:
        """Chunks that run at once: some more than ``JOB_BYTES`` if half of the cores would have no block."""
        size = max(JOB_BYTES // max(1, sum(self.sent(p) for p in range(self.parts))), math.ceil(self.tasks / 2 / self.parts))
        return [list(range(k, min(k + size, self.chunks))) for k in range(0, self.chunks, size)]

    def waves(self, chunks: int, size=None) -> list[list[int]]:
        """Blocks of ends that run at once, at ``size`` bytes each: at least one for half of the cores."""
        waves, held = [[]], 0
        for p in range(self.parts):
            need = (size or self.sent)(p) * chunks
            if len(waves[-1]) * chunks >= (1 if size else self.tasks / 2) and held + need > JOB_BYTES:
                waves, held = [*waves, []], 0
            waves[-1].append(p)
            held += need
        return waves


def sizes(d: int, sources: int, ends: int, edges: int, tasks: int, least: int = 1) -> Plan:
    """Wide chunks send packs fewer times, narrow ones need fewer blocks and so fewer copies of sums. ``least``: blocks needed
    for another reason."""
    held, found = max(sources, ends, 1), []
    for width in {math.ceil(d / math.ceil(d / min(w, d))) for w in WIDTHS}:
        parts = max(math.ceil(held * 8 * width / BLOCK_BYTES), least, math.ceil(tasks / math.ceil(d / width)))
        copies = min(parts, max(1.0, edges / max(1, ends)))
        found.append((8 * d * ends * copies + 8 * edges * math.ceil(d / width), -width, parts))
    _, width, parts = min(found)
    width = -width
    rows = max(1, min(ROW_BYTES // (8 * width), max(256, VERTEX_BYTES // (8 * d))))
    return Plan(d, width, parts, rows, tasks, max(1, math.ceil(edges / parts ** 2 / SLICE_EDGES)))


# ---------------------------------------------------------------- blocks of vertices

def cut_blocks(size: int, d: int, width: int, given: bool):
    """Rows of sorted vertices ``(part, id, n, x)``: ids with in-edge counts (kind 0), given vectors of a chunk (kind 1) with
    their places in the row."""
    def cut(batches):
        part, held, at = None, [], 0

        def out(rows):
            p, sub = part, at
            ids = np.concatenate([r[0] for r in rows])
            n = np.concatenate([r[1] for r in rows])
            yield _rows(BLOCK_ROW, [(p, sub, 0, len(ids), ids.tobytes(), n.tobytes())])
            if given:
                has = np.flatnonzero(np.concatenate([r[2] for r in rows]))
                if len(has):
                    x = np.concatenate([r[3] for r in rows])
                    for k in range(math.ceil(d / width)):
                        yield _rows(BLOCK_ROW, [(p, sub, 1, k, has.astype(np.int32).tobytes(), _padded(x[:, k * width:(k + 1) * width], width).tobytes())])

        for batch in batches:
            parts = batch.column("part").to_numpy()
            first = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(parts) else []
            for a, b in zip(first, [*first[1:], len(parts)]):
                if parts[a] != part:
                    if held:
                        yield from out(held)
                    part, held, at = int(parts[a]), [], 0
                while a < b:
                    room = size - sum(len(r[0]) for r in held)
                    some = batch.slice(a, min(room, b - a))
                    row = [some.column("id").to_numpy(), some.column("n").to_numpy()]
                    if given:
                        x = some.column("x")
                        row += [x.is_valid().to_numpy(zero_copy_only=False), x.drop_null().flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, d)]
                    held.append(row)
                    a += some.num_rows
                    if some.num_rows == room:
                        yield from out(held)
                        held, at = [], at + 1
        if held:
            yield from out(held)

    return cut


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x)


def blocks(vertices: DataFrame, plan: Plan, path: str) -> DataFrame:
    """``BLOCK_ROW`` of ``vertices (id, n, ins, outs, fed, x)`` without null ids; ``n`` is -1 for the end of no edge at all."""
    n = F.when(F.col("ins") > 0, F.col("n").cast("double")).when(F.col("fed"), F.lit(0.0)).otherwise(F.lit(-1.0))
    rows = vertices.withColumn("part", part_of("id", plan.parts)).withColumn("class", class_of())
    rows = rows.repartitionById(plan.parts, "part").sortWithinPartitions("part", "class", "id")
    rows = rows.select("part", "id", n.alias("n"), *(["x"] if plan.given else []))
    with conf_override(vertices.sparkSession, FEW | {"spark.sql.parquet.columnarReaderBatchSize": "4096"}):
        return stored(rows.mapInArrow(cut_blocks(plan.sub, plan.d, plan.width, plan.given), BLOCK_ROW), path, options=TABLE)


# ---------------------------------------------------------------- packs of edges

def split_edges(parts: int, slices: int, first: np.ndarray, many: np.ndarray):
    """Rows of edges ``(src, dst, weight, p, q, h)`` for the task of their pair of blocks and slice (kind 1, ``b`` is the slice)."""
    def split(batches):
        held, size = [], 0

        def out():
            src, dst, weight, p, q, h = (np.concatenate(c) for c in zip(*held))
            cell = (p.astype(np.int64) * parts + q) * slices + h
            by = np.argsort(cell, kind="stable")
            cell = cell[by]
            start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            rows = []
            for a, b in zip(start, [*start[1:], len(cell)]):
                i, g = divmod(int(cell[a]), parts * slices)
                for c in range(a, b, PACK_EDGES):
                    take = by[c:min(b, c + PACK_EDGES)]
                    rows.append((int(first[i]) + g % int(many[i]), i, 1, g // slices, g % slices, src[take].tobytes(), dst[take].tobytes(), weight[take].tobytes(), None))
                    if len(rows) >= 64:
                        yield _rows(ROW, rows)
                        rows = []
            if rows:
                yield _rows(ROW, rows)

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(k).to_numpy() for k in ("src", "dst", "weight", "p", "q", "h")])
                size += batch.num_rows
            if size >= SPLIT_EDGES:
                yield from out()
                held, size = [], 0
        if held:
            yield from out()

    return split


def _small(weight: np.ndarray) -> bytes:
    """Weights as nothing (all 1), as bytes, or as doubles."""
    if (weight == 1).all():
        return b""
    if (np.abs(weight) <= 127).all() and (weight == np.rint(weight)).all():
        return weight.astype(np.int8).tobytes()
    return weight.tobytes()


def packs_of(src: np.ndarray, dst: np.ndarray, weight: np.ndarray):
    """Packs ``(b, u, v, w, x)`` of edges by place: sources ``u`` of one line after the other, ``v`` the end of each line, ``w`` its
    edges (at most ``RUN``, most first), ``x`` weights. ``b`` is 1 if an end has several lines."""
    by = np.argsort(dst, kind="stable")
    src, dst, weight = src[by].astype(np.int32), dst[by].astype(np.int32), weight[by]
    for a in range(0, len(src), PACK_EDGES):
        s, e, w = src[a:a + PACK_EDGES], dst[a:a + PACK_EDGES], weight[a:a + PACK_EDGES]
        first = np.flatnonzero(np.r_[True, e[1:] != e[:-1]])
        count = np.diff(np.r_[first, len(e)])
        several = int((count > RUN).any())
        if several:     # more lines of an end
            lines = -(-count // RUN)
            nth = np.arange(lines.sum()) - np.repeat(np.cumsum(lines) - lines, lines)
            first, count = np.repeat(first, lines) + nth * RUN, np.minimum(RUN, np.repeat(count, lines) - nth * RUN)
        order = np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        edge = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(len(e))
        yield several, s[edge].tobytes(), e[first].tobytes(), count.astype(np.uint8).tobytes(), _small(w[edge])


def index_edges(sub: int, slices: int):
    """Packs of the pairs of blocks of a task, from ids of the block of sources (kind 0, ``a`` -1), ids of each block of ends (kind 0)
    and edges by id (kind 1), sorted by pair, kind and row of the block or slice. ``task`` numbers the slices of all ends."""
    def places(ids):
        """Sorted ids and their places."""
        at = np.concatenate([i for _, i in ids])
        place = np.concatenate([np.arange(b * sub, b * sub + len(i)) for b, i in ids])
        by = np.argsort(at, kind="stable")
        return at[by], place[by]

    def index(batches):
        part, end, slice_, sources, ends, held, size = None, None, 0, [], [], [], 0
        known = [None, None]

        def out():
            for k, ids in enumerate((sources, ends)):
                known[k] = known[k] or places(ids)
            src, dst, weight = (np.concatenate(c) for c in zip(*held))
            src, dst = (place[np.searchsorted(at, key)] for (at, place), key in zip(known, (src, dst)))
            for pack in packs_of(src, dst, weight):
                yield _rows(ROW, [(end * slices + slice_, part, 3, end, *pack)])

        for p, kind, a, b, u, v, w in _each(batches, "part", "kind", "a", "b", "u", "v", "w"):
            if (p, a) != (part, end):
                if held:
                    yield from out()
                if p != part:
                    sources, known[0] = [], None
                part, end, ends, known[1], held, size = p, a, [], None, [], 0
            if kind == 0:
                (sources if a < 0 else ends).append((b, _array(u, np.int64).copy()))
            else:
                if held and (b != slice_ or size >= 2 * SLICE_EDGES):
                    yield from out()
                    held, size = [], 0
                slice_ = b
                held.append((_array(u, np.int64), _array(v, np.int64), _array(w, np.float64)))
                size += len(held[-1][0])
        if held:
            yield from out()

    return index


def _lookup(values, key: str = "part") -> Column:
    return F.get(F.array(*[F.lit(int(v)) for v in values]), F.col(key))


def _numbers(n) -> Column:
    return F.explode(F.sequence(F.lit(0), (n if isinstance(n, Column) else F.lit(n)) - 1))


def _row(df: DataFrame, **columns) -> DataFrame:
    """``df`` as ``ROW``."""
    kinds = dict(c.split() for c in ROW.split(", "))
    values = [(v if isinstance(v, Column) else F.lit(v)) for v in (columns.get(k) for k in NAMES)]
    return df.select(*[F.coalesce(v, F.lit(0)).cast("int").alias(k) if kinds[k] == "int" else v.cast("binary").alias(k) for k, v in zip(NAMES, values)])


def _dealt(rows: DataFrame, tasks: int, function, schema: str, *order: str) -> DataFrame:
    rows = rows.repartitionById(tasks, "task")
    return (rows.sortWithinPartitions(*order) if order else rows).mapInArrow(function, schema)


#: Rows of these tables are large: few of them at a time, on the way to Python, from and to Parquet.
FEW = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.parquet.columnarReaderBatchSize": "16", "spark.sql.adaptive.enabled": "false"}
TABLE = {"compression": "zstd", "parquet.block.size": str(16 * 1024 * 1024)}


def packs(edges: DataFrame, table: DataFrame, plan: Plan, path: str) -> DataFrame:
    """``ROW`` of kind 3 for all edges with two ends: ``part`` and ``a`` are the pair of blocks (see ``packs_of``)."""
    first, many = plan.dealt(INDEX_EDGES, 1)
    split = edges.where("src is not null and dst is not null").select(
        "src", "dst", "weight", part_of("src", plan.parts).alias("p"), part_of("dst", plan.parts).alias("q"),
        F.pmod(F.xxhash64("dst", F.lit(2)), F.lit(plan.slices)).cast("int").alias("h"))
    split = split.mapInArrow(split_edges(plan.parts, plan.slices, first, many), ROW)
    ids = table.where("kind = 0")
    sources = ids.where(F.col("sub") * plan.sub < _lookup(plan.sources(p) for p in range(plan.parts))).withColumn("r", _numbers(_lookup(many)))
    sources = _row(sources, task=_lookup(first) + F.col("r"), part=F.col("part"), kind=0, a=-1, b=F.col("sub"), u=F.col("u"))
    ends = with_ends(ids, plan).withColumn("p", _numbers(plan.parts))
    ends = ends.withColumn("g", F.sequence(F.col("part") * plan.slices, (F.col("part") + 1) * plan.slices - 1))
    ends = ends.withColumn("many", _lookup(many, "p")).withColumn("g", F.explode(F.array_distinct(F.transform("g", lambda g: g % F.col("many")))))
    ends = _row(ends, task=_lookup(first, "p") + F.col("g"), part=F.col("p"), kind=0, a=F.col("part"), b=F.col("sub"), u=F.col("u"))
    rows = split.unionByName(sources).unionByName(ends)
    with conf_override(edges.sparkSession, FEW | {"spark.sql.parquet.columnarReaderBatchSize": "4096"}):
        return stored(_dealt(rows, int(many.sum()), index_edges(plan.sub, plan.slices), ROW, "part", "a", "kind", "b"), path, options=TABLE)


def with_ends(rows: DataFrame, plan: Plan) -> DataFrame:
    """Rows of blocks that hold ends of edges."""
    low, high = zip(*(plan.ends(p) for p in range(plan.parts)))
    return rows.where(((F.col("sub") + 1) * plan.sub > _lookup(low)) & (F.col("sub") * plan.sub < _lookup(high)))


# ---------------------------------------------------------------- a hop

def pack_sums(x: np.ndarray, src, dst, count, weight, several: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a pack and the weighted sums of their sources' rows of ``x``."""
    count = count.astype(np.int64)
    first = np.cumsum(count) - count
    out = np.zeros((len(dst), x.shape[1]))
    buffer = np.empty((min(LINES, len(dst)), x.shape[1]))
    for a in range(0, len(dst), LINES):
        lines, most, sums = first[a:a + LINES], -count[a:a + LINES], out[a:a + LINES]
        for j in range(-int(most[0])):
            at = lines[:np.searchsorted(most, -j)] + j
            rows = np.take(x, src[at], axis=0, out=buffer[:len(at)], mode="clip")
            if weight is not None:
                w = weight[at]
                other = np.flatnonzero(w != 1)
                if len(other):
                    rows[other] *= w[other, None]
            sums[:len(at)] += rows
    if several:
        by = np.argsort(dst, kind="stable")
        dst = dst[by]
        start = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]])
        dst, out = dst[start], np.add.reduceat(out[by], start, axis=0)
    return dst, out


def push(plan: Plan, chunks: list[int], to: dict[int, int], first_hop: bool):
    """Sums for the ends (kind 1) from a block's ids, given vectors, state and packs (kinds 0 to 3, in order)."""
    def run(batches):
        task, x, k, known = None, None, 0, 0
        width, piece = plan.width, max(1, ROW_BYTES // (8 * plan.width))
        for t, part, kind, a, b, u, v, w, z in _each(batches, *NAMES):
            if t != task:
                task, k = t, chunks[t % len(chunks)]
                x = None
                x = np.zeros((plan.sources(part), width))
                known = plan.sources(part) if first_hop else int(plan.counts[part, SOURCE])
            start = a * plan.sub
            if kind == 0:
                ids = _array(u, np.int64)[:max(0, known - start)]
                low, high = plan.dims(k)
                x[start:start + len(ids), :high - low] = seed_block(ids, low, high, *plan.seeds)
            elif kind == 1:
                at = start + _array(u, np.int32).astype(np.int64)
                some = at < known
                x[at[some]] = _array(v, np.float64).reshape(-1, width)[some]
            elif kind == 2:
                start = max(start, plan.ends(part)[0])
                rows = _array(v, np.float64).reshape(-1, width)[:max(0, len(x) - start)]
                x[start:start + len(rows)] = rows
            else:
                weight = None if z is None or not z.size else _array(z, np.int8 if z.size * 4 == u.size else np.float64)
                dst, sums = pack_sums(x, _array(u, np.int32), _array(v, np.int32), _array(w, np.uint8), weight, b)
                for c in range(0, len(dst), piece):
                    yield _rows(ROW, [(to[a] * len(chunks) + t % len(chunks), a, 1, k, 0, dst[c:c + piece].tobytes(), sums[c:c + piece].tobytes(), None, None)])

    return run


def add(plan: Plan):
    """``STATE_ROW`` of ends, from in-edge counts (kind 0, ``b`` is the row of the block) and sums (kind 1) in any order."""
    def run(batches):
        cells = {}
        for part, kind, k, b, u, v in _each(batches, "part", "kind", "a", "b", "u", "v"):
            low, high = plan.ends(part)
            if (part, k) not in cells:
                cells[part, k] = np.zeros((high - low, plan.width)), np.ones(high - low)
            total, n = cells[part, k]
            if kind == 0:
                start, some = b * plan.sub, _array(v, np.float64)
                a, z = max(low, start), min(high, start + len(some))
                n[a - low:z - low] = some[a - start:z - start]
            else:
                total[_array(u, np.int32) - low] += _array(v, np.float64).reshape(-1, plan.width)
        for part, k in list(cells):
            total, n = cells.pop((part, k))
            total /= n[:, None]
            low, high = plan.ends(part)
            for s in range(low // plan.sub, -(-high // plan.sub)):
                a, z = max(low, s * plan.sub), min(high, (s + 1) * plan.sub)
                yield _rows(STATE_ROW, [(part, s, k, total[a - low:z - low].tobytes())])

    return run


def hop(table: DataFrame, packed: DataFrame, state: DataFrame | None, plan: Plan, chunks: list[int], path: str, waves: list[list[int]]) -> DataFrame:
    """State of the ends after a hop of ``chunks``, from their ``state`` before (none: the first hop)."""
    many_chunks, out = len(chunks), None
    first, many = plan.dealt(TASK_EDGES, many_chunks)
    seeded = plan.counts[:, :BOTH].sum(1) if state is not None else plan.counts[:, :END].sum(1)
    own = table.where(F.col("sub") * plan.sub < _lookup(seeded)).withColumn("r", _numbers(_lookup(many)))
    sources = _row(own.where("kind = 0").withColumn("k", _numbers(many_chunks)), task=(_lookup(first) + F.col("r")) * many_chunks + F.col("k"),
                   part=F.col("part"), kind=0, a=F.col("sub"), u=F.col("u"))
    if plan.given:
        given = own.where(F.col("kind") == 1).where(F.col("b").between(chunks[0], chunks[-1]))
        sources = sources.unionByName(_row(given, task=(_lookup(first) + F.col("r")) * many_chunks + F.col("b") - chunks[0],
                                           part=F.col("part"), kind=1, a=F.col("sub"), u=F.col("u"), v=F.col("v")))
    if state is not None:
        both = state.where(F.col("sub") * plan.sub < _lookup(plan.counts[:, :END].sum(1))).withColumn("r", _numbers(_lookup(many)))
        sources = sources.unionByName(_row(both, task=(_lookup(first) + F.col("r")) * many_chunks + F.col("chunk") - chunks[0],
                                           part=F.col("part"), kind=2, a=F.col("sub"), v=F.col("v")))
    for wave in waves:
        to = {q: i for i, q in enumerate(wave)}
        rows = packed.where(F.col("a").isin(wave)) if len(waves) > 1 else packed
        rows = _row(rows.withColumn("k", _numbers(many_chunks)), task=(_lookup(first) + F.col("task") % _lookup(many)) * many_chunks + F.col("k"),
                    **{k: F.col(k) for k in NAMES[1:]})
        sums = _dealt(sources.unionByName(rows), int(many.sum()) * many_chunks, push(plan, chunks, to, state is None), ROW, "task", "kind")
        counts = with_ends(table.where("kind = 0").where(F.col("part").isin(wave)), plan).withColumn("k", _numbers(many_chunks))
        at = _lookup(to.get(q, 0) for q in range(plan.parts))
        counts = _row(counts, task=at * many_chunks + F.col("k"), part=F.col("part"), kind=0, a=F.col("k") + chunks[0], b=F.col("sub"), v=F.col("v"))
        with conf_override(table.sparkSession, FEW):
            out = stored(_dealt(sums.unionByName(counts), len(wave) * many_chunks, add(plan), STATE_ROW), path, ("part",), options=TABLE, mode="append")
    return out


# ---------------------------------------------------------------- whole vectors

def finish(plan: Plan, r0: float, weights: list[float], terms: list[float], freeze: bool):
    """``(id, x)`` from rows of ids (kind 0), given vectors (kind 1) and states of the hops of ``terms`` (kinds 2, ..), sorted by row of
    the block and kind."""
    def unit(x, weight):
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        with np.errstate(divide="ignore", invalid="ignore"):
            x *= np.where(norm != 0, weight / norm, weight)[:, None]
        return x

    def whole(part, sub, ids, n, given, states):
        low, high = plan.ends(part)
        a, z = (min(max(c - sub * plan.sub, 0), len(ids)) for c in (low, high))
        out = np.zeros((len(ids), plan.d))
        alone = np.ones(len(ids), bool)
        alone[a:z] = False
        weight = np.where(alone & (n >= 0) if freeze else alone, r0 + sum(weights), r0)
        need = np.flatnonzero(weight != 0)
        if len(need):
            x = seed_block(ids[need], 0, plan.d, *plan.seeds)
            if given:
                back = np.full(len(ids), -1)
                back[need] = np.arange(len(need))
                for k, at, rows in given:
                    low, high = plan.dims(k)
                    to = back[at]
                    x[to[to >= 0], low:high] = rows[to >= 0, :high - low]
            out[need] = unit(x, weight[need])
        for term, rows in zip(terms, states):
            if len(rows):
                x = np.concatenate([rows[k] for k in sorted(rows)], axis=1)[:, :plan.d]
                out[a:z] += unit(x, np.full(len(x), term))
        ends = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * plan.d)
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))], ["id", "x"])

    def run(batches):
        now, held = None, None
        for part, kind, sub, b, u, v in _each(batches, "part", "kind", "a", "b", "u", "v"):
            if (part, sub) != now:
                if now:
                    yield whole(*now, *held)
                now, held = (part, sub), [np.empty(0, np.int64), np.empty(0), [], [{} for _ in terms]]
            if kind == 0:
                held[:2] = _array(u, np.int64).copy(), _array(v, np.float64).copy()
            elif kind == 1:
                held[2].append((b, _array(u, np.int32), _array(v, np.float64).reshape(-1, plan.width)))
            else:
                held[3][kind - 2][b] = _array(v, np.float64).reshape(-1, plan.width)
        if now:
            yield whole(*now, *held)

    return run


def vectors(table: DataFrame, states: list[list[DataFrame]], plan: Plan, wave: list[int], function, path: str) -> DataFrame:
    """``(id, x)`` of the blocks of ``wave``; ``states`` of the hops that count, each in several tables."""
    subs = np.array([-(-plan.size(p) // plan.sub) if p in set(wave) else 0 for p in range(plan.parts)])
    tasks = max(1, min(int(subs.sum()), max(3 * plan.tasks, math.ceil(int(subs.sum()) * plan.sub * plan.d * 8 / (8 * VERTEX_BYTES)))))
    task = (_lookup(np.cumsum(subs) - subs) + F.col("sub")) % tasks
    mine = F.col("part").isin(wave)
    rows = _row(table.where(mine), task=task, part=F.col("part"), kind=F.col("kind"), a=F.col("sub"), b=F.col("b"), u=F.col("u"), v=F.col("v"))
    for i, state in ((i, state) for i, some in enumerate(states) for state in some):
        rows = rows.unionByName(_row(state.where(mine), task=task, part=F.col("part"), kind=2 + i, a=F.col("sub"), b=F.col("chunk"), v=F.col("v")))
    with conf_override(table.sparkSession, FEW):
        return stored(_dealt(rows, tasks, function, "id bigint, x array<double>", "part", "a", "kind"), path, options=TABLE, mode="append")
