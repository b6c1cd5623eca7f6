"""FastRP node embeddings as a driver loop of DataFrame hops.

Per hop ``t``::

    x_t(v) = sum_{u->v} w_uv * x_{t-1}(u) / #{u->v}      (v with in-edges)
    x_t(v) = x_{t-1}(v)                                  (v without in-edges)
    result = r0 * norm(x_0) + sum_t weights[t-1] * norm(x_t)

Vertices lie in blocks, edges as packs between blocks (``edge_blocks``). Chunk after chunk of dimensions goes through all hops:
a block's sources meet its packs, numpy sums, and the sums are added up in the block of their ends. Only the states of
hops with a weight are kept, of vertices with in-edges; other vectors follow from the ids or the given vectors. At the end
the chunks of a few thousand vertices at a time are put together, normalised and added to the result. Tables that
nothing reads any more are deleted; each is Parquet, so a lost executor replays one chunk of one hop.

``neighbor_mean`` is a single hop by joins (see ``explain_hop``), a vector being ``ceil(d / CHUNK)`` rows of flat doubles: the state is
hash-partitioned by ``(id, c)`` and the edges by ``(src, c)``, so the edges are not shuffled again; hot sources are salted
(``edge_layout``).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seed import sparse_seed
from ..functions.vectors import vec_norm
from ..session import conf_override, default_parallelism, discard, stored, stored_input, table_path
from . import edge_blocks as B
from .edge_layout import EdgeLayout, compress_edges, lay_out
from .graph import complete_vertices

MODES = ("carry", "freeze")


def given_vectors(x_col: str, d: int) -> Column:
    """The given vector, null where there is none; its length must be ``d``."""
    given = F.col(x_col).cast("array<double>")
    return F.when(given.isNull() | (F.size(given) == F.lit(d)), given).otherwise(
        F.raise_error(F.lit(f"initial vectors must have {d} dimensions")))


def init_vectors(vertices: DataFrame, d: int, sparsity: int = 3, init: bool = True,
                 x_col: str = "x", rng: str = "java", seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, x)``: the given vector when ``init`` and present, else a sparse random seed.
    Given vectors must have length ``d``. Columns in ``keep`` follow."""
    seeded = sparse_seed("id", d, sparsity, rng, seed)
    if init and x_col in vertices.columns:
        x = F.coalesce(given_vectors(x_col, d), seeded)
    else:
        x = seeded
    return vertices.select(F.col("id").cast("bigint").alias("id"), x.alias("x"), *keep)


CHUNK = 32           # most dimensions of a row of state
CHUNK_FIELDS = 4 * CHUNK + 16


def n_chunks(d: int) -> int:
    return max(1, math.ceil(d / CHUNK))


def width(d: int) -> int:
    """Dimensions of a row of state: narrow vectors are one row without filling."""
    return max(1, min(d, CHUNK))


def _names(prefix: str, d: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(width(d))]


def chunked(vectors: DataFrame, d: int) -> DataFrame:
    """``(id, c, v0 .., other columns)`` of ``vectors (id, x, ..)``; the last chunk is filled with zeros."""
    others = [k for k in vectors.columns if k not in ("id", "x")]
    rows = vectors.select("id", "x", *others, F.explode(F.sequence(F.lit(0), F.lit(n_chunks(d) - 1))).alias("c"))
    return rows.select("id", "c", *[F.coalesce(F.get("x", F.col("c") * CHUNK + i), F.lit(0.0)).alias(v) for i, v in enumerate(_names("v", d))], *others)


def joined_chunks(rows: DataFrame, d: int, prefix: str, *others: str) -> DataFrame:
    """``(id, x, others)`` from chunks; ``others`` are the same in each chunk of an id."""
    if n_chunks(d) == 1:
        return rows.select("id", F.slice(F.array(*_names(prefix, d)), 1, d).alias("x"), *others)
    parts = F.array_sort(F.collect_list(F.struct("c", F.array(*_names(prefix, d)).alias("x"))))
    got = rows.groupBy("id").agg(parts.alias("p"), *[F.first(k).alias(k) for k in others])
    return got.select("id", F.slice(F.flatten("p.x"), 1, d).alias("x"), *others)


def edge_layout(edges: DataFrame, d: int, partitions: int, share: int | None = None) -> EdgeLayout:
    """Layout of compressed edges with a row for each chunk."""
    chunk = F.explode(F.sequence(F.lit(0), F.lit(n_chunks(d) - 1)))
    return lay_out(edges, partitions, {"c": chunk}, n_chunks(d), share)


def message_means(state: DataFrame, layout: EdgeLayout, d: int) -> DataFrame:
    """``(id, c, m0 .., n)``: weighted in-neighbour sums over the number of in-edges, of chunks with at least one."""
    msgs = layout.messages(state.select("id", "c", *_names("v", d)))
    sums = [F.sum(F.col(f"v{i}") * F.col("weight")).alias(f"s{i}") for i in range(width(d))]
    agg = msgs.groupBy("dst", "c").agg(*sums, F.sum("n").alias("n"))
    return agg.select(F.col("dst").alias("id"), "c", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in range(width(d))], "n")


def neighbor_mean(state: DataFrame, edges: DataFrame, d: int | None = None, share: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """``(id, x, n)``: weighted in-neighbour sum of ``state (id, x)`` divided by the in-edge count ``n``, for
    vertices with at least one in-edge. Every edge counts, also weight 0 and negative weights."""
    spark = state.sparkSession
    state = stored_input(state.select("id", "x"))      # computed once, also when it comes from a join
    if d is None:
        first = state.select(F.size("x")).first()
        d = int(first[0]) if first else CHUNK
    small = stored_input(compress_edges(edges))
    w = width(d)
    layout = edge_layout(small, w, hop_partitions(spark, small.count(), w, num_partitions), share)
    with conf_override(spark, {"spark.sql.codegen.maxFields": CHUNK_FIELDS}):
        paths = [table_path(spark) for _ in range(n_chunks(d))]
        chunks = _chunk_tables(state, d, at := table_path(spark))
        means = [stored(message_means(v.select("id", "c", *_names("v", d)), layout, w), path) for v, path in zip(chunks, paths)]
        out = stored(joined_chunks(_numbered(means), d, "m", "n"))
    for path in (at, *paths):
        discard(spark, path)
    return out


TARGET_PARTITION_BYTES = 512 * 1024 * 1024


def hop_partitions(spark, n_edges: int, d: int, num_partitions: int | None = None) -> int:
    """Partitions for the hop loop: enough that one partition's messages (``8 d + 24``
    bytes per edge) stay near 512 MB, never fewer than the cluster's default parallelism.
    Larger partitions let the partial aggregation fold more messages per destination
    before the shuffle (measured: 8 partitions beat 20 at sf0.1, d=256)."""
    if num_partitions:
        return int(num_partitions)
    need = math.ceil(n_edges * (8 * d + 24) / TARGET_PARTITION_BYTES)
    return max(default_parallelism(spark), need, 1)


def _chunk_tables(vectors: DataFrame, d: int, path: str) -> list[DataFrame]:
    """``(id, c, v0 .., other columns)`` of each chunk of ``vectors (id, x, ..)``, from one table at ``path``; ``c`` is 0 in
    all: a chunk is one vector to its hop."""
    # c is stored: as a constant in a plan it would drop out of the join keys, and edges would be shuffled again
    rows = chunked(vectors, d).withColumnRenamed("c", "chunk").withColumn("c", F.lit(0))
    table = stored(rows, path, ("chunk",))
    return [table.where(F.col("chunk") == k).drop("chunk") for k in range(n_chunks(d))]


def _numbered(tables: list[DataFrame]) -> DataFrame:
    """One table of the rows of all chunks, with the chunk in ``c``."""
    out = None
    for k, table in enumerate(tables):
        rows = table.withColumn("c", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    return out


def fastrp(vertices: DataFrame, edges: DataFrame, d: int, weights, sparsity: int = 3,
           r0: float = 0.0, init: bool = True, mode: str = "carry", rng: str = "java",
           x_col: str = "x", num_partitions: int | None = None,
           share: int | None = None) -> DataFrame:
    """FastRP embeddings ``(id, x array<double>)`` for every vertex of the graph (given
    vertices plus all edge endpoints).

    ``mode="carry"``: a vertex without in-edges keeps its vector and adds
    ``weights[t] * norm(x_0)`` every hop. ``mode="freeze"``: such a vertex only gets
    ``r0 * norm(x_0)``. Both agree when every vertex has an in-edge. A null weight counts as 1.0;
    of several vertex rows of an id one stays (see ``complete_vertices``). ``share``: edges of a source that may lie in one
    task. ``num_partitions``: tasks that may run at once, by default the cluster's cores.
    """
    weights = [float(w) for w in weights]
    if not weights:
        raise ValueError("weights must not be empty")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    spark = edges.sparkSession
    while weights and weights[-1] == 0.0:   # trailing zero hops add nothing
        weights.pop()
    terms = [r0, *weights]
    added = sum(t != 0.0 for t in terms)
    known, graph, ends, table, packed, result = (table_path(spark) for _ in range(6))

    # the input edge table (often a join or a union) is computed and compressed once; all that follows reads this copy
    edges = stored_input(compress_edges(edges), graph)
    found = stored_input(B.edge_ends(edges), ends)
    both = found.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    verts = complete_vertices(vertices if x_col in vertices.columns else vertices.select("id"), both)
    given = [given_vectors(x_col, d).alias("x")] if init and x_col in vertices.columns else []
    verts = verts.select(F.col("id").cast("bigint").alias("id"), *given).join(found, "id", "left")
    verts = stored_input(verts.select("id", *[F.coalesce(k, F.lit(0)).cast("bigint").alias(k) for k in ("n", "ins", "outs")],
                                      F.coalesce("fed", F.lit(False)).alias("fed"), *(["x"] if given else [])), known)
    whole = verts.where("id is not null")
    size = whole.agg(*[F.coalesce(c, F.lit(0)) for c in (F.count_if(F.col("outs") > 0), F.count_if(F.col("ins") > 0), F.sum("outs"), F.max("outs"))]).first()
    plan = B.sizes(d, *size[:3], num_partitions or default_parallelism(spark), math.ceil(size[3] / share) if share else 1)
    plan.apart, plan.seeds, plan.given = share is not None, (sparsity, rng, 42), bool(given)
    plan.counts, plan.outs = np.zeros((plan.parts, 4), np.int64), np.zeros(plan.parts, np.int64)
    for p, c, k, out in whole.groupBy(B.part_of("id", plan.parts), B.class_of()).agg(F.count("*"), F.sum("outs")).collect():
        plan.counts[p, c], plan.outs[p] = k, plan.outs[p] + out
    blocks = B.blocks(whole, plan, table)
    states, kept = [[] for _ in weights], []
    if weights and size[2]:
        packs = B.packs(edges, blocks, plan, packed)
        for path in (graph, ends):
            discard(spark, path)
        for chunks in plan.groups():
            state = before = None
            for t, weight in enumerate(weights):
                path = table_path(spark)
                state = B.hop(blocks, packs, state, plan, chunks, path, plan.waves(len(chunks)))
                if weight != 0.0:
                    states[t].append(state)
                    kept.append(path)
                if before:
                    discard(spark, before)
                before = None if weight != 0.0 else path
        discard(spark, packed)
    counting = [t for t, weight in enumerate(weights) if weight != 0.0]
    final = B.finish(plan, r0, weights, [weights[t] for t in counting], mode == "freeze")
    for wave in plan.waves(1, lambda p: 8 * d * (len(counting) + 1) * plan.size(p)):
        out = B.vectors(blocks, [states[t] for t in counting], plan, wave, final, result)
        for path in kept:
            for p in wave:
                discard(spark, f"{path}/part={p}")
    if not (added > 1 or (added and n_chunks(d) > 1)):    # terms and norms meet by id
        total = r0 + (sum(weights) if mode == "carry" else 0.0)
        lost = init_vectors(verts.where("id is null"), d, sparsity, init, "x", rng)
        norm = vec_norm("x")
        factor = F.when(norm != 0, F.lit(total) / norm).otherwise(F.lit(total))
        out = stored(lost.select("id", F.transform("x", lambda v: F.coalesce(v, F.lit(0.0)) * factor).alias("x")), result, mode="append")
    for path in (known, graph, ends, table, *kept):
        discard(spark, path)
    return out


def explain_hop(state: DataFrame, layout: EdgeLayout, d: int, mode: str = "formatted") -> str:
    """Physical plan of one hop (for inspection), ``state`` in chunks."""
    plan = state.join(message_means(state, layout, d), ["id", "c"], "left")
    return plan._jdf.queryExecution().explainString(
        plan.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
