"""Cosine nearest neighbours: one query, many named queries, all pairs; LSH codes.

* ``knn_query``: one query vector enters the plan as a literal; every vector row computes its
  distance (no join) and ``k+1`` rows are kept.
* ``knn_by_name``: up to ``REPLICATED_BYTES`` the query vectors travel to the vectors, which are
  scanned where they lie, with one bounded list per query and task; beyond that queries are a table
  and meet the vectors block by block, as in the all-pairs form.
* ``knn_all_pairs``: exact blocked all-pairs. Vectors are hashed into ``B`` blocks; each
  (query block, candidate block) pair is one ``applyInArrow`` group holding about
  ``2 n / B`` vectors, where numpy multiplies the blocks and emits only ``k`` rows per query. A final
  ``row_number`` keeps ``k`` of the ``B k`` candidates per source. Every vector is shipped ``2 B`` times, so blocks
  grow with the table up to ``BLOCK_BYTES``; the distances themselves are ``n^2`` by nature.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seed import JavaRandom
from ..functions.vectors import cosine_distance, vec_dot


REPLICATED_BYTES = 64 << 20     # query vectors that every task may hold
UNNAMED_ROWS = 1 << 20          # ids without a name that every task may hold
SCAN_CELLS = 2_000_000          # distances in memory at once
BLOCKS = 16                     # blocks of a side, as long as they stay below BLOCK_BYTES
BLOCK_BYTES = 16 << 20          # vectors of a side that one group may hold


def _top_per_group(df: DataFrame, group: str, k: int, order=("dist", "id")) -> DataFrame:
    """``k`` best rows per group with a 0-based ``rank``. The filter is on the raw
    ``row_number`` so the optimizer plans a partial WindowGroupLimit before the shuffle
    (each map task sends at most ``k`` rows per group)."""
    w = Window.partitionBy(group).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return (df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= F.lit(k))
            .withColumn("rank", F.col("_rn") - 1).drop("_rn"))


def _distances_to_queries(vectors: DataFrame, qvecs, x_col: str = "x") -> DataFrame:
    """``(qid, id, dist)`` for each vector and each literal query vector."""
    qlit = F.array(*[F.array(*[F.lit(float(v)) for v in q]) for q in qvecs])
    x = F.col(x_col).cast("array<double>")
    dists = F.transform(qlit, lambda q: cosine_distance(x, q))
    return vectors.select("id", F.posexplode(dists).alias("qid", "dist"))


def knn_query(vectors: DataFrame, query, k: int = 10, names: DataFrame | None = None,
              x_col: str = "x") -> DataFrame:
    """``k+1`` nearest vectors to one query vector (the query itself is usually one of them):
    ``(dist, id[, name])``, ordered by distance then id; NaN distances sort last."""
    q = [float(v) for v in query]
    d = _distances_to_queries(vectors, [q], x_col).select("dist", "id")
    if names is not None:
        d = d.join(names.select("id", "name"), "id")
    return d.orderBy(F.col("dist").asc_nulls_last(), F.col("id")).limit(k + 1).select(
        "dist", "id", *(["name"] if names is not None else []))


def vector_of(vectors: DataFrame, vid: int, x_col: str = "x"):
    """Point lookup of one vector (``d`` numbers to the driver); unknown id raises."""
    row = vectors.filter(F.col("id") == F.lit(int(vid))).select(x_col).first()
    if row is None:
        raise ValueError(f"no vector for id {vid}")
    return list(row[0])


def knn_by_name(names: DataFrame, vectors: DataFrame, sites, k: int = 10, x_col: str = "x",
                block_rows: int = 4000, replicated_bytes: int = REPLICATED_BYTES) -> DataFrame:
    """Many by-name queries in one job: ``(query, query_id, rank, dist, id, name)``, ``k+1`` rows
    per query. ``sites`` is a list of names or a one-column DataFrame of names; every
    name must exist (the reference's ``lookup(..).head`` throws otherwise). Vectors without a
    name are left out before the top-k, so they take no places. Query vectors of at most
    ``replicated_bytes`` in all are shipped to the scan of the vectors, which then do not move;
    more queries stay distributed and meet the vectors block by block. Both ways give the same rows."""
    spark = names.sparkSession
    if isinstance(sites, DataFrame):
        site_df = sites.select(F.col(sites.columns[0]).alias("name"))
    else:
        site_df = spark.createDataFrame([(s,) for s in sites], "name string")
    known = names.select("id", "name")
    plain = vectors.select(F.col("id").cast("bigint").alias("id"), x_col)
    first = plain.where(F.col(x_col).isNotNull()).select(F.size(x_col)).first()
    d = int(first[0]) if first else 0
    fit = replicated_bytes // (8 * max(d, 1))
    asked = known.join(site_df, "name").select(F.col("name").alias("query"), F.col("id").cast("bigint").alias("query_id"))
    found = asked.limit(fit + 1).collect()
    if len(found) <= fit:
        return _by_name_scanned(known, plain, site_df, found, k, d, x_col)
    v = plain.join(known.select("id"), "id", "left_semi")
    named = asked.join(v.withColumnRenamed("id", "query_id"), "query_id").select("query", "query_id", x_col)
    _refuse_missing(site_df, named)
    queries = named.select(F.col("query_id").alias("id"), x_col).dropDuplicates(["id"])
    cands = _blocked_candidates(queries, v, k + 1, d, exclude_self=False, block_rows=block_rows, x_col=x_col)
    top = _top_per_group(cands, "src", k + 1, ("dist", "dst"))
    return (top.select(F.col("src").alias("query_id"), "rank", "dist", F.col("dst").alias("id"))
            .join(named.select("query", "query_id"), "query_id").join(known, "id")
            .select("query", "query_id", "rank", "dist", "id", "name"))


def _refuse_missing(site_df: DataFrame, named: DataFrame) -> None:
    missing = site_df.join(named.select(F.col("query").alias("name")), "name", "left_anti").limit(10).collect()
    if missing:
        raise ValueError(f"unknown names: {[r['name'] for r in missing]}")


def _by_name_scanned(known: DataFrame, plain: DataFrame, site_df: DataFrame, found, k: int, d: int, x_col: str) -> DataFrame:
    """The replicated way of ``knn_by_name`` for the looked-up ``found (query, query_id)``."""
    spark = known.sparkSession
    ids = spark.createDataFrame([(i,) for i in sorted({r["query_id"] for r in found})], "id bigint")
    rows = plain.where(F.col(x_col).isNotNull()).join(F.broadcast(ids), "id").select("id", F.col(x_col).cast("array<double>").alias("x"))
    held = {r["id"]: r["x"] for r in rows.groupBy("id").agg(F.min("x").alias("x")).collect()}
    named = spark.createDataFrame([(r["query"], r["query_id"]) for r in found if r["query_id"] in held], "query string, query_id bigint")
    _refuse_missing(site_df, named)
    qid = np.array(sorted(held), dtype=np.int64)
    Q = np.array([held[i] for i in qid.tolist()], dtype=np.float64).reshape(len(qid), d)
    # only ids are compared to find vectors without a name; few are shipped, many are joined away
    unnamed = plain.select("id").join(known.select("id"), "id", "left_anti").distinct().limit(UNNAMED_ROWS + 1)
    skip = np.array(sorted(r["id"] for r in unnamed.collect()), dtype=np.int64)
    if len(skip) > UNNAMED_ROWS:
        plain, skip = plain.join(known.select("id"), "id", "left_semi"), skip[:0]
    x = plain.select("id", F.col(x_col).cast("array<double>").alias("x")).where("id is not null and x is not null")
    cands = x.mapInArrow(_scan_topk(qid, Q, skip, k + 1), "src bigint, dst bigint, dist double")
    cands = cands.withColumn("dist", F.coalesce("dist", F.lit(float("nan"))))
    top = _top_per_group(cands, "src", k + 1, ("dist", "dst"))      # k + 1 rows for each held query
    top = top.select(F.col("src").alias("query_id"), "rank", "dist", F.col("dst").alias("id"))
    return (known.join(F.broadcast(top), "id").join(F.broadcast(named), "query_id")
            .select("query", "query_id", "rank", "dist", "id", "name"))


def _scan_topk(qid: np.ndarray, Q: np.ndarray, skip: np.ndarray, k: int):
    """Arrow batches ``(id, x)`` -> the ``k`` nearest ``(src, dst, dist)`` of each query among the rows of a task."""
    def fn(batches):
        qn = np.linalg.norm(Q, axis=1)
        best_d, best_i = np.empty((len(qid), 0)), np.empty((len(qid), 0), dtype=np.int64)
        step = max(1, SCAN_CELLS // max(1, len(qid)))
        for batch in batches:
            for s in range(0, batch.num_rows, step):
                part = batch.slice(s, step)
                cid = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                named = ~np.isin(cid, skip)
                C = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(cid), Q.shape[1])[named]
                cid = cid[named]
                den = np.outer(qn, np.linalg.norm(C, axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    D = 1.0 - (Q @ C.T) / den
                D[den == 0] = np.nan
                best_i = np.concatenate([best_i, np.broadcast_to(cid, D.shape)], axis=1)
                best_d = np.concatenate([best_d, D], axis=1)
                order = np.lexsort((best_i, best_d), axis=1)[:, :k]       # by distance, then id; NaN last
                best_d, best_i = np.take_along_axis(best_d, order, 1), np.take_along_axis(best_i, order, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(qid, best_i.shape[1])), pa.array(best_i.reshape(-1)),
                                          pa.array(best_d.reshape(-1))], ["src", "dst", "dist"])
    return fn


def block_count(n: int, block_rows: int, d: int) -> int:
    """Blocks of ``n`` vectors: of ``block_rows`` rows in small tables, ``BLOCKS`` of them in larger ones, and as
    many as ``BLOCK_BYTES`` needs beyond that."""
    most = max(block_rows, BLOCK_BYTES // (8 * max(d, 1)))
    return max(1, math.ceil(n / min(most, max(block_rows, math.ceil(n / BLOCKS)))))


def _nearest(D: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` smallest values of each row of ``D``, in order; ties by column, NaN last."""
    bound = np.partition(D, k - 1, axis=1)[:, k - 1]
    near = D <= bound[:, None]
    short = np.isnan(bound)             # fewer than k numbers: all of the row stays
    near[short] = True
    rows, cols = np.nonzero(near)
    order = np.lexsort((cols, D[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], cols[keep]


def _block_topk(k: int, d: int, exclude_self: bool = True):
    exclude_self = int(exclude_self)
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("dist", pa.float64())])

    def side(t: pa.Table, which: int) -> tuple[np.ndarray, np.ndarray]:
        t = t.filter(pc.equal(t["side"], which)).sort_by("id")
        if pc.any(pc.fill_null(pc.not_equal(pc.list_value_length(t["x"]), d), True)).as_py():
            raise ValueError(f"vectors must have {d} dimensions")
        x = pc.list_flatten(t["x"]).to_numpy().astype(np.float64)
        return t["id"].to_numpy(), x.reshape(t.num_rows, d)

    def fn(t: pa.Table) -> pa.Table:
        (qid, Q), (cid, C) = side(t, 0), side(t, 1)
        if len(qid) == 0 or len(cid) == 0:
            return schema.empty_table()
        qn = np.linalg.norm(Q, axis=1)
        cn = np.linalg.norm(C, axis=1)
        # one more than asked, as the query itself may be among them; it is dropped by id
        kk = min(k + exclude_self, len(cid))
        out_src, out_dst, out_dist = [], [], []
        step = max(1, SCAN_CELLS // len(cid))      # rows of Q per chunk: bounded memory
        for s in range(0, len(qid), step):
            D = Q[s:s + step] @ C.T
            den = np.outer(qn[s:s + step], cn)
            with np.errstate(divide="ignore", invalid="ignore"):
                np.divide(D, den, out=D)
            np.subtract(1.0, D, out=D)
            D[den == 0] = np.nan
            rows, cols = _nearest(D, kk)
            keep = qid[s:s + step][rows] != cid[cols] if exclude_self else slice(None)
            out_src.append(qid[s:s + step][rows][keep])
            out_dst.append(cid[cols][keep])
            out_dist.append(D[rows, cols][keep])
        return pa.table([np.concatenate(x) for x in (out_src, out_dst, out_dist)], schema=schema)
    return fn


def _blocked_candidates(queries: DataFrame, cands: DataFrame, k: int, d: int, exclude_self: bool = True,
                        block_rows: int = 4000, n: int | None = None, x_col: str = "x") -> DataFrame:
    """``(src, dst, dist)``: for each query, its ``k`` nearest candidates inside each
    candidate block. Candidates are hashed into ``block_count`` blocks; queries
    are hashed the same way when both sides are the same table (all pairs) and every
    query meets every candidate block. One ``applyInArrow`` group per (query block,
    candidate block) holds about ``block_rows`` vectors per side, in large tables more (see ``block_count``)."""
    q = queries.select(F.col("id").cast("bigint").alias("id"), F.col(x_col).cast("array<double>").alias("x"))
    c = cands.select(F.col("id").cast("bigint").alias("id"), F.col(x_col).cast("array<double>").alias("x"))
    n_c = n if n is not None else c.count()
    n_q = n if n is not None else q.count()
    Bc, Bq = block_count(n_c, block_rows, d), block_count(n_q, block_rows, d)
    qb = q.withColumn("a", F.pmod(F.xxhash64("id"), F.lit(Bq)).cast("int"))
    cb = c.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(Bc)).cast("int"))
    qrep = qb.select("a", F.explode(F.sequence(F.lit(0), F.lit(Bc - 1))).alias("b"), "id", "x",
                     F.lit(0).alias("side"))
    crep = cb.select(F.explode(F.sequence(F.lit(0), F.lit(Bq - 1))).alias("a"), "b", "id", "x",
                     F.lit(1).alias("side"))
    found = (qrep.unionByName(crep).groupBy("a", "b")
             .applyInArrow(_block_topk(k, d, exclude_self), "src long, dst long, dist double"))
    return found.withColumn("dist", F.coalesce("dist", F.lit(float("nan"))))


def knn_all_pairs(vectors: DataFrame, k: int = 10, names: DataFrame | None = None, x_col: str = "x",
                  block_rows: int = 4000, d: int | None = None) -> DataFrame:
    """Exact k nearest (cosine) of every vector among all others:
    ``(src, dst, dist, rank)`` (+ ``src_name``, ``dst_name``), rank 0-based, ties by id. With
    ``names``, vectors without a name are left out before the top-k. Distances to zero vectors
    are NaN and come last."""
    v = vectors.select(F.col("id").cast("bigint").alias("id"), F.col(x_col).cast("array<double>").alias("x"))
    if names is not None:
        v = v.join(names.select("id"), "id", "left_semi")
    n = v.count()
    if d is None:
        first = v.select(F.size("x")).first()
        d = int(first[0]) if first else 0
    cand_rows = _blocked_candidates(v, v, k, d, block_rows=block_rows, n=n)
    out = _top_per_group(cand_rows, "src", k, ("dist", "dst"))
    if names is not None:
        nm = names.select("id", "name")
        out = (out.join(nm.select(F.col("id").alias("src"), F.col("name").alias("src_name")), "src")
                  .join(nm.select(F.col("id").alias("dst"), F.col("name").alias("dst_name")), "dst"))
        return out.select("src", "dst", "dist", "rank", "src_name", "dst_name")
    return out.select("src", "dst", "dist", "rank")


# ---------------------------------------------------------------- LSH

def lsh_matrix(d: int, n_ht: int = 10, seed: int | None = None, redraw_first_column: bool = True):
    """Hash rows ``A[h][j]``, uniform in [0, 1), drawn from ``java.util.Random(seed)`` with
    ``seed = d + 1`` by default, column-major ``(n_ht x d)``. As in the reference, the
    ``n_ht`` draws meant for the offsets overwrite the first ``n_ht`` matrix entries."""
    rnd = JavaRandom(d + 1 if seed is None else seed)
    flat = [rnd.next_double() for _ in range(d * n_ht)]
    if redraw_first_column:
        for i in range(n_ht):
            flat[i] = rnd.next_double()
    return [[flat[h + j * n_ht] for j in range(d)] for h in range(n_ht)]


def lsh_codes(vectors: DataFrame, d: int, n_ht: int = 10, r: float = 2.0, seed: int | None = None,
              offset: bool = False, x_col: str = "x") -> DataFrame:
    """Long form ``(id, h, code)``: ``code = floor((A_h . x + b_h) / r)``. With
    ``offset=False`` (the reference) ``b = 0``; ``offset=True`` draws ``b`` in ``[0, r)``."""
    A = lsh_matrix(d, n_ht, seed, redraw_first_column=not offset)
    if offset:
        rnd = JavaRandom((d + 1 if seed is None else seed) + 7919)
        b = [rnd.next_double() * r for _ in range(n_ht)]
    else:
        b = [0.0] * n_ht
    x = F.col(x_col).cast("array<double>")
    rows = [F.floor((vec_dot(x, F.array(*[F.lit(a) for a in A[h]])) + F.lit(b[h])) / F.lit(r))
            for h in range(n_ht)]
    return vectors.select("id", F.posexplode(F.array(*rows)).alias("h", "code")).select(
        "id", "h", F.col("code").cast("bigint").alias("code"))
