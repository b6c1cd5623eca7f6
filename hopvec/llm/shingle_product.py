"""Near-duplicate documents by a blocked sparse product of the document by n-gram incidence matrix.

A document's row has a one for each of its distinct word shingles. Two documents link when ``DEN``
times their overlap reaches ``NUM`` times their union, so at an overlap of ``need(n, m)`` or more.
Columns are ordered by rarity, from counts over all documents in ``BUCKETS`` hashed buckets (any order
gives the same result; a fine one gives few products). The product runs over blocks of columns:

* the first block of a row are its rarest columns, as many as a linked row must share one of. Their
  products, in cells of rows of like size, name the pairs, in tiles of about ``TILE`` rows a side, which drop pairs
  below the bounds of size, of place (columns left) and of a parity signature of the whole row;
* the pairs left accumulate their overlap over ``PARTS`` blocks of all columns, and go as soon as the
  count and the columns left cannot reach the bound.

Equal rows are one row. Links are wanted for groups only, so rows already in one group are not
multiplied again: a first pass multiplies each row with the first row of its cells; then tiles give links
that join different groups, until none is left. What passes in tiles and fails the count is kept
apart and not tried again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import conf_override
from .common import stored
from .components import components
from .line_join import checked_broadcast

SHINGLE = 3
NUM, DEN = 90, 100
BUCKETS = 1 << 20
SLICE = 4096             # buckets that one row of counts holds
TASKS = 256              # tasks whose counts are added together at a time
TILE = 512
PARTS = 8
ROUNDS = 3               # rounds of joining links; what is left then is tried pair by pair
HOT_SHARE = 1024         # sets of more than this share of the rows are looked up by broadcast (at most so many)
BITS = (64, 8192)        # least and greatest length of a parity signature
MEMO = 1 << 17           # words whose hashes a task keeps
TEXTS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1024"}
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "64"}      # tiles, and pairs of whole rows, at a time in a task
_MIX = np.random.default_rng(11).integers(1, 2**63, 4, dtype=np.uint64) | np.uint64(1)


class Rows:
    """Rows of the incidence matrix as sorted arrays of 64-bit column numbers."""

    def __init__(self, shingle: int):
        self.shingle, self.memo, self.odd = shingle, {}, np.random.default_rng(3).integers(1, 2**63, shingle, dtype=np.uint64) | np.uint64(1)

    def _word(self, w: bytes) -> int:
        h = self.memo.get(w)
        if h is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            h = self.memo[w] = xxhash.xxh64_intdigest(w)
        return h

    def occurrences(self, text: str) -> np.ndarray:
        """A column for each shingle, repeats included: words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; with
        fewer words the whole sequence is one."""
        words = text.encode().lower().split()
        k = self.shingle
        if len(words) < k:
            return np.array([xxhash.xxh64_intdigest(b" ".join(words), len(words))] if words else [], np.uint64)
        h = np.fromiter(map(self._word, words), np.uint64, len(words))
        g = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            g += h[i:len(h) - k + 1 + i] * self.odd[i]
        g ^= g >> np.uint64(29)
        g *= _MIX[0]
        return g ^ (g >> np.uint64(32))

    def columns(self, text: str) -> np.ndarray:
        return np.unique(self.occurrences(text))


def need(n, m, num: int = NUM, den: int = DEN):
    """Least overlap of linked rows of ``n`` and ``m`` columns: ``o / (n + m - o) >= num / den``."""
    return -(-num * (n + m) // (num + den))


def column_levels(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """A byte for each bucket of columns: four times the binary logarithm of its occurrences in all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total = Rows(shingle), np.zeros(BUCKETS, np.int64)
        for b in batches:
            texts = b["text"].to_pylist()
            for i in range(0, len(texts), 256):
                found = np.concatenate([rows.occurrences(t or "") >> np.uint64(44) for t in texts[i:i + 256]])
                total += np.bincount(found.view(np.int64), minlength=BUCKETS)
        parts = total.reshape(-1, SLICE)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(c, np.int64) for c in table["counts"].to_pylist()], axis=0)
        return pa.table({"part": pa.array([table["part"][0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "part int, counts binary"
    found = docs.select("text").mapInArrow(count, schema).withColumn("some", F.floor(F.spark_partition_id() / TASKS))
    for keys in (["part", "some"], ["part"]):
        found = found.groupBy(*keys).applyInArrow(add, schema).withColumn("some", F.lit(0))
    total = np.zeros(BUCKETS, np.int64)
    for r in found.select("part", "counts").toLocalIterator():           # BUCKETS numbers in all
        total[r["part"] * SLICE:(r["part"] + 1) * SLICE] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(4 * np.log2(total + 1), 255).astype(np.uint8)


def signature(columns: np.ndarray) -> bytes:
    """Parity of the columns on each bit; twice as many bits as columns, rounded up to a power of two."""
    bits = min(max(BITS[0], 1 << (2 * len(columns) - 1).bit_length()), BITS[1])
    at = (columns & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def row_table(docs: DataFrame, levels: np.ndarray, shingle: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """``docs (doc_id, text)`` as doc_id, row_hash, n, key (128 bits of the row, null when empty), signature and
    first (the rarest columns, in order)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(shingle)
        for b in batches:
            n, key, sign, first = [], [], [], []
            for text in b["text"].to_pylist():
                c = rows.columns(text or "")
                n.append(len(c))
                key.append(hashlib.blake2b(c.tobytes(), digest_size=16).digest() if len(c) else None)
                sign.append(signature(c) if len(c) else None)
                code = (levels[(c >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (c >> np.uint64(8))
                p = len(c) + num * len(c) // -den + 1 if len(c) else 0
                first.append(np.sort(code)[:p].view(np.int64))
            ends = np.cumsum([0, *map(len, first)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(first) if first else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["row_hash"], pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sign, pa.binary()), lists],
                                             ["doc_id", "row_hash", "n", "key", "signature", "first"])

    return (docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
            .mapInArrow(run, "doc_id bigint, row_hash bigint, n bigint, key binary, signature binary, first array<bigint>"))


def distance(a: list[bytes], b: list[bytes], chunk: int = 1 << 14) -> np.ndarray:
    """Bits in which two lists of signatures differ, at the shorter length of each pair."""
    out = np.zeros(len(a), np.int64)
    size = np.array([min(len(x), len(y)) for x, y in zip(a, b)], np.int64)

    def at(s: bytes, length: int) -> np.ndarray:
        v = np.frombuffer(s, np.uint8)
        while len(v) > length:
            v = v[:len(v) // 2] ^ v[len(v) // 2:]
        return v

    for length in np.unique(size):
        which = np.flatnonzero(size == length)
        for i in range(0, len(which), chunk):
            w = which[i:i + chunk]
            x, y = (np.concatenate([at(s[k], length) for k in w]).reshape(len(w), -1).view(np.uint64) for s in (a, b))
            out[w] = np.bitwise_count(x ^ y).sum(1)
    return out


def _tile(t: dict[str, np.ndarray], left: np.ndarray, right: np.ndarray, joining: bool, num: int, den: int) -> list[tuple[int, int]]:
    """Pairs of one tile within the bounds and in different groups; with ``joining`` only as many as join all that meet.
    ``left`` and ``right`` are places in the columns ``t``."""
    n, m = t["n"][left][:, None], t["n"][right][None, :]
    least = need(n, m, num, den)
    own = t["own"][left][:, None] | t["own"][right][None, :]         # of the cells that two rows share, one counts
    # two rows outside the largest group meet from both sides: once is enough
    twice = t["other"][right][None, :] & (t["rid"][left][:, None] > t["rid"][right][None, :])
    x, y = np.nonzero((t["root"][left][:, None] != t["root"][right][None, :]) & own & ~twice & (np.minimum(n, m) >= least)
                      & (np.minimum(t["rest"][left][:, None], t["rest"][right][None, :]) >= least))
    x, y = left[x], right[y]
    far = distance(t["signature"][x], t["signature"][y])
    ok = far <= t["n"][x] + t["n"][y] - 2 * need(t["n"][x], t["n"][y], num, den)
    x, y, far = x[ok], y[ok], far[ok]
    up: dict[int, int] = {}

    def top(g: int) -> int:
        while up.get(g, g) != g:
            g = up[g] = up.get(up[g], up[g])
        return g

    out = []
    first, second = np.minimum(t["rid"][x], t["rid"][y]), np.maximum(t["rid"][x], t["rid"][y])
    # nearest pairs first, equals by number: tiles of other columns with the same rows choose the same links
    for k in np.lexsort((second, first, far)):
        bad = t["bad"][x[k]]
        if bad is not None and t["rid"][y[k]] in bad:
            continue
        if joining:
            g, h = top(int(t["root"][x[k]])), top(int(t["root"][y[k]]))
            if g == h:
                continue
            up[g] = h
        out.append((int(first[k]), int(second[k])))
    return out


def tile_pairs(cells: DataFrame, reps: DataFrame, groups: DataFrame, failed: DataFrame, joining: bool, num: int, den: int, tile: int = TILE,
               diagonal: bool = False) -> DataFrame:
    """``(x, y)``: pairs of different ``groups (rid, root)`` that a cell of ``cells`` has within the bounds. In
    each cell the rows outside its largest group meet all rows, in tiles; with ``diagonal`` the rows of their own block.
    Pairs in ``failed`` are left out."""
    cell = ["col", "cell"]
    rows = cells.select(*cell, "rid", "n", "i", "own").join(groups, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    per = rows.groupBy(*cell, "root").agg(F.count("*").alias("k"))
    per = per.groupBy(*cell).agg(F.sum("k").alias("all"), F.max(F.struct("k", "root")).alias("top")).where("all > top.k")
    per = per.select(*cell, F.col("top.root").alias("main"), F.ceil((F.col("all") - F.col("top.k")) / tile).cast("int").alias("a"), F.ceil(F.col("all") / tile).cast("int").alias("b"))
    if diagonal:
        per = per.where("b > 1")        # a cell of one tile is looked at once, with all others
    bad = failed.select(F.col("x").alias("rid"), F.col("y").alias("z")).union(failed.select("y", "x")).groupBy("rid").agg(F.collect_list("z").alias("bad"))
    live = (rows.join(per, cell).withColumn("other", F.col("root") != F.col("main"))
            .join(reps.select("rid", "signature"), "rid").join(bad, "rid", "left"))
    live = stored(live.withColumn("rest", F.col("n") - F.col("i")))
    mine = lambda k: F.pmod(F.xxhash64("rid"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    row = lambda left, right: F.struct("rid", "root", "n", "rest", "signature", "own", "other", "bad", left.alias("is_left"), right.alias("is_right")).alias("row")
    yes, no = F.lit(True), F.lit(False)
    if diagonal:
        dealt = live.select(*cell, mine("b").alias("p"), mine("b").alias("q"), row(F.col("other"), yes))
    else:
        # where one tile holds the cell, a row comes once for both sides
        alone = (F.col("a") == 1) & (F.col("b") == 1)
        left = live.where(F.col("other") & ~alone).select(*cell, mine("a").alias("p"), every("b").alias("q"), row(yes, no))
        dealt = left.union(live.select(*cell, every("a").alias("p"), mine("b").alias("q"), row(F.col("other") & alone, yes)))
    tiles = dealt.groupBy(*cell, "p", "q").agg(F.collect_list("row").alias("rows")).where(F.exists("rows", lambda r: r["is_left"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, flat = b["rows"].offsets.to_numpy(), b["rows"].values
            t = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in ("rid", "root", "n", "rest", "signature", "own", "other", "bad", "is_left", "is_right")}
            pairs = []
            for lo, hi in zip(ends[:-1], ends[1:]):
                here = np.arange(lo, hi)
                pairs += _tile(t, here[t["is_left"][lo:hi]], here[t["is_right"][lo:hi]], joining, num, den)
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["x", "y"])

    return tiles.select("rows").mapInArrow(run, "x bigint, y bigint").distinct()


def shared_cells(reps: DataFrame, num: int, den: int) -> DataFrame:
    """The first columns of all rows, as cells of rows of like size: col, cell, rid, n, i, own, and the cell's first row
    (p_rid, p_n, p_i, p_own). Linked rows are in the same or the next class of size; a row is in the cell of its class (own)
    and in the next. Cells where nothing can link are left out."""
    size = F.floor(F.log(F.col("n").cast("double")) / -np.log(0.99 * num / den)).cast("int")      # 0.99: rounding never parts two linked rows
    posts = reps.select(F.posexplode("first").alias("i", "col"), "rid", "n", size.alias("size"))
    met = posts.groupBy("col").agg(F.count("*").alias("k")).where("k > 1").select("col")
    shared = posts.join(met, "col", "left_semi")
    cells = shared.select("col", F.explode(F.array("size", F.col("size") + 1)).alias("cell"), "rid", "n", F.col("i").cast("bigint").alias("i"), "size")
    cells = stored(cells.withColumn("own", F.col("size") == F.col("cell")).drop("size"))
    first = (cells.groupBy("col", "cell").agg(F.min(F.struct("rid", "n", "i", "own")).alias("p"), F.count("*").alias("k"), F.max("own").alias("some"))
             .where("k > 1 and some").select("col", "cell", *[F.col(f"p.{c}").alias(f"p_{c}") for c in ("rid", "n", "i", "own")]))
    return stored(cells.join(first, ["col", "cell"]))


def first_pairs(cells: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """``(x, y)``: each row with the first row of each of its cells, within the bounds."""
    least = F.ceil(F.lit(num) * (F.col("n") + F.col("p_n")) / (num + den))
    met = cells.where("rid <> p_rid and (own or p_own)").where((F.least("n", "p_n") >= least) & (F.least(F.col("n") - F.col("i"), F.col("p_n") - F.col("p_i")) >= least))
    met = met.select(F.col("p_rid").alias("x"), F.col("rid").alias("y"), F.col("p_n").alias("n"), F.col("n").alias("m")).distinct()
    sign = reps.select("rid", "signature")
    met = met.join(sign.toDF("x", "sx"), "x").join(sign.toDF("y", "sy"), "y")

    @F.arrow_udf("boolean")
    def near(n: pa.Array, m: pa.Array, sx: pa.Array, sy: pa.Array) -> pa.Array:
        a, b = n.to_numpy(zero_copy_only=False), m.to_numpy(zero_copy_only=False)
        return pa.array(distance(sx.to_pylist(), sy.to_pylist()) <= a + b - 2 * need(a, b, num, den))

    return met.where(near("n", "m", "sx", "sy")).select("x", "y")


def overlapping(docs: DataFrame, reps: DataFrame, pairs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """``(x, y, linked)`` for ``pairs (x, y)``: overlaps accumulated over blocks of columns. Only the rows in question are built
    from their texts again."""
    ids = pairs.select(F.explode(F.array("x", "y")).alias("rid")).distinct()
    wanted = checked_broadcast(stored(ids.join(reps.select("rid", F.col("doc_id").alias("id"), F.col("row_hash").alias("hash")), "rid")))
    texts = docs.select(F.col("doc_id"), F.xxhash64("text").alias("row_hash"), "text").join(
        wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row_hash") == F.col("hash"))).select("rid", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = Rows(shingle)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["rid"], pa.array([rows.columns(t).tobytes() for t in b["text"].to_pylist()], pa.binary())], ["rid", "columns"])

    # several rows of the table may be the one (repeated id and text): their columns are equal
    built = stored(texts.mapInArrow(build, "rid bigint, columns binary")).dropDuplicates(["rid"])
    both = pairs.join(built.toDF("x", "cx"), "x").join(built.toDF("y", "cy"), "y")

    @F.arrow_udf("boolean")
    def product(cx: pa.Array, cy: pa.Array) -> pa.Array:
        return pa.array([linked(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), num, den) for a, b in zip(cx.to_pylist(), cy.to_pylist())], pa.bool_())

    return both.select("x", "y", product("cx", "cy").alias("linked"))


def linked(a: np.ndarray, b: np.ndarray, num: int = NUM, den: int = DEN, parts: int = PARTS) -> bool:
    """Overlap of two sorted rows, block of columns by block, until the bound is met or out of reach."""
    least, count = need(len(a), len(b), num, den), 0
    cuts = np.array([(k << 64) // parts for k in range(1, parts)], np.uint64)
    ea, eb = (np.concatenate([[0], np.searchsorted(v, cuts), [len(v)]]) for v in (a, b))
    for k in range(parts):
        if count + min(len(a) - ea[k], len(b) - eb[k]) < least:
            return False
        count += len(np.intersect1d(a[ea[k]:ea[k + 1]], b[eb[k]:eb[k + 1]], assume_unique=True))
    return bool(count >= least)


def jaccard_groups(docs: DataFrame, shingle: int = SHINGLE, num: int = NUM, den: int = DEN, tile: int = TILE, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per row of ``docs (doc_id, text)``.

    component_id is the smallest doc_id reachable by links, its own included. Null and texts without a
    word have no shingles and link with nothing. Rows with a null doc_id are grouped but never
    name a group (a group of such rows only has a null component_id). Repeated rows are one class; an
    empty table gives an empty result. Columns are told apart by 64-bit, equal rows by 128-bit hashes.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    with conf_override(docs.sparkSession, TEXTS):
        rows = stored(row_table(docs, column_levels(docs, shingle), shingle, num, den))
    classes = (rows.where("key is not null").groupBy("key").agg(F.min(F.struct("doc_id", "row_hash", "n", "signature", "first")).alias("r"), F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    reps = stored(classes.select(F.monotonically_increasing_id().alias("rid"), "key", "least", "copies", "r.*"))
    cells = shared_cells(reps, num, den)

    def tried(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        with conf_override(docs.sparkSession, BATCHES):
            out = stored(overlapping(docs, reps, stored(pairs), shingle, num, den))
        return out.where("linked").select("x", "y"), out.where("not linked").select("x", "y")

    links, failed = tried(first_pairs(cells, reps, num, den))
    open_cells = cells
    for k in range(rounds + 2):
        groups = components(links.toDF("a", "b")).withColumnRenamed("id", "rid")
        # the diagonal of the tiles first, which joins most of what is to be joined, then all; the last round takes every pair that is left
        with conf_override(docs.sparkSession, BATCHES):
            new = stored(tile_pairs(open_cells, reps, groups, failed, k <= rounds, num, den, tile, k == 0))
        if k and new.isEmpty():
            break
        more, worse = tried(new)
        links, failed = links.union(more), failed.union(worse)
        if k:
            # where every link that a tile gave holds, all that may link in it is joined: only cells of pairs that failed stay open
            again = worse.select(F.explode(F.array("x", "y")).alias("rid")).distinct()
            ids = open_cells.join(again, "rid", "left_semi").select("col", "cell").distinct()
            open_cells = stored(open_cells.join(ids, ["col", "cell"], "left_semi"))
    roots = components(links.toDF("a", "b"))
    rooted = reps.select("rid", "key", "least", "copies").join(roots.withColumnRenamed("id", "rid"), "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    first = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return _named(rows, stored(rooted.join(first, "root").select("key", "component_id", "copies")))


def _named(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Every row with the group of its set. Sets with more than one in ``HOT_SHARE`` of all rows are looked up by
    broadcast (fewer than ``HOT_SHARE``), so their rows do not meet in one task."""
    rows = rows.select("doc_id", F.col("n").alias("n_shingles"), "key")
    total = rows.count()
    hot = F.broadcast(named.where(F.col("copies") * HOT_SHARE > total).select("key", "component_id"))
    rest = rows.where("key is not null").join(hot.select("key"), "key", "left_anti")
    parts = [rows.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")),
             rows.join(hot, "key").select("doc_id", "n_shingles", "component_id"),
             rest.join(named.select("key", "component_id"), "key").select("doc_id", "n_shingles", "component_id")]
    return parts[0].union(parts[1]).union(parts[2])
