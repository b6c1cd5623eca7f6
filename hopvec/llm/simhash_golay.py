"""SimHash near-duplicates with Golay-code keys.

Fingerprints of 64 bits link at ``MAX_BITS`` = 3 or fewer differing bits. Three errors over two
32-bit halves leave a half with at most one. That half is looked up either by its first 23 bits
through the binary Golay code, beside its other 9 bits exactly, or by its first 23 bits exactly.
Two vectors at distance 1 always share a codeword within distance 4 of both, so the codewords
within distance 4 (one, or six where the nearest is 3 away) are the keys. The other half has at
most three errors over four bytes, so one byte is equal and is added to the key (each in turn).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, stored
from .components import components

SHINGLE = 3
MAX_BITS = 3
BLOCK = 512          # fingerprints of one key that meet in one block
# Fixed value: generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the (23, 12) Golay code.
GENERATOR = 0b110001110101


def syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit vectors by the generator (11 bits)."""
    v = v.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        v ^= ((v >> bit) & 1) * (GENERATOR << (bit - 11))
    return v


def _near_table() -> np.ndarray:
    """For each syndrome, the error patterns of weight 4 or less with it, unused places -1."""
    out = [[] for _ in range(2048)]
    for weight in range(5):
        errors = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)])
        for e, s in zip(errors, syndrome(errors)):
            out[s].append(int(e))
    return np.array([x + [-1] * (6 - len(x)) for x in out])


NEAR = _near_table()


def codeword_indices(v: np.ndarray) -> np.ndarray:
    """``(n, 6)`` numbers (12 bits) of the codewords within distance 4 of 23-bit vectors, -1: none."""
    e = NEAR[syndrome(v)]
    return np.where(e < 0, -1, (v[:, None] ^ e) >> 11)


def golay_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of every key of 64-bit fingerprints (given as int64)."""
    u = fp.view(np.uint64)
    halves = [(u >> np.uint64(32)).astype(np.int64), (u & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    rows, keys = [], []
    for side in (0, 1):
        own, other = halves[side], halves[1 - side]
        first, rest = own >> 9, own & 511
        coded = codeword_indices(first)
        at, which = np.nonzero(coded >= 0)
        kinds = [(np.arange(len(fp)), first), (at, (coded[at, which] << 9) | rest[at])]
        for kind, (row, value) in enumerate(kinds):
            for byte in range(4):
                tag = (side * 2 + kind) * 4 + byte
                keys.append((tag << 40) | (value << 8) | ((other[row] >> (8 * byte)) & 255))
                rows.append(row)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Fingerprint as a signed 64-bit number; 0 for a text without words."""
    parts = text.encode().lower().split()       # bytes.lower() changes A-Z only
    if not parts:
        return 0
    whole = b" ".join(parts)
    if len(parts) < shingle:
        hashes = xxhash.xxh64_digest(whole, 42)
    else:
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        hashes = b"".join([xxhash.xxh64_digest(whole[s:e], 42) for s, e in zip(starts, ends[shingle - 1:].tolist())])
    h = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 16384):
        ones += np.unpackbits(h[at:at + 16384], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``(doc_id, text_key, fp bigint)``, one row per row of ``docs (doc_id, text)``; text_key is a hash of the text."""

    @F.arrow_udf("bigint")
    def run(text: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t or "", shingle) for t in text.to_pylist()], pa.int64())

    return docs.select("doc_id", text_key("text").alias("text_key"), run("text").alias("fp"))


def _spanning(found: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Links that join what is connected among the fingerprints of one block."""
    near = np.bitwise_count(found.view(np.uint64)[:, None] ^ found.view(np.uint64)[None, :]) <= max_bits
    label = np.arange(len(found))
    while True:
        new = np.where(near, label[None, :], len(found)).min(1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(label != np.arange(len(found))):
        yield int(found[i]), int(found[label[i]])


def links(fps: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """``(a, b)``: links that connect all fingerprints of ``fps (fp)`` within ``max_bits`` of each
    other directly or over others. ``fps`` must be distinct; ``max_bits`` at most 3.

    A key that many fingerprints share is cut into blocks, and every two blocks meet in a group
    of their own of at most ``2 * block`` rows; from each come spanning links, not all pairs.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError("the keys find up to 3 differing bits")

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b["fp"].to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(fp), 4096):
                row, key = golay_keys(fp[at:at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at:at + 4096][row])], ["key", "fp"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [x for found in b["found"] for x in _spanning(found.values.to_numpy(), max_bits)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    keys = fps.select("fp").mapInArrow(emit, "key bigint, fp bigint")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # keys are some fifty for each fingerprint, which the planner cannot see below mapInArrow: without the hint it sends
    # all of them to the driver and broadcasts them while the fingerprints' file is small
    rows = keys.join(shared.hint("merge"), "key").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = (rows.groupBy("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))
              .agg(F.collect_list("fp").alias("found")).where(F.size("found") > 1).select("found"))
    return groups.mapInArrow(join, "a bigint, b bigint").distinct()


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, text_key, fp, fingerprint (16 hex digits), component_id, component_key: one row per row of
    ``docs (doc_id, text)``.

    component_id is the smallest doc_id of the group, component_key the smallest text_key with it. Texts without
    words have fingerprint zero and link like any other. Rows with a null doc_id are grouped but never name a group
    (a group of such rows only has a null component_id). An empty table gives an empty result.
    """
    prints = stored(fingerprints(docs, shingle))
    # equal fingerprints meet here first, summed map-side, so copies cost one row each task
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    least = stored(prints.groupBy("fp").agg(F.min(first).alias("least")))
    roots = components(links(least, max_bits))
    rooted = least.join(roots.withColumnRenamed("id", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("kept")), "root")
    named = named.select("fp", F.col("kept.doc_id").alias("component_id"), F.col("kept.text_key").alias("component_key"))
    return (prints.join(named, "fp")
            .select("doc_id", "text_key", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_key"))


def keep_first(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their group of ``simhash_groups``: id and text of its component_id and
    component_key. Of rows that share an id but not a text each is judged by its own group; rows that repeat the
    kept id and text all stay. A row with a null id goes if its group has a named one, and of a group without
    names one text stays. Other columns stay, whatever their names."""
    doc, key = free_names(docs, "_drop", "_key")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("component_key"))
    drop = groups.where(~stays).select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col(doc)) & (text_key(text_col) == F.col(key))
    return docs.join(drop, same, "left_anti")
