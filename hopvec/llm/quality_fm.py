"""Quality classifier: a second-order factorisation machine.

Inputs of a score: hashed lower-cased words (log counts, unit length), structure statistics
and the declared length. The pairwise term is computed in linear time:
``sum_i<j <v_i,v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]``.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import labelled_sample
from .textstats import stats_of

BUCKETS = 1 << 15
N_STATS = 14
DIM = BUCKETS + N_STATS
RANK = 8
MAX_TRAIN = 6000       # labelled documents that a fit may use
FEATURES_TYPE = T.StructType([T.StructField("idx", T.ArrayType(T.IntegerType())), T.StructField("val", T.ArrayType(T.FloatType()))])


def features(text: str, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted feature numbers and values of one text; the empty text has statistics only."""
    counts = Counter(text.lower().encode().split())
    tf = np.zeros(0)
    at = np.zeros(0, np.int64)
    if counts:
        h = np.fromiter((zlib.crc32(w) for w in counts), np.int64, len(counts)) % BUCKETS
        at, inv = np.unique(h, return_inverse=True)
        tf = np.log1p(np.bincount(inv, np.fromiter(counts.values(), np.float64, len(counts))))
        tf /= np.sqrt((tf * tf).sum())
    s = stats_of(text)
    n, ratios = s[0], s[5:]
    declared = np.log1p(max(0, n_chars)) / 10 if n_chars is not None else 0.0
    stats = np.array([np.log1p(n) / 10, declared, *np.tanh([ratios[0] / 10, *ratios[1:-1], ratios[-1] / 100])])
    return np.concatenate([at, BUCKETS + np.arange(N_STATS)]), np.concatenate([tf, stats])


class Model:
    """Parameters ``w0``, ``w[DIM]``, ``v[DIM, RANK]`` (about 1.2 MB whatever the corpus)."""

    def __init__(self, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.w0, self.w = 0.0, np.zeros(DIM)
        self.v = rng.normal(0, 0.01, (DIM, RANK))

    def raw(self, ptr: np.ndarray, idx: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score before the logistic function of each row of a CSR batch, and its factor sums."""
        vx = self.v[idx] * val[:, None]
        s = np.add.reduceat(vx, ptr[:-1], axis=0)
        pair = 0.5 * ((s * s).sum(1) - np.add.reduceat((vx * vx).sum(1), ptr[:-1]))
        return self.w0 + np.add.reduceat(self.w[idx] * val, ptr[:-1]) + pair, s

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 12, batch: int = 64,
            rate: float = 0.1, l2: float = 1e-5) -> "Model":
        """AdaGrad on the logistic loss, in an order fixed by the seed."""
        rng = np.random.default_rng(2)
        g0, gw, gv = 1e-6, np.full(DIM, 1e-6), np.full((DIM, RANK), 1e-6)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                take = order[at:at + batch]
                ptr = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in take])])
                idx, val = (np.concatenate([rows[i][k] for i in take]) for k in (0, 1))
                raw, s = self.raw(ptr, idx, val)
                d = (1 / (1 + np.exp(-raw)) - y[take]) / len(take)
                row = np.repeat(np.arange(len(take)), np.diff(ptr))
                uniq, inv = np.unique(idx, return_inverse=True)
                dw = np.bincount(inv, d[row] * val) + l2 * self.w[uniq]
                each = (d[row] * val)[:, None] * (s[row] - self.v[idx] * val[:, None])
                dv = np.stack([np.bincount(inv, each[:, f]) for f in range(RANK)], 1) + l2 * self.v[uniq]
                g0 += d.sum() ** 2
                gw[uniq] += dw * dw
                gv[uniq] += dv * dv
                self.w0 -= rate * d.sum() / np.sqrt(g0)
                self.w[uniq] -= rate * dw / np.sqrt(gw[uniq])
                self.v[uniq] -= 0.3 * rate * dv / np.sqrt(gv[uniq])
        return self

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        ptr = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])])
        raw, _ = self.raw(ptr, np.concatenate([i for i, _ in rows]), np.concatenate([x for _, x in rows]))
        return 1 / (1 + np.exp(-np.clip(raw, -50, 50)))


@F.arrow_udf(FEATURES_TYPE)
def _features(text: pa.Array, n_chars: pa.Array) -> pa.Array:
    rows = [features(t or "", n) for t, n in zip(text.to_pylist(), n_chars.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([i.tolist() for i, _ in rows], pa.list_(pa.int32())),
                                       pa.array([v.tolist() for _, v in rows], pa.list_(pa.float32()))], ["idx", "val"])


def held_out(doc_id="doc_id"):
    """True for the rows that a fit never sees: crc32 of the id as text leaves 1 by 3 (null id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def inputs(df: DataFrame) -> DataFrame:
    """``(doc_id, text, n_chars)``; null text: empty; without ``n_chars`` that input is null."""
    n = F.col("n_chars").cast("bigint") if "n_chars" in df.columns else F.lit(None).cast("bigint")
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                     F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), n.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, **kw) -> Model:
    """Fit on at most ``max_train`` labelled documents that are not held out. Without labels
    the model scores 0.5 everywhere. A repeated id counts once."""
    s = labelled_sample(inputs(docs), labels.where(~held_out()), "quality", max_train)
    s = s.select("doc_id", "label", _features.asNondeterministic()("text", "n_chars").alias("f"))
    s = s.groupBy("doc_id").agg(F.max(F.struct("label", "f")).alias("r")).orderBy("doc_id")
    rows = s.select("r.label", "r.f.idx", "r.f.val").toPandas()
    if rows.empty:
        model = Model()
        model.v[:] = 0.0
        return model
    x = [(np.asarray(i, np.int64), np.asarray(v, np.float64)) for i, v in zip(rows["idx"], rows["val"])]
    return Model().fit(x, rows["label"].to_numpy(float), **kw)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted: one row per row of ``docs``. The model is
    broadcast (fixed size)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = [features(t, n) for t, n in zip(part["text"].to_pylist(), part["n_chars"].to_pylist())]
                p = shared.value.scores(rows)
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["held_out"], pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                                                 ["doc_id", "held_out", "score", "predicted"])

    rows = inputs(docs).withColumn("held_out", held_out())
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, score double, predicted int")
