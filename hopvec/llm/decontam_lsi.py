"""Benchmark decontamination by latent semantic retrieval.

Words of all documents give inverse document frequencies. Benchmark passages are cut into blocks,
and each block's TF-IDF matrix is factorised by a randomised SVD in a task of its own; a block has
no more passages than its rank, so latent products are the exact ones. Windows of every document are folded into each block's latent space; windows whose cosine with a passage
reaches a bound (latent product over full TF-IDF lengths) are candidates. Short passages, for which
windows are too sparse, have candidates wherever one of their rarest words occurs: as many words as
any accepted copy must hold one of. A candidate counts if
its longest common subsequence with the passage is long, or fairly long and it holds the answer.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 1 << 18        # hashed words whose document frequencies are counted
PASSAGE = 64             # words of a benchmark passage; longer items are cut
MIN_WORDS = 5            # items with fewer words are no evidence and are not searched
BLOCK = 256              # passages of one latent space
BLOCKS_A_PASS = 8        # latent spaces that one look at the documents uses (bounds the broadcast)
RANK = BLOCK             # of a block, which holds no more passages: none loses a share of its cosine
STRIDE = 8
WINDOWS = (8, 16, 24, 32, 48, 64)
MIN_COSINE = 0.45
SHORT_WORDS = 12         # passages of so many words at most are found by their words, not by windows
COPY_LCS = 0.8           # share of a passage found in order: a copy
PARAPHRASE_LCS = 0.6     # enough where the answer is found as well
ANSWER_WORDS = 8         # without an answer column the last words of an item stand for it
DOCS_A_BATCH = 128

_MULT = np.random.default_rng(23).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_WORD_BYTES = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def tokenize(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one behind the other, and where each text's words
    begin (with the end). Words: lower-cased ASCII letters and digits and all other characters
    beyond ASCII."""
    raw = [t.lower().encode() for t in texts]
    whole = np.frombuffer(b" ".join(raw).translate(_WORD_BYTES), np.uint8)
    begin = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raw])]) if raw else np.zeros(1, np.int64)
    is_word = whole != 32
    edge = np.diff(is_word.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    size = ends - starts
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    at = np.arange(int(size.sum())) - np.repeat(first, size)
    value = (whole[is_word].astype(np.uint64) + np.uint64(1)) * _MULT[at & 63]
    if size.max() > 64:
        value *= (2 * (at >> 6) + 1).astype(np.uint64)
    h = np.add.reduceat(value, first)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x9E3779B97F4A7C15), np.searchsorted(starts, begin)


def buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold a word of each bucket (summed in tasks, then over them), and how many
    documents there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, last, n = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for at in range(0, b.num_rows, DOCS_A_BATCH):
                texts = [t or "" for t in b["text"].slice(at, DOCS_A_BATCH).to_pylist()]
                h, begin = tokenize(texts)
                n += len(texts)
                every = buckets(h)
                for i in range(len(texts)):
                    own = every[begin[i]:begin[i + 1]]
                    order = np.arange(len(own))
                    last[own] = order
                    df[own[last[own] == order]] += 1      # one place for each bucket
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS)
    words = rows[rows["bucket"] >= 0]
    df[words["bucket"].to_numpy(int)] = words["n"].to_numpy(float)
    return df, int(rows.loc[rows["bucket"] < 0, "n"].sum())


def passages_of(n: int) -> list[tuple[int, int]]:
    """Word ranges of the passages of an item of ``n`` words; the last one is a full one."""
    if n <= PASSAGE:
        return [(0, n)]
    return [(a, a + PASSAGE) for a in range(0, n - PASSAGE, PASSAGE)] + [(n - PASSAGE, n)]


class Block(NamedTuple):
    """A latent space: ``row`` of each bucket in ``word`` (-1: none), words and passages in it."""
    row: np.ndarray
    word: np.ndarray            # (words, rank), weighted by idf
    passage: np.ndarray         # (passages, rank), divided by full length
    item: list[int]
    tokens: list[list[int]]
    answer: list[list[int]]


def randomised_svd(a: np.ndarray, rank: int, seed: int = 5) -> np.ndarray:
    """Right singular vectors (columns) of the ``rank`` largest singular values: range finder with
    two power steps, then a small exact decomposition."""
    rank = min(rank, *a.shape)
    q = np.random.default_rng(seed).normal(size=(a.shape[0], min(rank + 16, *a.shape)))
    q, _ = np.linalg.qr(a.T @ q)
    for _ in range(2):
        q, _ = np.linalg.qr(a.T @ (a @ q))
    _, _, vt = np.linalg.svd(a @ q, full_matrices=False)
    return q @ vt[:rank].T


def fit_block(items: list[int], tokens: list[np.ndarray], answers: list[np.ndarray], idf: np.ndarray, rank: int) -> Block:
    words = np.unique(np.concatenate([buckets(t) for t in tokens]))
    a = np.zeros((len(tokens), len(words)))
    for i, t in enumerate(tokens):
        np.add.at(a[i], np.searchsorted(words, buckets(t)), 1.0)
    a *= idf[words]
    length = np.sqrt((a * a).sum(1, keepdims=True))
    a /= np.maximum(length, 1e-12)
    v = randomised_svd(a, rank)
    row = np.full(BUCKETS, -1, np.int32)
    row[words] = np.arange(len(words))
    return Block(row, (v * idf[words][:, None]).astype(np.float32), (a @ v).astype(np.float32), items,
                 [t.tolist() for t in tokens], [t.tolist() for t in answers])


def lcs(masks: dict[int, int], n: int, other: list[int]) -> int:
    """Length of the longest common subsequence of a text of ``n`` words (``masks``: the bits of
    each word's places) and ``other``."""
    v = full = (1 << n) - 1
    for t in other:
        m = masks.get(t)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def masks_of(tokens: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, t in enumerate(tokens):
        out[t] = out.get(t, 0) | (1 << i)
    return out


class Finder:
    """Finds benchmark passages in batches of texts."""

    def __init__(self, blocks: list[Block], idf: np.ndarray, min_cosine: float = MIN_COSINE):
        self.blocks, self.weight, self.min_cosine = blocks, idf * idf, min_cosine
        self.windows = [np.array([0 if len(t) <= SHORT_WORDS else min(WINDOWS, key=lambda w: (abs(w - len(t)), w)) for t in b.tokens]) for b in blocks]
        self.masks = [([masks_of(t) for t in b.tokens], [masks_of(t) for t in b.answer]) for b in blocks]
        # short passages by the words of which any accepted stretch holds one
        self.short: dict[int, list[tuple[int, int]]] = {}
        for no, b in enumerate(blocks):
            for p in np.flatnonzero(self.windows[no] == 0):
                t = b.tokens[p]
                least = next(k for k in range(len(t) + 1) if k / len(t) >= PARAPHRASE_LCS)
                rare = np.argsort(-self.weight[buckets(np.array(t, np.uint64))], kind="stable")[:len(t) - least + 1]
                for w in {t[i] for i in rare}:
                    self.short.setdefault(w, []).append((no, int(p)))
        self.is_short = np.zeros(BUCKETS, bool)
        self.is_short[buckets(np.array(list(self.short), np.uint64))] = True

    def candidates(self, h: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int, int, int, float]]:
        """``(text, block, passage, first word, words, cosine)`` of windows that reach the bound."""
        n = np.diff(begin)
        steps = -(-n // STRIDE)
        if steps.sum() == 0:
            return
        text = np.repeat(np.arange(len(n)), steps)
        first = np.concatenate([[0], np.cumsum(steps)])
        start = begin[text] + (np.arange(len(text)) - first[text]) * STRIDE
        bucket = buckets(h)
        weight = self.weight[bucket]
        mass = np.concatenate([[0], np.cumsum(np.add.reduceat(weight, start))])
        place = np.arange(len(text))
        for no, block in enumerate(self.blocks):
            row = block.row[bucket]
            inside = np.concatenate([[0], np.cumsum(np.add.reduceat(np.where(row >= 0, weight, 0.0), start))])
            wanted = []
            for size in np.unique(self.windows[no][self.windows[no] > 0]):
                end = np.minimum(place + size // STRIDE, first[text + 1])
                whole = (place + size // STRIDE <= first[text + 1]) | (place == first[text])
                full = mass[end] - mass[:-1]
                # words that no passage holds add to a window's length only
                own = inside[end] - inside[:-1]
                may = np.flatnonzero(whole & (own >= self.min_cosine ** 2 * full) & (own > 0))
                if len(may):
                    wanted.append((size, may, end[may], np.sqrt(full[may])))
            if not wanted:
                continue
            # latent vectors of the steps that some window needs, each word looked up once
            need = np.zeros(len(text) + 1, np.int64)
            for _, may, end, _ in wanted:
                np.add.at(need, may, 1)
                np.add.at(need, end, -1)
            steps_used = np.flatnonzero(np.cumsum(need[:-1]) > 0)
            at = start[steps_used]
            until = begin[text[steps_used] + 1]
            vector = np.zeros((len(steps_used) + 1, block.word.shape[1]), np.float32)      # the last one stays zero
            for c in range(STRIDE):
                r = np.where(at + c < until, row[np.minimum(at + c, len(row) - 1)], -1)
                hit = np.flatnonzero(r >= 0)
                vector[hit] += block.word[r[hit]]
            number = np.full(len(text) + 1, len(steps_used))
            number[steps_used] = np.arange(len(steps_used))
            for size, may, end, length in wanted:
                sums = vector[number[may]]
                for c in range(1, size // STRIDE):
                    sums += vector[np.where(may + c < end, number[np.minimum(may + c, len(text))], len(steps_used))]
                own = np.flatnonzero(self.windows[no] == size)
                cosine = (sums @ block.passage[own].T) / length[:, None]
                for w, p in zip(*np.nonzero(cosine >= self.min_cosine)):
                    yield int(text[may[w]]), no, int(own[p]), int(start[may[w]]), int(size), float(cosine[w, p])

    def accepted(self, no: int, passage: int, part: list[int]) -> float:
        """Share of the passage that a stretch holds in order, 0 if that is not enough."""
        (masks, answers), block = self.masks[no], self.blocks[no]
        n, answer = len(block.tokens[passage]), block.answer[passage]
        share = lcs(masks[passage], n, part) / n
        if share >= COPY_LCS or share >= PARAPHRASE_LCS and answer and lcs(answers[passage], len(answer), part) >= COPY_LCS * len(answer):
            return share
        return 0.0

    def cosine(self, tokens: list[int], part: list[int]) -> float:
        """Largest TF-IDF cosine of a passage and the stretches of its length in ``part``."""
        own, best = Counter(tokens), 0.0
        weight = dict(zip(set(tokens) | set(part), self.weight[buckets(np.array(list(set(tokens) | set(part)), np.uint64))].tolist()))
        norm = lambda c: sum(weight[t] * k * k for t, k in c.items()) ** 0.5
        for at in range(max(1, len(part) - len(tokens) + 1)):
            c = Counter(part[at:at + len(tokens)])
            best = max(best, sum(weight[t] * k * c[t] for t, k in own.items()) / max(1e-12, norm(own) * norm(c)))
        return best

    def find_short(self, h: np.ndarray, begin: np.ndarray) -> Iterator[tuple[int, int, int, float, float]]:
        """``(text, block, passage, cosine, share)`` of short passages: every stretch of up to one and
        a half times the passage's words that is accepted is found, wherever it begins."""
        if not self.short:
            return
        done = set()
        at = np.flatnonzero(self.is_short[buckets(h)])
        for k, text in zip(at.tolist(), (np.searchsorted(begin, at, "right") - 1).tolist()):
            for no, passage in self.short.get(int(h[k]), ()):
                if (text, no, passage) in done:
                    continue
                tokens = self.blocks[no].tokens[passage]
                reach = len(tokens) * 3 // 2
                part = h[max(begin[text], k - reach + 1):min(begin[text + 1], k + reach)].tolist()
                if share := self.accepted(no, passage, part):
                    done.add((text, no, passage))
                    yield text, no, passage, self.cosine(tokens, part), share

    def find(self, texts: list[str]) -> list[list[tuple[int, float, float]]]:
        """For each text the ``(item, cosine, share of the passage in order)`` of verified passages."""
        h, begin = tokenize(texts)
        by: dict[tuple[int, int, int], list[tuple[float, int, int]]] = {}
        for text, no, passage, start, size, cosine in self.candidates(h, begin):
            by.setdefault((text, no, passage), []).append((cosine, start, size))
        out: list[list[tuple[int, float, float]]] = [[] for _ in texts]
        for (text, no, passage), windows in by.items():
            block, n = self.blocks[no], len(self.blocks[no].tokens[passage])
            for cosine, start, size in sorted(windows, reverse=True):
                reach = max(n, size) // 2 + STRIDE
                part = h[max(begin[text], start - reach):min(begin[text + 1], start + size + reach)].tolist()
                if share := self.accepted(no, passage, part):
                    out[text].append((block.item[passage], cosine, share))
                    break
        for text, no, passage, cosine, share in self.find_short(h, begin):
            out[text].append((self.blocks[no].item[passage], cosine, share))
        return out


FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("lcs", T.DoubleType())]))


def fit(docs: DataFrame, bench: DataFrame, rank: int = RANK, min_cosine: float = MIN_COSINE) -> list[Finder]:
    """Finders for ``bench (item_id, text[, answer])`` with word weights from all of ``docs (text)``.

    Null ids and texts of fewer than ``MIN_WORDS`` words are left out; an item given twice is found
    twice as the same id. Every finder holds at most ``BLOCKS_A_PASS * BLOCK`` passages; a ``rank``
    under ``BLOCK`` makes smaller blocks.
    """
    df, n = document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)) + 0.1
    answer = F.col("answer").cast("string") if "answer" in bench.columns else F.lit(None).cast("string")
    rows = bench.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"), answer.alias("answer"))
    rows = rows.where("item_id is not null and text is not null").distinct()
    blocks = max(1, -(-rows.count() // BLOCK))
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def make(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["item_id", "text"])
        items, tokens, answers = [], [], []
        for item, text, given in zip(part["item_id"], part["text"], part["answer"]):
            h, _ = tokenize([text])
            own, _ = tokenize([given]) if given else (h[-ANSWER_WORDS:], None)
            for a, z in passages_of(len(h)) if len(h) >= MIN_WORDS else []:
                items.append(int(item))
                tokens.append(h[a:z])
                answers.append(own)
        out = []
        size = min(BLOCK, rank)
        for at in range(0, len(items), size):
            b = fit_block(items[at:at + size], tokens[at:at + size], answers[at:at + size], shared.value, rank)
            out.append((pickle.dumps(tuple(b)),))
        return pd.DataFrame(out, columns=["block"])

    made = (rows.withColumn("no", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
            .groupBy("no").applyInPandas(make, "block binary"))
    finders, held = [], []
    for r in made.toLocalIterator():
        held.append(Block(*pickle.loads(r["block"])))
        if len(held) == BLOCKS_A_PASS:
            finders.append(Finder(held, idf, min_cosine))
            held = []
    return finders + ([Finder(held, idf, min_cosine)] if held else [])


def _udf(docs: DataFrame, finder: Finder):
    shared = docs.sparkSession.sparkContext.broadcast(finder)

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(texts), DOCS_A_BATCH):
            for hits in shared.value.find([t or "" for t in texts.slice(at, DOCS_A_BATCH).to_pylist()]):
                out.append([{"item_id": i, "cosine": c, "lcs": s} for i, c, s in hits])
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64())])))

    return F.arrow_udf(run, FOUND).asNondeterministic()


def found_in(docs: DataFrame, finders: list[Finder], text: Column) -> Column:
    """``array<struct<item_id, cosine, lcs>>`` of the benchmark items in a text (null or empty: none)."""
    return F.concat(*[_udf(docs, f)(text) for f in finders]) if finders else F.array().cast(FOUND)


def contaminated(docs: DataFrame, finders: list[Finder]) -> DataFrame:
    """doc_id, item_ids (sorted, without repeats), cosine and lcs (the largest): one row per row of
    ``docs (doc_id, text)`` that holds a benchmark item."""
    d = docs.select("doc_id", found_in(docs, finders, F.col("text")).alias("found")).where(F.size("found") > 0)
    return d.select("doc_id", F.array_sort(F.array_distinct("found.item_id")).alias("item_ids"),
                    F.array_max("found.cosine").alias("cosine"), F.array_max("found.lcs").alias("lcs"))
