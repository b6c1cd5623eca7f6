"""Per-document counts that the quality operators share, as one Arrow UDF."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

SYMBOLS = "#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "bang_ratio",
          "digit_ratio", "stop_ratio", "top_word_ratio", "distinct_ratio", "non_ascii_ratio", "words_per_line"]
STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS] + [T.StructField(c, T.DoubleType()) for c in RATIOS])

WINDOW = 8
_MULT = np.random.default_rng(8).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words covered by ``window``-word windows that occur at least twice (first one included)."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number) + 1) for w in words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h += ids[k:k + n] * _MULT[k]
    _, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[inverse] > 1)
    if len(twice) == 0:
        return 0
    # equal windows have equal hashes; the exact comparison drops chance collisions
    exact = Counter(tuple(words[i:i + window]) for i in twice)
    start = np.zeros(len(words) + 1, np.int64)
    for i in twice:
        if exact[tuple(words[i:i + window])] > 1:
            start[i] += 1
            start[i + window] -= 1
    return int((np.cumsum(start) > 0).sum())


def stats_of(text: str) -> tuple:
    raw = text.encode()
    words = raw.split()              # bytes.split() cuts at exactly the ASCII white space of WORD
    n = len(words)
    word_chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.encode().split():
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = repeated_words(words)
    upper = len(raw) - len(raw.translate(None, UPPER))
    lower = len(raw) - len(raw.translate(None, LOWER))
    digits = len(raw) - len(raw.translate(None, DIGITS))
    counts = Counter(words)
    top = max(counts.values(), default=0)
    n1, c1 = max(1, n), max(1, word_chars)
    return (n, word_chars, symbols, dup, repeat, word_chars / n1, symbols / n1, dup / max(1, lines), repeat / n1,
            upper / max(1, upper + lower), text.count("!") / n1, digits / c1, text.count(".") / n1, top / n1,
            len(counts) / n1, (len(raw) - len(text)) / c1, n / max(1, lines))


@F.arrow_udf(STATS_TYPE)
def _stats(text: pa.Array) -> pa.Array:
    rows = [stats_of(t or "") for t in text.to_pylist()]
    cols = list(zip(*rows)) if rows else [()] * (len(COUNTS) + len(RATIOS))
    arrays = [pa.array(c, pa.int64()) for c in cols[:len(COUNTS)]] + [pa.array(c, pa.float64()) for c in cols[len(COUNTS):]]
    return pa.StructArray.from_arrays(arrays, COUNTS + RATIOS)


# Marked so, Spark evaluates it once where several expressions use its fields.
text_stats = _stats.asNondeterministic()
