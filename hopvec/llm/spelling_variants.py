"""Spelling variants: words one edit apart, found by asymmetric chunks.

Of two words one code point apart, the shorter (or of equal length the smaller) word gives its two
disjoint halves, the other all its positional grams of those lengths. The edit leaves one half
whole: the first at its place, or the second at its place or, where the other word is longer, one
further. Halves and grams meet by text and place, and every pair is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_CHARS = 5
MIN_COUNT = 3
DAMAGE = 97              # one of so many words of a document loses a code point
RATIO = 2                # a form is this many times as frequent as its variant
HOT = 4096               # grams of one key that a task takes
RUN = re.compile(r"[A-Za-zÀ-ÿ]+")


def words_of(doc_id: int | None, text: str | None, min_chars: int = MIN_CHARS, damage: int | None = DAMAGE) -> Counter:
    """Words of at least ``min_chars`` code points in one text, with their counts. ``damage``: one of so
    many (by crc32 of ``<doc_id>:<word>``; a null id is empty) loses one code point."""
    lowered = (text or "").encode().lower().decode()       # bytes.lower() changes A-Z only
    found = Counter(w for w in RUN.findall(lowered) if len(w) >= min_chars)
    if not damage:
        return found
    head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for w, n in found.items():
        h = zlib.crc32(w.encode(), head)
        if h % damage == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1:]
        if len(w) >= min_chars:
            out[w] += n
    return out


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, damage: int | None = DAMAGE) -> DataFrame:
    """``(word, n bigint)`` of ``docs (doc_id, text)``. Words are counted in each batch first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: Counter = Counter()
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                total.update(words_of(doc_id, text, min_chars, damage))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def near_words(vocab: DataFrame, hot: int = HOT) -> DataFrame:
    """``(s, s_n, t, t_n)``: each two words of ``vocab (word, n)`` one inserted, deleted or replaced code
    point apart, once. Keys of more than ``hot`` grams are dealt to several tasks."""
    one = F.lit(1).cast("bigint")
    bit = lambda c: F.call_function("shiftleft", one, F.ascii(c).bitwiseAND(F.lit(63)))
    letters = F.aggregate(F.split("word", ""), F.lit(0).cast("bigint"), lambda acc, c: F.when(c == "", acc).otherwise(acc.bitwiseXOR(bit(c))))
    size = F.length("word")
    base = stored(vocab.where(size > 0).select("word", "n", letters.alias("letters"), size.alias("size"), F.floor(size / 2).cast("int").alias("half")))

    def key(length, place, gram):
        return F.xxhash64(length, place, gram)

    # halves: the first at 0; the second at its place in words as long, one further in longer ones
    first, second = F.expr("substring(word, 1, half)"), F.expr("substring(word, half + 1)")
    halves = F.array(*[F.struct(key(F.col("size") + more, at, chunk).alias("key"), F.lit(k).alias("second"), F.lit(more).alias("more"))
                       for more in (0, 1) for k, at, chunk in ((0, F.lit(0), first), (1, F.col("half") + more, second))])
    s = base.select("word", "n", "letters", "half", F.inline(halves))
    # all positional grams of the lengths that halves of words as long or one shorter have
    lengths = F.array_distinct(F.array(F.floor((F.col("size") - 1) / 2), F.floor(F.col("size") / 2), F.ceil(F.col("size") / 2)).cast("array<int>"))
    grams = F.flatten(F.transform(F.filter(lengths, lambda q: q >= 1), lambda q: F.transform(
        F.sequence(F.lit(0), F.col("size") - q), lambda at: key(F.col("size"), at, F.substring("word", at + 1, q)))))
    t = base.select("word", "n", "letters", F.explode(grams).alias("key"))
    # only keys of both sides matter; a hot key's grams are dealt out, its halves repeated
    t = t.join(s.select("key").distinct(), "key", "left_semi")
    heavy = stored(t.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("key", F.ceil(F.col("k") / hot).cast("int").alias("parts")))
    t = t.join(heavy, "key", "left").withColumn("part", F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1))).cast("int"))
    s = s.join(heavy, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    s, t = s.alias("s"), t.alias("t")
    start = lambda side: F.substring(F.col(f"{side}.word"), F.lit(1), F.col("s.half"))
    near = ((F.col("s.key") == F.col("t.key")) & (F.col("s.part") == F.col("t.part"))
            & (F.bit_count(F.col("s.letters").bitwiseXOR(F.col("t.letters"))) <= 2)
            & ((F.col("more") == 1) | (F.col("s.word") < F.col("t.word")))
            & ((F.col("second") == 0) | (start("s") != start("t")))      # found by the first half already
            & (F.levenshtein("s.word", "t.word", 1) == 1))
    return s.join(t, near).select(F.col("s.word").alias("s"), F.col("s.n").alias("s_n"), F.col("t.word").alias("t"), F.col("t.n").alias("t_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``forms (word, form)``: the last word that forms lead to. Each round doubles the way."""
    state = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        up = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(state.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        state = step.select("word", "root")
        if step.where("moved").isEmpty():
            return state


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, damage: int | None = None, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of ``docs (doc_id, text)`` with at least
    ``min_chars`` code points and ``min_count`` occurrences.

    form is the near word of largest n (ties: smallest in code-point order) if that is at least
    ``ratio`` times the word's n, else null; root is where forms lead from the word, itself without
    one (forms have ever larger n, so the way ends). Null and empty texts have no words; repeated
    rows count each time; an empty table gives no rows.
    """
    vocab = stored(vocabulary(docs, min_chars, min_count, damage))
    pairs = stored(near_words(vocab))
    both = pairs.select(F.col("s").alias("word"), F.struct((-F.col("t_n")).alias("n"), F.col("t").alias("word")).alias("near")).union(
        pairs.select(F.col("t"), F.struct(-F.col("s_n"), F.col("s"))))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("best"))
    has = -F.col("best.n") >= ratio * F.col("n")
    out = stored(vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has, F.col("best.word")).alias("form"), F.when(has, -F.col("best.n")).alias("form_n")))
    ends = roots(out.where("form is not null").select("word", "form"))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
