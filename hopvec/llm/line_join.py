"""Line deduplication by an exact set-similarity join, with built-in functions only.

A line is the set of its lower-cased words. Two lines match at a Jaccard similarity of 4/5 or
more. A line is removed if it matches a line at an earlier position (document id, line number) of
any document, removed or not. Lines of fewer than ``min_words`` different words are left alone:
``MIN_WORDS`` by default, 1 in the queries, where only lines without a word stay.

Words are ordered by rarity, from counts over all documents in ``BUCKETS`` hashed buckets (any
total order gives the same result; a fine one gives few candidates). Lines with equal sets are
joined by hash first; sets of under ``LEAST_JOINED`` words match no others. The others meet on words of their rarest prefixes and pass length, positional
and parity filters before the exact check:

* a pair needs an overlap of ``ceil(4/9 (n + m))``, so the shorter line is found by its first
  ``n - ceil(8/9 n) + 1`` words among the first ``m - ceil(4/5 m) + 1`` of the longer one;
* the parity of the words that fall on each bit of a 128-bit signature differs in at most
  ``n + m - 2 overlap`` bits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_names, stored

NUM, DEN = 4, 5          # least Jaccard similarity as a fraction
MIN_WORDS = 5
LEAST_JOINED = 4         # at 4/5, smaller sets match only when equal
BUCKETS = 1 << 18
PIVOT_WORDS = 2          # rarest words by which the first round looks
HOT_LINES = 2            # words of more lines of a class get the second look
CLASSES = 8
PARTS = 3                # shares of the words that the second round joins one after the other (bounds disk)
BROADCAST_ROWS = 200_000


def _ceil(num: Column, den: int) -> Column:
    """Integer ceiling of ``num / den``."""
    return F.floor((num + (den - 1)) / den).cast("int")


def overlap(n: Column) -> Column:
    """Least overlap of two sets with ``n`` words together."""
    return _ceil(NUM * n, NUM + DEN)


def keyed(docs: DataFrame) -> DataFrame:
    """``(doc bigint, row_hash, text)``: a null id sorts before all others; rows that repeat an id
    and a text are one document, rows that repeat an id with another text are not."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))).alias("doc"), F.xxhash64(text).alias("row_hash"), text.alias("text"))


def lines(rows: DataFrame) -> DataFrame:
    return rows.select("doc", "row_hash", F.posexplode(F.split("text", "\n")).alias("line", "content"))


def spaced(text: Column) -> Column:
    """Tabs, VT, FF and CR as spaces: words are then cut at one plain character, at a third of a pattern's cost."""
    return reduce(lambda c, blank: F.replace(c, F.lit(blank), F.lit(" ")), "\t\x0b\x0c\r", text)


def word_set(content: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(content), SPACES)), "")


def _bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rarity(rows: DataFrame) -> bytes:
    """A byte for each bucket of hashed words: twice the binary logarithm of its count, from 33.
    Counted in the words' own case, and runs of blanks as words: the order serves the filters, not the result."""
    words = rows.select(F.explode(F.split(F.replace(spaced(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.groupBy(_bucket(F.xxhash64("w")).alias("bucket")).agg(F.count("*").alias("n"))
    level = counts.select("bucket", F.least(F.lit(93), F.floor(2 * F.log2("n"))).cast("int").alias("level")).toPandas()
    out = bytearray([33]) * BUCKETS
    for bucket, value in zip(level["bucket"], level["level"]):
        out[bucket] = 33 + value
    return bytes(out)


def occurrences(rows: DataFrame, levels: bytes, min_words: int = MIN_WORDS) -> DataFrame:
    """doc, row_hash, line, a and b (two hashes of the set), n (its size), its parity signature, prefix (the
    rarest words that the longer line of a pair needs, as 32-bit hashes)."""
    table = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<tinyint>")      # folded to a literal
    rows = rows.select("doc", "row_hash", spaced(F.lower("text")).alias("text"))
    cut = F.split(F.trim("content"), " ")
    hashes = F.transform(F.when(F.contains("content", F.lit("  ")), F.array_remove(cut, "")).otherwise(cut), lambda w: F.xxhash64(w))
    code = F.transform("h", lambda h: F.shiftleft(F.get(table, _bucket(h)).cast("bigint"), 56).bitwiseOR(F.shiftrightunsigned(h, 8)))
    some = F.trim("content") != "" if min_words < 2 else F.length("content") >= 2 * min_words - 1
    found = lines(rows).where(some).withColumn("h", hashes)
    found = found.withColumn("code", F.sort_array(F.array_distinct(code))).withColumn("n", F.size("code"))
    one = F.lit(1).cast("bigint")
    bit = lambda c: F.call_function("shiftleft", one, c.bitwiseAND(F.lit(63)).cast("int"))

    def parity(value) -> Column:
        return F.aggregate("code", F.lit(0).cast("bigint"), lambda acc, c: acc.bitwiseXOR(value(c)))

    # parity of the words on each of 64 bits: of those whose next bit is set, and of all
    marked = parity(lambda c: F.call_function("shiftleft", F.shiftright(c, 6).bitwiseAND(one), c.bitwiseAND(F.lit(63)).cast("int")))
    every = parity(bit)

    prefix = F.transform(F.slice("code", F.lit(1), F.col("n") - _ceil(NUM * F.col("n"), DEN) + 1), lambda c: F.hash(c))
    # no filter on n here: pushed down, it would compute the codes of every line once more
    return found.select(
        "doc", "row_hash", "line", F.xxhash64("code").alias("a"), F.xxhash64("code", F.lit(1)).alias("b"), "n", every.alias("every"), marked.alias("marked"), prefix.alias("prefix")).select(
        "doc", "row_hash", "line", "a", "b", "n", F.col("every").bitwiseXOR(F.col("marked")).alias("parity0"), F.col("marked").alias("parity1"), "prefix")


def _postings(reps: DataFrame, length: Column) -> DataFrame:
    p = F.posexplode(F.slice("prefix", F.lit(1), length)).alias("i", "token")
    return reps.select("a", "doc", "line", "n", "parity0", "parity1", "open", p)


def _earlier(x: str, y: str) -> Column:
    c = lambda s, k: F.col(f"{s}.{k}")
    return (c(x, "doc") < c(y, "doc")) | ((c(x, "doc") == c(y, "doc")) & (
        (c(x, "line") < c(y, "line")) | ((c(x, "line") == c(y, "line")) & (c(x, "a") < c(y, "a")))))


def _passes(s: str, t: str) -> Column:
    """Length, positional and parity filter for postings ``s`` and ``t`` of one word."""
    n, m, i, j = F.col(f"{s}.n"), F.col(f"{t}.n"), F.col(f"{s}.i"), F.col(f"{t}.i")
    need = overlap(n + m)
    differ = sum(F.bit_count(F.col(f"{s}.parity{k}").bitwiseXOR(F.col(f"{t}.parity{k}"))) for k in (0, 1))
    return ((DEN * F.least(n, m) >= NUM * F.greatest(n, m)) & (F.least(n - i, m - j) >= need)
            & (differ <= n + m - 2 * need))


def checked_broadcast(small: DataFrame) -> DataFrame:
    """``small`` with a broadcast hint if it has at most ``BROADCAST_ROWS`` narrow rows; beyond that
    the join shuffles."""
    return F.broadcast(small) if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else small


def verified(rows: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(y)``: the lines of ``pairs (x, y)`` (set hashes ``a``) whose exact word sets match. Only the
    lines in question are cut into words again."""
    ids = stored(pairs.select(F.explode(F.array("x", "y")).alias("a")).distinct())
    places = stored(reps.select("a", "doc", "row_hash", "line").join(checked_broadcast(ids), "a"))
    wanted = places.groupBy("doc", "row_hash").agg(F.collect_set("line").alias("wanted"))
    texts = rows.join(checked_broadcast(stored(wanted)), ["doc", "row_hash"])
    cut = F.split("text", "\n")
    sets = texts.select("doc", "row_hash", F.explode(F.transform("wanted", lambda k: F.struct(
        k.alias("line"), F.get(cut, k).alias("content")))).alias("l")).select("doc", "row_hash", "l.line", word_set(F.col("l.content")).alias("words"))
    sets = stored(sets.join(places, ["doc", "row_hash", "line"]).select("a", "words").dropDuplicates(["a"]))
    both = pairs.join(sets.select(F.col("a").alias("x"), F.col("words").alias("u")), "x").join(sets.select(F.col("a").alias("y"), F.col("words").alias("v")), "y")
    common = F.size(F.array_intersect("u", "v"))
    return both.where((NUM + DEN) * common >= NUM * (F.size("u") + F.size("v"))).select("y").distinct()


def _against_earliest(rows: DataFrame, reps: DataFrame, some: DataFrame, words: Column, more_than: int = 1, classes: int = 1) -> DataFrame:
    """``(y)``: lines of ``some`` that match the earliest line of ``reps`` (of each of ``classes``
    classes by hash) with one of their first ``words`` words, for words of more than ``more_than``
    lines of a class."""
    part = F.pmod(F.xxhash64("a"), F.lit(classes))
    pivot = _postings(reps, words).groupBy("token", part).agg(F.min(F.struct("doc", "line", "a", "n", "i", "parity0", "parity1")).alias("p"), F.count("*").alias("k"))
    pivot = stored(pivot.where(F.col("k") > more_than).select("token", "p.*"))     # a table of its own bounds disk
    near = _postings(some, words).alias("y").join(pivot.alias("x"), (F.col("x.token") == F.col("y.token")) & _passes("x", "y") & _earlier("x", "y"))
    near = near.groupBy(F.col("y.a").alias("y")).agg(F.min(F.struct("x.doc", "x.line", "x.a")).alias("x")).select("y", F.col("x.a").alias("x"))
    return stored(verified(rows, reps, stored(near)))


def later_matches(rows: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc, row_hash, line)`` of the lines to remove, for ``rows (doc, row_hash, text)``."""
    occ = stored(occurrences(rows, rarity(rows), min_words)).where(F.col("n") >= min_words)
    # equal sets: every occurrence but the first goes, whatever else matches
    kept = F.min(F.struct("doc", "line", "row_hash", "n", "parity0", "parity1", "prefix")).alias("r")
    firsts = stored(occ.groupBy("a", "b").agg(kept).select("a", "b", "r.*"))
    reps = firsts.where(F.col("n") >= LEAST_JOINED).withColumn("open", F.lit(True))
    place = F.struct("doc", "line", "row_hash")
    copies = (occ.select("a", "b", "doc", "line", "row_hash").join(firsts.select("a", "b", place.alias("first")), ["a", "b"])
              .where(place != F.col("first")))

    short = F.col("n") - _ceil(2 * NUM * F.col("n"), NUM + DEN) + 1
    # round 1: each line against the earliest line that shares one of its rarest words. Most
    # variants of one passage are settled here, by a few pairs for each line. Lines still open look
    # once more, at the earliest lines of some classes for words of many lines; what is left is for
    # round 2.
    done = _against_earliest(rows, reps, reps, F.least(short, F.lit(PIVOT_WORDS)))
    still = reps.join(checked_broadcast(done.select(F.col("y").alias("a"))), "a", "left_anti")
    done = stored(done.union(_against_earliest(rows, reps, still, short, HOT_LINES, CLASSES)))

    # round 2: all other pairs whose later line is still open
    left = reps.join(checked_broadcast(done.select(F.col("y").alias("a"), F.lit(False).alias("still"))), "a", "left").withColumn("open", F.coalesce("still", F.lit(True))).drop("still")
    order = (F.col("s.n") < F.col("t.n")) | ((F.col("s.n") == F.col("t.n")) & (F.col("s.a") < F.col("t.a")))
    t_later = _earlier("s", "t")
    open_later = F.when(t_later, F.col("t.open")).otherwise(F.col("s.open"))
    found = []
    for part in range(PARTS):
        s, t = (_postings(left, n).where(F.pmod("token", F.lit(PARTS)) == part).alias(name) for name, n in (("s", short), ("t", F.size("prefix"))))
        pairs = s.join(t, (F.col("s.token") == F.col("t.token")) & order & _passes("s", "t") & open_later)
        found.append(stored(pairs.select(F.when(t_later, F.col("s.a")).otherwise(F.col("t.a")).alias("x"),
                                         F.when(t_later, F.col("t.a")).otherwise(F.col("s.a")).alias("y")).distinct()))
    pairs = reduce(DataFrame.union, found).distinct()
    gone = stored(done.union(verified(rows, reps, pairs)).withColumnRenamed("y", "a"))
    firsts_gone = reps.join(gone, "a", "left_semi").select("doc", "row_hash", "line")
    return copies.select("doc", "row_hash", "line").union(firsts_gone)


def dedup_lines(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", removed_col: str = "_removed", min_words: int = MIN_WORDS) -> DataFrame:
    """``df`` with the lines removed from ``text_col``, and their number in ``removed_col``.

    Other columns stay as they are, whatever their names: if ``df`` has a column ``removed_col`` already, the
    new one gets underscores before its name. Kept lines stay in order, joined by line feeds. A null text
    stays null; empty texts and empty tables stay as they are. Rows that repeat an id and text
    lose the same lines. Lines of fewer than ``min_words`` different words stay.
    """
    removed_col, doc, row_hash, places = free_names(df, removed_col, "_doc", "_hash", "_lines")
    rows = keyed(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    gone = stored(later_matches(rows, min_words).groupBy("doc", "row_hash").agg(F.collect_set("line").alias("lines")))
    gone = gone.select(F.col("doc").alias(doc), F.col("row_hash").alias(row_hash), F.col("lines").alias(places))
    same = ((F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))) == F.col(doc))
            & (F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))) == F.col(row_hash)))
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda s, k: ~F.array_contains(places, k)), "\n")
    out = df.join(checked_broadcast(gone), same, "left")
    return (out.withColumn(removed_col, F.coalesce(F.size(places), F.lit(0)))
            .withColumn(text_col, F.when(F.col(places).isNull(), F.col(text_col)).otherwise(kept)).drop(doc, row_hash, places))
