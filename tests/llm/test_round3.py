"""n-gram join, Merkle manifest and spelling variants against brute force, with nulls, empty and long
texts, ties, repeated rows, empty tables and extra columns of clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hopvec.llm import line_join, merkle_manifest, sentencepiece_bpe, shingle_product, spelling_variants
from hopvec.llm.common import documents
from hopvec.llm.queries import op12_merkle_manifest

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents, near copies and awkward rows; the extra columns clash with output and inner names."""
    real = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("text").collect()]
    rng = random.Random(5)
    rows = list(enumerate(real))
    for k in range(120):                                    # drifting copies: many links, some only over others
        words = WORD.findall(real[k % 4])
        for _ in range(rng.randrange(1, 8)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(99)}"
        rows.append((1000 + k, " ".join(words)))
    rows += [(None, "a null id"), (None, real[0]), (9001, None), (9002, ""), (9003, " \t\n"), (9004, "one two"), (9004, "one two"), (9005, "One  TWO"),
             (9006, "ab " * 30_000), (9007, "x" * 50_000), (9008, "Größe größe GRÖSSE naïve ▁ \U0001F600 a×b"), (9009, real[1])]
    return spark.createDataFrame([(i, t, 1, "z", "g") for i, t in rows], "doc_id bigint, text string, rid int, root string, n string").cache()


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()


def groups(rows, num=90, den=100):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and den * k >= num * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted(((d, len(sets[i]), least.get(top(i))) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("tile,rounds", [(512, 3), (8, 3), (8, 0)])
def test_jaccard_groups_are_brute_force(docs, tile, rounds):
    got = shingle_product.jaccard_groups(documents(docs), tile=tile, rounds=rounds)
    want = groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert len({c for _, _, c in want}) < len(want) - 60
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == want


def test_jaccard_bound_is_exact(spark):
    """One row each side of the bound, and words that differ only by what is no white space."""
    base = [f"t{k}" for k in range(102)]                      # 100 shingles
    rows = [(1, " ".join(base)), (2, " ".join(base + ["u", "v", "x"])), (3, " ".join(base[:95])), (4, " ".join(base[:92])), (5, "a b c d"), (6, "a b c d")]
    got = shingle_product.jaccard_groups(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(d, c) for d, _, c in groups(rows)}


def test_blocked_overlap_counts():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = np.unique(rng.integers(0, 2**64, 40, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:rng.integers(30, 41)], rng.integers(0, 2**64, rng.integers(0, 6), dtype=np.uint64)]))
        k = len(np.intersect1d(a, b))
        assert shingle_product.linked(a, b) == (100 * k >= 90 * (len(a) + len(b) - k))
    s = [shingle_product.signature(np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))) for n in (5, 40, 90, 40)]
    assert (shingle_product.distance([s[0], s[1]], [s[0], s[3]]) == [0, np.bitwise_count(np.frombuffer(s[1], np.uint8) ^ np.frombuffer(s[3], np.uint8)).sum()]).all()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, source string, lang string, n_chars int, text string")
    assert shingle_product.jaccard_groups(none).count() == 0
    assert merkle_manifest.manifest(none).count() == 0
    assert spelling_variants.spelling_variants(none).count() == 0


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    text = row[4]
    if lower and text is not None:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))


def climb(nodes, fanout):
    """Root, and for each node the (left, right) siblings met on its way."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(at):
            lo = p - p % fanout
            ways[i].append(("".join(level[lo:p]), "".join(level[p + 1:lo + fanout])))
        level = [H(*level[k:k + fanout]) for k in range(0, len(level), fanout)]
        at = [p // fanout for p in at]
    return level[0], ways


def manifest_of(rows, fanout):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        by[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: climb([leaf(r) for r in by[g]], fanout) for g in names}
    root, ways = climb([trees[g][0] for g in names], fanout)
    out = []
    for g, upper in zip(names, ways):
        for r, lower in zip(by[g], trees[g][1]):
            way = lower + upper
            d = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for a, b in way:
                d = H(a, d, b)
            out.append((r[0], leaf(r), trees[g][0], root, H(*(a + b for a, b in way)), d, d == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n,fanout", [(1, 16), (2, 16), (300, 16), (300, 3)])
def test_manifest_is_brute_force(spark, tmp_path, n, fanout):
    rng = random.Random(n)
    rows = [(rng.randrange(200), "hot" if k % 3 else rng.choice([None, "", "src1", "Ünï", "a", "=", "-"]), rng.choice([None, "en"]), rng.choice([None, 3]),
             rng.choice([None, "", "Text A", "ÄB c" * 9])) for k in range(n)]
    rows += [(None, "hot", None, None, "A null id"), *rows[:2]] if n > 2 else []          # repeated rows
    df = spark.createDataFrame([(*r, "x", 1, True) for r in rows],
                               "doc_id bigint, source string, lang string, n_chars int, text string, digest string, pos int, verified boolean")
    if fanout == 16:
        df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
        got = op12_merkle_manifest(spark, str(tmp_path))
    else:
        lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        got = merkle_manifest.manifest(df, altered={"text": lowered}, where=F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, fanout=fanout)
    assert sorted(map(tuple, got.collect()), key=str) == manifest_of(rows, fanout)


def variants_of(rows, damage):
    count = Counter()
    for d, text in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if damage and h % damage == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))
    out, form = [], {}
    for w, n in words.items():
        by = sorted((-words[v], v) for v in words if abs(len(v) - len(w)) < 2 and v != w and near(w, v))
        form[w] = by[0][1] if by and -by[0][0] >= 2 * n else None
        out.append((w, n, len(by)))
    res = []
    for w, n, k in out:
        end = w
        while form[end]:
            end = form[end]
        res.append((w, form[w], end, n, k, words[form[w]] if form[w] else None))
    return sorted(res, key=str)


@pytest.mark.parametrize("damage,hot", [(97, 4096), (7, 3)])
def test_spelling_variants_are_brute_force(spark, docs, damage, hot, monkeypatch):
    rng = random.Random(3)
    stems = ["colour", "größe", "naïves", "abcde", "aaaaaa", "straße"]
    text = " ".join(s for s in stems for _ in range(rng.randrange(4, 60)))
    edits = []
    for s in stems:
        for _ in range(30):
            at, kind = rng.randrange(len(s) + 1), rng.randrange(3)
            edits += [(s[:at] + rng.choice("abÿ×") * (kind > 0) + s[at + (kind < 2):]).upper()] * rng.randrange(3, 5)
    more = spark.createDataFrame([(70 + k, t) for k, t in enumerate([text, " ".join(edits), " ".join(edits[::2])] * 2)], "doc_id bigint, text string")
    table = docs.select("doc_id", "text").union(more)
    monkeypatch.setattr(spelling_variants.near_words, "__defaults__", (hot,))
    got = spelling_variants.spelling_variants(table, damage=damage)
    want = variants_of([(r["doc_id"], r["text"]) for r in table.collect()], damage)
    assert any(w[1] and w[1] != w[2] for w in want)
    assert sorted(map(tuple, got.collect()), key=str) == want


def test_line_join_cuts_words_at_any_blank(spark):
    """Tabs, VT, FF, CR and runs of blanks cut words alike, for counting words too, and leave no empty word."""
    rows = [(1, "Alpha beta gamma delta"), (2, "\talpha\x0bBETA  gamma\x0cdelta \r"), (3, " \t\r\x0b\x0c \n   "), (4, "alpha  beta")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r._removed) for r in line_join.dedup_lines(df, min_words=1).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("", 1), 3: (rows[2][1], 0), 4: (rows[3][1], 0)}
    keyed = line_join.keyed(df)
    occ = {(r.doc, r.line): r.n for r in line_join.occurrences(keyed, line_join.rarity(keyed), 1).collect()}
    assert occ == {(1, 0): 4, (2, 0): 4, (4, 0): 2}
    # delta occurs twice (level 33 + 2 log2 2), whatever blank stands beside it
    bucket = df.select(F.xxhash64(F.lit("delta")).bitwiseAND(F.lit(line_join.BUCKETS - 1))).first()[0]
    assert line_join.rarity(keyed)[bucket] == 33 + 2
    # cut at plain spaces: a pattern took most of the stage's time
    assert line_join.SPACES not in line_join.occurrences(keyed, line_join.rarity(keyed), 1)._jdf.queryExecution().optimizedPlan().toString()


def test_piece_cache_is_bounded_and_holds_plain_segments(monkeypatch):
    """A worker's cache keeps the first half of its segments when full (it grew to a million with space marks, two
    bytes a character, and stayed in idle workers beside the next stage); ids and spans stay the same."""
    monkeypatch.setattr(sentencepiece_bpe, "CACHE", 8)
    blob = sentencepiece_bpe.read_model(public_tokenizers.path("piece_bpe_32k.model"))
    small, plain = sentencepiece_bpe.Model(blob), sentencepiece_bpe.Model(blob)
    text = "the " + " ".join(f"word{i} the" for i in range(40))
    for t in (text, "", " ", "a▁b c▁ d", "▁▁  x\n\n y", "café 漢 \U0001f600"):
        ids, ends = small.encode(t)
        whole = plain.normalize(t)[0]
        want = [plain.ids.get(p) for s in plain.cut.findall(whole) for p in plain.merge(s)]
        if None not in want:
            assert ids.tolist() == [*want, plain.eos]
        assert ends[-1] == len(t.encode()) and ids.dtype == ends.dtype == "int32"
        assert len(small.segments) <= 8
    small.encode(text)
    assert " the" in small.segments and small.segments[" the"] == small.segment("▁the")
