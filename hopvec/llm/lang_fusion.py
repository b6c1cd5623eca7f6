"""Language identification by Bayesian evidence fusion.

For each page: tempered text likelihoods (hashed byte 4-grams, naive Bayes), the language the
markup declares, the suffix of the address, and the priors of its host. Host priors are smoothed
over the host's domain, its suffix and the whole corpus, from grouped sums of the text posteriors.
A page's own share is taken out of every sum before the page uses it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .line_join import checked_broadcast

GRAM = 4
BUCKETS = 1 << 16
MAX_TRAIN = 8000      # labelled documents that a fit may use
TEMPER = 40.0         # grams that count as independent evidence at most
STRENGTH = 5.0        # pages that a parent prior is worth
# Domains under which hosts are registered one level deeper.
SECOND_LEVEL = ["co", "com", "org", "net", "gov", "ac", "edu"]


def grams(text: str) -> np.ndarray:
    """Bucket of every byte ``GRAM``-gram of the lower-cased text (a short text gives none)."""
    b = np.frombuffer((" " + " ".join(text.lower().split()) + " ").encode(), np.uint8).astype(np.uint32)
    n = len(b) - GRAM + 1
    if n < 1:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint32)
    for k in range(GRAM):
        h = (h ^ b[k:k + n]) * np.uint32(16777619) + np.uint32(0x9E3779B9)
    return ((h ^ (h >> 16)) % BUCKETS).astype(np.int64)


class TextModel:
    """``langs`` and log probabilities of the gram buckets under each (a fixed size a language)."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.log_p = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * BUCKETS)) if langs else counts

    def log_likelihood(self, text: str) -> np.ndarray:
        """Tempered log likelihoods, 0 for the best language; all 0 without grams."""
        g = grams(text)
        if len(g) == 0 or not self.langs:
            return np.zeros(len(self.langs))
        ll = self.log_p[:, g].sum(1)
        ll *= min(1.0, TEMPER / len(g))
        return ll - ll.max()


def fit_text_model(docs: DataFrame, max_train: int = MAX_TRAIN) -> TextModel:
    """Gram counts by language of at most ``max_train`` documents, chosen by hash of the id. Rows
    with a null or empty language are left out."""
    lab = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.trim(F.lower(F.col("lang").cast("string"))).alias("lang")).where(
        "doc_id is not null and lang <> ''")
    ids = lab.groupBy("doc_id").agg(F.min("lang").alias("lang")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist()):
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                sums[lang] += np.bincount(grams(text), minlength=BUCKETS)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])], ["lang", "bucket", "n"])

    sample = texts.join(F.broadcast(ids), "doc_id").select("lang", "text")
    rows = (sample.mapInArrow(count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((len(langs), BUCKETS))
    for i, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        counts[i, own["bucket"].to_numpy(int)] = own["n"].to_numpy(float)
    return TextModel(langs, counts)


_RAW = re.compile(r"<(script|style)\b", re.I)
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style")}
_MARKUP = re.compile(r"<(html|meta)\b", re.I)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CODE = re.compile(r"\s*([A-Za-z]{2,3})(?![A-Za-z])")


def _attributes(tag: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(tag):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def page_parts(html: str) -> tuple[str, str]:
    """Visible text, roughly, and the declared language ('' : none), from one forward scan.

    Comments, scripts, styles and tags go and entities are resolved; what is not closed counts as a tag, or as
    text if no tag ends behind it. An end that was not found once is not looked for again, so time grows with the
    length of the page. The language is that of the first ``html`` tag that gives one (``lang``, then
    ``xml:lang``), else of a ``content-language`` in a ``meta`` tag; comments and scripts declare nothing.
    """
    out, pos, said, meta = [], 0, "", ""
    comments, open_raw = True, {"script": True, "style": True}
    while True:
        start = html.find("<", pos)
        if start < 0:
            break
        out.append(html[pos:start])
        out.append(" ")
        if comments and html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            if end >= 0:
                pos = end + 3
                continue
            comments = False
        end = html.find(">", start)
        if end < 0:
            pos = start
            break
        raw = _RAW.match(html, start)
        if raw and open_raw[raw[1].lower()]:
            close = _CLOSE[raw[1].lower()].search(html, end + 1)
            if close:
                pos = close.end()
                continue
            open_raw[raw[1].lower()] = False
        markup = _MARKUP.match(html, start)
        if markup and not said:
            tag = _attributes(html[markup.end():end])
            if markup[1].lower() == "html":
                codes = [_CODE.match(tag.get(name, "")) for name in ("lang", "xml:lang")]
                said = next((c[1].lower() for c in codes if c), "")
            elif tag.get("http-equiv", "").lower() == "content-language" and not meta:
                code = _CODE.match(tag.get("content", ""))
                meta = code[1].lower() if code else ""
        pos = end + 1
    out.append(html[pos:])
    return unescape("".join(out)), said or meta


def text_evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, url, declared ('' : none), ll (tempered log likelihood by language)."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            html = [h or "" for h in b["html"].to_pylist()]
            parts = [page_parts(h) for h in html]
            yield pa.RecordBatch.from_arrays(
                [b["page_id"], b["url"], pa.array([said for _, said in parts], pa.string()),
                 pa.array([m.log_likelihood(text).tolist() for text, _ in parts], pa.list_(pa.float64()))],
                ["page_id", "url", "declared", "ll"])

    p = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                     F.col("html").cast("string").alias("html"))
    return p.mapInArrow(run, "page_id bigint, url string, declared string, ll array<double>")


def _softmax(ll: Column) -> Column:
    top = F.array_max(ll)
    e = F.transform(ll, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def identify(pages: DataFrame, model: TextModel, temper_strength: float = STRENGTH) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared, host: one row per row of ``pages (page_id, url, html)``.

    Null or empty pages have no text evidence; the rest decides. Ties go to the alphabetically
    first language. Without languages (nothing to train on) lang is null and confidence 0.
    """
    n = len(model.langs)
    url = F.col("url")
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    parts = F.split("host", r"\.")
    deep = F.coalesce(F.get(parts, F.size(parts) - 2).isin(SECOND_LEVEL), F.lit(False)) & (F.size(parts) >= 3)
    page = text_evidence(pages, model).withColumn("host", host).withColumn(
        "domain", F.array_join(F.slice(parts, -F.least(F.size(parts), F.when(deep, 3).otherwise(2)), F.size(parts)), ".")).withColumn(
        "suffix", F.element_at(parts, -1)).withColumn("post", _softmax(F.col("ll")) if n else F.array().cast("array<double>"))
    page = stored(page)
    if n == 0:
        return page.select("page_id", F.lit(None).cast("string").alias("lang"), F.lit(0.0).alias("confidence"),
                           F.lit(None).cast("string").alias("text_lang"), "declared", "host")

    sums = [F.sum(F.col("post")[i]).alias(f"c{i}") for i in range(n)]
    vector = F.array(*[F.col(f"c{i}") for i in range(n)])

    def grouped(key: str, name: str) -> DataFrame:
        """Summed text posteriors of each value of ``key`` (partial sums before the shuffle)."""
        return page.groupBy(key).agg(*sums).select(key, vector.alias(name))

    whole = page.agg(*sums).select(vector.alias("all")).first()["all"]      # a number for each language
    out = page.withColumn("all", F.array(*[F.lit(x or 0.0) for x in whole]))
    for key, name in (("host", "by_host"), ("domain", "by_domain"), ("suffix", "by_suffix"), ("declared", "by_declared")):
        out = out.join(checked_broadcast(stored(grouped(key, name))), key)     # few values: no row moves; many: shuffled

    less = lambda name: F.zip_with(F.col(name), F.col("post"), lambda a, b: F.greatest(a - b, F.lit(0.0)))

    def smooth(own: Column, parent: Column) -> Column:
        total = F.aggregate(own, F.lit(0.0), lambda a, b: a + b) + temper_strength
        return F.zip_with(own, parent, lambda c, p: (c + temper_strength * p) / total)

    out = out.withColumn("p_all", smooth(less("all"), F.array_repeat(F.lit(1.0 / n), n)))
    out = out.withColumn("p_suffix", smooth(less("by_suffix"), F.col("p_all")))
    out = out.withColumn("p_domain", smooth(less("by_domain"), F.col("p_suffix")))
    out = out.withColumn("p_host", smooth(less("by_host"), F.col("p_domain")))
    # likelihood of a declaration under a language: P(language | declaration) / P(language)
    out = out.withColumn("p_declared", smooth(less("by_declared"), F.col("p_all")))
    score = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (
        F.get("ll", i) + F.log(F.get("p_host", i)) + F.log(F.get("p_declared", i)) - F.log(F.get("p_all", i))))
    out = out.withColumn("p", _softmax(score))
    langs = F.array(*[F.lit(x) for x in model.langs])
    best = lambda c: F.get(langs, F.array_position(c, F.array_max(c)).cast("int") - 1)
    return out.select("page_id", best(F.col("p")).alias("lang"), F.array_max("p").alias("confidence"),
                      best(F.col("post")).alias("text_lang"), "declared", "host")
