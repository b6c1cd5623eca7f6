"""Learned decision lists: ordered threshold rules that tell which documents to reject.

Sequential covering on labelled statistics: grow a conjunction of thresholds by information
gain, prune it on held-back rows, keep it if it is precise enough, remove what it covers,
repeat. The list becomes one Spark ``CASE WHEN`` expression over the statistics.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, labelled_sample
from .textstats import COUNTS, RATIOS, text_stats

FEATURES = ["n_words", *RATIOS]
MAX_TRAIN = 8000     # labelled documents that a fit may use
CUTS = 48            # thresholds tried for each statistic

Rule = list[tuple[str, str, float]]   # conditions (statistic, "<=" or ">", threshold)


def _covers(x: np.ndarray, rule: Rule) -> np.ndarray:
    m = np.ones(len(x), bool)
    for name, op, t in rule:
        v = x[:, FEATURES.index(name)]
        m &= (v <= t) if op == "<=" else (v > t)
    return m


def _grow(x: np.ndarray, y: np.ndarray, max_conditions: int) -> Rule:
    rule: Rule = []
    live = np.ones(len(x), bool)
    while len(rule) < max_conditions and y[live].sum() < live.sum():
        p0, t0 = y[live].sum(), live.sum()
        best, choice = 0.0, None
        for j, name in enumerate(FEATURES):
            v = x[live, j]
            cuts = np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)[1:-1], method="lower"))
            for op in ("<=", ">"):
                m = (v[:, None] <= cuts) if op == "<=" else (v[:, None] > cuts)
                p, t = (m & (y[live] == 1)[:, None]).sum(0), m.sum(0)
                gain = p * (np.log2(np.maximum(p, 1e-9) / np.maximum(t, 1)) - np.log2(max(p0, 1e-9) / t0))
                gain = np.where(p > 0, gain, 0.0)
                i = int(gain.argmax())
                if gain[i] > best + 1e-12:
                    best, choice = float(gain[i]), (name, op, float(cuts[i]))
        if choice is None:
            break
        rule.append(choice)
        live &= _covers(x, [choice])
    return rule


def _prune(x: np.ndarray, y: np.ndarray, rule: Rule) -> Rule:
    def worth(r: Rule) -> float:
        m = _covers(x, r)
        p, n = (y[m] == 1).sum(), (y[m] == 0).sum()
        return (p - n) / max(1, p + n)
    return max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)


def learn(x: np.ndarray, y: np.ndarray, min_precision: float = 0.97, min_cover: int = 5,
          max_rules: int = 12, max_conditions: int = 4) -> list[Rule]:
    """Ordered reject rules; ``y`` is 1 for a document to reject. Deterministic for equal rows."""
    rng = np.random.default_rng(7)
    fold = rng.random(len(x)) < 2 / 3
    left = np.ones(len(x), bool)
    rules: list[Rule] = []
    while len(rules) < max_rules and y[left & fold].sum() >= min_cover:
        rule = _grow(x[left & fold], y[left & fold], max_conditions)
        if not rule:
            break
        rule = _prune(x[left & ~fold], y[left & ~fold], rule)
        m = _covers(x, rule) & left
        hit = int((y[m] == 1).sum())
        if hit < min_cover or hit < min_precision * m.sum():
            break
        rules.append(rule)
        left &= ~m
    return rules


def fit_rules(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, **kw) -> list[Rule]:
    """Learn from at most ``max_train`` labelled documents (``labels.quality`` 0: reject).
    Documents that the base rule rejects anyway are left out. No labels, or labels of one kind
    only, give the empty list. A repeated id counts once."""
    s = labelled_sample(docs, labels, "quality", max_train).select("doc_id", "label", text_stats("text").alias("s")).where(~base_failed("s"))
    s = s.groupBy("doc_id").agg(F.max(F.struct("label", "s")).alias("r")).orderBy("doc_id")
    rows = s.select("r.label", *[F.col(f"r.s.{c}").cast("double").alias(c) for c in FEATURES]).toPandas()
    if rows.empty or rows["label"].nunique() < 2:
        return []
    return learn(rows[FEATURES].to_numpy(float), (rows["label"].to_numpy() == 0).astype(int), **kw)


def base_failed(stats: str) -> Column:
    """Fewer than 20 words, or more than 30 % of the words in repeated windows."""
    n, r = F.col(stats)["n_words"], F.col(stats)["n_repeat_words"]
    return (n < 20) | (100 * r > 30 * n)


def rule_number(rules: list[Rule], stats: str = "s") -> Column:
    """Number (from 1) of the first rule that fires on struct column ``stats``, else 0."""
    out = F
    for i, rule in enumerate(rules, 1):
        cond = F.lit(True)
        for name, op, t in rule:
            v = F.col(stats)[name].cast("double")
            cond = cond & ((v <= t) if op == "<=" else (v > t))
        out = out.when(cond, F.lit(i))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def with_verdict(df: DataFrame, rules: list[Rule], text_col: str = "text", out: str = "_quality") -> DataFrame:
    """``df`` plus one struct column ``out``: the statistics, ``base_failed``, ``rule``, ``kept``.

    A null or empty text has no words and so fails the base rule. Map-only; other columns stay.
    """
    s, = free_names(df, f"{out}_s")
    df = df.withColumn(s, text_stats(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    base, rule = base_failed(s), rule_number(rules, s)
    return df.withColumn(out, F.struct(f"{s}.*", base.alias("base_failed"), rule.alias("rule"),
                                       (~base & (rule == 0)).alias("kept"))).drop(s)


def quality_rules(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row per row of ``docs (doc_id, text)``: doc_id, the counts, base_failed, kept, rule."""
    d = with_verdict(docs, rules)
    return d.select("doc_id", *[f"_quality.{c}" for c in COUNTS], "_quality.base_failed", "_quality.kept", "_quality.rule")
