"""Personal data by bootstrapped contextual extraction, with built-in functions only.

Fixed patterns find base entities (e-mail, IP, card and phone numbers). They seed a graph of
lexical patterns (left word, right word, or both, of a token with an @ or of another with digits) and instances (tokens with a digit or an @; every kind has one of them).
The form of a token is no part of a pattern, so identifiers of unseen forms are found by context.
Pattern and instance scores feed each other for some rounds; patterns that then score high
and have several seeds mark further tokens as entities of their kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

KINDS = ["email", "ip", "card", "phone"]
# Possessive quantifiers change no match here (nothing behind them could use what they hold) but
# keep Java's matcher from recursing. The look-behind starts only at the start of a run, or where
# the previous match ended: any match from inside a run would also start at its first character.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
CONTEXT = 64      # characters beside a token in which its neighbouring word is looked for

ROUNDS = 3
MIN_SCORE = 0.8
MIN_SEEDS = 3


def _located(text: Column, pattern: str, needs: Column) -> Column:
    """``array<struct<start, end, value>>`` of the matches of ``pattern``, in code points."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = begin + F.length(x["h"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["h"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    zipped = F.zip_with(F.slice(pieces, F.lit(1), F.size(hits)), hits, lambda p, h: F.struct(p.alias("p"), h.alias("h")))
    found = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    return F.when(needs, found).otherwise(start["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(_digits(value)).between(12, 19), _luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _checked(no: int, kind: str, spans: Column) -> Column:
    good = F.filter(spans, lambda s: _valid(kind, s["value"]))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(no).alias("no"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def base_spans(text: Column) -> Column:
    """``array<struct<start, no, kind, end>>`` of the base entities by start, then kind."""
    digit = text.rlike("[0-9]")
    needs = {"email": text.contains("@"), "ip": digit, "card": digit, "phone": text.contains("+")}
    patterns = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}
    parts = [_checked(no, kind, _located(text, patterns[kind], needs[kind])) for no, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*parts))


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _occurrences(base: DataFrame) -> DataFrame:
    """One row per identifier-like token: key, start, end, core, kind of the base entity it is
    part of ('' : overlaps one only in part, null: none), pats (its lexical patterns: left word,
    right word, both; with the class of the token)."""
    text = F.col("text")
    tokens = _located(text, TOKEN, text.rlike("[0-9@]"))
    d = base.select("doc_id", "row_hash", "base", text, F.explode(tokens).alias("t")).select(
        "doc_id", "row_hash", "base", F.col("t.start").alias("start"),
        F.regexp_replace("t.value", r"[.,;:!?]+$", "").alias("core"),
        F.substring(text, F.greatest(F.lit(1), F.col("t.start") - CONTEXT + 1), F.least(F.lit(CONTEXT), F.col("t.start"))).alias("before"),
        F.substring(text, F.col("t.end") + 1, F.lit(CONTEXT)).alias("after")).where("core <> ''")
    d = d.withColumn("end", F.col("start") + F.length("core"))
    inside = F.filter("base", lambda b: (b["start"] <= F.col("start")) & (F.col("end") <= b["end"]))
    touches = F.exists("base", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    word = lambda c: _shape(F.lower(c))
    left = word(F.regexp_extract("before", r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+$", 1))
    right = word(F.regexp_extract("after", r"^[^\x20\x09-\x0D]*[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)", 1))
    token = F.when(F.col("core").contains("@"), F.lit("@")).otherwise(F.lit("9"))
    before, after = F.concat(left, F.lit(" > "), token), F.concat(token, F.lit(" < "), right)
    return d.select("doc_id", "row_hash", "start", "end", "core",
                    F.when(F.size(inside) > 0, inside[0]["kind"]).when(touches, F.lit("")).alias("kind"),
                    F.array(before, after, F.concat(before, F.lit(" < "), right)).alias("pats"))


def _shape(c: Column) -> Column:
    """Digits become 9; a token with a digit or @ also loses its letters (runs become a)."""
    return F.when(c.rlike("[0-9@]"), F.regexp_replace(F.regexp_replace(c, "[0-9]", "9"), r"\p{L}+", "a")).otherwise(c)


def score_patterns(occ: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``pat``, ``p_<kind>`` (score 0 to 1) and ``n_<kind>`` (seed instances) of every pattern.

    A pattern scores the weighted mean of its instances' scores (one doubt added to the weight);
    an instance that is no seed scores the weighted mean of its patterns; seeds stay at 1 for
    their kind and 0 for others. Tokens of base entities are instances apart from equal tokens
    elsewhere: '12' within a card number makes no seed of every other '12'.
    """
    core = F.concat_ws("\x01", "core", "kind").alias("core")
    edges = stored(occ.where("kind is null or kind <> ''").select(F.explode("pats").alias("pat"), core, "kind")
                        .groupBy("pat", "core").agg(F.count("*").alias("w"), F.max("kind").alias("kind")))
    seed = edges.groupBy("core").agg(F.max("kind").alias("seed"))
    inst = stored(seed.select("core", "seed", *[F.when(F.col("seed") == k, 1.0).otherwise(0.0).alias(f"s_{k}") for k in KINDS]))
    for i in range(rounds):
        pats = stored(edges.select("pat", "core", "w").join(inst, "core").groupBy("pat").agg(
            *[(F.sum(F.col("w") * F.col(f"s_{k}")) / (F.sum("w") + 1)).alias(f"p_{k}") for k in KINDS],
            *[F.count(F.when(F.col("seed") == k, 1)).alias(f"n_{k}") for k in KINDS]))
        if i + 1 < rounds:
            back = edges.select("pat", "core", "w").join(pats, "pat").groupBy("core").agg(
                *[(F.sum(F.col("w") * F.col(f"p_{k}")) / F.sum("w")).alias(f"b_{k}") for k in KINDS])
            inst = stored(inst.join(back, "core").select("core", "seed", *[
                F.when(F.col("seed").isNull(), F.col(f"b_{k}")).otherwise(F.col(f"s_{k}")).alias(f"s_{k}") for k in KINDS]))
    return pats


def find_pii(docs: DataFrame, rounds: int = ROUNDS, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """doc_id, base, added (``array<struct<start, no, kind, end>>``): one row per row of ``docs (doc_id, text)``.

    Null texts are empty. A row is known by its id and a hash of its text, so rows that repeat an
    id with another text stay apart and equal rows give equal results. Tokens that touch a base
    entity are never added, nor are tokens that accepted patterns of two kinds claim (ties).
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id"), F.xxhash64(text).alias("row_hash"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    base = stored(rows.select("doc_id", "row_hash", "base"))
    occ = stored(_occurrences(rows.where(F.col("text").rlike("[0-9@]"))))
    pats = score_patterns(occ, rounds)
    good = pats.select("pat", F.explode(F.filter(F.array(*[
        F.when((F.col(f"p_{k}") >= min_score) & (F.col(f"n_{k}") >= min_seeds), F.struct(F.lit(n).alias("no"), F.lit(k).alias("kind")))
        for n, k in enumerate(KINDS)]), lambda x: x.isNotNull())).alias("g"))
    new = (occ.where("kind is null").select("doc_id", "row_hash", "start", "end", F.explode("pats").alias("pat")).join(good, "pat")
           .groupBy("doc_id", "row_hash", "start", "end").agg(F.min("g").alias("g"), F.max("g.no").alias("last"))
           .where("g.no = last")
           .groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_list(F.struct(
               F.col("start"), F.col("g.no").alias("no"), F.col("g.kind").alias("kind"), F.col("end")))).alias("added")))
    new = new.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "added")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row_hash") == F.col("_hash"))
    none = F.array().cast("array<struct<start:int,no:int,kind:string,end:int>>")
    return base.join(new, same, "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))
