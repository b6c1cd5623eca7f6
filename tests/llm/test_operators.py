"""The training-data operators against brute force on small fixtures, with nulls, empty and long
texts, ties, repeated rows, empty tables and extra columns of clashing names."""

import hashlib
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hopvec.llm import (decontam_lsi, lang_fusion, license_rules, line_join, pii_bootstrap, quality_fm, quality_rules, simhash_golay,
                        sentencepiece_bpe, warc)
from hopvec.llm.common import documents
from hopvec.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make(spark, rows, schema="doc_id bigint, text string"):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents and awkward rows; ``score`` and ``n_words`` clash with output names."""
    real = spark.read.parquet(f"{SF}/documents.parquet").limit(120).select("doc_id", "text").collect()
    odd = [(None, "a null id"), (9001, None), (9002, ""), (9003, " \t\n"), (9004, "one"), (9004, "one"), (9005, "ab " * 30_000),
           (9006, real[0]["text"]), (9007, "x" * 50_000), (9008, "Ünïcode ▁ \U0001F600 line\r\nnext")]
    rows = [(r["doc_id"], r["text"], 1.0, "z") for r in real] + [(i, t, 0.5, None) for i, t in odd]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score double, n_words string").cache()


def test_counts_and_base_rule(docs):
    got = quality_rules.quality_rules(documents(docs), []).collect()
    want = []
    for r in docs.collect():
        t = r["text"] or ""
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
        twice = {x for x in windows if windows.count(x) > 1} if len(w) < 3000 else set(windows)
        covered = {j for i, x in enumerate(windows) if x in twice for j in range(i, i + 8)}
        want.append((r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered),
                     len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(want, key=key)
    assert all(r.kept != r.base_failed for r in got)


def test_decision_list_learns_thresholds(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(quality_rules.FEATURES)))
    y = (x[:, quality_rules.FEATURES.index("bang_ratio")] > 0.8).astype(int)
    rules = quality_rules.learn(x, y)
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= quality_rules._covers(x, r)
    assert (hit == y).mean() > 0.95
    empty = make(spark, [])
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality_rules.fit_rules(empty, labels) == [] and quality_rules.quality_rules(empty, []).count() == 0


def test_factorisation_machine(spark, docs):
    m = quality_fm.Model()
    idx, val = quality_fm.features("some words and some more", 3)
    raw, _ = m.raw(np.array([0, len(idx)]), idx, val)
    pairs = sum(m.v[i] @ m.v[j] * a * b for k, (i, a) in enumerate(zip(idx, val)) for j, b in list(zip(idx, val))[k + 1:])
    assert math.isclose(raw[0], pairs, rel_tol=1e-9, abs_tol=1e-12)
    sf = "/root/testdata/sf0.01"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_fm.score(d, quality_fm.fit(d, labels)).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in out if r.quality == 1], [r.score for r in out if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    none = quality_fm.score(docs, quality_fm.fit(docs, labels.limit(0))).collect()
    assert len(none) == docs.count() and all(0 <= r.score <= 1 for r in none)


def simple_fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_simhash_groups(docs):
    rows = docs.where(F.length("text") < 5000).unionByName(docs.where("text is null"))
    got = simhash_golay.simhash_groups(documents(rows)).collect()
    assert len(got) == rows.count()
    prints = {(r.doc_id, simple_fingerprint(r.text)) for r in rows.collect()}
    assert {(r.doc_id, int(r.fingerprint, 16)) for r in got} == prints


def test_golay_links_lose_nothing(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base:
        for _ in range(12):
            fps.add(int(b) ^ sum({1 << int(k) for k in rng.integers(0, 64, rng.integers(1, 6))}))
    fps = sorted(fps)
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 3 and root(a) != root(b):
                parent[root(b)] = root(a)
    want = {}
    for f in fps:
        want.setdefault(root(f), set()).add(f)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    table = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    got = {}
    for r in components(simhash_golay.links(table, block=8)).collect():
        got.setdefault(r.root, set()).add(r.id % (1 << 64))
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7), (None, 3)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {98: 98, 99: 98, 100: 98}


PII = ("mail a@b.c_d@e.fg or x@y then 1.2.3.4.5.6.7.8 and 256.1.1.1 card 4111 1111 1111 1111, 4111-1111-1111-1112 "
       "tel +1 (984) 555-9848 +12 34 5 é +4915112345678.")


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def test_pii_base_and_bootstrap(spark, docs):
    rows = docs.select("doc_id", "text").union(make(spark, [(1, PII), (2, "9" * 40_000), (3, "a.b" * 20_000 + "@"), (4, "4 " * 20_000)]))
    got = sorted(((r.doc_id if r.doc_id is not None else -1, [(s["start"], s["no"], s["kind"], s["end"]) for s in r.base]) for r in pii_bootstrap.find_pii(rows).collect()), key=str)
    want = sorted(((r.doc_id if r.doc_id is not None else -1, base_spans(r.text or "")) for r in rows.collect()), key=str)
    assert got == want
    seeds = [(i, f"please call now +1 984 555-{1000 + i} today") for i in range(12)] + [(i, f"contact user{i}@mail.example.com now") for i in range(20, 32)]
    new = make(spark, [*seeds, (50, "contact user77@mailhost now"), (51, "nothing 12 here")])
    added = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.added] for r in pii_bootstrap.find_pii(new).collect()}
    assert added[51] == [] and all(k not in added or added[k] == [] for k in range(20, 32))
    assert pii_bootstrap.find_pii(make(spark, [])).count() == 0


def test_pii_finds_planted_identifiers_of_unseen_forms(spark):
    rows = [(i, f"contact user{i}@mail.example.com now") for i in range(20, 32)] + [(i, f"my number is +1984555{1000 + i} since then") for i in range(40, 52)]
    rows += [(60, "contact user77@mailhost now"), (61, "my number is 984/555-7777 since then"), (62, "page 12 of it"), (63, "contact room 12 now")]
    rows += [(70 + i, f"card 4111 1111 1111 1111 page 1111 of book {i}") for i in range(5)]
    added = {r.doc_id: [(s["kind"], s["start"], s["end"]) for s in r.added] for r in pii_bootstrap.find_pii(make(spark, rows)).collect()}
    assert added.pop(60) == [("email", 8, 23)] and added.pop(61) == [("phone", 13, 25)]
    assert not any(added.values())


def test_warc_round_trip(spark, tmp_path):
    evil = "text WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nrest"
    rows = [(5, "http://a/é", "same"), (2, None, "same"), (9, "u", None), (8, "u", ""), (3, "u", evil), (4, "u", evil + "é" * 9), (7, "u\r\nx", "\r\n\r\n"), (None, "u", "zz"), (6, "u", "  x")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, payload int")
    for per_file in (3, 1000):
        path = str(tmp_path / f"w{per_file}")
        warc.write_warc(warc.plan_records(pages), path, per_file)
        got = {r.page_id: r for r in warc.page_records(warc.read_warc(spark, path)).collect()}
        assert len(got) == len(rows)
        import base64
        for i, _, html in rows:
            raw = (html or "").encode()
            first = min((j for j, _, h in rows if (h or "").encode() == raw and j is not None), default=None)
            want = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first in (i, None) else "revisit", None if first in (i, None) else first)
            assert (got[i].payload_bytes, got[i].payload_digest, got[i].record_type, got[i].refers_to) == want
    empty = str(tmp_path / "none")
    warc.write_warc(warc.plan_records(pages.limit(0)), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_line_join_is_exact(spark):
    rng = np.random.default_rng(9)
    vocab = [f"w{i}" for i in range(400)]
    pool = [[vocab[int(k) ** 2 // 400] for k in rng.integers(0, 400, rng.integers(3, 40))] for _ in range(60)]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(int(rng.integers(1, 6))):
            line = list(pool[rng.integers(0, len(pool))])
            for _ in range(int(rng.integers(0, 5))):
                line[rng.integers(0, len(line))] = vocab[rng.integers(0, 400)]
            lines.append(" ".join(line).upper() if rng.random() < 0.2 else "\t".join(line))
        rows.append((d, "\n".join(lines)))
    rows += [(None, rows[3][1]), (500, None), (501, ""), (502, rows[5][1]), (502, rows[5][1]), (503, "\n\n")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, line string")
    got = sorted(((r.doc_id, r.text, r.line) for r in line_join.dedup_lines(df).collect()), key=str)
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    seen, kept = [], {}
    for d, text in order:
        keep = []
        for line in (text.split("\n") if text is not None else []):
            w = frozenset(WORD.findall(line.lower()))
            hit = len(w) >= 5 and any(9 * len(w & v) >= 4 * (len(w) + len(v)) for v in seen)
            if len(w) >= 5:
                seen.append(w)
            if not hit:
                keep.append(line)
        kept[d, text] = None if text is None else "\n".join(keep)
    assert got == sorted(((d, kept[d, t], "k") for d, t in rows), key=str)
    assert line_join.dedup_lines(df.limit(0)).count() == 0


def test_line_join_of_short_lines(spark):
    rows = [(1, "a b\n}\n \n\none two three four\nx"), (2, "}\nB  A b\n \n\none two three five\na b c"), (3, "five four three two one\nfour three two ONE\nx y\nx")]
    got = {r.doc_id: (r.text, r._removed) for r in line_join.dedup_lines(make(spark, rows), min_words=1).collect()}
    assert got == {1: (rows[0][1], 0), 2: (" \n\none two three five\na b c", 2), 3: ("x y", 3)}
    rng = np.random.default_rng(3)
    rows = [(d, "\n".join(" ".join(f"w{k}" for k in rng.integers(0, 9, rng.integers(0, 7))) for _ in range(8))) for d in range(60)]
    seen, want = set(), {}
    for d, text in rows:
        keep = []
        for line in text.split("\n"):
            w = frozenset(WORD.findall(line))
            if not any(9 * len(w & v) >= 4 * (len(w) + len(v)) for v in seen if w):
                keep.append(line)
            seen.add(w)
        want[d] = "\n".join(keep)
    assert {r.doc_id: r.text for r in line_join.dedup_lines(make(spark, rows), min_words=1).collect()} == want


def test_decontamination(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text")
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    items = [(r.item_id, " ".join(r.text.split())) for r in bench.collect()]
    want = {d.doc_id: {i for i, t in items if t in " ".join(d.text.split())} for d in docs.collect()}
    extra = docs.union(make(spark, [(None, items[0][1]), (9001, None), (9002, ""), (9003, "word")]))
    finders = decontam_lsi.fit(extra, bench.union(make(spark, [(None, "x"), (900, None), (901, "two words")])))
    got = {r.doc_id: set(r.item_ids) for r in decontam_lsi.contaminated(extra, finders).collect()}
    assert got.pop(None) == {items[0][0]}
    assert got == {d: i for d, i in want.items() if i}
    assert decontam_lsi.contaminated(docs, decontam_lsi.fit(docs, bench.limit(0))).count() == 0


def test_decontamination_finds_passages_of_a_full_block(spark):
    rng = np.random.default_rng(4)
    shared = [f"form{i}" for i in range(6)]
    items = [(i, " ".join(f"u{i}x{k}" for k in range(20))) for i in range(190)]
    items += [(i, " ".join(rng.permutation([*shared, *(f"u{i}x{k}" for k in range(12))]))) for i in range(190, 250)]
    filler = [" ".join(f"f{k}" for k in rng.integers(0, 3000, 50)) for _ in items]
    docs = make(spark, [(i, f"{f[:int(rng.integers(0, 60))]} {t} {f}") for (i, t), f in zip(items, filler)] + [(900, filler[0])])
    got = sorted((r.doc_id, r.item_ids) for r in decontam_lsi.contaminated(docs, decontam_lsi.fit(docs, make(spark, items, "item_id bigint, text string"))).collect())
    assert got == [(i, [i]) for i, _ in items]


def test_decontamination_of_short_items_at_all_offsets():
    rng = np.random.default_rng(6)
    items = [[f"c{k}" for k in rng.integers(0, 300, n)] for n in range(5, 13) for _ in range(12)]
    idf = np.full(decontam_lsi.BUCKETS, 6.0)          # words of the texts are rarer than those of the items
    idf[decontam_lsi.buckets(decontam_lsi.tokenize([" ".join(f"c{k}" for k in range(300))])[0])] = 2.0
    tokens = [decontam_lsi.tokenize([" ".join(i)])[0] for i in items]
    finder = decontam_lsi.Finder([decontam_lsi.fit_block(list(range(len(items))), tokens, [t[-8:] for t in tokens], idf, 256)], idf)
    for offset in range(17):
        for drop in (0, 1):       # a copy, and one word in the middle replaced where the shares allow it
            texts, want = [], []
            for i, item in enumerate(items):
                gone = drop and len(item) > 5
                text = [w if not (gone and k == len(item) // 2) else "other" for k, w in enumerate(item)]
                texts.append(" ".join([f"r{i}x{k}" for k in range(offset)] + text + [f"r{i}y{k}" for k in range(20)]))
                want.append(i)
            found = finder.find(texts)
            assert all(w in {x for x, _, _ in f} for w, f in zip(want, found)), (offset, drop)
            assert all(0 < c <= 1.000001 for f in found for _, c, _ in f)
    assert finder.find([" ".join(f"r{k}" for k in range(50)), ""]) == [[], []]


def test_randomised_svd_and_lcs():
    a = np.random.default_rng(1).normal(size=(30, 12)) @ np.random.default_rng(2).normal(size=(12, 80))
    v = decontam_lsi.randomised_svd(a, 12)
    assert np.allclose(a @ v @ v.T, a, atol=1e-8)
    m = decontam_lsi.masks_of([1, 2, 3, 2, 5])
    assert decontam_lsi.lcs(m, 5, [2, 3, 9, 5]) == 3 and decontam_lsi.lcs(m, 5, []) == 0


def test_language_fusion(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = lang_fusion.fit_text_model(docs)
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    declared = {r.page_id: re.search(r"/(en|de|fr|es)/", r.url) for r in pages.collect()}
    got = {r.page_id: r for r in lang_fusion.identify(pages, model).collect()}
    known = [(i, m[1]) for i, m in declared.items() if m]
    assert np.mean([got[i].lang == lang for i, lang in known]) > 0.95
    odd = spark.createDataFrame([(1, None, None), (None, "http://x.de/", ""), (2, "no url", "<html lang=de>")], "page_id bigint, url string, html string")
    out = lang_fusion.identify(pages.union(odd), model).collect()
    assert len(out) == pages.count() + 3 and all(r.lang in model.langs for r in out)
    none = lang_fusion.identify(odd, lang_fusion.fit_text_model(docs.limit(0))).collect()
    assert [r.lang for r in none] == [None] * 3


def test_sentencepiece_against_the_library(spark, docs):
    import public_tokenizers
    import sentencepiece
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sentencepiece_bpe.encode_decode(documents(docs), sentencepiece_bpe.read_model(path)).collect()
    want = []
    for r in documents(docs).collect():
        p = sp.encode(r.text, return_type="proto")
        want.append((r.doc_id, sp.encode(r.text, add_eos=True), [x.end for x in p.pieces] + [len(r.text.encode())], sp.decode(sp.encode(r.text, add_eos=True))))
    assert sorted(((r.doc_id, r.ids, r.ends, r.decoded) for r in got), key=str) == sorted(want, key=str)
    m = sentencepiece_bpe.Model(sentencepiece_bpe.read_model(path))
    word = "internationalisation" * 5
    assert m._scan(word) == m._heap(word)


def test_character_map_longest_prefix():
    import sentencepiece
    n = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    spec = next(v for f, v in sentencepiece_bpe._fields(n.serialized_model_proto()) if f == 3)
    cmap = sentencepiece_bpe.CharMap(dict(sentencepiece_bpe._fields(spec))[2])
    for text in ("ﬁ ①½", "ｶﾞ", "Àb", "plain"):
        raw, out, i = text.encode(), b"", 0
        while i < len(raw):
            hit = cmap.longest(raw, i)
            if hit is None:
                k = 1 + (raw[i] >= 0xC0) + (raw[i] >= 0xE0) + (raw[i] >= 0xF0)
                hit = k, raw[i:i + k]
            out += hit[1]
            i += hit[0]
        import unicodedata
        assert out.decode() == unicodedata.normalize("NFKC", text)


def test_license_rules(spark):
    rules = license_rules.Rules(spark)
    apache = license_rules.RULES[1][1]
    rows = [(1, "Intro.\nReleased under the MIT License.\nMore. Licensed under CC BY-NC 4.0."), (2, apache.replace("compliance with", "compliance\nwith")),
            (3, None), (4, ""), (5, "This work is licensed under the GNU General Public License,\nversion 3."), (6, "license license"), (1, "SPDX-License-Identifier: MIT\nx")]
    got = sorted((r.doc_id, tuple(r.licences)) for r in license_rules.scan(make(spark, rows), rules).collect())
    assert got == [(1, ("MIT",)), (1, ("MIT", "CC-BY-NC-4.0")), (2, ("Apache-2.0",)), (3, ()), (4, ()), (5, ("GPL-3.0",)), (6, ())]


GNU = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""


def test_license_notices_as_published(spark):
    gnu2 = GNU.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
    notices = [(GNU, "GPL-3.0-or-later"), (gnu2, "GPL-2.0-or-later"), (APACHE, "Apache-2.0"), (MIT, "MIT"), (BSD, "BSD-2-Clause")]
    forms = {"plain": "", "hash": "# ", "slash": "// ", "star": " * ", "dash": "-- ", "semicolon": ";; ", "dnl": "      "}
    rows, want = [], {}
    for n, (text, licence) in enumerate(notices):
        for k, mark in enumerate(forms.values()):
            body = "\n".join((mark + line).rstrip() for line in text.split("\n"))
            body = f"/*\n{body}\n */\nint x;" if mark == " * " else f"Some title\n{body}\nimport x"
            rows += [(100 * n + k, body), (100 * n + k + 50, body.replace("\n", "\r\n"))]
            want[100 * n + k] = want[100 * n + k + 50] = [licence]
    rows += [(900, "This is not\nlicensed under the MIT License."), (901, "// SPDX-License-Identifier: MIT\npackage main"), (902, "A title\nLicensed under the MIT License\n\nsee there"), (903, "=" * 50_000 + "\n" * 50_000 + " " * 50_000)]
    want |= {900: [], 901: ["MIT"], 902: ["MIT"], 903: []}
    got = {r.doc_id: r.licences for r in license_rules.scan(make(spark, rows), license_rules.Rules(spark)).collect()}
    assert got == want
    full = license_rules.scan(make(spark, [(1, "\n".join("# " + x for x in APACHE.split("\n")))]), license_rules.Rules(spark)).first()
    assert len(full.sentence_ids) == 3


def test_pipeline_stages(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    docs = docs.union(docs.limit(1).selectExpr("cast(null as bigint)", "text", "lang", "source", "n_chars", "extra"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count(), name
        assert stage(spark, docs.limit(0), SF).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()
