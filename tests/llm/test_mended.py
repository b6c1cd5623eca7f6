"""Clashing names, repeated ids, licence gaps and SPDX expressions, the page scan."""

import time

import pytest
from pyspark.sql import functions as F

from hopvec.llm import lang_fusion, license_rules, line_join, simhash_golay
from hopvec.llm.common import documents, free_names
from hopvec.session import conf_override
from tests.llm.test_operators import make


def test_free_names(spark):
    df = make(spark, [(1, "a", 2, 3)], "doc_id bigint, text string, _Doc int, __doc int")
    assert free_names(df, "_doc", "_lines", "_lines") == ["___doc", "_lines", "__lines"]


def test_line_dedup_with_clashing_names(spark):
    line = "one line of words that comes twice"
    rows = [(1, line, "d", "h", "l", "r"), (2, f"x y\n{line}", "d", "h", "l", "r"), (None, None, None, None, None, None)]
    df = make(spark, rows, "doc_id bigint, text string, _doc string, _hash string, _lines string, _removed string")
    got = {r.doc_id: r for r in line_join.dedup_lines(df, min_words=1).collect()}
    assert got[2].text == "x y" and got[1].text == line and got[None].text is None
    assert [got[2][c] for c in ("_doc", "_hash", "_lines", "_removed", "__removed")] == ["d", "h", "l", "r", 1]


def test_keep_first_by_id_and_text(spark):
    a = "these are some words of a text that has several near copies in the table " * 3
    other = "nothing in common with any other of the rows given here, a text of its own"
    rows = [(7, a, 1), (5, a, 2), (5, other, 3), (5, a, 4), (None, a, 5), (None, "alone and without a name at all", 6), (9, None, 7), (8, "", 8)]
    df = make(spark, rows, "doc_id bigint, text string, _drop int").withColumn("_key", F.lit("k"))
    kept = simhash_golay.keep_first(df, simhash_golay.simhash_groups(documents(df)))
    assert kept.columns == df.columns
    assert sorted(r._drop for r in kept.collect()) == [2, 3, 4, 6, 8]
    assert simhash_golay.keep_first(df.limit(0), simhash_golay.simhash_groups(documents(df.limit(0)))).count() == 0


BSD3 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
3. Neither the name of {} nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


def test_licences_with_gaps_and_spdx(spark):
    cases = [(BSD3.format(x), ["BSD-3-Clause"]) for x in ("the copyright holder", "Example Inc.", "the University of Some Place, Ltd.")]
    cases += [
        ("# " + BSD3.format("the\nUniversity").replace("\n", "\n# "), ["BSD-3-Clause"]),
        ("The code is licensed under the MIT License.", ["MIT"]),
        ("It is not licensed under the MIT License.", []),
        ("This is free and unencumbered software released into the public domain.", ["Unlicense"]),
        ("Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
         "copyright notice and this permission notice appear in all copies.", ["ISC"]),
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
         "the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", ["LGPL-2.1-or-later"]),
        ("// SPDX-License-Identifier: GPL-2.0-only\nint x;", ["GPL-2.0-only"]),
        ("/* SPDX-License-Identifier: bsd-2-clause */", ["BSD-2-Clause"]),
        ("SPDX-License-Identifier: MIT OR Apache-2.0\r\nx", ["MIT", "Apache-2.0"]),
        ("SPDX-License-Identifier: (GPL-2.0-only WITH Classpath-exception-2.0) and (MIT or Zlib)", ["GPL-2.0-only", "MIT", "Zlib"]),
        ("The tag SPDX-License-Identifier: MIT is read by tools", []), ("SPDX-License-Identifier:", []), (None, []), ("", []),
    ]
    df = make(spark, [(i, t, "c") for i, (t, _) in enumerate(cases)] + [(0, cases[0][0], "c")], "doc_id bigint, text string, licences string")
    rows = license_rules.scan(df, license_rules.Rules(spark)).collect()
    got = {r.doc_id: sorted(r.licences) for r in rows}
    assert got == {i: sorted(want) for i, (_, want) in enumerate(cases)} and len(rows) == len(cases) + 1
    assert license_rules.scan(df.limit(0), license_rules.Rules(spark)).count() == 0
    long = make(spark, [(1, "Neither the name of " * 100_000), (2, "SPDX-License-Identifier: " + "MIT OR " * 100_000 + "MIT"), (3, "a " * 500_000 + "is licensed under")])
    assert [r.n_licences for r in license_rules.scan(long, license_rules.Rules(spark)).orderBy("doc_id").collect()] == [0, 1, 0]


@pytest.mark.parametrize("html,text,said", [
    ("", "", ""), ("plain &amp; simple", "plain & simple", ""),
    ('<html data-lang="fr" lang="en">x', "x", "en"), ('<!-- <html lang="fr"> --><html lang="en">x', "x", "en"),
    ("<html xml:lang=de-AT>x", "x", "de"), ('<html><meta content="sv" http-equiv="Content-Language">x', "x", "sv"),
    ("<html title='lang=fr'>x", "x", ""), ("<script>if (a < b) '<html lang=fr>'</script >x<style>y", "x y", ""),
    ("a<!-- b", "a <!-- b", ""), ("a<!-- b> c", "a c", ""), ("a <b c", "a <b c", ""), ("<HTML LANG = 'en-GB'>a<br/>b", "a b", "en"),
])
def test_page_parts(html, text, said):
    got, code = lang_fusion.page_parts(html)
    assert (" ".join(got.split()), code) == (text, said)


def test_page_scan_of_long_pages():
    start = time.time()
    for unit in ("<!--", "<script>", "<html", "<html lang", "<", "<a b='", "</script   ", "<style></script>", "&", "<meta \""):
        lang_fusion.page_parts(unit * (2_000_000 // len(unit)))
        lang_fusion.page_parts(unit * (2_000_000 // len(unit)) + ">")
    assert time.time() - start < 60


def test_pipeline_stages_keep_clashing_columns(spark):
    import corpus_pipeline
    sf = "/root/testdata/sf0.001"
    extra = ["_quality", "_quality_s", "_found", "_drop", "_key", "_doc", "_hash", "_lines", "_removed"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name in extra:
        docs = docs.withColumn(name, F.concat(F.lit(name), F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        wrong = [F.col(c) != F.concat(F.lit(c), F.col("doc_id")) for c in extra]
        assert out.count() > 0 and out.where(wrong[0] | wrong[1] | wrong[2] | wrong[3] | wrong[4] | wrong[5] | wrong[6] | wrong[7] | wrong[8]).count() == 0, name


def test_simhash_keys_are_never_broadcast(spark):
    """The planner takes the keys for a table of the fingerprints' size; all of them once went to the driver."""
    fps = simhash_golay.stored(spark.range(3000).select((F.xxhash64("id")).alias("fp")))
    with conf_override(spark, {"spark.sql.autoBroadcastJoinThreshold": "10485760"}):
        found = simhash_golay.links(fps)
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan, plan
