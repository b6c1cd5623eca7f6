"""Licence recognition by sentence rules, with built-in functions only.

Texts are normalised (lower case, letters and digits; comment marks fall away) with marks where a
sentence ends or may end, known licence sentences between two such marks become identifiers, wrapped
or not, and the sequence of identifiers of a document is matched against ordered rules. The sentence
table is derived from the rule texts by the same expressions; ``GAP`` in one stands for any words (a holder, a
subject). SPDX tags are read by their own grammar: identifiers joined by AND, OR and WITH, in parentheses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence and a text that states it. Order is the order of matching.
RULES = [
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\nNeither the name of xgapx nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("LGPL-2.1-or-later", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("MIT", "xgapx is licensed under the MIT License."),
    ("MIT", "xgapx is released under the MIT License."),
    ("Apache-2.0", "xgapx is licensed under the Apache License, Version 2.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
]
# A sentence ends behind . ! ? or before Unless. A line break may end one, or may lie inside it, unless
# a lower-case letter begins the next line (a wrapped line) and no colon ends this one; SPDX tags end at
# any line break.
HARD_END = r"(?<=[.!?])\s++|(?<!\s)\s++(?=Unless\s)"
WRAP = r"(?<!:[\x20\t]{0,3})\n(?=[\x20\t]*+[a-z])"
RULE_END = HARD_END + r"|\n\s*+"       # the rule texts themselves have one sentence a line at most
TAG = "spdx license identifier "
GAP, GAP_WORDS = "xgapx", 12            # a place in a rule for 1 to 12 words of any kind
_ID = r"\(*[a-z0-9][a-z0-9.+-]*\)*"
SPDX = rf"(?im)spdx-license-identifier:[\x20\t]*+({_ID}(?:[\x20\t]++(?:and|or|with)[\x20\t]++{_ID})*+)(?=[^a-z0-9\n]*+$)"


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def marked(text: Column) -> Column:
    """Words of a text with what parts them: U+0001 (end of a sentence), line feed (perhaps one),
    carriage return (a wrapped line) or a blank. Marks of comments and lists are parted with."""
    t = F.regexp_replace(F.translate(text, "\x01\r", "  "), HARD_END, "\x01")
    t = F.regexp_replace(F.lower(F.regexp_replace(t, WRAP, "\r")), r"[^a-z0-9\n\r\x01]+", " ")
    return F.concat(F.lit("\n"), t, F.lit("\n"))


def known_pattern(known: list[str]) -> str:
    """Known sentences in a ``marked`` text, the longest first, from one end of a sentence to another."""
    end = r"(?=\x20?[\n\x01])"
    spaced = lambda s: s.strip().replace(" ", r"[\x20\n\r]++")
    # a holder may hold a full stop ("Example Inc."), so marks lie inside a gap; it ends before the next
    # fixed word, and no known sentence without a gap begins in it
    plain = "|".join(spaced(s) for s in known if GAP not in s and not s.startswith(TAG))
    begin = f"(?!(?:{plain}){end})" if plain else ""
    gap = begin + r"[a-z0-9]++(?:(?:[\x20\r]++(?![\n\x01])|[\x20\r]*+[\n\x01][\x20\n\r\x01]*+" + begin + r")[a-z0-9]++){0,%d}?" % (GAP_WORDS - 1)

    def one(s: str) -> str:
        if s.startswith(TAG):
            return s + r"(?=\x20?[\n\r\x01])"
        return _with_gaps([spaced(x) for x in s.split(GAP)], gap) + end
    return r"[\n\x01][\x20\r]{0,3}+(" + "|".join(one(s) for s in sorted(known, key=len, reverse=True)) + ")"


def _with_gaps(parts: list[str], gap: str) -> str:
    between = r"[\x20\n\r\x01]++"
    return (between + gap + between).join(parts) if parts[0] else gap + between + (between + gap + between).join(parts[1:])


class Rules:
    """Known sentences (number = place) and rules as sequences of their numbers."""

    def __init__(self, spark: SparkSession, rules: list[tuple[str, str]] | None = None):
        rules = RULES if rules is None else rules
        rows = spark.createDataFrame([(i, r[0], r[1]) for i, r in enumerate(rules)], "no int, licence string, text string")
        parts = rows.select("licence", F.filter(F.transform(F.split("text", RULE_END), _normal), lambda s: s != "").alias("s")).orderBy("no").collect()
        self.known = list(dict.fromkeys(s for r in parts for s in r["s"]))
        self.sequences = [(r["licence"], [self.known.index(s) for s in r["s"]]) for r in parts if r["s"]]


def _canonical(sentence: Column, known: list[str]) -> Column:
    """A found sentence with the words in its gap replaced by the gap's mark, as the table has it."""
    for s in known:
        if GAP in s.split(" "):
            before, after = (x.strip() for x in s.split(GAP))
            inside = F.lit(True)
            if before:
                inside = inside & sentence.startswith(before + " ")
            sentence = F.when(inside & sentence.endswith(" " + after), F.lit(s)).otherwise(sentence)
    return sentence


def spdx_identifiers(text: Column, licences: list[str]) -> Column:
    """Identifiers of all SPDX tags that take up the rest of their line, in order."""
    spelled = {x.lower(): x for x in licences}
    tags = F.regexp_extract_all(F.translate(text, "\r", "\n"), F.lit(SPDX), F.lit(1))
    plain = F.transform(tags, lambda t: F.regexp_replace(F.regexp_replace(t, r"(?i)\s+with\s+\S+", ""), "[()]", ""))
    ids = F.flatten(F.transform(plain, lambda t: F.split(t, r"(?i)\s+(?:and|or)\s+")))
    names = F.create_map(*[F.lit(x) for pair in spelled.items() for x in pair]) if spelled else F.create_map().cast("map<string,string>")
    return F.transform(ids, lambda i: F.coalesce(F.try_element_at(names, F.lower(i)), i))


def scan(docs: DataFrame, rules: Rules) -> DataFrame:
    """doc_id, sentence_ids, licences, n_licences: one row per row of ``docs (doc_id, text)``.

    Rules apply in order; each takes its runs of consecutive known sentences out of the sequence,
    so a sentence counts for one rule only. licences is in rule order, without repeats; then come the
    identifiers of SPDX tags (as the rules spell them, else as written; an exception after WITH is none).
    Null or empty texts have none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = F.regexp_extract_all(marked(text), F.lit(known_pattern(rules.known)), F.lit(1)) if rules.known else F.array().cast("array<string>")
    found = F.transform(found, lambda s: _canonical(_normal(s), rules.known))
    known = F.array(*[F.lit(s) for s in rules.known]).cast("array<string>")
    d = docs.select("doc_id", spdx_identifiers(text, [x for x, _ in rules.sequences]).alias("_spdx"), F.transform(found, lambda s: F.array_position(known, s).cast("int") - 1).alias("sentence_ids"))
    d = d.withColumn("_seq", F.when(F.size("sentence_ids") > 0, F.array_join(F.transform("sentence_ids", lambda i: F.concat(F.lit(","), i.cast("string"), F.lit(","))), "")))
    seq, hits = F.col("_seq"), []
    for licence, numbers in rules.sequences:
        run = "," + ",,".join(str(n) for n in numbers) + ","
        hits.append(F.when(seq.contains(run), F.lit(licence)))
        seq = F.replace(seq, F.lit(run), F.lit("|"))
    by_rule = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return d.select("doc_id", "sentence_ids", F.array_distinct(F.concat(by_rule, F.col("_spdx"))).alias("licences")).withColumn(
        "n_licences", F.size("licences"))
