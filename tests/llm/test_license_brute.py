"""Licence rules against a matcher that looks at one sentence after the other."""

import re

import numpy as np

from hopvec.llm import license_rules as R


def brute(sentences: list[str], rules: R.Rules) -> tuple[list[int], list[str]]:
    """Sentence numbers and licences: each sentence is looked up whole, each rule takes its runs out."""
    ids = []
    for s in sentences:
        s = " ".join(re.findall("[a-z0-9]+", s.lower()))
        for no, known in enumerate(rules.known):
            word = "[a-z0-9]+(?: [a-z0-9]+){0,%d}" % (R.GAP_WORDS - 1)
            if re.fullmatch(re.escape(known).replace(R.GAP, word), s):
                ids.append(no)
                break
    left, licences = list(ids), []
    for licence, run in rules.sequences:
        at, hit = 0, False
        while at + len(run) <= len(left):
            if left[at:at + len(run)] == run:
                left[at:at + len(run)] = [None]
                hit = True
            at += 1
        if hit and licence not in licences:
            licences.append(licence)
    return ids, licences


def test_license_rules_equal_the_brute_force(spark):
    rules, rng = R.Rules(spark), np.random.default_rng(17)
    known = [s for s in rules.known if not s.startswith(R.TAG)]
    runs = [[rules.known[k] for k in run] for _, run in rules.sequences if not rules.known[run[0]].startswith(R.TAG)]
    rows, want = [], {}
    for doc in range(250):
        sentences = []
        for _ in range(int(rng.integers(0, 6))):
            kind = rng.integers(0, 3)
            picked = [known[rng.integers(len(known))]] if kind == 0 else runs[rng.integers(len(runs))] if kind == 1 else [
                " ".join(f"noise{k}" for k in rng.integers(0, 50, rng.integers(1, 9)))]
            sentences += [s.replace(R.GAP, " ".join(f"holder{k}" for k in rng.integers(0, 9, rng.integers(1, 5)))) for s in picked]
        rows.append((doc, "\n".join(s[0].upper() + s[1:] + "." for s in sentences)))
        want[doc] = brute(sentences, rules)
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in R.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), rules).collect()}
    wrong = [(rows[d][1], got[d], want[d]) for d in want if got[d] != want[d]]
    assert not wrong, wrong[:3]
    assert sum(len(licences) > 1 for _, licences in want.values()) > 50


def test_a_subject_does_not_take_in_the_sentence_before(spark):
    rows = [(1, "Some words here. Released under the MIT License. The tool is licensed under the Apache License, Version 2.0."),
            (2, "Some words here\nReleased under the MIT License\nThe tool is licensed under the Apache License, Version 2.0\n"),
            (3, "Example Inc. is licensed under the MIT License.")]
    got = {r.doc_id: sorted(r.licences) for r in R.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), R.Rules(spark)).collect()}
    assert got == {1: ["Apache-2.0", "MIT"], 2: ["Apache-2.0", "MIT"], 3: ["MIT"]}
