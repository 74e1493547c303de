"""Operator 6 against plain word scans and interval suppression."""
import re
import time
from re import _parser

import pytest
from .conftest import SF

from jobscope.llm import license_scan
from jobscope.llm.license_rules import rules
from jobscope.llm.queries import QUERIES

PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}


def plain_base(text):
    words = [w.lower() if w.isascii() else w for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    places = [(i, k) for k, p in PHRASES.items() for i in range(len(words)) if words[i:i + len(p)] == p]
    at = [i for i, _ in places]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in places}))


def check(rows, texts):
    for r in rows:
        first, last = (None if x is None or x != x else int(x) for x in (r["first_word"], r["last_word"]))
        assert (r["n_words"], r["n_base"], first, last, r["base_labels"]) == plain_base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_base_columns(spark, docs):
    check([r.asDict() for r in QUERIES["op6_license_scan"](spark, SF).collect()], dict(zip(docs.doc_id, docs.text)))


def test_rules_are_gated_by_what_every_match_holds():
    table = rules()
    assert len(table) > 200 and [r["rule"] for r in table] == list(range(len(table)))
    for r in table:
        assert r["stem"] in r["keyword"] or r["stem"] == "licen" and "licen" in r["pattern"]
        re.compile(r["pattern"])


def texts_of(parsed):
    """Texts that a parsed pattern matches, for every choice among its alternatives and optional parts."""
    texts = [""]
    for op, value in parsed:
        op = str(op)
        if op == "LITERAL":
            parts = [chr(value)]
        elif op == "IN":  # the class of blanks, or each member of a plain class
            names = [str(v) for o, v in value if str(o) == "CATEGORY"]
            parts = [" "] if "CATEGORY_SPACE" in names else ["1"] if "CATEGORY_DIGIT" in names else ["x"] if names or str(value[0][0]) == "NEGATE" \
                else [chr(v) for _, v in value]
        elif op in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            parts = ([""] if value[0] == 0 else []) + [x * max(value[0], 1) for x in texts_of(value[2])]
        elif op == "SUBPATTERN":
            parts = texts_of(value[3])
        elif op == "BRANCH":
            parts = [x for branch in value[1] for x in texts_of(branch)]
        else:
            parts = ["x" if op in ("ANY", "NOT_LITERAL") else ""]
        texts = [t + p for t in texts for p in parts]
    return texts


def test_every_rule_fires_on_every_form_of_its_pattern(spark):
    cases = [(r["rule"], t) for r in rules() for t in texts_of(_parser.parse(r["pattern"])) if re.search(r["pattern"], t)]
    assert {rule for rule, _ in cases} == {r["rule"] for r in rules()}
    cases += [(rule, f"see (https://{t.upper()}), x") for rule, t in cases if "creativecommons.org" in t]
    table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    fired = {(m.doc_id, m.rule) for m in license_scan.matches(table).select("doc_id", "rule").collect()}
    assert [case for i, case in enumerate(cases) if (i, case[0]) not in fired] == []


@pytest.mark.parametrize("text, labels", [
    ("https://creativecommons.org/licenses/by-nc-sa/4.0/", ["cc-by-nc-sa"]),
    ("http://creativecommons.org/publicdomain/zero/1.0/", ["cc0-1.0"]),
    ("the End-User License Agreement", ["proprietary"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["gpl", "gpl-3.0"]),
    ("under the GNU Lesser General Public License", ["gpl", "lgpl"]),
    ("Licensed under CC BY-NC 4.0.", ["cc-by-nc"]),
    ("Licensed under the Apache\n * License, Version 2.0.", ["apache", "apache-2.0"]),
    ("SPDX-License-Identifier: BSD-3-Clause", ["bsd-3-clause"]),
    ("see the mit licence and all rights reserved", ["all-rights-reserved", "mit"]),
    ("MIT licence or CC0 1.0 Universal", ["cc0-1.0", "mit"]),
    ("a permit license is no such thing", []),
])
def test_labels(spark, text, labels):
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = license_scan.scan_licenses(table).first()
    assert row.labels == labels
    for d in row.detections or []:  # intervals point into the text
        rule = rules()[d.rule]
        assert re.fullmatch(rule["pattern"], text[d.start:d.stop])


def test_suppression_equals_all_pairs(spark):
    text = "\n".join(["Released under the MIT License.", "GNU General Public License version 2 or the GNU GPL", "Copyright (c) 2020 x. All rights reserved",
                      "Licensed under the Apache License, Version 2.0", "BSD license", "Creative Commons Attribution-ShareAlike"] * 3)
    spots = []
    flat = re.sub(r"[\s/*#>]+", " ", text.lower())
    for r in rules():
        if r["keyword"] in flat:
            spots += [(m.start(), m.end(), r["priority"], r["rule"]) for m in re.finditer(r["pattern"], text)]
    left = [s for s in spots if not any(o != s and o[0] <= s[0] and s[1] <= o[1] and
                                        ((o[2] < s[2]) or (o[2] == s[2] and ((o[0], -o[1]) != (s[0], -s[1]) or o[3] < s[3]))) for o in spots)]
    got = license_scan.detections(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sorted((r.start, r.stop, r.priority, r.rule) for r in got) == sorted(left)


def test_edge_cases(edge, empty):
    got = license_scan.scan_licenses(edge).toPandas()
    assert len(got) == edge.count() and got[got.doc_id.isin([1, 2, 3])].score.eq(0).all()
    twice = got[got.doc_id == 9]
    assert len(twice) == 2 and all(list(x) == ["gpl", "gpl-3.0", "mit"] for x in twice.labels) and twice.n_base.eq(2).all()
    assert license_scan.scan_licenses(empty).count() == 0


def test_banners_are_passed_over_once(spark):
    """Behind a rule's keyword, and behind each part of a text that it matches, stand long runs of comment leaders."""
    banners = [c * 10_000 for c in "*/#> "] + ["*/" * 5_000, "* " * 5_000, "#\n" * 5_000]
    starts = {r["keyword"] + " " for r in rules()}
    for r in rules():
        words = max(texts_of(_parser.parse(r["pattern"])), key=len).split(" ")
        starts |= {" ".join(words[:k]) + " " for k in (len(words) // 2, len(words) - 1) if k > 0}
    starts |= {"This software is provided ", "provided " * 40, "Do What The F", "may not be reproduced, copied "}
    rows = [(i, start + banner + "/") for i, (start, banner) in enumerate((s, b) for s in sorted(starts) for b in banners)]
    t = time.time()
    # far more texts than a second each would allow
    license_scan.matches(spark.createDataFrame(rows, "doc_id long, text string").repartition(16)).count()
    assert len(rows) > 2000 and time.time() - t < 240


@pytest.mark.parametrize("text", ["provided to you on an \"as is\" basis", "Provided * by the\n * authors and/or others # \"AS IS\"", "provided \"as is\""])
def test_provided_as_is(spark, text):
    found = license_scan.matches(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert [r.label for r in found.where("label = 'disclaimer'").collect()] == ["disclaimer"]
