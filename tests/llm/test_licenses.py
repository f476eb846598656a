"""License scan: rules, base places, suppression, odd rows."""

from __future__ import annotations

import re

import pytest

from textloom.llm.license_rules import BASE, RULES, Rule, spread
from textloom.llm.licenses import license_scan

from .brute import lower
from .conftest import odd_rows, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def scan(spark, texts, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: r for r in license_scan(rows, **options).collect()}


def places(text):
    words, found = WORD.findall(lower(text)), []
    for label, phrase, _ in BASE:
        own = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(own)] == own]
    return words, sorted(found)


def plain(text, rules=RULES):
    """Matches that no other suppresses, pair by pair."""
    normal = re.sub(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "  ", f" {lower(text)} ")
    found = []
    for i, rule in enumerate(rules):
        for m in re.finditer(spread(rule.pattern), normal):
            found.append((normal[: m.start()].count(" ") // 2, normal[: m.end()].count(" ") // 2, i, rule))
    key = lambda m: (m[0] - m[1], m[3].priority, m[2])
    hidden = lambda m, o: o[0] <= m[0] and o[1] >= m[1] and o[3].priority <= m[3].priority and key(o) < key(m)
    return sorted((a, b, i, r.label) for a, b, i, r in found if not any(hidden((a, b, i, r), o) for o in found))


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); see http://www.apache.org/licenses/LICENSE-2.0",
    "SPDX-License-Identifier: GPL-2.0-or-later", "Released under the MIT License. MIT license, mit  LICENSE!", "cc by cc by cc-by-sa 4.0 CC BY-NC 4.0",
    "GNU General Public License version 3 or, either version 3 of the License, or (at your option) any later version",
    "the gnu lesser general public license version 2.1", "permit license submit license", "éMIT license", "mit licenseé", "mit\0license\x7fMIT_License",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided", "", None, "MIT", "license: isc",
    f"{prose(1, 3000)} under the terms of the GNU GPL {prose(2, 50)} apache license", "unlicense unlicense", "creativecommons.org/licenses/by-sa/4.0/legalcode",
]


def test_scan_equals_plain_python(spark):
    found = scan(spark, TEXTS)
    for i, text in enumerate(TEXTS):
        words, base = places(text)
        row = found[i]
        assert (row["n_words"], row["n_base"]) == (len(words), len(base)), text
        assert (row["first_word"], row["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert row["base_labels"] == ",".join(sorted({label for _, label in base}))
        want = plain(text)
        assert [tuple(d) for d in row["detections"]] == want, text
        assert row["labels"] == ",".join(sorted({label for _, label in base} | {m[3] for m in want}))
        assert row["score"] == max([RULES[m[2]].relevance for m in want], default=0.0)


def test_better_and_longer_matches_suppress_those_inside(spark):
    rules = [Rule("low", "b c", "b", 2, 0.1), Rule("long", "a b c d", "a", 1, 0.9), Rule("other", "c d e", "c", 1, 0.5), Rule("twin", "a b c d", "d", 1, 0.8), Rule("wide", "a b c d e", "e", 3, 0.2)]
    row = scan(spark, ["a b c d e", "b c"], rules=rules)
    # A long match of the worst priority suppresses nothing; equal intervals go to the earlier rule.
    assert [d["label"] for d in row[0]["detections"]] == ["long", "wide", "other"] and row[0]["score"] == 0.9
    assert [d["label"] for d in row[1]["detections"]] == ["low"]


def test_odd_repeated_and_no_rows(spark, odd, none):
    found = {r["doc_id"]: r for r in license_scan(odd).collect()}
    assert len(found) == len(odd_rows())
    assert all(found[i]["n_words"] == len(WORD.findall(lower(t))) for i, t, *_ in odd_rows())
    assert license_scan(none).count() == 0
    twice = spark.createDataFrame([(1, "mit license"), (1, "mit license"), (None, "cc by")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["n_base"]) for r in license_scan(twice).collect()) == [(0, 1), (1, 1), (1, 1)]


def test_a_text_of_very_many_matches(spark):
    row = scan(spark, ["mit license " * 20_000 + "apache license"])[0]
    assert (row["n_base"], row["first_word"], row["last_word"]) == (20_001, 0, 40_000) and row["labels"] == "apache,mit"


def test_rules_are_hundreds_and_hold_their_keywords():
    assert len(RULES) > 200 and [(r.label, r.pattern) for r in RULES[:4]] == [(label, phrase) for label, phrase, _ in BASE]
    for rule in RULES:
        fixed = re.sub(r"\(\?:[^()]*\)\?", "", rule.pattern)
        assert any(re.search(rf"(?<![a-z0-9]){word}(?![a-z0-9])", fixed) for word in rule.keywords.split()), rule
        re.compile(spread(rule.pattern))


@pytest.mark.parametrize("label", ["gpl-3.0", "cc-by-4.0", "mpl-2.0", "bsd-3-clause", "openrail-m", "lgpl-2.1"])
def test_each_rule_of_a_family_is_opened_by_its_keywords(label):
    import itertools

    def spelled(pattern):  # the texts a small pattern stands for
        pattern = pattern.replace("[cs]", "c").replace(" ?", "(?: )?")
        if not (m := re.search(r"\(\?:([^()]*)\)(\?)?", pattern)):
            return pattern.split("|")
        options = m[1].split("|") + ([""] if m[2] else [])
        return list(itertools.chain.from_iterable(spelled(pattern[: m.start()] + o + pattern[m.end() :]) for o in options))

    for rule in (r for r in RULES if r.label == label and len(r.pattern) < 90):
        for text in spelled(rule.pattern):
            words = " ".join(text.split())
            assert set(words.split()) & set(rule.keywords.split()), (rule, words)
            assert re.search(spread(rule.pattern), "  " + words.replace(" ", "  ") + "  "), (rule, words)
