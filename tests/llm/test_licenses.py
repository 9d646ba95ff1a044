import random
import re
from itertools import product
from re import _constants as op, _parser

from cases import ROWS, frame, key

from marketlens.llm import licenses

TEXTS = ["apache license apache license. CC BY cc-by 4.0 MIT License x", "éapache license", "apache éé license", "İMIT license mit license",
         "Licensed under CC BY-NC 4.0. SPDX-License-Identifier: MIT", "This work is licensed under the GNU General Public License, version 3.",
         "cc by cc by cc\x00by", "the GNU Lesser General Public License v2.1", "mit license " * 600]


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_base_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(400).collect()
    rows = ROWS + [(100 + i, t, "en", "a", 1, None, None, None, None) for i, t in enumerate(TEXTS)]
    rows += [(1000 + r.doc_id, r.text, "en", "a", 1, None, None, None, None) for r in docs]
    got = licenses.scan(frame(spark, rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(((r[0], *base(r[1])) for r in rows), key=key)
    for r in got:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert licenses.scan(frame(spark, [])).count() == 0


def labels(spark, text):
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    return r.labels, [(d.start, d.end, d.label) for d in r.detections]


def test_contained_detections_are_suppressed(spark):
    got, found = labels(spark, "This is licensed under the Apache License, Version 2.0, and that under the Mozilla Public License 1.1.")
    assert got == "apache,apache-2,mpl-1.1"
    assert sorted(found) == [(2, 10, "apache-2"), (14, 19, "mpl-1.1")]


def test_priority_goes_before_length(spark):
    assert labels(spark, "GNU Lesser General Public License")[0] == "lgpl"
    assert labels(spark, "Creative Commons Attribution-NonCommercial-ShareAlike 4.0")[0] == "cc-by-nc-sa"
    assert labels(spark, "see http://creativecommons.org/licenses/by-nd/4.0/ there")[0] == "cc-by-nd"
    assert labels(spark, "SPDX-License-Identifier: BSD-3-Clause")[0] == "bsd-3-clause"
    assert labels(spark, "dedicated to the public domain; all rights reserved?")[0] == "proprietary,public-domain"


def test_texts_without_keywords_have_no_labels(spark):
    assert labels(spark, "A licence to fish, and the Apache people.") == ("", [])


def test_every_rule_compiles_and_is_gated_by_a_word_it_needs():
    table = licenses.rules()
    assert len(table) > 300 and [r.rank for r in table] == sorted(r.rank for r in table)
    for r in table:
        re.compile(r.pattern)
        assert r.pattern.startswith((" ", "(?: "))


def texts_of(pattern):
    """Texts that a pattern matches: each alternative, each character of a class, and repetitions as often as they must and once more."""
    def expand(node):
        kind, value = node
        if kind is op.LITERAL:
            return [chr(value)]
        if kind is op.NOT_LITERAL:
            return ["x"]
        if kind is op.IN:
            return [chr(v) if k is op.LITERAL else "7" for k, v in value]
        if kind is op.BRANCH:
            return [t for branch in value[1] for t in sequence(branch)]
        if kind is op.SUBPATTERN:
            return sequence(value[-1])
        assert kind is op.MAX_REPEAT, kind
        low, high, body = value
        return [t for n in {low, min(low + 1, high)} for t in ("".join(p) for p in product(sequence(body), repeat=n))]

    def sequence(nodes):
        return ["".join(p) for p in product(*[expand(n) for n in nodes])]

    return sequence(_parser.parse(pattern))


def test_every_text_of_a_rule_holds_its_keyword():
    for r in licenses.rules():
        for text in texts_of(r.pattern):
            assert re.fullmatch(r.pattern, text) and f" {r.keyword}" in text, (r, text)


def test_alternatives_need_no_word_of_another(spark):
    want = {"the GNU Library General Public License, version 2": "lgpl-2", "GNU Library General Public License": "lgpl",
            "Common Development and Distribution License 1.0": "cddl-1", "the FreeBSD license": "bsd-2-clause",
            "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software": "boost"}
    got = licenses.scan(spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")).collect()
    assert {list(want)[r.doc_id]: r.labels for r in got} == want


def by_hand(text):
    """Labels and score from the rules, with every detection compared with every other."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    norm = "".join(f" {w}" for w in words) + " "
    found = []
    for r in licenses.rules():
        if f" {r.keyword}" in norm:
            for m in re.finditer(f"{r.pattern}(?= )", norm):
                a, z = (norm[:x].count(" ") for x in m.span())
                found.append((a, z, r.rank, r.label, r.confidence))
    left = [x for x in found if not any(o[0] <= x[0] and o[1] >= x[1] and (o[2] < x[2] or o[2] == x[2] and o[1] - o[0] > x[1] - x[0]) for o in found)]
    base = {label for phrase, label in licenses.PHRASES.items() if f" {phrase} " in norm}
    doubt = 1.0
    for *_, confidence in left:
        doubt *= 1 - confidence
    return ",".join(sorted(base | {x[3] for x in left})), 1.0 if base else 1 - doubt


NAMED = {"GPLv3": "gpl-3", "LGPL 2.1": "lgpl-2.1", "AGPL": "agpl", "MPL 2.0": "mpl-2", "under Apache 2.0": "apache-2", "GNU GPL v3": "gpl-3",
         "the GPL version 2 or later": "gpl-2", "MIT licensed": "mit", "GPL-3.0-only": "gpl-3", "(EUPL)": "eupl", "CDDL v1.1": "cddl-1.1", "FreeBSD license": "bsd-2-clause"}


def test_labels_and_scores_match_brute_force(spark):
    rng = random.Random(9)
    parts = [*NAMED, "GNU General Public License, version 2", "all rights reserved", "Apache License", "licensed under the", "cc by-nc 4.0", "word", "and", "3.0",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "LGPL", "the terms of the GNU Lesser General Public License v3"]
    texts = [None, "", *NAMED, *[" ".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(150)], "all rights reserved " * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    small = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for df in (docs, small):
        text = {r.doc_id: r.text for r in df.collect()}
        for r in licenses.scan(df).collect():
            labels, score = by_hand(text[r.doc_id])
            assert r.labels == labels and abs(r.score - score) < 1e-9, text[r.doc_id][:200]


def test_short_references_with_versions(spark):
    got = licenses.scan(spark.createDataFrame(list(enumerate(NAMED)), "doc_id long, text string")).collect()
    assert {list(NAMED)[r.doc_id]: r.labels for r in got} == NAMED
    plain = ["The EPL season 2 begins.", "an isc file", "BSD units", "Apache helicopters, 3 of them", "one mit student", "3 gp lessons"]
    assert all(r.labels == "" for r in licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(plain[1:])], "doc_id long, text string")).collect())
