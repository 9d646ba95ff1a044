"""Licence scans by ordered signature rules.

A rule is a regular expression over the normalised words of a text (A-Z lower-cased, one
space before each word and one at the end), with a keyword that must occur, a label, a
confidence and a place in the order.  The keywords of all rules are looked for first; only
the rules of keywords that occur are run.  A detection that lies within the words of a
detection of an earlier rule is suppressed, as is one within a longer detection of the same rank.

Everything happens within the row: no shuffle, no Python.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import ascii_lower, let, match_places, text_of
from marketlens.llm.common import scan as sweep

#: Characters that separate words here: ASCII except digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed values of the base search.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


class Rule(NamedTuple):
    """A signature.  ``pattern`` sees words as `` word``; ``rank`` 0 goes first.

    Every text that ``pattern`` matches has a word that starts with ``keyword``: a pattern
    whose alternatives share no such word is several rules.
    """

    label: str
    keyword: str
    pattern: str
    rank: int
    confidence: float


#: Licence families: label, keyword, name as written in running text, versions.
FAMILIES = [
    ("agpl", "affero", "(?: gnu)? affero general public licen[sc]e", ("1", "3")),
    ("lgpl", "lesser", "(?: gnu)? lesser general public licen[sc]e", ("2", "2 1", "3")),
    ("lgpl", "library", "(?: gnu)? library general public licen[sc]e", ("2", "2 1", "3")),
    ("gfdl", "documentation", "(?: gnu)? free documentation licen[sc]e", ("1 1", "1 2", "1 3")),
    ("gpl", "general", "(?: gnu)? general public licen[sc]e", ("1", "2", "3")),
    ("apache", "apache", " apache(?: software)? licen[sc]e", ("1", "1 1", "2")),
    ("mpl", "mozilla", " mozilla public licen[sc]e", ("1", "1 1", "2")),
    ("epl", "eclipse", " eclipse public licen[sc]e", ("1", "2")),
    ("edl", "eclipse", " eclipse distribution licen[sc]e", ("1",)),
    ("cddl", "cddl", " cddl", ("1", "1 1")),
    ("cddl", "development", " common development and distribution licen[sc]e", ("1", "1 1")),
    ("cpl", "common", " common public licen[sc]e", ("1",)),
    ("cpal", "attribution", " common public attribution licen[sc]e", ("1",)),
    ("osl", "open", " open software licen[sc]e", ("1", "2", "3")),
    ("afl", "academic", " academic free licen[sc]e", ("1 2", "2", "2 1", "3")),
    ("eupl", "european", " european union public licen[sc]e", ("1", "1 1", "1 2")),
    ("artistic", "artistic", "(?: perl)? artistic licen[sc]e", ("1", "2")),
    ("boost", "boost", " boost software licen[sc]e", ("1",)),
    ("python", "python", " python(?: software foundation)? licen[sc]e", ("2",)),
    ("php", "php", " php licen[sc]e", ("3", "3 01")),
    ("zope", "zope", " zope public licen[sc]e", ("1 1", "2", "2 1")),
    ("ms-pl", "microsoft", " microsoft public licen[sc]e", ("1",)),
    ("ms-rl", "microsoft", " microsoft reciprocal licen[sc]e", ("1",)),
    ("odbl", "database", " open(?: data commons open)? database licen[sc]e", ("1",)),
    ("odc-by", "commons", " open data commons attribution licen[sc]e", ("1",)),
    ("ofl", "font", "(?: sil)? open font licen[sc]e", ("1", "1 1")),
    ("lppl", "latex", " latex project public licen[sc]e", ("1", "1 1", "1 2", "1 3")),
    ("qpl", "public", " q public licen[sc]e", ("1",)),
    ("sspl", "server", " server side public licen[sc]e", ("1",)),
    ("bsl", "business", " business source licen[sc]e", ("1", "1 1")),
    ("elastic", "elastic", " elastic licen[sc]e", ("1", "2")),
    ("w3c", "w3c", " w3c software(?: notice and)? licen[sc]e", ("1",)),
    ("cecill", "cecill", " cecill(?: free software licen[sc]e)?", ("1", "2", "2 1")),
    ("mulan", "mulan", " mulan permissive software licen[sc]e", ("1", "2")),
    ("upl", "universal", " universal permissive licen[sc]e", ("1",)),
    ("mit", "mit", " mit licen[sc]e", ()),
    ("isc", "isc", " isc licen[sc]e", ()),
    ("zlib", "zlib", " zlib(?: libpng)? licen[sc]e", ()),
    ("openssl", "openssl", " openssl licen[sc]e", ()),
    ("curl", "curl", " curl licen[sc]e", ()),
    ("x11", "x11", " x11 licen[sc]e", ()),
    ("ncsa", "ncsa", "(?: university of illinois)? ncsa(?: open source)? licen[sc]e", ()),
    ("postgresql", "postgresql", " postgresql licen[sc]e", ()),
    ("unlicense", "unlicense", " (?:the )?unlicense", ()),
    ("wtfpl", "wtfpl", " wtfpl", ()),
    ("beerware", "beerware", " beerware licen[sc]e", ()),
    ("ruby", "ruby", " ruby licen[sc]e", ()),
    ("vim", "vim", " vim licen[sc]e", ()),
    ("bsd-2-clause", "bsd", " (?:bsd 2 clause|2 clause bsd|simplified bsd)(?: licen[sc]e)?", ()),
    ("bsd-2-clause", "freebsd", " freebsd(?: licen[sc]e)?", ()),
    ("bsd-3-clause", "bsd", " (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[sc]e)?", ()),
    ("bsd-4-clause", "bsd", " (?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?", ()),
    ("bsd", "bsd", " bsd licen[sc]e", ()),
]

#: Creative Commons terms: label, short form, written-out form.
COMMONS = [
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?(?: works)?"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by", "by", "attribution"),
]

#: Sentences of licence texts and notices: label, keyword, pattern, confidence.
SENTENCES = [
    ("mit", "permission", " permission is hereby granted free of charge to any person obtaining a copy of this software", 1.0),
    ("isc", "permission", " permission to use copy modify and or distribute this software for any purpose with or without fee", 1.0),
    ("bsd", "redistribution", " redistribution and use in source and binary forms with or without modification", 0.9),
    ("bsd-3-clause", "endorse", " neither the name of(?: [^ ]+){1,12} may be used to endorse or promote products", 0.95),
    ("bsd-4-clause", "advertising", " all advertising materials mentioning features or use of this software", 0.95),
    ("zlib", "altered", " altered source versions must be plainly marked as such", 0.95),
    ("boost", "organization", " permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 0.95),
    ("gpl", "redistribute", " you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e", 1.0),
    ("lgpl", "redistribute", " you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e", 1.0),
    ("agpl", "redistribute", " you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e", 1.0),
    ("mpl", "mozilla", " this source code form is subject to the terms of the mozilla public licen[sc]e", 1.0),
    ("apache", "compliance", " you may not use this file except in compliance with the licen[sc]e", 0.9),
    ("unlicense", "unencumbered", " this is free and unencumbered software released into the public domain", 1.0),
    ("wtfpl", "fuck", " do what the fuck you want to public licen[sc]e", 1.0),
    ("cc0", "cc0", " cc0(?: 1 0)?(?: universal)?", 0.95),
    ("cc0", "waived", " waived all copyright and related or neighboring rights", 0.95),
    ("public-domain", "domain", " (?:is|are|released|placed|dedicated|put)(?: [^ ]+){0,3} (?:in|into|to) the public domain", 0.8),
    ("proprietary", "rights", " all rights reserved", 0.5),
    ("proprietary", "proprietary", " proprietary and confidential", 0.8),
    ("proprietary", "unauthorized", " unauthorized (?:copying|reproduction|distribution|use) of this (?:file|document|software|work)", 0.8),
]

#: Short references: label, keyword, name, versions, and whether the name alone says enough.
SHORT = [
    ("agpl", "agpl", "(?: gnu)? agpl", ("1", "3"), True),
    ("lgpl", "lgpl", "(?: gnu)? lgpl", ("2", "2 1", "3"), True),
    ("gpl", "gpl", "(?: gnu)? gpl", ("1", "2", "3"), True),
    ("gfdl", "gfdl", "(?: gnu)? gfdl", ("1 1", "1 2", "1 3"), True),
    ("gfdl", "fdl", " gnu fdl", ("1 1", "1 2", "1 3"), True),
    ("apache", "apache", " apache", ("1 1", "2"), False),
    ("apache", "asl", " asl", ("1 1", "2"), False),
    ("mpl", "mpl", " mpl", ("1", "1 1", "2"), False),
    ("epl", "epl", " epl", ("1", "2"), False),
    ("cddl", "cddl", " cddl", ("1", "1 1"), True),
    ("cpl", "cpl", " cpl", ("1",), False),
    ("osl", "osl", " osl", ("2", "2 1", "3"), False),
    ("afl", "afl", " afl", ("1 2", "2", "2 1", "3"), False),
    ("eupl", "eupl", " eupl", ("1", "1 1", "1 2"), True),
    ("ofl", "ofl", "(?: sil)? ofl", ("1", "1 1"), False),
    ("boost", "bsl", " bsl", ("1",), False),
    ("boost", "boost", " boost licen[sc]e", ("1",), True),
    ("odbl", "odbl", " odbl", ("1",), True),
    ("lppl", "lppl", " lppl", ("1", "1 1", "1 2", "1 3"), True),
    ("zope", "zpl", " zpl", ("1 1", "2", "2 1"), False),
    ("sspl", "sspl", " sspl", ("1",), True),
    ("python", "psf", " psf(?: licen[sc]e)?", ("2",), False),
    ("python", "psfl", " psfl", ("2",), True),
    ("ms-pl", "ms", " ms pl", (), True),
    ("ms-rl", "ms", " ms rl", (), True),
    ("mit", "mit", " mit licen[sc]ed", (), True),
    ("mit", "expat", " expat licen[sc]e", (), True),
    ("isc", "isc", " isc licen[sc]ed", (), True),
    ("bsd", "bsd", " bsd licen[sc]ed", (), True),
    ("bsd", "bsd", " bsd style licen[sc]e", (), True),
    ("bsd-2-clause", "bsd", " bsd 2", (), True),
    ("bsd-3-clause", "bsd", " bsd 3", (), True),
    ("unlicense", "unlicen", " unlicen[sc]ed into the public domain", (), True),
]

#: Further sentences of licence texts and notices: label, keyword, pattern, confidence.
NOTICES = [
    ("apache", "agreed", " unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis", 0.95),
    ("apache", "limitations", " see the licen[sc]e for the specific language governing permissions and limitations under the licen[sc]e", 0.9),
    ("apache", "contributor", " licen[sc]ed to the apache software foundation(?: asf)? under one or more contributor licen[sc]e agreements", 1.0),
    ("gpl", "merchantability", " without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[sc]e", 1.0),
    ("lgpl", "merchantability", " without even the implied warranty of merchantability or fitness for a particular purpose see the gnu (?:lesser|library) general public licen[sc]e", 1.0),
    ("agpl", "merchantability", " without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public licen[sc]e", 1.0),
    ("gpl", "received", " you should have received a copy of the gnu general public licen[sc]e", 1.0),
    ("lgpl", "received", " you should have received a copy of the gnu (?:lesser|library) general public licen[sc]e", 1.0),
    ("agpl", "received", " you should have received a copy of the gnu affero general public licen[sc]e", 1.0),
    ("gfdl", "invariant", " with no invariant sections", 0.9),
    ("gfdl", "copy", " permission is granted to copy distribute and or modify this document", 0.9),
    ("mpl", "obtain", " if a copy of the mpl was not distributed with this file you can obtain one at", 1.0),
    ("mpl", "incompatible", " this source code form is incompatible with secondary licenses", 1.0),
    ("epl", "accompanying", " this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e", 1.0),
    ("cddl", "development", " the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 1.0),
    ("mit", "substantial", " the above copyright notice and this permission notice shall be included in all copies or substantial portions", 0.95),
    ("mit", "restriction", " to deal in the software without restriction", 0.8),
    ("isc", "disclaims", " the author disclaims all warranties with regard to this software", 0.9),
    ("bsd", "redistributions", " redistributions of source code must retain the above copyright notice", 0.9),
    ("bsd", "reproduce", " redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("bsd-4-clause", "acknowledgement", " must display the following acknowledgement", 0.7),
    ("zlib", "misrepresented", " the origin of this software must not be misrepresented", 0.95),
    ("zlib", "liable", " in no event will the authors be held liable for any damages arising from the use of this software", 0.9),
    ("artistic", "artistic", " the copyright holder maintains some semblance of artistic control", 0.9),
    ("ofl", "reserved", " with reserved font name", 0.95),
    ("ofl", "sold", " the font software may not be sold by itself", 0.9),
    ("unlicense", "compile", " anyone is free to copy modify publish use compile sell or distribute this software", 1.0),
    ("beerware", "beer", " you can buy me a beer in return", 0.95),
    ("cc0", "dedicated", " has dedicated the work to the public domain by waiving", 0.95),
    ("public-domain", "copyright", " no copyright is claimed", 0.6),
    ("public-domain", "government", " work of the (?:united states|u s) government", 0.7),
    ("open-government", "government", " open government licen[sc]e", 0.95),
    ("open-government", "crown", " crown copyright", 0.6),
    ("creative-commons", "commons", " licen[sc]ed under a creative commons", 0.8),
    ("odc-pddl", "dedication", " public domain dedication and licen[sc]e", 0.9),
    ("proprietary", "trade", " trade secrets? of", 0.6),
    ("proprietary", "reproduced", " no part of this (?:publication|document|book|work) may be reproduced", 0.8),
    ("proprietary", "internal", " for internal use only", 0.7),
    ("proprietary", "materials", " licen[sc]ed materials property of", 0.9),
    ("proprietary", "eula", " eula", 0.6),
    ("proprietary", "end", " end user licen[sc]e agreement", 0.7),
    ("proprietary", "written", " without (?:the )?(?:prior )?(?:express )?written (?:permission|consent) of", 0.5),
    ("proprietary", "without", " (?:may|must|shall) not (?:be )?(?:copy|copied|reproduced?|disclosed?|distributed?) (?:or [^ ]+ )?without", 0.6),
    ("non-commercial", "non", " (?:for|free for) non ?commercial use only", 0.8),
    ("non-commercial", "academic", " free for academic use", 0.7),
    ("non-commercial", "personal", " (?:free )?for personal use only", 0.7),
    ("freeware", "freeware", " (?:is|as) freeware", 0.7),
    ("shareware", "shareware", " (?:is|as) shareware", 0.7),
    ("dual", "dual", " dual licen[sc]ed", 0.6),
]

#: Name, label and confidence of the ways in which a text names a family; {name} is the family's pattern.
FORMS = [
    (" (?:licen[sc]ed|released|distributed|available|published|covered|provided) (?:under|by)(?: the)?(?: terms of)?(?: the)?{name}", 1, 1.0),
    (" under the terms(?: and conditions)? of the{name}", 1, 1.0),
    (" spdx licen[sc]e identifier{tag}", 0, 1.0),
    ("{name}", 4, 0.8),
]


def rules() -> list[Rule]:
    """All signatures, from the tables above, in order: the lower rank goes first."""
    found = []
    for label, keyword, name, versions in FAMILIES:
        for form, rank, confidence in FORMS:
            tag = " " + label.replace("-", " ")
            pattern = form.format(name=name, tag=tag)
            rule = Rule(label, "spdx" if "{tag}" in form else keyword, pattern, rank + 1, confidence)
            if rule not in found:  # the names of a label share its tag
                found.append(rule)
            if "{name}" in form:
                for v in versions:
                    numbers = f"(?: version| v)? v?{v}" + ("(?: 0)?" if " " not in v else "")
                    found.append(Rule(f"{label}-{v.replace(' ', '.')}", keyword, f"{pattern}{numbers}", rank, min(confidence + 0.1, 1.0)))
    for rank, (label, short, long) in enumerate(COMMONS):
        found.append(Rule(label, "cc", f" cc {short}(?: \\d \\d)?", rank, 0.95))
        found.append(Rule(label, "commons", f" creative commons {long}(?: \\d \\d)?", rank, 1.0))
        found.append(Rule(label, "creativecommons", f" creativecommons org licenses {short}(?: \\d \\d)?", rank, 1.0))
    for label, keyword, name, versions, alone in SHORT:
        for v in versions:
            # GPLv3, GPL v3, GPL 3.0, GPL version 3
            found.append(Rule(f"{label}-{v.replace(' ', '.')}", keyword, f"{name}(?: version| v)? ?v?{v}" + ("(?: 0)?" if " " not in v else ""), 5, 0.8))
        if alone:
            found.append(Rule(label, keyword, name, 6, 0.7))
    found += [Rule(label, keyword, pattern, 1, confidence) for label, keyword, pattern, confidence in SENTENCES + NOTICES]
    return sorted(found, key=lambda r: r.rank)


def spaces(x: Column) -> Column:
    return F.char_length(x) - F.char_length(F.replace(x, F.lit(" "), F.lit("")))


def words_text(text: Column) -> Column:
    """The words, each with a space before it, and a space at the end; a single space if there are none."""
    words = F.btrim(F.regexp_replace(ascii_lower(text), BREAK, " "))
    return F.when(words == "", " ").otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def base_places(norm: Column, phrase: str, label: str) -> Column:
    """Label, number of places of a phrase, and the first and last word where it starts (null if none)."""
    first, *rest = phrase.split(" ")
    # only the first word is consumed, so places may overlap
    pieces = F.split(norm, f" {first}(?= {' '.join(rest)} )" if rest else f" {first}(?= )", -1)
    return let(pieces, lambda p: F.struct(
        F.lit(label).alias("label"), (F.size(p) - 1).alias("n"), F.when(F.size(p) > 1, spaces(p[0])).alias("first"),
        F.when(F.size(p) > 1, spaces(norm) - 1 - spaces(F.element_at(p, -1))).alias("last")))


def detections(norm: Column, table: list[Rule]) -> Column:
    """Array of (start, end, rank, label, confidence) of all rules whose keyword occurs; end is exclusive, in words."""
    keywords = F.array(*[F.lit(k) for k in sorted({r.keyword for r in table})])
    signatures = F.array(*[F.struct(F.lit(r.keyword).alias("keyword"), F.lit(f"{r.pattern}(?= )").alias("pattern"), F.lit(r.rank).alias("rank"),
                                    F.lit(r.label).alias("label"), F.lit(r.confidence).alias("confidence")) for r in table])
    present = F.filter(keywords, lambda k: F.contains(norm, F.concat(F.lit(" "), k)))

    def places(rule: Column) -> Column:
        spans = match_places(norm, rule["pattern"], spaces)
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), rule["rank"].alias("rank"),
                                                     rule["label"].alias("label"), rule["confidence"].alias("confidence")))

    hits = let(present, lambda ks: F.filter(signatures, lambda r: F.array_contains(ks, r["keyword"])))
    return F.flatten(F.transform(hits, places))


def surviving(found: Column, ranks: int) -> Column:
    """Detections that are not within one of an earlier rank, or a longer one of the same rank.

    Detections are swept in the order of their starts, the longer first.  Of each rank the
    furthest end so far is known, and the start of the detection that reaches it; no
    detection is compared with all others.
    """
    def step(reach: Column, x: Column) -> tuple[Column, Column]:
        longer = lambda m: (m["end"] > x["end"]) | (m["end"] == x["end"]) & (m["start"] < x["start"])
        beats = F.transform(reach, lambda m, i: F.when(i < x["rank"], m["end"] >= x["end"]).otherwise((i == x["rank"]) & longer(m)))
        now = F.transform(reach, lambda m, i: F.when((i == x["rank"]) & (x["end"] > m["end"]), F.struct(x["end"].alias("end"), x["start"].alias("start"))).otherwise(m))
        return now, F.exists(beats, lambda b: b)

    order = F.transform(found, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), x["rank"].alias("rank"), x.alias("x")))
    nothing = F.array_repeat(F.struct(F.lit(-1).alias("end"), F.lit(-1).alias("start")), ranks)
    swept = lambda xs: let(sweep(xs, nothing, "boolean", step), lambda beaten: F.filter(xs, lambda x, i: ~F.get(beaten, i)))
    return F.when(F.size(found) < 2, found).otherwise(let(F.transform(F.array_sort(order), lambda o: o["x"]), swept))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    A null text counts as empty: no words, no labels, score 0.  Rows are scanned one by
    one, so repeated rows and null ids are carried along; an empty table gives an empty
    result; only the id and the text are read.  Texts of any length are scanned whole, in time
    that grows with their length and the logarithm of their detections.  score is the confidence that at least one
    surviving detection is right, 1 if a base phrase occurs.
    """
    table = rules()
    norm = docs.select(F.col(id_col).alias("_id"), words_text(text_of(text_col)).alias("_norm"))
    any_keyword = "|".join(sorted({r.keyword for r in table} | {p.split(" ")[0] for p in phrases}))
    # the prefilter: texts without any keyword at the start of a word need no rule
    gated = norm.select("_id", "_norm", (spaces(F.col("_norm")) - 1).cast("long").alias("n_words"),
                        F.col("_norm").rlike(f" (?:{any_keyword})").alias("_gate"))
    base = F.array(*[base_places(F.col("_norm"), p, label) for p, label in phrases.items()])
    none_base = F.array().cast("array<struct<label:string,n:int,first:int,last:int>>")
    none_found = F.array().cast("array<struct<start:int,end:int,rank:int,label:string,confidence:double>>")
    seen = gated.select("_id", "n_words", F.when(F.col("_gate"), base).otherwise(none_base).alias("_base"),
                        F.when(F.col("_gate"), let(detections(F.col("_norm"), table), lambda d: surviving(d, max(r.rank for r in table) + 1))).otherwise(none_found).alias("detections"))
    base_labels = F.array_sort(F.array_distinct(F.transform(F.filter("_base", lambda x: x["n"] > 0), lambda x: x["label"])))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("detections", lambda x: x["label"]))))
    doubt = F.aggregate("detections", F.lit(1.0), lambda a, x: a * (1 - x["confidence"]))
    n_base = F.aggregate("_base", F.lit(0), lambda a, x: a + x["n"])
    return seen.select(
        F.col("_id").alias(id_col), "n_words", n_base.cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda x: x["last"])).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(n_base > 0, 1.0).otherwise(1 - doubt).alias("score"), "detections")
