"""License detections by ordered signature rules.

A rule is a keyword with one regex for the words up to it and one for the words from it
on. Rules come from hand-written names and texts in a few forms (a tag, a notice, a
denial, a plain mention); earlier forms have priority.

The keyword is the prefilter: only where a word of the text is a keyword are that
keyword's rules tried, on the words around it, so a text without keywords costs one scan.
A detection is the interval of words that a rule matched. One that lies inside another's
interval goes if the other has a better priority, or the same one and more words, or the
same words and an earlier place in the table. That relation is transitive, so what stays
does not depend on any order of work, and only neighbours within SPAN words can matter.

Everything is one projection of built-in functions over whole texts: no shuffle. Null and
empty texts have no words, counts of 0, null places, empty labels and score 0. Repeated
rows give repeated results; a null doc_id stays null.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Separators of words, as ranges of ASCII characters; A-Z are letters, lower-cased afterwards.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most words before a keyword and from it on that a rule may cover, and most words of any detection.
BEFORE, AFTER = 12, 28
SPAN = BEFORE + AFTER

#: Fixed phrases and labels of the contract: (words, which of them is the keyword, label).
PHRASES = (("cc by", 0, "cc-by"), ("general public license", 1, "gpl"), ("all rights reserved", 2, "reserved"))

#: Names: label, then the words from the keyword (the first one) on. {v}: an optional word before a version.
NAMES = (
    ("apache-2.0", "apache (?:software )?(?:license|licence|public license) {v}2(?: 0)?"),
    ("apache-2.0", "apache 2(?: 0)? (?:license|licence)"),
    ("apache-1.1", "apache (?:software )?(?:license|licence) {v}1 1"),
    ("apache-1.0", "apache (?:software )?(?:license|licence) {v}1 0"),
    ("apache", "apache (?:software )?(?:license|licence)"),
    ("mit", "mit (?:license|licence)"),
    ("mit", "mit x11 (?:license|licence)"),
    ("mit", "expat (?:license|licence)"),
    ("x11", "x11 (?:license|licence)"),
    ("mit-0", "mit no attribution(?: license| licence)?"),
    ("mit-0", "mit 0(?: license| licence)?"),
    ("bsd-2-clause", "bsd 2 clause(?: simplified)?(?: license| licence)?"),
    ("bsd-2-clause", "simplified bsd (?:license|licence)"),
    ("bsd-2-clause", "freebsd (?:license|licence)"),
    ("bsd-3-clause", "bsd 3 clause(?: new| revised)?(?: license| licence)?"),
    ("bsd-3-clause", "modified bsd (?:license|licence)"),
    ("bsd-3-clause", "revised bsd (?:license|licence)"),
    ("bsd-4-clause", "bsd 4 clause(?: original)?(?: license| licence)?"),
    ("0bsd", "0bsd(?: license| licence)?"),
    ("0bsd", "bsd zero clause(?: license| licence)?"),
    ("bsd", "bsd (?:style )?(?:license|licence)"),
    ("isc", "isc (?:license|licence)"),
    ("gpl-1.0", "gnu general public (?:license|licence) {v}1(?: 0)?"),
    ("gpl-2.0-or-later", "gnu general public (?:license|licence) {v}2(?: 0)? or (?:any later|later|at your option any later)(?: version)?"),
    ("gpl-2.0", "gnu general public (?:license|licence) {v}2(?: 0)?(?: only)?"),
    ("gpl-3.0-or-later", "gnu general public (?:license|licence) {v}3(?: 0)? or (?:any later|later|at your option any later)(?: version)?"),
    ("gpl-3.0", "gnu general public (?:license|licence) {v}3(?: 0)?(?: only)?"),
    ("gpl", "gnu general public (?:license|licence)"),
    ("gpl", "gnu gpl"),
    ("gpl-2.0", "gnu gpl {v}(?:2|v2)(?: 0)?"),
    ("gpl-3.0", "gnu gpl {v}(?:3|v3)(?: 0)?"),
    ("gpl-2.0", "gplv2(?: license| licence)?"),
    ("gpl-3.0", "gplv3(?: license| licence)?"),
    ("gpl-2.0", "gpl {v}(?:2|v2)(?: 0)?(?: license| licence)?"),
    ("gpl-3.0", "gpl {v}(?:3|v3)(?: 0)?(?: license| licence)?"),
    ("gpl", "gpl (?:license|licence)"),
    ("lgpl-2.0", "gnu (?:library|lesser) general public (?:license|licence) {v}2(?: 0)?"),
    ("lgpl-2.1", "gnu lesser general public (?:license|licence) {v}2 1"),
    ("lgpl-3.0", "gnu lesser general public (?:license|licence) {v}3(?: 0)?"),
    ("lgpl", "gnu (?:library|lesser) general public (?:license|licence)"),
    ("lgpl-2.1", "lgpl {v}(?:2|v2) 1(?: license| licence)?"),
    ("lgpl-3.0", "lgpl {v}(?:3|v3)(?: 0)?(?: license| licence)?"),
    ("lgpl-3.0", "lgplv3(?: license| licence)?"),
    ("lgpl", "lgpl (?:license|licence)"),
    ("agpl-3.0", "gnu affero general public (?:license|licence) {v}3(?: 0)?"),
    ("agpl", "gnu affero general public (?:license|licence)"),
    ("agpl-3.0", "agplv3(?: license| licence)?"),
    ("agpl-3.0", "agpl {v}(?:3|v3)(?: 0)?(?: license| licence)?"),
    ("agpl", "affero (?:general public )?(?:license|licence)"),
    ("gfdl-1.3", "gnu free documentation (?:license|licence) {v}1 3"),
    ("gfdl-1.2", "gnu free documentation (?:license|licence) {v}1 2"),
    ("gfdl", "gnu free documentation (?:license|licence)"),
    ("mpl-1.1", "mozilla public (?:license|licence) {v}1 1"),
    ("mpl-2.0", "mozilla public (?:license|licence) {v}2(?: 0)?"),
    ("mpl", "mozilla public (?:license|licence)"),
    ("mpl-2.0", "mpl {v}2(?: 0)?"),
    ("epl-1.0", "eclipse public (?:license|licence) {v}1(?: 0)?"),
    ("epl-2.0", "eclipse public (?:license|licence) {v}2(?: 0)?"),
    ("epl", "eclipse public (?:license|licence)"),
    ("edl-1.0", "eclipse distribution (?:license|licence)(?: {v}1(?: 0)?)?"),
    ("cddl-1.0", "common development and distribution (?:license|licence) {v}1(?: 0)?"),
    ("cddl-1.1", "common development and distribution (?:license|licence) {v}1 1"),
    ("cddl", "common development and distribution (?:license|licence)"),
    ("cddl", "cddl (?:license|licence)"),
    ("cpl-1.0", "common public (?:license|licence)(?: {v}1(?: 0)?)?"),
    ("ipl-1.0", "ibm public (?:license|licence)(?: {v}1(?: 0)?)?"),
    ("artistic-2.0", "artistic (?:license|licence) {v}2(?: 0)?"),
    ("artistic-1.0", "artistic (?:license|licence) {v}1(?: 0)?"),
    ("artistic", "artistic (?:license|licence)"),
    ("bsl-1.0", "boost software (?:license|licence)(?: {v}1(?: 0)?)?"),
    ("busl-1.1", "business source (?:license|licence)(?: {v}1 1)?"),
    ("busl-1.1", "busl 1 1"),
    ("elastic-2.0", "elastic (?:license|licence) {v}(?:2|v2)(?: 0)?"),
    ("elastic", "elastic (?:license|licence)"),
    ("sspl-1.0", "server side public (?:license|licence)(?: {v}(?:1|v1))?"),
    ("sspl-1.0", "sspl (?:license|licence|v1|1 0)"),
    ("eupl-1.2", "european union public (?:license|licence) {v}(?:1 2|v1 2)"),
    ("eupl", "european union public (?:license|licence)"),
    ("eupl-1.2", "eupl {v}(?:1 2|v1 2)"),
    ("eupl", "eupl (?:license|licence)"),
    ("cecill", "cecill (?:license|licence|b|c|2 1)"),
    ("zlib", "zlib (?:license|licence)"),
    ("zlib", "zlib libpng (?:license|licence)"),
    ("libpng", "libpng (?:license|licence)"),
    ("openssl", "openssl (?:license|licence)"),
    ("python-2.0", "python software foundation (?:license|licence)(?: {v}2)?"),
    ("python-2.0", "psf (?:license|licence)"),
    ("php-3.01", "php (?:license|licence)(?: {v}3 01)?"),
    ("ruby", "ruby (?:license|licence)"),
    ("perl", "perl (?:artistic )?(?:license|licence)"),
    ("postgresql", "postgresql (?:license|licence)"),
    ("ncsa", "ncsa (?:open source )?(?:license|licence)"),
    ("ncsa", "university of illinois ncsa (?:open source )?(?:license|licence)"),
    ("w3c", "w3c software (?:notice and )?(?:license|licence)"),
    ("unicode", "unicode (?:license|licence)(?: agreement| v3)?"),
    ("ofl-1.1", "sil open font (?:license|licence)(?: {v}1 1)?"),
    ("ofl-1.1", "ofl (?:license|licence|1 1)"),
    ("wtfpl", "wtfpl(?: license| licence)?"),
    ("unlicense", "unlicense(?: license)?"),
    ("beerware", "beerware (?:license|licence)"),
    ("ms-pl", "microsoft public (?:license|licence)"),
    ("ms-rl", "microsoft reciprocal (?:license|licence)"),
    ("ms-rsl", "microsoft reference source (?:license|licence)"),
    ("apsl-2.0", "apple public source (?:license|licence)(?: {v}2(?: 0)?)?"),
    ("osl-3.0", "open software (?:license|licence)(?: {v}3(?: 0)?)?"),
    ("afl-3.0", "academic free (?:license|licence)(?: {v}3(?: 0)?)?"),
    ("upl-1.0", "universal permissive (?:license|licence)(?: {v}1(?: 0)?)?"),
    ("mulan-psl", "mulan (?:psl|permissive software license)(?: v2| v1)?"),
    ("odbl-1.0", "open (?:data commons open )?database (?:license|licence)(?: {v}1(?: 0)?)?"),
    ("odbl-1.0", "odbl(?: license| licence| 1 0)?"),
    ("odc-by", "open data commons attribution (?:license|licence)"),
    ("pddl", "open data commons public domain dedication(?: and license| and licence)?"),
    ("cdla-permissive", "community data (?:license|licence) agreement permissive(?: {v}[12](?: 0)?)?"),
    ("cdla-sharing", "community data (?:license|licence) agreement sharing(?: {v}1(?: 0)?)?"),
    ("llama", "llama (?:[23](?: [0-9])? )?community (?:license|licence)(?: agreement)?"),
    ("openrail", "openrail(?: m)?(?: license| licence)?"),
    ("rail", "responsible ai (?:license|licence)s?"),
    ("ogl-uk", "open government (?:license|licence)(?: {v}(?:[123]|v[123])(?: 0)?)?"),
    ("commons-clause", "commons clause(?: license)?(?: condition)?"),
    ("cc0-1.0", "cc0(?: 1 0)?(?: universal)?(?: license| public domain dedication)?"),
    ("cc0-1.0", "creative commons (?:zero|cc0|0)(?: {v}1 0)?(?: universal)?"),
    ("cc-by", "cc by(?: license| licence)?"),
    ("cc-by-1.0", "cc by 1 0"), ("cc-by-2.0", "cc by 2 0"), ("cc-by-2.5", "cc by 2 5"), ("cc-by-3.0", "cc by 3 0"), ("cc-by-4.0", "cc by 4 0"),
    ("cc-by-sa", "cc by sa(?: license| licence)?"),
    ("cc-by-sa-3.0", "cc by sa 3 0"), ("cc-by-sa-4.0", "cc by sa 4 0"),
    ("cc-by-nc", "cc by nc(?: license| licence)?"),
    ("cc-by-nc-3.0", "cc by nc 3 0"), ("cc-by-nc-4.0", "cc by nc 4 0"),
    ("cc-by-nd", "cc by nd(?: license| licence)?"),
    ("cc-by-nd-4.0", "cc by nd 4 0"),
    ("cc-by-nc-sa", "cc by nc sa(?: license| licence)?"),
    ("cc-by-nc-sa-3.0", "cc by nc sa 3 0"), ("cc-by-nc-sa-4.0", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "cc by nc nd(?: license| licence)?"),
    ("cc-by-nc-nd-4.0", "cc by nc nd 4 0"),
    ("cc-by", "creative commons attribution(?: {v}[1-4] [05])?(?: international| generic| unported)?(?: license| licence)?"),
    ("cc-by-sa", "creative commons attribution share ?alike(?: {v}[1-4] [05])?(?: international| generic| unported)?(?: license| licence)?"),
    ("cc-by-nd", "creative commons attribution no ?deriv(?:ative|atives|s)(?: works)?(?: {v}[1-4] [05])?(?: international| generic| unported)?(?: license| licence)?"),
    ("cc-by-nc", "creative commons attribution non ?commercial(?: {v}[1-4] [05])?(?: international| generic| unported)?(?: license| licence)?"),
    ("cc-by-nc-sa", "creative commons attribution non ?commercial share ?alike(?: {v}[1-4] [05])?(?: international| generic| unported)?(?: license| licence)?"),
    ("cc-by-nc-nd", "creative commons attribution non ?commercial no ?deriv(?:ative|atives|s)(?: works)?(?: {v}[1-4] [05])?(?: international| generic| unported)?(?: license| licence)?"),
    ("cc", "creative commons (?:license|licence)"),
)
VERSION = "(?:(?:version|v) )?"

#: Forms of a name: priority, confidence, words before the keyword, whether the name's label is kept.
#: The last one is the plain mention.
FORMS = (
    (1, 1.0, "spdx license identifier", True),
    (2, 0.0, "(?:not|never|no longer) (?:licensed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?", False),
    (3, 0.9, "(?:licensed|released|distributed|redistributed|published|provided|available|offered|covered|made available) (?:to you )?(?:under|by|with) "
             "(?:the )?(?:terms (?:and conditions )?of )?(?:the )?(?:a |an )?", True),
    (4, 0.6, "", True),
)

#: Texts of their own: label, priority, confidence, words before the keyword, words from the keyword on.
TEXTS = (
    ("mit", 2, 1.0, "permission is ", "hereby granted free of charge to any person obtaining a copy of this software"),
    ("isc", 2, 1.0, "permission to use copy modify and or ", "distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 2, 0.9, "", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", 2, 1.0, "neither the name of (?:[^ ]+ ){1,4}nor the names of its ", "contributors may be used to endorse or promote products"),
    ("mit", 3, 0.6, "the software is ", "provided as is without warranty of any kind"),
    ("apache-2.0", 2, 1.0, "you may not use this file except in ", "compliance with the license"),
    ("apache-2.0", 2, 1.0, "www ", "apache org licenses license 2 0"),
    ("gpl", 2, 0.9, "you can ", "redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", 2, 0.9, "you can ", "redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", 2, 0.9, "you can ", "redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", 2, 0.9, "www ", "gnu org licenses gpl(?: [23] 0)?(?: html| txt)?"),
    ("lgpl", 2, 0.9, "www ", "gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?"),
    ("agpl", 2, 0.9, "www ", "gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("mpl-2.0", 2, 1.0, "this source code form is ", "subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 2, 1.0, "", "mozilla org mpl 2 0"),
    ("unlicense", 2, 1.0, "this is free and ", "unencumbered software released into the public domain"),
    ("public-domain", 3, 0.9, "(?:released|dedicated|placed) (?:in|into|to) the ", "public domain"),
    ("public-domain", 4, 0.3, "in the ", "public domain"),
    ("wtfpl", 2, 1.0, "do what the fuck you want to ", "public license"),
    ("beerware", 2, 1.0, "the beer ware ", "license revision 42"),
    ("zlib", 2, 1.0, "this software is ", "provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1.0", 2, 1.0, "www ", "boost org license 1 0(?: txt)?"),
    ("cc0-1.0", 2, 1.0, "", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", 2, 0.9, "", "creativecommons org publicdomain mark 1 0"),
    ("cc-by-sa", 2, 1.0, "", "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nc", 2, 1.0, "", "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nd", 2, 1.0, "", "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc-sa", 2, 1.0, "", "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", 2, 1.0, "", "creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by", 2, 1.0, "", "creativecommons org licenses by [1-4] [05]"),
    ("proprietary", 3, 0.6, "(?:unauthorized|unauthorised) (?:copying|use|reproduction) (?:or distribution )?of (?:this|the) (?:[^ ]+ ){1,3}", "strictly prohibited"),
    ("proprietary", 3, 0.6, "", "proprietary and confidential"),
    ("proprietary", 3, 0.6, "may not be reproduced (?:or )?(?:distributed )?(?:in any form )?without ", "prior written permission"),
    ("reserved", 4, 0.3, "all ", "rights reserved"),
    ("reserved", 4, 0.3, "no ", "rights reserved"),
    ("commercial", 3, 0.6, "commercial ", "license agreement"),
    ("eula", 3, 0.6, "end user ", "license agreement"),
    ("copyleft", 4, 0.3, "", "copyleft"),
)


@dataclass(frozen=True)
class Rule:
    """Rank in the table, priority (1 is best), confidence, label (empty: a suppressor only), keyword, both regexes."""

    rank: int
    priority: int
    confidence: float
    label: str
    keyword: str
    before: str
    after: str


def rules() -> list[Rule]:
    """The ordered table. Both regexes see single spaces between words, one after the last."""
    out: list[Rule] = []

    def add(priority: int, confidence: float, label: str, before: str, after: str) -> None:
        before = before if not before or before.endswith((" ", ")?", "}")) else before + " "
        out.append(Rule(len(out), priority, confidence, label, after.split(" ")[0].split("(")[0], f"(?:^| )({before})$" if before else "()$", f"^((?:{after}) )"))

    for priority, confidence, before, kept in FORMS:
        if priority == 1:
            for label in dict.fromkeys(label for label, _ in NAMES):
                add(priority, confidence, label, before, label.replace("-", " ").replace(".", " ") + "(?: only| or later)?")
            continue
        for label, name in NAMES:
            add(priority, confidence, label if kept else "", before, name.replace("{v}", VERSION))
    for label, priority, confidence, before, after in TEXTS:
        add(priority, confidence, label, before, after)
    return out


RULES = rules()
#: Words that any rule or phrase starts from.
KEYWORDS = sorted({r.keyword for r in RULES} | {words.split()[at] for words, at, _ in PHRASES})


def _lowered(words: Column) -> Column:
    return F.translate(words, UPPER, LOWER)


def _cut(words: Column, begin: Column, length: Column) -> Column:
    """`length` words from 0-based `begin` on, lower-cased, a space after each."""
    return F.concat(_lowered(F.array_join(F.slice(words, begin + 1, length), " ")), F.lit(" "))


def _count(text: Column) -> Column:
    """Words of a text with a space after each."""
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _rule_table() -> Column:
    """The rules by keyword, as one constant."""
    by_key: dict[str, list[dict]] = {}
    for r in RULES:
        by_key.setdefault(r.keyword, []).append(asdict(r))
    rule = "struct<rank: int, priority: int, confidence: double, label: string, before: string, after: string>"
    return F.from_json(F.lit(json.dumps(by_key)), f"map<string, array<{rule}>>")


def _better(a: Column, b: Column) -> Column:
    """b's interval holds a's, and b comes first."""
    size = lambda x: x["end"] - x["start"]
    inside = (b["start"] <= a["start"]) & (b["end"] >= a["end"])
    return inside & ((b["priority"] < a["priority"]) | ((b["priority"] == a["priority"]) & (
        (size(b) > size(a)) | ((size(b) == size(a)) & (b["rank"] < a["rank"])))))


def _hits_at(words: Column, at: Column, table: Column) -> Column:
    """Detections of the rules whose keyword stands at word `at`."""
    before = _cut(words, F.greatest(at - BEFORE, F.lit(0)), F.least(at, F.lit(BEFORE)))
    after = _cut(words, at, F.lit(AFTER))

    def tried(rule: Column) -> Column:
        left = F.call_function("regexp_extract", before, rule["before"], F.lit(1))
        right = F.call_function("regexp_extract", after, rule["after"], F.lit(1))
        fits = (right != "") & ((rule["before"] == "()$") | (left != ""))
        return F.when(fits, F.struct(
            (at - _count(left)).cast("int").alias("start"), (at + _count(right)).cast("int").alias("end"), rule["rank"].alias("rank"),
            rule["priority"].alias("priority"), rule["confidence"].alias("confidence"), rule["label"].alias("label")))

    found = F.coalesce(F.transform(F.element_at(table, _lowered(words[at])), tried), F.array())
    return F.filter(found, lambda h: h.isNotNull())


def _places(phrase: str, key: int, label: str) -> Column:
    """Where the phrase stands, from the anchors of its word number `key`."""
    def stands(i: Column) -> Column:
        own = F.array_join(F.slice("words", F.greatest(i - key, F.lit(0)) + 1, F.lit(len(phrase.split()))), " ")
        return (i >= key) & (_lowered(own) == phrase)

    return F.transform(F.filter("anchors", stands), lambda i: F.struct((i - key).alias("start"), F.lit(label).alias("label")))


def detections(docs: DataFrame) -> DataFrame:
    """`docs` with `words` (not lower-cased), `places` (start, label of the contract's phrases) and
    `found`: detections (start, end, rank, priority, confidence, label) that nothing suppresses."""
    rows = docs.withColumn("words", F.filter(F.split(F.coalesce("text", F.lit("")), SEPARATOR), lambda w: w != ""))
    # lower() may change letters beyond ASCII, so it only picks candidates; what follows sees A-Z lower-cased.
    is_key = lambda w: F.lower(w).isin(KEYWORDS)
    at = F.when(F.exists("words", is_key), F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: is_key(F.col("words")[i]))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("anchors", at)
    table = _rule_table()
    rows = rows.withColumn("places", F.concat(*[_places(*p) for p in PHRASES])).withColumn(
        "groups", F.filter(F.transform("anchors", lambda i: F.struct(i.alias("at"), _hits_at(F.col("words"), i, table).alias("hits"))), lambda g: F.size(g["hits"]) > 0))

    def kept(group: Column, k: Column) -> Column:
        first = F.greatest(k - SPAN, F.lit(0))
        near = F.filter(F.slice("groups", first + 1, F.lit(2 * SPAN + 1)), lambda g: F.abs(g["at"] - group["at"]) <= SPAN)
        return F.filter(group["hits"], lambda a: ~F.exists(near, lambda g: F.exists(g["hits"], lambda b: _better(a, b))))

    return rows.withColumn("found", F.flatten(F.transform("groups", kept))).drop("groups", "anchors")


def op11_license_rules(docs: DataFrame) -> DataFrame:
    found = detections(docs.select("doc_id", "text"))
    base, rule_labels = F.array_distinct("places.label"), F.filter("found.label", lambda label: label != "")
    return found.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"), F.size("places").cast("bigint").alias("n_base"),
        F.array_min("places.start").cast("bigint").alias("first_word"), F.array_max("places.start").cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, rule_labels))), ",").alias("labels"),
        F.coalesce(F.array_max("found.confidence"), F.lit(0.0)).alias("score"), F.size("found").cast("bigint").alias("n_found"))
