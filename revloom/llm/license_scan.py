"""License scans: ordered signature rules over the words of a text, native expressions only.

A rule is a regular expression over the text's words (lower-cased, joined by one space), with keywords of which one must occur in the text before the
expression is tried, a label and a tier. Keywords come from the expression itself, one for each of its alternatives, so that no match lacks them. A cheap test of the raw
text lets most documents pass by; in the others, the rules with a keyword that occurs are tried, and each match becomes a detection: an interval of words. Overlapping detections resolve by interval containment: one that lies
inside another of the same or a better tier goes (of two equal intervals, the one of the better tier, then of the earlier rule, stays).
The intervals of a document are swept once in order of their start, with a running maximum of the ends for each tier, so that a
document with many mentions costs n log n.

Tier 0 are the base phrases; they count at every place and their labels always stay.

Defined results: a null or empty text has no words, no labels and score 0. A null doc_id is scanned like any other. Repeated rows give
repeated results. Only doc_id and text are read, so that other columns may have any names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what stands between words, once A-Z are lower case
GAP_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"  # the same before that
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (phrase, label)
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

V = r"(?:v|version )?"
#: Signatures: (label, names as a regular expression over words, the identifier in tags and addresses)
SIGNATURES = [
    ("mit", r"mit(?: x11)?|expat|massachusetts institute of technology", r"mit"),
    ("apache-1.1", rf"apache(?: software)?(?: foundation)?(?: licen[sc]e)? {V}1 1", r"apache 1 1"),
    ("apache-2", rf"apache(?: software)?(?: foundation)?(?: licen[sc]e)? {V}2(?: 0)?|al2|asl 2(?: 0)?", r"apache 2 0"),
    ("gpl-1", rf"(?:gnu )?general public licen[sc]e {V}1(?: 0)?", r"gpl 1 0"),
    ("gpl-2", rf"(?:gnu )?general public licen[sc]e {V}2(?: 0)?", r"gpl 2 0"),
    ("gpl-3", rf"(?:gnu )?general public licen[sc]e {V}3(?: 0)?", r"gpl 3 0"),
    ("gpl-2", rf"(?:gnu )?gpl ?{V}2(?: 0)?(?: only)?", r"gpl 2 0 only"),
    ("gpl-3", rf"(?:gnu )?gpl ?{V}3(?: 0)?(?: only)?", r"gpl 3 0 only"),
    ("gpl-2-or-later", rf"(?:gnu )?(?:gpl|general public licen[sc]e) {V}2(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?", r"gpl 2 0 or later"),
    ("gpl-3-or-later", rf"(?:gnu )?(?:gpl|general public licen[sc]e) {V}3(?: 0)? (?:or|and)(?: at your option)?(?: any)? later(?: version)?", r"gpl 3 0 or later"),
    ("lgpl-2", rf"(?:gnu )?library general public licen[sc]e {V}2(?: 0)?", r"lgpl 2 0"),
    ("lgpl-2.1", rf"(?:gnu )?lesser general public licen[sc]e {V}2 1", r"lgpl 2 1"),
    ("lgpl-3", rf"(?:gnu )?lesser general public licen[sc]e {V}3(?: 0)?", r"lgpl 3 0"),
    ("lgpl-2.1", rf"(?:gnu )?lgpl ?{V}2 1(?: only)?", r"lgpl 2 1 only"),
    ("lgpl-3", rf"(?:gnu )?lgpl ?{V}3(?: 0)?(?: only)?", r"lgpl 3 0 only"),
    ("agpl-3", rf"(?:gnu )?affero general public licen[sc]e {V}3(?: 0)?", r"agpl 3 0"),
    ("agpl-3", rf"(?:gnu )?agpl ?{V}3(?: 0)?", r"agpl 3 0 only"),
    ("gfdl-1.3", rf"(?:gnu )?free documentation licen[sc]e {V}1 3", r"gfdl 1 3"),
    ("gfdl-1.2", rf"(?:gnu )?free documentation licen[sc]e {V}1 2", r"gfdl 1 2"),
    ("bsd-2", r"(?:2|two) clause bsd|simplified bsd|freebsd|bsd 2 clause", r"bsd 2 clause"),
    ("bsd-3", r"(?:3|three) clause bsd|new bsd|modified bsd|revised bsd|bsd 3 clause", r"bsd 3 clause"),
    ("bsd-4", r"(?:4|four) clause bsd|original bsd|old bsd|bsd 4 clause", r"bsd 4 clause"),
    ("0bsd", r"zero clause bsd|free public licen[sc]e 1 0 0|bsd zero clause", r"0bsd"),
    ("bsd", r"bsd(?: style)?", r"bsd"),
    ("mpl-1.1", rf"mozilla public licen[sc]e {V}1 1", r"mpl 1 1"),
    ("mpl-2", rf"mozilla public licen[sc]e {V}2(?: 0)?", r"mpl 2 0"),
    ("mpl-2", rf"mpl ?{V}2(?: 0)?", r"mpl 2 0 no copyleft exception"),
    ("epl-1", rf"eclipse public licen[sc]e {V}1(?: 0)?", r"epl 1 0"),
    ("epl-2", rf"eclipse public licen[sc]e {V}2(?: 0)?", r"epl 2 0"),
    ("eupl-1.2", rf"european union public licen[sc]e {V}1 2", r"eupl 1 2"),
    ("cddl-1", rf"common development and distribution licen[sc]e {V}1(?: 0)?", r"cddl 1 0"),
    ("cpl-1", rf"common public licen[sc]e {V}1(?: 0)?", r"cpl 1 0"),
    ("isc", r"isc|internet systems consortium", r"isc"),
    ("zlib", r"zlib(?: libpng)?", r"zlib"),
    ("libpng", r"libpng(?: 2 0)?", r"libpng 2 0"),
    ("boost-1", rf"boost software licen[sc]e(?: {V}1(?: 0)?)?", r"bsl 1 0"),
    ("artistic-1", rf"artistic licen[sc]e {V}1(?: 0)?", r"artistic 1 0"),
    ("artistic-2", rf"artistic licen[sc]e {V}2(?: 0)?", r"artistic 2 0"),
    ("unlicense", r"the unlicense|unlicense", r"unlicense"),
    ("wtfpl", r"wtfpl(?: v ?2| version 2)?", r"wtfpl"),
    ("ofl-1.1", rf"(?:sil )?open font licen[sc]e(?: {V}1 1)?", r"ofl 1 1"),
    ("python-2", r"python software foundation|psf", r"psf 2 0"),
    ("php-3", rf"php licen[sc]e {V}3(?: 0| 01)?", r"php 3 01"),
    ("ruby", r"ruby(?: s)?", r"ruby"),
    ("postgresql", r"postgresql", r"postgresql"),
    ("openssl", r"openssl", r"openssl"),
    ("curl", r"curl", r"curl"),
    ("ms-pl", r"microsoft public", r"ms pl"),
    ("ms-rl", r"microsoft reciprocal", r"ms rl"),
    ("odbl-1", rf"open (?:data commons )?open database licen[sc]e(?: {V}1 0)?|open database licen[sc]e", r"odbl 1 0"),
    ("odc-by-1", r"open data commons attribution", r"odc by 1 0"),
    ("pddl-1", r"public domain dedication and licen[sc]e", r"pddl 1 0"),
    ("cc0-1", rf"cc0(?: {V}1 0)?(?: universal)?", r"cc0 1 0"),
    ("public-domain", r"(?:in|into|to) the public domain|public domain dedication", r"publicdomain"),
    ("cc-by", r"cc by(?: [1-4] [05])?", r"cc by 4 0"),
    ("cc-by-sa", r"cc by sa(?: [1-4] [05])?", r"cc by sa 4 0"),
    ("cc-by-nc", r"cc by nc(?: [1-4] [05])?", r"cc by nc 4 0"),
    ("cc-by-nd", r"cc by nd(?: [1-4] [05])?", r"cc by nd 4 0"),
    ("cc-by-nc-sa", r"cc by nc sa(?: [1-4] [05])?", r"cc by nc sa 4 0"),
    ("cc-by-nc-nd", r"cc by nc nd(?: [1-4] [05])?", r"cc by nc nd 4 0"),
    ("cc-by", r"creative commons attribution(?: [1-4] [05])?", r"by 4 0"),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: [1-4] [05])?", r"by sa 4 0"),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: [1-4] [05])?", r"by nc 4 0"),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:s|atives)(?: [1-4] [05])?", r"by nd 4 0"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", r"by nc sa 4 0"),
    ("cc-by-nc-nd", r"creative commons attribution non ?commercial no ?deriv(?:s|atives)(?: [1-4] [05])?", r"by nc nd 4 0"),
    ("all-rights-reserved", r"all rights reserved(?: under)?(?: the)?(?: copyright)?", r"all rights reserved"),
    ("proprietary", r"proprietary and confidential|proprietary software", r"proprietary"),
]
#: Names without a version: (label, names). They need no form, and give way to longer matches.
VERSIONLESS = [
    ("gpl", r"(?:gnu )?general public licen[sc]e|(?:gnu )?gpl"),
    ("lgpl", r"(?:gnu )?(?:lesser|library) general public licen[sc]e|(?:gnu )?lgpl"),
    ("agpl", r"(?:gnu )?affero general public licen[sc]e|(?:gnu )?agpl"),
    ("gfdl", r"(?:gnu )?free documentation licen[sc]e|gfdl"),
    ("apache", r"apache(?: software)?(?: foundation)?(?: public)? licen[sc]e"),
    ("mpl", r"mozilla public licen[sc]e"),
    ("epl", r"eclipse public licen[sc]e"),
    ("eupl", r"european union public licen[sc]e"),
    ("cddl", r"common development and distribution licen[sc]e|cddl"),
    ("cpl", r"common public licen[sc]e"),
    ("artistic", r"artistic licen[sc]e"),
    ("php", r"php licen[sc]e"),
    ("creative-commons", r"creative commons licen[sc]e"),
]
#: Statements that stand by themselves.
STATEMENTS = [
    ("all-rights-reserved", r"all rights (?:are )?reserved"),
    ("proprietary", r"proprietary and confidential|confidential and proprietary|proprietary software|proprietary information"),
    ("public-domain", r"(?:in|into|to|within) the public domain|public domain dedication|public domain (?:work|software|text|notice)"),
    ("cc0-1", r"no rights reserved|creativecommons org publicdomain zero 1 0"),
    ("apache-2", rf"apache org licen[sc]es licen[sc]e 2 0|apache(?: software)?(?: foundation)? licen[sc]e {V}2(?: 0)?"),
    ("apache-1.1", rf"apache(?: software)?(?: foundation)? licen[sc]e {V}1 1"),
    ("cc-by", r"cc by [1-4] [05]"),
]
NOTICE = r"permission is hereby granted free of charge to any person"
FSF = r"(?: as)? published by the free software foundation (?:either )?"
THING = r"(?:it|them|this (?:program|library|software|file|work))"
TERMS = rf"redistribute {THING} and or modify {THING} under the terms of the (?:gnu )?"
LATER = r" of the licen[sc]e or (?:at your option )?any later version"
#: What hand-written notices say.
NOTICES = [
    ("mit", rf"{NOTICE} obtaining a copy of this software(?: and associated documentation files)?"),
    ("boost-1", rf"{NOTICE} or organi[sz]ation obtaining a copy of the software and accompanying documentation covered by this licen[sc]e"),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("0bsd", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", r"redistributions? and use in source and binary forms with or without modification (?:are|is) permitted"),
    ("bsd-3", r"may be used to endorse or promote products derived from this software"),
    ("bsd-4", r"all advertising materials mentioning features or use of this software must display"),
    ("zlib", r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", r"do what the fuck you want to(?: public licen[sc]e)?"),
    ("apache-2", r"may not use this (?:file|work|software) except in compliance with the licen[sc]e"),
    *[(f"{label}-or-later", rf"{TERMS}{name}general public licen[sc]e{FSF}version {v}(?: 0)?{LATER}") for label, name, v in (("gpl-2", "", "2"), ("gpl-3", "", "3"), ("lgpl-2", "library ", "2"), ("lgpl-2.1", "lesser ", "2 1"), ("lgpl-3", "lesser ", "3"), ("agpl-3", "affero ", "3"))],
]
GRANT = r"(?:licen[sc]ed|released|distributed|published|available|provided|offered|shared|covered|redistributed) (?:to you )?(?:under|by|with|according to)(?: the)?(?: terms of)?(?: the)?(?: conditions of)?(?: the)? "


def alternatives(names: str) -> list[str]:
    out, depth = [""], 0
    for c in names:
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def fixed(x: str) -> str:
    """The longest text that each match of an expression without alternatives has: what stands outside of groups, classes and optional characters."""
    out, depth = [""], 0
    for k, c in enumerate(x):
        if c in "([":
            depth += 1
            out.append("")
        elif c in ")]":
            depth -= 1
        elif not depth and c == "?":
            out[-1:] = [out[-1] if x[k - 1] in ")]" else out[-1][:-1], ""]
        elif not depth:
            out[-1] += c
    return max(out, key=len)


def keywords(names: str) -> list[str]:
    return [fixed(x) for x in alternatives(names)]


#: The forms that each signature takes: (tier, confidence, what makes the rule's keywords and expression of its names and identifier). A form whose words don't name a license needs the word.
FORMS = [
    (1, 0.99, lambda names, tag: ([f"identifier {tag}"], rf"spdx licen[sc]e identifier {tag}")),
    (2, 0.95, lambda names, tag: (keywords(names), rf"{GRANT}(?:{names})(?: licen[sc]e)?")),
    (3, 0.9, lambda names, tag: ([f" {tag}"], rf"(?:opensource|creativecommons|spdx|gnu|apache|choosealicense)(?: org| com) (?:licen[sc]es?|publicdomain) {tag}")),
    (4, 0.8, lambda names, tag: (keywords(names), rf"(?:{names}) licen[sc]ed?")),
    (4, 0.7, lambda names, tag: (keywords(names), rf"licen[sc]es? (?:type |is |name |information )?(?:the )?(?:{names})")),
]
#: What takes no form: (tier, confidence, rules as (label, expression)). A full name with its version needs no form either.
ALONE = [
    (2, 0.95, NOTICES),
    (4, 0.9, STATEMENTS),
    (4, 0.75, [(label, "|".join(got)) for label, names, _ in SIGNATURES if (got := [x for x in alternatives(names) if re.search(r"licen\[sc\]e(?!\))|gpl|\bmpl|wtfpl|unlicense|cc0|creative commons|cc by [sn]", x)])]),
    (4, 0.6, VERSIONLESS),
]
TIERS = 5


def rules() -> list[tuple[int, int, list[str], str, str, float]]:
    """(rank, tier, keywords, expression, label, confidence) in order of priority."""
    found = [(0, [phrase], phrase, label, 1.0) for phrase, label in BASE]
    found += [(tier, *form(names, tag), label, sure) for tier, sure, form in FORMS for label, names, tag in SIGNATURES]
    found += [(tier, keywords(x), x, label, sure) for tier, sure, got in ALONE for label, x in got]
    found.sort(key=lambda r: r[0])
    return [(k, tier, words, rf"(?<![^ ])(?:{x})(?![^ ])", label, sure) for k, (tier, words, x, label, sure) in enumerate(found)]


#: Whatever a rule can match has one of these where a word begins; tried on the raw text.
GATE = r"(?i)(?<![^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F])(?:" + "|".join(
    x.replace(" ", GAP_RAW)
    for x in (
        "(?:un)?licen[sc]", "spdx", "apache", "cc by", "cc0", "gnu", "[al]?gpl", "mpl", "gfdl", "cddl", "wtfpl", "opensource", "creativecommons", "creative commons", "choosealicense", "(?:released|distributed|published|available|provided|offered|shared|covered) (?:to you )?(?:under|by|with|according)",
        "rights (?:are )?reserved", "proprietary (?:and|software|information)", "and proprietary", "public domain", "permission (?:is|to)", "and use in source", "endorse or promote", "advertising materials mentioning", "provided as is", "fuck you want", "redistribute [a-z]+",
    )
) + ")"


def words(x):
    """How many words a normal text (or a piece of one) has."""
    t = F.btrim(x)
    return F.when(t == "", F.lit(0)).otherwise(F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def normal(text):
    return F.translate(F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), GAP_RAW, " ")), UPPER, LOWER)


def detections(docs: DataFrame) -> DataFrame:
    """Every match of every rule: doc_id, th, rank, tier, label, sure, first, last (its words, from 0), kept (not suppressed). docs: doc_id, th, text, no two rows alike."""
    table_of = F.array(*[F.struct(*[(F.array(*map(F.lit, v)) if n == "keywords" else F.lit(v)).alias(n) for n, v in zip(("rank", "tier", "keywords", "rx", "label", "sure"), r, strict=True)]) for r in rules()])
    rows = docs.where(F.col("text").rlike(GATE)).select("doc_id", "th", normal(F.col("text")).alias("norm"))
    tried = rows.withColumn("r", F.explode(F.filter(table_of, lambda r: F.exists(r["keywords"], lambda k: F.contains(F.col("norm"), k))))).where(F.expr("norm rlike r.rx"))
    pieces = tried.select("doc_id", "th", "r", F.split("norm", F.col("r.rx"), -1).alias("gaps"), F.expr("regexp_extract_all(norm, r.rx, 0)").alias("hits"))
    at = pieces.select("doc_id", "th", "r", F.posexplode(F.arrays_zip("gaps", "hits")).alias("at", "x"))
    at = at.select("doc_id", "th", "r.rank", "r.tier", "r.label", "r.sure", "at", words(F.coalesce("x.gaps", F.lit(""))).alias("gap"), F.when(F.col("x.hits").isNotNull(), words(F.col("x.hits"))).alias("hit"))
    before = Window.partitionBy("doc_id", "th", "rank").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.coalesce("hit", F.lit(0))).over(before)
    spans = at.withColumn("last", end - 1).withColumn("first", F.col("last") - F.col("hit") + 1).where("hit is not null")
    earlier = Window.partitionBy("doc_id", "th").orderBy("first", F.desc("last"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for tier in range(TIERS):  # an earlier interval of this tier or a better one reaches as far
        reach = F.max(F.when(F.col("tier") <= tier, F.col("last"))).over(earlier)
        inside = F.when(F.col("tier") == tier, F.coalesce(reach >= F.col("last"), F.lit(False))).otherwise(inside)
    return spans.select("doc_id", "th", "rank", "tier", "label", "sure", "first", "last", (~inside).alias("kept"))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    found = detections(rows.where(F.col("text").rlike(GATE)).dropDuplicates(["doc_id", "th"]))
    base = F.col("tier") == 0
    sets = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    by_doc = found.groupBy("doc_id", "th").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        sets(base).alias("base_labels"), sets(F.col("kept") | base).alias("labels"), F.max(F.when(F.col("kept"), F.col("sure"))).alias("score"),
    )
    all_rows = rows.select(F.col("doc_id").alias("d"), F.col("th").alias("t"), words(F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), GAP_RAW, " "))).alias("n_words"))
    same = F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("t") == F.col("th"))
    empty = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return all_rows.join(by_doc, same, "left").select(F.col("d").alias("doc_id"), "n_words", empty("n_base", 0), "first_word", "last_word", empty("base_labels", ""), empty("labels", ""), empty("score", 0.0))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
