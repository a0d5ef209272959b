"""Operator 1, license scans: ordered signature rules.

A text is cut to words; each word w stands as " w " in the searched form, so a rule's regular expression always matches
whole words. A rule runs only on texts with its keyword. Where detections overlap, one that lies within another of
smaller or equal priority number is suppressed; the contract's base phrases have priority 0 and always stay."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NON_WORD, ascii_lower, check_columns, read


class Rule(NamedTuple):
    label: str
    pattern: str  # over " word " units
    keyword: str
    priority: int
    weight: float


BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: The rules after the base phrases: label; keyword; priority; weight; phrase. In a phrase a|b is either word, a? may be
#: missing, and * stands for one word of digits or nothing. A rule's keyword is a word of every text that it matches.
RULES = """
mit; mit; 1; 0.95; spdx license identifier mit
mit; mit; 1; 0.9; licensed|licenced|released|distributed|available|published under the? terms? of? the? mit license|licence
mit; mit; 2; 0.8; mit license|licence
mit; expat; 2; 0.7; expat license|licence
mit; mit; 2; 0.6; mit licensed|licenced
x11; x11; 2; 0.7; x11 license|licence
mit-text; permission; 3; 0.5; permission is hereby granted free of charge to any person obtaining a copy
mit-text; warranty; 3; 0.4; the software is provided as is without warranty of any kind
isc; isc; 1; 0.95; spdx license identifier isc
isc; isc; 2; 0.8; isc license|licence
isc-text; permission; 3; 0.5; permission to use copy modify and or? distribute this software for any purpose with or without fee
zlib; zlib; 1; 0.95; spdx license identifier zlib
zlib; zlib; 2; 0.8; zlib libpng? license|licence
unlicense; unlicense; 1; 0.95; spdx license identifier unlicense
unlicense; unlicense; 2; 0.7; the unlicense
unlicense; unencumbered; 3; 0.6; this is free and unencumbered software released into the public domain
apache-2; apache; 1; 0.95; spdx license identifier apache 2 *
apache-2; apache; 1; 0.9; apache license|licence version|v? 2|v2 *
apache-2; apache; 1; 0.9; apache software license|licence version|v? 2|v2 *
apache-2; apache; 1; 0.8; apache 2|v2 *
apache-1; apache; 1; 0.9; apache software? license|licence version|v? 1|v1 *
apache; apache; 2; 0.7; apache software? license|licence
apache; apache; 2; 0.6; licensed|licenced|released|distributed under the? apache
asl; asl; 2; 0.6; asl 2|v2 *
bsd-2-clause; bsd; 1; 0.95; spdx license identifier bsd 2 clause
bsd-3-clause; bsd; 1; 0.95; spdx license identifier bsd 3 clause
bsd-0-clause; 0bsd; 1; 0.9; 0bsd
bsd-2-clause; bsd; 1; 0.9; bsd 2|two clause license|licence?
bsd-3-clause; bsd; 1; 0.9; bsd 3|three clause license|licence?
bsd-4-clause; bsd; 1; 0.9; bsd 4|four clause license|licence?
bsd-2-clause; bsd; 1; 0.9; 2|two clause bsd license|licence?
bsd-3-clause; bsd; 1; 0.9; 3|three clause bsd license|licence?
bsd-4-clause; bsd; 1; 0.9; 4|four clause bsd license|licence?
bsd-2-clause; bsd; 1; 0.8; simplified|freebsd bsd license|licence
bsd-3-clause; bsd; 1; 0.8; new|modified|revised bsd license|licence
bsd-4-clause; bsd; 1; 0.8; original|old bsd license|licence
bsd; bsd; 2; 0.7; bsd license|licence
bsd; bsd; 2; 0.7; bsd style license|licence
bsd; bsd; 2; 0.6; licensed|licenced|released|distributed under the? bsd
bsd-text; redistribution; 3; 0.5; redistribution and use in source and binary forms
bsd-text; endorse; 3; 0.4; may be used to endorse or promote products derived from this software
bsl-1; bsl; 1; 0.95; spdx license identifier bsl 1 *
bsl-1; boost; 1; 0.9; boost software license|licence version|v? 1|v1 *
bsl; boost; 2; 0.7; boost software? license|licence
artistic-1; artistic; 1; 0.9; artistic license|licence? version|v? 1|v1 *
artistic-2; artistic; 1; 0.9; artistic license|licence? version|v? 2|v2 *
artistic; artistic; 2; 0.7; artistic license|licence
perl; perl; 2; 0.5; under the same terms as perl itself?
mpl-2; mpl; 1; 0.95; spdx license identifier mpl 2 *
mpl-1; mpl; 1; 0.95; spdx license identifier mpl 1 *
mpl-2; mozilla; 1; 0.9; mozilla public license|licence version|v? 2|v2 *
mpl-1; mozilla; 1; 0.9; mozilla public license|licence version|v? 1|v1 *
mpl-2; mpl; 1; 0.8; mpl version|v? 2|v2 *
mpl-1; mpl; 1; 0.8; mpl version|v? 1|v1 *
mpl; mozilla; 2; 0.7; mozilla public license|licence
epl-1; epl; 1; 0.95; spdx license identifier epl 1 *
epl-2; epl; 1; 0.95; spdx license identifier epl 2 *
epl-1; eclipse; 1; 0.9; eclipse public license|licence version|v? 1|v1 *
epl-2; eclipse; 1; 0.9; eclipse public license|licence version|v? 2|v2 *
epl-1; epl; 1; 0.8; epl version|v? 1|v1 *
epl-2; epl; 1; 0.8; epl version|v? 2|v2 *
epl; eclipse; 2; 0.7; eclipse public license|licence
edl; eclipse; 2; 0.7; eclipse distribution license|licence
cddl-1; cddl; 1; 0.95; spdx license identifier cddl 1 *
cddl-1; development; 1; 0.9; common development and distribution license|licence version|v? 1|v1 *
cddl-1; cddl; 1; 0.8; cddl version|v? 1|v1 *
cddl; development; 2; 0.7; common development and distribution license|licence
cpl; common; 2; 0.7; common public license|licence
gpl-2; gpl; 1; 0.95; spdx license identifier gpl 2 *
gpl-3; gpl; 1; 0.95; spdx license identifier gpl 3 *
lgpl-2; lgpl; 1; 0.95; spdx license identifier lgpl 2 *
lgpl-3; lgpl; 1; 0.95; spdx license identifier lgpl 3 *
agpl-3; agpl; 1; 0.95; spdx license identifier agpl 3 *
gpl-1; gnu; 1; 0.9; gnu general public license|licence version|v? 1|v1 *
gpl-2; gnu; 1; 0.9; gnu general public license|licence version|v? 2|v2 *
gpl-3; gnu; 1; 0.9; gnu general public license|licence version|v? 3|v3 *
gpl-2; gnu; 1; 0.85; gnu general public license|licence as published by the free software foundation either? version 2 *
gpl-3; gnu; 1; 0.85; gnu general public license|licence as published by the free software foundation either? version 3 *
lgpl-2; gnu; 1; 0.9; gnu lesser|library general public license|licence version|v? 2|v2 *
lgpl-3; gnu; 1; 0.9; gnu lesser general public license|licence version|v? 3|v3 *
lgpl-2; gnu; 1; 0.85; gnu lesser|library general public license|licence as published by the free software foundation either? version 2 *
lgpl-3; gnu; 1; 0.85; gnu lesser general public license|licence as published by the free software foundation either? version 3 *
agpl-1; affero; 1; 0.9; affero general public license|licence version|v? 1|v1 *
agpl-3; affero; 1; 0.9; affero general public license|licence version|v? 3|v3 *
gpl-1; gpl; 1; 0.8; gpl version|v? 1|v1 *
gpl-2; gpl; 1; 0.8; gpl version|v? 2|v2 *
gpl-3; gpl; 1; 0.8; gpl version|v? 3|v3 *
gpl-2; gplv2; 1; 0.8; gplv2
gpl-3; gplv3; 1; 0.8; gplv3
lgpl-2; lgpl; 1; 0.8; lgpl version|v? 2|v2 *
lgpl-3; lgpl; 1; 0.8; lgpl version|v? 3|v3 *
lgpl-2; lgplv2; 1; 0.8; lgplv2
lgpl-3; lgplv3; 1; 0.8; lgplv3
agpl-1; agpl; 1; 0.8; agpl version|v? 1|v1 *
agpl-3; agpl; 1; 0.8; agpl version|v? 3|v3 *
agpl-3; agplv3; 1; 0.8; agplv3
gpl; gnu; 2; 0.7; gnu general public license|licence
gpl; gnu; 2; 0.6; gnu gpl
gpl; gpl; 2; 0.6; gpl license|licence|licensed|compatible
gpl; gpl; 2; 0.6; licensed|licenced|released|distributed under the? gpl
lgpl; gnu; 2; 0.7; gnu lesser|library general public license|licence
lgpl; lgpl; 2; 0.6; lgpl license|licence|licensed
lgpl; lgpl; 2; 0.6; licensed|licenced|released|distributed under the? lgpl
agpl; affero; 2; 0.7; affero general public license|licence
agpl; agpl; 2; 0.6; agpl license|licence|licensed
gfdl-1; gnu; 1; 0.9; gnu free documentation license|licence? version|v? 1|v1 *
gfdl-1; gfdl; 1; 0.8; gfdl version|v? 1|v1 *
gfdl; gnu; 2; 0.7; gnu free documentation license|licence
gpl-text; redistribute; 3; 0.4; this program is free software you can redistribute it and or? modify it
gpl-text; merchantability; 3; 0.3; implied warranty of merchantability or fitness for a particular purpose
eupl-1; eupl; 1; 0.9; eupl version|v? 1|v1 *
eupl-1; european; 1; 0.9; european union public license|licence version|v? 1|v1 *
eupl; european; 2; 0.7; european union public license|licence
cecill; cecill; 2; 0.7; cecill free? software? license|licence
odbl-1; odbl; 1; 0.9; odbl version|v? 1|v1 *
odbl-1; database; 1; 0.9; open database license|licence? version|v? 1|v1 *
odbl; database; 2; 0.7; open database license|licence
odc-by; commons; 2; 0.7; open data commons attribution license|licence
pddl; commons; 2; 0.7; open data commons public domain dedication
ogl-1; government; 1; 0.9; open government license|licence version|v? 1|v1 *
ogl-2; government; 1; 0.9; open government license|licence version|v? 2|v2 *
ogl-3; government; 1; 0.9; open government license|licence version|v? 3|v3 *
ogl; government; 2; 0.7; open government license|licence
ms-pl; microsoft; 2; 0.7; microsoft public license|licence
ms-rl; microsoft; 2; 0.7; microsoft reciprocal license|licence
psf-2; python; 1; 0.9; python software foundation license|licence version|v? 2|v2 *
psf; python; 2; 0.7; python software foundation license|licence
php-3; php; 1; 0.9; php license|licence version|v? 3|v3 *
php; php; 2; 0.7; php license|licence
ruby; ruby; 2; 0.7; ruby license|licence
vim; vim; 2; 0.7; vim license|licence
openssl; openssl; 2; 0.7; openssl license|licence
postgresql; postgresql; 2; 0.7; postgresql license|licence
ncsa; illinois; 2; 0.7; university of illinois ncsa? open source license|licence
curl; curl; 2; 0.7; curl license|licence
wtfpl; wtfpl; 2; 0.8; wtfpl
wtfpl; want; 2; 0.6; do what the fuck you want to public license|licence
beerware; beerware; 2; 0.7; beerware license|licence
beerware; beer; 2; 0.7; beer ware license|licence
ofl-1; ofl; 1; 0.9; ofl version|v? 1|v1 *
ofl-1; font; 1; 0.9; sil open font license|licence version|v? 1|v1 *
ofl; font; 2; 0.7; open font license|licence
blueoak-1; oak; 1; 0.9; blue oak model license|licence 1 *
upl-1; upl; 1; 0.9; upl version|v? 1|v1 *
upl; universal; 2; 0.7; universal permissive license|licence
elastic-2; elastic; 1; 0.9; elastic license|licence version|v? 2|v2 *
sspl-1; side; 1; 0.9; server side public license|licence version|v? 1|v1 *
sspl; sspl; 2; 0.7; sspl
busl-1; business; 1; 0.9; business source license|licence version|v? 1|v1 *
openrail; openrail; 2; 0.7; openrail m? license|licence?
llama; llama; 2; 0.7; llama 2|3 community license|licence agreement?
cc0; cc0; 1; 0.95; spdx license identifier cc0 1 *
cc0; cc0; 2; 0.8; cc0 1? *
cc0; zero; 2; 0.8; creative commons zero
cc-by-1; cc; 1; 0.9; cc by international? license|licence? 1 *
cc-by-2; cc; 1; 0.9; cc by international? license|licence? 2 *
cc-by-3; cc; 1; 0.9; cc by unported? license|licence? 3 *
cc-by-4; cc; 1; 0.9; cc by international? license|licence? 4 *
cc-by-sa-2; cc; 1; 0.9; cc by sa license|licence? 2 *
cc-by-sa-3; cc; 1; 0.9; cc by sa license|licence? 3 *
cc-by-sa-4; cc; 1; 0.9; cc by sa license|licence? 4 *
cc-by-nd-4; cc; 1; 0.9; cc by nd license|licence? 4 *
cc-by-nc-3; cc; 1; 0.9; cc by nc license|licence? 3 *
cc-by-nc-4; cc; 1; 0.9; cc by nc license|licence? 4 *
cc-by-nc-sa-3; cc; 1; 0.9; cc by nc sa license|licence? 3 *
cc-by-nc-sa-4; cc; 1; 0.9; cc by nc sa license|licence? 4 *
cc-by-nc-nd-3; cc; 1; 0.9; cc by nc nd license|licence? 3 *
cc-by-nc-nd-4; cc; 1; 0.9; cc by nc nd license|licence? 4 *
cc-by; cc; 2; 0.8; cc by
cc-by-sa; cc; 2; 0.8; cc by sa
cc-by-nd; cc; 2; 0.8; cc by nd
cc-by-nc-sa; cc; 2; 0.8; cc by nc sa
cc-by-nc-nd; cc; 2; 0.8; cc by nc nd
cc-by-3; attribution; 1; 0.9; creative commons attribution unported? license|licence? 3 *
cc-by-4; attribution; 1; 0.9; creative commons attribution international? license|licence? 4 *
cc-by-sa-3; attribution; 1; 0.9; creative commons attribution sharealike|share alike? unported? license|licence? 3 *
cc-by-sa-4; attribution; 1; 0.9; creative commons attribution sharealike|share alike? international? license|licence? 4 *
cc-by-nc-4; attribution; 1; 0.9; creative commons attribution noncommercial international? license|licence? 4 *
cc-by; attribution; 2; 0.8; creative commons attribution
cc-by-sa; attribution; 2; 0.8; creative commons attribution sharealike|share alike?
cc-by-nd; attribution; 2; 0.8; creative commons attribution noderivatives|noderivs
cc-by-nc; attribution; 2; 0.8; creative commons attribution noncommercial
cc-by-nc-sa; attribution; 2; 0.8; creative commons attribution noncommercial sharealike
cc-by-nc-nd; attribution; 2; 0.8; creative commons attribution noncommercial noderivatives|noderivs
creative-commons; creative; 3; 0.5; creative commons license|licence
public-domain; domain; 2; 0.7; public domain dedication
public-domain; domain; 2; 0.7; dedicated|released in|into|to the public domain
all-rights-reserved; reserved; 3; 0.4; all rights reserved
proprietary; proprietary; 3; 0.4; proprietary and confidential
unknown-license; licensed; 3; 0.4; licensed under
unknown-license; license; 3; 0.4; see the? license file
unknown-license; license; 3; 0.4; terms of the? license
unknown-license; licence; 3; 0.4; terms of the? licence
"""  # fmt: skip


def unit(phrase: str) -> str:
    """A phrase's regular expression over the searched form."""
    out = []
    for w in phrase.split():
        core, maybe = w.removesuffix("?"), w.endswith("?")
        body = " [0-9] " if w == "*" else f" (?:{core}) " if "|" in core else f" {core} "
        out.append(f"(?:{body})?" if maybe or w == "*" else body)
    return "".join(out)


def example(phrase: str) -> str:
    """A text that the phrase matches: first alternatives, no optional words."""
    return " ".join(w.split("|")[0] for w in phrase.split() if w != "*" and not w.endswith("?"))


def signatures() -> list[tuple[str, str, int, float, str]]:
    """(label, keyword, priority, weight, phrase) in order: the base phrases, then RULES."""
    base = [(label, {"mit": "mit", "apache-2": "apache", "cc-by-nc": "cc"}[label], 0, 1.0, phrase) for phrase, label in BASE.items()]
    return base + [(a, k, int(p), float(w), phrase) for a, k, p, w, phrase in (line.split("; ") for line in RULES.strip().split("\n"))]


def rules() -> list[Rule]:
    return [Rule(label, unit(phrase), f" {keyword} ", priority, weight) for label, keyword, priority, weight, phrase in signatures()]


def searched(text: Column) -> Column:
    """The text as " w " units."""
    spaced = F.regexp_replace(F.concat(F.lit("\n"), ascii_lower(text), F.lit("\n")), NON_WORD, "  ")
    return F.regexp_replace(spaced, "^ | $", "")


def _rule_table(table: list[Rule]) -> Column:
    row = lambda k, r: F.struct(F.lit(r.label).alias("label"), F.lit(r.pattern).alias("rx"), F.lit(r.keyword.strip()).alias("kw"), F.lit(r.priority).alias("priority"), F.lit(r.weight).alias("weight"), F.lit(k).alias("nr"))
    return F.array(*(row(k, r) for k, r in enumerate(table)))


def _places(form: Column, rule: Column) -> Column:
    """The rule's matches as (start, end) in words: marked in the text, then found among its words."""
    parts = F.split(F.trim(F.regexp_replace(form, rule["rx"], F.lit(" \u0001 $0 \u0002 "))), " +")
    at = lambda mark, skip: F.transform(F.filter(F.transform(parts, lambda w, i: F.when(w == F.lit(mark), i)), lambda x: x.isNotNull()), lambda x, j: (x - 2 * j - skip).cast("long"))
    return F.transform(F.arrays_zip(at("\u0001", 0).alias("start"), at("\u0002", 1).alias("end")), lambda x: F.struct(
        x["start"].alias("start"), (-x["end"]).alias("minus_end"), rule["priority"].alias("priority"), rule["nr"].alias("nr"), rule["label"].alias("label"), rule["weight"].alias("weight")))


def scan(docs: DataFrame, table: list[Rule] | None = None) -> DataFrame:
    """docs (text, others) with n_words, found (all matches) and kept (those not suppressed), in order of place.

    Matches of one rule do not overlap each other. Null text counts as empty; texts without words have no matches; very
    long texts are read whole; equal rows have equal results and empty tables none. The document's other columns stay,
    whatever their names, except that columns named n_words, found or kept are replaced."""
    check_columns(docs, "text")
    known = table if table is not None else rules()
    levels = 1 + max((r.priority for r in known), default=0)
    text = F.coalesce("row.text", F.lit(""))
    kind = "array<struct<start:bigint,minus_end:bigint,priority:int,nr:int,label:string,weight:double>>"
    own = [c for c in docs.columns if c not in ("n_words", "found", "kept")]
    back = [F.col("row").getField(c).alias(c) for c in own]
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row")).withColumn("form", searched(text)).withColumn("words", F.split(F.trim("form"), "  "))
    df = df.withColumn("n_words", F.when(F.col("form") == "", 0).otherwise(F.size("words")).cast("long"))
    if not known:
        return df.select(*back, "n_words", F.array().cast(kind).alias("found"), F.array().cast(kind).alias("kept"))
    # one pass over the words says which keywords stand in the text, whatever the number of rules
    there = F.array_intersect(F.array(*(F.lit(w) for w in dict.fromkeys(r.keyword.strip() for r in known))), "words")
    df = df.withColumn("there", there).drop("words")
    df = df.withColumn("hits", F.when(F.size("there") > 0, F.filter(_rule_table(known), lambda r: F.array_contains("there", r["kw"]) & F.rlike(F.col("form"), r["rx"]))))
    found = F.array_sort(F.flatten(F.transform("hits", lambda r: _places(F.col("form"), r))))
    df = df.withColumn("found", F.when(F.size("hits") > 0, found).otherwise(F.array().cast(kind)))
    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), levels).alias("to"), F.array().cast(kind).alias("kept"))

    def step(acc: Column, d: Column) -> Column:
        free = F.array_max(F.slice(acc["to"], F.lit(1), d["priority"] + 1)) < -d["minus_end"]
        to = F.transform(acc["to"], lambda x, p: F.when(p == d["priority"], F.greatest(x, -d["minus_end"])).otherwise(x))
        return F.struct(to.alias("to"), F.when(free | (d["priority"] == 0), F.concat(acc["kept"], F.array(d))).otherwise(acc["kept"]).alias("kept"))

    return df.withColumn("kept", F.aggregate("found", start, step, lambda acc: acc["kept"])).select(*back, "n_words", "found", "kept")


def licenses(docs: DataFrame) -> DataFrame:
    """One row per row of docs: words, base places, base and all labels, score (the greatest weight kept, else 0)."""
    s = scan(docs.select("doc_id", "text"))
    base = F.filter("found", lambda d: d["priority"] == 0)
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ",")
    s = s.withColumn("base", base)
    return s.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda d: d["start"])).alias("first_word"), F.array_max(F.transform("base", lambda d: d["start"])).alias("last_word"),
        names(F.col("base")).alias("base_labels"), names(F.col("kept")).alias("labels"),
        F.coalesce(F.array_max(F.transform("kept", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(read(spark, sf_dir, "documents"))


def _sql() -> str:
    values = ", ".join(f"({k}, '{r.label}', '{r.pattern}', '{r.keyword}', {r.priority}, {r.weight}::DOUBLE)" for k, r in enumerate(rules()))
    return rf"""
WITH rules(nr, label, rx, kw, priority, weight) AS (VALUES {values}),
d AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_replace(chr(10) || translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || chr(10), '[^0-9a-z\x80-\x{{10FFFF}}]+', '  ', 'g') AS spaced FROM documents),
f AS (SELECT k, doc_id, substr(spaced, 2, length(spaced) - 2) AS form FROM d),
m AS (
  SELECT f.k, r.*, form, regexp_extract_all(form, rx) AS ms, string_split_regex(form, rx) AS gaps
  FROM f JOIN rules r ON contains(form, r.kw) AND regexp_matches(form, r.rx)),
p AS (
  SELECT k, nr, label, priority, weight, ms[i] AS hit, array_to_string(gaps[1:i], '') || array_to_string(ms[1:i - 1], '') AS before FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)),
w AS (
  SELECT k, nr, label, priority, weight, (length(before) - length(replace(before, ' ', ''))) // 2 AS s, (length(before) - length(replace(before, ' ', '')) + length(hit) - length(replace(hit, ' ', ''))) // 2 AS e FROM p),
kept AS (
  SELECT * FROM w a WHERE priority = 0 OR NOT EXISTS (
    SELECT 1 FROM w b WHERE b.k = a.k AND b.priority <= a.priority AND b.s <= a.s AND b.e >= a.e AND (b.s, -b.e, b.priority, b.nr) < (a.s, -a.e, a.priority, a.nr))),
b AS (SELECT k, count(*) AS n, min(s) AS lo, max(s) AS hi, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM w WHERE priority = 0 GROUP BY k),
l AS (SELECT k, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(weight) AS score FROM kept GROUP BY k)
SELECT f.doc_id, ((length(form) - length(replace(form, ' ', ''))) // 2)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(l.labels, '') AS labels, coalesce(l.score, 0.0)::DOUBLE AS score
FROM f LEFT JOIN b USING (k) LEFT JOIN l USING (k)
"""


SQL = _sql()
