"""License scans by ordered signature rules, in Spark expressions only.

A rule is a regular expression with a label, a keyword and a tier: exact identifiers and addresses come
first, then notices, then names, then mere clues. A text is split into words once; it is tried against a
rule only if all words of one of the rule's keywords are among them, alone or with a version behind them
(``gplv2``); every branch of a pattern has a keyword in it. Of all detections, one that lies inside another of the same or an earlier tier is
suppressed (equal spans: the earlier rule stays). Nothing is shuffled: a row carries its detections.

Rules are written once for each family of licenses, as name, versions and address, and multiplied out
over the forms in which licenses are stated.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Word characters of the base phrases; only A-Z count as upper case.
W = r"0-9A-Za-z\x{80}-\x{10FFFF}"
WORD = f"[{W}]+"
#: All other characters one by one, which the pattern compiler turns into a table.
BETWEEN = "[" + "".join(f"\\x{c:02X}" for c in range(128) if not chr(c).isalnum()) + "]+"
GAP = f"[^{W}]+"
# Base phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Label, identifier, name (a regular expression), keywords of the name, versions, address (a regular expression or none).
FAMILIES = (
    ("apache", "Apache", r"apache(?: software)?", "apache", ("1.0", "1.1", "2.0"), r"apache\.org/licenses"),
    ("gpl", "GPL", r"(?:gnu )?general public|gnu gpl|gpl", "general public|gpl", ("1.0", "2.0", "3.0"), r"gnu\.org/(?:licenses|copyleft)/gpl"),
    ("lgpl", "LGPL", r"(?:gnu )?(?:lesser|library) general public|gnu lgpl|lgpl", "lesser|library|lgpl", ("2.0", "2.1", "3.0"), r"gnu\.org/(?:licenses|copyleft)/(?:lgpl|lesser)"),
    ("agpl", "AGPL", r"(?:gnu )?affero general public|gnu agpl|agpl", "affero|agpl", ("1.0", "3.0"), r"gnu\.org/licenses/agpl"),
    ("gfdl", "GFDL", r"gnu free documentation|gfdl", "free documentation|gfdl", ("1.1", "1.2", "1.3"), r"gnu\.org/licenses/fdl"),
    ("mit", "MIT", r"mit|expat", "mit|expat", (), r"opensource\.org/licenses/mit"),
    ("bsd-2-clause", "BSD-2-Clause", r"(?:simplified|freebsd|2-clause) bsd|bsd 2-clause", "bsd", (), r"opensource\.org/licenses/bsd-2-clause"),
    ("bsd-3-clause", "BSD-3-Clause", r"(?:new|revised|modified|3-clause) bsd|bsd 3-clause", "bsd", (), r"opensource\.org/licenses/bsd-3-clause"),
    ("bsd-4-clause", "BSD-4-Clause", r"(?:original|4-clause) bsd|bsd 4-clause", "bsd", (), None),
    ("isc", "ISC", r"isc", "isc", (), r"opensource\.org/licenses/isc"),
    ("mpl", "MPL", r"mozilla public|mpl", "mozilla|mpl", ("1.0", "1.1", "2.0"), r"mozilla\.org/(?:mpl|en-us/mpl)"),
    ("epl", "EPL", r"eclipse public|epl", "eclipse|epl", ("1.0", "2.0"), r"eclipse\.org/(?:legal/)?epl"),
    ("eupl", "EUPL", r"european union public|eupl", "european union|eupl", ("1.0", "1.1", "1.2"), r"joinup\.ec\.europa\.eu/\S*eupl"),
    ("cddl", "CDDL", r"common development and distribution|cddl", "distribution|cddl", ("1.0", "1.1"), r"opensource\.org/licenses/cddl"),
    ("cpl", "CPL", r"common public", "common public", ("1.0",), r"opensource\.org/licenses/cpl"),
    ("artistic", "Artistic", r"artistic", "artistic", ("1.0", "2.0"), r"opensource\.org/licenses/artistic"),
    ("boost", "BSL", r"boost software", "boost", ("1.0",), r"boost\.org/license"),
    ("zlib", "Zlib", r"zlib(?:/libpng)?", "zlib", (), r"opensource\.org/licenses/zlib"),
    ("openssl", "OpenSSL", r"openssl", "openssl", (), r"openssl\.org/source/license"),
    ("postgresql", "PostgreSQL", r"postgresql", "postgresql", (), r"opensource\.org/licenses/postgresql"),
    ("python", "Python", r"python software foundation|psf", "python|psf", ("2.0",), r"docs\.python\.org/\S*license"),
    ("php", "PHP", r"php", "php", ("3.0", "3.01"), r"php\.net/license"),
    ("ruby", "Ruby", r"ruby", "ruby", (), r"ruby-lang\.org/\S*license"),
    ("ofl", "OFL", r"sil open font|open font|ofl", "open font|ofl", ("1.0", "1.1"), r"scripts\.sil\.org/ofl"),
    ("unlicense", "Unlicense", r"unlicense", "unlicense", (), r"unlicense\.org"),
    ("wtfpl", "WTFPL", r"wtfpl|do what the f\w+ you want to public", "wtfpl|what want public", (), r"wtfpl\.net"),
    ("odbl", "ODbL", r"open database|odbl", "open database|odbl", ("1.0",), r"opendatacommons\.org/licenses/odbl"),
    ("odc-by", "ODC-By", r"open data commons attribution|odc-by", "open data commons|odc-by", ("1.0",), r"opendatacommons\.org/licenses/by"),
    ("pddl", "PDDL", r"public domain dedication and license|pddl", "dedication|pddl", ("1.0",), r"opendatacommons\.org/licenses/pddl"),
    ("ms-pl", "MS-PL", r"microsoft public|ms-pl", "microsoft public|ms-pl", (), r"opensource\.org/licenses/ms-pl"),
    ("ms-rl", "MS-RL", r"microsoft reciprocal|ms-rl", "microsoft reciprocal|ms-rl", (), r"opensource\.org/licenses/ms-rl"),
    ("sspl", "SSPL", r"server side public|sspl", "server side|sspl", ("1.0",), r"mongodb\.com/licensing/server-side-public-license"),
    ("busl", "BUSL", r"business source", "business source", ("1.1",), r"mariadb\.com/bsl"),
    ("cc0", "CC0", r"cc0|creative commons zero", "cc0|commons zero", ("1.0",), r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", "CC-BY", r"cc[ -]by|creative commons attribution(?! ?-? ?(?:share|non|no))", "cc|creative commons", ("1.0", "2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by"),
    ("cc-by-sa", "CC-BY-SA", r"cc[ -]by[ -]sa|creative commons attribution ?-? ?share ?-?alike", "cc|creative commons", ("1.0", "2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by-sa"),
    ("cc-by-nc", "CC-BY-NC", r"cc[ -]by[ -]nc|creative commons attribution ?-? ?non ?-?commercial", "cc|creative commons", ("1.0", "2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by-nc"),
    ("cc-by-nd", "CC-BY-ND", r"cc[ -]by[ -]nd|creative commons attribution ?-? ?no ?-?deriv\w*", "cc|creative commons", ("1.0", "2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by-nd"),
    ("cc-by-nc-sa", "CC-BY-NC-SA", r"cc[ -]by[ -]nc[ -]sa", "cc", ("1.0", "2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by-nc-sa"),
    ("cc-by-nc-nd", "CC-BY-NC-ND", r"cc[ -]by[ -]nc[ -]nd", "cc", ("1.0", "2.0", "2.5", "3.0", "4.0"), r"creativecommons\.org/licenses/by-nc-nd"),
)
# Label, pattern, keyword, tier of rules that stand alone.
SINGLE = (
    ("mit", r"permission is hereby granted, free of charge, to any person", "hereby granted", 1),
    ("isc", r"permission to use, copy, modify, and/or distribute this software", "permission use", 1),
    # The holder's name has any length and lines; of several beginnings the last before the end counts, and runs of blanks are read once.
    ("bsd-3-clause", r"neither the name of +(?s:(?!neither the name of).)+?(?<!\s) may be used to endorse", "endorse", 1),
    ("bsd", r"redistribution and use in source and binary forms", "redistribution", 2),
    ("apache-2.0", r"you may not use this file except in compliance with the license", "compliance license", 1),
    ("gpl", r"this program is free software[;:,] you can redistribute it", "free software", 2),
    ("gpl", r"without even the implied warranty of merchantability", "merchantability", 3),
    ("public-domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain", 1),
    ("public-domain", r"public domain", "public domain", 3),
    ("warranty-disclaimer", r"provided ['\"]?as is['\"]?,? without (?:any )?warranty", "warranty", 3),
    ("reserved", r"all rights reserved", "reserved", 3),
    ("copyright", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d(?: ?[-,] ?(?:19|20)?\d\d)*", "copyright", 3),
    ("copyright", r"(?:\(c\)|©) ?(?:19|20)\d\d", "c|©", 3),
    ("copyright", r"copyright", "copyright", 3),
    ("license-statement", r"(?:licensed|released|distributed|published) under", "under", 3),
    ("license-statement", r"see (?:the )?licen[cs]e(?: file)?", "license|licence", 3),
    ("proprietary", r"(?:confidential and )?proprietary(?: and confidential)?", "proprietary", 3),
    ("proprietary", r"unauthori[sz]ed (?:copying|use|reproduction)", "unauthorised|unauthorized", 3),
    ("creative-commons", r"creative commons", "creative commons", 3),
    ("non-commercial", r"non-?commercial (?:use )?only", "commercial|noncommercial", 3),
)
SCORES = (1.0, 0.9, 0.7, 0.4)


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str  # several are separated by a bar
    tier: int


def _bounded(pattern: str) -> str:
    return f"(?i)(?<![{W}])" + f"(?:{pattern})".replace(" ", r"\s+").replace(r"\s+?", r"\s*") + f"(?![{W}])"


def rules() -> list[Rule]:
    """All rules in order."""
    out = []
    for label, ident, name, keyword, versions, address in FAMILIES:
        bare = rf"the )?(?:{name})(?: licen[cs]e"
        for version in (*versions, None):
            full = f"{label}-{version}" if version else label
            tail = "" if version is None else rf"[,( ]*(?:version |v\.? ?|-)?{version.replace('.', '[.]')}"
            if version and version.endswith(".0"):
                tail = rf"[,( ]*(?:version |v\.? ?|-)?{version[:-2]}(?:[.]0)?(?![.]?[0-9])"
            spdx = f"{ident}-{version}" if version else ident
            out.append(Rule(full, rf"spdx-license-identifier: ?{spdx}(?:-only|-or-later|[+])?", f"spdx license identifier {ident.split('-')[0].lower()}", 0))
            out.append(Rule(full, rf"(?:licensed|released|distributed|published|available) under (?:{bare})?{tail}", _with(keyword, "under"), 1))
            out.append(Rule(full, rf"(?:{bare}){tail}", _with(keyword, "license", "licence"), 2))
            if version:
                out.append(Rule(full, rf"(?:{name}){tail}", keyword, 2))
            if address:
                place = rf"(?:https?://)?(?:www\.)?{address}[-/a-z]*{version.replace('.', '[.]')}" if version else rf"(?:https?://)?(?:www\.)?{address}"
                out.append(Rule(full, place, address.split("\\")[0], 0 if version else 1))
    out += [Rule(*x) for x in SINGLE]
    return out


def _phrase(text: str) -> str:
    return GAP.join(text.split())


BASE = f"(?i)(?<![{W}])(?:" + "|".join(_phrase(p) for p, _ in PHRASES) + f")(?![{W}])"
DETECTION = "array<struct<start:int,stop:int,tier:int,rule:int,label:string>>"


def _forms(word: str) -> list[str]:
    """A keyword's word as it may stand in a text: alone, or run together with a version."""
    if word == "©":  # a word character here, so that a year may follow it
        return [word, *(f"{word}{year}" for year in range(1900, 2100))]
    return [word, *(f"{word}{v}{n}" for v in ("", "v", "version") for n in ("", *range(10)) if v or n != "")]


def _alternatives(keyword: str) -> list[list[str]]:
    return [[w for w in re.split("[^0-9a-z©]+", phrase) if w and w != "by"] for phrase in keyword.split("|")]


def _with(keyword: str, *more: str) -> str:
    """Every alternative of a keyword together with one of some further words."""
    return "|".join(f"{k} {m}" for k in keyword.split("|") for m in more)


def _opened(keyword: str, present: Column) -> Column:
    """Whether all words of one of the keywords are present."""
    return reduce(or_, [reduce(and_, [F.array_contains(present, w) for w in words]) for words in _alternatives(keyword)])


def keyword_words(words: Column) -> Column:
    """Those of a text's lower-case words that some gate asks for, without versions behind them too."""
    asked = sorted({f for r in rules() for words in _alternatives(r.keyword) for w in words for f in _forms(w)})
    bare = lambda w: F.regexp_replace(w, "(?<=^©).*$|(?:v|version)?[0-9]?$", "")
    return F.array_distinct(F.flatten(F.transform(F.filter(words, lambda w: w.isin(asked)), lambda w: F.array(w, bare(w)))))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _detections(text: Column, present: Column) -> Column:
    """All detections of the rules whose keyword occurs."""
    groups: dict[str, list[dict]] = {}
    for j, r in enumerate(rules()):
        groups.setdefault(r.keyword, []).append({"pattern": _bounded(r.pattern), "label": r.label, "tier": r.tier, "rule": j})
    table = F.from_json(F.lit(json.dumps(list(groups.values()))), "array<array<struct<pattern:string,label:string,tier:int,rule:int>>>")
    opened = F.array_compact(F.array(*[F.when(_opened(k, present), F.lit(j + 1)) for j, k in enumerate(groups)]))
    tried = F.flatten(F.transform(opened, lambda j: F.element_at(table, j)))

    def cut(r: Column, found: Column) -> Column:
        between = F.slice(F.split(text, r["pattern"], -1), F.lit(1), F.size(found))

        def add(done: Column, x: Column) -> Column:
            start = done["at"] + F.length(x["between"])
            stop = start + F.length(x["found"])
            one = F.struct(start.alias("start"), stop.alias("stop"), r["tier"].alias("tier"), r["rule"].alias("rule"), r["label"].alias("label"))
            return F.struct(stop.alias("at"), F.concat(done["out"], F.array(one)).alias("out"))

        zipped = F.zip_with(between, found, lambda a, b: F.struct(a.alias("between"), b.alias("found")))
        begin = F.struct(F.lit(0).alias("at"), none.alias("out"))
        return F.aggregate(zipped, begin, add, lambda done: done["out"])

    none = F.array().cast(DETECTION)
    found = lambda r: F.regexp_extract_all(text, r["pattern"], F.lit(0))
    each = F.transform(tried, lambda r: let(found(r), lambda x: F.when(F.size(x) > 0, cut(r, x)).otherwise(none)))
    return F.when(F.size(present) > 0, F.flatten(each)).otherwise(none)


def _surviving(found: Column) -> Column:
    """Without the detections that lie inside another of the same or an earlier tier."""
    ordered = F.transform(
        F.array_sort(F.transform(found, lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("back"), d["tier"].alias("tier"), d["rule"].alias("rule"), d["label"].alias("label")))),
        lambda d: F.struct(d["start"].alias("start"), (-d["back"]).alias("stop"), d["tier"].alias("tier"), d["rule"].alias("rule"), d["label"].alias("label")),
    )
    tiers = range(len(SCORES))

    def step(done: Column, d: Column) -> Column:
        reach = F.greatest(*[F.when(d["tier"] >= t, done[f"t{t}"]).otherwise(-1) for t in tiers])
        ends = [F.when(d["tier"] == t, F.greatest(done[f"t{t}"], d["stop"])).otherwise(done[f"t{t}"]).alias(f"t{t}") for t in tiers]
        kept = F.when(reach >= d["stop"], done["out"]).otherwise(F.concat(done["out"], F.array(d)))
        return F.struct(*ends, kept.alias("out"))

    begin = F.struct(*[F.lit(-1).alias(f"t{t}") for t in tiers], F.array().cast(DETECTION).alias("out"))
    return F.aggregate(ordered, begin, step, lambda done: done["out"])


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def _says(found: str, phrase: str) -> Column:
    return F.exists(found, lambda x: x.rlike("(?i)^" + _phrase(phrase) + "$"))


def scan(docs: DataFrame, text_col: str = "text", into: str = "license") -> DataFrame:
    """Add ``into``: n_words, n_base, first_word, last_word, base_labels, labels, score and the detections.

    Detections are character spans of the text (start, stop, tier, rule number, label), suppressed ones
    left out. A null text counts as empty: no words, no labels, score 0. Rows and other columns stay; a column
    named as ``into`` is replaced.
    """
    kept = [c for c in docs.columns if c != into]
    text, words, present = F.col("__text"), F.col("__words"), F.col("__present")
    rows = docs.select("*", F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    # Lower-casing turns letters into letters, so the words keep their number; empty ones stand at the ends only.
    rows = rows.select("*", F.split(F.lower("__text"), BETWEEN, -1).alias("__words"))
    outside = F.when(F.get(words, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    rows = rows.select(*kept, "__text", (F.size(words) - outside).cast("bigint").alias("__n"), keyword_words(words).alias("__present"))
    has = lambda *ws: reduce(and_, [F.array_contains(present, w) for w in ws])
    gate = has("cc") | has("public", "license") | has("reserved")
    rows = rows.select(
        *kept, "__text", "__n", _detections(text, present).alias("__all"),
        F.when(gate, F.regexp_extract_all(text, F.lit(BASE), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("__base"),
    )
    some = F.size("__base") > 0
    pieces = F.split(text, BASE, -1)
    rows = rows.select(
        *kept, "__n", "__base", _surviving(F.col("__all")).alias("__kept"),
        F.when(some, _words(F.get(pieces, F.lit(0)))).alias("__first"),
        F.when(some, F.col("__n") - _words(F.element_at(pieces, -1)) - _words(F.element_at("__base", -1))).alias("__last"),
    )
    base = F.array_sort(F.array_compact(F.array(*[F.when(_says("__base", p), F.lit(label)) for p, label in PHRASES])))
    labels = F.array_sort(F.array_union(base, F.transform("__kept", lambda d: d["label"])))
    best = F.array_min(F.transform("__kept", lambda d: d["tier"]))
    graded = F.element_at(F.array(*map(F.lit, SCORES)), F.coalesce(best, F.lit(0)) + 1)
    score = F.when(best.isNotNull(), graded).when(some, SCORES[-1]).otherwise(0.0)
    return rows.select(
        *kept,
        F.struct(
            F.col("__n").alias("n_words"), F.size("__base").cast("bigint").alias("n_base"), F.col("__first").alias("first_word"), F.col("__last").alias("last_word"),
            F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), F.col("__kept").alias("detections"),
        ).alias(into),
    )
