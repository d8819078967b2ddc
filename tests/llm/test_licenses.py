"""License rules: each branch of a pattern passes the gate in front of it, whatever blanks stand in it."""

import re
from re import _parser as parser

from pyspark.sql import functions as F

from foldwise.llm import licenses


def forms(parsed, blank):
    """Texts of a parsed pattern that together take each of its branches."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            own = [blank if chr(arg) == " " else chr(arg)]
        elif name == "NOT_LITERAL":
            own = ["x"]
        elif name == "ANY":
            own = ["x"]
        elif name == "IN":
            kind, first = arg[0]
            own = ["x"] if str(kind) == "NEGATE" else [{"CATEGORY_DIGIT": "7", "CATEGORY_WORD": "x", "CATEGORY_NOT_SPACE": "x"}[str(first)] if str(kind) == "CATEGORY" else chr(first[0] if str(kind) == "RANGE" else first)]
        elif name == "BRANCH":
            own = [f for branch in arg[1] for f in forms(branch, blank)]
        elif name == "SUBPATTERN":
            own = forms(arg[3], blank)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, _, body = arg
            own = [f * max(low, 1) for f in forms(body, blank)] + [""] * (low == 0)
        else:
            assert name == "ASSERT_NOT"
            continue
        # Not the product of all: each form of one part meets the first form of the others.
        out = [o + own[0] for o in out] + [out[0] + f for f in own[1:]]
    return out


def test_every_rule_passes_its_gate(spark):
    rules = licenses.rules()
    texts = [(j, f) for j, r in enumerate(rules) for blank in ("\n", "  ", " \n\t") for f in forms(parser.parse(r.pattern), blank)]
    keywords = list(dict.fromkeys(r.keyword for r in rules))
    assert {j for j, _ in texts} == set(range(len(rules)))
    for cased in (str.lower, str.upper):
        table = spark.createDataFrame([(j, cased(f)) for j, f in texts], "rule int, text string").repartition(8)
        table = table.withColumn("present", licenses.keyword_words(F.split(F.lower("text"), licenses.BETWEEN, -1)))
        gates = F.array(*[licenses._opened(k, F.col("present")) for k in keywords])
        patterns = [licenses._bounded(r.pattern) for r in rules]
        found = table.withColumn("pattern", F.element_at(F.array(*map(F.lit, patterns)), F.col("rule") + 1))
        found = found.select("rule", "text", F.regexp_like("text", F.col("pattern")).alias("matches"), gates.alias("gates")).collect()
        matching = [r for r in found if r.matches]
        assert {r.rule for r in matching} == set(range(len(rules)))
        assert [(rules[r.rule].pattern, r.text) for r in matching if not r.gates[keywords.index(rules[r.rule].keyword)]] == []


def test_wrapped_notices(spark):
    said = {
        "Permission is hereby\ngranted, free of charge, to any person": "mit",
        "Licensed under the Expat License.": "mit",
        "This is free  software under the GNU General\n  Public License, version 2.0": "gpl-2.0",
        "except in  compliance: you may not use this file except in compliance\n * with": "",
        "you may not use this file except in compliance\nwith the License.": "apache-2.0",
        "(c) 1998 Jane": "copyright", "\u00a9\n1999 Jane": "copyright",
        "placed in the public\ndomain": "public-domain", "a Creative\nCommons work": "creative-commons",
        "Permission  to use, copy, modify, and/or distribute this software": "isc",
    }
    got = {r.text: set(r.license.labels.split(",")) for r in licenses.scan(spark.createDataFrame([(t,) for t in said], "text string")).collect()}
    assert {t: x for t, x in said.items() if x not in got[t]} == {}


def test_bsd_clause_of_any_layout(spark):
    begin, end = "Neither the name of", "may be used to endorse"
    said = {
        f"{begin} the Foo nor the names of its\n contributors {end} or promote": True,
        f"{begin} Foo Inc. nor its contributors {end}": True,
        f" * {begin} the\n * {'very long ' * 40}holder, e.g. Foo Inc.,\n *   nor others\n {end}": True,
        f"{begin} Foo {end}": True,
        f"{begin} " + "x. " * 30000 + end: True,
        f"{begin}" + " \n" * 30000: False,
        f"{begin} " * 20000 + "endorse": False,
        f"{end}. {begin} Foo": False,
    }
    got = {r.text: r.license for r in licenses.scan(spark.createDataFrame([(t,) for t in said], "text string")).collect()}
    assert {t: "bsd-3-clause" in x.labels.split(",") for t, x in got.items()} == said
    assert all(x.score == 0.9 and x.detections[0].stop == len(t) - len(t.partition(end)[2]) for t, x in got.items() if said[t])
    # Of two beginnings the one next to the end counts: a notice between other clauses keeps its label.
    two = f"{begin} Foo shall be named. Released under the MIT License. {begin} Bar Inc. {end} this"
    (row,) = licenses.scan(spark.createDataFrame([(two,)], "text string")).collect()
    assert {"mit", "bsd-3-clause"} <= set(row.license.labels.split(","))
