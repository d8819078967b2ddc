"""Personal data by weak supervision.

Patterns propose spans. Five labelers vote on each: form (a stricter pattern), checksum, gazetteer (domains, issuers,
country codes, given names), context (words around the span) and edges (what touches it). A vote is for, against
or none. Votes and two coarse features make up a span's pattern number, of which there is a fixed number; their
counts over all texts are all that leaves the tasks. Expectation-maximisation over these counts estimates for each kind
how reliable each labeler is, and with that how likely a pattern is personal data. A logistic regression on
votes, kind, length and share of digits is trained on these soft labels; it decides about the spans.

The base kinds' own rules need no vote: their spans always stay. Others are added where the classifier's probability is
at least ``SURE``. Patterns run in time proportional to the text: repeated parts give nothing back.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.words import session_limits
from foldwise.session import settle

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id", "name")
LABELERS = ("form", "checksum", "gazetteer", "context", "edges")
SURE = 0.9
#: Share of personal data with a wrong checksum, which is set and not learned, and weight of a vote pattern that was not seen.
WRONG_CHECKSUM, UNSEEN = 1e-4, 0.1
RIDGE = 0.01
AROUND = 40
FOUND = "array<struct<kind:int,start:int,stop:int,base:boolean,pattern:int>>"

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DIGIT = re.compile("[0-9]")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Parts of a match that fails as a whole, e.g. because the next number follows after a blank.
PHONE_PART = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]{3}[ .-][0-9]{4}(?![0-9])")
CARD_PART = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4})(?![0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+(])(?:\([0-9]{2,5}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Madame", "Monsieur", "Señor", "Señora")
GIVEN = (
    "James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "William", "Elizabeth", "David", "Barbara", "Richard", "Susan", "Joseph",
    "Thomas", "Sarah", "Charles", "Karen", "Daniel", "Nancy", "Matthew", "Lisa", "Anthony", "Emily", "Hans", "Klaus", "Jürgen", "Ursula", "Monika", "Petra",
    "Jean", "Pierre", "Marie", "François", "Nathalie", "Isabelle", "José", "Carlos", "María", "Carmen", "Antonio", "Manuel", "Ana", "Jane", "Anna", "Peter",
)
NAME = re.compile(rf"\b(?:(?:{'|'.join(TITLES)})\.? (?:[A-ZÀ-Þ][a-zß-ÿ]{{1,20}} )?|(?:{'|'.join(GIVEN)}) )[A-ZÀ-Þ][a-zß-ÿ]{{1,20}}\b")
STARTS = re.compile(rf"\b(?:{'|'.join(sorted((*TITLES, *GIVEN)))})\b")
DOMAINS = frozenset("com org net edu gov info io de fr es it uk us ca ch at nl be pl eu co int mil".split())
COUNTRIES = tuple("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 98 212 351 353 358 380 420 971 972".split())
ISSUERS = re.compile("4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38")
SAYS = {
    "email": r"e-?mail|mail|contact|write|courriel|correo|@", "ip": r"\bip\b|address|host|server|login|adresse", "card": r"card|visa|master|credit|karte|carte|tarjeta",
    "phone": r"phone|tel\b|call|mobile|fax|telefon|téléphone|teléfono", "iban": r"iban|account|bank|konto|compte|cuenta", "national_id": r"ssn|social security|national id",
    "name": r"name|contact|signed|dear|author|from|nom\b|nombre",
}
SAYS = {k: re.compile(v) for k, v in SAYS.items()}
SAYS_NOT = re.compile(r"version|isbn|order|token|secret|api|sha|hash|serial|invoice|release|\bid\b|example only")
STRICT = {
    "email": re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,62}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"),
    "ip": re.compile(r"(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})"),
    "card": re.compile(r"[0-9]{13,19}|[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4}){2}|3[0-9]{3}([ -])[0-9]{6}\2[0-9]{5}"),
    "phone": re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?)?[0-9]+(?:[ .-][0-9]+)*|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}"),
    "iban": re.compile(r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4})+(?: [A-Z0-9]{1,3})?)"),
    "national_id": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
    "name": re.compile(rf"(?:{'|'.join(TITLES)})\.? .+"),
}


def luhn(digits: str) -> bool:
    double = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in double)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        left = text[free:at]
        start = free + len(left.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if domain:
            out.append((start, domain.end()))
            free = domain.end()
        at = text.find("@", free)
    return out


def addresses(text: str) -> list[tuple[int, int, bool]]:
    """Four numbers joined by dots, and whether all are at most 255."""
    out = []
    for m in DOTTED.finditer(text):
        if m.group().count(".") >= 3:
            at, parts = m.start(), m.group().split(".")
            for j in range(0, len(parts) - 3, 4):
                four = parts[j : j + 4]
                stop = at + sum(map(len, four)) + 3
                out.append((at, stop, all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four)))
                at = stop + 1
    return out


def proposals(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, stop, whether it is a base span): base kinds first, each kind from left to right."""
    out = [("email", a, b, True) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        if text.count(".") > 2:
            out += [("ip", *x) for x in addresses(text)]
        for m in NUMBER.finditer(text):
            if m.end() - m.start() >= 13:
                if 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
                    out.append(("card", *m.span(), True))
                else:
                    out += [("card", *part.span(), False) for part in CARD_PART.finditer(text, *m.span())]
        phones = []
        if "+" in text:
            for m in PLUS.finditer(text):
                if 9 <= len(_digits(m.group())) <= 15:
                    phones.append((*m.span(), True))
                elif part := PHONE_PART.match(text, *m.span()):
                    phones.append((*part.span(), False))
        taken = [(a, b) for kind, a, b, base in out if base] + [(a, b) for a, b, _ in phones]
        more = [(kind, *m.span()) for kind, p in (("phone", LOCAL_PHONE), ("iban", IBAN), ("national_id", NATIONAL)) for m in p.finditer(text)]
        more = [x for x in more if not any(a < x[2] and x[1] < b for a, b in taken)] if len(taken) * len(more) < 10_000 else _apart(more, taken)
        out += sorted([("phone", *x) for x in phones] + [(*x, False) for x in more if x[0] == "phone"], key=lambda x: x[1])
        out += [(*x, False) for x in more if x[0] != "phone"]
    if STARTS.search(text):
        out += [("name", *m.span(), False) for m in NAME.finditer(text)]
    return out


def _apart(spans: list[tuple], taken: list[tuple[int, int]]) -> list[tuple]:
    """Those spans that touch none of many others."""
    first = np.array(sorted(taken))
    reach = np.maximum.accumulate(first[:, 1])
    return [x for x in spans if not (k := int(np.searchsorted(first[:, 0], x[2]))) or reach[k - 1] <= x[1]]


def votes(kind: str, text: str, start: int, stop: int) -> tuple[int, ...]:
    """1, -1 or 0 of each labeler."""
    span, digits = text[start:stop], _digits(text[start:stop])
    before, after = text[max(0, start - AROUND) : start], text[stop : stop + AROUND // 2]
    form = 1 if STRICT[kind].fullmatch(span) and (kind != "ip" or all(int(p) < 256 for p in span.split("."))) else -1
    checksum = gazetteer = 0
    if kind == "card":
        checksum = 1 if luhn(digits) else -1
        gazetteer = 1 if ISSUERS.match(digits) else -1
    elif kind == "iban":
        moved = span.replace(" ", "")
        checksum = 1 if int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1 else -1
    elif kind == "email":
        gazetteer = 1 if span.rpartition(".")[2].lower() in DOMAINS else -1
    elif kind == "phone":
        gazetteer = (1 if digits.startswith(COUNTRIES) else -1) if span[0] == "+" else 0
    elif kind == "ip":
        gazetteer = -1 if digits.startswith("0") or span.startswith(("0.", "127.")) else 0
    elif kind == "name":
        gazetteer = 1 if any(w in GIVEN for w in span.split()) else 0
    near = (before + " " + after).lower()
    context = (1 if SAYS[kind].search(near) else 0) - (1 if SAYS_NOT.search(near) else 0)
    touched = (before[-1:].isalnum(), after[:1].isalnum())
    joined = before[-1:] in ("-", "_", "/", "=", "#") or after[:1] in ("_", "/", "=") or (after[:1] in (".", "-") and after[1:2].isalnum())
    return form, checksum, gazetteer, context, -1 if any(touched) else 0 if joined else 1


def pattern_number(kind: str, cast: tuple[int, ...], length: int, digits: int) -> int:
    number = KINDS.index(kind)
    for v in cast:
        number = number * 3 + v + 1
    return (number * 4 + min(3, length // 8)) * 3 + min(2, 3 * digits // max(1, length))


def pattern_parts(number: int) -> tuple[int, tuple[int, ...], int, int]:
    """(kind, votes, length class, share of digits) of a pattern number."""
    number, share = divmod(number, 3)
    number, length = divmod(number, 4)
    cast = []
    for _ in LABELERS:
        number, v = divmod(number, 3)
        cast.append(v - 1)
    return number, tuple(cast[::-1]), length, share


def candidates(text: str | None) -> list[tuple]:
    """(kind, start, stop, base, pattern) of every proposal, by kind and start."""
    if not text:
        return []
    out = []
    for kind, start, stop, base in proposals(text):
        if stop - start > 4096:  # judged by its ends: nothing that long is personal data but by the base rules
            pattern = pattern_number(kind, (-1, 0, 0, 0, 0), stop - start, len(_digits(text[start:stop])))
        else:
            pattern = pattern_number(kind, votes(kind, text, start, stop), stop - start, len(_digits(text[start:stop])))
        out.append((KINDS.index(kind), start, stop, base, pattern))
    return out


@dataclass
class SpanModel:
    """Labeler reliabilities by kind, and the classifier's probability of each pattern seen."""

    reliability: dict[str, dict[str, tuple[float, float]]]
    probability: dict[int, float]


def agreement(casts: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, ...]:
    """Expectation-maximisation of one kind: (probability of each vote pattern, truths, votes given the truth).

    ``casts`` has a row of votes per pattern, ``counts`` how often it occurs. Labelers vote independently given the
    truth; a weak prior holds that they are right more often than wrong.
    """
    p = 1 / (1 + np.exp(-casts.sum(axis=1).astype(float)))
    prior = np.repeat(np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])[:, None], casts.shape[1], axis=1)  # truth x labeler x vote
    table = np.zeros((2, casts.shape[1], 3))
    for _ in range(rounds):
        share = np.array([(counts * (1 - p)).sum() + 1, (counts * p).sum() + 1])
        for truth, weight in enumerate((counts * (1 - p), counts * p)):
            for v in (-1, 0, 1):
                table[truth, :, v + 1] = prior[truth, :, v + 1] + (weight[:, None] * (casts == v)).sum(axis=0)
        table /= table.sum(axis=2, keepdims=True)
        table[1, LABELERS.index("checksum"), 0] = WRONG_CHECKSUM
        p = posterior(casts, share, table)
    return p, share, table


def posterior(casts: np.ndarray, share: np.ndarray, table: np.ndarray) -> np.ndarray:
    score = np.log(share) + np.log(table[:, np.arange(casts.shape[1])[None], casts + 1]).sum(axis=2).T
    return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -50, 50)))


def fit(counts: dict[int, int]) -> SpanModel:
    """Reliabilities and classifier from how often each pattern occurs.

    The classifier also learns, with little weight, what the labelers' reliabilities say of votes that no span has.
    """
    numbers = sorted(counts)
    if not numbers:
        return SpanModel({}, {})
    parts = [pattern_parts(n) for n in numbers]
    kind, casts = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    length, share_of = (np.array([p[j] for p in parts]) for j in (2, 3))
    weight, soft, reliability = np.array([counts[n] for n in numbers], float), np.zeros(len(numbers)), {}
    every = np.array(list(itertools.product((-1, 0, 1), repeat=len(LABELERS))))
    unseen = []
    for k in np.unique(kind):
        own = kind == k
        soft[own], share, table = agreement(casts[own], weight[own])
        reliability[KINDS[k]] = {name: (float(table[1, j, 2]), float(table[0, j, 0])) for j, name in enumerate(LABELERS)}
        usual = np.argmax(np.where(own, weight, 0))
        unseen.append((np.full(len(every), k), every, np.full(len(every), length[usual]), np.full(len(every), share_of[usual]), posterior(every, share, table)))

    def features(kind, casts, length, share_of):
        return np.column_stack([kind[:, None] == np.arange(len(KINDS)), casts == 1, casts == -1, length[:, None] == np.arange(4), share_of[:, None] == np.arange(3)]).astype(float)

    seen = features(kind, casts, length, share_of)
    design = np.vstack([seen, *(features(*x[:4]) for x in unseen)])
    soft, weight = np.concatenate([soft, *(x[4] for x in unseen)]), np.append(weight, np.full(len(every) * len(unseen), UNSEEN))
    beta = np.zeros(design.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (p - soft)) + RIDGE * beta
        curvature = (design * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ design + RIDGE * np.eye(len(beta))
        step = np.linalg.solve(curvature, gradient)
        beta -= step
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(seen @ beta, -30, 30)))
    return SpanModel(reliability, dict(zip(numbers, p.tolist())))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, SpanModel]:
    """((id, base, spans), model): spans of personal data in every text, in code points.

    ``base`` and ``spans`` are arrays of (kind, start, stop), by kind as in ``KINDS``, then start; ``spans`` holds the
    base spans and those that the classifier adds. A null or empty text has none; ids may be null or repeat, each
    row has its result. Without any proposal, or with an empty table, nothing is learned and nothing added.
    """
    session_limits(docs.sparkSession)

    @F.pandas_udf(FOUND)
    def propose(texts: pd.Series) -> pd.Series:
        names = ("kind", "start", "stop", "base", "pattern")
        return pd.Series([[dict(zip(names, c)) for c in candidates(t)] for t in texts])

    rows = settle(docs.select(F.col(id_col).alias("id"), propose(F.col(text_col)).alias("found")))
    patterns = rows.select(F.explode("found.pattern").alias("pattern")).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    # At most 7 x 3^5 x 12 patterns.
    model = fit({r["pattern"]: r["n"] for r in patterns.collect()})
    sure = [n for n, p in model.probability.items() if p >= SURE]
    kind = lambda c: F.element_at(F.array(*map(F.lit, KINDS)), c["kind"] + 1)
    shown = lambda xs: F.transform(xs, lambda c: F.struct(kind(c).alias("kind"), c["start"].alias("start"), c["stop"].alias("stop")))
    base = F.filter("found", lambda c: c["base"])
    spans = F.filter("found", lambda c: c["base"] | c["pattern"].isin(sure))
    return rows.select("id", shown(base).alias("base"), shown(spans).alias("spans")), model
