"""Spelling variants against all pairs of words, with the trie whole and cut into many bins."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from foldwise.llm import queries, spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    found = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 7:
                found[word] += 1
    return {w: n for w, n in found.items() if n >= 2}


def changed(a, b):
    """By all single changes of the shorter word, without a common prefix."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = counted(rows)
    words = sorted(n)
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and changed(w, x)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    base = ["".join(rng.choices("abcdé", k=rng.randrange(6, 12))) for _ in range(40)] + ["NETWORKS", "Ünïcødé×÷", "straßenbahn"]
    made = []
    for i in range(150):
        words = []
        for w in rng.choices(base, k=20):
            at = rng.randrange(len(w))
            words.append(rng.choice([w, w, w.upper(), w[:at] + w[at + 1 :], w[:at] + rng.choice("abxé") + w[at:], w[:at] + rng.choice("abxé") + w[at + 1 :]]))
        made.append((i, rng.choice([" ", "-", "1", "\n"]).join(words)))
    # Forms of forms, many words of one vector, ties, very long words, more of a letter than is counted.
    made += [(500, "frequent " * 3000 + "frequents " * 250 + "freqents " * 20 + "freqentz " * 2)]
    made += [(600 + j, " ".join("".join(w) for w in [rng.sample("aaaaabbbbb", 10) for _ in range(60)])) for j in range(8)]
    made += [(700, "tie" * 3 + "a " + "tie" * 3 + "b "), (701, "tie" * 3 + "a " + "tie" * 3 + "b "), (702, ("tie" * 3 + " ") * 40)]
    made += [(j, f"{'x' * 70000} {'x' * 70001} {'e' * 40} {'e' * 41} {'e' * 39}a {'e' * 40}a") for j in (710, 711, 712)]
    return made + [(None, made[0][1]), (None, made[0][1]), (800, None), (801, ""), (802, "12 \n"), (803, made[3][1])]


@pytest.mark.parametrize("bin_words", [20_000, 25])
def test_variants(spark, monkeypatch, rows, bin_words):
    monkeypatch.setattr(spelling, "BIN_WORDS", bin_words)
    table = spark.createDataFrame([(*r, "w", 3) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    want = brute(rows)
    got = spelling.variants(table).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(map(tuple, got.collect())) == want
    assert {r[5] for r in want if r[0] == "freqentz"} == {"frequent"} and sum(r[2] > 0 for r in want) > 200
    if bin_words == 25:
        assert spelling.variants(table.limit(0)).count() == 0


def test_query_and_checksums(spark, folder):
    rows = [tuple(r) for r in queries.table(spark, folder, "documents").select("doc_id", "text").collect()]
    got = queries.op13_spelling_variants(spark, folder).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted(map(tuple, got.collect())) == brute(rows)
    words, letters = spelling.runs_of([b"", "abécd œuf q×".encode(), b"x" * 100])
    assert [words.word(i).decode() for i in range(len(words))] == ["abécd", "uf", "q×", "x" * 100] and letters.tolist() == [5, 2, 2, 100]
    assert spelling.checksums(words, [b"1:", b"-2:", b":"]).tolist() == [zlib.crc32(p + words.word(i)) for i, p in enumerate((b"-2:", b"-2:", b"-2:", b":"))]


def test_search_finds_all_vectors_in_reach():
    rng = np.random.default_rng(2)
    vectors = np.unique(rng.integers(0, 3, (400, 5)).astype(np.uint8), axis=0)
    trie = spelling.Trie(vectors)
    own, leaf, _ = trie.search(vectors)
    got = {frozenset((int(i), int(np.flatnonzero(trie.leaf == x)[0]))) for i, x in zip(own, leaf)}
    change = vectors[:, None].astype(int) - vectors[None].astype(int)
    reach = (np.maximum(change, 0).sum(2) <= 1) & (np.maximum(-change, 0).sum(2) <= 1)
    assert got == {frozenset((int(i), int(j))) for i, j in np.argwhere(reach)}
