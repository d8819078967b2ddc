"""The pipeline's stages against brute force, and columns whose names clash with those of the operators."""

import re

import pytest
from pyspark.sql import functions as F
from test_operators import SPACED, WORD, lower, simhash_of

import corpus_pipeline
from foldwise.llm import decontaminate, langid, licenses, media, queries

CLASHING = {"language": "mine", "contamination": "x", "license": "y", "fingerprint": "z", "rest": "r", "kept": "k", "id": "i"}


@pytest.fixture(scope="module")
def docs(spark, folder):
    rows = queries.table(spark, folder, "documents").collect()
    first, second = (next(r for r in rows[n:] if len(r.text.split()) > 60) for n in (0, 40))
    item = next(r.text for r in queries.table(spark, folder, "benchmark").collect() if len(WORD.findall(lower(r.text))) >= 10)
    made = [tuple(r) for r in rows] + [
        (9001, first.text, "en", "s", len(first.text)),  # an exact copy
        (9002, " ".join(f"w{j}" for j in range(20)) + " " + " ".join(second.text.split()[5:45]), "en", "s", 0),  # a repeated passage
        (9003, "before " + item + " after", "en", "s", 0), (9004, "", "en", "s", 0), (9005, None, None, None, None), (9006, None, None, None, None),
        (9007, "too short to hold a window", "en", "s", 26),
    ]
    table = spark.createDataFrame(made, queries.table(spark, folder, "documents").schema)
    return table.select("*", *[F.lit(v).alias(k) for k, v in CLASHING.items()]).checkpoint()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark, folder, docs, monkeypatch):
    before = by_id(docs)
    kept = by_id(corpus_pipeline.language_id(spark, docs, folder))
    model = by_id(langid.identify(docs.select("doc_id", "text", "lang")))
    assert set(kept) == {i for i, r in model.items() if r.language.lang_pred != "und" and r.language.score >= corpus_pipeline.LEAST_SCORE}
    assert all(r == before[i] for i, r in kept.items()) and not {9004, 9005, 9006} & set(kept)

    prints, root = {i: simhash_of(r.text) for i, r in before.items()}, {i: i for i in before}

    def find(x):
        return x if root[x] == x else find(root[x])

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    kept = by_id(corpus_pipeline.near_duplicates(spark, docs, folder))
    assert set(kept) == {i for i in before if find(i) == i} and 9001 not in kept and all(r == before[i] for i, r in kept.items())

    words, low = {i: SPACED.findall(r.text or "") for i, r in before.items()}, {}
    for i in sorted(words):
        for j in range(len(words[i]) - 12):
            low.setdefault(tuple(words[i][j : j + 13]), i)
    kept = by_id(corpus_pipeline.repeated_passages(spark, docs, folder))
    for i, r in before.items():
        gone = {p for j in range(len(words[i]) - 12) if low[tuple(words[i][j : j + 13])] < i for p in range(j, j + 13)}
        left = [w for p, w in enumerate(words[i]) if p not in gone]
        if gone and not left:
            assert i not in kept
            continue
        text = " ".join(left) if gone else r.text
        assert kept[i].asDict() == r.asDict() | {"text": text, "n_chars": len(text) if gone else r.n_chars}
    assert 9001 not in kept and len(words[9002]) > len(SPACED.findall(kept[9002].text)) and 9007 in kept

    windows = set()
    for (text,) in queries.table(spark, folder, "benchmark").select("text").collect():
        w = WORD.findall(lower(text))
        windows |= {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    kept = by_id(corpus_pipeline.benchmark_passages(spark, docs, folder))
    for i, r in before.items():
        w = WORD.findall(lower(r.text))
        hit = any(tuple(w[j : j + n]) in windows for n in sizes for j in range(len(w) - n + 1))
        assert (i in kept) != hit and (hit or kept[i] == r)
    assert 9003 not in kept


def test_a_column_named_as_the_result_is_replaced(docs):
    few = docs.filter("doc_id < 5 or doc_id > 9000").withColumn("sniffed", F.lit(1)).withColumn("media", F.lit(2)).withColumn("read", F.lit(3))
    for made, into in (
        (licenses.scan(few), "license"), (langid.with_language(few, langid.fit(few)), "language"),
        (decontaminate.find_contamination(few, few.limit(0).select(F.col("doc_id").alias("item_id"), "text")), "contamination"),
        (media.store_texts(few), "media"), (media.sniff(media.store_texts(few), "media"), "sniffed"), (media.read_samples(media.store_texts(few)), "read"),
    ):
        assert sorted(made.columns) == sorted(few.columns) and made.select(into).dtypes != few.select(into).dtypes
        rest = [c for c in few.columns if c not in (into, "media")]
        assert sorted(map(str, made.select(rest).collect())) == sorted(map(str, few.select(rest).collect()))
    assert re.search("replaced", licenses.scan.__doc__)
