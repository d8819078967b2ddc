"""Operators against brute force on small tables that hold nulls, empty and repeated rows, ties and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from foldwise.llm import bpe, chat, decontaminate, langid, licenses, lm, media, quality, queries, recompress, simhash
from foldwise.llm.graph import components

SPACED = re.compile("[^\x20\x09-\x0d]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
VOCABULARY = ["a", "b", "The", "of", "ñu", "x1"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


#: Two words that a polynomial over their letters cannot tell apart modulo a power of two.
MORSE = ["".join("ab"[(i.bit_count() + flip) % 2] for i in range(2048)) for flip in (0, 1)]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    made = [(i, " ".join(rng.choices(VOCABULARY[: rng.choice([1, 2, 4, 6])], k=rng.randrange(70)))) for i in range(120)]
    made += [(1000, None), (1001, ""), (1002, " \n\t"), (None, made[3][1]), (1003, made[4][1]), (1003, made[4][1]), (1004, made[5][1])]
    made += [(1005, "word " * 40000), (1006, "all rights RESERVED, cc-by (c) 2020. " * 3), (1007, "x" * 70000), (1008, "it's ''s ÉÀ I'LL 12 <|endoftext|> ẹ̀ ΑΣ")]
    # Such words side by side in one text, apart in several, and once only among texts that are not learned from.
    made += [(1010 + j, f"q{j} " + " ".join(f"w{k}" for k in range(12)) + " " + MORSE[j % 2] + f" z{j}") for j in range(4)]
    made += [(1020, " ".join(MORSE)), (1021, MORSE[0] + "é " + MORSE[1] + "é"), (1030, MORSE[0] + "x"), (1031, MORSE[1] + "x")]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = spark.createDataFrame([(i, t, "en", "7", 3) for i, t in rows], "doc_id long, text string, lang string, fp string, n_words int")
    return made.repartition(5)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination(spark, docs, rows, empty, block_bytes):
    rng = random.Random(2)
    items = [(i, " ".join(rng.choices(VOCABULARY[:4], k=n))) for i, n in enumerate((1, 3, 5, 7, 10, 14, 30))]
    items += [(50, None), (51, "..."), (None, "b a b"), (4, "of of the")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for i, text in items:
        w = WORD.findall(lower(text))
        for j in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[j : j + 10])].add(i)
    want = []
    for i, text in rows:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (x := tuple(w[j : j + n])) in windows:
                    hit.update(range(j, j + n))
                    found |= windows[x] - {None}
        want.append((i, len(w), len(hit), sorted(map(str, found))))
    got = decontaminate.find_contamination(docs, benchmark, block_bytes=block_bytes)
    assert got.columns == [*docs.columns, "contamination"]
    assert sorted([(r.doc_id, r.contamination.n_words, r.contamination.n_hit, r.contamination["items"]) for r in got.collect()], key=str) == sorted(want, key=str)
    assert decontaminate.find_contamination(empty, benchmark).count() == 0
    assert decontaminate.find_contamination(docs, benchmark.limit(0)).filter("contamination.n_hit > 0").count() == 0


def simhash_of(text):
    w = SPACED.findall(lower(text))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[j : j + 3]), 42) for j in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, rows, empty):
    prints = [(i, simhash_of(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = [(i, p) for i, p in prints if i is not None]
    for i, p in known:
        for j, q in known:
            if (p ^ q).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    want = [(i, f"{p:016x}", None if i is None else find(i)) for i, p in prints]
    got = simhash.near_duplicates(docs)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got.collect()], key=str) == sorted(want, key=str)
    kept = [r.doc_id for r in simhash.drop_near_duplicates(docs).collect()]
    assert sorted(kept, key=str) == sorted([i for i, _, c in want if i == c], key=str)
    assert simhash.near_duplicates(empty).count() == 0


def test_covering_masks_and_large_buckets(spark, monkeypatch):
    masks = simhash.covering_masks()
    for a in range(64):
        for b in range(64):
            assert any(not (m >> a & 1 or m >> b & 1) for m in masks)
    rng = random.Random(1)
    prints = [rng.getrandbits(62) for _ in range(30)]
    prints += [p ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for p in prints for _ in range(4)]
    prints = sorted(set(prints))
    table = spark.createDataFrame([(p, i) for i, p in enumerate(prints)], "fp long, rep long")
    want = {(j, i) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2}
    assert {(min(r), max(r)) for r in simhash.links(table).collect()} == want
    monkeypatch.setattr(simhash, "PAIRWISE", 1)
    few = {(min(r), max(r)) for r in simhash.links(table).collect()}
    assert few <= want and groups(few) == groups(want)


def groups(edges):
    found = []
    for e in edges:
        near = [g for g in found if g & set(e)]
        found = [g for g in found if g not in near] + [set(e).union(*near)]
    return sorted(map(sorted, found))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(i, 0) for i in range(1, 201)} | {(501, 500)}


def test_licenses(docs, rows, empty):
    got = licenses.scan(docs).collect()
    for r in got:
        w, places, labels = WORD.findall(lower(r.text)), [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    places.append(j)
                    labels.add(label)
        x = r.license
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(w), len(places), min(places, default=None), max(places, default=None))
        assert x.base_labels == ",".join(sorted(labels)) and labels <= set(x.labels.split(",")) and 0 <= x.score <= 1
        for a in x.detections:
            inside = [b for b in x.detections if b != a and b.start <= a.start and a.stop <= b.stop and b.tier <= a.tier]
            assert not inside and (r.text or "")[a.start : a.stop].strip()
    assert len(got) == len(rows) and licenses.scan(empty).count() == 0


def test_license_labels(spark):
    said = {
        "Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0", "SPDX-License-Identifier: GPL-2.0-or-later": "gpl-2.0",
        "licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "No words of that kind.": "",
    }
    got = licenses.scan(spark.createDataFrame([(t,) for t in said], "text string")).collect()
    assert {r.text: r.license.labels for r in got} == said
    assert len(licenses.rules()) > 300


def test_language_model(docs, rows, empty):
    train = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    runs = [lm.score_texts(docs, train, block_bytes=b, part_bytes=p).collect() for b, p in ((1 << 20, 1 << 20), (500, 3000))]
    counts, learned = Counter(), lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    texts = [(i, SPACED.findall(lower(t)) + [None]) for i, t in rows]
    for i, w in texts:
        if learned(i):
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    want = sorted([(i, not learned(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)) for i, w in texts], key=str)
    for run in runs:
        assert sorted([(r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in run], key=str) == want
        assert all(r.score <= 0 for r in run)
    one, two = ({(r.id, r.n_tokens): r.score for r in run} for run in runs)
    assert all(abs(one[k] - two[k]) < 1e-2 * abs(one[k]) + 1e-6 for k in one)
    assert lm.score_texts(empty, train).count() == 0


def test_filter_levels_are_never_too_low():
    import numpy as np
    import pyarrow as pa

    from foldwise.llm.words import pack, pack_sorted

    names = np.sort(np.random.default_rng(3).integers(0, 1 << 63, 3000).astype(np.uint64)) * np.uint64(2)
    counts = np.random.default_rng(4).integers(1, 50, 3000).astype(np.uint32)
    table = pa.Table.from_pylist([{"shard": 0, "order": 2, "names": pack_sorted(names), "counts": pack(counts)}], schema=lm.GRAMS)
    row = lm._segment(table).to_pylist()[0]
    found = lm.probe(names, {0: (row["size"], row["bits"])}, 1)
    exact = lm.level(counts, lm.BASES[1])
    assert (found >= exact).all() and (found == exact).mean() > 0.95


def test_rotation(spark):
    rng = random.Random(9)
    turns = [(c, t, rng.choice(["ann", "bob", "system", None]), rng.choice(["hi", "", None, "é😀"])) for c in (1, 2, None) for t in (0, 1, 1, 2, None, 5)]
    turns += [(7, 0, "system", "alone"), (1, 1, "ann", "hi"), (1, 1, "ann", "hi")]
    got = chat.rotate(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.conv_id, r.perspective].append(r)
    speakers = {(c, r or "unknown") for c, _, r, _ in turns if r != "system"}
    assert set(pieces) == speakers
    for (conv, perspective), own in pieces.items():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(1, len(own) + 1)) and len(own) == sum(t[0] == conv for t in turns)
        whole = "".join(r.piece for r in own)
        for r in own:
            assert whole[r.char_start : r.char_end] == r.piece
            assert r.trained == (r.speaker == perspective) and (r.mask_end > r.mask_start) == r.trained
            assert r.role == ("assistant" if r.trained else "system" if r.speaker == "system" else "user")


def test_quality(spark, folder):
    docs, labels = (queries.table(spark, folder.replace("0.001", "0.01"), t) for t in ("documents", "labels"))
    got = queries.op6_quality(spark, folder.replace("0.001", "0.01"))
    assert got.count() == docs.count()
    held = got.join(labels, "doc_id").filter("held_out").select((F.col("predicted") == F.col("quality")).cast("double").alias("x"))
    assert held.agg(F.avg("x")).first()[0] > 0.95
    odd = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "a b", 0)], "doc_id long, text string, stats int")
    assert quality.score_quality(odd, labels.limit(0), F.lit(True)).filter("score between 0 and 1").count() == 3


def test_bpe(spark, docs, rows, empty):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = []
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), " ".join(map(str, ids)), tokenizer.decode(ids, skip_special_tokens=False)))
    encoded = bpe.encode(docs, TOKENIZER, block_bytes=3000)
    assert sorted(map(tuple, encoded.collect()), key=str) == sorted(want, key=str)
    few = encoded.filter("id < 20 or id in (1000, 1001, 1003, 1008)")
    decoded = bpe.decode(few, bpe.vocabulary(spark, TOKENIZER)).collect()
    assert sorted(map(tuple, decoded), key=str) == sorted([(r.id, r.decoded) for r in few.collect()], key=str)
    assert bpe.encode(empty, TOKENIZER).count() == 0


def test_media(spark, docs, rows, empty):
    png = b"\x89PNG\r\n\x1a\n"
    for kind, body in ((b"IHDR", bytes(13)), (b"IEND", b"")):
        png += len(body).to_bytes(4, "big") + kind + body + zlib.crc32(kind + body).to_bytes(4, "big")
    files = [(0, png, "image/gif"), (1, b"BM junk GIF8 RIFF" + png + b"PK", "x"), (2, media.wav(png), "audio/wav"), (3, None, None), (4, b"", None), (5, png[:-3], "image/png")]
    table = media.sniff(spark.createDataFrame(files, "n int, media binary, declared string"), "media", "declared")
    got = {r.n: (r.sniffed.kind, r.sniffed.declared_right, [(s.kind, s.start) for s in r.sniffed.segments]) for r in table.collect()}
    assert got == {
        0: ("image/png", False, [("image/png", 0)]), 1: (media.UNKNOWN, False, [("image/png", 17)]),
        2: ("audio/wav", True, [("audio/wav", 0), ("image/png", 44)]), 3: (None, True, []), 4: (media.UNKNOWN, False, []), 5: (media.UNKNOWN, False, []),
    }
    assert {bytes(r.carved) for r in media.carve(table, "media").filter("kind = 'image/png'").collect()} == {png}
    stored = media.read_samples(media.store_texts(docs), "media").collect()
    for r in stored:
        raw = (r.text or "").encode()
        assert bytes(r.read.payload) == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    assert len(stored) == len(rows) and media.store_texts(empty).count() == 0


def test_language(spark, folder, docs, empty):
    found = queries.op9_language(spark, folder.replace("0.001", "0.01")).join(queries.table(spark, folder.replace("0.001", "0.01"), "documents"), "doc_id")
    assert found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    model = langid.fit(docs.select("doc_id", "text", F.lit("en").alias("lang")))
    got = {r.doc_id: r.language for r in langid.with_language(docs, model).collect()}
    assert got[1000].lang_pred == got[1001].lang_pred == got[1002].lang_pred == "und" and got[1008].lang_pred == "en"
    assert langid.fit(empty).languages == [] and langid.with_language(docs, langid.fit(empty)).filter("language.lang_pred <> 'und'").count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 22, 2000])
def test_recompression(docs, rows, empty, block_bytes):
    low = {}
    for i, text in rows:
        w = SPACED.findall(text or "")
        for j in range(len(w) - 12):
            if i is not None:
                k = tuple(w[j : j + 13])
                low[k] = min(low.get(k, i), i)
    want = []
    for i, text in rows:
        w = SPACED.findall(text or "")
        gone = {p for j in range(len(w) - 12) if i is not None and low[tuple(w[j : j + 13])] < i for p in range(j, j + 13)}
        want.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    got = recompress.remove_repeats(docs, block_bytes=block_bytes)
    assert sorted([(r.id, r.n_words, r.n_removed, r.kept) for r in got.collect()], key=str) == sorted(want, key=str)
    assert recompress.remove_repeats(empty).count() == 0


def test_pipeline(spark, folder):
    docs = queries.table(spark, folder, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept
        kept = stage(spark, before, folder).checkpoint()
        assert kept.columns == docs.columns and 0 < kept.count() <= before.count(), name
    got = {r.doc_id: (r.ids_sha256, r.n_tokens) for r in corpus_pipeline.run(spark, folder).collect()}
    tokenizer = Tokenizer.from_file(TOKENIZER)
    want = {}
    for r in kept.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (sha(" ".join(map(str, ids))), len(ids))
        assert r.n_chars == len(r.text)
    assert got == want
