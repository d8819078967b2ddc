"""Benchmark decontamination by winnowing.

Both sides are reduced to fingerprints: of every ``window - k + 1`` consecutive k-grams the smallest
name, the rightmost if names tie. A span of ``window`` words that occurs on both sides therefore has a
fingerprint in common, at the same place of the span. Each joined pair of places is extended over the
whole diagonal of document and item, word by word, and runs of at least ``window`` equal words are hits.
An item of fewer words is one window of its own; it is looked up by its first words among all k-grams.

Documents are never shuffled: the benchmark is dealt into blocks of at most about ``block_bytes`` (a
longer single item is its own bound), each broadcast to one pass over the rows. Usually that is one pass;
further ones are settled one by one, so that a worker holds one block at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.words import ALPHANUMERIC, Words, chunks, gram_names, session_limits, split_words, utf8
from foldwise.session import settle

WINDOW = 10
GRAM = 5
BLOCK_BYTES = 16 << 20
HITS = "struct<n_words:bigint,spans:array<struct<start:bigint,stop:bigint>>,items:array<string>>"


@dataclass
class Block:
    """Items of one block with their fingerprints, sorted by name."""

    ids: list
    words: Words
    long: tuple[np.ndarray, np.ndarray]
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def winnowed(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Names and places of the selected k-grams."""
    grams = gram_names(words.names, k) if len(words) else np.zeros(0, np.uint64)
    width = window - k + 1
    n = max(0, len(grams) - width + 1)
    best, place = grams[:n].copy(), np.arange(n)
    for j in range(1, width):
        smaller = grams[j : n + j] <= best
        best = np.where(smaller, grams[j : n + j], best)
        place = np.where(smaller, np.arange(n) + j, place)
    place = np.unique(place[np.arange(n) + window <= words.last[:n]])
    return grams[place], place


def _sorted(names: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(names, kind="stable")
    return names[order], places[order]


def index_items(items: list[tuple], window: int = WINDOW, k: int = GRAM) -> Block:
    words = split_words([utf8(text, lower=True) for _, text in items], ALPHANUMERIC)
    size = np.diff(words.first)
    short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for gram in sorted({min(k, int(m)) for m in size if 0 < m < window}):
        at = words.first[:-1][(size < window) & (np.minimum(size, k) == gram)]
        short[gram] = _sorted(gram_names(words.names, gram)[at], at)
    return Block([i for i, _ in items], words, _sorted(*winnowed(words, window, k)), short)


def _pairs(names: np.ndarray, places: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places on both sides that have the same name."""
    keys, at = table
    low, high = np.searchsorted(keys, names, "left"), np.searchsorted(keys, names, "right")
    count = high - low
    own = np.repeat(places, count)
    step = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    return own, at[np.repeat(low, count) + step]


def scan(texts: list[bytes], block: Block, window: int = WINDOW, k: int = GRAM) -> list[tuple]:
    """(n_words, spans, items) of each text."""
    words = split_words(texts, ALPHANUMERIC)
    found: list[tuple[np.ndarray, np.ndarray]] = [_pairs(*winnowed(words, window, k), block.long)]
    for gram, table in block.short.items():
        names = gram_names(words.names, gram) if len(words) else np.zeros(0, np.uint64)
        at = np.flatnonzero(np.isin(names, table[0]))
        found.append(_pairs(names[at], at, table))
    own, other = (np.concatenate(x) for x in zip(*found))
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    if len(own):
        text, item = words.text_of[own], block.words.text_of[other]
        diagonals = np.unique(np.stack([text, item, own - other], 1), axis=0)
        for t, i, shift in diagonals.tolist():
            a, b = block.words.first[i], block.words.first[i + 1]
            low, high = max(words.first[t], a + shift), min(words.first[t + 1], b + shift)
            same = np.zeros(high - low + 2, np.int8)
            same[1:-1] = words.names[low:high] == block.words.names[low - shift : high - shift]
            edge = np.diff(same)
            for x, y in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()):
                if y - x < min(window, b - a) or any(
                    words.word(low + j) != block.words.word(low - shift + j) for j in range(x, y)
                ):
                    continue
                spans[t].append((int(low + x - words.first[t]), int(low + y - words.first[t])))
                if block.ids[i] is not None:
                    items[t].add(str(block.ids[i]))
    return [(int(n), sorted(set(s)), sorted(x)) for n, s, x in zip(np.diff(words.first), spans, items)]


def _finder(shared, window: int, k: int):
    @F.pandas_udf(HITS)
    def hits(texts: pd.Series) -> pd.DataFrame:
        data = [utf8(t, lower=True) for t in texts]
        out = [row for x, y in chunks(data) for row in scan(data[x:y], shared.value, window, k)]
        return pd.DataFrame(out, columns=["n_words", "spans", "items"])

    return hits


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    k: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
    into: str = "contamination",
) -> DataFrame:
    """Add ``into``: n_words, n_hit, merged spans of hit words, and the sorted ids of the items found.

    Every row and column stays, but for one named as ``into``, which is replaced. A null text has no words; an item without words never occurs; an item
    with a null id marks words but isn't listed; items that share an id count once. An empty benchmark
    or an empty table gives no hits. Two block passes or one give the same result.
    """
    spark = docs.sparkSession
    session_limits(spark)
    items = benchmark.select(F.col(item_col).alias("id"), F.col(item_text_col).alias("words")).filter("words is not null").distinct()
    total = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    # Dealt by id and text: copies of one text spread over the blocks too.
    items = items.withColumn("block", F.pmod(F.xxhash64("id", "words"), F.lit(n_blocks)))
    parts = []
    for b in range(n_blocks):
        rows = [(r[0], r[1]) for r in items.filter(F.col("block") == b).select("id", "words").collect()]
        shared = spark.sparkContext.broadcast(index_items(rows, window, k))
        name = f"__hits_{b}"
        docs = docs.withColumn(name, _finder(shared, window, k)(F.col(text_col)))
        if n_blocks > 1:
            docs = settle(docs)
            shared.unpersist()
        parts.append(name)
    spans = F.array_sort(F.flatten(F.array(*[F.col(p)["spans"] for p in parts])))
    listed = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(p)["items"] for p in parts]))))
    empty = F.array().cast("array<struct<start:bigint,stop:bigint>>")

    def add(done, x):
        back = F.element_at(done, -1)
        joined = F.struct(back["start"].alias("start"), F.greatest(back["stop"], x["stop"]).alias("stop"))
        return F.when((F.size(done) > 0) & (F.get(done, F.size(done) - 1)["stop"] >= x["start"]),
                      F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    def merged(done, x):
        return F.when(F.size(done) == 0, F.array(x)).otherwise(add(done, x))

    docs = docs.withColumn("__spans", F.aggregate(spans, empty, merged))
    total_hit = F.aggregate("__spans", F.lit(0).cast("bigint"), lambda n, x: n + x["stop"] - x["start"])
    return docs.withColumn(
        into,
        F.struct(
            F.col(parts[0])["n_words"].alias("n_words"),
            total_hit.alias("n_hit"),
            F.col("__spans").alias("spans"),
            listed.alias("items"),
        ),
    ).drop("__spans", *parts)
