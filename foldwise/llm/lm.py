"""Language-model scoring from a log-frequency Bloom filter.

Counts of words and word pairs are quantised: a count c has level 1 + floor(log_base c). For an n-gram of
level q the filter holds the q entries (n-gram, 1) ... (n-gram, q). A worker probes (n-gram, 1), (n-gram,
2), ... until one is missing; the level so found is never too low and rarely too high. From the levels
come the smoothed probabilities

    P(w | h) = (c(h, w) + mu P(w)) / (c(h) + mu),   P(w) = (c(w) + alpha) / (N + alpha (V + 1)).

Counting is distributed: blocks of texts send each distinct n-gram once, with its count, to the shard of
its name; a shard adds up and builds its own segment of the filter. Nothing is pruned, so the filter grows
with the corpus. Segments are broadcast in parts of at most ``part_bytes``, one pass over the blocks for
each part; a pass answers the n-grams of its segments, and the passes together give every level.

The exact word counts of the base score take the same way back as other names: a block asks the shards.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.llm.blocks import BLOCK_BYTES, read_blocks, record, shard_count
from foldwise.llm.bpe import by_name, ddl, joined, listed, ranked, shard_edges, word_names
from foldwise.llm.words import SPACED, SPREAD, U64, chunks, mix, pack, pack_sorted, session_limits, split_words, unpack, unpack_sorted
from foldwise.session import settle

ALPHA = 0.1
MU = 4.0
BASES = (1.2, 2.0)
BITS_PER_ENTRY = 10
HASHES = 7
PART_BYTES = 48 << 20
#: Name of the sign that stands before and behind every text.
EDGE = U64(0x0E0D0C0B0A090807)

BLOCKS = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("trained", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("counts", pa.binary()), ("order", pa.binary()), ("seq", pa.binary()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_trained", pa.int64())])
ASKED = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])
COUNTED = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("counts", pa.binary()), ("n_distinct", pa.int64())])
GRAMS = pa.schema([("shard", pa.int64()), ("order", pa.int64()), ("names", pa.binary()), ("counts", pa.binary())])
SEGMENT = pa.schema([("shard", pa.int64()), ("size", pa.int64()), ("bits", pa.binary())])
LEVELS = pa.schema([("block", pa.int64()), ("levels1", pa.binary()), ("levels2", pa.binary())])
SCORED = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
SCORES = pa.schema([("id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def _index(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in read_blocks(batches, block_bytes):
            texts = [(t or b"").lower() for t in rows.texts]
            train = np.array([r == b"1" for r in rows.rest], bool)
            found, table, sizes = [], {}, np.zeros(len(texts), np.int64)
            for x, y in chunks(texts):
                words = split_words(texts[x:y], SPACED)
                sizes[x:y] = np.diff(words.first)
                if len(words):
                    at, which = words.distinct
                    found.append(np.array([table.setdefault(words.word(i), len(table)) for i in at.tolist()], np.int64)[which])
            which, spelled = by_name(np.concatenate(found) if found else np.zeros(0, np.int64), list(table))
            counts = np.bincount(which[np.repeat(train, sizes)], minlength=len(spelled)).astype(np.uint32)
            seq, order = ranked(which, len(spelled))
            yield record(BLOCKS, [{
                "block": block, "ids": pack(rows.ids), "known": pack(rows.known.astype(np.uint8)), "trained": pack(train.astype(np.uint8)),
                "sizes": pack(sizes), "words": joined(spelled), "counts": pack(counts), "order": order, "seq": seq,
                "n_words": len(spelled), "n_tokens": int(counts.sum()), "n_trained": int(train.sum()),
            }])

    return run


def _ask(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, counts = listed(row["words"]), unpack(row["counts"])
                edge = shard_edges(word_names(words), shards)
                yield record(ASKED, [
                    {"shard": s, "block": row["block"], "words": joined(words[x:y]), "counts": pack(counts[x:y])}
                    for s, (x, y) in enumerate(zip(edge, edge[1:]))
                    if y > x
                ])

    return run


def _count(table: pa.Table) -> pa.Table:
    """Exact counts over all blocks, for every block's words of this shard."""
    rows = [(r["shard"], r["block"], listed(r["words"]), unpack(r["counts"])) for r in table.to_pylist()]
    total: Counter = Counter()
    for _, _, words, counts in rows:
        for w, c in zip(words, counts.tolist()):
            total[w] += c
    distinct = sum(c > 0 for c in total.values())
    out = [{"shard": s, "block": b, "counts": pack(np.array([total[w] for w in words], np.uint64)), "n_distinct": distinct if j == 0 else 0} for j, (s, b, words, _) in enumerate(rows)]
    return pa.Table.from_pylist(out, schema=COUNTED)


def unigram(names: np.ndarray) -> np.ndarray:
    return mix(names * U64(0x9FB21C651E98DF25) + U64(1))


def bigram(before: np.ndarray, names: np.ndarray) -> np.ndarray:
    return mix(mix(before * U64(0xA24BAED4963EE407) + U64(2)) + names)


def _sequence(row: dict) -> tuple[np.ndarray, ...]:
    """Distinct names (the edge sign last) and, with an edge behind every text, the token sequence,
    each token's predecessor, and the text of each token."""
    distinct = np.append(word_names(listed(row["words"])), EDGE)
    sizes = unpack(row["sizes"])
    order = unpack(row["order"])
    words = order[unpack(row["seq"])].astype(np.int64) if len(order) else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    token = np.full(len(text), len(distinct) - 1, np.int64)
    stop = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(text), bool)
    inner[stop] = False
    token[inner] = words
    before = np.append(len(distinct) - 1, token[:-1])
    return distinct, token, before, text


def _grams(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                distinct, token, before, text = _sequence(row)
                train = unpack(row["trained"]).astype(bool)[text]
                for order, names in ((1, unigram(distinct)[token[train]]), (2, bigram(distinct[before[train]], distinct[token[train]]))):
                    own, count = np.unique(names, return_counts=True)
                    edge = shard_edges(own, shards)
                    yield record(GRAMS, [
                        {"shard": s, "order": order, "names": pack_sorted(own[x:y]), "counts": pack(count[x:y].astype(np.uint32))}
                        for s, (x, y) in enumerate(zip(edge, edge[1:]))
                        if y > x
                    ])

    return run


def level(count: np.ndarray, base: float) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, 1)) / np.log(base) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray, base: float) -> np.ndarray:
    """Middle of the counts that share a level; 0 where nothing was found."""
    low = np.ceil(base ** (levels - 1.0) - 1e-6)
    high = np.maximum(low, np.ceil(base ** levels.astype(float) - 1e-6) - 1)
    return np.where(levels > 0, (low + high) / 2, 0.0)


def _places(names: np.ndarray, step, size: int) -> Iterator[np.ndarray]:
    """Bit places of the entries (name, step)."""
    a = mix(names + SPREAD * np.asarray(step, U64))
    b = mix(a) | U64(1)
    for _ in range(HASHES):
        yield ((a >> U64(32)) * U64(size) >> U64(32)).astype(np.int64)
        a = a + b


def _segment(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    entries = []
    for order, base in enumerate(BASES, 1):
        own = [r for r in rows if r["order"] == order]
        if own:
            names = np.concatenate([unpack_sorted(r["names"]) for r in own])
            counts = np.concatenate([unpack(r["counts"]) for r in own]).astype(np.float64)
            distinct, which = np.unique(names, return_inverse=True)
            entries.append((distinct, level(np.bincount(which, counts), base)))
    size = max(64, int(sum(int(q.sum()) for _, q in entries)) * BITS_PER_ENTRY)
    bits = np.zeros(size, bool)
    for names, q in entries:
        step = 1
        while len(names):
            for place in _places(names, step, size):
                bits[place] = True
            names, q, step = names[q > step], q[q > step], step + 1
    return pa.Table.from_pylist([{"shard": rows[0]["shard"], "size": size, "bits": np.packbits(bits).tobytes()}], schema=SEGMENT)


def probe(names: np.ndarray, segments: dict[int, tuple[int, bytes]], shards: int) -> np.ndarray:
    """Levels of ascending names in the segments at hand; 0 elsewhere."""
    out = np.zeros(len(names), np.uint8)
    edge = shard_edges(names, shards)
    for s, (size, data) in segments.items():
        raw = np.frombuffer(data, np.uint8)
        alive, step = np.arange(edge[s], edge[s + 1]), 1
        while len(alive) and step < 256:
            here = np.ones(len(alive), bool)
            for place in _places(names[alive], step, size):
                here &= (raw[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
            alive = alive[here]
            out[alive] += 1
            step += 1
    return out


def _distinct_grams(row: dict):
    distinct, token, before, text = _sequence(row)
    one = unigram(distinct)
    two, which = np.unique(bigram(distinct[before], distinct[token]), return_inverse=True)
    return one, two, which, token, before, text


def _probe(segments, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                one, two, *_ = _distinct_grams(row)
                by_name = np.argsort(one)
                q1 = np.zeros(len(one), np.uint8)
                q1[by_name] = probe(one[by_name], segments.value, shards)
                yield record(LEVELS, [{"block": row["block"], "levels1": pack(q1), "levels2": pack(probe(two, segments.value, shards))}])

    return run


def _score(n: int, v: int, edges: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        answers = sorted((r["shard"], r["counts"]) for r in rows if r["counts"] is not None)
        q1, q2 = (sum(unpack(r[k]) for r in rows if r[k] is not None).astype(np.int64) for k in ("levels1", "levels2"))
        tables = []
        for row in left.to_pylist():
            exact = np.concatenate([unpack(c) for _, c in answers] + [np.array([edges], np.uint64)]).astype(np.float64)
            below = n + ALPHA * (v + 1)
            _, _, which, token, before, text = _distinct_grams(row)
            base = np.log10((exact + ALPHA) / below)[token]
            word = count_of(q1, BASES[0])
            pair = np.minimum(count_of(q2, BASES[1])[which], word[before])
            smooth = np.log10((pair + MU * (word[token] + ALPHA) / below) / (word[before] + MU))
            m = len(unpack(row["sizes"]))
            ids, known = unpack(row["ids"]).tolist(), unpack(row["known"]).tolist()
            tables.append(pa.Table.from_pydict({
                "id": [i if k else None for i, k in zip(ids, known)],
                "held_out": ~unpack(row["trained"]).astype(bool),
                "n_tokens": np.bincount(text, minlength=m),
                "n_known": np.bincount(text, exact[token] > 0, minlength=m).astype(np.int64),
                "base_score": np.bincount(text, base, minlength=m),
                "score": np.bincount(text, np.minimum(smooth, 0), minlength=m),
            }, schema=SCORES))
        return pa.concat_tables(tables)

    return run


def score_texts(
    docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Rows for which ``train`` holds are learned from; null counts as false. Each text, the empty and the null
    one too, ends with one token of its own. ``base_score`` uses exact counts, ``score`` the filter's.
    Rows that repeat are counted and scored each. Without training rows all counts are zero.
    """
    spark = docs.sparkSession
    session_limits(spark)
    marked = docs.select(
        F.col(id_col).cast("bigint").alias("id"),
        F.col(text_col).cast("binary").alias("text"),
        F.when(train, "1").otherwise("0").cast("binary").alias("rest"),
    )
    blocks = settle(marked.mapInArrow(_index(block_bytes), ddl(BLOCKS)))
    size = blocks.agg(F.sum("n_words"), F.sum("n_tokens"), F.sum("n_trained")).first()
    words, tokens, trained = (int(x or 0) for x in size)
    asked = blocks.select("block", "words", "counts").mapInArrow(_ask(shard_count(words, 500_000)), ddl(ASKED))
    counted = settle(asked.groupBy("shard").applyInArrow(_count, ddl(COUNTED)))
    distinct = int(counted.agg(F.sum("n_distinct")).first()[0] or 0) + (trained > 0)
    shards = shard_count(tokens)
    segments = settle(blocks.mapInArrow(_grams(shards), ddl(GRAMS)).groupBy("shard").applyInArrow(_segment, ddl(SEGMENT)))
    sizes = sorted((r[0], r[1] // 8) for r in segments.select("shard", "size").collect())
    parts, room = [[]], part_bytes
    for shard, n_bytes in sizes:
        if parts[-1] and n_bytes > room:
            parts.append([])
            room = part_bytes
        parts[-1].append(shard)
        room -= n_bytes
    texts = blocks.select("block", "ids", "known", "trained", "sizes", "words", "order", "seq")
    nothing = F.lit(None).cast("binary")
    answers = counted.select("block", "shard", "counts", nothing.alias("levels1"), nothing.alias("levels2"))
    for part in parts:
        rows = segments.filter(F.col("shard").between(part[0], part[-1])).collect() if part else []
        shared = spark.sparkContext.broadcast({r["shard"]: (r["size"], bytes(r["bits"])) for r in rows})
        # Settled one by one: a task holds one part of the filter at a time.
        levels = settle(texts.mapInArrow(_probe(shared, shards), ddl(LEVELS)))
        answers = answers.union(levels.select("block", F.lit(None).cast("bigint"), nothing, "levels1", "levels2"))
        shared.unpersist()
    total = tokens + trained
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(total, distinct, trained), SCORED)
    return scored.withColumn("train_tokens", F.lit(total).cast("bigint"))
