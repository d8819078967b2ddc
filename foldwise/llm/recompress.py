"""Substring deduplication by recompression.

A text is a sequence of word names. Each round renames it: a run of equal symbols becomes one symbol, and
two single neighbours become one symbol where the left one falls in the left half and the right one in
the right half of the alphabet, as a bit of the name says. Names are 64-bit hashes of what they stand for,
so every task in every round gives equal content the same name and no dictionary has to be exchanged.

Whether neighbours join depends on a few symbols around them. For every symbol the rounds keep the span of
words that decides it; where that span lies inside a window, all occurrences of the window have this
symbol at the same place. A window is represented by its decided symbol of widest cover (ties: by name),
named together with its deciding span; single words are always decided, so every window has one.
Windows that occur in two texts therefore share their symbol. Three steps follow:

1. Each block sends its distinct symbols to shards, which answer which of them occur in several texts.
2. Windows with such a symbol are verified by 96-bit names of all their words: again the block sends
   distinct names, now with its smallest id, and the shard answers where a smaller id exists elsewhere.
3. Words covered by a window that also starts under a smaller id are removed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.blocks import (
    TEXTS,
    Rows,
    drop_table,
    read_blocks,
    record,
    shard_count,
    source,
    write_table,
)
from foldwise.llm.words import (
    SPACED,
    U64,
    Words,
    _powers,
    chunks,
    gram_names,
    mix,
    pack,
    pack_sorted,
    split_words,
    unpack,
    unpack_sorted,
)
from foldwise.session import settle


WINDOW = 13
BLOCK_BYTES = 12 << 20
#: Rows of a block turn into Arrow tables of about this size.
OUT_BYTES = 4 << 20
ROUNDS = 3
FAR = 1 << 40


def symbol_rounds(words: Words, rounds: int = ROUNDS) -> Iterator[tuple[np.ndarray, ...]]:
    """Per round: names, first and last word, first and last word of the deciding span (far off: never)."""
    name = words.names
    first = np.arange(len(name))
    last, low, high = first.copy(), first.copy(), first.copy()
    yield name, first, last, low, high
    for level in range(rounds):
        n = len(name)
        text = words.text_of[first]
        beside = np.zeros(n, bool)
        beside[:-1] = text[1:] == text[:-1]
        equal = np.zeros(n, bool)
        equal[:-1] = beside[:-1] & (name[1:] == name[:-1])
        run = equal.copy()
        run[1:] |= equal[:-1]
        right = (name * (U64(0x9E3779B97F4A7C15) + U64(2 * level)) >> U64(63)).astype(bool)
        fit = np.zeros(n, bool)
        fit[:-1] = beside[:-1] & ~right[:-1] & right[1:]
        pair = np.zeros(n, bool)
        pair[:-1] = fit[:-1] & ~run[:-1] & ~run[1:]
        a = np.flatnonzero(np.concatenate(([True], ~(equal | pair)[:-1])))
        b = np.append(a[1:] - 1, n - 1)
        # A neighbour that would fit but is part of a run is decided by the symbol behind it.
        opens = np.concatenate(([True], ~beside[:-1]))[a]
        before, after = np.maximum(a - 1, 0), np.minimum(b + 1, n - 1)
        low_next = np.where(fit[before] & run[before] & ~run[a], low[np.maximum(a - 2, 0)], low[before])
        high_next = np.where(fit[b] & run[after] & ~run[b], high[np.minimum(b + 2, n - 1)], high[after])
        low, high = np.where(opens, -FAR, low_next), np.where(~beside[b], FAR, high_next)
        renamed = name[a]
        runs, pairs = equal[a], pair[a]
        renamed[runs] = mix(renamed[runs] * U64(0xA24BAED4963EE407) + (b - a + 1)[runs].astype(U64))
        renamed[pairs] = mix(renamed[pairs] * U64(0xC2B2AE3D27D4EB4F) + name[b[pairs]] + U64(7))
        name, first, last = renamed, first[a], last[b]
        yield name, first, last, low, high


def representatives(words: Words, window: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """For each word the representing symbol of the window that starts there (0: the text ends before)."""
    n = len(words)
    best = np.zeros(n, U64)
    if not n:
        return best
    power, inverse = _powers(1 << max(20, n.bit_length()))
    total = np.zeros(n + 1, U64)
    np.cumsum(words.names * power[:n], out=total[1:])
    for name, first, last, low, high in symbol_rounds(words, rounds):
        sure = np.flatnonzero(high - low < window)
        name, first, last, low, high = name[sure], first[sure], last[sure], low[sure], high[sure]
        span = (total[high + 1] - total[low]) * inverse[low]
        rank = (np.minimum(last - first + 1, 255).astype(U64) << U64(56)) | (mix(span ^ name) >> U64(8))
        start, slack = high - (window - 1), window - 1 - (high - low)
        for j in range(window):
            if j:
                more = slack >= j
                start, slack, rank = start[more], slack[more], rank[more]
            if not len(start):
                break
            skip = np.searchsorted(start, -j)
            at = start[skip:] + j
            best[at] = np.maximum(best[at], rank[skip:])
    best[np.arange(n) + window > words.last] = 0
    return best


def window_names(words: Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """96 bits for every window, as 64 and 32; the two parts start from independent names of the words."""
    other = words.pieces.names(words.start, words.end, seed=0x5EED)
    return gram_names(words.names, window), (gram_names(other, window, seed=0x5EED) >> U64(32)).astype(np.uint32)


SYMBOLS = pa.schema([("block", pa.int64())] + [(c.split()[0], pa.binary()) for c in TEXTS.split(", ")] + [("symbols", pa.binary()), ("several", pa.binary()), ("n_symbols", pa.int64()), ("n_words", pa.int64()), ("run_start", pa.binary()), ("run_symbol", pa.binary())])
SENT = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("names", pa.binary()), ("more", pa.binary()), ("low", pa.binary())])
ANSWER = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("bits", pa.binary()), ("n", pa.int64())])
OPEN = pa.schema([("block", pa.int64())] + [(c.split()[0], pa.binary()) for c in TEXTS.split(", ")] + [("names", pa.binary()), ("more", pa.binary()), ("low", pa.binary()), ("n_names", pa.int64()), ("candidates", pa.binary())])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _word_chunks(rows: Rows) -> Iterator[tuple[int, Words]]:
    texts = [t or b"" for t in rows.texts]
    for x, y in chunks(texts):
        yield x, split_words(texts[x:y], SPACED)


def _symbol_blocks(window: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in read_blocks(batches, block_bytes):
            found, starts, texts, base = [], [], [], 0
            for x, words in _word_chunks(rows):
                best = representatives(words, window)
                best[~rows.known[x + words.text_of]] = 0
                change = np.ones(len(best), bool)
                change[1:] = (best[1:] != best[:-1]) | (words.text_of[1:] != words.text_of[:-1])
                at = np.flatnonzero(change)
                found.append(np.where(best[at] > 0, (mix(best[at]) >> U64(16)) | U64(1), U64(0)))
                starts.append(at + base)
                texts.append(words.text_of[at] + x)
                base += len(words)
            symbol, start, text = (np.concatenate(p) if p else np.zeros(0, np.int64) for p in (found, starts, texts))
            names, which = np.unique(symbol.astype(U64), return_inverse=True)
            low = np.full(len(names), len(rows.texts), np.int64)
            high = np.full(len(names), -1, np.int64)
            np.minimum.at(low, which, text)
            np.maximum.at(high, which, text)
            yield record(SYMBOLS, [{"block": block, **rows.packed(), "symbols": pack_sorted(names), "several": pack((high > low).astype(np.uint8)), "n_symbols": len(names), "n_words": base, "run_start": pack(np.diff(start, prepend=0).astype(np.uint32)), "run_symbol": pack(which.astype(np.uint32))}])

    return run


def _shard_of(names: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Ascending with the name: a shard is a range of names."""
    top = (names >> U64(bits - 32)) if bits > 32 else names
    return ((top * U64(shards)) >> U64(32)).astype(np.int64)


def _send(bits: int, shards: int, kinds: tuple[str, ...]):
    """Cut a block's sorted names, and what goes with each, into one row per shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                names = unpack_sorted(row["names"])
                extra = {k: unpack(row[k]) for k in kinds}
                edge = np.searchsorted(_shard_of(names, bits, shards), np.arange(shards + 1))
                yield record(SENT, [
                    {"shard": s, "block": row["block"], "names": pack_sorted(names[x:y]), **{k: pack(v[x:y]) for k, v in extra.items()}}
                    for s, (x, y) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist()))
                    if y > x
                ])

    return run


def _gather(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    rows = table.sort_by("block").to_pylist()
    parts = [unpack_sorted(r["names"]) for r in rows]
    edge = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=edge[1:])
    return rows, np.concatenate(parts), np.repeat(np.arange(len(parts)), np.diff(edge)), edge


def _answers(rows: list, edge: np.ndarray, flag: np.ndarray) -> pa.Table:
    return pa.Table.from_pylist(
        [{"shard": r["shard"], "block": r["block"], "bits": np.packbits(flag[x:y]).tobytes(), "n": int(y - x)} for r, x, y in zip(rows, edge[:-1], edge[1:])], schema=ANSWER
    )


def _shared_symbols(table: pa.Table) -> pa.Table:
    """Which names occur in several texts; name 0 stands for no window."""
    rows, names, _, edge = _gather(table)
    several = np.concatenate([unpack(r["more"]) for r in rows]).astype(bool)
    _, which, count = np.unique(names, return_inverse=True, return_counts=True)
    return _answers(rows, edge, ((count[which] > 1) | several) & (names > 0))


def _smaller_elsewhere(table: pa.Table) -> pa.Table:
    """Which names start under an id below the block's smallest."""
    rows, names, _, edge = _gather(table)
    more = np.concatenate([unpack(r["more"]) for r in rows])
    low = np.concatenate([unpack(r["low"]) for r in rows])
    order = np.lexsort((more, names))
    new = np.ones(len(order), bool)
    new[1:] = (names[order][1:] != names[order][:-1]) | (more[order][1:] != more[order][:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(low[order], np.flatnonzero(new))
    return _answers(rows, edge, least[group] < low)


def _flags(answers: pa.Table) -> np.ndarray:
    """One flag for each of the block's sorted names: shards are ranges of names."""
    rows = sorted(answers.to_pylist(), key=lambda r: r["shard"])
    parts = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]) for r in rows]
    return np.concatenate(parts or [np.zeros(0, np.uint8)]).astype(bool)


def _distinct(rows: Rows, window: int, candidate: np.ndarray):
    """Candidate windows of a block: places, ids, and for each the index of its distinct name."""
    places, names, more, ids, base = [], [], [], [], 0
    for x, words in _word_chunks(rows):
        here = np.flatnonzero(candidate[base : base + len(words)])
        if len(here):
            a, b = window_names(words, window)
            places.append(here + base), names.append(a[here]), more.append(b[here])
            ids.append(rows.ids[x + words.text_of[here]])
        base += len(words)
    if not places:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(U64), empty.astype(np.uint32), empty
    place, name, check, own = (np.concatenate(p) for p in (places, names, more, ids))
    order = np.lexsort((check, name))
    new = np.ones(len(order), bool)
    new[1:] = (name[order][1:] != name[order][:-1]) | (check[order][1:] != check[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    head = np.flatnonzero(new)
    return place, own, which, name[order][head], check[order][head], np.minimum.reduceat(own[order], head)


def _mark(window: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            rows = Rows.of(row)
            flag = _flags(right)
            start = np.cumsum(unpack(row["run_start"]).astype(np.int64))
            shared = flag[unpack(row["run_symbol"])]
            candidate = np.repeat(shared, np.diff(np.append(start, row["n_words"])))
            _, _, _, names, more, low = _distinct(rows, window, candidate)
            out.append({"block": row["block"], **{c.split()[0]: row[c.split()[0]] for c in TEXTS.split(", ")}, "names": pack_sorted(names), "more": pack(more), "low": pack(low), "n_names": len(names), "candidates": pack(np.packbits(candidate))})
        pa.default_memory_pool().release_unused()
        return pa.Table.from_pylist(out, schema=OPEN)

    return run


KEPT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("text", pa.string()), ("rest", pa.string())])


def _remove(window: int, with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tables, out, size = [], [], 0
        for row in left.to_pylist():
            rows = Rows.of(row)
            candidate = np.unpackbits(unpack(row["candidates"])).astype(bool)
            place, own, which, _, _, low = _distinct(rows, window, candidate)
            elsewhere = _flags(right)
            gone = place[elsewhere[which] | (low[which] < own)]
            base = 0
            for x, words in _word_chunks(rows):
                here = gone[(gone >= base) & (gone < base + len(words))] - base
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, here, 1)
                np.subtract.at(cover, here + window, 1)
                keep = np.cumsum(cover[:-1]) == 0
                base += len(words)
                for i in range(len(words.first) - 1):
                    a, b = words.first[i], words.first[i + 1]
                    k, text = keep[a:b], rows.texts[x + i]
                    parts = (text or b"").split()
                    if not k.all():
                        parts = [p for p, ok in zip(parts, k.tolist()) if ok]
                    out.append({"id": int(rows.ids[x + i]) if rows.known[x + i] else None, "n_words": int(b - a), "n_removed": int(b - a - k.sum()), "kept": b" ".join(parts).decode(), "text": text.decode() if with_text and text is not None else None, "rest": rows.rest[x + i].decode()})
                    size += 2 * len(text or b"")
                    if size > OUT_BYTES:
                        tables.append(pa.Table.from_pylist(out, schema=KEPT))
                        out, size = [], 0
        return pa.concat_tables([*tables, pa.Table.from_pylist(out, schema=KEPT)])

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: list = (), with_text: bool = False,
    window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(id, n_words, n_removed, kept, text, rest) for every row.

    Removes each word that is covered by ``window`` words which also start in a row with a smaller id;
    windows are judged on the input. ``kept`` joins the other words with one space; ``text`` is the
    input text if asked for. A null text has no words. A row with a null id keeps all its words and
    removes none elsewhere; rows that repeat an id don't affect each other. Texts shorter than the
    window stay. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    first = write_table(source(docs, id_col, text_col, rest).mapInArrow(_symbol_blocks(window, block_bytes), ddl(SYMBOLS)), "symbols")
    blocks = spark.read.parquet(first)
    shards = shard_count(blocks.agg(F.sum("n_symbols")).first()[0])
    sent = blocks.select("block", F.col("symbols").alias("names"), F.col("several").alias("more"))
    shared = sent.mapInArrow(_send(48, shards, ("more",)), ddl(SENT)).groupBy("shard").applyInArrow(_shared_symbols, ddl(ANSWER))
    marked = blocks.drop("symbols", "several", "n_symbols").groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_mark(window), ddl(OPEN))
    blocks = settle(marked)
    drop_table(spark, first)
    shards = shard_count(blocks.agg(F.sum("n_names")).first()[0])
    sent = blocks.select("block", "names", "more", "low").mapInArrow(_send(64, shards, ("more", "low")), ddl(SENT))
    smaller = sent.groupBy("shard").applyInArrow(_smaller_elsewhere, ddl(ANSWER))
    texts = blocks.select("block", *[c.split()[0] for c in TEXTS.split(", ")], "candidates")
    return texts.groupBy("block").cogroup(smaller.groupBy("block")).applyInArrow(_remove(window, with_text), ddl(KEPT))
