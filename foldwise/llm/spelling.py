"""Spelling variants of words: a trie of letter-group counts, searched with a budget of one surplus and one deficit.

A word's vector holds how often each of ``LETTERS``' groups occurs in it. One inserted letter raises one count by
one, a deleted one lowers one, a replaced one does both or, inside a group, neither. The trie arranges the words by
one count after the other. A search goes depth first: at each level it follows the word's own count or spends its
surplus on the next higher count or, after that, its deficit on the next lower one; the other order is the search of the
other word. Words of the leaves it reaches are near if they are verified letter by letter; a leaf offers those that
share the half of the word in which the change is not.

The trie is cut where a node holds at most ``BIN_WORDS`` words (a two-thousandth of all, if that is more), and nodes that
follow each other are packed into bins. The cut has at most some ten thousands of nodes whatever the number of
words; every task descends it, sends a word to the bin where it lives and, as a search, to the bins that its budget reaches. A
leaf with too many words is dealt over several bins, and each search that reaches it goes to all of them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.graph import split_join
from foldwise.llm.words import U64, Pieces, Words, chunks, mix, session_limits
from foldwise.session import settle

LEAST_LETTERS, LEAST_TIMES, RATIO, SPOILED = 7, 2, 10, 31
#: Letter groups, one level of the trie each; every other letter belongs to the last one.
LETTERS = ("e", "a", "t", "i", "o", "n", "s", "r", "h", "l", "cd", "mu", "fgp", "bwy", "jkqvxz", "")
MOST_COUNT = 31
BIN_WORDS, MOST_BINS = 5_000, 2_000
TABLE_WORDS = 200_000
FRONTIER = 1 << 19
SHORT = 64

_ALPHA = np.zeros(256, bool)
_ALPHA[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_GROUP = np.full(256, len(LETTERS) - 1)
for _j, _letters in enumerate(LETTERS):
    _GROUP[[ord(c) for c in _letters]] = _j


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def runs_of(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, and their lengths in code points; texts are lower-cased."""
    data = b"\n".join(texts) + b"\n"
    raw = np.frombuffer(data, np.uint8)
    lead = raw == 0xC3  # begins each of U+00C0 to U+00FF and nothing else
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = _ALPHA[raw] | lead
    inside[2:-1] |= lead[:-1]
    change = np.diff(inside)
    start, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    leads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead, out=leads[1:])
    return Words(data, start, end, np.searchsorted(start, begin)), end - start - (leads[end] - leads[start])


def checksums(words: Words, prefix: list[bytes]) -> np.ndarray:
    """CRC-32 of each word behind its text's prefix."""
    state = np.array([zlib.crc32(p) for p in prefix], np.uint32)[words.text_of] ^ np.uint32(0xFFFFFFFF)
    raw, size = np.frombuffer(words.data, np.uint8), words.end - words.start
    alive, step = np.flatnonzero(size <= SHORT), 0
    while len(alive):
        now = state[alive]
        state[alive] = _CRC[(now ^ raw[words.start[alive] + step]) & np.uint32(255)] ^ (now >> np.uint32(8))
        step += 1
        alive = alive[size[alive] > step]
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > SHORT).tolist():
        out[i] = zlib.crc32(words.word(i), zlib.crc32(prefix[words.text_of[i]]))
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table: dict[bytes, int] = {}

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in table], pa.string()), "n": pa.array(table.values(), pa.int64())})

    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [(t or b"").lower() for t in batch.column(1).to_pylist()]
        for x, y in chunks(texts):
            words, letters = runs_of(texts[x:y])
            long = np.flatnonzero(letters >= LEAST_LETTERS)
            text = words.text_of[long]
            words = Words(words.data, words.start[long], words.end[long], np.searchsorted(text, np.arange(y - x + 1)))
            letters = letters[long]
            check = checksums(words, [(b"" if i is None else str(i).encode()) + b":" for i in ids[x:y]])
            spoiled = check % np.uint32(SPOILED) == 0
            for i in np.flatnonzero(spoiled & (letters > LEAST_LETTERS)).tolist():
                word, at = words.word(i).decode(), int(check[i]) % int(letters[i])
                key = (word[:at] + word[at + 1 :]).encode()
                table[key] = table.get(key, 0) + 1
            whole = np.flatnonzero(~spoiled)
            at, which = Words(words.data, words.start[whole], words.end[whole], np.zeros(1, np.int64)).distinct
            for i, n in zip(whole[at].tolist(), np.bincount(which, minlength=len(at)).tolist()):
                key = words.word(i)
                table[key] = table.get(key, 0) + n
            if len(table) > TABLE_WORDS:
                yield made()
                table.clear()
    yield made()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words with at least ``LEAST_LETTERS`` letters and ``LEAST_TIMES`` occurrences.

    A run whose checksum with its document's id is a multiple of ``SPOILED`` loses one letter first.
    """
    session_limits(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text"))
    counts = rows.mapInArrow(_count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= LEAST_TIMES)


def letters_of(words: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All letters as one byte each, and where each word begins and ends."""
    parts = [w.encode("latin-1") for w in words]
    end = np.cumsum([len(p) for p in parts], dtype=np.int64)
    return b"".join(parts), end - np.array([len(p) for p in parts], np.int64), end


def vectors_of(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How often each letter group occurs in each word, at most ``MOST_COUNT``."""
    word = np.repeat(np.arange(len(start)), end - start)
    place = word * len(LETTERS) + _GROUP[np.frombuffer(data, np.uint8)]
    return np.minimum(np.bincount(place, minlength=len(start) * len(LETTERS)), MOST_COUNT).astype(np.uint8).reshape(len(start), len(LETTERS))


@dataclass
class Cut:
    """The top of the trie: inner nodes, and for each node at which it is cut its first bin and number of bins."""

    inner: set[bytes]
    bins: dict[bytes, tuple[int, int]]

    def home(self, vector: bytes) -> tuple[int, int]:
        level = 0
        while vector[:level] in self.inner and vector[:level] not in self.bins:
            level += 1
        return self.bins[vector[:level]]

    def reached(self, vector: bytes) -> set[int]:
        """Bins of the nodes that a search reaches with its budget."""
        found, stack = set(), [(b"", 0)]
        while stack:
            node, spent = stack.pop()
            if node in self.bins:
                first, n = self.bins[node]
                found.update(range(first, first + n))
            elif node in self.inner:
                c = vector[len(node)]
                stack.append((node + bytes([c]), spent))
                if spent == 0 and c < MOST_COUNT:
                    stack.append((node + bytes([c + 1]), 1))
                if spent == 1 and c > 0:
                    stack.append((node + bytes([c - 1]), 2))
        return found


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = vectors_of(*letters_of(batch.column(0).to_pylist()))
        rows, n = np.unique(found, axis=0, return_counts=True) if len(found) else (found, np.zeros(0, np.int64))
        yield pa.RecordBatch.from_pydict({"vector": pa.array([r.tobytes() for r in rows], pa.binary()), "n": pa.array(n, pa.int64())})


def cut_of(words: DataFrame) -> Cut:
    """Cut the trie so that a bin holds a bounded number of words; at most 32 children of each inner node come to the driver."""
    vectors = settle(words.select("word").mapInArrow(_vectors, "vector binary, n bigint").groupBy("vector").agg(F.sum("n").alias("n")))
    total = vectors.agg(F.sum("n")).first()[0] or 0
    most = max(BIN_WORDS, total // MOST_BINS)
    inner, bins, filled = set(), {}, [0, 0]
    prefix = lambda n: F.expr(f"substring(vector, 1, {n})")
    by_level = vectors.select(F.explode(F.array(*[prefix(n) for n in range(1, len(LETTERS) + 1)])).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n"))
    by_level = settle(by_level.withColumn("parent", F.expr("substring(node, 1, octet_length(node) - 1)")))
    large = by_level.filter(F.col("n") > most).select(F.col("node").alias("parent"))
    # At most len(LETTERS) * MOST_BINS nodes are so large.
    children = by_level.join(F.broadcast(large), "parent", "left_semi")
    cut = children if total <= most else children.unionByName(by_level.filter("octet_length(node) = 1"))
    found = {bytes(r["node"]): r["n"] for r in cut.select("node", "n").collect()} if total > most else {b"": total}
    for node, n in sorted(found.items()):
        if n > most and len(node) < len(LETTERS):
            inner.add(node)
            continue
        if filled[1] + n > most and filled[1]:
            filled = [filled[0] + 1, 0]
        parts = max(1, -(-n // most))
        bins[node] = (filled[0], parts)
        filled = [filled[0] + parts - 1, n] if parts == 1 else [filled[0] + parts, 0]
    if total > most:
        inner.add(b"")
    return Cut(inner, bins)


SENT = pa.schema([("bin", pa.int64()), ("search", pa.bool_()), ("word", pa.string()), ("n", pa.int64())])
NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _deal(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = shared.value, {}
        for batch in batches:
            out = {k: [] for k in SENT.names}
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for word, n, vector in zip(words, counts, map(bytes, vectors_of(*letters_of(words)))):
                if vector not in known:
                    if len(known) > TABLE_WORDS:
                        known.clear()
                    known[vector] = cut.home(vector), sorted(cut.reached(vector))
                (first, parts), reached = known[vector]
                lives = first + zlib.crc32(word.encode()) % parts
                for where, search in [(lives, False), *((b, True) for b in reached)]:
                    for k, v in zip(out, (where, search, word, n)):
                        out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=SENT)

    return run


class Trie:
    """Distinct vectors in order, one level for each count: children of a node are a range of (node, count)."""

    def __init__(self, vectors: np.ndarray):
        order = np.lexsort(vectors.T[::-1]) if len(vectors) else np.zeros(0, np.int64)
        rows = vectors[order].astype(np.int64)
        new = np.zeros(len(rows), bool)
        self.keys, node = [], np.zeros(len(rows), np.int64)
        for level in range(vectors.shape[1]):
            key = node * (MOST_COUNT + 1) + rows[:, level]
            self.keys.append(np.unique(key))
            node = np.searchsorted(self.keys[-1], key)
        self.leaf = np.empty(len(rows), np.int64)
        self.leaf[order] = node

    def search(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(vector, leaf, spent) for each leaf in reach: depth first over pieces of at most ``FRONTIER`` open searches."""
        found, stack = [], [(0, np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int8))]
        while stack:
            level, own, node, spent = stack.pop()
            if level == len(self.keys):
                found.append((own, node, spent))
                continue
            if len(own) > FRONTIER:
                half = len(own) // 2
                stack += [(level, own[:half], node[:half], spent[:half]), (level, own[half:], node[half:], spent[half:])]
                continue
            count = vectors[own, level].astype(np.int64)
            more, less = (spent == 0) & (count < MOST_COUNT), (spent == 1) & (count > 0)
            own = np.concatenate([own, own[more], own[less]])
            key = np.concatenate([node, node[more], node[less]]) * (MOST_COUNT + 1) + np.concatenate([count, count[more] + 1, count[less] - 1])
            spent = np.concatenate([spent, spent[more] + 1, spent[less] + 1])
            at = np.searchsorted(self.keys[level], key)
            at[at == len(self.keys[level])] = 0
            there = self.keys[level][at] == key if len(self.keys[level]) else np.zeros(len(key), bool)
            stack.append((level + 1, own[there], at[there], spent[there].astype(np.int8)))
        return tuple(np.concatenate([f[j] for f in found] or [np.zeros(0, np.int64)]) for j in range(3))


def one_change(a: bytes, b: bytes) -> bool:
    """Whether two different words are one inserted, deleted or replaced letter apart."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def _verified(data: bytes, start, end, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether the words of each pair are one change apart; the right one is as long or one longer."""
    out = np.zeros(len(left), bool)
    raw = np.frombuffer(data + bytes(SHORT + 2), np.uint8)
    size, other = end[left] - start[left], end[right] - start[right]
    fit = (other == size) | (other == size + 1)
    for i in np.flatnonzero(fit & (size > SHORT)).tolist():
        a, b = left[i], right[i]
        out[i] = one_change(data[start[a] : end[a]], data[start[b] : end[b]])
    short = np.flatnonzero(fit & (size <= SHORT))
    for at in range(0, len(short), 1 << 16):
        some = short[at : at + (1 << 16)]
        a, b, n, same = start[left[some]], start[right[some]], size[some], other[some] == size[some]
        differ, first, late = np.zeros(len(some), np.int64), n.copy(), np.full(len(some), -1)
        for j in range(int(n.max(initial=0))):
            inside = n > j
            x, here, behind = raw[a + j], raw[b + j], raw[b + j + 1]
            unequal = inside & (x != here)
            differ += unequal
            first = np.where(unequal & (first == n), j, first)
            late = np.where(inside & (x != behind), j, late)
        out[some] = np.where(same, differ == 1, late < first)
    return out


def near_pairs(words: list[str], lives: np.ndarray, searches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places (search, word that lives here) that are one change apart, each pair of words once."""
    data, start, end = letters_of(words)
    vectors, size, pieces = vectors_of(data, start, end), end - start, Pieces(data)
    trie = Trie(vectors[lives])
    distinct, which = np.unique(vectors[searches], axis=0, return_inverse=True) if len(searches) else (vectors[searches], np.zeros(0, np.int64))
    which = which.ravel()
    own, leaf, spent = trie.search(distinct)
    halves = []
    for longer in (0, 1):  # how many letters the word that lives here has more
        half = (size[lives] - longer) // 2
        a, b = start[lives], end[lives]
        for side, names in ((0, pieces.names(a, a + half)), (1, pieces.names(a + half + longer, b))):
            halves.append(mix(names ^ (trie.leaf.astype(U64) * U64(4) + U64(2 * longer + side)) * U64(0x9E3779B97F4A7C15)))
    key = np.concatenate(halves)
    order = np.argsort(key, kind="stable")
    key, place = key[order], np.tile(lives, 4)[order]
    by_vector = np.argsort(which, kind="stable")
    edge = np.searchsorted(which[by_vector], np.arange(len(distinct) + 1))
    many = np.diff(edge)[own]
    capped = (distinct == MOST_COUNT).any(axis=1)[own] if len(distinct) else np.zeros(0, bool)
    left_out, right_out = [], []
    total = np.cumsum(many)
    # Searches times the leaves that their vector reaches, some at a time.
    cuts = np.unique(np.searchsorted(total, np.arange(0, int(total[-1]) if len(total) else 0, FRONTIER)))
    for x, y in zip(cuts, [*cuts[1:], len(own)]):
        count = many[x:y]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        search = searches[by_vector[np.repeat(edge[own[x:y]], count) + step]]
        at_leaf, how, wide = (np.repeat(v[x:y], count) for v in (leaf, spent, capped))
        half = size[search] // 2
        for longer in (0, 1):
            # Where a count is at its cap, a surplus or a deficit of that group does not show.
            fit = (how == 1) | wide & (how == 0) if longer else (how != 1) | wide
            some = np.flatnonzero(fit)
            a, b, h = start[search[some]], end[search[some]], half[some]
            for side, names in ((0, pieces.names(a, a + h)), (1, pieces.names(a + h, b))):
                asked = mix(names ^ (at_leaf[some].astype(U64) * U64(4) + U64(2 * longer + side)) * U64(0x9E3779B97F4A7C15))
                low, high = np.searchsorted(key, asked, "left"), np.searchsorted(key, asked, "right")
                hits = high - low
                left = np.repeat(search[some], hits)
                right = place[np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)]
                good = _verified(data, start, end, left, right)
                left_out.append(left[good]), right_out.append(right[good])
    left, right = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left_out, right_out))
    # Equal vectors and equal lengths are found from both sides: the pair is kept by its smaller word.
    both = (size[left] == size[right]) & (vectors[left] == vectors[right]).all(axis=1)
    keep = np.array([not t or words[i] < words[j] for t, i, j in zip(both.tolist(), left.tolist(), right.tolist())], bool)
    pair = np.unique(np.stack([left[keep], right[keep]], 1), axis=0) if keep.any() else np.zeros((0, 2), np.int64)
    return pair[:, 0], pair[:, 1]


def _search(table: pa.Table) -> pa.Table:
    words, counts = table["word"].to_pylist(), table["n"].to_numpy()
    search = table["search"].to_numpy(zero_copy_only=False)
    left, right = near_pairs(words, np.flatnonzero(~search), np.flatnonzero(search))
    best: dict[str, list] = {}
    for i, j in [*zip(left.tolist(), right.tolist()), *zip(right.tolist(), left.tolist())]:
        n, other = int(counts[j]), words[j]
        own = best.setdefault(words[i], [0, n, other])
        own[0] += 1
        if (-n, other) < (-own[1], own[2]):
            own[1:] = n, other
    return pa.Table.from_pydict({k: [w if k == "word" else best[w][j - 1] for w in best] for j, k in enumerate(NEAR.names)}, schema=NEAR)


def neighbours(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words that have a near one: their number, and the most frequent."""
    shared = words.sparkSession.sparkContext.broadcast(cut_of(words))
    dealt = words.select("word", "n").mapInArrow(_deal(shared), "bin bigint, search boolean, word string, n bigint")
    found = dealt.groupBy("bin").applyInArrow(_search, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select("word", "n_near", F.col("x")["best"].alias("best"), (-F.col("x")["m"]).alias("best_n"))


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word that ``word_counts`` has.

    ``form`` is the near word of largest count (ties: the smallest), if it has at least ``RATIO`` times the word's
    count; ``root`` follows the forms to the last. Null and empty texts have no words, repeated rows count each,
    a null id counts as the empty text; an empty table has no words.
    """
    words = settle(word_counts(docs, id_col, text_col))
    rows = words.join(neighbours(words), "word", "left")
    takes = F.col("best_n") >= RATIO * F.col("n")
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(takes, F.col("best")).alias("form"), F.when(takes, F.col("best_n")).alias("form_n"))
    rows = settle(rows)
    # Counts grow by RATIO at each step, so a few doublings reach every root.
    ends = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ends = settle(ends)
        farther = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = split_join(ends, farther, ["root"], "left")
        if stepped.filter("next is not null").isEmpty():
            break
        ends = stepped.select("word", F.coalesce("next", "root").alias("root"))
    return rows.join(ends, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
