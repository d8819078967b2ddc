"""BPE encoding and decoding over a distinct-word table.

Tokenizers of this kind encode each word of a text on its own. Blocks of texts are split into words; a
block sends each distinct word once to the word's shard; the shard encodes each distinct word once and
answers with its ids; the block puts the ids back by position. Decoding joins the ids with the id-to-piece
table of the vocabulary, whose size the tokenizer file fixes, so it is broadcast.

Splitting follows the tokenizer file of kind "BPE with word ends": special strings are cut out first,
then NFC, lower case and the pattern of contractions, letters, single digits and other signs. Texts with
characters beyond the tables below go through the tokenizer's own normaliser and splitter.
"""

from __future__ import annotations

import functools
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.blocks import BLOCK_BYTES, read_blocks, record, shard_count, source
from foldwise.llm.words import SPACED, U64, Words, pack, split_words, squeeze, unpack, unsqueeze
from foldwise.session import settle

#: Characters below this are classed by table; both sides agree on all of them.
TABLED = 0x530
LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
# Fixed value: the endings that are split off behind an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
OUT_CHARS = 4 << 20


@functools.lru_cache(1)
def _classes() -> np.ndarray:
    kinds = ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s"))
    return np.array([next((k for k, p in kinds if regex.match(p, chr(c))), OTHER) for c in range(TABLED)], np.uint8)


@functools.lru_cache(2)
def _tokenizers(definition: str):
    """(whole tokenizer, one that only takes single words, special strings to ids, id-to-piece table)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    whole = Tokenizer.from_str(definition)
    single = Tokenizer(whole.model)
    single.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    special = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
    pieces = {i: p for p, i in whole.get_vocab(with_added_tokens=True).items()}
    return whole, single, special, [pieces.get(i, "") for i in range(max(pieces) + 1)]


def _word_spans(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points as bytes, and word spans, of normalised text whose characters are all in the table."""
    wide = text.encode("utf-32-le")
    point = np.frombuffer(wide, np.uint32)
    kind = _classes()[point]
    cut = np.ones(len(point) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    if "'" in text:
        for at in np.flatnonzero(point == 0x27).tolist():
            if at and kind[at - 1] == OTHER:
                continue
            for ending in ENDINGS:
                if text.startswith(ending, at + 1):
                    cut[at + 1] = False
                    cut[at + 2 : at + 1 + len(ending)] = False
                    cut[at + 1 + len(ending)] = True
                    break
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    word = kind[start] != SPACE
    return wide, start[word], end[word]


def _odd_words(text: str, definition: str) -> list[str]:
    """Words of any text, by the tokenizer's own parts; byte-level letters are read back into characters."""
    whole, _, special, _ = _tokenizers(definition)
    out = []
    for part in re.split("(" + "|".join(map(re.escape, special)) + ")", text):
        if part in special:
            out.append(part)
        elif part:
            clean = whole.normalizer.normalize_str(part)
            out += [clean[a:b] for _, (a, b) in whole.pre_tokenizer.pre_tokenize_str(clean)]
    return out


def split_block(texts: list, definition: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, index of each word in text order, words per text)."""
    special = _tokenizers(definition)[2]
    table: dict[str, int] = {}
    order, sizes = [], np.zeros(len(texts), np.int64)
    plain, plain_at, size = [], [], 0

    def flush() -> None:
        nonlocal plain, plain_at, size
        if not plain:
            return
        text = "\n".join(plain)
        wide, start, end = _word_spans(text)
        where, which = Words(wide, 4 * start, 4 * end, np.zeros(1, np.int64)).distinct
        spelled = [text[a:b] for a, b in zip(start[where].tolist(), end[where].tolist())]
        local = np.array([table.setdefault(w, len(table)) for w in spelled], np.int64)
        stop = np.cumsum([len(t) + 1 for t in plain])
        edge = np.searchsorted(start, stop)
        flat = local[which]
        for i, x, y in zip(plain_at, np.append(0, edge[:-1]).tolist(), edge.tolist()):
            order.append((i, flat[x:y]))
        plain, plain_at, size = [], [], 0

    for i, raw in enumerate(texts):
        text = (raw or b"").decode()
        clean = text.lower()
        if not text.isascii():
            clean = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if (text.isascii() or max(text + clean) < chr(TABLED)) and not any(s in text for s in special):
            plain.append(clean), plain_at.append(i)
            size += len(clean)
            if size > 1 << 19:
                flush()
        else:
            found = _odd_words(text, definition)
            order.append((i, np.array([table.setdefault(w, len(table)) for w in found], np.int64)))
    flush()
    order.sort(key=lambda x: x[0])
    for i, x in order:
        sizes[i] = len(x)
    return list(table), np.concatenate([x for _, x in order]) if order else np.zeros(0, np.int64), sizes


def ranked(which: np.ndarray, n: int) -> tuple[bytes, bytes]:
    """Sequence with frequent words as small numbers, and the word of each number."""
    by_count = np.argsort(-np.bincount(which, minlength=n), kind="stable")
    rank = np.empty(n, np.uint32)
    rank[by_count] = np.arange(n, dtype=np.uint32)
    return pack(rank[which], 9), pack(by_count.astype(np.uint32))


SPLIT = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("known", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary()), ("order", pa.binary()), ("seq", pa.binary()), ("n_words", pa.int64())])
SENT = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("words", pa.binary())])
CODES = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("counts", pa.binary()), ("codes", pa.binary())])
ENCODED = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.string()), ("decoded", pa.string())])


def ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.binary(): "binary", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def joined(words: list[bytes]) -> bytes:
    return squeeze(b"\n".join(words), 3)


def listed(data: bytes) -> list[bytes]:
    whole = unsqueeze(data)
    return whole.split(b"\n") if whole else []


def word_names(words: list[bytes]) -> np.ndarray:
    """Names of words without white space, by which they are dealt to shards."""
    parts: Words = split_words([b"\n".join(words)], SPACED)
    return parts.names if len(words) else np.zeros(0, U64)


def by_name(which: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The same sequence over the same distinct words, these in the order of their names."""
    order = np.argsort(word_names(words), kind="stable")
    back = np.empty(len(words), np.int64)
    back[order] = np.arange(len(words))
    return back[which], [words[i] for i in order.tolist()]


def shard_edges(names: np.ndarray, shards: int) -> list[int]:
    """Where each shard begins in ascending names."""
    return np.searchsorted((((names >> U64(32)) * U64(shards)) >> U64(32)).astype(np.int64), np.arange(shards + 1)).tolist()


def _split(definition, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in read_blocks(batches, block_bytes):
            words, which, sizes = split_block(rows.texts, definition.value)
            which, raw = by_name(which, [w.encode() for w in words])
            seq, order = ranked(which, len(raw))
            yield record(SPLIT, [{"block": block, "ids": pack(rows.ids), "known": pack(rows.known.astype(np.uint8)), "sizes": pack(sizes), "words": joined(raw), "order": order, "seq": seq, "n_words": len(raw)}])

    return run


def _send(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words = listed(row["words"])
                edge = shard_edges(word_names(words), shards)
                yield record(SENT, [
                    {"shard": s, "block": row["block"], "words": joined(words[x:y])} for s, (x, y) in enumerate(zip(edge, edge[1:])) if y > x
                ])

    return run


def _encode(definition):
    def run(table: pa.Table) -> pa.Table:
        _, single, special, _ = _tokenizers(definition.value)
        rows = [(r["shard"], r["block"], listed(r["words"])) for r in table.to_pylist()]
        distinct = {w: j for j, w in enumerate(dict.fromkeys(w for _, _, words in rows for w in words))}
        codes, todo = [], list(distinct)
        for at in range(0, len(todo), 20_000):
            text = [w.decode() for w in todo[at : at + 20_000]]
            got = single.encode_batch_fast(text, add_special_tokens=False)
            codes += [[special[t]] if t in special else e.ids for t, e in zip(text, got)]
        out = []
        for shard, block, words in rows:
            own = [codes[distinct[w]] for w in words]
            flat = np.fromiter((i for c in own for i in c), np.uint32)
            out.append({"shard": shard, "block": block, "counts": pack(np.fromiter(map(len, own), np.uint32, len(own))), "codes": pack(flat)})
        return pa.Table.from_pylist(out, schema=CODES)

    return run


def _place(definition):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pieces = _tokenizers(definition.value)[3]
        answers = sorted(zip(right["shard"].to_pylist(), right["counts"].to_pylist(), right["codes"].to_pylist()))
        tables = []
        for row in left.to_pylist():
            count = np.concatenate([unpack(c) for _, c, _ in answers] or [np.zeros(0, np.uint32)]).astype(np.int64)
            ids, texts = [], []
            for _, counts, codes in answers:
                code, at = unpack(codes).tolist(), 0
                for n in unpack(counts).tolist():
                    own = code[at : at + n]
                    at += n
                    ids.append(" ".join(map(str, own)))
                    texts.append(" ".join([pieces[i] for i in own]))  # the id-to-piece join
            order = unpack(row["order"])
            seq = order[unpack(row["seq"])] if len(order) else np.zeros(0, np.int64)
            keys, known, edge = unpack(row["ids"]).tolist(), unpack(row["known"]).tolist(), np.cumsum(unpack(row["sizes"]))
            out, size = [], 0
            for i, (key, ok, e) in enumerate(zip(keys, known, edge.tolist())):
                own = seq[edge[i - 1] if i else 0 : e]
                place = own.tolist()
                a, b = " ".join([ids[j] for j in place]), " ".join([texts[j] for j in place])
                out.append({"id": key if ok else None, "n_tokens": int(count[own].sum()), "ids": a, "decoded": b})
                size += len(a) + len(b)
                if size > OUT_CHARS:
                    tables.append(pa.Table.from_pylist(out, schema=ENCODED))
                    out, size = [], 0
            tables.append(pa.Table.from_pylist(out, schema=ENCODED))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(tables)

    return run


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_tokens, ids, decoded) for every row: ids joined by one space, and the text they decode to.

    The tokenizer file is read on the driver and broadcast; its vocabulary bounds what is sent. A null
    text counts as empty and has no token; ids may be null or repeat, each row has its result. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = spark.sparkContext.broadcast(file.read())
    blocks = settle(source(docs, id_col, text_col).mapInArrow(_split(definition, block_bytes), ddl(SPLIT)))
    shards = shard_count(blocks.agg(F.sum("n_words")).first()[0], 500_000)
    sent = blocks.select("block", "words").mapInArrow(_send(shards), ddl(SENT))
    codes = sent.groupBy("shard").applyInArrow(_encode(definition), ddl(CODES))
    texts = blocks.drop("words", "n_words")
    return texts.groupBy("block").cogroup(codes.groupBy("block")).applyInArrow(_place(definition), ddl(ENCODED))


def vocabulary(spark, tokenizer_path: str) -> DataFrame:
    """The id-to-piece table (token, piece) of a tokenizer file."""
    with open(tokenizer_path, encoding="utf-8") as file:
        pieces = _tokenizers(file.read())[3]
    return spark.createDataFrame(list(enumerate(pieces)), "token int, piece string")


def decode(encoded: DataFrame, vocab: DataFrame, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of any table of space-joined ids, by a join with the id-to-piece table.

    Rows are dealt out by their place, so that equal ids and repeated rows stay apart. Unknown ids are
    left out; an empty or null list decodes to the empty text.
    """
    rows = settle(encoded.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(ids_col).alias("ids")))
    parts = rows.filter("ids <> ''").select("row", F.posexplode(F.split("ids", " ")).alias("pos", "token"))
    pieces = parts.select("row", "pos", F.col("token").cast("int").alias("token")).join(vocab, "token")
    texts = pieces.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("xs"))
    found = texts.select("row", F.array_join(F.col("xs")["piece"], " ").alias("decoded"))
    return rows.join(found, "row", "left").select("id", F.coalesce("decoded", F.lit("")).alias("decoded"))
