"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position i gets a non-zero code m(i) of radius + 1 bits. Table v (each non-zero code) keeps the
bits whose m(i) has odd parity with v. For at most ``radius`` positions there is a v that has even
parity with all their codes: so a pair within the radius agrees on all kept bits of some table, always.

Fingerprints are made distinct first, so copies cost one row. A bucket of up to ``PAIRWISE`` fingerprints
is compared pair by pair. In a larger one all members agree on the kept bits, so links of radius 2 are
found through common neighbours instead: each member names itself and its one-bit changes of the other
bits; members that name the same value lie within two bits of each other, and a value has at most 65
members. That is linear in the bucket and exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.graph import components, split_join
from foldwise.llm.words import session_limits, utf8
from foldwise.session import settle

RADIUS = 2
BITS = 64
PAIRWISE = 64
SHINGLE = 3
PIECE = 1 << 16


def _votes(values: np.ndarray) -> np.ndarray:
    """For each bit, how many values set it."""
    bits = np.unpackbits(values.view(np.uint8), bitorder="little").reshape(-1, BITS)
    whole = len(bits) // 255 * 255
    votes = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        votes += bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return votes


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """64-bit SimHash over XXH64 of the shingles, as a signed number; 0 without words."""
    words = text.split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(width + 1) - 1
    start = stop - width
    size = min(size, len(words))
    first, last = start[: len(words) - size + 1].tolist(), stop[size - 1 :].tolist()
    votes, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(first), PIECE):
        spans = zip(first[at : at + PIECE], last[at : at + PIECE])
        hashes = np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)
        votes += _votes(hashes)
    return int(np.packbits(votes * 2 > len(first), bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", into: str = "fp") -> DataFrame:
    """Add the fingerprint as a long; null texts have 0."""
    session_limits(docs.sparkSession)

    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(utf8(t, lower=True)) for t in texts], dtype="int64")

    return docs.withColumn(into, prints(F.col(text_col)))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def covering_masks(radius: int = RADIUS) -> list[int]:
    codes = (1 << (radius + 1)) - 1
    code = [1 + i % codes for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (code[i] & v).bit_count() % 2) for v in range(1, codes + 1)]


def links(prints: DataFrame) -> DataFrame:
    """``prints(fp, rep)`` with distinct fp -> edges (a, b) of reps that cover every pair within the radius.

    Within a large bucket only links to the smallest member of each common neighbour are written; the
    rest follow from them.
    """
    masks = covering_masks()
    tables = prints.select(
        "fp",
        "rep",
        F.explode(
            F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks)])
        ).alias("x"),
    ).select("x.t", "x.key", "fp", "rep")
    sizes = tables.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = settle(split_join(tables, sizes, ["t", "key"]))
    members = F.collect_list(F.struct("rep", "fp"))
    small = found.filter(F.col("n") <= PAIRWISE).groupBy("t", "key").agg(F.array_sort(members).alias("xs"))

    def near(x, y):
        return (x["rep"] < y["rep"]) & (F.bit_count(x["fp"].bitwiseXOR(y["fp"])) <= RADIUS)

    pairs = F.flatten(
        F.transform("xs", lambda x: F.transform(F.filter("xs", lambda y: near(x, y)), lambda y: F.struct(y["rep"].alias("a"), x["rep"].alias("b"))))
    )
    close = small.select(F.explode(pairs).alias("e")).select("e.a", "e.b")
    flips = F.array(
        *[
            F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)) for i in range(BITS) if not m >> i & 1])
            for m in masks
        ]
    )
    around = (
        found.filter(F.col("n") > PAIRWISE)
        .select("fp", "rep", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"))
        .select(F.col("fp").bitwiseXOR(F.col("flip")).alias("z"), "rep")
    )
    stars = (
        around.groupBy("z")
        .agg(F.collect_set("rep").alias("reps"))
        .filter(F.size("reps") > 1)
        .select(F.explode("reps").alias("a"), F.array_min("reps").alias("b"))
        .filter("a <> b")
    )
    return close.union(stars)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, n_same) for every row.

    ``component_id`` is the smallest id that can be reached over fingerprints at 2 or fewer differing
    bits; ``n_same`` counts the rows with this very fingerprint. Texts without words have fingerprint 0
    and are linked like any other. Rows that repeat an id are one document: their fingerprints are
    linked. A row with a null id joins no group, its component is null. An empty table gives an empty
    result.
    """
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("__text"))
    prints = settle(
        with_fingerprint(named, "__text").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"))
    )
    known, unknown = prints.filter("doc_id is not null"), prints.filter("doc_id is null")
    reps = settle(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_same")))
    several = known.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).filter("x <> y").select("doc_id")
    through = split_join(known, several, ["doc_id"]).join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    roots = components(links(reps).union(through))
    classes = settle(
        reps.join(roots, reps["rep"] == roots["node"], "left").select(
            F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.coalesce("root", "rep").alias("component_id"), "n_same"
        )
    )
    nothing = F.lit(None).cast("bigint")
    return (
        known.select("doc_id", "fingerprint")
        .join(classes, "fingerprint")
        .select("doc_id", "fingerprint", "component_id", "n_same")
        .union(unknown.select("doc_id", "fingerprint", nothing, nothing))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of its component: one document of each group stays.

    Rows that repeat an id stay or go together; rows with a null id stay.
    """
    kept = near_duplicates(docs, id_col, text_col).filter("doc_id = component_id").select(F.col("doc_id").alias("__kept"))
    named = docs.filter(F.col(id_col).isNotNull())
    return named.join(kept, named[id_col].cast("bigint") == kept["__kept"], "left_semi").union(docs.filter(F.col(id_col).isNull()))
