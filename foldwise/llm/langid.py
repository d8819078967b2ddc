"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Grams of one to three characters of the lower-cased text are hashed into ``SIZE`` buckets. Document
frequencies cover every training text. Weights come from follow-the-regularised-leader with L1 and L2
penalties over a sample of at most ``per_language`` texts of each language, drawn by a hash; a fifth of the
sample is kept out of it and sets the temperature of the softmax.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from foldwise.llm.words import session_limits
from foldwise.session import settle

SIZE = 1 << 16
ORDERS = (1, 2, 3)
PER_LANGUAGE = 1500
EPOCHS = 2
RATE, SOFTEN, L1, L2 = 0.5, 1.0, 0.02, 0.01
PIECE = 1 << 20
UNKNOWN = "und"


def has_letter(text) -> bool:
    return isinstance(text, str) and (re.search("[A-Za-z]", text) is not None or any(map(str.isalpha, text)))


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket occurs in the text."""
    out = np.zeros(SIZE, np.int64)
    text = text.lower()
    shift = np.uint32(32 - SIZE.bit_length() + 1)
    for at in range(0, len(text), PIECE):
        point = np.frombuffer(text[at : at + PIECE + ORDERS[-1] - 1].encode("utf-32-le"), np.uint32)
        for n in ORDERS:
            m = min(PIECE, len(point) - n + 1)
            if m > 0:
                name = np.full(m, n, np.uint32)
                for j in range(n):
                    name = (name ^ point[j : j + m]) * np.uint32(0x9E3779B1)
                    name ^= name >> np.uint32(15)
                out += np.bincount((name * np.uint32(0x85EBCA6B)) >> shift, minlength=SIZE)
    return out


def weighted(text: str, idf: np.ndarray) -> np.ndarray:
    value = gram_counts(text) * idf
    return value / max(np.sqrt(value @ value), 1e-12)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = softmax((weighted(text, self.idf) @ self.weights + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[int], idf: np.ndarray, n_classes: int):
    """FTRL-proximal; returns weights, bias and temperature."""
    rng = np.random.default_rng(1)
    z, n = np.zeros((SIZE + 1, n_classes)), np.zeros((SIZE + 1, n_classes))

    def current(at: np.ndarray) -> np.ndarray:
        push = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
        return -push / ((SOFTEN + np.sqrt(n[at])) / RATE + L2)

    kept = [i for i in range(len(texts)) if i % 5]
    for _ in range(EPOCHS):
        for i in rng.permutation(kept):
            x = weighted(texts[i], idf)
            at = np.append(np.flatnonzero(x), SIZE)
            x = np.append(x[at[:-1]], 1.0)
            w = current(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / RATE
            z[at] += g - sigma * w
            n[at] += g * g
    w = current(np.arange(SIZE + 1))
    rest = [i for i in range(len(texts)) if i % 5 == 0]
    scores = np.array([weighted(texts[i], idf) @ w[:-1] + w[-1] for i in rest]).reshape(len(rest), n_classes)
    truth = np.array([labels[i] for i in rest], np.int64)
    grid = np.exp(np.linspace(np.log(0.02), np.log(20), 139))
    loss = [-np.log(softmax(scores / t)[np.arange(len(rest)), truth] + 1e-12).mean() if rest else abs(np.log(t)) for t in grid]
    return w[:-1], w[-1], float(grid[int(np.argmin(loss))])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(SIZE, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            found += gram_counts(text) > 0
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(found[at], pa.int64())})


def _trainer(idf, languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()))
        if rows:
            w, b, t = train([r[2] for r in rows], [languages.index(r[1]) for r in rows], idf.value, len(languages))
            yield pa.RecordBatch.from_pydict({"weights": [w.astype("<f8").tobytes()], "bias": [b.astype("<f8").tobytes()], "temperature": [t]})

    return run


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from the rows with a label and a letter; ids only seed the draw of the sample."""
    spark = labelled.sparkSession
    session_limits(spark)
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("lang"), F.col(id_col).alias("id"))
    rows = rows.filter("lang is not null and text rlike '\\\\p{L}'")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros(SIZE), np.zeros((SIZE, 0)), np.zeros(0), 1.0)
    frequency = np.zeros(SIZE, np.int64)
    for r in rows.select("text").mapInArrow(_frequencies, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        frequency[r["bucket"]] = r["n"]
    idf = np.log((1 + sum(counts.values())) / (1 + frequency)) + 1
    # A share a little above the bound is drawn by hash, then the bound itself holds for each language.
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, 1.2 * per_language / counts[k] + 1e-9))])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    drawn = rows.withColumn("draw", draw).filter(F.col("draw") < share[F.col("lang")] * (1 << 30))
    ranked = drawn.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "id")))
    sample = ranked.filter(F.col("place") <= per_language).select("draw", "lang", "text").repartition(1)
    shared = spark.sparkContext.broadcast(idf)
    got = sample.mapInArrow(_trainer(shared, languages), "weights binary, bias binary, temperature double").first()
    weights = np.frombuffer(bytes(got["weights"])).reshape(SIZE, len(languages))
    return LanguageModel(languages, idf, weights, np.frombuffer(bytes(got["bias"])), got["temperature"])


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", into: str = "language") -> DataFrame:
    """Add ``into``: lang_pred and score. Null texts and texts without a letter are ``und`` with score 0.

    Rows and other columns stay; a column named as ``into`` is replaced.
    """
    session_limits(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    return docs.withColumn(into, predict(F.col(text_col)))


def is_training(id_col: str = "doc_id"):
    """Three quarters of the ids by a checksum; a null id counts as empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 != 2


def identify(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", into: str = "language") -> DataFrame:
    """Fit on the training share of the labelled rows, then add ``into`` (lang_pred and score) to all."""
    model = fit(docs.filter(is_training(id_col)), text_col, label_col, id_col)
    return with_language(docs, model, text_col, into)
