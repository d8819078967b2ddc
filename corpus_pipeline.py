"""A corpus pipeline of five stages; each stage's result is written and read again as the next one's documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import bpe, decontaminate, langid, recompress, simhash
from foldwise.llm.queries import table, tokenizer_path
from foldwise.session import checkpoint_folder

#: A predicted language below this probability is rejected, as is a text without letters.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those with a null or empty text or without a letter go.

    Repeated rows are judged each; all columns stay as they are, whatever their names.
    """
    found = langid.identify(docs, into="__language")
    known = (F.col("__language")["lang_pred"] != langid.UNKNOWN) & (F.col("__language")["score"] >= LEAST_SCORE)
    return found.filter(known).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id.

    Empty and null texts are one group; a document without an id is in none and stays.
    """
    return simhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also start in a document of smaller id.

    Untouched texts stay as they are; of others the kept words are joined by one space and ``n_chars`` follows.
    A document of which nothing is left goes; a null, empty or short text stays.
    """
    rest = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    found = recompress.remove_repeats(docs, rest=rest, with_text=True)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name not in ("doc_id", "text"))
    touched = F.col("n_removed") > 0
    columns = {"doc_id": F.col("id"), "text": F.when(touched, F.col("kept")).otherwise(F.col("text"))}
    if rest:
        found = found.withColumn("rest", F.from_json("rest", kinds))
        columns |= {f.name: F.col("rest")[f.name] for f in docs.schema if f.name not in columns}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(touched, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return found.filter(~touched | (F.col("kept") != "")).select(*[columns[c].alias(c) for c in docs.columns])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; null and empty texts have none, repeated rows are judged each."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), into="__contamination")
    return found.filter(F.col("__contamination")["n_hit"] == 0).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of ids and decoded text; a null text counts as empty."""
    found = bpe.encode(docs, tokenizer_path())
    return found.select(
        F.col("id").alias("doc_id"), "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("token_ids", token_ids),
]
#: Language identification is trained and names are hashed in rounds: no SQL. Tests hold stages 2 to 4 against brute
#: force, the last against the tokenizer; of the first they take the decision from the model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for j, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{j}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
