"""The registered queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm import bpe, chat, decontaminate, langid, licenses, lm, media, personal, quality, recompress, simhash, spelling, trie


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(divisor: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % divisor


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_contamination(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"))
    x = F.col("contamination")
    return found.select(
        "doc_id", x["n_words"].alias("n_words"), x["n_hit"].alias("n_hit"), F.size(x["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(x["items"], ","), 256).alias("items_sha256"), (x["n_hit"] > 0).alias("contaminated"),
    )


def op2_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def op3_licenses(spark: SparkSession, folder: str) -> DataFrame:
    x = F.col("license")
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    found = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[x[n].alias(n) for n in names], F.size(x["detections"]).cast("bigint").alias("n_detections"))


def op4_language_model(spark: SparkSession, folder: str) -> DataFrame:
    found = lm.score_texts(table(spark, folder, "documents"), remainder(10) != 0)
    return found.withColumnRenamed("id", "doc_id")


def op5_chat_rotation(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rotate(table(spark, folder, "conversations"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    scored = quality.score_quality(docs, labels, remainder(5) != 0)
    return scored.select("doc_id", (remainder(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = bpe.encode(table(spark, folder, "documents"), tokenizer_path())
    return found.select(F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_media(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    stored = media.sniff(media.store_texts(docs).withColumn("declared", F.lit("application/octet-stream")), "media", "declared")
    host = F.get(F.filter(F.col("sniffed")["segments"], lambda s: (s["start"] == 0) & (s["kind"] == F.col("sniffed")["kind"])), F.lit(0))
    carved = stored.withColumn("host", host).withColumn("carved", F.expr("substring(media, 1, CAST(host.stop AS INT))"))
    read = media.read_samples(carved, "carved")
    payload = F.col("read")["payload"]
    return read.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.expr("substring(read.payload, octet_length(read.payload) - 63, 64)")).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.col("read")["feature"].alias("feature"),
        F.col("sniffed")["kind"].alias("kind"), F.size(F.col("sniffed")["segments"]).cast("bigint").alias("n_segments"),
    )


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    found = langid.identify(table(spark, folder, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), F.col("language")["lang_pred"].alias("lang_pred"), F.col("language")["score"].alias("score"))


def op10_recompression(spark: SparkSession, folder: str) -> DataFrame:
    found = recompress.remove_repeats(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.conversation_trie(table(spark, folder, "conversations"))


def op12_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found, _ = personal.find(table(spark, folder, "documents"))
    written = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(F.col("id").alias("doc_id"), *map(n, personal.BASE_KINDS), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_simhash, op3_licenses, op4_language_model, op5_chat_rotation,
        op6_quality, op7_bpe, op8_media, op9_language, op10_recompression, op11_prefix_trie,
        op12_personal_data, op13_spelling_variants,
    )
}
