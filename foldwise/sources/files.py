"""File sources and sinks: cohort matrices found by name, text exports, JSON settings, result bundles."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldwise.session import checkpoint_folder

# Fixed value: the name pattern of a cohort matrix.
KEY_PATTERN = r"(dataset[0-9]+_(?:pre|post1|post2))(?:[./]|$)"
# Fixed value: the first and last number of a data set.
DATASET_NUMBERS = (1, 7)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def key_of(path) -> F.Column:
    """Cohort key in a path; NULL when the name does not follow the pattern."""
    return F.nullif(F.regexp_extract(F.lower(path), KEY_PATTERN, 1), F.lit(""))


def key_parts(key) -> tuple:
    """(number, time point) of a cohort key."""
    return (
        F.regexp_extract(key, r"^dataset([0-9]+)_", 1).cast("int"),
        F.regexp_extract(key, r"_(pre|post1|post2)$", 1),
    )


def write_matrices(matrix: DataFrame, folder: str, key: str, sep: str = ",") -> None:
    """One folder per cohort key; an existing folder is an error, nothing is overwritten."""
    matrix.write.mode("errorifexists").partitionBy(key).csv(folder, header=True, sep=sep, nullValue="NA")


def scan_matrices(
    spark: SparkSession, folder: str, features: Sequence[str], id_col: str = "id", label_col: str = "category", sep: str = ","
) -> DataFrame:
    """Every matrix file below ``folder`` as text columns plus its cohort key.

    The schema is given, never inferred, so identifiers stay text (leading zeros survive).
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [id_col, label_col, *features]])
    raw = (
        spark.read.schema(schema)
        .option("recursiveFileLookup", "true")
        .csv(folder, header=True, sep=sep, enforceSchema=False)
    )
    return raw.select(key_of(F.col("_metadata.file_path")).alias("cohort_key"), "*")


def key_inventory(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files below ``folder`` with their key: unknown names have a NULL key; only names are read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(folder)
        .select("path", "length")
    )
    return files.withColumn("cohort_key", key_of(F.col("path")))


def key_problems(files: DataFrame, path: str = "path", numbers: tuple[int, int] = DATASET_NUMBERS) -> DataFrame:
    """(path, cohort_key, problem) of files that can't be taken: unknown names, numbers out of range, keys with several files."""
    key = F.regexp_replace(key_of(F.col(path)), "^dataset0+(?=[0-9])", "dataset")
    keyed = files.select(F.col(path).alias("path"), key.alias("cohort_key"))
    counts = keyed.where(F.col("cohort_key").isNotNull()).groupBy("cohort_key").agg(F.count(F.lit(1)).alias("n"))
    number, _ = key_parts(F.col("cohort_key"))
    problem = (
        F.when(F.col("cohort_key").isNull(), "unknown_name")
        .when(~number.between(*numbers), "number_out_of_range")
        .when(F.col("n") > 1, "several_files_per_key")
    )
    return keyed.join(counts, "cohort_key", "left").select("path", "cohort_key", problem.alias("problem")).where("problem is not null")


def read_settings(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON settings with a declared schema."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_bundle(tables: dict[str, DataFrame], folder: str, partition_by: Sequence[str]) -> None:
    """One table per artifact, partitioned by unit keys; an existing table is an error."""
    for name, df in tables.items():
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(f"{folder}/{name}")


def read_bundle(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def bundle_summary(tables: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Row count per table and unit."""
    parts = [
        df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), *keys, "n_rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)
