"""Ingest: typed matrices from text, quality checks as violation rows, manifests, fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.scalars import clean_id, clean_name, finite, is_missing_token, parse_label, parse_number


def ingest(raw: DataFrame, keys: Sequence[str], id_col: str, label_col: str, features: Sequence[str]) -> DataFrame:
    """Text matrix to (keys, id, y, double features): headers trimmed, empty rows dropped."""
    return content_rows(raw, id_col, label_col, features).select(
        *keys,
        clean_id(id_col).alias("id"),
        parse_label(label_col).alias("y"),
        *[parse_number(f.strip()).alias(f.strip()) for f in features],
    )


def content_rows(raw: DataFrame, id_col: str, label_col: str, features: Sequence[str]) -> DataFrame:
    """The matrix under trimmed headers, without rows that hold nothing."""
    trimmed = raw.toDF(*[c.strip() for c in raw.columns])
    return trimmed.dropna("all", subset=[id_col, label_col, *[f.strip() for f in features]])


def admission(raw: DataFrame, keys: Sequence[str], id_col: str, label_col: str, features: Sequence[str]) -> DataFrame:
    """One row per matrix: its problems by kind and whether it is accepted as a whole.

    Unparsable and infinite tokens, labels without a class, blank and repeated ids reject the matrix.
    Rows are counted per id first, so a large matrix is combined before it meets one task.
    """
    names = [f.strip() for f in features]

    def tokens(test) -> Column:
        read = lambda f: F.col(f).isNotNull() & ~is_missing_token(f)
        return F.sum(reduce(add, [(read(f) & test(F.trim(f).try_cast("double"))).cast("bigint") for f in names]))

    per_id = content_rows(raw, id_col, label_col, features).groupBy(*keys, clean_id(id_col).alias("_id")).agg(
        F.count(F.lit(1)).alias("n"),
        tokens(lambda x: x.isNull()).alias("non_numeric"),
        tokens(lambda x: x.isNotNull() & ~finite(x)).alias("non_finite"),
        F.count_if(parse_label(label_col).isNull()).alias("unknown_label"),
    )
    blank = F.col("_id").isNull() | (F.col("_id") == "")
    kinds = ["non_numeric", "non_finite", "unknown_label", "blank_id", "duplicate_id"]
    found = per_id.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"),
        *[F.sum(c).alias(c) for c in kinds[:3]],
        F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("blank_id"),
        F.sum(F.when(~blank, F.col("n") - 1).otherwise(0)).alias("duplicate_id"),
    )
    problems = F.concat_ws(",", *[F.when(F.col(c) > 0, c) for c in kinds])
    status = F.when(F.col("problems") == "", "accepted").otherwise("rejected")
    return found.withColumn("problems", problems).withColumn("status", status)


def admit(matrix: DataFrame, manifest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of accepted matrices: a rejected one leaves no row behind, the others go on."""
    return matrix.join(manifest.where(F.col("status") == "rejected"), list(keys), "left_anti")


def to_long(matrix: DataFrame, ids: Sequence[str], features: Sequence[str]) -> DataFrame:
    return matrix.unpivot(list(ids), list(features), "feature", "value")


def cell_problems(raw_long: DataFrame) -> DataFrame:
    """Strict typing before any repair: tokens that are neither numbers nor declared missing."""
    number = F.trim("token").try_cast("double")
    problem = (
        F.when(F.col("token").isNull() | is_missing_token("token"), None)
        .when(number.isNull(), "non_numeric")
        .when(~finite(number), "non_finite")
    )
    return raw_long.withColumn("problem", problem).where(F.col("problem").isNotNull())


def id_problems(raw: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """Blank and duplicate identifiers after normalisation."""
    counted = raw.groupBy(*keys, clean_id(id_col).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    blank = F.col("id").isNull() | (F.col("id") == "")
    return (
        counted.withColumn("problem", F.when(blank, "blank_id").when(F.col("n") > 1, "duplicate_id"))
        .where(F.col("problem").isNotNull())
    )


def first_offenders(problems: DataFrame, order: Sequence[str], n: int = 10) -> DataFrame:
    """The first ``n`` rows of an error report."""
    return problems.orderBy(*order).limit(n)


def header_problems(headers: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Headers that collide after normalisation, or are blank."""
    return (
        headers.groupBy(*keys, clean_name(name).alias("normalized"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) | (F.col("normalized") == ""))
    )


def feature_manifest(cells: DataFrame, masked: Column) -> DataFrame:
    """Counts per (cohort, feature). Values are grouped first, so distinct counts need no sets.

    ``cells`` has cohort, feature, value (as read); ``masked`` is the value after the rules.
    """
    v = F.col("value")
    per_value = cells.withColumn("_masked", masked).groupBy("cohort", "feature", "_masked").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(v.isNull()).alias("n_null"),
        F.count_if(v == 0).alias("n_zero"),
        F.count_if(v < 0).alias("n_negative"),
    )
    return (
        per_value.groupBy("cohort", "feature")
        .agg(
            F.sum("n").alias("n_samples"),
            F.sum("n_null").alias("n_original_missing"),
            F.sum("n_zero").alias("n_zero"),
            F.sum("n_negative").alias("n_negative"),
            F.sum(F.when(F.col("_masked").isNull(), F.col("n")).otherwise(0)).alias("n_missing_after_rules"),
            F.count("_masked").alias("n_unique_valid"),
        )
        .withColumn("missing_rate_after_rules", F.col("n_missing_after_rules") / F.col("n_samples"))
        .withColumn("included_in_analysis", F.col("n_missing_after_rules") < F.col("n_samples"))
        .withColumn(
            "global_exclusion_reason",
            F.when(F.col("included_in_analysis"), "").otherwise("all_missing_after_feature_rules"),
        )
    )


def missingness(manifest: DataFrame) -> DataFrame:
    """Input and retained missingness per cohort from its manifest."""
    kept, missing = F.col("included_in_analysis"), F.col("n_missing_after_rules")
    n = F.max("n_samples")
    features, remaining = F.count(F.lit(1)), F.count_if(kept)
    left = F.sum(F.when(kept, missing).otherwise(0))
    return manifest.groupBy("cohort").agg(
        n.alias("n_samples"),
        features.alias("input_features"),
        (features - remaining).alias("all_missing_excluded"),
        remaining.alias("remaining_features"),
        F.sum(missing).alias("missing_cells_input"),
        left.alias("missing_cells_remaining"),
        (F.sum(missing) / (n * features)).alias("missing_rate_input"),
        (left / F.nullif(n * remaining, F.lit(0))).alias("missing_rate_remaining"),
        F.count_if(kept & (missing > 0)).alias("remaining_features_with_missing"),
    )


def fingerprint(df: DataFrame, groups: Sequence[str], parts: Sequence[Column]) -> DataFrame:
    """Order-independent fingerprint of a row set per group.

    Each row is hashed; the four 32-bit pieces of the hashes are summed exactly, so the aggregate
    combines on the map side and no group is ever collected. The count and the sums are hashed.
    """
    row = F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("missing")) for p in parts]), 256)
    pieces = [
        F.sum(F.conv(F.substring("_row", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).cast("string")
        for i in range(4)
    ]
    return (
        df.withColumn("_row", row)
        .groupBy(*groups)
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *pieces), 256).alias("fingerprint"))
    )


def restore_mask(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Listed cells that hold 0 become NULL; every other cell is unchanged."""
    marked = mask.select("cohort", "id", "feature", F.lit(True).alias("_listed"))
    listed_zero = F.col("_listed") & (F.col("value") == 0)
    return (
        cells.join(marked, ["cohort", "id", "feature"], "left")
        .withColumn("value", F.when(F.coalesce(listed_zero, F.lit(False)), None).otherwise(F.col("value")))
        .drop("_listed")
    )


def restoration_check(before: DataFrame, after: DataFrame, mask: DataFrame) -> DataFrame:
    """Cell-by-cell comparison of a repaired matrix with its source, counted per cohort."""
    keys = ["cohort", "id", "feature"]
    joined = (
        before.select(*keys, F.col("value").alias("b"), F.lit(True).alias("in_b"))
        .join(after.select(*keys, F.col("value").alias("a"), F.lit(True).alias("in_a")), keys, "full_outer")
        .join(mask.select(*keys, F.lit(True).alias("listed")), keys, "left")
    )
    listed, same = F.col("listed").isNotNull(), F.col("a").eqNullSafe(F.col("b"))
    return joined.groupBy("cohort").agg(
        F.count_if(listed & (F.col("b") == 0) & F.col("a").isNull()).alias("restored"),
        F.count_if(listed & ~F.coalesce(F.col("b") == 0, F.lit(False))).alias("listed_not_zero"),
        F.count_if(~listed & ~same).alias("changed_unlisted"),
        F.count_if((F.col("a") == 0) & ~listed).alias("genuine_zeros"),
        F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("layout_changes"),
    )
