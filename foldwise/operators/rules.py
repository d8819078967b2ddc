"""Feature rules: resolution, validity, value masks, retained features and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.scalars import clean_name

FIELDS = ["transform", "zero_is_missing", "negative_is_missing", "half_minimum_allowed", "input_scale"]
# The positive-intensity default, the rule of a log10-scaled cohort.
DEFAULT = {
    "transform": "log1p",
    "zero_is_missing": True,
    "negative_is_missing": True,
    "half_minimum_allowed": True,
    "input_scale": "linear",
}
LOG10 = {
    "transform": "identity",
    "zero_is_missing": False,
    "negative_is_missing": False,
    "half_minimum_allowed": True,
    "input_scale": "log10",
}
RULE_SCHEMA = (
    "transform string, zero_is_missing boolean, negative_is_missing boolean, "
    "half_minimum_allowed boolean, input_scale string"
)


def resolve_rules(
    features: DataFrame, named: DataFrame, overrides: DataFrame, scales: DataFrame | None = None
) -> DataFrame:
    """Rule of every (cohort, feature): override, else named exception, else scale or default rule.

    ``named`` has feature + rule fields, ``overrides`` cohort + feature + rule fields, ``scales``
    cohort + input_scale. Names match after normalisation. All three are small dimension tables;
    Spark broadcasts them from their measured size.
    """
    base = features.select("cohort", "feature").withColumn("_name", clean_name("feature"))
    named = named.select(clean_name("feature").alias("_name"), F.struct(*FIELDS).alias("_named"))
    overrides = overrides.select("cohort", clean_name("feature").alias("_name"), F.struct(*FIELDS).alias("_own"))
    joined = base.join(named, "_name", "left").join(overrides, ["cohort", "_name"], "left")
    if scales is None:
        log_scaled: Column = F.lit(False)
    else:
        joined = joined.join(scales.select("cohort", F.col("input_scale").alias("_scale")), "cohort", "left")
        log_scaled = F.coalesce(F.col("_scale") == "log10", F.lit(False))
    return joined.select(
        "cohort",
        "feature",
        *[
            F.coalesce(
                F.col(f"_own.{f}"),
                F.col(f"_named.{f}"),
                F.when(log_scaled, F.lit(LOG10[f])).otherwise(F.lit(DEFAULT[f])),
            ).alias(f)
            for f in FIELDS
        ],
    )


def rule_violation() -> Column:
    """Name of the broken rule constraint, NULL when the rule is valid."""
    log_like = F.col("input_scale").isin("log10", "derived_log10_ratio")
    return (
        F.when(~F.col("transform").isin("log1p", "identity"), "unsupported_transform")
        .when(~F.col("input_scale").isin("linear", "log10", "derived_log10_ratio"), "unsupported_scale")
        .when(
            log_like & ((F.col("transform") != "identity") | F.col("zero_is_missing") | F.col("negative_is_missing")),
            "log_scale_needs_identity_and_valid_values",
        )
        .when(
            (F.col("input_scale") == "derived_log10_ratio") & F.col("half_minimum_allowed"),
            "ratio_forbids_half_minimum",
        )
    )


def masked_value(value: Column | str = "value") -> Column:
    """Negative and zero values to NULL where the rule says so."""
    v = F.col(value) if isinstance(value, str) else value
    return (
        F.when(F.col("negative_is_missing") & (v < 0), None)
        .when(F.col("zero_is_missing") & (v == 0), None)
        .otherwise(v)
    )


def apply_rules(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """cells with the rule columns and the masked value."""
    return cells.join(rules, ["cohort", "feature"]).withColumn("value", masked_value())


def all_missing_features(masked: DataFrame) -> DataFrame:
    """(cohort, feature) without any observed value after the rules."""
    return (
        masked.groupBy("cohort", "feature").agg(F.count("value").alias("observed")).where("observed = 0").drop("observed")
    )


def retained_cells(masked: DataFrame) -> DataFrame:
    return masked.join(all_missing_features(masked), ["cohort", "feature"], "left_anti")


def empty_samples(masked: DataFrame) -> DataFrame:
    """Samples without any observed value over the retained features."""
    return (
        retained_cells(masked)
        .groupBy("cohort", "id")
        .agg(F.count("value").alias("observed"))
        .where("observed = 0")
        .select("cohort", "id")
    )


def required_and_forbidden(features: DataFrame, required: DataFrame, exact: DataFrame, patterns: DataFrame) -> DataFrame:
    """Violation rows: required features that are absent, forbidden ones that are present."""
    present = features.select("cohort", "feature", clean_name("feature").alias("_name"))
    wanted = required.select("cohort", "feature", clean_name("feature").alias("_name"))
    banned = exact.select("cohort", clean_name("feature").alias("_name"))
    missing = wanted.join(present, ["cohort", "_name"], "left_anti").select(
        "cohort", "feature", F.lit("required_missing").alias("problem")
    )
    named = present.join(banned, ["cohort", "_name"], "left_semi").select(
        "cohort", "feature", F.lit("forbidden_name").alias("problem")
    )
    matched = (
        present.join(patterns, "cohort")
        .where(F.expr("rlike(feature, pattern)"))
        .select("cohort", "feature", F.lit("forbidden_pattern").alias("problem"))
        .distinct()
    )
    return missing.unionByName(named).unionByName(matched)
