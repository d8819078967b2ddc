"""Side-by-side comparison of methods, scenarios and cohorts; schedules, coverage and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["roc_auc", "average_precision", "brier"]


def paired_oof(oof: DataFrame, keys: Sequence[str], methods: tuple[str, str]) -> DataFrame:
    """Two methods' averaged scores side by side per sample, and whether their labels agree.

    One aggregate instead of a self-join; a sample that lacks one method keeps a NULL there.
    """
    a, b = methods
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    return (
        oof.where(F.col("method").isin(a, b))
        .groupBy(*keys, "id")
        .agg(
            pick(a, "p_oof").alias("p_a"),
            pick(b, "p_oof").alias("p_b"),
            F.min("y_true").alias("y_true"),
            (F.min("y_true") == F.max("y_true")).alias("labels_agree"),
            F.count(F.lit(1)).alias("sides"),
        )
    )


def method_deltas(metrics: DataFrame, keys: Sequence[str], base: str, other: str) -> DataFrame:
    """One row per unit: both methods' metrics and ``other - base`` differences."""
    pick = lambda m, c: F.max(F.when(F.col("method") == m, F.col(c)))
    wide = metrics.groupBy(*keys).agg(
        F.max("n").alias("n_samples"),
        F.max("positive").alias("n_positive"),
        F.max("negative").alias("n_negative"),
        *[pick(m, c).alias(f"{m}_{c}") for m in (base, other) for c in METRICS],
    )
    return wide.withColumns({f"delta_{c}": F.col(f"{other}_{c}") - F.col(f"{base}_{c}") for c in METRICS})


def change_from_primary(deltas: DataFrame, fields: Sequence[str], primary: str = "primary") -> DataFrame:
    """Scenario rows joined to the primary row of their cohort, with change = value - primary value."""
    reference = deltas.where(F.col("scenario") == primary).select(
        "cohort", *[F.col(f).alias(f"primary_{f}") for f in fields]
    )
    joined = deltas.where(F.col("scenario") != primary).join(reference, "cohort", "left")
    return joined.withColumns({f"change_{f}": F.col(f) - F.col(f"primary_{f}") for f in fields})


def with_reference_method(metrics: DataFrame, keys: Sequence[str], reference: str) -> DataFrame:
    """Each method's metrics with their difference to a reference method of the same unit.

    Only the reference, the fully nested method, estimates performance; the others show what leaks.
    """
    ref = metrics.where(F.col("method") == reference).select(*keys, *[F.col(c).alias(f"ref_{c}") for c in METRICS])
    return (
        metrics.join(ref, list(keys), "left")
        .withColumns({f"delta_{c}": F.col(c) - F.col(f"ref_{c}") for c in METRICS})
        .withColumns({"valid_performance_estimator": F.col("method") == reference, "diagnostic_leakage": F.col("method") != reference})
        .drop(*[f"ref_{c}" for c in METRICS])
    )


def scenario_summary(deltas: DataFrame, groups: Sequence[str], field: str, change: str) -> DataFrame:
    """Median, range and sign counts of a delta over cohorts, and of its change from primary."""
    d = F.col(field)
    return deltas.groupBy(*groups).agg(
        F.count(d).alias("n_cohorts"),
        F.percentile(d, F.lit(0.5)).alias("median_delta"),
        F.min(d).alias("min_delta"),
        F.max(d).alias("max_delta"),
        F.count_if(d > 0).alias("n_positive_delta"),
        F.count_if(d < 0).alias("n_negative_delta"),
        F.count_if(d == 0).alias("n_zero_delta"),
        F.percentile(F.col(change), F.lit(0.5)).alias("median_change"),
    )


def coverage(expected: DataFrame, available: DataFrame, selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status of every expected unit: available or not, selected or not."""
    keys = list(keys)
    return (
        expected.join(available.select(*keys, F.lit(True).alias("_a")).distinct(), keys, "left")
        .join(selected.select(*keys, F.lit(True).alias("_s")).distinct(), keys, "left")
        .select(
            *keys,
            F.when(F.col("_a"), "available").otherwise("not_provided").alias("input_status"),
            F.when(F.col("_s"), "selected").otherwise("not_selected").alias("selection_status"),
        )
    )


def select_cohorts(requests: DataFrame, available: DataFrame, defaults: Sequence[str]) -> DataFrame:
    """Resolve selectors. ALL keeps the available defaults in default order; an explicit request
    that is missing or repeated becomes a row with its problem instead of an ordinal.

    ``requests`` is (selector, cohort, ord): cohort NULL asks for ALL.
    """
    present = available.select("cohort", F.lit(True).alias("_present")).distinct()
    listed = F.posexplode(F.array(*[F.lit(c) for c in defaults])).alias("_pos", "cohort")
    every = (
        requests.where("cohort IS NULL")
        .select("selector", listed)
        .join(present, "cohort")
        .select("selector", "cohort", (F.col("_pos") + 1).alias("ord"), F.lit("selected").alias("status"))
    )
    explicit = (
        requests.where("cohort IS NOT NULL")
        .withColumn("cohort", F.upper(F.trim("cohort")))
        .groupBy("selector", "cohort")
        .agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("_n"))
        .join(present, "cohort", "left")
        .select(
            "selector",
            "cohort",
            "ord",
            F.when(F.col("_n") > 1, "duplicate")
            .when(F.col("_present").isNull(), "missing")
            .otherwise("selected")
            .alias("status"),
        )
    )
    return every.unionByName(explicit)


def last_wins(schedule: DataFrame, keys: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """One row per key: the latest entry. An aggregate with map-side combine, no window."""
    return (
        schedule.groupBy(*keys)
        .agg(F.max(F.struct(order, *fields)).alias("_l"), F.count(F.lit(1)).alias("n_entries"))
        .select(*keys, "_l.*", "n_entries")
    )


def run_outcome(attempts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Completed and failed counts with the overall status of a run."""
    ok = F.count_if(F.col("status") == "completed")
    bad = F.count_if(F.col("status") == "failed")
    return attempts.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("units"),
        ok.alias("completed"),
        bad.alias("failed"),
        F.when(bad == 0, "completed").when(ok > 0, "completed_with_failures").otherwise("failed").alias("run_status"),
    )


def scale_comparison(original: DataFrame, rescaled: DataFrame) -> DataFrame:
    """Original against rescaled results, one row per (panel, cohort, method)."""
    keys = ["panel", "cohort", "method"]
    return original.select(*keys, F.col("value").alias("original")).join(
        rescaled.select(*keys, F.col("value").alias("scale_aware")), keys, "full_outer"
    ).withColumn("difference", F.col("scale_aware") - F.col("original"))
