"""Agreement of the feature sets chosen by the outer fits of a cohort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.metrics import dispersion
from foldwise.session import settle


def nogueira(table: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Selection stability over the completed feature x fit universe of each group.

    ``table`` has one row per (group, fit_id, feature) with boolean ``used``; it is settled because
    several aggregates read it.
    """
    groups = list(groups)
    table = settle(table.select(*groups, "fit_id", "feature", "used"))
    per_fit = table.groupBy(*groups, "fit_id").agg(F.count_if("used").alias("k"))
    sizes = per_fit.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_outer_fits"),
        F.avg("k").alias("mean_model_feature_n"),
        F.percentile("k", F.lit(0.5)).alias("median_model_feature_n"),
        F.min("k").alias("min_model_feature_n"),
        F.max("k").alias("max_model_feature_n"),
    )
    per_feature = table.groupBy(*groups, "feature").agg(
        F.count(F.lit(1)).alias("B"), F.avg(F.col("used").cast("double")).alias("f")
    )
    spread = per_feature.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("feature_universe_n"),
        F.avg(F.col("B") / (F.col("B") - 1.0) * F.col("f") * (1 - F.col("f"))).alias("_var"),
    )
    q = F.col("mean_model_feature_n") / F.col("feature_universe_n")
    few = F.col("n_outer_fits") < 2
    flat = (q <= 1e-8) | (q >= 1 - 1e-5)
    return (
        sizes.join(spread, groups)
        .withColumn(
            "nogueira_stability",
            F.when(~few & ~flat, 1 - F.col("_var") / F.nullif(q * (1 - q), F.lit(0.0))),
        )
        .withColumn(
            "stability_status",
            F.when(few, "insufficient_B_or_p").when(flat, "degenerate_all_none_or_all").otherwise("ok"),
        )
        .drop("_var")
    )


def pairwise_jaccard(table: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Jaccard index of every unordered pair of fits of a group.

    A cohort has a fixed number of fits (folds x repeats), so the pairs are the result itself. The
    intersections come from an equi-join on the feature; sizes follow by inclusion-exclusion.
    """
    groups = list(groups)
    table = settle(table.select(*groups, "fit_id", "feature", "used"))
    sizes = table.groupBy(*groups, "fit_id").agg(F.count_if("used").alias("k"))
    used = table.where("used").select(*groups, "fit_id", "feature")
    a = used.withColumnRenamed("fit_id", "fit_a")
    shared = (
        a.join(used.withColumnRenamed("fit_id", "fit_b"), [*groups, "feature"])
        .where("fit_a < fit_b")
        .groupBy(*groups, "fit_a", "fit_b")
        .agg(F.count(F.lit(1)).alias("common"))
    )
    left = sizes.select(*groups, F.col("fit_id").alias("fit_a"), F.col("k").alias("size_a"))
    right = sizes.select(*groups, F.col("fit_id").alias("fit_b"), F.col("k").alias("size_b"))
    pairs = left.join(right, groups).where("fit_a < fit_b").join(shared, [*groups, "fit_a", "fit_b"], "left")
    common = F.coalesce("common", F.lit(0))
    union = F.col("size_a") + F.col("size_b") - common
    return pairs.select(
        *groups,
        "fit_a",
        "fit_b",
        (F.split("fit_a", "-")[0] == F.split("fit_b", "-")[0]).alias("same_repeat"),
        F.coalesce(common / F.nullif(union, F.lit(0)), F.lit(1.0)).alias("jaccard"),
    )


def jaccard_summary(pairs: DataFrame, groups: Sequence[str]) -> DataFrame:
    return dispersion(pairs, groups, "jaccard").withColumnRenamed("n_values", "n_pairs").drop("iqr")
