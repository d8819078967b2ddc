"""Choosing hyperparameters, ranking features and describing the choices over outer fits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scores are compared after rounding, so that summation order cannot break a tie.
TIE_DIGITS = 12


def grid_scores(fold_auc: DataFrame, fit: Sequence[str], grid: Sequence[str]) -> DataFrame:
    """Mean over repeats of the repeat's mean fold AUC, its sd over repeats and the counts."""
    per_repeat = fold_auc.groupBy(*fit, *grid, "inner_repeat").agg(
        F.avg("auc").alias("m"), F.count(F.lit(1)).alias("folds")
    )
    return per_repeat.groupBy(*fit, *grid).agg(
        F.round(F.avg("m"), TIE_DIGITS).alias("mean_auc"),
        F.round(F.stddev_samp("m"), TIE_DIGITS).alias("sd_repeat_mean_auc"),
        F.count(F.lit(1)).alias("n_inner_repeats"),
        F.sum("folds").alias("n_inner_evaluations"),
    )


def best_point(scores: DataFrame, fit: Sequence[str], grid: Sequence[str]) -> DataFrame:
    """Highest mean score; the first point in grid order wins a tie. One aggregate, no sort."""
    first = F.min(F.struct((-F.col("mean_auc")).alias("_neg"), *grid)).alias("_best")
    return scores.groupBy(*fit).agg(first).select(
        *fit, *[F.col(f"_best.{g}").alias(g) for g in grid], (-F.col("_best._neg")).alias("mean_auc")
    )


def best_c_per_k(scores: DataFrame, fit: Sequence[str]) -> DataFrame:
    """k curve: best C of every k with the standard error of its repeat means."""
    repeats = F.col("_b.n_inner_repeats")
    sd = F.when(repeats > 1, F.col("_b.sd_repeat_mean_auc")).otherwise(0.0)
    best = F.min(
        F.struct((-F.col("mean_auc")).alias("_neg"), "C", "sd_repeat_mean_auc", "n_inner_repeats")
    ).alias("_b")
    return scores.groupBy(*fit, "k").agg(best).select(
        *fit,
        "k",
        F.col("_b.C").alias("best_C"),
        (-F.col("_b._neg")).alias("mean_auc"),
        sd.alias("sd_repeat_mean_auc"),
        F.round(sd / F.sqrt(repeats.cast("double")), TIE_DIGITS).alias("se_auc"),
    )


def one_standard_error(curve: DataFrame, fit: Sequence[str]) -> DataFrame:
    """Smallest k whose mean reaches the best mean minus the best k's standard error."""
    best = F.min(F.struct((-F.col("mean_auc")).alias("_neg"), "k", "se_auc")).over(Window.partitionBy(*fit))
    threshold = F.round(-F.col("_top._neg") - F.col("_top.se_auc"), TIE_DIGITS)
    return (
        curve.withColumn("_top", best)
        .withColumn("threshold", threshold)
        .where(F.col("mean_auc") >= F.col("threshold"))
        .groupBy(*fit)
        .agg(F.min(F.struct("k", "best_C", "mean_auc", "threshold")).alias("_c"))
        .select(
            *fit,
            F.col("_c.k").alias("k_selected"),
            F.col("_c.best_C").alias("l2_C"),
            F.col("_c.mean_auc").alias("mean_auc"),
            F.col("_c.threshold").alias("threshold"),
        )
    )


def stability_table(coefficients: DataFrame, fit: Sequence[str], resamples: Column | int) -> DataFrame:
    """Eligibility, non-zero frequency and mean coefficients; denominators are all resamples."""
    total = resamples if isinstance(resamples, Column) else F.lit(float(resamples))
    c = F.col("coef")
    return (
        coefficients.groupBy(*fit, "feature")
        .agg(
            (F.count(c) / total).alias("eligible_freq"),
            (F.count_if(c != 0) / total).alias("nonzero_freq"),
            F.round(F.sum(F.abs(c)) / total, TIE_DIGITS).alias("mean_abs_coef"),
            F.round(F.sum(c) / total, TIE_DIGITS).alias("mean_signed_coef"),
        )
        .where("eligible_freq > 0")
    )


def rank_features(stability: DataFrame, fit: Sequence[str]) -> DataFrame:
    """Rank by non-zero frequency, then mean absolute coefficient, then name."""
    order = Window.partitionBy(*fit).orderBy(F.desc("nonzero_freq"), F.desc("mean_abs_coef"), F.asc("feature"))
    return stability.withColumn("rank", F.row_number().over(order))


def dense_rerank(ranking: DataFrame, fit: Sequence[str], eligible: DataFrame) -> DataFrame:
    """Keep the features eligible in the training set and renumber them 1..m in rank order."""
    order = Window.partitionBy(*fit).orderBy("rank")
    kept = ranking.join(eligible.select(*fit, "feature"), [*fit, "feature"], "left_semi")
    return kept.withColumn("training_rank", F.row_number().over(order))


def rank_gaps(ranking: DataFrame, fit: Sequence[str]) -> DataFrame:
    """Rows whose rank is not its position: ranks must run 1..m without gaps or repeats."""
    position = F.row_number().over(Window.partitionBy(*fit).orderBy("rank", "feature"))
    return ranking.where("rank IS NOT NULL").withColumn("expected_rank", position).where("rank <> expected_rank")


def top_k(ranking: DataFrame, choice: DataFrame, fit: Sequence[str]) -> DataFrame:
    """The first k features of each fit; k beyond the ranked features selects all of them."""
    return ranking.join(choice, list(fit)).where(F.col("rank") <= F.col("k_selected"))


def effective_k(ranking: DataFrame, choice: DataFrame, fit: Sequence[str]) -> DataFrame:
    """min(requested k, ranked features) per fit."""
    ranked = ranking.groupBy(*fit).agg(F.max("rank").alias("ranked"))
    return choice.join(ranked, list(fit)).withColumn("effective_k", F.least("k_selected", "ranked"))


def feature_by_fit(
    universe: DataFrame, choice: DataFrame, ranking: DataFrame, coefficients: DataFrame, fit: Sequence[str]
) -> DataFrame:
    """Every feature of a cohort for every fit of that cohort, zeros and NULLs where unranked.

    ``universe`` is (cohort, feature); the equi-join on the cohort yields exactly the table's rows.
    """
    keys = [*fit, "feature"]
    full = universe.join(choice, "cohort")
    return (
        full.join(ranking.select(*keys, "rank", "eligible_freq", "nonzero_freq"), keys, "left")
        .join(coefficients.select(*keys, "coef"), keys, "left")
        .select(
            *keys,
            "rank",
            F.coalesce("eligible_freq", F.lit(0.0)).alias("eligible_freq"),
            F.coalesce("nonzero_freq", F.lit(0.0)).alias("nonzero_freq"),
            F.coalesce(F.col("rank") <= F.col("k_selected"), F.lit(False)).alias("selected"),
            F.col("coef").isNotNull().alias("used"),
            "coef",
        )
    )


def selection_frequency(table: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Counts and rates of eligibility, selection and use over the outer fits (a fixed number)."""
    n = F.count(F.lit(1))
    used = F.count_if("used")
    return table.groupBy(*groups, "feature").agg(
        n.alias("n_fits"),
        F.count_if(F.col("eligible_freq") > 0).alias("eligible_count"),
        F.count_if("selected").alias("selected_count"),
        (F.count_if("selected") / n).alias("selected_rate"),
        used.alias("used_count"),
        (used / n).alias("used_rate"),
        F.avg("coef").alias("coef_mean"),
        F.percentile("coef", F.lit(0.5)).alias("coef_median"),
        (F.count_if(F.col("coef") > 0) / F.nullif(used, F.lit(0))).alias("positive_rate"),
    )


def k_curve_summary(curve: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Mean, sd, count and standard error of the inner score per k across outer fits."""
    n = F.count(F.lit(1))
    return curve.groupBy(*groups, "k").agg(
        F.avg("mean_auc").alias("mean"),
        F.stddev_samp("mean_auc").alias("sd"),
        n.alias("n_fits"),
        (F.stddev_samp("mean_auc") / F.sqrt(n.cast("double"))).alias("se"),
    )


def at_boundary(value: Column | str, grid: Sequence[float], tol: float = 1e-12) -> tuple[Column, Column]:
    """(at the grid minimum, at the grid maximum)."""
    v = F.col(value) if isinstance(value, str) else value
    return F.abs(v - min(grid)) <= tol, F.abs(v - max(grid)) <= tol


def boundary_counts(parameters: DataFrame, groups: Sequence[str], grids: dict[str, Sequence[float]]) -> DataFrame:
    """How often each selected hyperparameter sits on an end of its grid."""
    parts = []
    for name, grid in grids.items():
        low, high = at_boundary(name, grid)
        parts.append(F.struct(F.lit(name).alias("parameter"), low.alias("low"), high.alias("high")))
    return (
        parameters.select(*groups, F.explode(F.array(*parts)).alias("p"))
        .groupBy(*groups, F.col("p.parameter").alias("parameter"))
        .agg(
            F.count(F.lit(1)).alias("n_fits"),
            F.count_if("p.low").alias("at_minimum"),
            F.count_if("p.high").alias("at_maximum"),
        )
    )


def linear_scores(cells: DataFrame, coefficients: DataFrame, fit: Sequence[str], intercepts: DataFrame) -> DataFrame:
    """Probability of every row under every fit: sum of coefficient x z plus intercept, expit.

    ``cells`` is the transformed long table (fit, id, feature, z). The sum combines on the map side.
    """
    from foldwise.functions.scalars import expit

    eta = (
        cells.join(F.broadcast(coefficients.select(*fit, "feature", "coef")), [*fit, "feature"])
        .groupBy(*fit, "id")
        .agg(F.sum(F.col("coef") * F.col("z")).alias("_eta"))
    )
    return eta.join(F.broadcast(intercepts), list(fit)).select(*fit, "id", expit(F.col("_eta") + F.col("intercept")).alias("p"))


def ordered_coefficients(coefficients: DataFrame, groups: Sequence[str], intercepts: DataFrame) -> DataFrame:
    """Coefficients by absolute size, the intercept row last."""
    order = Window.partitionBy(*groups).orderBy(F.desc(F.abs("coef")), F.asc("feature"))
    ranked = coefficients.select(*groups, "feature", "coef", F.row_number().over(order).alias("position"))
    counts = coefficients.groupBy(*groups).agg((F.count(F.lit(1)) + 1).cast("int").alias("position"))
    last = intercepts.join(counts, list(groups)).select(
        *groups, F.lit("(intercept)").alias("feature"), F.col("intercept").alias("coef"), "position"
    )
    return ranked.unionByName(last)
