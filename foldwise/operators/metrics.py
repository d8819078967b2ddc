"""Discrimination metrics over long prediction tables, for every group in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldwise.functions.scalars import ratio
from foldwise.operators.ordered import running


def averaged_oof(predictions: DataFrame, groups: Sequence[str], score: str = "p") -> DataFrame:
    """One row per sample: label, mean score, sample sd and count over repeats.

    The mean is rounded to 12 decimals: equal sets of scores then tie exactly, whatever the order
    in which partial sums arrive from the executors.
    """
    return predictions.groupBy(*groups, "id").agg(
        F.min("y_true").alias("y_true"),
        F.round(F.avg(score), 12).alias("p_oof"),
        F.stddev_samp(score).alias("p_oof_sd"),
        F.count(F.lit(1)).alias("oof_count"),
    )


def score_counts(
    scores: DataFrame,
    groups: Sequence[str],
    score: str,
    label: str = "y_true",
    weight: Column | None = None,
    is_cut: bool = False,
) -> DataFrame:
    """Distinct scores with class counts and running class counts (see ``running``)."""
    w = F.lit(1) if weight is None else weight
    return running(
        scores,
        groups,
        score,
        {"pos": F.sum(w * F.col(label)), "neg": F.sum(w * (1 - F.col(label)))},
        is_cut,
    )


def discrimination(
    scores: DataFrame,
    groups: Sequence[str],
    score: str = "p",
    label: str = "y_true",
    weight: Column | None = None,
    is_cut: bool = False,
) -> DataFrame:
    """n, positive, negative, roc_auc, average_precision, brier per group from one pass.

    AUROC counts ties as one half; average precision steps over distinct thresholds. Both are NULL
    for a group with one class.
    """
    c = score_counts(scores, groups, score, label, weight, is_cut)
    pos, neg = F.col("pos"), F.col("neg")
    tp = F.col("pos_total") - F.col("pos_below")
    fp = F.col("neg_total") - F.col("neg_below")
    s = F.col(score)
    totals = c.groupBy(*groups).agg(
        F.first("pos_total").alias("positive"),
        F.first("neg_total").alias("negative"),
        F.sum(pos * (F.col("neg_below") + neg / 2.0)).alias("_wins"),
        F.sum(pos * (tp / (tp + fp))).alias("_precision"),
        F.sum(pos * (1.0 - s) * (1.0 - s) + neg * s * s).alias("_loss"),
    )
    n = F.col("positive") + F.col("negative")
    both = F.col("negative") > 0
    return totals.select(
        *groups,
        n.alias("n"),
        "positive",
        "negative",
        ratio("_wins", F.col("positive").cast("double") * F.col("negative")).alias("roc_auc"),
        F.when(both, ratio("_precision", "positive")).alias("average_precision"),
        (F.col("_loss") / n).alias("brier"),
    )


def average_ranks(scores: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Mid-rank of every distinct value with its multiplicity."""
    c = running(scores, groups, value, {"n": F.count(F.lit(1))})
    return c.select(
        *groups, value, F.col("n").alias("ties"), (F.col("n_below") + (F.col("n") + 1) / 2.0).alias("avg_rank")
    )


def roc_points(scores: DataFrame, groups: Sequence[str], score: str = "p", label: str = "y_true") -> DataFrame:
    """ROC coordinates from the strictest threshold down, collinear interior points dropped.

    Each group starts with (0, 0) at threshold NULL. A distinct score is a corner when the step to
    it differs from the step to the next smaller score, or when it is the largest or the smallest.
    """
    c = score_counts(scores, groups, score, label)
    tp = F.col("pos_total") - F.col("pos_below")
    fp = F.col("neg_total") - F.col("neg_below")
    top = (F.col("pos_below") + F.col("pos") == F.col("pos_total")) & (
        F.col("neg_below") + F.col("neg") == F.col("neg_total")
    )
    bend = (F.col("pos_prev") != F.col("pos")) | (F.col("neg_prev") != F.col("neg"))
    points = c.where(F.col("pos_prev").isNull() | top | bend).select(
        *groups,
        F.col(score).alias("threshold"),
        ratio(fp, "neg_total").alias("fpr"),
        ratio(tp, "pos_total").alias("tpr"),
    )
    start = points.select(*groups).distinct().select(
        *groups, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(start)


def pr_points(scores: DataFrame, groups: Sequence[str], score: str = "p", label: str = "y_true") -> DataFrame:
    """Precision and recall at every distinct threshold, plus the terminal (precision 1, recall 0)."""
    c = score_counts(scores, groups, score, label)
    tp = F.col("pos_total") - F.col("pos_below")
    fp = F.col("neg_total") - F.col("neg_below")
    points = c.select(
        *groups,
        F.col(score).alias("threshold"),
        (tp / (tp + fp)).alias("precision"),
        ratio(tp, "pos_total").alias("recall"),
    )
    end = points.select(*groups).distinct().select(
        *groups, F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.unionByName(end)


def metric_dispersion(table: DataFrame, groups: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Median, quartiles, IQR, mean, sd, min and max of each metric over a group's splits."""
    long = table.unpivot(list(groups), list(metrics), "metric", "value").where(F.col("value").isNotNull())
    return dispersion(long, [*groups, "metric"], "value")


def dispersion(table: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Spread of a bounded list (splits, repeats, pairs of fits, cohorts) per group."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (
        table.groupBy(*groups)
        .agg(
            F.count(v).alias("n_values"),
            q.alias("_q"),
            F.avg(v).alias("mean"),
            F.stddev_samp(v).alias("sd"),
            F.min(v).alias("min"),
            F.max(v).alias("max"),
        )
        .select(
            *groups,
            "n_values",
            F.col("_q")[1].alias("median"),
            F.col("_q")[0].alias("q1"),
            F.col("_q")[2].alias("q3"),
            (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"),
            "mean",
            "sd",
            "min",
            "max",
        )
    )
