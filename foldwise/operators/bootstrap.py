"""Bootstrap intervals of fixed predictions, all units and draws in one job.

A unit whose rows fit a task is resampled there, one task per chunk of draws. A larger unit is
resampled relationally: draw weights, running sums and Newton passes over shuffled rows. Both ways
use the same draws and the same limits, bounds and tolerances, so a draw fails in both or in neither.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.functions.scalars import digest
from foldwise.operators import drawtasks
from foldwise.operators.calibration import recalibration
from foldwise.operators.metrics import discrimination
from foldwise.operators.ordered import cut, number_by_hash
from foldwise.operators.resample import BOOTSTRAP_DRAWS, bootstrap_weights, class_counts
from foldwise.session import settle

# Interval bounds and the success count below which a warning row is written.
LOW, HIGH = 0.025, 0.975
MIN_SUCCESS = 200
LEAST_MINORITY = 2
SUMMARY_METRICS = [
    "roc_auc",
    "average_precision",
    "brier",
    "event_rate",
    "mean_predicted_probability",
    "calibration_intercept",
    "calibration_slope",
]
# Rows of a unit that one task resamples, and hash chunks (of two draws) per task. A task keeps some 250 bytes a row,
# whatever the number of its draws; the rows of a unit are sent once for each of its tasks, whose number is fixed.
TASK_ROWS = 2_000_000
CHUNKS_PER_TASK = 50


def interval(value: str):
    """[2.5 %, 97.5 %] over the draws of one unit; a unit has at most the fixed number of draws."""
    return F.percentile(F.col(value), F.array(F.lit(LOW), F.lit(HIGH)))


def _by_size(rows: DataFrame, groups: Sequence[str]) -> tuple[DataFrame, DataFrame | None]:
    """(rows of units a task can hold, rows of larger units or None)."""
    sizes = settle(rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")))
    large = sizes.where(F.col("_n") > TASK_ROWS).select(*groups)
    if large.isEmpty():
        return rows, None
    return rows.join(large, list(groups), "left_anti"), rows.join(large, list(groups), "left_semi")


def _in_tasks(rows: DataFrame, groups, strata, purpose: str, draws: int, task, columns: str) -> DataFrame:
    """Every unit's numbered rows meet every chunk of draws."""
    numbered = number_by_hash(rows, [*groups, *strata], digest(purpose, F.col("id")), "id", "_rn").drop("group_n", "id")
    tasks = -(-((draws + 1) // 2) // CHUNKS_PER_TASK)
    types = dict(rows.dtypes)
    schema = ", ".join([*[f"{g} {types[g]}" for g in groups], columns])
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        numbered.withColumn("_task", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))))
        .repartition(max(width, 32), *groups, "_task")
        .groupBy(*groups, "_task")
        .applyInPandas(task, schema)
    )


def auc_draws(scores: DataFrame, groups: Sequence[str], names: Sequence[str], draws: int) -> DataFrame:
    """(groups, draw, auc_<name>...): stratified draws, one draw serves every score."""
    groups, names = list(groups), list(names)
    rows = settle(scores.select(*groups, "id", "y_true", *names))
    small, large = _by_size(rows, groups)
    columns = ", ".join(["draw int", *[f"auc_{n} double" for n in names]])
    task = drawtasks.auc_task(groups, names, "boot", CHUNKS_PER_TASK, draws)
    out = _in_tasks(small, groups, ["y_true"], "boot", draws, task, columns)
    if large is None:
        return out
    for name in names:
        large = cut(large, groups, name).withColumnsRenamed({"_cell": f"_cell_{name}"})
    has_cells = f"_cell_{names[0]}" in large.columns
    sides = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("side"),
                    F.col(n).alias("p"),
                    *([F.col(f"_cell_{n}").alias("_cell")] if has_cells else []),
                )
                for n in names
            ]
        )
    ).alias("s")
    long = bootstrap_weights(large, groups, ["y_true"], draws, "boot").select(
        *groups, "y_true", "draw", "weight", sides
    )
    per_side = discrimination(
        long.select(*groups, "y_true", "draw", "weight", "s.*"),
        [*groups, "side", "draw"],
        "p",
        weight=F.col("weight"),
        is_cut=True,
    )
    wide = per_side.groupBy(*groups, "draw").agg(
        *[F.max(F.when(F.col("side") == n, F.col("roc_auc"))).alias(f"auc_{n}") for n in names]
    )
    return out.unionByName(wide)


def auc_interval(scores: DataFrame, groups: Sequence[str], score: str, draws: int = BOOTSTRAP_DRAWS) -> DataFrame:
    """Stratified bootstrap interval of AUROC."""
    per_draw = auc_draws(scores, groups, [score], draws)
    return per_draw.groupBy(*groups).agg(
        F.count(f"auc_{score}").alias("draws"), interval(f"auc_{score}").alias("_ci")
    ).select(*groups, "draws", F.col("_ci")[0].alias("auc_ci95_lo"), F.col("_ci")[1].alias("auc_ci95_hi"))


def guarded_auc_interval(
    scores: DataFrame, groups: Sequence[str], score: str, least: int = LEAST_MINORITY, draws: int = BOOTSTRAP_DRAWS
) -> DataFrame:
    """AUROC interval of every unit with its class counts; withheld, with a warning, where a class has under ``least`` rows.

    No draw is made for a withheld unit.
    """
    groups = list(groups)
    counts = class_counts(scores, groups, "y_true").withColumn("_enough", F.least("positive", "negative") >= least)
    kept = scores.join(counts.where("_enough").select(*groups), groups, "left_semi")
    found = counts.join(auc_interval(kept, groups, score, draws), groups, "left")
    warning = F.when(~F.col("_enough"), F.concat(F.lit("minority_below_"), F.lit(least)))
    return found.select(
        *groups, "n", "positive", "negative",
        F.when(F.col("_enough"), "reported").otherwise("withheld").alias("interval_status"),
        F.coalesce("draws", F.lit(0)).alias("draws"), "auc_ci95_lo", "auc_ci95_hi", warning.alias("warning"),
    )


def paired_auc_interval(
    paired: DataFrame, groups: Sequence[str], score_a: str, score_b: str, draws: int = BOOTSTRAP_DRAWS
) -> DataFrame:
    """Intervals of both AUROCs and of their difference; one draw serves both scores."""
    per_draw = auc_draws(paired, groups, [score_a, score_b], draws).select(
        *groups,
        F.col(f"auc_{score_a}").alias("auc_a"),
        F.col(f"auc_{score_b}").alias("auc_b"),
        (F.col(f"auc_{score_b}") - F.col(f"auc_{score_a}")).alias("delta"),
    )
    names = ["auc_a", "auc_b", "delta"]
    wide = per_draw.groupBy(*groups).agg(*[interval(n).alias(n) for n in names])
    return wide.select(
        *groups,
        *[F.col(n)[i].alias(f"{n}_ci95_{end}") for n in names for i, end in ((0, "lo"), (1, "hi"))],
    )


def metric_draws(scores: DataFrame, groups: Sequence[str], score: str, draws: int = BOOTSTRAP_DRAWS) -> DataFrame:
    """Ordinary n-of-n bootstrap: the seven summary metrics of every draw.

    Class-dependent metrics are NULL for a draw with a single class.
    """
    groups = list(groups)
    keys = [*groups, "draw"]
    small, large = _by_size(settle(scores.select(*groups, "id", "y_true", score)), groups)
    names = ["positive", "negative", *SUMMARY_METRICS]
    columns = ", ".join(["draw int", *[f"{n} double" for n in names]])
    task = drawtasks.summary_task(groups, score, "ordinary", CHUNKS_PER_TASK, draws)
    out = _in_tasks(small, groups, [], "ordinary", draws, task, columns)
    out = out.select(*keys, *[F.nanvl(n, F.lit(None).cast("double")).alias(n) for n in names])
    if large is None:
        return out
    rows = settle(cut(large, groups, score))
    weighted = settle(bootstrap_weights(rows, groups, [], draws, "ordinary"))
    base = discrimination(weighted, keys, score, weight=F.col("weight"), is_cut=True)
    means = weighted.groupBy(*keys).agg(
        (F.sum(F.col("weight") * F.col("y_true")) / F.sum("weight")).alias("event_rate"),
        (F.sum(F.col("weight") * F.col(score)) / F.sum("weight")).alias("mean_predicted_probability"),
    )
    fits = recalibration(weighted, keys, score, weight=F.col("weight"))
    joined = base.join(means, keys).join(fits.select(*keys, "calibration_intercept", "calibration_slope"), keys)
    return out.unionByName(joined.select(*keys, *[F.col(n).cast("double").alias(n) for n in names]))


def metric_intervals(per_draw: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Long table: metric, successful draws, interval; draws with both classes."""
    groups = list(groups)
    both = (F.col("positive") > 0) & (F.col("negative") > 0)
    long = per_draw.withColumn("_both", both.cast("int")).unpivot(
        [*groups, "draw", "_both"], SUMMARY_METRICS, "metric", "value"
    )
    return (
        long.groupBy(*groups, "metric")
        .agg(
            F.count(F.lit(1)).alias("bootstrap_target"),
            F.sum("_both").alias("draws_with_both_classes"),
            F.count("value").alias("bootstrap_success"),
            interval("value").alias("_ci"),
        )
        .withColumn("ci95_lo", F.col("_ci")[0])
        .withColumn("ci95_hi", F.col("_ci")[1])
        .drop("_ci")
    )


def low_success(intervals: DataFrame, groups: Sequence[str], required: int = MIN_SUCCESS) -> DataFrame:
    """Warning rows for metrics with too few successful draws."""
    return intervals.where(F.col("bootstrap_success") < required).select(
        *groups,
        F.concat(F.lit("low_"), "metric", F.lit("_bootstrap_success")).alias("issue"),
        F.col("bootstrap_success").alias("successful"),
    )
