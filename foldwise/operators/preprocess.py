"""Training-fold preprocessing as tables: one state row per (fit, feature), applied by a join.

A fold's training set is every other fold of its plan, so statistics are aggregated once per fold
and feature, and the training statistics of each left-out fold are combined from those few rows.
The cells are read once per plan instead of once per (fold, training set).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.scalars import transform_value
from foldwise.operators.ordered import exact_median, running
from foldwise.plans.design import MISSING_RATE

RULE = ["transform", "half_minimum_allowed", "input_scale"]
LOG10_2 = 0.3010299956639812


def placed_cells(cells: DataFrame, assignment: DataFrame, plan: Sequence[str], fold: str) -> DataFrame:
    """(plan, fold, feature, value, rule columns): every cell under every plan its sample belongs to.

    ``cells`` is (cohort, id, feature, value, rule columns) after the value rules; ``assignment``
    is (plan keys incl. cohort, fold, id).
    """
    return assignment.select(*plan, fold, "id").join(
        cells.select("cohort", "id", "feature", "value", *RULE), ["cohort", "id"]
    ).drop("id")


def fold_statistics(placed: DataFrame, plan: Sequence[str], fold: str) -> DataFrame:
    """Per (plan, fold, feature): counts, minima and moments of the transformed observed values."""
    v = F.col("value")
    t = transform_value("value", "transform")
    return placed.groupBy(*plan, fold, "feature", *RULE).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(v).alias("n_obs"),
        F.min(F.when(v > 0, v)).alias("min_pos"),
        F.min(v).alias("min_obs"),
        F.min(t).alias("min_t"),
        F.max(t).alias("max_t"),
        F.avg(t).alias("mean_t"),
        (F.var_pop(t) * F.count(t)).alias("m2"),
    )


def _combine(parts: Column) -> dict[str, Column]:
    """Statistics of a union of folds; the second moment is combined around the joint mean."""
    total = lambda f: F.aggregate(parts, F.lit(0.0), lambda a, e: a + F.coalesce(f(e), F.lit(0.0)))
    n_obs = total(lambda e: e["n_obs"].cast("double"))
    mean = total(lambda e: e["n_obs"] * e["mean_t"]) / F.nullif(n_obs, F.lit(0.0))
    spread = lambda m: total(lambda e: e["m2"] + e["n_obs"] * (e["mean_t"] - m) * (e["mean_t"] - m))
    least = lambda f: F.array_min(F.transform(parts, lambda e: e[f]))
    return {
        "n_train": total(lambda e: e["n"].cast("double")).cast("long"),
        "n_obs": n_obs.cast("long"),
        "min_pos": least("min_pos"),
        "min_obs": least("min_obs"),
        "min_t": least("min_t"),
        "max_t": F.array_max(F.transform(parts, lambda e: e["max_t"])),
        "mean_obs": mean,
        "_spread": spread,
    }


def training_state(
    cells: DataFrame,
    assignment: DataFrame,
    plan: Sequence[str],
    fold: str,
    imputation: str = "half_minimum",
    missing_rate: float = MISSING_RATE,
) -> DataFrame:
    """Preprocessing state of every training set: one row per (plan, left-out fold, feature).

    half_minimum: impute on the raw scale, transform, drop constants, z-score.
    knn: z-score the observed values only; the missing ones are filled later (see ``neighbors``).
    """
    return state_of_placed(placed_cells(cells, assignment, plan, fold), plan, fold, imputation, missing_rate)


def state_of_placed(
    placed: DataFrame,
    plan: Sequence[str],
    fold: str,
    imputation: str = "half_minimum",
    missing_rate: float = MISSING_RATE,
    splits: int | None = None,
    in_one_task: bool = False,
) -> DataFrame:
    """``training_state`` from cells that carry their plans and folds already.

    A caller that knows the number of folds, or that no (plan, feature) is too large for one task, spares a
    pass over ``placed`` each.
    """
    plan = list(plan)
    fields = ["n", "n_obs", "min_pos", "min_obs", "min_t", "max_t", "mean_t", "m2"]
    per_fold = fold_statistics(placed, plan, fold)
    listed = per_fold.groupBy(*plan, "feature", *RULE).agg(
        F.collect_list(F.struct(F.col(fold).alias("fold"), *fields)).alias("_folds")
    )
    left_out = listed.withColumn("_out", F.explode(F.transform("_folds", lambda e: e["fold"])))
    others = left_out.withColumn("_parts", F.filter("_folds", lambda e: e["fold"] != F.col("_out")))
    stats = _combine(F.col("_parts"))
    spread = stats.pop("_spread")
    combined = others.withColumns(stats).withColumn("m2_obs", spread(F.col("mean_obs")))
    combined = combined.withColumnRenamed("_out", fold).drop("_folds", "_parts")
    medians = None
    if imputation == "half_minimum":
        signed = placed.where(~F.col("half_minimum_allowed"))
        medians = leave_one_out_medians(signed, [*plan, "feature"], fold, "value", splits=splits, in_one_task=in_one_task)
    return _finish(combined, medians, plan, fold, imputation, missing_rate)


def single_state(
    cells: DataFrame, rows: DataFrame, keys: Sequence[str], imputation: str = "half_minimum", missing_rate: float = MISSING_RATE
) -> DataFrame:
    """State of one training set per key: ``rows`` is (keys incl. cohort, id), all of them training."""
    keys = list(keys)
    whole = fold_statistics(placed_cells(cells, rows.withColumn("_all", F.lit(0)), keys, "_all"), keys, "_all")
    combined = whole.select(
        *keys, "feature", *RULE, F.col("n").alias("n_train"), "n_obs", "min_pos", "min_obs", "min_t", "max_t",
        F.col("mean_t").alias("mean_obs"), F.col("m2").alias("m2_obs"),
    )
    medians = None
    if imputation == "half_minimum":
        signed = cells.where(~F.col("half_minimum_allowed")).select("cohort", "id", "feature", "value")
        train = rows.select(*keys, "id").join(signed, ["cohort", "id"])
        medians = exact_median(train, [*keys, "feature"], "value")
    return _finish(combined, medians, keys, None, imputation, missing_rate)


def leave_one_out_medians(
    rows: DataFrame,
    groups: Sequence[str],
    fold: str,
    value: str,
    out: str = "median",
    splits: int | None = None,
    in_one_task: bool = False,
) -> DataFrame:
    """(groups, fold, out): the exact median of all rows outside each fold.

    Each distinct value carries a vector of counts, one per fold. What lies below it outside a fold is the total
    below it less the fold's own, so one running sum serves every left-out fold and no row is copied.
    """
    groups = list(groups)
    rows = rows.where(F.col(value).isNotNull())
    # The number of folds is part of the design.
    folds = range(1, (splits or rows.agg(F.max(fold)).first()[0] or 0) + 1)
    if not folds:
        return rows.select(*groups, fold, F.col(value).alias(out))
    seen = running(rows, groups, value, {f"c{f}": F.count_if(F.col(fold) == f) for f in folds}, is_cut=in_one_task)
    outside = lambda f, part: reduce(add, [F.col(f"c{g}{part}") for g in folds if g != f], F.lit(0))
    kind = dict(rows.dtypes)[fold]
    sides = [F.struct(F.lit(f).cast(kind).alias(fold), outside(f, "").alias("n"), outside(f, "_below").alias("below"), outside(f, "_total").alias("of")) for f in folds]
    placed = seen.select(*groups, F.col(value).alias("_v"), F.explode(F.array(*sides)).alias("s")).select(*groups, "_v", "s.*").where("n > 0")
    inside = lambda at: F.when((at >= F.col("below")) & (at < F.col("below") + F.col("n")), 1).otherwise(0)
    middle = placed.withColumn("_hits", inside(F.floor((F.col("of") - 1) / 2)) + inside(F.floor(F.col("of") / 2))).where("_hits > 0")
    return middle.groupBy(*groups, fold).agg((F.sum(F.col("_v") * F.col("_hits")) / F.sum("_hits")).alias(out))


def _finish(stats, medians, plan, fold, imputation, missing_rate):
    keys = [*plan, *([fold] if fold else []), "feature"]
    if medians is not None:
        stats = stats.join(medians, keys, "left")
    n, n_obs = F.col("n_train"), F.col("n_obs")
    n_mis = n - n_obs
    kept = (n_mis / n <= missing_rate) & (n_obs > 0)
    out = stats.withColumn("missing_rate", n_mis / n).withColumn("kept_after_missing", kept)
    if imputation == "half_minimum":
        impute = (
            F.when(~F.col("half_minimum_allowed"), F.col("median"))
            .when(F.col("input_scale") == "log10", F.col("min_obs") - LOG10_2)
            .otherwise(F.col("min_pos") / 2)
        )
        out = out.withColumn("impute_value", F.when(F.col("kept_after_missing"), impute))
        out = out.withColumn("_t", transform_value("impute_value", "transform"))
        filled = F.when(n_mis > 0, F.col("_t"))
        mean = F.when(n_mis > 0, (n_obs * F.col("mean_obs") + n_mis * F.col("_t")) / n).otherwise(F.col("mean_obs"))
        out = out.withColumn("mean", mean)
        m2 = F.col("m2_obs") + F.when(
            n_mis > 0, n_obs * F.pow(F.col("mean_obs") - F.col("mean"), 2) + n_mis * F.pow(F.col("_t") - F.col("mean"), 2)
        ).otherwise(0.0)
        out = out.withColumn("sd", F.sqrt(m2 / n))
        varies = F.least("min_t", filled) < F.greatest("max_t", filled)
    else:
        out = out.withColumn("impute_value", F.lit(None).cast("double")).withColumn("mean", F.col("mean_obs"))
        out = out.withColumn("sd", F.sqrt(F.col("m2_obs") / n_obs))
        varies = F.col("min_t") < F.col("max_t")
    used = F.col("kept_after_missing") & F.coalesce(varies & (F.col("sd") > 0), F.lit(False))
    reason = (
        F.when(~F.col("kept_after_missing"), "missing_rate").when(~used, "constant").otherwise("")
    )
    return out.select(
        *keys, *RULE, "n_train", "n_obs", "missing_rate", "kept_after_missing", "impute_value",
        F.when(F.col("kept_after_missing"), F.col("mean")).alias("mean"),
        F.when(F.col("kept_after_missing"), F.col("sd")).alias("sd"),
        used.alias("used"),
        reason.alias("exclusion_reason"),
    )


def standardize(cells: DataFrame, rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """z-scores of ``rows`` (keys incl. cohort, id) with their fit's training state only.

    A missing value takes the training impute value; under KNN it stays NULL.
    """
    used = state.where("used").select(*keys, "feature", "impute_value", "mean", "sd")
    filled = F.coalesce("value", "impute_value")
    return (
        rows.join(cells.select("cohort", "id", "feature", "value", "transform"), ["cohort", "id"])
        .join(used, [*keys, "feature"])
        .select(
            *[c for c in rows.columns],
            "feature",
            ((transform_value(filled, "transform") - F.col("mean")) / F.col("sd")).alias("z"),
        )
    )
