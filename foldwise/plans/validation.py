"""The validation analyses: nested, non-nested, selectively nested, holdout, full-data signature."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators import metrics, preprocess, selection
from foldwise.operators.resample import holdout_splits, stratified_folds, training_sets
from foldwise.plans import fitting
from foldwise.plans.design import Design
from foldwise.session import settle

OUTER = ["cohort", "repeat", "outer_fold"]
SPLIT = ["cohort", "split"]


@dataclass
class Analysis:
    tuned: fitting.Tuned | None
    models: DataFrame
    predictions: DataFrame
    order: DataFrame


def outer_plan(samples: DataFrame, design: Design) -> DataFrame:
    return stratified_folds(
        samples, ["cohort"], "repeat", "outer_fold", design.outer_splits, design.outer_repeats, "outer"
    )


def outer_roles(plan: DataFrame) -> DataFrame:
    """(cohort, repeat, outer_fold, id, y, is_train)."""
    train = training_sets(plan, ["cohort", "repeat"], "outer_fold").withColumn("is_train", F.lit(True))
    return train.unionByName(plan.withColumn("is_train", F.lit(False)))


def outer_state(cells: DataFrame, plan: DataFrame, design: Design) -> DataFrame:
    return preprocess.training_state(cells, plan, ["cohort", "repeat"], "outer_fold", design.imputation, design.missing_rate)


def nested(cells: DataFrame, samples: DataFrame, design: Design) -> Analysis:
    """Tuning, ranking and size selection inside every outer training set, then one model each."""
    plan = settle(outer_plan(samples, design))
    train = training_sets(plan, ["cohort", "repeat"], "outer_fold")
    tuned = fitting.tune(cells, fitting.inner_samples(train, OUTER, design), OUTER, design)
    order = fitting.feature_order(cells)
    models, predictions = fitting.fit_final(
        cells,
        outer_roles(plan),
        outer_state(cells, plan, design),
        fitting.order_arrays(tuned.ranking, order, OUTER),
        tuned.choice,
        OUTER,
        design,
    )
    return Analysis(tuned, models, predictions, order)


def global_tuning(cells: DataFrame, samples: DataFrame, design: Design) -> fitting.Tuned:
    """Tune once per cohort on all rows, with the outer plan as the resamples."""
    plan = outer_plan(samples, design).withColumnsRenamed({"repeat": "inner_repeat", "outer_fold": "inner_fold"})
    return fitting.tune(cells, plan, ["cohort"], design)


def fixed_specification(
    cells: DataFrame, samples: DataFrame, ranking: DataFrame, choice: DataFrame, design: Design
) -> Analysis:
    """Refit one specification per outer fold. ``ranking``/``choice`` are keyed by cohort or by fit."""
    plan = settle(outer_plan(samples, design))
    order = fitting.feature_order(cells)
    fits = plan.select(*OUTER).distinct()
    by_fit = lambda df, key: df if "outer_fold" in df.columns else fits.join(df, key)
    orders = fitting.order_arrays(by_fit(ranking, "cohort"), order, OUTER)
    models, predictions = fitting.fit_final(
        cells, outer_roles(plan), outer_state(cells, plan, design), orders, by_fit(choice, "cohort"), OUTER, design
    )
    return Analysis(None, models, predictions, order)


def non_nested(cells: DataFrame, samples: DataFrame, design: Design, spec: fitting.Tuned | None = None) -> Analysis:
    spec = spec or global_tuning(cells, samples, design)
    done = fixed_specification(cells, samples, spec.ranking, spec.choice, design)
    return Analysis(spec, done.models, done.predictions, done.order)


def nested_ranking_global_size(cells, samples, fold_ranking: DataFrame, spec: fitting.Tuned, design: Design) -> Analysis:
    """Fold-wise ranking, k and C from the global tuning."""
    return fixed_specification(cells, samples, fold_ranking, spec.choice, design)


def global_ranking_nested_size(cells, samples, spec: fitting.Tuned, design: Design) -> Analysis:
    """Global ranking restricted to what each training set can use, k and C chosen inside the fold."""
    plan = settle(outer_plan(samples, design))
    state = settle(outer_state(cells, plan, design))
    order = fitting.feature_order(cells)
    fits = plan.select(*OUTER).distinct()
    ranking = settle(
        selection.dense_rerank(fits.join(spec.ranking, "cohort"), OUTER, state.where("used").select(*OUTER, "feature"))
    )
    orders = fitting.order_arrays(ranking, order, OUTER, "training_rank")
    train = training_sets(plan, ["cohort", "repeat"], "outer_fold")
    rows, states = fitting.prepare(cells, fitting.inner_samples(train, OUTER, design), OUTER, design)
    _, choice = fitting.choose_size(fitting.size_scores(rows, states, orders, OUTER, design), OUTER)
    models, predictions = fitting.fit_final(cells, outer_roles(plan), state, orders, settle(choice), OUTER, design)
    return Analysis(None, models, predictions, order)


def holdout(cells: DataFrame, samples: DataFrame, design: Design) -> Analysis:
    """Tune on the training side of every split, predict its test side."""
    plan = settle(holdout_splits(samples, ["cohort"]).withColumn("is_train", F.col("subset") == "train"))
    train = plan.where("is_train").select(*SPLIT, "id", "y")
    tuned = fitting.tune(cells, fitting.inner_samples(train, SPLIT, design), SPLIT, design)
    order = fitting.feature_order(cells)
    state = preprocess.single_state(cells, train, SPLIT, design.imputation, design.missing_rate)
    models, predictions = fitting.fit_final(
        cells, plan, state, fitting.order_arrays(tuned.ranking, order, SPLIT), tuned.choice, SPLIT, design
    )
    return Analysis(tuned, models, predictions, order)


def full_data_signature(cells: DataFrame, samples: DataFrame, design: Design) -> Analysis:
    """Tune, rank and fit on all rows of a cohort; the model's coefficients are the result."""
    fit = ["cohort"]
    everyone = samples.select("cohort", "id", "y")
    tuned = fitting.tune(cells, fitting.inner_samples(everyone, fit, design), fit, design)
    order = fitting.feature_order(cells)
    state = preprocess.single_state(cells, everyone, fit, design.imputation, design.missing_rate)
    models, predictions = fitting.fit_final(
        cells,
        everyone.withColumn("is_train", F.lit(True)),
        state,
        fitting.order_arrays(tuned.ranking, order, fit),
        tuned.choice,
        fit,
        design,
    )
    return Analysis(tuned, models, predictions, order)


def oof_metrics(predictions: DataFrame) -> DataFrame:
    """Metrics of the averaged out-of-fold scores per cohort."""
    return metrics.discrimination(metrics.averaged_oof(predictions, ["cohort"]), ["cohort"], "p_oof")
