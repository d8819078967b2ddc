"""The second stage of an analysis: which scenario is fitted for which cohort, read off the primary fits.

A scenario names its cohorts in one of three ways (``TARGETS``): all that are available, those whose primary
analysis gave predictions, or those in which some primary fit reached the size limit. Explicit requests add to
that. The schedule is a table; each scenario then fits its own cohorts only.
"""

from __future__ import annotations

from dataclasses import fields, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators import compare, metrics
from foldwise.plans import validation
from foldwise.plans.design import PRIMARY, SCENARIOS, Design
from foldwise.session import settle

# Scenario, how it finds its cohorts, and why it is run.
TARGETS = [
    ("knn", "available", "imputation_sensitivity"),
    ("outer3", "with_results", "fold_sensitivity"),
    ("kmax30", "at_ceiling", "kmax_sensitivity"),
    ("reggrid", "with_results", "grid_sensitivity"),
]
SIZES = ["nested_roc_auc", "non_nested_roc_auc", "delta_roc_auc"]


def under(base: Design, scenario: str) -> Design:
    """``base`` with what the scenario changes against the primary design."""
    own = SCENARIOS[scenario]
    return replace(base, **{f.name: getattr(own, f.name) for f in fields(Design) if getattr(own, f.name) != getattr(PRIMARY, f.name)})


def primary_outcomes(samples: DataFrame, choice: DataFrame, predictions: DataFrame, max_k: int) -> DataFrame:
    """(cohort, fits, max_k_selected, ceiling_hit, has_results) of every cohort, fitted or not.

    A cohort is at the ceiling when any of its outer fits chose the largest size allowed.
    """
    sizes = choice.groupBy("cohort").agg(
        F.count(F.lit(1)).alias("fits"), F.max("k_selected").alias("max_k_selected"), F.bool_or(F.col("k_selected") >= max_k).alias("ceiling_hit")
    )
    scored = predictions.select("cohort").distinct().withColumn("has_results", F.lit(True))
    every = samples.select("cohort").distinct().join(sizes, "cohort", "left").join(scored, "cohort", "left")
    return every.fillna({"fits": 0, "ceiling_hit": False, "has_results": False})


def schedule(outcomes: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """(cohort, scenario, entry, source, max_k, imputation, outer_splits, n_entries), one row per cohort and scenario.

    ``requests`` is (cohort, scenario, source): cohorts asked for beside the rules. A request for a cohort that has no
    samples, or for a scenario that does not exist, is left out. Where a cohort and a scenario meet twice, the later
    entry stands: requests come after the rules, and equal requests in the order of their sources.
    """
    session = outcomes.sparkSession
    rules = session.createDataFrame([(i, *t) for i, t in enumerate(TARGETS)], "entry int, scenario string, rule string, source string")
    told = ("max_k", "imputation", "outer_splits")
    designs = session.createDataFrame(
        [(n, *[getattr(SCENARIOS[n], f) for f in told]) for n, _, _ in TARGETS], "scenario string, max_k int, imputation string, outer_splits int"
    )
    wanted = F.filter(
        F.array(
            F.lit("available"),
            F.when(F.col("has_results"), F.lit("with_results")),
            F.when(F.col("has_results") & F.col("ceiling_hit"), F.lit("at_ceiling")),
        ),
        lambda r: r.isNotNull(),
    )
    entries = outcomes.select("cohort", F.explode(wanted).alias("rule")).join(rules, "rule").select("cohort", "scenario", "entry", "source")
    if requests is not None:
        asked = requests.join(outcomes.select("cohort"), "cohort", "left_semi").withColumn("entry", F.lit(len(TARGETS)))
        entries = entries.unionByName(asked.select(*entries.columns))
    return compare.last_wins(entries, ["cohort", "scenario"], "entry", ["source"]).join(designs, "scenario")


def of_scenario(table: DataFrame, plan: DataFrame, scenario: str) -> DataFrame:
    """Rows of the cohorts that the scenario is scheduled for."""
    return table.join(plan.where(F.col("scenario") == scenario).select("cohort"), "cohort", "left_semi")


def deltas(full: DataFrame, none: DataFrame, scenario: str) -> DataFrame:
    """Nested against non-nested metrics per cohort from both sets of predictions."""
    union = full.withColumn("method", F.lit("nested")).unionByName(none.withColumn("method", F.lit("non_nested")))
    table = metrics.discrimination(metrics.averaged_oof(union, ["cohort", "method"]), ["cohort", "method"], "p_oof")
    return compare.method_deltas(table, ["cohort"], "nested", "non_nested").withColumn("scenario", F.lit(scenario))


def run(
    cells: DataFrame, samples: DataFrame, plan: DataFrame, scenario: str, base: Design = PRIMARY
) -> tuple[validation.Analysis, validation.Analysis]:
    """(nested, non-nested) analysis of the cohorts that the scenario is scheduled for, and of no others."""
    own = settle(of_scenario(cells, plan, scenario)), settle(of_scenario(samples, plan, scenario))
    design = under(base, scenario)
    return validation.nested(*own, design), validation.non_nested(*own, design)


def against_primary(primary: DataFrame, parts: list[DataFrame], choices: DataFrame) -> DataFrame:
    """Change of every scheduled scenario from the primary one, with the largest size either chose.

    ``primary`` and ``parts`` come from ``deltas``; ``choices`` is (cohort, scenario, k_selected).
    """
    table = reduce(DataFrame.unionByName, parts, primary)
    largest = choices.groupBy("cohort", "scenario").agg(F.max("k_selected").alias("max_k_selected"))
    before = largest.where("scenario = 'primary'").select("cohort", F.col("max_k_selected").alias("primary_max_k_selected"))
    changed = compare.change_from_primary(table, SIZES).where("scenario <> 'primary'")
    return changed.join(largest, ["cohort", "scenario"]).join(before, "cohort").select(
        "cohort", "scenario", "n_samples", "n_positive", "primary_max_k_selected", "max_k_selected", *SIZES, *[f"change_{c}" for c in SIZES]
    )
