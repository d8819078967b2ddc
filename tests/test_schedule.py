"""Scenarios scheduled out of primary fits, on one cohort with more features than sizes and one with few."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from foldwise.plans import fitting, schedule, validation
from foldwise.plans.design import MAX_K, PRIMARY, SCENARIOS

SMALL = replace(PRIMARY, outer_splits=3, outer_repeats=1, inner_splits=3, inner_repeats=1, en_c=(0.1,), en_l1=(0.05,), l2_c=(0.1,))


@pytest.fixture(scope="module")
def matrix(spark):
    """Thirty-six features that carry equally much, and four of which one carries everything."""
    rng = np.random.default_rng(3)
    parts, labels = [], []
    for cohort, n, width in (("WIDE", 240, 36), ("NARROW", 120, 4)):
        y = (np.arange(n) % 2).astype(int)
        x = rng.normal(size=(n, width))
        x[:, : width if cohort == "WIDE" else 1] += (0.45 if cohort == "WIDE" else 3.0) * y[:, None]
        ids = [f"{cohort}{i}" for i in range(n)]
        frame = pd.DataFrame(x, columns=[f"f{j:02d}" for j in range(width)]).assign(id=ids, cohort=cohort)
        parts.append(frame.melt(["cohort", "id"], var_name="feature"))
        labels.append(pd.DataFrame({"cohort": cohort, "id": ids, "y": y}))
    # A cohort with one positive cannot be split: it is there, but without results.
    labels.append(pd.DataFrame({"cohort": "LONE", "id": ["a", "b", "c"], "y": [0, 0, 1]}))
    parts.append(pd.DataFrame({"cohort": "LONE", "id": ["a", "b", "c"], "feature": "f00", "value": [1.0, 2.0, 3.0]}))
    cells = pd.concat(parts).assign(transform="identity", half_minimum_allowed=False, input_scale="linear")
    return spark.createDataFrame(cells), spark.createDataFrame(pd.concat(labels))


@pytest.fixture(scope="module")
def primary(matrix):
    return validation.nested(*matrix, SMALL)


def test_schedule_follows_the_primary_fits(spark, matrix, primary):
    outcomes = schedule.primary_outcomes(matrix[1], primary.tuned.choice, primary.predictions, SMALL.max_k)
    found = {r.cohort: r for r in outcomes.collect()}
    assert found["WIDE"].ceiling_hit and found["WIDE"].max_k_selected == MAX_K and found["WIDE"].fits == 3
    assert not found["NARROW"].ceiling_hit and found["NARROW"].has_results
    assert (found["LONE"].fits, found["LONE"].has_results, found["LONE"].ceiling_hit) == (0, False, False)
    rows = {(r.cohort, r.scenario): r for r in schedule.schedule(outcomes).collect()}
    assert set(rows) == {
        ("WIDE", "knn"), ("NARROW", "knn"), ("LONE", "knn"), ("WIDE", "outer3"), ("NARROW", "outer3"),
        ("WIDE", "reggrid"), ("NARROW", "reggrid"), ("WIDE", "kmax30"),
    }
    assert rows["WIDE", "kmax30"].max_k == 30 and rows["WIDE", "knn"].imputation == "knn" and rows["WIDE", "outer3"].outer_splits == 3
    asked = [("NARROW", "kmax30", "explicit"), ("WIDE", "kmax30", "explicit"), ("ABSENT", "knn", "explicit"), ("WIDE", "unknown", "explicit")]
    more = {(r.cohort, r.scenario): r for r in schedule.schedule(outcomes, spark.createDataFrame(asked, "cohort string, scenario string, source string")).collect()}
    assert set(more) == set(rows) | {("NARROW", "kmax30")}
    assert (more["WIDE", "kmax30"].source, more["WIDE", "kmax30"].n_entries) == ("explicit", 2)
    assert (more["WIDE", "knn"].source, more["WIDE", "knn"].n_entries) == ("imputation_sensitivity", 1)
    assert schedule.schedule(outcomes.limit(0)).count() == 0


def test_a_scenario_fits_its_cohorts_and_differs(matrix, primary):
    cells, samples = matrix
    outcomes = schedule.primary_outcomes(samples, primary.tuned.choice, primary.predictions, SMALL.max_k)
    full, none = schedule.run(cells, samples, schedule.schedule(outcomes), "kmax30", SMALL)
    assert [r.cohort for r in full.predictions.select("cohort").distinct().collect()] == ["WIDE"]
    base = validation.non_nested(cells, samples, SMALL)
    table = schedule.against_primary(
        schedule.deltas(primary.predictions, base.predictions, "primary"),
        [schedule.deltas(full.predictions, none.predictions, "kmax30")],
        primary.tuned.choice.selectExpr("cohort", "'primary' scenario", "k_selected").unionByName(full.tuned.choice.selectExpr("cohort", "'kmax30' scenario", "k_selected")),
    ).collect()
    assert [(r.cohort, r.scenario, r.primary_max_k_selected) for r in table] == [("WIDE", "kmax30", MAX_K)]
    assert table[0].max_k_selected > MAX_K and table[0].change_nested_roc_auc > 0.01


def test_coefficients_of_the_chosen_features_only(primary):
    listed = fitting.model_coefficients(primary.models, primary.order, validation.OUTER).groupBy(*validation.OUTER).count()
    both = listed.join(primary.tuned.choice, validation.OUTER).collect()
    assert len(both) == 6 and all(r["count"] == r.k_selected for r in both)


def test_design_of_a_scenario():
    assert schedule.under(PRIMARY, "kmax30") == replace(SCENARIOS["kmax30"], scenario="kmax30")
    small = schedule.under(SMALL, "knn")
    assert small.imputation == "knn" and small.outer_repeats == 1 and small.en_c == (0.1,)
