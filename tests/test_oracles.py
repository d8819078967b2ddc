"""Registered queries against their DuckDB text on the smallest data set.

A cross-section by default; every query with FOLDWISE_FULL=1.
"""

import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

QUICK = [
    "fold_assignment", "rare_label_folds", "holdout_assignment", "outer_fold_counts", "oof_discrimination",
    "roc_coordinates", "pr_coordinates", "calibration_bins", "recalibration_fits", "auc_bootstrap",
    "ingest_text_matrices", "ingest_admission", "admitted_matrices", "matrix_file_problems", "cell_problems", "feature_rules", "feature_manifest", "restoration_check",
    "one_se_choice", "selection_frequency", "pairwise_jaccard", "method_comparison", "omission_summaries",
    "signed_rank_test", "coverage_grid", "saved_predictions_vs_plan", "parameter_row_problems",
    "preprocessing_state", "standardized_holdout_cells", "knn_imputed_cells",
    "fitted_bundle_counts", "fitted_predictions_vs_plan", "fitted_bundle_problems", "fixed_holdout_intervals",
]
ORACLE = entry.oracle_sql()
NAMES = sorted(ORACLE) if os.environ.get("FOLDWISE_FULL") else QUICK


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"create view {f.stem} as select * from '{f}'")
    return con


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return (0, "")
    if isinstance(v, bool):
        return (1, str(v))
    if isinstance(v, (int, float)):
        return (2, repr(round(float(v), 9) + 0.0))
    return (3, str(v))


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(name, spark, folder, duck):
    df = entry.queries()[name](spark, folder)
    want = duck.execute(ORACLE[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 5
