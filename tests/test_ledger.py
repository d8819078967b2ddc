"""A run that is killed between and inside units resumes and ends as an unbroken one; planted faults are found."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.plans import ledger, validation
from foldwise.plans.design import PRIMARY

SMALL = replace(PRIMARY, outer_splits=3, outer_repeats=1, inner_splits=2, inner_repeats=1, en_c=(0.1,), en_l1=(0.5,), l2_c=(0.1, 1.0), max_k=2)


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"cohort": np.repeat(["A", "B"], 40), "id": [f"s{i}" for i in range(80)], "y": rng.integers(0, 2, 80)})
    for j in range(3):
        frame[f"f{j}"] = rng.normal(size=80) + frame.y * (j == 0)
    cells = frame.melt(["cohort", "id", "y"], var_name="feature").drop(columns="y").assign(transform="identity", half_minimum_allowed=False, input_scale="linear")
    return spark.createDataFrame(cells), spark.createDataFrame(frame[["cohort", "id", "y"]])


@pytest.fixture(scope="module")
def plan(spark):
    return spark.createDataFrame([("A", "primary"), ("B", "primary"), ("A", "outer3")], "cohort string, scenario string")


def rows(tables):
    return {n: sorted(map(str, t.select(sorted(t.columns)).collect())) for n, t in tables.items()}


@pytest.fixture(scope="module")
def unbroken(spark, matrix, plan, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("whole"))
    finished = ledger.fit_unfinished(*matrix, plan, root, "v1", SMALL)
    return ledger.bundle(spark, root, finished)


def test_killed_run_resumes(spark, matrix, plan, unbroken, tmp_path, monkeypatch):
    root, calls = str(tmp_path / "run"), []

    def analyse(cells, samples, design):
        calls.append((design.scenario, sorted(r.cohort for r in samples.select("cohort").distinct().collect())))
        return validation.nested(cells, samples, design)

    def killed(*_):
        raise KeyboardInterrupt

    # The first scenario is finished; the second has its tables written, but never reaches the ledger.
    whole, commits = ledger._commit, []
    monkeypatch.setattr(ledger, "_commit", lambda *a: killed() if commits else (commits.append(1), whole(*a)))
    with pytest.raises(KeyboardInterrupt):
        ledger.fit_unfinished(*matrix, plan, root, "v1", SMALL, analyse)
    monkeypatch.setattr(ledger, "_commit", whole)
    assert calls == [("outer3", ["A"]), ("primary", ["A", "B"])]
    assert spark.read.parquet(f"{root}/predictions").count() == 40 + 80
    assert [(r.cohort, r.scenario) for r in ledger.entries(spark, root).collect()] == [("A", "outer3")]

    finished = ledger.fit_unfinished(*matrix, plan, root, "v1", SMALL, analyse)
    assert calls[2:] == [("primary", ["A", "B"])]
    assert spark.read.parquet(f"{root}/predictions").count() == 40 + 2 * 80
    assert rows(ledger.bundle(spark, root, finished)) == rows(unbroken)
    ledger.fit_unfinished(*matrix, plan, root, "v1", SMALL, analyse)
    assert len(calls) == 3

    # One label of B changes: only B is fitted again, and A keeps its rows.
    cells, samples = matrix
    flipped = samples.withColumn("y", F.when(F.col("id") == "s50", 1 - F.col("y")).otherwise(F.col("y")))
    finished = ledger.fit_unfinished(cells, flipped, plan, root, "v1", SMALL, analyse)
    assert calls[3:] == [("primary", ["B"])] and finished.count() == 3
    tables = ledger.bundle(spark, root, finished)
    assert tables["predictions"].count() == 120
    assert ledger.problems(tables, flipped, "primary", SMALL).collect() == []
    # Another version accepts nothing of it.
    current = ledger.sources(*matrix)
    assert ledger.unfinished(plan, ledger.accepted(ledger.entries(spark, root), current, "v2")).count() == 3


def test_planted_faults_are_found(matrix, unbroken):
    samples = matrix[1]
    assert ledger.problems(unbroken, samples, "primary", SMALL).collect() == []
    assert ledger.count_problems(unbroken, samples, "primary", SMALL).isEmpty()
    p = unbroken["predictions"].where("id <> 's1'").withColumn("y_true", F.when(F.col("id") == "s2", 1 - F.col("y_true")).otherwise(F.col("y_true")))
    p = p.withColumn("outer_fold", F.when(F.col("id") == "s3", F.col("outer_fold") % 3 + 1).otherwise(F.col("outer_fold"))).withColumn("p", F.when(F.col("id") == "s4", 1.5).otherwise(F.col("p")))
    p = p.unionByName(p.where("id = 's5'"))
    bad = {
        **unbroken,
        "predictions": p,
        "choice": unbroken["choice"].withColumn("l2_C", F.when(F.col("outer_fold") == 1, 0.3).otherwise(F.col("l2_C"))).withColumn("k_selected", F.when(F.col("outer_fold") == 2, 3).otherwise(F.col("k_selected"))),
        "best": unbroken["best"].withColumn("l1_ratio", F.when(F.col("outer_fold") == 3, 0.9).otherwise(F.col("l1_ratio"))),
        "ranking": unbroken["ranking"].where("not (cohort = 'B' and outer_fold = 2 and rank = 1)"),
    }
    found = ledger.problems(bad, samples, "primary", SMALL).toPandas()
    told = {(r.subject, r.problem) for r in found.itertuples() if r.table == "predictions"}
    assert told == {("s1", "missing"), ("s2", "label_differs"), ("s3", "fold_differs"), ("s4", "not_a_probability"), ("s5", "repeated")}
    kinds = found.groupby(["table", "problem"]).size().to_dict()
    assert kinds["choice", "C_not_on_grid"] == 2 and kinds["choice", "size_out_of_range"] == 2 and kinds["best", "l1_ratio_not_on_grid"] == 2
    assert kinds["ranking", "ranks_broken"] == 1 and kinds["repeat_metrics", "not_reproduced"] >= 1
    counts = ledger.count_problems(bad, samples, "primary", SMALL).collect()
    assert counts == [] or {r.table for r in counts} == {"predictions"}
    fewer = {**unbroken, "models": unbroken["models"].where("not (cohort = 'A' and outer_fold = 1)")}
    assert [tuple(r) for r in ledger.count_problems(fewer, samples, "primary", SMALL).collect()] == [("A", "primary", "models", 3, 2)]
