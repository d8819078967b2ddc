"""Sources, sinks, overwrite protection and the checks that raise."""

import pytest
from pyspark.sql import functions as F

from foldwise.operators import checks, ingest, resample, rules
from foldwise.plans import fitting
from foldwise.sources import files


def test_overwrite_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([("dataset1_pre", "001", "1", "2.5")], "key string, id string, category string, f string")
    target = str(tmp_path / "out")
    files.write_matrices(df, target, "key")
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_matrices(df, target, "key")
    back = files.scan_matrices(spark, target, ["f"]).collect()
    assert [(r.cohort_key, r.id, r.f) for r in back] == [("dataset1_pre", "001", "2.5")]


def test_unknown_file_names_have_no_key(spark, tmp_path):
    (tmp_path / "dataset2_post1.csv").write_text("id,category,f\n01,1,NA\n")
    (tmp_path / "notes.csv").write_text("x\n")
    found = {r.path.rsplit("/", 1)[1]: r.cohort_key for r in files.key_inventory(spark, str(tmp_path), "*.csv").collect()}
    assert found == {"dataset2_post1.csv": "dataset2_post1", "notes.csv": None}


def test_json_settings(spark, tmp_path):
    path = tmp_path / "settings.json"
    path.write_text('{"outer_splits": 5,\n "grid": [0.1, 1]}')
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("outer_splits", T.IntegerType()), T.StructField("grid", T.ArrayType(T.DoubleType()))])
    row = files.read_settings(spark, str(path), schema).first()
    assert row.outer_splits == 5 and row.grid == [0.1, 1.0]


def test_required_columns(spark):
    with pytest.raises(ValueError, match="missing columns"):
        checks.require_columns(spark.range(1), ["id", "p"])


def test_clean_tables_have_no_violations(spark):
    good = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.25)], "id string, n int, p double")
    assert checks.range_violations(good, ["id"], {"n": (1, 5, True), "p": (0, 1, False)}).isEmpty()
    assert checks.set_difference(good, good, ["id", "n"]).isEmpty()
    assert checks.disagreement(good, good, ["id"], ["n", "p"]).isEmpty()
    assert checks.duplicate_keys(good, ["id"]).isEmpty()


def test_fingerprint_ignores_order_only(spark):
    rows = [("g", str(i), i * 0.5) for i in range(50)]
    print_of = lambda r: ingest.fingerprint(
        spark.createDataFrame(r, "g string, id string, v double").repartition(3), ["g"], [F.col("id"), F.col("v").cast("string")]
    ).first().fingerprint
    assert print_of(rows) == print_of(rows[::-1])
    assert print_of(rows) != print_of(rows[:-1] + [("g", "49", 25.0)])


def test_rule_conflicts(spark):
    broken = spark.createDataFrame(
        [("log1p", True, True, True, "log10"), ("identity", False, False, True, "derived_log10_ratio"), ("identity", False, False, False, "derived_log10_ratio")],
        rules.RULE_SCHEMA,
    )
    problems = [r.problem for r in broken.select(rules.rule_violation().alias("problem")).collect()]
    assert problems == ["log_scale_needs_identity_and_valid_values", "ratio_forbids_half_minimum", None]


def test_folds_are_balanced(spark):
    samples = spark.createDataFrame([("c", str(i), int(i % 3 == 0)) for i in range(53)], "cohort string, id string, y int")
    plan = resample.stratified_folds(samples, ["cohort"], "repeat", "fold", 5, 3, "t")
    sizes = plan.groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).toPandas()
    assert len(sizes) == 15 and sizes.n.max() - sizes.n.min() <= 1 and sizes.p.max() - sizes.p.min() <= 1
    rare = spark.createDataFrame([("c", str(i), int(i == 0)) for i in range(9)], "cohort string, id string, y int")
    assert resample.stratified_folds(rare, ["cohort"], "repeat", "fold", 5, 3, "t").isEmpty()


def test_holdout_quota(spark):
    samples = spark.createDataFrame([("c", str(i), int(i < 7)) for i in range(24)], "cohort string, id string, y int")
    plan = resample.holdout_splits(samples, ["cohort"], splits=4)
    test = plan.where("subset = 'test'").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("p")).collect()
    assert {(r.n, r.p) for r in test} == {(8, 2)}


def test_a_matrix_is_taken_whole_or_not_at_all(spark):
    raw = spark.createDataFrame(
        [
            ("good", "1.0", "R", "1.5"), ("good", "2", "NR", "NA"), ("good", None, None, None),
            ("token", "1", "R", "abc"), ("token", "2", "NR", "1"),
            ("infinite", "1", "R", "Infinity"), ("infinite", "2", "0", "1"),
            ("label", "1", "maybe", "1"), ("label", "2", "0", "1"),
            ("twin", "7", "R", "1"), ("twin", " 7.0 ", "R", "1"),
            ("blank", " ", "R", "1"), ("blank", "2", "0", "1"),
        ],
        "m string, id string, y string, ` f ` string",
    )
    manifest = ingest.admission(raw, ["m"], "id", "y", [" f "])
    found = {r.m: (r.status, r.problems, r.n_rows) for r in manifest.collect()}
    assert found == {
        "good": ("accepted", "", 2), "token": ("rejected", "non_numeric", 2), "infinite": ("rejected", "non_finite", 2),
        "label": ("rejected", "unknown_label", 2), "twin": ("rejected", "duplicate_id", 2), "blank": ("rejected", "blank_id", 2),
    }
    taken = ingest.admit(ingest.ingest(raw, ["m"], "id", "y", [" f "]), manifest, ["m"])
    assert sorted((r.m, r.id, r.y, r.f) for r in taken.collect()) == [("good", "1", 1, 1.5), ("good", "2", 0, None)]
    assert ingest.admission(raw.limit(0), ["m"], "id", "y", [" f "]).isEmpty()


def test_file_names_that_are_refused(spark):
    names = ["dataset1_pre.csv", "x/Dataset01_pre.csv", "dataset99_pre.csv", "notes.csv", "dataset2_post1.csv"]
    found = files.key_problems(spark.createDataFrame([(n,) for n in names], "path string"))
    assert {r.path: r.problem for r in found.collect()} == {
        "dataset1_pre.csv": "several_files_per_key", "x/Dataset01_pre.csv": "several_files_per_key",
        "dataset99_pre.csv": "number_out_of_range", "notes.csv": "unknown_name",
    }


def test_a_failed_cohort_is_reported(spark):
    models = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "cohort string, converged boolean")
    assert sorted(tuple(r) for r in fitting.fit_status(models, ["cohort"]).collect()) == [("a", 2, 1, "failed"), ("b", 1, 0, "ok")]
