"""Known answers for the statistical operators."""

import math

import pytest
from pyspark.sql import functions as F

from foldwise.functions.scalars import clean_id, exact_integer, parse_label, prior_adjusted, wilson
from foldwise.operators import calibration, compare, inference, metrics, preprocess, resample

DELTAS = [0.1, 0.2, 0.05, 0.12, 0.18, 0.15]


def deltas(spark, values, names=None):
    names = names or [f"c{i + 1}" for i in range(len(values))]
    return spark.createDataFrame([("g", n, v) for n, v in zip(names, values)], "g string, cohort string, d double")


def test_signed_rank_six_positive(spark):
    row = inference.signed_rank(deltas(spark, DELTAS), ["g"], "d").first()
    assert row.p_value == 0.03125 and row.enumerations == 64 and row.rank_sum == 21


def test_signed_rank_zeros_and_many(spark):
    assert inference.signed_rank(deltas(spark, [0.0, 0.0]), ["g"], "d").first().p_value == 1.0
    row = inference.signed_rank(deltas(spark, [0.01 * i for i in range(1, 23)]), ["g"], "d").first()
    assert row.p_value == 2.0**-21 and row.n_nonzero == 22
    for n in (60, 500):
        signed = [i * (-1) ** i for i in range(1, n + 1)]
        row = inference.signed_rank(deltas(spark, [float(d) for d in signed]), ["g"], "d").first()
        plus, total = sum(d for d in signed if d > 0), n * (n + 1) // 2
        ways = [1]  # exact counts of sign vectors by rank sum, as Python integers
        for r in range(1, n + 1):
            ways = [a + b for a, b in zip(ways + [0] * r, [0] * r + ways)]
        far = sum(w for s, w in enumerate(ways) if abs(2 * s - total) >= abs(2 * plus - total))
        assert row.p_value == pytest.approx(far / 2**n, rel=1e-12) and row.t_plus == plus


def test_sign_test_many(spark):
    for up, down in ((550, 550), (2600, 2400), (1000, 3)):
        row = inference.sign_test(deltas(spark, [1.0] * up + [-1.0] * down), ["g"], "d").first()
        n = up + down
        exact = min(1, 2 * sum(math.comb(n, i) for i in range(min(up, down) + 1)) / 2**n)
        assert row.p_value == pytest.approx(exact, rel=1e-9)


@pytest.mark.parametrize("share, n_test", [(0.25, 25), (0.04, 4), (0.3, 30), (0.015, 2)])
def test_holdout_share_is_exact(spark, share, n_test):
    rows = [("g", f"s{i}", int(i % 2)) for i in range(100)]
    splits = resample.holdout_splits(spark.createDataFrame(rows, "g string, id string, y int"), ["g"], 2, share)
    assert {r["count"] for r in splits.where("subset = 'test'").groupBy("split").count().collect()} == {n_test}


def test_sign_test(spark):
    row = inference.sign_test(deltas(spark, [1.0, 2.0, 3.0, -1.0, 0.0]), ["g"], "d").first()
    assert (row.n_positive, row.n_negative, row.n_zero) == (3, 1, 1)
    assert row.p_value == pytest.approx(2 * (1 + 4) / 16)


def test_formal_inference_not_run(spark):
    required = spark.createDataFrame([("g", c) for c in ("c1", "c2", "c9")], "g string, cohort string")
    rows = inference.formal_inference(deltas(spark, DELTAS), ["g"], "d", required).collect()
    assert [(r.status, r.missing_cohorts) for r in rows] == [("missing_prespecified_cohorts", "c9")]


def test_omission_summaries(spark):
    table = inference.omission_summaries(
        deltas(spark, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]), ["g"], "d", "c6"
    ).collect()
    by = {(r.summary, r.excluded_cohort): r for r in table}
    assert by["all_available", ""].mean_delta == pytest.approx(0.35)
    assert by["all_available", ""].median_delta == pytest.approx(0.35)
    assert by["named_subset", "c6"].mean_delta == pytest.approx(0.3)
    assert len(table) == 8
    single = inference.omission_summaries(deltas(spark, [0.4]), ["g"], "d", "c1").collect()
    empty = [r for r in single if r.n_retained == 0]
    assert empty and all(r.mean_delta is None and r.status == "no_retained_cohorts" for r in empty)


def test_calibration_bins_and_wilson(spark):
    scores = spark.createDataFrame(
        [("u", i / 10, int(i > 4)) for i in range(1, 9)], "u string, p double, y_true int"
    )
    rows = calibration.calibration_bins(scores, ["u"], bins=2).orderBy("bin").collect()
    assert [(r.n, r.n_positive) for r in rows] == [(4, 0), (4, 4)]
    assert rows[0].observed_rate_wilson95_high == pytest.approx(0.4898908364545973, abs=1e-12)
    assert rows[1].observed_rate_wilson95_low == pytest.approx(0.5101091635454027, abs=1e-12)
    tied = spark.createDataFrame([("u", 0.5, y) for y in (0, 1, 1)], "u string, p double, y_true int")
    (only,) = calibration.calibration_bins(tied, ["u"]).collect()
    assert (only.bin, only.n, only.n_positive) == (1, 3, 2) and only.observed_rate == pytest.approx(2 / 3)


def test_wilson_half(spark):
    low, high = wilson(F.lit(2), F.lit(4))
    row = spark.range(1).select(low.alias("low"), high.alias("high")).first()
    assert row.low == pytest.approx(0.15003898914215) and row.high == pytest.approx(0.84996101085785)


def test_averaged_oof_and_repeat_deltas(spark):
    p = {
        "nested": [(0.1, 0.8, 0.2, 0.7), (0.1, 0.2, 0.8, 0.9)],
        "non_nested": [(0.1, 0.2, 0.8, 0.9)] * 2,
    }
    rows = [
        ("c", m, f"0{i}", r + 1, (0, 0, 1, 1)[i], v[i])
        for m, repeats in p.items()
        for r, v in enumerate(repeats)
        for i in range(4)
    ]
    pred = spark.createDataFrame(rows, "cohort string, method string, id string, repeat int, y_true int, p double")
    oof = metrics.discrimination(metrics.averaged_oof(pred, ["cohort", "method"]), ["cohort", "method"], "p_oof")
    row = compare.method_deltas(oof, ["cohort"], "nested", "non_nested").first()
    assert row.nested_roc_auc == 0.875 and row.non_nested_roc_auc == 1.0 and row.delta_roc_auc == 0.125
    per = {(r.method, r.repeat): r.roc_auc for r in metrics.discrimination(pred, ["method", "repeat"]).collect()}
    assert [per["non_nested", r] - per["nested", r] for r in (1, 2)] == [0.5, 0.0]


def test_scale_aware_imputation(spark):
    rows = [("a", str(i), "log", v, "identity", True, "log10") for i, v in enumerate([-1.0, 0.0, 2.0, None])]
    rows += [("a", str(i), "ratio", v, "identity", False, "derived_log10_ratio") for i, v in enumerate([-3.0, -1.0, 1.0, None])]
    cells = spark.createDataFrame(
        rows, "cohort string, id string, feature string, value double, transform string, half_minimum_allowed boolean, input_scale string"
    )
    train = cells.select("cohort", "id").distinct()
    state = {r.feature: r for r in preprocess.single_state(cells, train, ["cohort"]).collect()}
    assert state["log"].impute_value == pytest.approx(-1 - math.log10(2))
    assert state["ratio"].impute_value == -1.0
    filled = [-1.0, 0.0, 2.0, -1 - math.log10(2)]
    mean = sum(filled) / 4
    assert state["log"].mean == pytest.approx(mean)
    assert state["log"].sd == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in filled) / 4))


def test_cohort_selection(spark):
    available = spark.createDataFrame([("C7",)], "cohort string")
    requests = spark.createDataFrame(
        [("all", None, 1), ("missing", "c2", 1), ("twice", "C7", 1), ("twice", "c7 ", 2)],
        "selector string, cohort string, ord int",
    )
    got = {(r.selector, r.cohort): r.status for r in compare.select_cohorts(requests, available, ["C2", "C7"]).collect()}
    assert got == {("all", "C7"): "selected", ("missing", "C2"): "missing", ("twice", "C7"): "duplicate"}


def test_scalar_edges(spark):
    df = spark.createDataFrame([("007",), (" 12.0 ",), ("1.5",), ("Non_Responder",), ("maybe",), ("1e400",)], "t string")
    rows = df.select(clean_id("t").alias("i"), parse_label("t").alias("y"), exact_integer("t").alias("n")).collect()
    assert [r.i for r in rows] == ["007", "12", "1.5", "Non_Responder", "maybe", "1e400"]
    assert [r.y for r in rows] == [None, None, None, 0, None, None]
    assert [r.n for r in rows] == [7, 12, None, None, None, None]
    adjusted = spark.range(1).select(prior_adjusted(F.lit(0.5), F.lit(30), F.lit(10)).alias("p")).first().p
    assert adjusted == pytest.approx(0.75)
