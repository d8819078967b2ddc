"""The paths for large groups give exactly the results of the paths for small ones."""

import tracemalloc
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldwise.catalog import compare as cc
from foldwise.catalog import metrics as cm
from foldwise.operators import bootstrap, calibration, drawtasks, metrics, neighbors, ordered, preprocess, resample
from foldwise.plans import fitting, taskside
from foldwise.sources import tuning


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(7)
    n = 400
    frame = pd.DataFrame(
        {
            "u": np.where(rng.random(n) < 0.85, "hot", "cold"),
            "id": [str(i) for i in range(n)],
            "y_true": rng.integers(0, 2, n),
            "p": np.round(rng.beta(0.3, 4, n).clip(0.001, 0.999), 3),
        }
    )
    frame["q"] = (frame.p * 0.5 + 0.2 * frame.y_true + rng.random(n) * 0.2).round(4)
    return frame, spark.createDataFrame(frame)


def brute(frame, score="p"):
    y, p = frame.y_true.to_numpy(), frame[score].to_numpy()
    a, b = p[y == 1][:, None], p[y == 0][None, :]
    auc = ((a > b) + 0.5 * (a == b)).mean()
    ap = np.mean([y[p >= t].mean() for t in p[y == 1]])
    return auc, ap, ((p - y) ** 2).mean()


def same(a, b, keys):
    a, b = (x.sort_values(keys, na_position="first").reset_index(drop=True)[sorted(x.columns)] for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-12)


@pytest.mark.parametrize("cells", [False, True])
def test_discrimination(scores, cells, monkeypatch):
    frame, df = scores
    if cells:
        monkeypatch.setattr(ordered, "ONE_TASK_ROWS", 20)
        monkeypatch.setattr(ordered, "CELL_ROWS", 7)
    got = metrics.discrimination(df, ["u"]).toPandas().set_index("u")
    for u, part in frame.groupby("u"):
        assert tuple(got.loc[u, ["roc_auc", "average_precision", "brier"]]) == pytest.approx(brute(part))


def test_cells_are_even_for_skewed_values(spark, monkeypatch):
    rng = np.random.default_rng(4)
    values = np.append(np.exp(3 * rng.standard_normal(20_000)), 1e12)
    df = spark.createDataFrame(pd.DataFrame({"u": "hot", "v": values}))
    monkeypatch.setattr(ordered, "ONE_TASK_ROWS", 1000)
    monkeypatch.setattr(ordered, "CELL_ROWS", 500)
    sizes = ordered.cut(df, ["u"], "v").groupBy("_cell").count().toPandas()["count"]
    assert len(sizes) >= 30 and sizes.max() <= 1000 and sizes.sum() == len(values)


@pytest.mark.parametrize("operator", ["roc", "pr", "bins", "ranks", "median"])
def test_cells_change_nothing(scores, operator, monkeypatch):
    _, df = scores
    run = {
        "roc": lambda: metrics.roc_points(df, ["u"]),
        "pr": lambda: metrics.pr_points(df, ["u"]),
        "bins": lambda: calibration.calibration_bins(df, ["u"]),
        "ranks": lambda: metrics.average_ranks(df, ["u"], "p"),
        "median": lambda: ordered.exact_median(df, ["u"], "p"),
    }[operator]
    plain = run().toPandas()
    monkeypatch.setattr(ordered, "ONE_TASK_ROWS", 20)
    monkeypatch.setattr(ordered, "CELL_ROWS", 5)
    cut = run().toPandas()
    keys = [c for c in plain.columns if plain[c].dtype != object or c == "u"]
    same(plain, cut, keys)
    if operator == "median":
        frame = scores[0]
        assert plain.set_index("u")["median"].to_dict() == pytest.approx(frame.groupby("u").p.median().to_dict())
    if operator == "bins":
        part = scores[0].query("u == 'hot'")
        codes = pd.qcut(part.p, min(10, part.p.nunique()), labels=False, duplicates="drop")
        assert plain.query("u == 'hot'").sort_values("bin").n.tolist() == codes.value_counts().sort_index().tolist()


@pytest.mark.parametrize("cells", [False, True])
def test_leave_one_out_medians(spark, cells, monkeypatch):
    """Ties, an empty fold, a fold that holds all values of a group, nulls."""
    rng = np.random.default_rng(11)
    frame = pd.DataFrame({"g": rng.choice(["hot", "cold"], 300, p=[0.9, 0.1]), "fold": rng.choice([1, 2, 4], 300).astype("int32"), "v": rng.integers(0, 40, 300) / 4})
    frame = pd.concat([frame, pd.DataFrame({"g": "one", "fold": np.int32(2), "v": [3.0, 1.0]}), pd.DataFrame({"g": "two", "fold": np.array([1, 2], "int32"), "v": [7.0, 9.0]})])
    df = spark.createDataFrame(frame, "g string, fold int, v double").unionByName(spark.createDataFrame([("hot", 1, None)], "g string, fold int, v double"))
    if cells:
        monkeypatch.setattr(ordered, "ONE_TASK_ROWS", 20)
        monkeypatch.setattr(ordered, "CELL_ROWS", 7)
    got = {(r.g, r.fold): r["median"] for r in preprocess.leave_one_out_medians(df, ["g"], "fold", "v").collect()}
    want = {(g, f): own.v[own.fold != f].median() for g, own in frame.groupby("g") for f in range(1, 5) if (own.fold != f).any()}
    assert got == pytest.approx(want)
    assert preprocess.leave_one_out_medians(df.limit(0), ["g"], "fold", "v").count() == 0


def test_number_by_hash(scores, spark):
    frame, df = scores
    got = ordered.number_by_hash(df, ["u"], F.md5("id"), "id", "rn").select("u", "id", "rn", F.md5("id").alias("h")).toPandas()
    want = got.sort_values("h").groupby("u").cumcount() + 1
    assert (got.rn == want.reindex(got.index)).all()


def test_bootstrap_paths_agree(scores, monkeypatch):
    _, df = scores
    in_task = bootstrap.auc_draws(df, ["u"], ["p", "q"], 20).toPandas()
    summary = bootstrap.metric_draws(df, ["u"], "p", 11).toPandas()
    assert in_task.groupby("u").draw.nunique().tolist() == [20, 20]
    monkeypatch.setattr(bootstrap, "TASK_ROWS", 100)
    mixed = bootstrap.auc_draws(df, ["u"], ["p", "q"], 20).toPandas()
    same(in_task, mixed, ["u", "draw"])
    relational = bootstrap.metric_draws(df, ["u"], "p", 11).toPandas()
    a, b = (x.sort_values(["u", "draw"]).set_index(["u", "draw"])[sorted(bootstrap.SUMMARY_METRICS)] for x in (summary, relational))
    assert np.allclose(a.astype(float), b.astype(float), atol=1e-6, equal_nan=True)
    assert (a.calibration_slope.astype(float).between(-1, 1)).all()


def test_failing_draws_fail_on_both_paths(spark, monkeypatch):
    """Few rows: many draws have one class, are separated, or have a slope near the bound."""
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"u": "few", "id": [str(i) for i in range(14)], "y_true": [0] * 8 + [1] * 6, "p": np.append(rng.uniform(0.2, 0.52, 8), rng.uniform(0.48, 0.8, 6)).round(3)})
    steep = pd.DataFrame({"u": "steep", "id": [str(i) for i in range(30)], "y_true": [0, 1] * 15, "p": 0.5 + 0.01 * np.repeat([-1, 1], 15) + 0.001 * np.arange(30) / 30})
    df = spark.createDataFrame(pd.concat([frame, steep]))
    in_task = bootstrap.metric_draws(df, ["u"], "p", 24).toPandas()
    monkeypatch.setattr(bootstrap, "TASK_ROWS", 1)
    relational = bootstrap.metric_draws(df, ["u"], "p", 24).toPandas()
    a, b = (x.sort_values(["u", "draw"]).set_index(["u", "draw"])[sorted(bootstrap.SUMMARY_METRICS)].astype(float) for x in (in_task, relational))
    assert (a.isna() == b.isna()).all().all() and 0 < a.calibration_slope.isna().sum() < len(a)
    assert np.allclose(a, b, atol=1e-5, equal_nan=True)


def test_recalibration_optimum(scores):
    """Badly scaled scores: the fits still reach the stationary point."""
    frame, df = scores
    got = calibration.recalibration(df, ["u"]).toPandas().set_index("u")
    for u, part in frame.groupby("u"):
        z, y, r = np.log(part.p / (1 - part.p)), part.y_true, got.loc[u]
        assert r.calibration_slope_status == "ok"
        shift = 1 / (1 + np.exp(-(r.calibration_intercept + z))) - y
        line = 1 / (1 + np.exp(-(r.recalibration_intercept_free + r.calibration_slope * z))) - y
        assert abs(shift.sum()) < 1e-6 and abs(line.sum()) < 1e-6 and abs((line * z).sum()) < 1e-5


def test_knn_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    z = rng.normal(size=(60, 4))
    z[rng.random(z.shape) < 0.2] = np.nan
    train = rng.random(60) < 0.7
    rows = [
        ("k", f"{i:02d}", f"f{j}", None if np.isnan(z[i, j]) else float(z[i, j]), bool(train[i]))
        for i in range(60)
        for j in range(4)
    ]
    df = spark.createDataFrame(rows, "k string, id string, feature string, z double, is_train boolean")
    whole = neighbors.knn_fill(df, ["k"]).toPandas()
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 8)
    monkeypatch.setattr(neighbors, "RARE_ROWS", 3)
    blocks = neighbors.knn_fill(df, ["k"]).toPandas()
    same(whole, blocks, ["id", "feature"])
    d = np.round(neighbors.nan_distances(z, z[train]), 9)
    for r in whole.itertuples():
        i, j = int(r.id), int(r.feature[1])
        pool = [t for t in range(train.sum()) if not np.isnan(z[train][t, j]) and np.isfinite(d[i, t])]
        near = sorted(pool, key=lambda t: (d[i, t], t))[:5]
        assert r.z == pytest.approx(z[train][near, j].mean() if near else 0.0)


def test_few_pairs_of_blocks_are_opened(spark, monkeypatch):
    """Clusters far apart, ties, a fit without donors of one feature, and rows without a common feature."""
    rng = np.random.default_rng(12)
    centre = rng.normal(size=(40, 3))
    z = centre[rng.integers(0, 40, 2000)] + rng.normal(size=(2000, 3)) * 0.02
    z[:30] = z[0]
    z[rng.random(2000) < 0.1, 1] = np.nan
    train = rng.random(2000) < 0.8
    frame = pd.DataFrame({"id": [f"{i:04d}" for i in range(2000)], "is_train": train}).assign(**{f"f{j}": z[:, j] for j in range(3)})
    odd = pd.DataFrame({"id": ["a", "b", "c"], "is_train": [True, True, False], "f0": [1.0, np.nan, np.nan], "f1": [np.nan, np.nan, np.nan], "f2": [np.nan, 2.0, 1.0]})
    long = pd.concat([f.assign(k=k).melt(["k", "id", "is_train"], var_name="feature", value_name="z") for k, f in (("x", frame), ("odd", odd))])
    df = spark.createDataFrame(long[["k", "id", "feature", "z", "is_train"]]).withColumn("z", F.when(~F.isnan("z"), F.col("z")))
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 32)
    monkeypatch.setattr(neighbors, "RARE_ROWS", 10)
    filled, opened, blocks = neighbors.search(df, ["k"])
    d = np.round(neighbors.nan_distances(z, z[train]), 9)
    got = filled.where("k = 'x'").toPandas()
    assert len(got) == np.isnan(z).sum()
    for r in got.itertuples():
        i, j = int(r.id), int(r.feature[1])
        pool = [t for t in np.argsort(d[i], kind="stable") if not np.isnan(z[train][t, j])][:5]
        assert r.z == pytest.approx(z[train][pool, j].mean())
    n = blocks.where("k = 'x'").groupBy("side").agg(F.count("n").alias("blocks"), F.sum("n").alias("rows")).toPandas().set_index("side")
    pairs = opened.where("k = 'x'").agg(F.sum(F.size("rows"))).first()[0]
    assert n.rows.receiver <= pairs < 0.2 * n.rows.receiver * n.blocks.donor
    assert opened.distinct().count() == opened.count()
    assert {(r.id, r.feature): r.z for r in filled.where("k = 'odd'").collect()} == {
        ("a", "f1"): 0.0, ("a", "f2"): 0.0, ("b", "f0"): 0.0, ("b", "f1"): 0.0, ("c", "f0"): 0.0, ("c", "f1"): 0.0,
    }


@pytest.fixture
def one_cohort(spark, folder):
    from foldwise.catalog import fits

    cells, samples = fits.inputs(spark, folder)
    return (x.where(F.col("cohort") == "AUTOMOBILE") for x in (cells, samples))


def force_distributed(monkeypatch):
    from foldwise.plans import distributed, fitting

    monkeypatch.setattr(fitting, "TASK_CELLS", 1)
    monkeypatch.setattr(distributed, "BLOCK_ROWS", 7)
    monkeypatch.setattr(distributed, "WAVE_BYTES", 12_000)


def test_distributed_grid_matches_task_grid(one_cohort, monkeypatch):
    from foldwise.plans import fitting, validation
    from foldwise.plans.design import PRIMARY

    cells, samples = one_cohort
    design = replace(PRIMARY, outer_splits=2, outer_repeats=1, en_c=(0.1,), en_l1=(0, 0.5))
    plan = validation.outer_plan(samples, design).withColumnsRenamed({"repeat": "inner_repeat", "outer_fold": "inner_fold"})
    rows, states = fitting.prepare(cells, plan, ["cohort"], design)
    a = fitting.tune_grid(rows, states, ["cohort"], design).toPandas()
    force_distributed(monkeypatch)
    b = fitting.tune_grid(rows, states, ["cohort"], design).toPandas()
    both = a.merge(b, on=["cohort", "inner_repeat", "inner_fold", "C", "l1_ratio"])
    assert len(both) == len(a) == len(b) == 4
    assert np.allclose(both.auc_x, both.auc_y) and (both.converged_x == both.converged_y).all() and both.converged_x.all()
    assert both.iterations_x.between(1, 200).all() and both.iterations_y.between(1, 200).all()
    wide = lambda column: np.array([[np.nan if v is None else v for v in x] for x in column], float)
    assert np.allclose(wide(both.coef_x), wide(both.coef_y), atol=1e-6, equal_nan=True)


def test_distributed_final_models_match_with_neighbours(spark, one_cohort, monkeypatch):
    """Neighbour imputation inside a large fit depends on the fold and on the features in use."""
    from foldwise.plans import fitting, validation
    from foldwise.plans.design import PRIMARY

    cells, samples = one_cohort
    cells = cells.withColumn("value", F.when(F.pmod(F.xxhash64("id", "feature"), F.lit(5)) > 0, F.col("value")))
    design = replace(PRIMARY, outer_splits=2, outer_repeats=1, imputation="knn")
    (names,) = [r.features for r in fitting.feature_order(cells).collect()]
    ranking = spark.createDataFrame([("AUTOMOBILE", f, j + 1) for j, f in enumerate(names[::-1])], "cohort string, feature string, rank int")
    choice = spark.createDataFrame([("AUTOMOBILE", 3, 0.1)], "cohort string, k_selected int, l2_C double")
    a = validation.fixed_specification(cells, samples, ranking, choice, design)
    ap, am = a.predictions.toPandas(), a.models.toPandas()
    force_distributed(monkeypatch)
    b = validation.fixed_specification(cells, samples, ranking, choice, design)
    keys = ["cohort", "repeat", "outer_fold"]
    p = ap.merge(b.predictions.toPandas(), on=[*keys, "id"])
    assert len(p) == len(ap) and np.allclose(p.p_x, p.p_y, atol=1e-6) and (p.y_true_x == p.y_true_y).all()
    m = am.merge(b.models.toPandas(), on=keys)
    assert len(m) == len(am) == 2 and (m.converged_x == m.converged_y).all() and np.allclose(m.intercept_x, m.intercept_y, atol=1e-6)
    wide = lambda column: np.array([[np.nan if v is None else v for v in x] for x in column], float)
    assert np.allclose(wide(m.coef_x), wide(m.coef_y), atol=1e-6, equal_nan=True)


def test_prepared_rows_are_stored_once(one_cohort):
    """A sample is one row whatever it serves, and its plans spread to exactly the inner plan."""
    from foldwise.plans import fitting, validation
    from foldwise.plans.design import PRIMARY

    cells, samples = one_cohort
    design = replace(PRIMARY, outer_splits=3, outer_repeats=2, inner_repeats=4)
    plan = validation.outer_plan(samples, design)
    inner = fitting.inner_plan(validation.training_sets(plan, ["cohort", "repeat"], "outer_fold"), validation.OUTER, design)
    rows, states = fitting.prepare(cells, inner, validation.OUTER, design)
    assert rows.count() == samples.count()
    columns = [*validation.OUTER, "inner_repeat", "inner_fold", "id", "y"]
    spread = fitting.by_resample(rows, validation.OUTER)
    assert spread.count() == samples.count() * 2 * 2 * 4
    assert spread.select(columns).exceptAll(inner.select(columns)).isEmpty()
    from foldwise.operators import preprocess

    keys = [*validation.OUTER, "inner_repeat"]
    joined = preprocess.training_state(cells, inner, keys, "inner_fold")
    packed = fitting.pack_state(joined, [*keys, "inner_fold"]).toPandas()
    both = packed.merge(states.toPandas(), on=[*keys, "inner_fold"])
    assert len(both) == len(packed) == states.count() == 2 * 3 * 4 * 3
    for c in ("impute_value", "mean", "sd"):
        number = [np.array([np.nan if v is None else v for v in np.concatenate(both[f"{c}_{s}"])], float) for s in "xy"]
        assert np.allclose(*number, equal_nan=True)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_numbers_of_small_groups_need_no_cells(scores, monkeypatch):
    """Groups numbered whole have no table of cells to join; numbers and sizes are those of the cells."""
    _, df = scores
    number = lambda: ordered.number_by_hash(df, ["u"], F.md5("id"), "id", "rn").select("u", "id", "rn", "group_n")
    whole = number()
    assert "Join" not in plan_of(whole)
    monkeypatch.setattr(ordered, "ONE_TASK_ROWS", 20)
    monkeypatch.setattr(ordered, "CELL_ROWS", 7)
    cells = number()
    assert "SortMergeJoin" in plan_of(cells) and "Broadcast" not in plan_of(cells)
    same(whole.toPandas(), cells.toPandas(), ["u", "id"])


def test_samples_are_never_broadcast(scores, spark):
    """The side of one row per group is the one that is sent around, whatever Spark measures of the samples."""
    df = scores[1].select(F.col("u").alias("cohort"), "id", F.col("y_true").alias("y"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        folds = resample.stratified_folds(df, ["cohort"], "repeat", "outer_fold", 5, 2, "outer")
        for made in (folds, resample.training_sets(folds, ["cohort", "repeat"], "outer_fold"), resample.inner_folds(folds, ["cohort"]), resample.holdout_splits(df, ["cohort"], 2)):
            assert "BroadcastHashJoin" in plan_of(made) and "SortMergeJoin" not in plan_of(made)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_primary_units_are_chosen_before_they_are_settled(spark, folder, monkeypatch):
    kept = []
    monkeypatch.setattr(cm, "settle", lambda df: kept.append(df) or df)
    cm.primary_units(spark, folder)
    assert kept[-1].select("unit_type").distinct().count() == 2


def test_inner_resamples_are_drawn_once_a_query(spark, folder, monkeypatch):
    calls, drawn = [], tuning.resamples
    monkeypatch.setattr(tuning, "resamples", lambda *a: calls.append(a) or drawn(*a))
    for query in (cc.feature_by_fit, cc.linear_predictions, cc.effective_k, cc.grid_boundary_flags, cc.rank_gaps, cc.ordered_coefficients):
        calls.clear()
        query(spark, folder)
        assert len(calls) == 1, query


def test_draws_in_batches_are_those_of_one_batch(monkeypatch):
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"y_true": np.arange(300) % 2, "_rn": np.arange(300) // 2 + 1, "p": rng.uniform(0.01, 0.99, 300).round(2)})
    once = rows.assign(_rn=np.arange(300) + 1)
    run = lambda: (drawtasks.auc_task(["u"], ["p"], "boot", 5, 17)(("a", 1), rows), drawtasks.summary_task(["u"], "p", "ordinary", 5, 17)(("a", 1), once))
    whole = run()
    monkeypatch.setattr(drawtasks, "BATCH_VALUES", 700)
    monkeypatch.setattr(drawtasks, "HASHED", 64)
    sizes, drawn = [], drawtasks.draw_weights
    monkeypatch.setattr(drawtasks, "draw_weights", lambda *a: sizes.append(len(a[-1])) or drawn(*a))
    for a, b in zip(whole, run(), strict=True):
        pd.testing.assert_frame_equal(a.reset_index(drop=True), b.reset_index(drop=True), rtol=1e-9)
        assert b.draw.tolist() == list(range(11, 18))
    assert set(sizes) == {1}


def test_neighbours_are_filled_without_all_pairs():
    """Ties, empty rows, columns without a donor: as by brute force, with a bounded share of the distances held."""
    rng = np.random.default_rng(3)
    z = np.round(rng.normal(size=(700, 4)), 1)
    z[rng.random(z.shape) < 0.3] = np.nan
    z[:3], train = np.nan, rng.random(700) < 0.6
    want, donors = z.copy(), z[train]
    distance = np.round(neighbors.nan_distances(z, donors), 9)
    for i, j in np.argwhere(np.isnan(z)):
        pool = np.flatnonzero(~np.isnan(donors[:, j]) & np.isfinite(distance[i]))
        near = pool[np.argsort(distance[i, pool], kind="stable")[:5]]
        want[i, j] = donors[near, j].mean() if len(near) else 0.0
    np.testing.assert_allclose(taskside.fill_neighbors(z, train), want, rtol=1e-12)
    big = rng.normal(size=(9000, 4))
    big[rng.random(big.shape) < 0.1] = np.nan
    tracemalloc.start()
    taskside.fill_neighbors(big, np.arange(9000) % 3 > 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_standardizing_holds_one_more_matrix():
    rng = np.random.default_rng(9)
    x = rng.gamma(2.0, size=(20_000, 20))
    x[rng.random(x.shape) < 0.1] = np.nan
    state = {
        "used": [j != 3 for j in range(20)], "impute_value": np.full(20, 0.5), "mean": np.linspace(0, 1, 20), "sd": np.linspace(1, 2, 20),
        "transform": ["log1p" if j % 2 else "identity" for j in range(20)],
    }
    before = x.copy()
    tracemalloc.start()
    z, used = taskside.standardize(x, state)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    filled = np.where(np.isnan(x), 0.5, x)
    want = (np.where(np.arange(20) % 2, np.log1p(filled), filled) - state["mean"]) / state["sd"]
    np.testing.assert_array_equal(z, want[:, used])
    np.testing.assert_array_equal(x, before)
    assert used.tolist() == [j for j in range(20) if j != 3]
    assert peak < 1.5 * x.nbytes


def test_final_fits_join_their_rows_once_if_none_can_be_large(spark, monkeypatch):
    """Rows without cells, and an id that trains a fit twice, count as they do in the join."""
    cells = spark.createDataFrame([("a", str(i), f"v{j}", 1.0) for i in range(6) for j in range(3)], "cohort string, id string, feature string, value double")
    roles = spark.createDataFrame([("a", f, str(i % 8)) for f in (1, 2) for i in range(9)], "cohort string, outer_fold int, id string")
    exact = lambda: fitting.large_fits(roles.join(fitting.pack_rows(cells), ["cohort", "id"]), ["cohort", "outer_fold"])
    monkeypatch.setattr(fitting, "TASK_CELLS", 27)
    assert not fitting.may_be_large(cells, roles, ["cohort", "outer_fold"]) and exact() is None
    monkeypatch.setattr(fitting, "TASK_CELLS", 20)
    assert fitting.may_be_large(cells, roles, ["cohort", "outer_fold"]) and exact().count() == 2


def test_a_sample_is_hashed_before_it_joins_the_inner_resamples(spark, folder, monkeypatch):
    plans, inner = [], tuning.inner_folds
    monkeypatch.setattr(tuning, "inner_folds", lambda df, *a: plans.append(df) or inner(df, *a))
    tuning.resamples(spark, folder)
    assert "_u" in plans[0].columns


@pytest.mark.parametrize("most", [500_000, 3])
def test_row_numbers_carry_half_a_digest(spark, monkeypatch, most):
    """The order is that of the hex digits, ties by id; a row without a digest is numbered by no one."""
    monkeypatch.setattr(ordered, "ONE_TASK_ROWS", most)
    hexed = ["00ff", "ff00", "00ff", "0a00", "a000", None, "7fff", "8000"]
    rows = spark.createDataFrame([("g", str(i), h) for i, h in enumerate(hexed)], "u string, id string, h string")
    numbered = ordered.number_by_hash(rows, ["u"], F.col("h"), "id", "rn")
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert "unhex" in plan
    found = [r.id for r in numbered.where("h is not null").orderBy("rn").collect()]
    assert found == [str(i) for i, h in sorted(enumerate(hexed), key=lambda r: (r[1] or "~", r[0])) if h]


@pytest.mark.parametrize("most", [500_000, 3])
def test_inner_means_are_those_of_the_plan_rows(spark, monkeypatch, most):
    """Whole classes and cells give the rows of the inner plan, also for repeated and null ids, null values and odd class sizes."""
    rng = np.random.default_rng(8)
    rows = [(c, None if i == 5 else str(i % 50), int(rng.random() < share), None if i % 9 == 0 else float(rng.random())) for c, n, share in (("a", 61, 0.5), ("b", 23, 0.2), ("c", 3, 0.4)) for i in range(n)]
    rows += [(None, "1", 1, 0.5), ("a", "2", None, 0.5)]
    samples = spark.createDataFrame(rows, "cohort string, id string, y int, v double")
    outer = resample.stratified_folds(samples, ["cohort"], "repeat", "outer_fold", 5, 2, "outer").localCheckpoint()
    inner = resample.inner_folds(outer, ["cohort"])
    keys = ["cohort", "repeat", "outer_fold", "inner_repeat", "inner_fold"]
    want = inner.groupBy(*keys).agg(F.avg("v").alias("v")).toPandas()
    # Whole, a task takes the digests of all inner repeats; no window over plan rows is left to Spark.
    monkeypatch.setattr(ordered, "ONE_TASK_ROWS", most)
    monkeypatch.setattr(ordered, "CELL_ROWS", 2)
    got = resample.inner_folds(outer, ["cohort"], 3, 5, "v")
    same(want, got.toPandas(), keys)
    assert len(want) > 200


def test_inner_resamples_number_no_plan_rows(spark, folder, monkeypatch):
    """Their means come from digests sorted in tasks: only the outer plan is numbered row by row."""
    calls, numbered = [], resample.number_by_hash
    monkeypatch.setattr(resample, "number_by_hash", lambda *a: calls.append(a[1]) or numbered(*a))
    tuning.resamples(spark, folder)
    assert calls == [["cohort", "repeat", "y"]]


def test_a_query_numbers_its_outer_plan_once(spark, folder, monkeypatch):
    made, folds = [], tuning.folds
    for module in (tuning, cc.b):
        monkeypatch.setattr(module, "folds", lambda *a: made.append(a) or folds(*a))
    for query in (cc.linear_predictions, cc.grid_boundary_flags):
        made.clear()
        query(spark, folder)
        assert len(made) == 1, query


# Fits from blocks of rows -------------------------------------------------------------------------------


def small_matrix(spark, n=90):
    """(cells, train): two cohorts of different width, two fits each, with missing, negative and zero values."""
    from foldwise.functions.scalars import hash_uniform

    u = lambda *p: hash_uniform(*p, F.col("id"))
    samples = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("cohort"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("id")
    ).withColumn("y", (u("y") < 0.5).cast("int"))
    names = F.when(F.col("cohort") == "a", F.array(*map(F.lit, "pqr"))).otherwise(F.array(*map(F.lit, "pqrst")))
    cells = samples.select("cohort", "id", F.explode(names).alias("feature")).select(
        "cohort", "id", "feature",
        F.when(u("hole", F.col("feature")) > 0.2, F.round(8 * u("v", F.col("feature")), 1) - F.when(F.col("feature") == "q", 4).otherwise(1)).alias("value"),
        F.when(F.col("feature") == "q", "identity").otherwise("log1p").alias("transform"),
        (F.col("feature") != "q").alias("half_minimum_allowed"),
        F.when(F.col("feature") == "r", "log10").otherwise("linear").alias("input_scale"),
    )
    fits = F.explode(F.array(F.lit(1), F.lit(2)))
    train = samples.withColumn("split", fits).where(F.pmod(F.xxhash64("id", "split"), F.lit(4)) > 0)
    return cells, train


def test_folds_dealt_in_tasks_are_the_numbered_ones(spark, monkeypatch):
    """One shuffled row a sample and fit instead of one an inner repeat, and the same folds."""
    from foldwise.operators import ordered, resample

    _, train = small_matrix(spark)
    fit = ["cohort", "split"]
    want = resample.stratified_folds(train, fit, "r", "fold", 3, 4, "inner", F.col("split"))
    found = resample.stratified_fold_lists(train, fit, 3, 4, "inner", "split")
    spread = found.select(*fit, "id", "y", F.posexplode("folds").alias("r", "fold")).withColumn("r", F.col("r") + 1)
    key = lambda df: sorted(map(tuple, df.select(*fit, "id", "y", "r", F.col("fold").cast("int")).collect()))
    assert key(spread) == key(want) and found.count() == train.count()
    monkeypatch.setattr(ordered, "ONE_TASK_ROWS", 10)
    assert resample.stratified_fold_lists(train, fit, 3, 4, "inner", "split") is None


@pytest.mark.parametrize("imputation", ["half_minimum", "knn"])
def test_states_of_blocks_are_those_of_the_cells(spark, imputation):
    from foldwise.operators import preprocess
    from foldwise.plans import fitting
    from foldwise.plans.design import PRIMARY

    cells, train = small_matrix(spark)
    fit, design = ["cohort", "split"], replace(PRIMARY, inner_repeats=2, imputation=imputation, missing_rate=0.22)
    keys = [*fit, "inner_repeat", "inner_fold"]
    rows, states = fitting.prepare(cells, fitting.inner_samples(train, fit, design), fit, design)
    assert rows.count() == cells.select("cohort", "id").distinct().join(train, ["cohort", "id"]).select("cohort", "id").distinct().count()
    state = preprocess.training_state(cells, fitting.inner_plan(train, fit, design), keys[:3], "inner_fold", imputation, design.missing_rate)
    both = states.toPandas().merge(fitting.pack_state(state, keys).toPandas(), on=keys)
    assert len(both) == states.count() == 2 * 2 * 2 * 3
    assert not all(all(u) for u in both.used_x)
    for r in both.to_dict("records"):
        assert list(r["used_x"]) == list(r["used_y"]) and list(r["transform_x"]) == list(r["transform_y"])
        for c in ("impute_value", "mean", "sd"):
            number = [np.array([np.nan if v is None else v for v in r[f"{c}_{s}"]], float) for s in "xy"]
            assert np.allclose(*number, rtol=1e-12, atol=1e-12, equal_nan=True)


def test_blocks_hold_the_rows_of_every_fit(spark):
    from foldwise.plans import fitting, taskside
    from foldwise.plans.design import PRIMARY

    cells, train = small_matrix(spark)
    fit, design = ["cohort", "split"], replace(PRIMARY, inner_repeats=2)
    rows = fitting.inner_samples(train, fit, design).join(fitting.pack_rows(cells), ["cohort", "id"]).repartition(3)
    want = fitting.by_resample(rows, fit).toPandas()
    for apart in (False, True):
        blocks = fitting.fit_blocks(rows, fit, apart).toPandas()
        assert len(blocks) <= 3 * 2 * 2 * (2 if apart else 1)
        for (cohort, split, part), own in blocks.groupby([*fit, "part"]):
            ids, x, y, folds = taskside.unpack(own)
            for r in (part,) if apart else (1, 2):
                told = want[(want.cohort == cohort) & (want.split == split) & (want.inner_repeat == r)].sort_values("id")
                assert list(ids) == list(told.id) and list(y) == list(told.y)
                assert list(folds[:, 0 if apart else r - 1]) == list(told.inner_fold)
                assert np.array_equal(x, taskside.matrix(told), equal_nan=True)


def test_blocks_leave_out_large_fits(spark, monkeypatch):
    """One cohort's fits go to the blocks of a task, the other's to many tasks."""
    from foldwise.plans import fitting
    from foldwise.plans.design import PRIMARY

    cells, train = small_matrix(spark)
    fit, design = ["cohort", "split"], replace(PRIMARY, inner_repeats=1)
    rows = fitting.inner_samples(train, fit, design).join(fitting.pack_rows(cells), ["cohort", "id"])
    assert fitting._shape(rows, fit)[0] is None
    monkeypatch.setattr(fitting, "TASK_CELLS", 30 * 3)
    large = fitting._shape(rows, fit)[0]
    assert sorted(tuple(r) for r in large.collect()) == [("b", 1), ("b", 2)]
    some = large.where("split = 2")
    columns = [*fit, "inner_repeat", "inner_fold", "id", "y"]
    want = fitting.by_resample(rows, fit).join(some, fit, "left_anti").select(columns)
    found = fitting.by_resample(fitting._small(rows, some, fit), fit).select(columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_a_repeated_sample_is_not_fitted(spark):
    """Its packed row would hold every feature twice."""
    from foldwise.plans import fitting
    from foldwise.plans.design import PRIMARY

    cells, train = small_matrix(spark)
    fit, design = ["cohort", "split"], replace(PRIMARY, inner_repeats=1)
    with pytest.raises(Exception, match="values a sample for"):
        fitting.prepare(cells.unionByName(cells), fitting.inner_samples(train, fit, design), fit, design)
