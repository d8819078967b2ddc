"""Tuning, ranking, size selection and final fits for every training set at once.

A *fit* is one outer training set, named by its key columns (cohort, repeat, outer_fold; or cohort,
split; or just cohort). Stages depend on each other and are settled in between:

    inner plan -> training states -> grid scores and coefficients -> best point, ranking
               -> k scores -> k and C -> final models and predictions

Spark plans, shuffles and aggregates; a task receives the packed rows of one (fit, inner repeat)
with the training states of its folds and only solves the small regressions.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators import preprocess, selection
from foldwise.operators.ordered import in_one_task
from foldwise.operators.resample import stratified_fold_lists, stratified_folds
from foldwise.plans import distributed, solver
from foldwise.plans.design import (
    EN_ITERATION_LIMIT,
    EN_ITERATIONS,
    L2_ITERATION_LIMIT,
    Design,
)
from foldwise.plans.taskside import fill_neighbors, schema_of, standardize, training_states, unpack
from foldwise.session import settle

# One task holds the rows of one fit: at most this many cells. Up to ten doubles are held for each (the rows as they
# arrive, as a matrix, scaled and split), and the tasks of an executor add up. Larger fits go to
# ``foldwise.plans.distributed``, which never gathers the rows of a fit. Only the place of the work differs: optimum, convergence and the unit of the iteration limits are the same.
TASK_CELLS = 8_000_000
STATE = ["impute_value", "mean", "sd", "used", "transform"]
#: Sizes whose regressions a task solves in one batch.
SIZES = 5
#: Bytes of blocks that a task sends on at a time.
SEND_BYTES = 16 << 20


@dataclass
class Tuned:
    grid: DataFrame  # fit, C, l1_ratio, mean_auc, ...
    best: DataFrame  # fit, C, l1_ratio, mean_auc
    ranking: DataFrame  # fit, feature, rank, frequencies
    curve: DataFrame  # fit, k, best_C, mean_auc, se_auc
    choice: DataFrame  # fit, k_selected, l2_C
    folds: DataFrame  # fit, inner_repeat, inner_fold, C, l1_ratio, auc, converged, iterations, coef


# Packing ---------------------------------------------------------------------------------------------


def pack_rows(cells: DataFrame) -> DataFrame:
    """(cohort, id, x): one array per sample in feature order; NULL cells stay NULL."""
    ordered = F.array_sort(F.collect_list(F.struct("feature", "value")))
    return cells.groupBy("cohort", "id").agg(F.transform(ordered, lambda c: c["value"]).alias("x"))


def feature_order(cells: DataFrame) -> DataFrame:
    """(cohort, features): the names behind the array positions; bounded by the matrix width."""
    return cells.select("cohort", "feature").distinct().groupBy("cohort").agg(
        F.array_sort(F.collect_list("feature")).alias("features")
    )


def pack_state(state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Training state per key as arrays in feature order."""
    ordered = F.array_sort(F.collect_list(F.struct("feature", *STATE)))
    packed = state.groupBy(*keys).agg(ordered.alias("_s"))
    return packed.select(*keys, *[F.col(f"_s.{f}").alias(f) for f in STATE])


def large_fits(rows: DataFrame, fit: Sequence[str]) -> DataFrame | None:
    """(fit) whose rows would not fit one task, or None when there is none."""
    sizes = rows.groupBy(*fit).agg((F.count(F.lit(1)) * F.max(F.size("x"))).alias("cells"))
    if (sizes.agg(F.max("cells")).first()[0] or 0) <= TASK_CELLS:
        return None
    return settle(sizes.where(F.col("cells") > TASK_CELLS).select(*fit).distinct())


def _shape(rows: DataFrame, fit: Sequence[str]) -> tuple[DataFrame | None, bool]:
    """(large fits of prepared rows, whether the inner repeats of a fit go to tasks of their own).

    A fit has at most the rows of its cohort: its rows are counted only where those are too many.
    """
    cells = (F.count(F.lit(1)) * F.max(F.size("x"))).alias("cells")
    most, fits = rows.groupBy("cohort").agg(cells, F.max(F.size("plans")).alias("fits")).agg(F.max("cells"), F.sum("fits")).first()
    large = None if (most or 0) <= TASK_CELLS else large_fits(by_fit(rows, fit), fit)
    return large, (fits or 0) < 4 * rows.sparkSession.sparkContext.defaultParallelism


def may_be_large(cells: DataFrame, roles: DataFrame, fit: Sequence[str]) -> bool:
    """Whether the rows of the fits must be joined to tell: not where the most rows times the most cells fit a task."""
    rows = roles.groupBy(*fit).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    width = cells.groupBy("cohort", "id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    return rows * width > TASK_CELLS


def _split(df: DataFrame, large: DataFrame, fit: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return df.join(large, list(fit), "left_anti"), df.join(large, list(fit), "left_semi")


def fit_blocks(rows: DataFrame, fit: Sequence[str], apart: bool) -> DataFrame:
    """(fit, part, ids, y, x, folds): rows with ``plans`` spread over their fits, as bytes.

    A block holds the rows that one Arrow batch has for a fit, so what is shuffled are a few large rows. ``part`` is 0,
    or with ``apart`` the inner repeat, which then has blocks of its own.
    """
    fit = list(fit)
    others = [c for c in fit if c != "cohort"]
    names = [*fit, "part", "ids", "y", "x", "folds"]
    schema = schema_of_fit(rows, fit) + ", part int, ids array<string>, y binary, x binary, folds binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            plans, lists = batch.column("plans"), batch.column("x")
            entries, widths = plans.flatten(), lists.value_lengths().to_numpy()
            if not len(entries):
                continue
            owner = np.repeat(np.arange(batch.num_rows), plans.value_lengths().to_numpy())
            cells, start = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(widths) - widths
            dealt = entries.field("folds").flatten().to_numpy(zero_copy_only=False).astype("<i2").reshape(len(entries), -1)
            ids, y = batch.column("id").to_numpy(zero_copy_only=False), batch.column("y").to_numpy(zero_copy_only=False).astype("i1")
            keys = pd.DataFrame({"cohort": batch.column("cohort").to_numpy(zero_copy_only=False)[owner]} | {c: entries.field(c).to_numpy(zero_copy_only=False) for c in others})
            for key, at in keys.groupby(fit, sort=False).indices.items():
                own = owner[at]
                x = cells[start[own][:, None] + np.arange(widths[own[0]])].astype("<f8")
                key = [k.item() if isinstance(k, np.generic) else k for k in (key if isinstance(key, tuple) else (key,))]
                for part, folds in enumerate(dealt[at].T, 1) if apart else [(0, dealt[at])]:
                    out.append((*key, part, ids[own], y[own].tobytes(), x.tobytes(), folds.tobytes()))
                    held += x.nbytes
                if held > SEND_BYTES:
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names), schema=kinds, preserve_index=False)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=names), schema=kinds, preserve_index=False)

    kinds = pa.schema([(n, _ARROW[t]) for n, t in (f.strip().split(" ") for f in schema.split(", "))])
    ids = F.col("id").cast("string").alias("id")
    return rows.select("cohort", ids, F.col("y").cast("int").alias("y"), "x", "plans").mapInArrow(run, schema)


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16(), "binary": pa.binary(), "array<string>": pa.list_(pa.string())}


def schema_of_fit(rows: DataFrame, fit: Sequence[str]) -> str:
    """Key columns of a fit as they stand in ``plans``."""
    entry = {f.name: f.dataType.simpleString() for f in rows.schema["plans"].dataType.elementType.fields}
    return ", ".join(f"{c} {entry.get(c, 'string')}" for c in fit)


# Task-side helpers -----------------------------------------------------------------------------------


def _resamples(blocks: pd.DataFrame, states: pd.DataFrame):
    """Per inner resample: (its state, z, used positions, train mask, labels); rows in id order."""
    if blocks.empty or states.empty:
        return
    _, x, y, folds = unpack(blocks)
    for state in states.sort_values(["inner_repeat", "inner_fold"]).to_dict("records"):
        z, used = standardize(x, state)
        yield state, z, used, folds[:, 0 if state["part"] else state["inner_repeat"] - 1] != state["inner_fold"], y


def _state_task(fit: list[str], design: Design):
    names = [*fit, "inner_repeat", "inner_fold", *STATE]

    def run(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        _, x, _, folds = unpack(blocks)
        rules = blocks.iloc[0]
        if x.shape[1] != len(rules["transform"]):
            raise ValueError(f"{key[0]}: {x.shape[1]} values a sample for {len(rules['transform'])} features")
        out = []
        for j, fold in enumerate(folds.T, 1):
            for f, state in training_states(x, fold, rules, design.imputation, design.missing_rate):
                out.append((*key[:-1], int(key[-1] or j), f, *[state[c] for c in STATE]))
        return pd.DataFrame(out, columns=names)

    return run


def _grid_task(fit: list[str], design: Design):
    points = [(c, r) for c in design.en_c for r in design.en_l1]
    names = [*fit, "inner_repeat", "inner_fold", "C", "l1_ratio", "auc", "converged", "iterations", "coef"]

    def run(key: tuple, blocks: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        out = []
        for state, z, used, train, y in _resamples(blocks, states):
            z = fill_neighbors(z, train)
            beta, converged, sweeps = solver.fit_batch(
                z[train], y[train], [p[0] for p in points], [p[1] for p in points], False, EN_ITERATION_LIMIT
            )
            auc = solver.auc_of(z[~train], y[~train], beta)
            wide = np.full((len(points), len(state["used"])), np.nan)
            wide[:, used] = beta[:, 1:]
            for t, (c, r) in enumerate(points):
                out.append((*key[:-1], state["inner_repeat"], state["inner_fold"], float(c), float(r), auc[t], bool(converged[t]), int(sweeps[t]), wide[t]))
        return pd.DataFrame(out, columns=names)

    return run


def _size_task(fit: list[str], design: Design):
    names = [*fit, "inner_repeat", "inner_fold", "k", "C", "auc", "converged", "iterations"]

    def run(key: tuple, blocks: pd.DataFrame, states: pd.DataFrame) -> pd.DataFrame:
        out = []
        for state, z, used, train, y in _resamples(blocks, states):
            place = {int(u): i for i, u in enumerate(used)}
            order = list(state["order"])[: design.max_k]
            for first in range(0, len(order), SIZES):
                sizes = range(first + 1, min(first + SIZES, len(order)) + 1)
                auc, converged, sweeps = _sizes_of(z, y, train, [[place[j] for j in order[:k] if j in place] for k in sizes], design)
                for i, (k, c) in enumerate((k, c) for k in sizes for c in design.l2_c):
                    out.append((*key[:-1], state["inner_repeat"], state["inner_fold"], k, float(c), auc[i], bool(converged[i]), int(sweeps[i])))
        return pd.DataFrame(out, columns=names)

    return run


def _sizes_of(z, y, train, chosen: list[list[int]], design: Design):
    """(AUROC, converged, passes) of every (list of columns, C), in this order.

    Sizes share the passes over the rows, as the columns of one begin those of the next. Where neighbours fill
    the cells, they depend on the columns, and a size has its own passes.
    """
    if len(chosen) > 1 and np.isnan(z[:, chosen[-1]]).any():
        parts = [_sizes_of(z, y, train, [columns], design) for columns in chosen]
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
    # Nothing usable in a resample: a constant score, which has AUROC one half.
    some, tasks = chosen[-1], len(chosen) * len(design.l2_c)
    auc, converged, sweeps = np.full(tasks, 0.5), np.ones(tasks, bool), np.zeros(tasks, int)
    if some:
        sub = fill_neighbors(z[:, some], train)
        c, widths = np.tile(design.l2_c, len(chosen)), np.repeat([len(columns) for columns in chosen], len(design.l2_c))
        own = widths > 0
        active = np.arange(len(some)) < widths[own, None]
        beta, converged[own], sweeps[own] = solver.fit_batch(sub[train], y[train], c[own], np.zeros(own.sum()), True, L2_ITERATION_LIMIT, active)
        auc[own] = solver.auc_of(sub[~train], y[~train], beta)
    return auc, converged, sweeps


def _final_task(fit: list[str]):
    names = [*fit, "intercept", "coef", "converged", "iterations", "ids", "labels", "p"]

    def run(key: tuple, blocks: pd.DataFrame, spec: pd.DataFrame) -> pd.DataFrame:
        if blocks.empty or spec.empty:
            return pd.DataFrame(columns=names)
        (ids, x, y, roles), s = unpack(blocks), spec.iloc[0]
        train = roles[:, 0] == 1
        z, used = standardize(x, s)
        place = {int(u): i for i, u in enumerate(used)}
        chosen = [j for j in list(s["order"])[: int(s["k_selected"])] if j in place]
        z = fill_neighbors(z[:, [place[j] for j in chosen]], train)
        beta, converged, sweeps = solver.fit_batch(z[train], y[train], [s["l2_C"]], [0.0], True, L2_ITERATION_LIMIT)
        coef = np.full(x.shape[1], np.nan)
        coef[chosen] = beta[0, 1:]
        p = solver.probabilities(z[~train], beta)[:, 0]
        row = (*key[:-1], beta[0, 0], coef, bool(converged[0]), int(sweeps[0]), ids[~train], y[~train], p)
        return pd.DataFrame([row], columns=names)

    return run


def _width(df: DataFrame) -> int:
    """Partitions for groups that cost a solve each: enough that few of them share one."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8 * df.sparkSession.sparkContext.defaultParallelism)


def _cogroup(left: DataFrame, right: DataFrame, keys: Sequence[str], task, schema: str) -> DataFrame:
    """Both sides hash-partitioned by the same keys; an explicit count keeps small inputs spread out."""
    width = _width(left)
    fresh = right.select(*[F.col(c).alias(c) for c in right.columns])
    return (
        left.repartition(width, *keys).groupBy(*keys)
        .cogroup(fresh.repartition(width, *keys).groupBy(*keys))
        .applyInPandas(task, schema)
    )


# Stages ----------------------------------------------------------------------------------------------


def inner_plan(train: DataFrame, fit: Sequence[str], design: Design) -> DataFrame:
    """Inner resamples of every training set: (fit, id, y, inner_repeat, inner_fold)."""
    extra = [F.col(c) for c in fit if c != "cohort"]
    return stratified_folds(
        train, fit, "inner_repeat", "inner_fold", design.inner_splits, design.inner_repeats, "inner", *extra
    )


def sample_plans(inner: DataFrame, fit: Sequence[str]) -> DataFrame:
    """(cohort, id, y, plans): one row per sample with the fits it trains.

    An entry of ``plans`` names its fit and lists the sample's inner fold under every inner repeat.
    """
    others = [c for c in fit if c != "cohort"]
    dealt = F.array_sort(F.collect_list(F.struct("inner_repeat", F.col("inner_fold").cast("smallint").alias("fold"))))
    per_fit = inner.groupBy(*fit, "id", "y").agg(F.transform(dealt, lambda d: d["fold"]).alias("folds"))
    return per_fit.groupBy("cohort", "id", "y").agg(F.collect_list(F.struct(*others, "folds")).alias("plans"))


def inner_samples(train: DataFrame, fit: Sequence[str], design: Design) -> DataFrame:
    """``sample_plans`` of the inner plan of every training set, without a row for each inner repeat."""
    others = [c for c in fit if c != "cohort"]
    dealt = stratified_fold_lists(train, fit, design.inner_splits, design.inner_repeats, "inner", *others)
    if dealt is None:
        return sample_plans(inner_plan(train, fit, design), fit)
    return dealt.groupBy("cohort", "id", "y").agg(F.collect_list(F.struct(*others, "folds")).alias("plans"))


def by_fit(rows: DataFrame, fit: Sequence[str]) -> DataFrame:
    """Rows with ``plans`` spread over their fits: (fit, folds, other columns). No shuffle."""
    others = [c for c in fit if c != "cohort"]
    kept = [c for c in rows.columns if c not in ("cohort", "plans")]
    spread = rows.select("cohort", *kept, F.explode("plans").alias("_p"))
    return spread.select("cohort", *[F.col(f"_p.{c}").alias(c) for c in others], F.col("_p.folds").alias("folds"), *kept)


def by_resample(rows: DataFrame, fit: Sequence[str]) -> DataFrame:
    """Rows with ``plans`` spread over their inner resamples: (fit, inner_repeat, inner_fold, other columns). No shuffle."""
    spread = by_fit(rows, fit)
    kept = [c for c in spread.columns if c != "folds" and c not in fit]
    return spread.select(*fit, F.posexplode("folds").alias("_r", "_f"), *kept).select(
        *fit, (F.col("_r") + 1).alias("inner_repeat"), F.col("_f").cast("int").alias("inner_fold"), *kept
    )


def prepare(cells: DataFrame, inner: DataFrame, fit: Sequence[str], design: Design) -> tuple[DataFrame, DataFrame]:
    """(packed samples with their plans, packed inner states), both settled: two stages read them.

    ``inner`` is an inner plan or its ``sample_plans``. A sample is stored once, whatever the number of fits and inner
    repeats it serves. The states of a fit that a task can hold come from its blocks; of larger ones the statistics of all
    plans come from one pass over the cells, which find their sample's plans once and are spread over them inside the task.
    """
    keys = [*fit, "inner_repeat"]
    plans = inner if "plans" in inner.columns else sample_plans(inner, fit)
    rows = settle(plans.join(pack_rows(cells), ["cohort", "id"]).repartition(_width(cells)))
    large, apart = _shape(rows, fit)
    if large is None:
        return rows, settle(_states_of_blocks(rows, packed_rules(cells), fit, design, apart))
    planned = cells.select("cohort", "id", "feature", "value", *preprocess.RULE).join(
        rows.select("cohort", "id", "plans"), ["cohort", "id"]
    )
    splits = rows.select(F.max(F.array_max(F.transform("plans", lambda p: F.array_max(p["folds"]))))).first()[0]
    # A plan holds a feature at most as often as its cohort does.
    whole = in_one_task(cells, ["cohort", "feature"])
    state = preprocess.state_of_placed(
        by_resample(planned.drop("id"), fit), keys, "inner_fold", design.imputation, design.missing_rate, splits, whole
    )
    return rows, settle(pack_state(state, [*keys, "inner_fold"]))


def packed_rules(cells: DataFrame) -> DataFrame:
    """(cohort, rule arrays): the rules of the features in feature order."""
    listed = F.array_sort(F.collect_list(F.struct("feature", *preprocess.RULE))).alias("_r")
    packed = cells.select("cohort", "feature", *preprocess.RULE).distinct().groupBy("cohort").agg(listed)
    return packed.select("cohort", *[F.col(f"_r.{c}").alias(c) for c in preprocess.RULE])


def _states_of_blocks(rows: DataFrame, rules: DataFrame, fit: Sequence[str], design: Design, apart: bool) -> DataFrame:
    keys = [*fit, "part"]
    blocks = fit_blocks(rows, fit, apart).join(F.broadcast(settle(rules)), "cohort")
    kinds = "impute_value array<double>, mean array<double>, sd array<double>, used array<boolean>, transform array<string>"
    schema = f"{schema_of_fit(rows, fit)}, inner_repeat int, inner_fold int, {kinds}"
    return blocks.repartition(_width(rows), *keys).groupBy(*keys).applyInPandas(_state_task(list(fit), design), schema)


def _by_block(rows: DataFrame, states: DataFrame, fit: Sequence[str], apart: bool, task, schema: str) -> DataFrame:
    """The task of every fit that one holds, over its blocks and states."""
    told = states.withColumn("part", F.col("inner_repeat") if apart else F.lit(0))
    return _cogroup(fit_blocks(rows, fit, apart), told, [*fit, "part"], task, schema)


def _small(rows: DataFrame, large: DataFrame, fit: Sequence[str]) -> DataFrame:
    """Rows whose ``plans`` name none of the large fits."""
    others = [c for c in fit if c != "cohort"]
    named = large.groupBy("cohort").agg(F.collect_list(F.struct(*others) if others else F.lit(1)).alias("_large"))
    told = rows.join(F.broadcast(named), "cohort", "left")
    is_large = lambda p: F.array_contains("_large", F.struct(*[p[c].alias(c) for c in others]) if others else F.lit(1))
    kept = F.when(F.col("_large").isNull(), F.col("plans")).otherwise(F.filter("plans", lambda p: ~is_large(p)))
    return told.withColumn("plans", kept).drop("_large").select(rows.columns)


def tune_grid(rows: DataFrame, states: DataFrame, fit: Sequence[str], design: Design) -> DataFrame:
    """Fold AUROC, convergence and coefficients at every grid point of every inner resample."""
    keys = [*fit, "inner_repeat"]
    columns = "inner_fold int, C double, l1_ratio double, auc double, converged boolean, iterations int, coef array<double>"
    schema, task = schema_of(states, keys, columns), _grid_task(list(fit), design)
    large, apart = _shape(rows, fit)
    if large is None:
        return settle(_by_block(rows, states, fit, apart, task, schema))
    (_, big_rows), (states, big_states) = _split(by_resample(rows, fit), large, fit), _split(states, large, fit)
    points = [(float(c), float(r), None) for c in design.en_c for r in design.en_l1]
    big = distributed.resample_scores(big_rows, big_states, fit, points, False, EN_ITERATION_LIMIT, design.imputation == "knn")
    small = _by_block(_small(rows, large, fit), states, fit, apart, task, schema)
    return settle(small.unionByName(big.select(*small.columns)))


def rank(folds: DataFrame, best: DataFrame, order: DataFrame, fit: Sequence[str]) -> DataFrame:
    """Stability ranking from the coefficients at the chosen grid point (nothing is refitted)."""
    chosen = folds.join(best.select(*fit, "C", "l1_ratio"), [*fit, "C", "l1_ratio"], "left_semi")
    pairs = F.explode(F.arrays_zip("features", "coef")).alias("f")
    long = chosen.join(order, "cohort").select(*fit, "inner_repeat", "inner_fold", pairs).select(
        *fit,
        "inner_repeat",
        "inner_fold",
        F.col("f.features").alias("feature"),
        F.when(~F.isnan("f.coef"), F.col("f.coef")).alias("coef"),
    )
    totals = chosen.groupBy(*fit).agg(F.count(F.lit(1)).cast("double").alias("_total"))
    keyed = long.join(totals, list(fit))
    stable = selection.stability_table(keyed, [*fit, "_total"], F.first("_total")).drop("_total")
    return selection.rank_features(stable, fit)


def order_arrays(ranking: DataFrame, order: DataFrame, fit: Sequence[str], rank_col: str = "rank") -> DataFrame:
    """(fit, order): ranked feature positions in the packed arrays."""
    position = F.array_position("features", F.col("feature")).cast("int") - 1
    placed = ranking.join(order, "cohort").select(*fit, F.col(rank_col).alias("_r"), position.alias("_p"))
    listed = F.array_sort(F.collect_list(F.struct("_r", "_p")))
    return placed.groupBy(*fit).agg(F.transform(listed, lambda s: s["_p"]).alias("order"))


def size_scores(rows, states, orders, fit: Sequence[str], design: Design) -> DataFrame:
    """Fold AUROC for every k and C of every inner resample."""
    keys = [*fit, "inner_repeat"]
    columns = "inner_fold int, k int, C double, auc double, converged boolean, iterations int"
    schema, task = schema_of(states, keys, columns), _size_task(list(fit), design)
    states = states.join(orders, list(fit))
    large, apart = _shape(rows, fit)
    if large is None:
        return settle(_by_block(rows, states, fit, apart, task, schema))
    (_, big_rows), (states, big_states) = _split(by_resample(rows, fit), large, fit), _split(states, large, fit)
    points = [(float(c), 0.0, k) for k in range(1, design.max_k + 1) for c in design.l2_c]
    big = distributed.resample_scores(big_rows, big_states, fit, points, True, L2_ITERATION_LIMIT, design.imputation == "knn")
    ranked = orders.select(*fit, F.size("order").alias("_ranked"))
    big = big.join(ranked, list(fit)).where(F.col("k") <= F.col("_ranked"))
    small = _by_block(_small(rows, large, fit), states, fit, apart, task, schema)
    return settle(small.unionByName(big.select(*small.columns)))


def choose_size(scores: DataFrame, fit: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    curve = selection.best_c_per_k(selection.grid_scores(scores, fit, ["k", "C"]), fit)
    return curve, selection.one_standard_error(curve, fit)


def tune(cells: DataFrame, inner: DataFrame, fit: Sequence[str], design: Design) -> Tuned:
    """All three dependent stages for every fit."""
    order = feature_order(cells)
    rows, states = prepare(cells, inner, fit, design)
    folds = tune_grid(rows, states, fit, design)
    grid = selection.grid_scores(folds, fit, ["C", "l1_ratio"])
    best = selection.best_point(grid, fit, ["C", "l1_ratio"])
    ranking = settle(rank(folds, best, order, fit))
    scores = size_scores(rows, states, order_arrays(ranking, order, fit), fit, design)
    curve, choice = choose_size(scores, fit)
    return Tuned(grid, best, ranking, curve, settle(choice), folds)


def fit_final(
    cells: DataFrame,
    roles: DataFrame,
    state: DataFrame,
    orders: DataFrame,
    choice: DataFrame,
    fit: Sequence[str],
    design: Design,
) -> tuple[DataFrame, DataFrame]:
    """One L2 model per fit at its chosen features and C: (models, held-out predictions).

    Predictions are (fit, id, y_true, p). Where the design fails on non-convergence, a cohort with such a model
    has no predictions and the other cohorts go on; its models stay, see ``fit_status``. ``roles`` is (fit, id, y, is_train); ``state`` the training states of the fits.
    """
    others = [c for c in fit if c != "cohort"]
    entry = F.struct(*others, F.array(F.col("is_train").cast("smallint")).alias("folds"))
    plans = roles.groupBy("cohort", "id", "y").agg(F.collect_list(entry).alias("plans"))
    rows = plans.join(pack_rows(cells), ["cohort", "id"])
    spec = pack_state(state, fit).join(orders, list(fit)).join(choice.select(*fit, "k_selected", "l2_C"), list(fit))
    types = dict(roles.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in fit) + ", intercept double, coef array<double>, converged boolean, iterations int"
    held = "ids array<string>, labels array<int>, p array<double>"
    large = None
    if may_be_large(cells, roles, fit):
        joined = settle(roles.select(*fit, "id", "y", "is_train").join(pack_rows(cells), ["cohort", "id"]))
        large = large_fits(joined, fit)
    if large is not None:
        rows, (_, big_rows) = _small(rows, large, fit), _split(joined, large, fit)
        spec, big_spec = _split(settle(spec), large, fit)
        big_models, big_predictions = distributed.final_models(big_rows, big_spec, fit, L2_ITERATION_LIMIT, design.imputation == "knn")
    blocks = fit_blocks(rows.repartition(_width(rows)), fit, False)
    solved = _cogroup(blocks, spec.withColumn("part", F.lit(0)), [*fit, "part"], _final_task(list(fit)), f"{schema}, {held}")
    packed = settle(solved)
    zipped = F.explode(F.arrays_zip("ids", "labels", "p")).alias("r")
    predictions = packed.select(*fit, zipped).select(
        *fit, F.col("r.ids").alias("id"), F.col("r.labels").alias("y_true"), F.col("r.p").alias("p")
    )
    models = packed.drop("ids", "labels", "p")
    if large is not None:
        models, predictions = models.unionByName(big_models), predictions.unionByName(big_predictions)
    if design.fail_on_nonconvergence:
        failed = models.where(~F.col("converged")).select("cohort").distinct()
        predictions = predictions.join(failed, "cohort", "left_anti").select(predictions.columns)
    return models, predictions


def fit_status(models: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Final models per group, how many missed their iteration limit, and whether the group failed."""
    counted = models.groupBy(*groups).agg(F.count(F.lit(1)).alias("fits"), F.count_if(~F.col("converged")).alias("unconverged"))
    return counted.withColumn("status", F.when(F.col("unconverged") > 0, "failed").otherwise("ok"))


def model_coefficients(models: DataFrame, order: DataFrame, fit: Sequence[str]) -> DataFrame:
    """(fit, feature, coef) of the features the model used; the others are NULL or NaN in ``coef``."""
    pairs = F.explode(F.arrays_zip("features", "coef")).alias("f")
    return (
        models.join(order, "cohort")
        .select(*fit, pairs)
        .where(F.col("f.coef").isNotNull() & ~F.isnan("f.coef"))
        .select(*fit, F.col("f.features").alias("feature"), F.col("f.coef").alias("coef"))
    )


def convergence_warnings(folds: DataFrame, fit: Sequence[str], first: int = EN_ITERATIONS) -> DataFrame:
    """Rows for solves that needed more than the first iteration budget; each doubling is one refit."""
    doublings = F.ceil(F.log2(F.col("iterations") / F.lit(float(first))))
    return folds.where((F.col("iterations") > first) | ~F.col("converged")).select(
        *fit, "inner_repeat", "inner_fold", "iterations", "converged", F.greatest(doublings, F.lit(0)).alias("refits")
    )
