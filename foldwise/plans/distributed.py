"""The same regressions for fits that are too large for one task.

No rows are gathered and nothing of a fit reaches the driver. Rows are packed where they lie into blocks of bounded
size and settled once. The state of every batch of regressions is a row of a table. One pass sends the open
trial points to the blocks, each partition adds up loss, gradient and diagonal curvature of its blocks, the sums are
reduced in two levels, and a task per batch takes one quasi-Newton step with them (``plans.quasi``). So a pass moves
vectors of the width of the matrix, whatever the number of rows. Convergence and the unit of the iteration limit, a
pass over the rows, are those of the task-side solver.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.operators.metrics import discrimination
from foldwise.operators.neighbors import knn_fill
from foldwise.plans import quasi, solver
from foldwise.plans.taskside import matrix, schema_of, standardize
from foldwise.session import settle

BLOCK_ROWS = 2048
#: Values of the blocks that a task holds open while it packs them.
OPEN_VALUES = 8_000_000
#: Bytes of trial points that one broadcast may hold; more take their passes in turns.
WAVE_BYTES = 256 << 20
REDUCERS = 32
ARRAYS = ["impute_value", "mean", "sd", "used", "transform"]


# Blocks ----------------------------------------------------------------------------------------------


def pack_blocks(rows: DataFrame, keys: Sequence[str], fold_col: str) -> DataFrame:
    """(keys, fold, ids, y, x): up to ``BLOCK_ROWS`` rows of one fold as bytes, settled."""
    keys = [*keys, fold_col]

    def block(key: tuple, parts: list) -> tuple:
        x = np.concatenate([p[0] for p in parts])
        y = np.concatenate([p[1] for p in parts])
        return (*key, [i for p in parts for i in p[2]], y.astype(np.int8).tobytes(), x.astype("<f8").tobytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, held, names = {}, {}, [*keys, "ids", "y", "x"]
        for batch in batches:
            out = []
            for key, part in batch.groupby(keys, sort=False):
                parts.setdefault(key, []).append((matrix(part), part["y"].to_numpy(int), part["id"].tolist()))
                held[key] = held.get(key, 0) + len(part)
                if held[key] >= BLOCK_ROWS:
                    out.append(block(key, parts.pop(key)))
                    held.pop(key)
            if sum(p[0].size for own in parts.values() for p in own) > OPEN_VALUES:
                out += [block(key, own) for key, own in parts.items()]
                parts, held = {}, {}
            if out:
                yield pd.DataFrame(out, columns=names)
        if parts:
            yield pd.DataFrame([block(key, own) for key, own in parts.items()], columns=names)

    schema = schema_of(rows, keys, "ids array<string>, y binary, x binary")
    return settle(rows.select(*keys, "id", F.col("y").cast("int").alias("y"), "x").mapInPandas(run, schema))


def _unpacked(row) -> tuple[np.ndarray, np.ndarray]:
    y = np.frombuffer(row["y"], np.int8).astype(float)
    return np.frombuffer(row["x"], "<f8").reshape(len(y), -1), y


class Preparation:
    """Turns packed rows into the design matrix of one training set."""

    def __init__(self, state: dict, columns: np.ndarray):
        self.state, self.columns = state, columns
        place = {int(u): i for i, u in enumerate(np.flatnonzero(np.asarray(state["used"], bool)))}
        self.place = [place[int(j)] for j in columns]

    def design(self, x: np.ndarray) -> np.ndarray:
        z, _ = standardize(x, self.state)
        return np.column_stack([np.ones(len(x)), z[:, self.place]])


# States ----------------------------------------------------------------------------------------------


def _pickled(*parts) -> bytes:
    return pickle.dumps(parts, protocol=5)


def start(rows: DataFrame, states: DataFrame, keys: Sequence[str], fold_col: str, describe: Callable, penalise_intercept: bool) -> DataFrame:
    """(keys, left_out, model, open): one row per training set with the batch of its regressions.

    ``describe(state)`` gives (columns, active, C, l1_ratio) of a row of ``states``.
    """
    keys = list(keys)
    fold = rows.groupBy(*keys, fold_col).agg(F.count(F.lit(1)).alias("_own"), F.sum("y").alias("_own_pos"))
    whole = fold.groupBy(*keys).agg(F.sum("_own").alias("_n"), F.sum("_own_pos").alias("_pos"))
    told = states.join(whole, keys).join(fold, [*keys, fold_col], "left").na.fill(0, ["_own", "_own_pos"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                n, positive = row["_n"] - row["_own"], row["_pos"] - row["_own_pos"]
                columns, active, c, l1 = describe(row)
                weights = (n / (2.0 * max(positive, 1)), n / (2.0 * max(n - positive, 1)))
                own = quasi.Batch(np.asarray(c, float), np.asarray(l1, float), active, float(n), penalise_intercept)
                model = _pickled(Preparation({k: row[k] for k in ARRAYS}, columns), weights, own)
                out.append((*[row[k] for k in keys], row[fold_col], model, True))
            yield pd.DataFrame(out, columns=[*keys, "left_out", "model", "open"])

    return told.mapInPandas(run, schema_of(states, keys, "left_out int, model binary, open boolean"))


def _trials(limit: int):
    @F.pandas_udf("binary")
    def light(models: pd.Series) -> pd.Series:
        """What a block needs of a model: preparation, weights, open regressions and their trial points."""
        out = []
        for data in models:
            preparation, weights, own = pickle.loads(data)
            t = np.flatnonzero(own.open(limit))
            out.append(_pickled(preparation, weights, t, own.trial[t]))
        return pd.Series(out)

    return light


def _partial_sums(keys: list[str], fold_col: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_dict("records"):
                x, y = _unpacked(row)
                for trial in row["trials"]:
                    if trial["left_out"] == row[fold_col]:
                        continue
                    preparation, weights, _, beta = pickle.loads(trial["trial"])
                    flat = quasi.sums(preparation.design(x), y, np.where(y == 1, *weights), beta)
                    key = (*[row[k] for k in keys], trial["left_out"])
                    total[key] = total[key] + flat if key in total else flat
        if total:
            yield pd.DataFrame([(*key, flat.ravel()) for key, flat in total.items()], columns=[*keys, "left_out", "sums"])

    return run


def _add(names: list[str]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key[: len(names)], np.sum(np.stack(rows["sums"]), axis=0))], columns=[*names, "sums"])

    return run


def _step(names: list[str], limit: int):
    def run(key: tuple, models: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        out = []
        for data in models["model"]:
            preparation, weights, own = pickle.loads(data)
            t, width = np.flatnonzero(own.open(limit)), own.beta.shape[1]
            flat = np.zeros((len(own.c), 1 + 2 * width))
            if len(sums):  # without training rows there is no loss
                flat[t] = np.sum(np.stack(sums["sums"]), axis=0).reshape(len(t), -1)
            own.advance(flat[:, 0], flat[:, 1 : 1 + width], flat[:, 1 + width :], limit)
            out.append((*key, _pickled(preparation, weights, own), bool(own.open(limit).any())))
        return pd.DataFrame(out, columns=[*names, "model", "open"])

    return run


def _with_trials(blocks: DataFrame, trials: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks beside the trial points of their key. The points are broadcast: their size was checked."""
    packed = trials.groupBy(*keys).agg(F.collect_list(F.struct("left_out", "trial")).alias("trials"))
    return blocks.join(F.broadcast(packed), keys)


def _waves(models: DataFrame, keys: list[str]) -> list:
    """Conditions that part the models so that each part may be broadcast; none without models."""
    size = models.agg(F.sum(F.octet_length("model"))).first()[0] or 0
    n = -(-size // WAVE_BYTES)
    if n == 1:
        return [F.lit(True)]
    return [F.pmod(F.xxhash64(*keys), F.lit(n)) == j for j in range(n)]


def solve(blocks: DataFrame, models: DataFrame, keys: Sequence[str], fold_col: str, limit: int) -> DataFrame:
    """Passes until every regression has converged, stalled or used up its passes."""
    keys = list(keys)
    names = [*keys, "left_out"]
    sums_schema = schema_of(models, names, "sums array<double>")
    step_schema = schema_of(models, names, "model binary, open boolean")
    models, closed, light = settle(models), None, _trials(limit)
    while True:
        finished = models.where(~F.col("open"))
        closed = finished if closed is None else closed.unionByName(finished)
        models = models.where("open")
        waves = _waves(models, keys)
        if not waves:
            return closed
        partial = None
        for wave in waves:
            trials = models.where(wave).select(*names, light("model").alias("trial"))
            part = _with_trials(blocks, trials, keys).mapInPandas(_partial_sums(keys, fold_col), sums_schema)
            partial = part if partial is None else partial.unionByName(part)
        salted = partial.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(REDUCERS)))
        reduced = salted.groupBy(*names, "_salt").applyInPandas(_add(names), sums_schema)
        models = settle(models.groupBy(*names).cogroup(reduced.groupBy(*names)).applyInPandas(_step(names, limit), step_schema))


def regressions(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, left_out, task, intercept, coef, converged, iterations); unused features are NaN in ``coef``."""
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                preparation, _, own = pickle.loads(row["model"])
                for t in range(len(own.c)):
                    coef = np.full(len(preparation.state["used"]), np.nan)
                    coef[preparation.columns[own.active[t]]] = own.beta[t, 1:][own.active[t]]
                    out.append((*[row[k] for k in keys], row["left_out"], t, own.beta[t, 0], coef, bool(own.done[t]), int(own.passes[t])))
            yield pd.DataFrame(out, columns=[*keys, "left_out", "task", "intercept", "coef", "converged", "iterations"])

    schema = schema_of(models, keys, "left_out int, task int, intercept double, coef array<double>, converged boolean, iterations int")
    return models.mapInPandas(run, schema)


def held_out_scores(blocks: DataFrame, models: DataFrame, keys: Sequence[str], fold_col: str) -> DataFrame:
    """(keys, left_out, task, id, y, p): every regression's score of its left-out rows."""
    keys = list(keys)

    @F.pandas_udf("binary")
    def final(data: pd.Series) -> pd.Series:
        solved = (pickle.loads(d) for d in data)
        return pd.Series([_pickled(preparation, own.beta) for preparation, _, own in solved])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                for trial in row["trials"]:
                    if trial["left_out"] == row[fold_col]:
                        x, y = _unpacked(row)
                        preparation, beta = pickle.loads(trial["trial"])
                        p = solver.sigmoid(preparation.design(x) @ beta.T)
                        for t in range(p.shape[1]):
                            out = pd.DataFrame({"left_out": trial["left_out"], "task": t, "id": row["ids"], "y": y.astype(int), "p": p[:, t]})
                            yield out.assign(**{k: row[k] for k in keys})[[*keys, "left_out", "task", "id", "y", "p"]]

    schema = schema_of(models, keys, "left_out int, task int, id string, y int, p double")
    parts = [
        _with_trials(blocks, models.where(w).select(*keys, "left_out", final("model").alias("trial")), keys).mapInPandas(run, schema)
        for w in _waves(models, keys)
    ]
    out = parts[0] if parts else rows_of_none(models, schema)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rows_of_none(like: DataFrame, schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame([], schema)


# Neighbour imputation --------------------------------------------------------------------------------


def fill(rows: DataFrame, states: DataFrame, keys: Sequence[str], fold_col: str, chosen: Sequence[int | None]) -> tuple[DataFrame, DataFrame]:
    """Rows and states of one training set each, standardised and with missing cells taken from neighbours.

    Distances depend on the training set and on the features in use, so there is a copy of the rows for each
    left-out fold and each of ``chosen`` (the first k of ``order``, or all used features for None). The copies are
    named by two more keys, ``_left`` and ``_k`` (0: all).
    """
    keys = list(keys)
    more = [*keys, "_left", "_k"]
    sizes = F.explode(F.array(*[F.lit(k or 0) for k in chosen]))
    ranked = "order" in states.columns
    told = states.select(*keys, F.col(fold_col).alias("_left"), *ARRAYS, *(["order"] if ranked else [])).withColumn("_k", sizes)
    first = F.array_sort(F.slice("order", F.lit(1), F.col("_k"))) if ranked else F.array().cast("array<int>")
    position = F.sequence(F.lit(0), F.size("used") - 1)
    here = F.filter(position, lambda j: F.get("used", j) & ((F.col("_k") == 0) | F.array_contains(first, j)))
    told = settle(told.withColumn("_columns", here))
    joined = rows.select(*keys, fold_col, "id", "y", "x").join(told, keys)

    def value(j):
        cell = F.coalesce(F.get("x", j), F.get("impute_value", j))
        cell = F.when(F.get("transform", j) == "log1p", F.log1p(cell)).otherwise(cell)
        return (cell - F.get("mean", j)) / F.get("sd", j)

    z = F.transform("_columns", lambda j: F.struct(j.alias("feature"), value(j).alias("z")))
    cells = settle(joined.select(*more, fold_col, "id", "y", F.size("used").alias("_width"), z.alias("_z")))
    long = cells.where(F.size("_z") > 0).select(*more, "id", (F.col(fold_col) != F.col("_left")).alias("is_train"), F.explode("_z").alias("c"))
    found = knn_fill(long.select(*more, "id", F.col("c.feature").alias("feature"), F.col("c.z").alias("z"), "is_train"), more)
    patch = found.groupBy(*more, "id").agg(F.map_from_entries(F.collect_list(F.struct("feature", "z"))).alias("_new"))
    place = lambda j: F.get(F.filter("_z", lambda c: c["feature"] == j), F.lit(0))["z"]
    whole = F.transform(F.sequence(F.lit(0), F.col("_width") - 1), lambda j: F.coalesce(place(j), F.try_element_at(F.col("_new"), j)))
    filled = cells.join(patch, [*more, "id"], "left").select(*more, fold_col, "id", "y", whole.alias("x"))
    same = lambda v, kind: F.transform("used", lambda _: F.lit(v).cast(kind))
    used = F.transform(position, lambda j: F.array_contains("_columns", j))
    plain = told.select(
        *more, F.col("_left").alias(fold_col), same(0.0, "double").alias("impute_value"), same(0.0, "double").alias("mean"), same(1.0, "double").alias("sd"),
        used.alias("used"), same("identity", "string").alias("transform"), *(["order"] if ranked else []),
    )
    return settle(filled), plain


# Stages ----------------------------------------------------------------------------------------------


def _ranked(row, order) -> tuple[np.ndarray, np.ndarray]:
    """(usable columns, their ranks) of an order."""
    place = {int(j): r for r, j in enumerate(order)}
    columns = np.array([j for j in np.flatnonzero(np.asarray(row["used"], bool)) if int(j) in place], int)
    return columns, np.array([place[int(j)] for j in columns], int)


def resample_scores(rows, states, fit: Sequence[str], points, penalise_intercept: bool, limit: int, by_neighbours: bool = False) -> DataFrame:
    """AUROC, convergence and coefficients of every point of every inner resample.

    ``points`` are (C, l1_ratio, k or None); with k only the first k positions of ``order`` are used.
    """
    keys, names = [*fit, "inner_repeat"], [*fit, "inner_repeat"]
    sizes = list(dict.fromkeys(p[2] for p in points))
    if by_neighbours:
        rows, states = fill(rows, states, keys, "inner_fold", sizes)
        keys = [*keys, "_left", "_k"]

    def describe(row):
        own = [p for p in points if not by_neighbours or (p[2] or 0) == row["_k"]]
        c, l1 = [p[0] for p in own], [p[1] for p in own]
        if points[0][2] is None:
            columns = np.flatnonzero(np.asarray(row["used"], bool))
            return columns, np.ones((len(own), len(columns)), bool), c, l1
        columns, ranks = _ranked(row, row["order"])
        return columns, np.array([ranks < p[2] for p in own]).reshape(len(own), len(columns)), c, l1

    blocks = pack_blocks(rows, keys, "inner_fold")
    models = start(rows, states, keys, "inner_fold", describe, penalise_intercept)
    models = settle(solve(blocks, models, keys, "inner_fold", limit))
    scores = held_out_scores(blocks, models, keys, "inner_fold")
    auc = discrimination(scores, [*keys, "left_out", "task"], "p", "y")
    found = regressions(models, keys).join(auc.select(*keys, "left_out", "task", F.col("roc_auc").alias("auc")), [*keys, "left_out", "task"])
    told = [(j, (p[2] or 0) if by_neighbours else 0, float(p[0]), float(p[1]), p[2]) for j, p in _numbered(points, by_neighbours)]
    grid = rows.sparkSession.createDataFrame(told, "task int, _k int, C double, l1_ratio double, k int")
    on = ["task", "_k"] if by_neighbours else ["task"]
    found = found.join(grid if by_neighbours else grid.drop("_k"), on)
    return settle(found.select(*names, F.col("left_out").alias("inner_fold"), "task", "C", "l1_ratio", "k", "converged", "iterations", "coef", "auc"))


def _numbered(points, apart: bool) -> list[tuple[int, tuple]]:
    """Points with their place in the batch they are solved in: one batch, or one for each k."""
    seen: dict = {}
    out = []
    for p in points:
        j = seen.get(p[2] if apart else None, 0)
        seen[p[2] if apart else None] = j + 1
        out.append((j, p))
    return out


def final_models(rows, spec, fit: Sequence[str], limit: int, by_neighbours: bool = False) -> tuple[DataFrame, DataFrame]:
    """(models, held-out predictions) of one L2 regression per fit; held-out rows are side 0."""
    keys = list(fit)
    rows = rows.withColumn("side", F.col("is_train").cast("int"))
    spec = spec.withColumn("side", F.lit(0))
    if by_neighbours:
        # The features of a fit are its first k_selected ones: they are put in front, alone.
        chosen = spec.withColumn("order", F.expr("slice(`order`, 1, k_selected)"))
        chosen = chosen.withColumn("used", F.expr("transform(used, (u, j) -> u and array_contains(`order`, j))"))
        told = chosen.select(*fit, "k_selected", "l2_C")
        rows, states = fill(rows, chosen, keys, "side", [None])
        keys = [*keys, "_left", "_k"]
        spec = states.join(told, list(fit))

    def describe(row):
        columns, ranks = _ranked(row, row["order"])
        return columns, (ranks < row["k_selected"])[None, :], [row["l2_C"]], [0.0]

    blocks = pack_blocks(rows, keys, "side")
    models = settle(solve(blocks, start(rows, spec, keys, "side", describe, True), keys, "side", limit))
    scores = held_out_scores(blocks, models, keys, "side")
    predictions = settle(scores.select(*fit, "id", F.col("y").alias("y_true"), "p"))
    return regressions(models, keys).select(*fit, "intercept", "coef", "converged", "iterations"), predictions
