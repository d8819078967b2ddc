"""Small helpers that run inside tasks on the packed rows of one fit."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from foldwise.operators.neighbors import DISTANCE_DIGITS
from foldwise.operators.preprocess import LOG10_2
from foldwise.plans.design import NEIGHBORS

# Pairs of rows whose distances a task holds at a time.
PAIRS = 250_000
# Donors of which the nearest one alone tells how far the nearest few may be.
GROUP = 16


def matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.array(rows["x"].tolist(), dtype=float)


def unpack(blocks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, x, y, folds) of the blocks of one fit, rows in id order; see ``fitting.fit_blocks``."""
    ids = np.concatenate([np.asarray(i, object) for i in blocks["ids"]])
    place = np.empty(len(ids), int)
    place[np.argsort(ids, kind="stable")] = np.arange(len(ids))

    def gathered(column: str, kind: str) -> np.ndarray:
        out, at = None, 0
        for n, data in zip(map(len, blocks["ids"]), blocks[column], strict=True):
            part = np.frombuffer(data, kind).reshape(n, -1)
            out = np.empty((len(ids), part.shape[1]), kind) if out is None else out
            out[place[at : at + n]] = part
            at += n
        return out

    ordered = np.empty(len(ids), object)
    ordered[place] = ids
    return ordered, gathered("x", "<f8"), gathered("y", "i1")[:, 0].astype(int), gathered("folds", "<i2")


def training_states(x: np.ndarray, fold: np.ndarray, rules, imputation: str, missing_rate: float):
    """(left-out fold, state) of every training set of one plan, as ``preprocess.state_of_placed`` defines it.

    ``rules`` has the arrays transform, half_minimum_allowed and input_scale in feature order.
    """
    logged = np.array([t == "log1p" for t in rules["transform"]])
    allowed = np.asarray(rules["half_minimum_allowed"], bool)
    log_scale = np.array([s == "log10" for s in rules["input_scale"]])
    seen = ~np.isnan(x)
    with np.errstate(all="ignore"):
        transformed = lambda v: np.where(logged, np.log1p(np.where(v >= 0, v, np.nan)), v)
        least = lambda v: np.where(np.isnan(m := np.fmin.reduce(v, axis=0, initial=np.inf)) | (m == np.inf), np.nan, m)
        parts = {}
        for f in np.unique(fold):
            v, has = x[fold == f], seen[fold == f]
            t = transformed(v)
            known = ~np.isnan(t)
            n_t = known.sum(0)
            mean = np.where(known, t, 0.0).sum(0) / n_t
            spread = np.where(known, t - mean, 0.0)
            parts[int(f)] = {
                "n": np.full(x.shape[1], len(v)), "n_obs": has.sum(0), "min_pos": least(np.where(v > 0, v, np.nan)), "min_obs": least(v),
                "min_t": least(t), "max_t": -least(-t), "mean_t": mean, "m2": np.where(n_t > 0, (spread * spread).sum(0), np.nan),
            }
        for f in parts:
            others = {name: np.stack([p[name] for g, p in parts.items() if g != f]) for name in parts[f]}
            n, n_obs = others["n"].sum(0), others["n_obs"].sum(0)
            mean_obs = np.nan_to_num(others["n_obs"] * others["mean_t"]).sum(0) / n_obs
            m2 = np.nan_to_num(others["m2"] + others["n_obs"] * (others["mean_t"] - mean_obs) ** 2).sum(0)
            min_t, max_t = least(others["min_t"]), -least(-others["max_t"])
            n_mis = n - n_obs
            kept = (n_mis / n <= missing_rate) & (n_obs > 0)
            if imputation == "half_minimum":
                impute = np.where(log_scale, least(others["min_obs"]) - LOG10_2, least(others["min_pos"]) / 2)
                for j in np.flatnonzero(~allowed):
                    values = x[(fold != f) & seen[:, j], j]
                    impute[j] = np.median(values) if len(values) else np.nan
                impute = np.where(kept, impute, np.nan)
                filled = transformed(impute)
                some = n_mis > 0
                mean = np.where(some, (n_obs * mean_obs + n_mis * filled) / n, mean_obs)
                m2 = m2 + np.where(some, n_obs * (mean_obs - mean) ** 2 + n_mis * (filled - mean) ** 2, 0.0)
                sd = np.sqrt(m2 / n)
                varies = np.fmin(min_t, np.where(some, filled, np.nan)) < np.fmax(max_t, np.where(some, filled, np.nan))
            else:
                impute, mean, sd, varies = np.full(x.shape[1], np.nan), mean_obs, np.sqrt(m2 / n_obs), min_t < max_t
            number = lambda v: [None if np.isnan(e) else float(e) for e in np.where(kept, v, np.nan)]  # noqa: E731, B023
            yield f, {"impute_value": number(impute), "mean": number(mean), "sd": number(sd), "used": (kept & varies & (sd > 0)).tolist(), "transform": list(rules["transform"])}


def standardize(x: np.ndarray, state) -> tuple[np.ndarray, np.ndarray]:
    """(z over the used features, their positions); missing values stay NaN only without impute values."""
    used = np.flatnonzero(np.asarray(state["used"], bool))
    number = lambda name: np.array([np.nan if v is None else v for v in state[name]], float)[used]
    # In place: a task holds one copy of its matrix at a time besides the rows.
    z = x[:, used]
    np.copyto(z, number("impute_value"), where=np.isnan(z))
    for j in np.flatnonzero([t == "log1p" for t in np.asarray(state["transform"], object)[used]]):
        z[:, j] = np.log1p(z[:, j])
    z -= number("mean")
    z /= number("sd")
    return z, used


def fill_neighbors(z: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Fill NaN with the mean of the nearest training rows; 0 (the training mean) without a donor.

    Rows with the same cells missing are searched together, equal ones once. A matrix product gives their distances to
    the donors but for rounding; only donors that may be among the nearest are measured as ``neighbors.nan_distances`` does.
    """
    missing = np.isnan(z)
    if not missing.any():
        return z
    out, donors = z.copy(), z[train]
    seen = ~np.isnan(donors)
    holes = np.flatnonzero(missing.any(axis=1))
    patterns, kind = np.unique(missing[holes], axis=0, return_inverse=True)
    for p, pattern in enumerate(patterns):
        shared = np.flatnonzero(~pattern)
        rows = holes[kind.ravel() == p]
        queries, place = np.unique(z[np.ix_(rows, shared)], axis=0, return_inverse=True)
        for j in np.flatnonzero(pattern):
            pool = np.flatnonzero(seen[:, j] & seen[:, shared].any(axis=1))
            filled = _nearest_means(queries, donors[np.ix_(pool, shared)], donors[pool, j], z.shape[1])
            out[rows, j] = filled[place.ravel()]
    return out


def _nearest_means(queries: np.ndarray, donors: np.ndarray, values: np.ndarray, features: int) -> np.ndarray:
    """Mean value of the NEIGHBORS donors nearest to each query, in the order of rounded distance and place; 0 without any."""
    if not len(values) or not queries.shape[1]:
        return np.zeros(len(queries))
    k, seen = min(NEIGHBORS, len(values)), ~np.isnan(donors)
    known = np.where(seen, donors, 0.0)
    scale = features / seen.sum(1)
    right = np.vstack([seen.T, -2.0 * known.T, (known * known).sum(1)]) * scale
    # Both the rounding of the product and that of the distances stay far within this.
    size = (np.abs(queries).max() + np.abs(known).max()) ** 2 * features * features
    slack = 1e-8 + 1e-12 * size
    out = np.empty(len(queries))
    for at in range(0, len(queries), step := max(1, PAIRS // len(values))):
        q = queries[at : at + step]
        near = np.hstack([q * q, q, np.ones((len(q), 1))]) @ right
        # The k-th least of the least distances of some groups of donors is one that k donors keep to.
        whole = len(values) // GROUP
        least = near[:, : GROUP * whole].reshape(len(q), GROUP, whole).min(1) if whole >= k else near
        last = np.partition(least, k - 1, axis=1)[:, k - 1]
        row, donor = np.divmod(np.flatnonzero(near <= last[:, None] + slack), len(values))
        total, common = np.zeros(len(row)), np.zeros(len(row))
        for c in range(q.shape[1]):
            difference = q[row, c] - donors[donor, c]
            total += np.where(seen[donor, c], difference * difference, 0.0)
            common += seen[donor, c]
        order = np.lexsort((donor, np.round(total * features / common, DISTANCE_DIGITS), row))
        first = np.searchsorted(row, np.arange(len(q)))
        out[at : at + step] = values[donor[order]][first[:, None] + np.arange(k)].mean(axis=1)
    return out


def schema_of(df: DataFrame, keys: Sequence[str], rest: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([*[f"{k} {types[k]}" for k in keys], rest])
