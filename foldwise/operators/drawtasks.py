"""Bootstrap draws of units that fit a task: weights and metrics of a chunk of draws per task.

The draws are those of ``resample.bootstrap_weights`` (same hashes, same row numbers), so a unit has
the same resamples whichever way it is computed.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd

from foldwise.operators.calibration import BOUND_TOL, CONSTANT_LOGIT, INTERCEPT_BOUND, LOSS_TOL, MAX_NEWTON, NEWTON_TOL, SLOPE_BOUND, STILL

# Weights (draws x rows) that a task holds at a time, and numbers hashed at a time.
BATCH_VALUES = 1_000_000
HASHED = 100_000


def draw_weights(numbers, labels, purpose: str, strata, chunks) -> np.ndarray:
    """(draws, rows): how often each row is drawn. Each 16-byte hash serves two draws."""
    weights = np.zeros((2 * len(chunks), len(numbers)), np.int32)
    for s in strata:
        rows = np.arange(len(numbers)) if s is None else np.flatnonzero(labels == s)
        n = len(rows)
        if not n:
            continue
        by_number = np.empty(n, int)
        by_number[numbers[rows] - 1] = rows
        prefix = f"{purpose}|" if s is None else f"{purpose}|{s}|"
        for i, chunk in enumerate(chunks):
            picks = np.empty((n, 2), np.int64)
            for first in range(0, n, HASHED):
                last = min(first + HASHED, n)
                # The first 60 bits of each half, as 15 hex digits are elsewhere.
                picks[first:last] = (_digests(f"{prefix}{chunk}|", first + 1, last + 1) >> 4).astype(np.int64) % n
            for part in range(2):
                weights[2 * i + part] += np.bincount(by_number[picks[:, part]], minlength=len(numbers)).astype(np.int32)
    return weights


def _digests(prefix: str, first: int, last: int) -> np.ndarray:
    """(rows, 2): both halves of the hash of the prefix and every number from ``first`` on, below ``last``."""
    start, digests = hashlib.md5(prefix.encode()), []
    for j in range(first, last):
        h = start.copy()
        h.update(b"%d" % j)
        digests.append(h.digest())
    return np.frombuffer(b"".join(digests), ">u8").reshape(last - first, 2)


def by_score(score):
    """(distinct scores, the start of each in the order of the rows by score, that order)."""
    order = np.argsort(score, kind="stable")
    return *np.unique(score[order], return_index=True), order


def class_weights_by_score(places, labels, weights):
    """(distinct scores, positives, negatives) with the counts as (draws, distinct scores)."""
    values, starts, order = places
    ordered, y = weights[:, order], labels[order]
    positive = np.add.reduceat(ordered * y, starts, axis=1).astype(float)
    return values, positive, np.add.reduceat(ordered, starts, axis=1) - positive


def auc(positive, negative):
    below = np.cumsum(negative, axis=1) - negative
    total = positive.sum(1) * negative.sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(total > 0, (positive * (below + negative / 2)).sum(1) / total, np.nan)


def summary(values, positive, negative) -> dict[str, np.ndarray]:
    """The seven summary metrics of every draw; NaN where a draw has a single class."""
    p, n = positive.sum(1), negative.sum(1)
    tp = np.cumsum(positive[:, ::-1], axis=1)[:, ::-1]
    flagged = tp + np.cumsum(negative[:, ::-1], axis=1)[:, ::-1]
    total = p + n
    with np.errstate(invalid="ignore", divide="ignore"):
        precision = np.where(flagged > 0, tp / flagged, 0.0)
        ap = np.where((p > 0) & (n > 0), (positive * precision).sum(1) / p, np.nan)
    intercept, slope = recalibrate(np.log(values / (1 - values)), positive, negative)
    return {
        "positive": p,
        "negative": n,
        "roc_auc": auc(positive, negative),
        "average_precision": ap,
        "brier": (positive @ (1 - values) ** 2 + negative @ values**2) / total,
        "event_rate": p / total,
        "mean_predicted_probability": (positive + negative) @ values / total,
        "calibration_intercept": intercept,
        "calibration_slope": slope,
    }


def recalibrate(z, positive, negative):
    """Newton for the intercept and for intercept + slope of every draw; NaN when not identifiable.

    Limits, bounds and tolerances are those of ``calibration.recalibration``.
    """
    m, draws = positive + negative, len(positive)
    both = (positive.sum(1) > 0) & (negative.sum(1) > 0)
    low = lambda c: np.where(c > 0, z, np.inf).min(1)
    high = lambda c: np.where(c > 0, z, -np.inf).max(1)
    separated = (high(negative) <= low(positive)) | (high(positive) <= low(negative))
    free = both & (high(m) - low(m) > CONSTANT_LOGIT) & ~separated
    with np.errstate(divide="ignore", invalid="ignore"):
        start = np.where(both, np.log(positive.sum(1) / negative.sum(1)), 0.0)
    ones = np.ones(len(z))
    shift, step0 = _newton(ones[None], z, positive, m, np.zeros((draws, 1)), both)
    line, step = _newton(np.stack([ones, z]), 0.0, positive, m, np.column_stack([start, np.zeros(draws)]), free)
    inside = free & (np.maximum(step0, step) <= STILL) & (np.abs(line) < SLOPE_BOUND - BOUND_TOL).all(1)
    return np.where(both & (np.abs(shift[:, 0]) < INTERCEPT_BOUND), shift[:, 0], np.nan), np.where(inside, line[:, 1], np.nan)


def _newton(design, offset, positive, m, beta, wanted):
    """Logistic fits of every draw (rows of ``beta``) with step halving: (beta, last change)."""
    accepted, loss, moving = beta.copy(), np.full(len(beta), np.inf), wanted.copy()
    last = np.zeros(len(beta))
    for _ in range(MAX_NEWTON):
        t = np.flatnonzero(moving)
        if not len(t):
            break
        eta, counts, hits = beta[t] @ design + offset, m[t], positive[t]
        q = _expit(eta)
        now = (counts * np.logaddexp(0.0, eta) - hits * eta).sum(1)
        worse = now > loss[t] + LOSS_TOL * (1 + np.abs(now))
        gradient = (counts * q - hits) @ design.T
        curve = counts * q * (1 - q)
        hessian = np.stack([np.stack([curve @ (a * b) for b in design], -1) for a in design], -2)
        flat = np.abs(np.linalg.det(hessian)) < 1e-280
        hessian[flat] = np.eye(len(design))
        step = np.where(flat[:, None], 0.0, np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0])
        target = np.where(worse[:, None], (beta[t] + accepted[t]) / 2, beta[t] - step)
        accepted[t] = np.where(worse[:, None], accepted[t], beta[t])
        loss[t] = np.where(worse, loss[t], now)
        change = np.abs(target - beta[t]).max(1)
        beta[t] = target
        last[t] = change
        moving[t] = (change >= NEWTON_TOL) & ((np.abs(accepted[t]) <= 2 * SLOPE_BOUND).all(1) | worse)
    return beta, last


def _expit(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -700, 700)))


def _batches(key: tuple, rows: int, per_task: int, draws: int):
    """The chunks of one task, as many at a time as keep their weights within BATCH_VALUES."""
    first = int(key[-1]) * per_task
    last, some = min(first + per_task, (draws + 1) // 2), max(1, BATCH_VALUES // (2 * max(1, rows)))
    return (range(at, min(at + some, last)) for at in range(first, last, some))


def auc_task(groups, scores, purpose, per_task, draws):
    """Task of one (unit, chunk of draws): AUROC of every score per draw."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y, numbers = rows["y_true"].to_numpy(int), rows["_rn"].to_numpy(int)
        places, parts = {name: by_score(rows[name].to_numpy(float)) for name in scores}, []
        for chunks in _batches(key, len(y), per_task, draws):
            weights = draw_weights(numbers, y, purpose, (0, 1), chunks)
            out = {g: key[i] for i, g in enumerate(groups)} | {"draw": np.arange(len(weights)) + 2 * chunks[0] + 1}
            for name in scores:
                _, positive, negative = class_weights_by_score(places[name], y, weights)
                out[f"auc_{name}"] = auc(positive, negative)
            parts.append(pd.DataFrame(out))
        return pd.concat(parts).query("draw <= @draws")

    return run


def summary_task(groups, score, purpose, per_task, draws):
    """Task of one (unit, chunk of draws): the seven summary metrics per draw."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y, numbers = rows["y_true"].to_numpy(int), rows["_rn"].to_numpy(int)
        places, parts = by_score(rows[score].to_numpy(float)), []
        for chunks in _batches(key, len(y), per_task, draws):
            counted = class_weights_by_score(places, y, draw_weights(numbers, y, purpose, (None,), chunks))
            out = {g: key[i] for i, g in enumerate(groups)} | {"draw": np.arange(2 * len(chunks)) + 2 * chunks[0] + 1}
            parts.append(pd.DataFrame(out | summary(*counted)))
        return pd.concat(parts).query("draw <= @draws")

    return run
