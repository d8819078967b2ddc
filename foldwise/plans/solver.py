"""Weighted penalised logistic regression for one training matrix and a batch of penalties.

Minimises  C * sum_i w_i * log(1 + exp(-+ eta_i)) + l1_ratio * |b|_1 + (1 - l1_ratio) / 2 * |b|_2^2
with balanced class weights. Proximal Newton: each step solves the penalised quadratic model by
coordinate descent, vectorised over the batch, and halves the step until the objective falls.
Shrunk coefficients are exact zeros. This is the small helper that runs inside Spark tasks.
"""

from __future__ import annotations

import numpy as np

STEP_TOL = 1e-8
#: A regression has converged when no entry of its smallest subgradient exceeds this share of 1 + C * rows.
OPTIMAL = 1e-9
# Values of all regressions and products of a block of rows: about 1 MB, near the processor.
BLOCK_VALUES = 125_000
# Scores held at a time while AUROCs are counted.
SCORE_VALUES = 125_000
# Scores up to which sixteen factors 1 + exp(s) may be multiplied.
MODERATE = 40.0


def sigmoid(eta: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(eta, -500, 500)))


def balanced(y: np.ndarray) -> np.ndarray:
    """n / (2 n_k) per row."""
    positive = max(y.sum(), 1)
    negative = max(len(y) - y.sum(), 1)
    return np.where(y == 1, len(y) / (2.0 * positive), len(y) / (2.0 * negative))


def subgradient(beta: np.ndarray, gradient: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """The smallest subgradient: that of a zero coefficient takes in what the penalty can balance."""
    at_zero = np.sign(gradient) * np.maximum(np.abs(gradient) - l1, 0.0)
    return np.where(beta == 0, at_zero, gradient + l1 * np.sign(beta))


def optimal(steepest: np.ndarray, c: np.ndarray, rows: float) -> np.ndarray:
    """Whether each regression has converged; the same in a task and over many."""
    return np.abs(steepest).max(1) <= OPTIMAL * (1.0 + np.asarray(c, float) * rows)


def sides(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """(columns x rows, the intercept first; (start, end, balanced weight) of either class in them).

    Rows stand by class, negative where the label is one: a regression's score of a column is how wrong it is there.
    """
    w, order = balanced(y), np.concatenate([np.flatnonzero(y == 1), np.flatnonzero(y != 1)])
    positive = int((y == 1).sum())
    a = np.empty((x.shape[1] + 1, len(x)))
    a[0] = 1.0
    for j in range(x.shape[1]):
        a[j + 1] = x[order, j]
    a[:, :positive] *= -1.0
    return a, [(at, end, float(w[order[at]])) for at, end in ((0, positive), (positive, len(x))) if end > at]


def losses(score: np.ndarray, moderate: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log(1 + exp(s)) summed over the rows of each regression, and its first and second derivative per row.

    ``score`` is regressions x rows and is written over. A sum of logarithms is the logarithm of a product: sixteen
    factors share one where the scores are so moderate that their product cannot overflow.
    """
    if moderate:
        tasks, rows = score.shape
        odds = np.exp(score, out=score)
        one = odds + 1.0
        whole = rows // 16
        loss = np.log(one[:, : 16 * whole].reshape(tasks, 16, whole).prod(1)).sum(1) + np.log(one[:, 16 * whole :]).sum(1)
        right = np.divide(1.0, one, out=one)
        wrong = np.multiply(odds, right, out=odds)
    else:
        small = np.exp(-np.abs(score))
        loss = (np.log1p(small) + np.maximum(score, 0.0)).sum(1)
        wrong, right = (np.where(score >= 0, p, q) / (1.0 + small) for p, q in ((1.0, small), (small, 1.0)))
    bend = np.multiply(right, wrong, out=right)
    return loss, wrong, np.maximum(bend, 1e-10, out=bend)


def evaluate(a, classes, b, reach):
    """Weighted loss (T), its gradient (T, 1 + p) and Hessian (T, 1 + p, 1 + p) of every regression, before C.

    The rows pass block by block, so that memory does not grow with rows x regressions. The products of columns
    are the same for all regressions: one matrix product gives all Hessians of a block. ``reach`` is the largest
    value of each column.
    """
    tasks, width = b.shape
    pairs = width * (width + 1) // 2
    loss, gradient, curvature = np.zeros(tasks), np.zeros((tasks, width)), np.zeros((tasks, pairs))
    size = max(64, BLOCK_VALUES // (3 * tasks + pairs) // 16 * 16)
    moderate = bool((np.abs(b) @ reach).max() <= MODERATE)
    products = np.empty((pairs, size))
    for start, end, weight in classes:
        for at in range(start, end, size):
            own = a[:, at : min(at + size, end)]
            its_loss, wrong, bend = losses(b @ own, moderate)
            at = 0
            for j in range(width):
                np.multiply(own[j], own[j:], out=products[at : at + width - j, : own.shape[1]])
                at += width - j
            loss += weight * its_loss
            gradient += weight * (wrong @ own.T)
            curvature += weight * (bend @ products[:, : own.shape[1]].T)
    upper = np.triu_indices(width)
    hessian = np.empty((tasks, width, width))
    hessian[:, upper[0], upper[1]] = hessian[:, upper[1], upper[0]] = curvature
    return loss, gradient, hessian


def fit_batch(x, y, c, l1_ratio, penalise_intercept, limit, active=None):
    """Coefficients (T, 1 + p) with the intercept first, converged flags and passes over the rows.

    ``active`` (T, p) tells which columns a regression uses, all of them without it; the others keep a zero.
    """
    c, l1_ratio = np.asarray(c, float), np.asarray(l1_ratio, float)
    x, y = np.asarray(x, float), np.asarray(y)
    tasks, width = len(c), x.shape[1] + 1
    a, classes = sides(x, y)
    reach = np.abs(a).max(1)
    l1 = np.repeat(l1_ratio[:, None], width, axis=1)
    l2 = np.repeat((1.0 - l1_ratio)[:, None], width, axis=1)
    l1[:, 0], l2[:, 0] = 0.0, 1.0 if penalise_intercept else 0.0
    live = np.ones((tasks, width), bool)
    if active is not None:
        live[:, 1:] = active
    l1, l2 = np.where(live, l1, 0.0), np.where(live, l2, 0.0)
    beta = np.zeros((tasks, width))
    passes = np.zeros(tasks, int)
    done, stalled = np.zeros(tasks, bool), np.zeros(tasks, bool)

    def at_point(b, t, known=None):
        loss, gradient, hessian = evaluate(a, classes, b, reach) if known is None else known
        value = c[t] * loss + (l1[t] * np.abs(b)).sum(1) + 0.5 * (l2[t] * b * b).sum(1)
        gradient, hessian = gradient * c[t, None], hessian * c[t, None, None]
        if active is not None:
            gradient, hessian = np.where(live[t], gradient, 0.0), np.where(live[t][:, :, None] & live[t][:, None, :], hessian, 0.0)
            hessian[:, range(width), range(width)] += ~live[t]
        return value, gradient + l2[t] * b, hessian

    # All start at zero, where the sums are the same for all.
    known = [np.repeat(part, tasks, axis=0) for part in evaluate(a, classes, beta[:1], reach)]
    value, slope, curve = at_point(beta, np.arange(tasks), known)
    while True:
        t = np.flatnonzero(~done & ~stalled & (passes < limit))
        if not len(t):
            return beta, done, passes
        passes[t] += 1
        done[t] = optimal(subgradient(beta[t], slope[t], l1[t]), c[t], len(x))
        t = t[~done[t]]
        if not len(t):
            continue
        b, gradient, hessian = beta[t], slope[t], curve[t]
        hessian[:, range(width), range(width)] += l2[t] + 1e-12
        if not l1[t].any():
            target = b - np.linalg.solve(hessian, gradient[:, :, None])[:, :, 0]
        else:
            target, _ = coordinate_descent(hessian, gradient, b, l1[t])
        step, trial = target - b, target
        # A point that is taken needs its derivatives next, so a trial has them with its value.
        worse, scale = np.arange(len(t)), 1.0
        for _ in range(31):
            now, its_slope, its_curve = at_point(trial, t[worse])
            before = value[t[worse]]
            falls = ~(now > before + 1e-10 * (1.0 + np.abs(before)))
            taken = t[worse[falls]]
            beta[taken], value[taken], slope[taken], curve[taken] = trial[falls], now[falls], its_slope[falls], its_curve[falls]
            worse = worse[~falls]
            if not len(worse):
                break
            scale /= 2.0
            trial = b[worse] + scale * step[worse]
        # No part of the step helps: the task stays where it is and does not count as converged.
        stalled[t[worse]] = True


def coordinate_descent(hessian, gradient, start, l1):
    """Minimise the penalised quadratic model of every task: (coefficients, sweeps).

    The model is solved to a thousandth of its first sweep; the Newton loop around it goes on until
    its own steps vanish, so the final accuracy does not depend on this.
    """
    b, slope = start.copy(), gradient.copy()
    columns = np.ascontiguousarray(hessian.transpose(2, 0, 1))
    tolerance = 0.0
    for sweep in range(1, 101):
        before = b.copy()
        for j, column in enumerate(columns):
            h, bound = column[:, j], l1[:, j]
            u = b[:, j] * h - slope[:, j]
            new = (u - np.minimum(np.maximum(u, -bound), bound)) / h
            slope += column * (new - b[:, j])[:, None]
            b[:, j] = new
        largest = np.abs(b - before).max()
        tolerance = tolerance or max(STEP_TOL / 10, 1e-3 * largest)
        if largest <= tolerance:
            break
    return b, sweep


def probabilities(x, beta):
    """Rows x tasks; as ``sigmoid``, in place."""
    p = np.column_stack([np.ones(len(x)), x]) @ beta.T
    np.negative(np.clip(p, -500, 500, out=p), out=p)
    np.exp(p, out=p)
    p += 1.0
    return np.divide(1.0, p, out=p)


def auc_columns(y, scores):
    """AUROC of every column of scores between 0 and 1, ties counted as one half; NaN when a class is absent."""
    positive, negative = int(y.sum()), int(len(y) - y.sum())
    if not positive or not negative:
        return np.full(scores.shape[1], np.nan)
    # Scores are compared at twelve digits: as whole numbers, whose last bit tells the class.
    keys = np.empty(scores.shape[::-1], np.int64)
    np.rint(scores.T * 1e12, out=keys, casting="unsafe")
    keys *= 2
    keys += np.asarray(y, np.int64)
    keys.sort(axis=1)
    out = np.empty(len(keys))
    for t, own in enumerate(keys):
        # The rank sum: a positive beats all that stand before it but the other positives.
        wins = float((np.flatnonzero(own & 1) + 1).sum() - positive * (positive + 1) // 2)
        value = own >> 1
        parted = value[1:] != value[:-1]
        if not parted.all():
            last = np.append(np.flatnonzero(parted), len(own) - 1)
            both = np.diff(last, prepend=-1)
            positives = np.diff(np.cumsum(own & 1)[last], prepend=0)
            wins -= (positives * (both - positives)).sum() / 2.0  # half of its equals, which stand before it
        out[t] = wins / (float(positive) * float(negative))
    return out


def auc_of(x, y, beta):
    """AUROC of every regression on these rows; the scores of a few regressions are held at a time."""
    some = max(1, SCORE_VALUES // max(1, len(x)))
    parts = [auc_columns(y, probabilities(x, beta[at : at + some])) for at in range(0, len(beta), some)]
    return np.concatenate(parts)
