"""One step of an orthant-wise limited-memory quasi-Newton method for a batch of regressions.

The method needs only sums over the rows at a trial point: loss, gradient and the diagonal of the curvature, all
vectors. Whoever holds the rows adds them up; ``advance`` takes the sums, accepts or shortens the step and proposes
the next trial point. Everything is vectorised over the regressions of one training matrix.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from foldwise.plans import solver

MEMORY = 12
ARMIJO = 1e-4
LEAST_STEP = 1e-9
#: Rounding of a sum of losses, as a share of it.
ROUNDING = 1e-13


@dataclass
class Batch:
    """State of a batch: all arrays have one row per regression; the intercept is column 0."""

    c: np.ndarray
    l1: np.ndarray
    active: np.ndarray
    rows: float  # training rows, which is also the sum of the balanced weights
    penalise_intercept: bool
    beta: np.ndarray = field(init=False)
    trial: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)
    gradient: np.ndarray = field(init=False)
    curve: np.ndarray = field(init=False)
    direction: np.ndarray = field(init=False)
    scale: np.ndarray = field(init=False)
    steps: list = field(default_factory=list)  # (s, y, usable), the latest last
    passes: np.ndarray = field(init=False)
    done: np.ndarray = field(init=False)
    stalled: np.ndarray = field(init=False)

    def __post_init__(self):
        tasks, width = len(self.c), self.active.shape[1] + 1
        self.live = np.column_stack([np.ones(tasks, bool), self.active])
        self.bound = np.where(self.live, np.repeat(np.asarray(self.l1, float)[:, None], width, axis=1), 0.0)
        self.ridge = np.repeat(1.0 - np.asarray(self.l1, float)[:, None], width, axis=1)
        self.bound[:, 0], self.ridge[:, 0] = 0.0, 1.0 if self.penalise_intercept else 0.0
        for name in ("beta", "trial", "gradient", "direction"):
            setattr(self, name, np.zeros((tasks, width)))
        self.curve = np.ones((tasks, width))
        self.value, self.scale = np.full(tasks, np.inf), np.ones(tasks)
        self.passes = np.zeros(tasks, int)
        self.done, self.stalled = np.zeros(tasks, bool), np.zeros(tasks, bool)

    def open(self, limit: int) -> np.ndarray:
        return ~self.done & ~self.stalled & (self.passes < limit)

    def advance(self, loss: np.ndarray, gradient: np.ndarray, curve: np.ndarray, limit: int) -> None:
        """Take in the sums at the trial points of the open regressions (rows of others are not read)."""
        t = np.flatnonzero(self.open(limit))
        if not len(t):
            return
        b, c = self.trial[t], np.asarray(self.c, float)[t][:, None]
        value = c[:, 0] * loss[t] + (self.bound[t] * np.abs(b)).sum(1) + 0.5 * (self.ridge[t] * b * b).sum(1)
        slope = np.where(self.live[t], c * gradient[t] + self.ridge[t] * b, 0.0)
        self.passes[t] += 1
        moved = b - self.beta[t]
        promise = (solver.subgradient(self.beta[t], self.gradient[t], self.bound[t]) * moved).sum(1)
        good = value <= self.value[t] + ARMIJO * np.minimum(promise, 0) + ROUNDING * (1 + np.abs(value)) * 10
        self._shorten(t[~good])
        self._accept(t[good], b[good], value[good], slope[good], (c * curve[t] + self.ridge[t])[good], moved[good])

    def _shorten(self, t: np.ndarray) -> None:
        self.scale[t] /= 2
        self.stalled[t[self.scale[t] < LEAST_STEP]] = True
        self._propose(t)

    def _accept(self, t, b, value, slope, curve, moved) -> None:
        if not len(t):
            return
        s, y = np.zeros_like(self.beta), np.zeros_like(self.beta)
        s[t], y[t] = moved, slope - self.gradient[t]
        usable = np.zeros(len(self.beta), bool)
        usable[t] = np.isfinite(self.value[t]) & ((s[t] * y[t]).sum(1) > 1e-14 * (y[t] * y[t]).sum(1) / np.maximum(curve.max(1), 1e-300))
        self.steps = [*self.steps, (s, y, usable)][-MEMORY:]
        self.beta[t], self.value[t], self.gradient[t], self.curve[t] = b, value, slope, np.maximum(curve, 1e-12)
        steepest = solver.subgradient(b, slope, self.bound[t])
        self.done[t] = solver.optimal(steepest, np.asarray(self.c, float)[t], self.rows)
        # Two-loop recursion around the diagonal curvature.
        q, used = -steepest.copy(), []
        for s, y, usable in reversed(self.steps):
            sy = (s[t] * y[t]).sum(1)
            fits = usable[t] & (sy > 0)
            alpha = np.where(fits, (s[t] * q).sum(1) / np.where(fits, sy, 1.0), 0.0)
            q -= alpha[:, None] * y[t]
            used.append((s, y, fits, alpha, sy))
        q /= self.curve[t]
        for s, y, fits, alpha, sy in reversed(used):
            beta = np.where(fits, (y[t] * q).sum(1) / np.where(fits, sy, 1.0), 0.0)
            q += np.where(fits, alpha - beta, 0.0)[:, None] * s[t]
        # A penalised coefficient leaves zero only as its subgradient says.
        q = np.where(self.live[t] & ((self.bound[t] == 0) | (b != 0) | (q * steepest < 0)), q, 0.0)
        uphill = (q * steepest).sum(1) >= 0
        q[uphill] = np.where(self.live[t], -steepest / self.curve[t], 0.0)[uphill]
        self.direction[t], self.scale[t] = q, 1.0
        self._propose(t)

    def _propose(self, t: np.ndarray) -> None:
        b = self.beta[t]
        trial = b + self.scale[t][:, None] * self.direction[t]
        steepest = solver.subgradient(b, self.gradient[t], self.bound[t])
        orthant = np.where(b != 0, np.sign(b), -np.sign(steepest))
        self.trial[t] = np.where((self.bound[t] > 0) & (trial * orthant <= 0), 0.0, trial)


def sums(a: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Per regression: loss, gradient and diagonal curvature of some rows, side by side."""
    eta = a @ beta.T
    q = solver.sigmoid(eta)
    loss = w @ (np.logaddexp(0.0, eta) - y[:, None] * eta)
    gradient = (a.T @ (w[:, None] * (q - y[:, None]))).T
    curve = ((a * a).T @ (w[:, None] * np.maximum(q * (1 - q), 1e-10))).T
    return np.concatenate([loss[:, None], gradient, curve], axis=1)
