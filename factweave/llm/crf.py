"""A two-state linear-chain conditional random field in numpy.

State scores are given as log-odds, so the forward and backward passes carry one
number per place. All chains of a batch take a step together.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Crf:
    weights: np.ndarray  # of state 1 against state 0, by feature
    trans: np.ndarray  # trans[i, j]: from state i to state j
    mean: np.ndarray
    scale: np.ndarray

    def emission(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0]

    def marginals(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(state 1) at each place of the chains laid end to end in ``x``."""
        a, b, _ = passes(self.emission(x), lengths, self.trans)
        return sigmoid(a + b)


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _steps(lengths: np.ndarray) -> list[np.ndarray]:
    """The places of the t-th step of every chain that has one."""
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    by = lengths[order]
    alive = np.searchsorted(-by, -np.arange(int(by[0]) if len(by) else 0), side="left")
    return [starts[:n] + t for t, n in enumerate(alive.tolist())]


def passes(e: np.ndarray, lengths: np.ndarray, t: np.ndarray):
    """Forward and backward log-odds of each place, and the steps taken."""
    steps = _steps(lengths)
    a, b = e.astype(np.float64).copy(), np.zeros(len(e))
    for at in steps[1:]:
        r = a[at - 1]
        a[at] += np.logaddexp(t[0, 1], t[1, 1] + r) - np.logaddexp(t[0, 0], t[1, 0] + r)
    for at in reversed(steps[1:]):
        r = e[at] + b[at]
        b[at - 1] = np.logaddexp(t[1, 0], t[1, 1] + r) - np.logaddexp(t[0, 0], t[0, 1] + r)
    return a, b, steps


def train(x: np.ndarray, y: np.ndarray, lengths: np.ndarray, iterations: int = 80, rate: float = 0.15, ridge: float = 1e-3) -> Crf:
    """Maximum likelihood by full-batch Adam; features are standardised."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.hstack([np.ones((len(x), 1)), (x - mean) / scale])
    first = np.zeros(len(x), bool)
    first[np.cumsum(lengths) - lengths] = True
    nxt = np.flatnonzero(~first)  # places with one before them in their chain
    pair = np.zeros((2, 2))
    np.add.at(pair, (y[nxt - 1], y[nxt]), 1)
    p = np.zeros(z.shape[1] + 3)
    m, v = np.zeros_like(p), np.zeros_like(p)
    n = max(1, len(x))
    for i in range(1, iterations + 1):
        w, t = p[:-3], np.array([[0.0, p[-3]], [p[-2], p[-1]]])
        e = z @ w
        a, b, _ = passes(e, lengths, t)
        g = np.empty_like(p)
        g[:-3] = z.T @ (y - sigmoid(a + b)) / n - ridge * w
        r, s = a[nxt - 1], e[nxt] + b[nxt]
        logit = np.stack([np.zeros_like(r) + t[0, 0], t[0, 1] + s, t[1, 0] + r, t[1, 1] + r + s])
        q = np.exp(logit - logit.max(0))
        q = (q / q.sum(0)).sum(1)
        g[-3:] = (pair.ravel() - q)[1:] / n - ridge * p[-3:]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-9)
    return Crf(p[:-3], np.array([[0.0, p[-3]], [p[-2], p[-1]]]), mean, scale)


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weights (bias first) of a ridge logistic regression by Newton's method."""
    z = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(z.shape[1])
    pull = np.full(len(w), ridge)
    pull[0] = 1e-4
    for _ in range(steps):
        p = sigmoid(z @ w)
        g = z.T @ (p - y) + pull * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull) + 1e-8 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w
