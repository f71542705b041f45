"""Non-negative positive-unlabelled learning in numpy.

The risk of a classifier g with class prior p is

    p E_P[l(g)] + max(0, E_U[l(-g)] - p E_P[l(-g)])

with logistic loss l. The second part estimates the risk on negatives from unlabelled rows; where it
falls below zero the fit has started to memorise, and the step goes up that part alone
(Kiryo et al., 2017). Rows are sets of binary features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Sets:
    """Rows as runs of feature numbers."""

    starts: np.ndarray
    features: np.ndarray

    @property
    def n(self) -> int:
        return len(self.starts) - 1

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), np.diff(self.starts))

    def take(self, keep: np.ndarray) -> Sets:
        size = np.diff(self.starts)[keep]
        starts = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(self.starts[:-1][keep] - starts[:-1], size) + np.arange(starts[-1])
        return Sets(starts, self.features[at])


def margins(x: Sets, weights: np.ndarray, bias: float) -> np.ndarray:
    return np.bincount(x.rows(), weights=weights[x.features], minlength=x.n) + bias


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def fit(pos: Sets, unl: Sets, prior: float, n_features: int, rounds: int = 300, rate: float = 0.05, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (full-batch Adam)."""
    theta = np.zeros(n_features + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    rows_p, rows_u = pos.rows(), unl.rows()
    if not pos.n or not unl.n:
        return theta[:-1], 0.0

    def gradient(x: Sets, rows: np.ndarray, per_row: np.ndarray) -> np.ndarray:
        g = np.zeros_like(theta)
        g[:-1] = np.bincount(x.features, weights=per_row[rows], minlength=n_features)
        g[-1] = per_row.sum()
        return g

    for t in range(1, rounds + 1):
        zp, zu = margins(pos, theta[:-1], theta[-1]), margins(unl, theta[:-1], theta[-1])
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        down_p = prior * _sigmoid(zp) / pos.n
        down_u = _sigmoid(zu) / unl.n
        if negative >= 0:
            g = gradient(pos, rows_p, -prior * _sigmoid(-zp) / pos.n - down_p) + gradient(unl, rows_u, down_u)
        else:
            g = -(gradient(unl, rows_u, down_u) - gradient(pos, rows_p, down_p))
        g[:-1] += decay * theta[:-1]
        first = 0.9 * first + 0.1 * g
        second = 0.999 * second + 0.001 * g * g
        theta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return theta[:-1], float(theta[-1])


def cut(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Margin with the fewest errors on rows with known classes (each class counts the same), and a scale.

    With one class only, the cut lies at zero.
    """
    if not (y == 1).any() or not (y == 0).any():
        return 0.0, 1.0
    order = np.argsort(z, kind="stable")
    zs, ys = z[order], y[order]
    share1 = np.concatenate(([0], np.cumsum(ys == 1))) / (y == 1).sum()
    share0 = np.concatenate(([0], np.cumsum(ys == 0))) / (y == 0).sum()
    wrong = share1 + 1 - share0
    wrong[1:-1][zs[1:] == zs[:-1]] = np.inf  # no cut between equal margins
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    low, high = best[0], best[-1]
    left = zs[low - 1] if low > 0 else zs[0] - 1.0
    right = zs[high] if high < len(zs) else zs[-1] + 1.0
    spread = abs(z[y == 1].mean() - z[y == 0].mean())
    return float((left + right) / 2), float(4.0 / max(spread, 1e-6))


def score(z: np.ndarray, at: float, scale: float, decision: float = 0.7) -> np.ndarray:
    """Margins as scores from 0 to 1 that cross ``decision`` at the cut."""
    return _sigmoid(scale * (z - at) + np.log(decision / (1 - decision)))
