"""Histogram gradient-boosted trees for a binary label, in numpy.

Features are cut at quantiles into bins; each tree grows level by level on histograms of gradients
and is complete, so that all trees lie in flat arrays with the children of node k at 2k + 1 and
2k + 2 and rows go down all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """edges: cut points by feature; feature, cut: by tree and inner node; value: by tree and leaf; base: log-odds."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row."""
        log_odds = np.full(len(x), self.base)
        if self.feature.size and len(x):
            trees, inner = self.feature.shape
            first = np.arange(trees) * inner
            node = np.zeros((len(x), trees), np.int64)
            row = np.arange(len(x))[:, None]
            for _ in range(inner.bit_length()):
                at = first + node
                node = 2 * node + 1 + (x[row, self.feature.ravel()[at]] > self.cut.ravel()[at])
            log_odds += self.value.ravel()[np.arange(trees) * (inner + 1) + node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-log_odds))


def fit(x: np.ndarray, label: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 10, penalty: float = 1.0) -> Boosted:
    """``least``: rows in a leaf; ``penalty``: L2 on leaf values. Without both labels the score is constant."""
    inner = (1 << depth) - 1
    positive = label.mean() if len(label) else 0.5
    if not len(label) or not 0 < positive < 1:
        return Boosted([], np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)), {0.0: -5.0, 1.0: 5.0}.get(float(positive), 0.0))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    base = float(np.log(positive / (1 - positive)))
    log_odds = np.full(len(x), base)
    feature, cut, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-log_odds))
        grad, hess, node = label - p, p * (1 - p), np.zeros(len(x), np.int64)
        for level in range(depth):
            width, start = 1 << level, (1 << level) - 1
            sums = [
                np.stack([np.bincount(node * bins + binned[:, f], weights=w, minlength=width * bins).reshape(width, bins) for f in range(x.shape[1])], axis=1).cumsum(axis=2)
                for w in (grad, hess, np.ones(len(x)))
            ]
            (g, h, n), (ga, ha, na) = sums, [s[:, :, -1:] for s in sums]
            gain = g**2 / (h + penalty) + (ga - g) ** 2 / (ha - h + penalty) - ga**2 / (ha + penalty)
            gain[(n < least) | (na - n < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for k in range(width):
                f, b = divmod(int(best[k]), bins)
                if gain[k, f, b] > 1e-9 and b < len(edges[f]):
                    feature[t, start + k], cut[t, start + k] = f, edges[f][b]
            chosen, at = feature[t, start + node], cut[t, start + node]
            node = 2 * node + (x[np.arange(len(x)), chosen] > at)
        g, h = np.bincount(node, weights=grad, minlength=inner + 1), np.bincount(node, weights=hess, minlength=inner + 1)
        value[t] = rate * g / (h + penalty)
        log_odds += value[t][node]
    return Boosted(edges, feature, cut, value, base)
