"""Histogram gradient-boosted trees in numpy, flattened for vectorised scoring.

Fitting runs on a bounded sample on the driver: features are cut into at most
``BINS`` quantile bins, and trees of fixed depth are grown level by level from
gradient histograms (logistic loss).  A model is four arrays: the feature and
threshold of each inner node of each complete tree, and its leaves.  Scoring
walks all rows down one tree at a time with array indexing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

BINS = 64


class Forest(NamedTuple):
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # go right if the value is above
    leaf: np.ndarray  # trees x leaves
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        depth = self.leaf.shape[1].bit_length() - 1
        row = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0,
    least: float = 1.0, bins: int = BINS,
) -> Forest:
    """A forest for labels 0 and 1; a constant one if a class is missing."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if len(y) else 0.5
    base = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return Forest(np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    made, margin = [], np.full(len(y), base)
    offsets = np.arange(x.shape[1]) * bins
    flat = binned + offsets
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, weight = y - p, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, shift = 1 << level, (1 << level) - 1
            cells = ((node - shift)[:, None] * (x.shape[1] * bins) + flat).ravel()
            shape = (width, x.shape[1], bins)
            g = np.bincount(cells, np.repeat(gradient, x.shape[1]), width * x.shape[1] * bins).reshape(shape)
            h = np.bincount(cells, np.repeat(weight, x.shape[1]), width * x.shape[1] * bins).reshape(shape)
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :1, -1:], hl[:, :1, -1:]
            gr, hr = gt - gl, ht - hl
            gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (hr < least)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for i, cell in enumerate(best):
                f, b = divmod(int(cell), bins)
                if gain[i, f, b] > 1e-9 and b < len(edges[f]):
                    feature[shift + i], threshold[shift + i] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        spot = node - inner
        leaf = rate * np.bincount(spot, gradient, leaves) / (np.bincount(spot, weight, leaves) + ridge)
        margin += leaf[spot]
        made.append((feature, threshold, leaf))
    return Forest(*(np.stack(part) for part in zip(*made)), base)
