"""Gradient-boosted trees on binned features, flattened into node arrays.

Bins are quantiles of the training rows. A split on a constrained feature must order
its two leaf values the right way, and both children inherit their midpoint as a
bound, so the whole ensemble is monotonic in that feature.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Ascending cut points per column; a value falls into the bin left of the first cut >= it."""
    grid = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(col, grid)) if len(col) else np.zeros(0) for col in x.T]


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.int32)
    for j, cut in enumerate(edges):
        out[:, j] = np.searchsorted(cut, x[:, j], side="left")
    return out


@dataclass
class Trees:
    """Flat nodes of all trees; a leaf points to itself and has a value."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    start: float = 0.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability per row: all rows walk all trees together, one level a step."""
        if not len(x):
            return np.zeros(0)
        at = np.repeat(self.roots[None, :], len(x), axis=0)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


@dataclass(frozen=True)
class BoostParams:
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 64
    ridge: float = 1.0
    least_rows: int = 10
    falling: tuple[int, ...] = field(default_factory=tuple)


def fit_trees(x: np.ndarray, y: np.ndarray, p: BoostParams = BoostParams()) -> Trees:
    """Logistic boosting. Without rows of both classes the score is a constant."""
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}

    def leaf(value: float) -> int:
        at = len(nodes["value"])
        for key, v in (("feature", 0), ("cut", 0.0), ("left", at), ("right", at), ("value", value)):
            nodes[key].append(v)
        return at

    mean = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(mean / (1 - mean)))
    roots: list[int] = []
    if len(y) and 0 < y.sum() < len(y):
        edges = bin_edges(x, p.bins)
        b = to_bins(x, edges)
        score = np.full(len(y), start)
        falling = np.zeros(x.shape[1], bool)
        falling[list(p.falling)] = True

        live = [j for j, cut in enumerate(edges) if len(cut)]
        width = max(len(edges[j]) for j in live) + 1 if live else 1
        # All features' bins side by side, so that one count serves a node.
        shelf = np.ascontiguousarray(b[:, live].T) + (np.arange(len(live)) * width)[:, None].astype(np.int32)
        room = np.array([len(edges[j]) for j in live])
        beyond = np.arange(width - 1)[None, :] >= room[:, None]
        down = falling[live]

        def sums(cells: np.ndarray, weights: np.ndarray | None, n: int) -> np.ndarray:
            w = None if weights is None else np.broadcast_to(weights, (len(live), n)).ravel()
            return np.cumsum(np.bincount(cells, w, len(live) * width).reshape(len(live), width), axis=1)[:, :-1]

        def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
            gs, hs = g[rows].sum(), h[rows].sum()
            value = float(np.clip(-gs / (hs + p.ridge), low, high))
            best = None
            if live and width > 1 and depth < p.depth and len(rows) >= 2 * p.least_rows:
                cells = shelf[:, rows].ravel()
                n = sums(cells, None, len(rows))
                gl, hl = sums(cells, g[rows], len(rows)), sums(cells, h[rows], len(rows))
                gain = gl**2 / (hl + p.ridge) + (gs - gl) ** 2 / (hs - hl + p.ridge) - gs**2 / (hs + p.ridge)
                wrong = down[:, None] & (-gl / (hl + p.ridge) < -(gs - gl) / (hs - hl + p.ridge))
                gain[beyond | wrong | (n < p.least_rows) | (len(rows) - n < p.least_rows)] = -1
                i, k = divmod(int(np.argmax(gain)), width - 1)
                if gain[i, k] > 1e-9:
                    vl = np.clip(-gl[i, k] / (hl[i, k] + p.ridge), low, high)
                    vr = np.clip(-(gs - gl[i, k]) / (hs - hl[i, k] + p.ridge), low, high)
                    best = (live[i], k, float(vl + vr) / 2)
            if best is None:
                score[rows] += p.rate * value
                return leaf(p.rate * value)
            j, k, middle = best
            here = leaf(0.0)
            goes_left = b[rows, j] <= k
            bounds = ((middle, high), (low, middle)) if falling[j] else ((low, high), (low, high))
            nodes["feature"][here], nodes["cut"][here] = j, float(edges[j][k])
            nodes["left"][here] = grow(rows[goes_left], g, h, depth + 1, *bounds[0])
            nodes["right"][here] = grow(rows[~goes_left], g, h, depth + 1, *bounds[1])
            return here

        for _ in range(p.trees):
            prob = 1 / (1 + np.exp(-score))
            roots.append(grow(np.arange(len(y)), prob - y, prob * (1 - prob), 0, -np.inf, np.inf))
    if not roots:
        roots.append(leaf(0.0))
    kinds = {"feature": np.int32, "left": np.int32, "right": np.int32}
    flat = {k: np.asarray(v, kinds.get(k, float)) for k, v in nodes.items()}
    return Trees(**flat, roots=np.asarray(roots, np.int32), depth=p.depth, start=start)
