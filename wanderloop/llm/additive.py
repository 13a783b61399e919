"""Generalised additive model with pairwise interactions, by cyclic boosting.

Every round visits every feature once and adds a shallow tree on that feature alone to
its lookup table; afterwards the strongest pairs get tables of their own, boosted the
same way on what is left. A score is a sum of looked-up bins through the logistic
function.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from wanderloop.llm.boosting import bin_edges, to_bins


@dataclass(frozen=True)
class AdditiveParams:
    rounds: int = 80
    pair_rounds: int = 40
    pairs: int = 8
    bins: int = 48
    pair_bins: int = 8
    rate: float = 0.15
    ridge: float = 2.0


@dataclass
class Additive:
    start: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        total = np.full(len(x), self.start)
        b = to_bins(x, self.edges)
        for j, t in enumerate(self.tables):
            total += t[b[:, j]]
        if self.pairs:
            c = to_bins(x, self.pair_edges)
            for (i, j), t in zip(self.pairs, self.pair_tables):
                total += t[c[:, i], c[:, j]]
        return 1 / (1 + np.exp(-total))


def _cut(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int]:
    """Gain and place of the best cut of ordered bins."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gs, hs = g.sum(), h.sum()
    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _shallow(g: np.ndarray, h: np.ndarray, ridge: float, leaves: int = 3) -> np.ndarray:
    """Values per bin of a tree with at most ``leaves`` leaves on one feature."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gains = [(_cut(g[a:z], h[a:z], ridge), a, z) for a, z in parts]
        (gain, k), a, z = max(gains, key=lambda x: x[0][0])
        if gain <= 1e-9:
            break
        parts.remove((a, z))
        parts += [(a, a + k), (a + k, z)]
    out = np.empty(len(g))
    for a, z in parts:
        out[a:z] = -g[a:z].sum() / (h[a:z].sum() + ridge)
    return out


def _shallow_pair(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """A tree of depth two on a grid: one cut of either axis, then one of the other on each side."""
    best = (-1.0, None)
    for axis in (0, 1):
        gg, hh = (g, h) if axis == 0 else (g.T, h.T)
        for k in range(1, len(gg)):
            out, gain = np.empty(gg.shape), 0.0
            for part in (slice(0, k), slice(k, None)):
                a, b = gg[part].sum(axis=0), hh[part].sum(axis=0)
                _, m = _cut(a, b, ridge)
                for side in (slice(0, m), slice(m, None)):
                    gs, hs = a[side].sum(), b[side].sum()
                    gain += gs**2 / (hs + ridge)
                    out[part, side] = -gs / (hs + ridge)
            if gain > best[0]:
                best = (gain, out if axis == 0 else out.T)
    return (0.0, np.zeros(g.shape)) if best[1] is None else best


def fit_additive(x: np.ndarray, y: np.ndarray, p: AdditiveParams = AdditiveParams()) -> Additive:
    """Without rows of both classes all tables are zero and the score is a constant."""
    mean = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(mean / (1 - mean)))
    edges, pair_edges = bin_edges(x, p.bins), bin_edges(x, p.pair_bins)
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Additive(start, edges, tables, pair_edges, [], [])
    if not len(y) or not 0 < y.sum() < len(y):
        return model
    b, c = to_bins(x, edges), to_bins(x, pair_edges)
    score = np.full(len(y), start)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        prob = 1 / (1 + np.exp(-score))
        return prob - y, prob * (1 - prob)

    for _ in range(p.rounds):
        for j, t in enumerate(tables):
            g, h = slopes()
            col = b[:, j]
            step = p.rate * _shallow(np.bincount(col, g, len(t)), np.bincount(col, h, len(t)), p.ridge)
            t += step
            score += step[col]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)
        cell = c[:, i] * shape[1] + c[:, j]
        g, h = slopes()
        size = shape[0] * shape[1]
        return cell, np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape)

    ranked = []
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            _, g, h = grid(i, j)
            ranked.append((_shallow_pair(g, h, p.ridge)[0], -i, -j))
    model.pairs = [(-i, -j) for gain, i, j in sorted(ranked, reverse=True)[:p.pairs] if gain > 1e-6]
    model.pair_tables = [np.zeros((len(pair_edges[i]) + 1, len(pair_edges[j]) + 1)) for i, j in model.pairs]
    for _ in range(p.pair_rounds):
        for (i, j), t in zip(model.pairs, model.pair_tables):
            cell, g, h = grid(i, j)
            step = p.rate * _shallow_pair(g, h, p.ridge)[1]
            t += step
            score += step.ravel()[cell]
    return model
