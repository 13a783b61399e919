"""Slow, plain definitions the fast code is compared with."""

from __future__ import annotations

from itertools import combinations

import numpy as np


def h1_bars_by_matrix_reduction(d: np.ndarray, end: float) -> list[tuple[float, float]]:
    """Column reduction of the triangle boundary matrix over Z/2."""
    n = len(d)
    edges = sorted(
        ((d[a, b], a, b) for a, b in combinations(range(n), 2) if d[a, b] <= end)
    )
    index = {(a, b): q for q, (_, a, b) in enumerate(edges)}
    parent = list(range(n))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    cycle_edges = set()
    for q, (_, a, b) in enumerate(edges):
        ra, rb = root(a), root(b)
        if ra == rb:
            cycle_edges.add(q)
        else:
            parent[ra] = rb
    triangles = []
    for a, b, c in combinations(range(n), 3):
        if (a, b) in index and (b, c) in index and (a, c) in index:
            col = {index[a, b], index[b, c], index[a, c]}
            triangles.append((max(col), col))
    triangles.sort(key=lambda t: t[0])
    pivots: dict[int, set] = {}
    bars = []
    for top, col in triangles:
        col = set(col)
        while col and max(col) in pivots:
            col ^= pivots[max(col)]
        if col:
            low = max(col)
            pivots[low] = col
            cycle_edges.discard(low)
            if edges[top][0] > edges[low][0]:
                bars.append((edges[low][0], edges[top][0]))
    bars += [(edges[q][0], np.inf) for q in cycle_edges]
    return sorted(bars)
