"""Small numpy helpers for one packed trajectory: distances, graph, H1 bars.

They run inside Spark tasks; Spark does the grouping, permutation fan-out and statistics.
Matrices of up to ``HELD`` numbers stay in memory. Larger ones lie in unnamed files of the task's
temporary folder and are gone through in strips of rows, so that memory holds the points, a few
strips and one bit for each pair; the results are the same.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np

EPS = 1e-12
HELD = 1 << 22


def matrix(shape: tuple[int, ...], dtype: type = float) -> np.ndarray:
    """An empty matrix, in memory or, if it is large, in a file that goes with it."""
    size = int(np.prod(shape))
    if size <= HELD:
        return np.empty(shape, dtype)
    with tempfile.TemporaryFile() as file:
        file.truncate(size * np.dtype(dtype).itemsize)
        return np.asarray(np.memmap(file, dtype, "r+", shape=shape))


def strips(n: int, wide: int | None = None) -> Iterator[slice]:
    """Ranges of the rows of a matrix, each of at most ``HELD`` numbers or one row."""
    step = max(1, HELD // max(1, n if wide is None else wide))
    for low in range(0, n, step):
        yield slice(low, min(low + step, n))


def upper_numbers(d: np.ndarray) -> Iterator[np.ndarray]:
    """The numbers right of the diagonal, strip by strip."""
    for s in strips(len(d)):
        yield d[s][np.arange(s.start, s.stop)[:, None] < np.arange(len(d))]


def ranked(parts: Callable[[], Iterator[np.ndarray]], ranks: Sequence[int]) -> list[float]:
    """The numbers of given ranks (from 0) among non-negative ones that come in parts: counted by 16 bits at a time until few are left."""
    out = []
    for rank in ranks:
        head, bits = 0, 64
        while True:
            bits -= 16
            counts = np.zeros(1 << 16, np.int64)
            for part in parts():
                key = np.ascontiguousarray(part, dtype=float).view(np.uint64)
                if bits < 48:
                    key = key[key >> np.uint64(bits + 16) == np.uint64(head)]
                counts += np.bincount((key >> np.uint64(bits) & np.uint64(0xFFFF)).astype(np.int64), minlength=1 << 16)
            before = np.cumsum(counts)
            digit = int(np.searchsorted(before, rank, side="right"))
            rank -= int(before[digit] - counts[digit])
            head = head << 16 | digit
            if bits == 0:
                out.append(float(np.array([head], np.uint64).view(float)[0]))
                break
            if counts[digit] <= HELD:
                few = []
                for part in parts():
                    key = np.ascontiguousarray(part, dtype=float).view(np.uint64)
                    few.append(key[key >> np.uint64(bits) == np.uint64(head)])
                out.append(float(np.partition(np.concatenate(few), rank)[rank:rank + 1].view(float)[0]))
                break
    return out


def percentile(parts: Callable[[], Iterator[np.ndarray]], count: int, pct: float) -> float:
    """``np.percentile`` of ``count`` non-negative numbers that come in parts."""
    if count <= HELD:
        return float(np.percentile(np.concatenate(list(parts())), pct))
    at = (count - 1) * (pct / 100)
    low = int(at)
    a, b = ranked(parts, [low, min(low + 1, count - 1)])
    share = at - low
    return b - (b - a) * (1 - share) if share >= 0.5 else a + (b - a) * share


def median(parts: Callable[[], Iterator[np.ndarray]], count: int) -> float:
    """``np.median`` of ``count`` non-negative numbers that come in parts."""
    if count <= HELD:
        return float(np.median(np.concatenate(list(parts()))))
    a, b = ranked(parts, [(count - 1) // 2, count // 2])
    return (a + b) / 2.0


def block_order(n_steps: int, block_size: int, rng: np.random.Generator) -> np.ndarray:
    """Step order with contiguous blocks shuffled; block size 1 shuffles steps."""
    b = max(1, int(block_size))
    starts = rng.permutation(-(-n_steps // b)) * b
    order = (starts[:, None] + np.arange(b)).ravel()
    in_block = np.tile(np.arange(b), len(starts)) + np.repeat(starts, b)
    return order[in_block < n_steps]


def distances_from_gram(gram: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Checkpoint distances when steps with inner products ``gram`` are walked in ``order``.

    The squared distance of checkpoints a and b is the sum of the Gram block
    of the steps between them, read off a two-way running sum.
    """
    g = gram if order is None else np.take(gram[order], order, axis=1)
    n = len(g) + 1
    p = np.zeros((n, n))
    inner = p[1:, 1:]
    np.cumsum(g, axis=0, out=inner)
    np.cumsum(inner, axis=1, out=inner)
    own = p.diagonal()
    sq = own[:, None] + own[None, :]
    sq -= p + p.T
    return rooted(sq)


def rooted(sq: np.ndarray) -> np.ndarray:
    """Distances in place of their squares, zero on the diagonal."""
    np.maximum(sq, 0.0, out=sq)
    np.sqrt(sq, out=sq)
    np.fill_diagonal(sq, 0.0)
    return sq


def point_distances(points: np.ndarray) -> np.ndarray:
    """Euclidean distances, centred on the first point against cancellation."""
    x = np.asarray(points, dtype=float)
    x = x - x[0]
    norm = (x * x).sum(axis=1)
    n = len(x)
    if n * n > HELD:
        d = matrix((n, n))
        for s in strips(n):
            # From the diagonal on; the rest is the mirror image.
            sq = norm[s, None] + norm[None, s.start:]
            sq -= 2.0 * (x[s] @ x[s.start:].T)
            own = sq[:, : s.stop - s.start]
            own[:] = (own + own.T) / 2
            np.fill_diagonal(own, 0.0)
            np.maximum(sq, 0.0, out=sq)
            np.sqrt(sq, out=sq)
            d[s, s.start:] = sq
            d[s.stop:, s] = sq[:, s.stop - s.start:].T
        return d
    twice = x @ x.T
    twice *= 2.0
    sq = norm[:, None] + norm[None, :]
    sq -= twice
    np.add(sq, sq.T, out=twice)
    twice /= 2
    return rooted(twice)


def neighbour_order(d: np.ndarray) -> np.ndarray:
    """Other points of each row by distance, ties to the lower index."""
    loop = d.astype(float, copy=True)
    np.fill_diagonal(loop, -1.0)
    return np.argsort(loop, axis=1, kind="stable")[:, 1:]


def knn_graph(d: np.ndarray, neighbours: np.ndarray, k: int) -> np.ndarray:
    """Weights of the undirected union kNN graph, inf where there is no edge."""
    w = np.full(d.shape, np.inf)
    rows = np.arange(len(d))[:, None]
    cols = neighbours[:, :k]
    w[rows, cols] = d[rows, cols]
    return np.minimum(w, w.T)


def nearest_graph(d: np.ndarray, k: int) -> np.ndarray:
    """``knn_graph`` without sorting whole rows: up to the k-th distance, ties at that one in order."""
    n = len(d)
    w = matrix((n, n))
    for s in strips(n):
        loop = d[s].astype(float, copy=True)
        loop[np.arange(len(loop)), np.arange(s.start, s.stop)] = np.inf
        far = np.partition(loop, k - 1, axis=1)[:, k - 1]
        part = np.where(loop <= far[:, None], loop, np.inf)
        for row in np.flatnonzero(np.isfinite(part).sum(axis=1) > k):
            part[row, np.flatnonzero(loop[row] == far[row])[k - int((loop[row] < far[row]).sum()):]] = np.inf
        w[s] = part
    if n * n <= HELD:
        return np.minimum(w, w.T)
    for s in strips(n):
        part = np.minimum(w[s, s.start:], w[s.start:, s].T)
        w[s, s.start:] = part
        w[s.start:, s] = part.T
    return w


def linked_points(w: np.ndarray) -> np.ndarray:
    """Which pairs have a weight."""
    linked = matrix(w.shape, bool)
    for s in strips(len(w)):
        np.isfinite(w[s], out=linked[s])
    return linked


def component_count(w: np.ndarray) -> int:
    linked = linked_points(w)
    left = np.ones(len(w), dtype=bool)
    count = 0
    while left.any():
        count += 1
        seen = np.zeros(len(w), dtype=bool)
        edge = np.array([int(np.argmax(left))])
        seen[edge] = True
        while edge.size:
            new = ~seen
            new &= np.logical_or.reduce([linked[edge[s]].any(axis=0) for s in strips(len(edge), len(w))])
            seen |= new
            edge = np.flatnonzero(new)
        left &= ~seen
    return count


def grow_graph(d: np.ndarray, k0: int, kmax: int) -> tuple[np.ndarray, int, int, int]:
    """Double k until the graph connects or k reaches its ceiling.

    Returns (weights, k, components at k0, components at k).
    """
    ceiling = min(int(kmax), len(d) - 1)
    k = min(max(1, int(k0)), ceiling)
    w = nearest_graph(d, k)
    first = parts = component_count(w)
    while parts > 1 and k < ceiling:
        k = min(2 * k, ceiling)
        w = nearest_graph(d, k)
        parts = component_count(w)
    return w, k, first, parts


def shortest_paths(w: np.ndarray) -> np.ndarray:
    """Lengths of the shortest ways; points with few neighbours are taken out first, so that sparse graphs take far fewer steps than n**3."""
    return eliminated(w, min(len(w) // 6, HELD // len(w)), blocked_paths)


def eliminated(w: np.ndarray, most: int, rest: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray | None:
    """Shortest ways by taking points out, fewest neighbours first, and putting them back.

    A point that goes leaves the ways over it between its neighbours, so distances among the
    points left stay; back in, its ways lead over those neighbours. Once all have more than
    ``most`` neighbours, ``rest`` finds the ways of the points left (without it: None).
    """
    n = len(w)
    d = matrix((n, n))
    d[:] = w
    np.fill_diagonal(d, 0.0)
    linked = linked_points(d)
    np.fill_diagonal(linked, False)
    degree = linked.sum(axis=1)
    order, after = [], []
    for _ in range(n):
        v = int(degree.argmin())
        if degree[v] > most:
            break
        others = np.flatnonzero(linked[v])
        ways = d[v, others]
        order.append(v)
        after.append((others, ways))
        linked[others, v] = False
        degree[v] = n + 1
        at = others[:, None], others
        d[at] = np.minimum(d[at], ways[:, None] + ways)
        linked[at] = True
        linked[others, others] = False
        degree[others] = np.count_nonzero(linked[others], axis=1)
    if len(order) < n and rest is None:
        return None
    out = d if n * n > HELD else np.empty((n, n))
    if len(order) < n:
        left = np.flatnonzero(degree <= n)
        core = matrix((len(left), len(left)))
        for s in strips(len(left)):
            core[s] = d[left[s][:, None], left]
        out[len(order):, len(order):] = rest(core)
        order += left.tolist()
    np.fill_diagonal(out, 0.0)
    place = np.argsort(order)
    for v in range(len(after) - 1, -1, -1):
        others, ways = after[v]
        if v + 1 < n:
            far = (ways[:, None] + out[place[others], v + 1:]).min(axis=0) if len(others) else np.inf
            out[v, v + 1:] = out[v + 1:, v] = far
    if n * n <= HELD:
        return out[place[:, None], place]
    back = matrix((n, n))
    for s in strips(n):
        back[s] = out[place[s][:, None], place]
    return back


def ways_from(sources: np.ndarray, start: np.ndarray, others: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Shortest ways from some points to all of a sparse undirected graph, a row per point and a column per source.

    Neighbours of point v are ``others[start[v]:start[v + 1]]``. Each round passes on the ways of
    the points that got shorter ones, so the work is that of the edges times the sources
    times the few rounds in which a point changes.
    """
    n = len(start) - 1
    d = np.full((n, len(sources)), np.inf)
    d[sources, np.arange(len(sources))] = 0.0
    start, changed = start.tolist(), np.unique(sources)
    while changed.size:
        mark = np.zeros(n, dtype=bool)
        mark[changed] = True
        met = np.unique(np.concatenate([others[start[v]:start[v + 1]] for v in changed.tolist()]))
        shorter = []
        for v in met.tolist():
            around = others[start[v]:start[v + 1]]
            over = mark[around]
            way = (d[around[over]] + length[start[v]:start[v + 1]][over][:, None]).min(axis=0)
            if (way < d[v]).any():
                np.minimum(way, d[v], out=d[v])
                shorter.append(v)
        changed = np.array(shorter, dtype=np.int64)
    return d


def blocked_paths(w: np.ndarray, block: int = 48) -> np.ndarray:
    """Shortest ways in blocks of points that stay in the cache: a block is closed in itself, its rows go through it, and all others take the shorter of theirs and those through its rows."""
    n = len(w)
    d = matrix((n, n))
    d[:] = w
    np.fill_diagonal(d, 0.0)
    for low in range(0, n, block):
        high = min(low + block, n)
        pivot = d[low:high, low:high].copy()
        way = np.empty_like(pivot)
        for m in range(high - low):
            np.add(pivot[:, m, None], pivot[None, m], out=way)
            np.minimum(pivot, way, out=pivot)
        through = min_plus(pivot, d[low:high])
        for top in range(0, n, block):
            down = min(top + block, n)
            # Rows of a block from its own columns on; the rest is the mirror image.
            part = min_plus(np.ascontiguousarray(through[:, top:down].T), through[:, top:], d[top:down, top:])
            d[top:down, top:] = part
            d[down:, top:down] = part[:, down - top:].T
    return d


def min_plus(a: np.ndarray, b: np.ndarray, into: np.ndarray | None = None) -> np.ndarray:
    """The shorter of ``into`` (none: ``b``) and the ways from rows of ``a`` over its columns to columns of ``b``."""
    out = np.array(b if into is None else into, order="C")
    b, way = np.ascontiguousarray(b), np.empty_like(out)
    for m in range(a.shape[1]):
        np.add(a[:, m, None], b[None, m], out=way)
        np.minimum(out, way, out=out)
    return out


def geodesic_distances(
    d: np.ndarray, k0: int, kmax: int, sentinel_fill: bool = False, rescale: bool = True
) -> tuple[np.ndarray, int, bool]:
    """Graph distances on the grown kNN graph: (distances, k, sentinel used)."""
    if len(d) < 4:
        raise ValueError("a geodesic audit needs at least four points")
    w, k, _, parts = grow_graph(d, k0, kmax)
    geo = shortest_paths(w)
    if parts > 1:
        if not sentinel_fill:
            raise RuntimeError(f"kNN graph still disconnected at k={k}")
        count = sum(int(np.isfinite(geo[s]).sum()) for s in strips(len(geo)))
        far = 10.0 * median(lambda: (geo[s][np.isfinite(geo[s])] for s in strips(len(geo))), count) + 1.0
        for s in strips(len(geo)):
            geo[s][~np.isfinite(geo[s])] = far
    if rescale:
        # Both halves have the same median.
        positive = lambda: (half[half > EPS] for half in upper_numbers(geo))
        count = sum(map(len, positive()))
        middle = median(positive, count) if count else 0.0
        if middle > 0:
            for s in strips(len(geo)):
                geo[s] /= middle + EPS
    return geo, k, parts > 1


def filtration_end(d: np.ndarray, pct: float | None) -> float:
    """Largest positive distance, or its percentile when ``pct`` is given."""
    def positive() -> Iterator[np.ndarray]:
        for s in strips(len(d)):
            part = d[s]
            yield part[(part > EPS) & np.isfinite(part)]

    tops = [(part.size, float(part.max())) for part in positive() if part.size]
    if not tops:
        return 0.0
    if pct is None:
        return max(top for _, top in tops)
    return percentile(positive, sum(size for size, _ in tops), pct)


def as_words(mask: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    full = np.zeros((len(mask), -(-mask.shape[1] // 64) * 64), dtype=bool)
    full[:, : mask.shape[1]] = mask
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64)


def open_pairs(d: np.ndarray, cut: float, nearest: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (rows, cols) up to about ``cut`` that none of the nearest neighbours of an end lies strictly between.

    A pair with a point closer to both of its ends is never among the edges without an
    older way; a few others may be left in, which ``unbridged`` drops.
    """
    n, whole = len(d), d
    d = matrix((n, n), np.float32)
    d[:] = whole  # what is shorter after rounding is so before
    np.fill_diagonal(d, np.inf)
    k = min(nearest, n - 1)
    near = np.concatenate([np.argpartition(d[s], k - 1, axis=1)[:, :k] for s in strips(n)])
    every = np.arange(n)
    far = matrix((n, n), bool)
    for s in strips(n):
        part = d[s] <= np.float32(cut)
        way = np.empty_like(d[s])
        for v in near[s, :2].T:
            np.take(d, v, axis=0, out=way, mode="clip")
            np.maximum(way, d[every[s], v][:, None], out=way)
            part &= way >= d[s]
        far[s] = part
    found = []
    for s in strips(n):
        rows, cols = np.divmod(np.flatnonzero(far[s] & far[:, s].T), n)
        rows += s.start
        upper = rows < cols
        found.append((rows[upper], cols[upper]))
    rows, cols = (np.concatenate(x) for x in zip(*found))
    for v in near[:, 2:].T:
        for a, b in ((0, 1), (1, 0)):
            end = (rows, cols)
            left = np.maximum(d[end[a], v[end[a]]], d[v[end[a]], end[b]]) >= d[rows, cols]
            rows, cols = rows[left], cols[left]
    return rows, cols


def unbridged(rank: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Which edges have no common neighbour over two older edges."""
    out = np.ones(len(rows), dtype=bool)
    step = max(1, (1 << 20) // len(rank))
    for low in range(0, len(rows), step):
        i, j = rows[low:low + step], cols[low:low + step]
        out[low:low + step] = np.maximum(rank[i], rank[j]).min(axis=1) >= rank[i, j]
    return out


def lowest(words: np.ndarray) -> np.ndarray:
    """Number of the lowest bit of each row of words; every row has one."""
    at = (words != 0).argmax(axis=1)
    word = words[np.arange(len(words)), at]
    return 64 * at + np.log2((word & (~word + np.uint64(1))).astype(float)).astype(np.int64)


def lunes(rank: np.ndarray, i: np.ndarray, j: np.ndarray, edges: np.ndarray, low: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common neighbours over older edges of each edge, as bits: all of ``low``, and those of ``most`` that are older."""
    out = low.copy()
    asked = (most & ~low).ravel()
    at = np.flatnonzero(asked)
    bits = np.unpackbits(asked[at].view(np.uint8), bitorder="little")
    k, bit = np.divmod(np.flatnonzero(bits), 64)
    row, word = np.divmod(at[k], low.shape[1])
    point = 64 * word + bit
    older = np.maximum(rank[i[row], point], rank[j[row], point]) < edges[row]
    np.bitwise_or.at(out.ravel(), at[k[older]], SINGLE[bit[older]])
    return out


def leaders(near: np.ndarray, lune: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, point): points of each lune whose triangle does not follow from that of ``inner``.

    Two points of a lune that are neighbours close tetrahedra with its edge, whose other triangles
    are older; so one point of a connected part of the lune will do.
    """
    bit = lambda w: as_bit(w, lune.shape[1])
    rows = np.arange(len(lune))
    reached = (near[inner] & lune) | bit(inner)
    left = lune & ~reached
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        more = left.any(axis=1)
        rows, lune, reached, left = rows[more], lune[more], reached[more], left[more]
        if not rows.size:
            break
        w = lowest(left)
        around = near[w] & lune
        new = ~(around & reached).any(axis=1)
        found.append((rows[new], w[new]))
        reached |= around | bit(w)
        left &= ~reached
    if not found:
        return rows, rows
    row, point = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(row, kind="stable")
    return row[order], point[order]


def as_bit(at: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros((len(at), words), dtype=np.uint64)
    out[np.arange(len(at)), at // 64] = np.uint64(1) << (at % 64).astype(np.uint64)
    return out


def separate(rank: np.ndarray, i: np.ndarray, j: np.ndarray, v: np.ndarray, w: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Numbers of the edges whose lune points ``v`` and ``w`` are no neighbours over older edges and have no common one in the lune."""
    far = np.flatnonzero(rank[v, w] > edges)
    out = np.ones(len(far), dtype=bool)
    step = max(1, (1 << 18) // len(rank))
    for low in range(0, len(far), step):
        e = far[low:low + step]
        way = rank[i[e]]
        for p in (j, v, w):
            np.maximum(way, rank[p[e]], out=way)
        out[low:low + step] = way.min(axis=1) >= edges[e]
    return far[out]


SINGLE = np.uint64(1) << np.arange(64, dtype=np.uint64)

# Edges whose classes are remembered at a time; the others are found again.
REMEMBERED = 500_000


class Classes:
    """Classes by number, each as bits over those still open."""

    def __init__(self) -> None:
        self.count = 0
        self.bits = np.zeros((64, 1), dtype=np.uint64)

    def open(self) -> int:
        k = self.count
        if k == len(self.bits):
            wide = matrix((2 * k, 2 * k // 64), np.uint64)
            wide[:] = 0
            wide[:k, : self.bits.shape[1]] = self.bits
            self.bits = wide
        self.bits[k, k // 64] = np.uint64(1) << np.uint64(k % 64)
        self.count += 1
        return k

    def relate(self, sums: list[frozenset]) -> Iterator[tuple[int, int]]:
        """(number of the sum, youngest class left in it) for each sum, in order, that is not zero yet; it is zero from there on."""
        asked = [(t, k) for t, members in enumerate(sums) for k in members]
        if not asked:
            return
        owner, member = np.array(asked).T
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        owner, words = owner[heads], -(-self.count // 64)
        step = max(1, (1 << 22) // words)
        ends = np.append(heads, len(member))
        rows = np.empty((len(heads), words), dtype=np.uint64)
        low = 0
        while low < len(heads):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + step, side="right")) - 1)
            part = self.bits[member[ends[low]:ends[high]], :words]
            rows[low:high] = np.bitwise_xor.reduceat(part, heads[low:high] - heads[low], axis=0)
            low = high
        for t in np.flatnonzero(rows.any(axis=1)).tolist():
            row = rows[t].copy()
            filled = np.flatnonzero(row)
            if not filled.size:
                continue
            word = int(filled[-1])
            bit = int(row[word]).bit_length() - 1
            shift, one = np.uint64(bit), np.uint64(1)
            for held in (rows, self.bits[: self.count]):
                has = np.flatnonzero((held[:, word] >> shift) & one)
                held[has, :words] ^= row
            yield int(owner[t]), 64 * word + bit


class Filtration:
    """Edges of a distance matrix up to ``cut`` by length, sorted part by part as they are asked for."""

    def __init__(self, d: np.ndarray, cut: float) -> None:
        n = len(d)
        self.d, self.cut, self.n = d, cut, n
        self.rank = matrix((n, n), np.int32 if n * n < 1 << 31 else np.int64)
        self.rank[:] = n * n
        held = n * n <= HELD
        most = n * n if held else sum(np.count_nonzero(part <= cut) for part in upper_numbers(d))
        end = np.int64 if held else np.int32
        # Of each edge its ends, its length, and a point between, -1 for none, -2 if not looked for yet.
        self.room = [matrix((most,), kind) for kind in (end, end, float, np.int32)]
        self.rows, self.cols, self.length, self.inner = (x[:0] for x in self.room)
        self.upto, self.sure = -np.inf, False
        self.parent = list(range(n))
        i, j = open_pairs(d, cut)
        order = np.argsort(d[i, j], kind="stable")
        self.pairs = i[order], j[order], d[i, j][order]
        self.opens_at = np.empty(0, dtype=np.int64)  # edges that open a class
        self.upper = np.where(np.arange(n)[:, None] < np.arange(n), d, np.inf).ravel() if held else None
        at = np.arange(0, n * n, max(1, n * n // 20_000))
        some = d.ravel()[at[at // n < at % n]]
        some = np.sort(some[some <= cut])
        parts = np.arange(1, -(-4 * most // HELD)) * HELD / (4 * most)  # at most about a quarter of HELD edges each
        shares = (0.15, 0.4, 0.7) if held else np.union1d((0.15, 0.4, 0.7), parts)
        self.marks = [float(some[int(len(some) * q)]) for q in shares] if n > 200 and len(some) else []
        self.marks.append(cut)

    @property
    def more(self) -> bool:
        return bool(self.marks)

    @property
    def more_open(self) -> bool:
        """Whether edges still to be sorted open a class or join parts."""
        if self.more and not self.sure:
            i, j, length = self.pairs
            left = np.ones(len(i), dtype=bool)
            step = max(1, (1 << 20) // self.n)
            for low in range(0, len(i), step):
                e = slice(low, low + step)
                left[e] = np.maximum(self.d[i[e]], self.d[j[e]]).min(axis=1) >= length[e]
            left &= length <= self.cut
            self.pairs, self.sure = (i[left], j[left], length[left]), True
        return bool(self.pairs[2].size) and self.more

    def extend(self) -> None:
        mark = self.marks.pop(0)
        if mark <= self.upto:
            return
        at, length = self.edges_up_to(mark)
        order = np.argsort(length)
        m, kind = len(self.length), self.rank.dtype.type
        rows, cols = (x.astype(np.int64) for x in np.divmod(at[order].astype(kind), kind(self.n)))
        self.rank[rows, cols] = self.rank[cols, rows] = np.arange(m, m + len(at), dtype=kind)
        for room, new in zip(self.room, (rows, cols, length[order], -2)):
            room[m:m + len(at)] = new
        self.rows, self.cols, self.length, self.inner = (x[:m + len(at)] for x in self.room)
        self.upto = mark
        i, j, length = self.pairs
        now = int(np.searchsorted(length, mark, side="right"))
        self.pairs = i[now:], j[now:], length[now:]
        i, j = i[:now], j[:now]
        left = unbridged(self.rank, i, j)
        opened = [e for e in np.sort(self.rank[i[left], j[left]]).tolist() if not self.joined(e)]
        self.opens_at = np.concatenate([self.opens_at, np.array(opened, dtype=np.int64)])

    def edges_up_to(self, mark: float) -> tuple[np.ndarray, np.ndarray]:
        """Places right of the diagonal, and lengths, of the edges up to ``mark`` that are not sorted yet."""
        if self.upper is not None:
            below = self.upper <= mark
            if len(self.length):
                below &= self.upper > self.upto
            at = np.flatnonzero(below)
            return at, self.upper[at]
        found = []
        for s in strips(self.n):
            part = self.d[s]
            below = part <= mark
            if len(self.length):
                below &= part > self.upto
            below &= np.arange(s.start, s.stop)[:, None] < np.arange(self.n)
            at = np.flatnonzero(below)
            found.append((at + s.start * self.n, part.ravel()[at]))
        at, length = (np.concatenate(x) for x in zip(*found))
        return at, length

    def joined(self, edge: int) -> bool:
        """Join the parts at the ends of an edge; False if they were one already."""
        parent, ends = self.parent, []
        for a in (int(self.rows[edge]), int(self.cols[edge])):
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            ends.append(a)
        parent[ends[0]] = ends[1]
        return ends[0] != ends[1]

    def between(self, edge: int) -> int:
        v = int(self.inner[edge])
        if v == -2:
            way = np.maximum(self.rank[self.rows[edge]], self.rank[self.cols[edge]])
            v = int((way < edge).argmax())  # the first of them: ways over the same few points are found once
            v = v if way[v] < edge else -1
            self.inner[edge] = v
        return v


def halfway_walk(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The checkpoint half-way between two of a walk; of those far apart, the one half-way round the other side."""
    way = (a + b) // 2
    return np.where(2 * np.abs(a - b) > n, (way + n // 2) % n, way)


def h1_bars(
    d: np.ndarray, end: float, batch: int = 2048, between: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(births, deaths) of the positive H1 bars of the Rips filtration up to ``end``.

    Death is inf for a class alive at ``end``. Once one point sees all others, every
    class is closed, so longer edges are left out. An edge with a common neighbour
    that is closer to both ends can be replaced by the two older edges of that
    triangle, so only edges without one (the relative neighbourhood graph)
    can open a class, and those in the spanning tree do not. Any edge is then a
    sum of opening edges, found when asked for; a triangle whose three sums do not
    cancel closes the youngest class of what is left after older relations.

    An edge whose lune lies around one of the lune's points closes nothing. Most edges are
    found to be such a batch at a time: the point must be next to all that the lune may have
    at the end of the batch, over edges from before it. The others are looked at by their
    own lunes: one triangle for each connected part. Edges are sorted as far as classes
    are open or still to open, and passed over where none is. ``between`` guesses such a
    point for pairs of points (none: the checkpoint half-way); guesses cost time only.
    """
    n = len(d)
    if n < 4:
        return np.empty(0), np.empty(0)
    # Points in the middle first: the lowest bit of a lune is a point that sees most of it.
    total = d.sum(axis=1)
    if not np.isfinite(total).all():
        total = np.concatenate([np.where(np.isfinite(d[s]), d[s], 0.0).sum(axis=1) for s in strips(n)])
    middle = np.argsort(total, kind="stable")
    given, d = d, matrix((n, n))
    for s in strips(n):
        np.take(given[middle[s]], middle, axis=1, out=d[s])
    f = Filtration(d, min(end, float(d.max(axis=1).min())))
    rank = f.rank
    flat, words = rank.ravel(), -(-n // 64)
    own_word, own_bit = np.arange(n) * words + np.arange(n) // 64, ~SINGLE[np.arange(n) % 64]
    place = np.argsort(middle)  # of each point in this order
    halfway = between or (lambda a, b: halfway_walk(a, b, n))

    def half(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return place[halfway(middle[i], middle[j])]

    sums: dict[int, frozenset] = {}  # edge -> classes of the edges it can be replaced by
    first: dict[int, frozenset] = {}  # edges that open a class
    nothing = frozenset()

    def classes(edge: int) -> frozenset:
        """Classes of an edge, those of older edges first (no recursion: ways can be long)."""
        stack = [edge]
        while stack:
            e = stack[-1]
            if e in sums:
                stack.pop()
                continue
            v = f.between(e)
            if v < 0:
                sums[e] = first.get(e, nothing)
                stack.pop()
                continue
            left, right = int(rank[f.rows[e], v]), int(rank[f.cols[e], v])
            a, b = sums.get(left), sums.get(right)
            if a is not None and b is not None:
                sums[e] = a ^ b
                stack.pop()
                continue
            if a is None:
                stack.append(left)
            if b is None:
                stack.append(right)
        return sums[edge]

    found, alive = Classes(), {}  # class -> edge that opened it
    bars: list[tuple[float, float]] = []
    start, near, held = 0, None, -1
    while True:
        if not alive and found.count < len(f.opens_at):
            start = int(f.opens_at[found.count])
        elif not alive and f.more_open:
            f.extend()
            continue
        elif not alive:
            break
        if start == len(f.length):
            if not f.more:
                break
            f.extend()
            continue
        # Lunes grow by the batch: while there are few edges, batches are small.
        stop = min(start + min(batch, max(512, start // 8)), len(f.length))
        i, j = f.rows[start:stop].astype(np.int64), f.cols[start:stop].astype(np.int64)
        if held != start:
            near = np.concatenate([as_words(rank[s] < start) for s in strips(n)])
        then = near.copy()
        ends, others = np.concatenate([i, j]), np.concatenate([j, i])
        np.bitwise_or.at(then.ravel(), ends * then.shape[1] + others // 64, SINGLE[others % 64])
        for e in f.opens_at[found.count: np.searchsorted(f.opens_at, stop)].tolist():
            k = found.open()
            first[e] = frozenset([k])
            alive[k] = e
        beyond = ~near
        beyond.ravel()[own_word] &= own_bit
        apex = half(i, j)
        most = then[i]
        most &= then[j]
        hard = np.flatnonzero(
            (most & beyond[apex]).any(axis=1) | (np.maximum(flat.take(i * n + apex), flat.take(j * n + apex)) >= start)
        )
        i, j, most = i[hard], j[hard], most[hard]
        low = near[i] & near[j]
        some = np.flatnonzero(low.any(axis=1))
        apex = lowest(low[some])
        f.inner[start + hard[some]] = apex
        eased = np.ones(len(hard), dtype=bool)
        eased[some] = (most[some] & beyond[apex]).any(axis=1)
        left = np.flatnonzero(eased)
        edges = start + hard[left]
        lune = lunes(rank, i[left], j[left], edges, low[left], most[left])
        some = lune.any(axis=1)
        f.inner[edges[~some]] = -1
        edges, lune = edges[some], lune[some]
        if edges.size:
            inner = lowest(lune)
            f.inner[edges] = inner
            at, point = leaders(near, lune, inner)
            apart = separate(rank, f.rows[edges[at]], f.cols[edges[at]], inner[at], point, edges[at])
            edge, v, point = edges[at[apart]], inner[at[apart]], point[apart]
            a, b = f.rows[edge], f.cols[edge]
            sides = np.stack([rank[a, v], rank[b, v], rank[a, point], rank[b, point]], axis=1).tolist()
            for t, youngest in found.relate([classes(p) ^ classes(q) ^ classes(r) ^ classes(s) for p, q, r, s in sides]):
                birth, death = float(f.length[alive.pop(youngest)]), float(f.length[edge[t]])
                if death > birth:
                    bars.append((birth, death))
            if len(sums) > REMEMBERED:
                sums.clear()
        near, start, held = then, stop, stop
    bars += [(float(f.length[e]), np.inf) for e in alive.values()]
    out = np.asarray(bars, dtype=float).reshape(-1, 2)
    return out[:, 0], out[:, 1]


def max_h1_lifetime(d: np.ndarray, pct: float | None = None) -> float:
    """Longest H1 bar; a bar cut by the filtration end counts up to that end."""
    if len(d) < 4:
        return 0.0
    radius = float(d.max(axis=1).min())
    below = count = 0
    for s in strips(len(d)):
        pairs = (d[s] > EPS) & np.isfinite(d[s])
        below += np.count_nonzero(pairs & (d[s] < radius))
        count += np.count_nonzero(pairs)
    cut = radius <= EPS or cuts(below, count, pct)
    end = filtration_end(d, pct) if cut else np.inf
    if end <= 0.0:
        return 0.0
    return longest(*h1_bars(d, end), end)


def longest(births: np.ndarray, deaths: np.ndarray, end: float) -> float:
    return float((np.minimum(deaths, end) - births).max()) if births.size else 0.0


def cuts(below: int, count: int, pct: float | None) -> bool:
    """Whether a percentile of ``count`` distances may cut a bar, if ``below`` of them are shorter than the radius at which one point sees all others."""
    return below >= int((100.0 if pct is None else pct) / 100.0 * (count - 1))


def lifetimes_to(d: np.ndarray, pct: float | None) -> np.ndarray:
    """Lengths of the H1 bars, cut at the filtration end."""
    end = filtration_end(d, pct)
    births, deaths = h1_bars(d, end)
    return np.minimum(deaths, end) - births


def significant_bars(d: np.ndarray, pct: float | None, share: float = 0.10) -> int:
    """Bars longer than ``share`` of the longest one."""
    life = lifetimes_to(d, pct)
    return int((life > share * life.max()).sum()) if life.size else 0


def lifetime_pair(
    d: np.ndarray, k0: int, kmax: int, pct: float | None = None, sentinel_fill: bool = False
) -> tuple[float, float | None, int]:
    """(Euclidean lifetime, geodesic lifetime, k used) of one distance matrix.

    The geodesic lifetime is None when the graph stays disconnected at ``kmax``.
    """
    straight = max_h1_lifetime(d, pct)
    if len(d) < 4:
        return straight, 0.0, 0
    try:
        geo, k, _ = geodesic_distances(d, k0, kmax, sentinel_fill)
    except RuntimeError:
        return straight, None, min(int(kmax), len(d) - 1)
    return straight, max_h1_lifetime(geo, pct), k
