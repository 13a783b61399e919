"""Mixing overlapping sources to target weights by min-cost flow.

A document belongs to one or more sources. Documents with the same set of sources form a
membership pattern; only the patterns' word totals reach the driver, at most
``max_patterns`` of them (more are refused). There, tokens flow from patterns to sources:
each repetition of a pattern is an arc as wide as the pattern has words, each dearer than
the one before (convex cost), and a source takes no more than its quota. The cheapest
maximal flow repeats as little as possible. It tells how often each pattern is taken
whole, and how many words more; for those, documents are taken in a seeded order.

The seeded order is never sorted as a whole: word totals per pattern and slice of the
hash range tell the slice where the quota ends, and only that slice is ordered.

Null sources count as a source of their own, last in order; null or empty text has no
words and takes nothing; repeated rows count as often as they stand there; an empty table
gives no rows. Other columns pass through.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from wanderloop.llm.shared import packed, unpacked

SLICES = 4096


@dataclass(frozen=True)
class MixParams:
    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    seed: int = 42
    max_patterns: int = 100_000


def quotas(sizes: dict[str | None, int], total: int, p: MixParams) -> dict[str | None, float]:
    """Share ``total`` by weight; a source stops at ``most`` times its size, the excess is reshared."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: p.weights[i % len(p.weights)] for i, s in enumerate(names)}
    out: dict[str | None, float] = {}
    left, free = float(total), names
    while free:
        share = left / sum(weight[s] for s in free)
        full = [s for s in free if share * weight[s] > p.most * sizes[s]]
        if not full:
            out |= {s: share * weight[s] for s in free}
            break
        for s in full:
            out[s] = float(p.most * sizes[s])
        left -= sum(out[s] for s in full)
        free = [s for s in free if s not in out]
    return out


class Flow:
    """Maximal flow by blocking flows (Dinic); arcs may be widened and the flow resumed."""

    def __init__(self, n: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.arcs: list[list[int]] = [[] for _ in range(n)]

    def arc(self, a: int, b: int, room: int) -> int:
        self.arcs[a].append(len(self.to))
        self.arcs[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [room, 0]
        return len(self.to) - 2

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.arcs)
        level[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in self.arcs[a]:
                if self.room[e] > 0 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def push(self, source: int, sink: int) -> None:
        while (level := self.levels(source))[sink] >= 0:
            turn = [0] * len(self.arcs)
            path: list[int] = []
            at = source
            while True:
                if at == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    path, at = [], source
                    continue
                arcs = self.arcs[at]
                while turn[at] < len(arcs) and not (self.room[arcs[turn[at]]] > 0 and level[self.to[arcs[turn[at]]]] == level[at] + 1):
                    turn[at] += 1
                if turn[at] < len(arcs):
                    path.append(arcs[turn[at]])
                    at = self.to[path[-1]]
                elif path:
                    at = self.to[path.pop() ^ 1]
                    turn[at] += 1
                else:
                    break


def route(patterns: dict[str, int], quota: dict[str | None, float], most: int) -> dict[str, int]:
    """Words to take from each pattern.

    Costs stand on the repetition arcs alone and rise with the repetition, so the cheapest
    flow fills all first repetitions as far as any routing lets it, then the second, and
    so on: one maximal flow per repetition, each going on from the last.
    """
    names, members = list(quota), list(patterns)
    place = {s: 2 + len(members) + i for i, s in enumerate(names)}
    flow = Flow(2 + len(members) + len(names))
    entry = [flow.arc(0, 2 + i, 0) for i in range(len(members))]
    for i, pattern in enumerate(members):
        for s in json.loads(pattern):
            flow.arc(2 + i, place[s], most * patterns[pattern])
    for s in names:
        flow.arc(place[s], 1, round(quota[s]))
    for _ in range(most):
        for e, pattern in zip(entry, members):
            flow.room[e] += patterns[pattern]
        flow.push(0, 1)
    return {pattern: flow.room[e ^ 1] for e, pattern in zip(entry, members)}


def pattern_of(sources: Column) -> Column:
    """The set of sources of a row as a text key; a null array is a set of one null source."""
    return F.to_json(F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string"))))))


def plan_mix(rows: DataFrame, p: MixParams) -> tuple[DataFrame, dict[str | None, tuple[int, float]]]:
    """Decisions per pattern, and (size, target) per source, of rows with _pattern, _size, _slice."""
    spark = rows.sparkSession
    slices = rows.groupBy("_pattern", "_slice").agg(F.sum("_size").alias("words")).persist()
    totals = slices.groupBy("_pattern").agg(F.sum("words").alias("words"))
    found = totals.take(p.max_patterns + 1)
    if len(found) > p.max_patterns:
        raise ValueError(f"more than {p.max_patterns} sets of sources; group the sources first")
    patterns = {r["_pattern"]: int(r["words"] or 0) for r in sorted(found, key=lambda r: r["_pattern"])}
    sizes: dict[str | None, int] = {}
    for pattern, words in patterns.items():
        for s in json.loads(pattern):
            sizes[s] = sizes.get(s, 0) + words
    target = quotas(sizes, sum(patterns.values()), p)
    taken = route(patterns, target, p.most)
    rows_out = []
    for pattern, words in patterns.items():
        full = taken[pattern] // words if words else 0
        rows_out.append((pattern, int(full), int(taken[pattern] - full * words)))
    plan = spark.createDataFrame(rows_out, "_pattern string, _full int, _rest long")
    # Words before each slice, in at most SLICES rows of a pattern.
    before = F.sum("words").over(Window.partitionBy("_pattern").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    ends = (
        slices.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(plan), "_pattern")
        .filter((F.col("before") < F.col("_rest")) & (F.col("before") + F.col("words") >= F.col("_rest")))
        .groupBy("_pattern").agg(F.min("_slice").alias("_end"), F.min_by("before", "_slice").alias("_before"))
    )
    decided = [
        (r["_pattern"], r["_full"], r["_rest"], r["_end"], r["_before"])
        for r in plan.join(ends, "_pattern", "left").toLocalIterator()
    ]
    slices.unpersist()
    schema = "_pattern string, _full int, _rest long, _end int, _before long"
    return spark.createDataFrame(decided, schema), {s: (sizes[s], target[s]) for s in sizes}


def mix(
    docs: DataFrame, size: Column, sources: Column, doc_id: str = "doc_id", p: MixParams = MixParams(), keep: bool = False,
) -> tuple[DataFrame, dict[str | None, tuple[int, float]]]:
    """The rows (packed with ``keep``) with ``_size`` and ``repeats`` (times a row is taken), and (size, target) per source."""
    rows = packed(docs, F.col(doc_id).alias("_id"), size.alias("_size"), pattern_of(sources).alias("_pattern"))
    order = F.xxhash64(F.lit(p.seed), F.col("_id"))
    rows = rows.withColumn("_order", order).withColumn(
        "_slice", F.pmod(F.shiftrightunsigned("_order", 40), F.lit(SLICES)).cast("int")
    )
    plan, known = plan_mix(rows.select("_pattern", "_size", "_slice"), p)
    # One row per set of sources: at most max_patterns rows.
    placed = rows.join(F.broadcast(plan), "_pattern")
    open_slice = F.coalesce(F.col("_slice") == F.col("_end"), F.lit(False))
    below = F.coalesce(F.col("_slice") < F.col("_end"), F.lit(False))
    decided = placed.filter(~open_slice).select("_row", "_size", (F.col("_full") + below.cast("int")).alias("_times"))
    behind = F.sum("_size").over(
        Window.partitionBy("_pattern").orderBy("_order", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    )
    edge = placed.filter(open_slice).withColumn("_behind", F.col("_before") + F.coalesce(behind, F.lit(0)))
    chosen = F.col("_behind") + F.col("_size") / 2 <= F.col("_rest")
    both = decided.unionByName(edge.select("_row", "_size", (F.col("_full") + chosen.cast("int")).alias("_times")))
    if keep:
        return both, known
    return unpacked(both, docs.columns, "_size", F.col("_times").alias("repeats"), names=("_size", "repeats")), known


def repeat_rows(docs: DataFrame, size: Column, sources: Column, doc_id: str = "doc_id", p: MixParams = MixParams()) -> DataFrame:
    """Every row as often as the mix takes it; the columns of ``docs``."""
    mixed, _ = mix(docs, size, sources, doc_id, p, keep=True)
    return unpacked(
        mixed.filter("_times > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("_times")))), docs.columns
    )
