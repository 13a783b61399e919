"""Merkle manifest of a dataset: leaves per row, trees per group, one root over the groups.

A run of ``FANOUT`` consecutive nodes becomes one row: conditional aggregates spread the
children into slot columns. All slots side by side are hashed to the parent; all slots but
a child's own are its siblings. Trees grow by one level per aggregation over all groups, so
the number of jobs is the logarithm of the largest group. Proofs go down the same slot
rows, one join per level, and a leaf unfolds from its run only at the end: a proof moves
once per eight rows, and texts never move.

Positions of groups of any size: rows are cut into ranges of (group, order), each slice
counts its own rows, and the counts of a group's earlier slices are added. Rows that tie in
everything are told apart by their place in the scan, so that a range can end among them.

Null values have a field of their own (``-``); null groups come first, null ids come first
in their group; empty and very long texts are hashed like others; repeated rows are leaves
of their own beside each other; an empty table has no rows and no root; further columns of
the table are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from wanderloop.llm.shared import LOWER, UPPER, settle

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SLOTS = [f"c{k}" for k in range(FANOUT)]
# A run that is all that remains of its tree is kept as it is.
LONE = "parent = 0 AND c1 IS NULL"


def field(value: Column) -> Column:
    """Byte length, colon and value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def group_key(group: Column) -> Column:
    """A key that is never null and sorts as the group does, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


def beside(slots: list[str]) -> str:
    """SQL of the slots side by side, empty ones left out."""
    return f"concat_ws({', '.join([repr(''), *slots])})"


def placed(rows: DataFrame, order: list[str], slices: int) -> DataFrame:
    """The rows with ``pos``, counted from 0 in each ``tree`` in ascending order, nulls first."""
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "_scan")]
    cut = rows.withColumn("_scan", F.monotonically_increasing_id()).repartitionByRange(slices, *keys).sortWithinPartitions(*keys)
    # Within a slice the id counts up from the slice's number in the upper bits.
    cut = settle(cut.withColumn("_at", F.monotonically_increasing_id()).drop("_scan").withColumn("_slice", F.shiftright("_at", 33)), "merkle-places")
    held = cut.groupBy("tree", "_slice").agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_rows"))
    # A tree has at most one row per slice here.
    earlier = Window.partitionBy("tree").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("tree", "_slice", (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_low")).alias("_shift"))
    return cut.join(settle(held, "merkle-slices"), ["tree", "_slice"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_slice", "_shift")


def runs(nodes: DataFrame, *kept: str) -> DataFrame:
    """One row per run: tree, parent, the children's hashes in slots, the run's own hash.

    ``kept`` columns of the children go into one struct ``k0`` and so on beside each slot.
    """
    spread = [f"max(CASE WHEN pos % {FANOUT} = {k} THEN hash END) AS {c}" for k, c in enumerate(SLOTS)]
    if kept:
        spread += [f"max(CASE WHEN pos % {FANOUT} = {k} THEN struct({', '.join(kept)}) END) AS k{k}" for k in range(FANOUT)]
    grown = nodes.groupBy("tree", F.floor(F.col("pos") / FANOUT).alias("parent")).agg(*map(F.expr, spread))
    return grown.withColumn("hash", F.expr(f"CASE WHEN {LONE} THEN c0 ELSE sha2({beside(SLOTS)}, 256) END"))


def grow(nodes: DataFrame, *kept: str) -> list[DataFrame]:
    """The runs of all levels of all trees, from the leaves to the single ones."""
    largest = nodes.groupBy("tree").agg(F.max("pos").alias("last")).agg(F.max("last")).first()[0]
    left = (largest or 0) + 1
    levels = [settle(runs(nodes, *kept), "merkle-level")]
    while (left := -(-left // FANOUT)) > 1:
        up = levels[-1].select("tree", F.col("parent").alias("pos"), "hash")
        levels.append(settle(runs(up), "merkle-level"))
    return levels


def unfold(level: DataFrame, above: DataFrame, keep: list[str], kept: bool = False) -> DataFrame:
    """From the paths of the parents (tree, pos, path, ...) to those of their children.

    A path lists, from the bottom up, what stands before and after the node in its run.
    """
    def child(k: int) -> str:
        step = f"struct({beside(SLOTS[:k])} AS before, {beside(SLOTS[k + 1:])} AS after)"
        path = f"CASE WHEN {LONE} THEN path ELSE concat(array({step}), path) END"
        return f"struct(parent * {FANOUT} + {k} AS pos, c{k} AS hash, {path} AS path{f', k{k} AS kept' if kept else ''})"

    joined = level.withColumnRenamed("hash", "_own").join(above.withColumnRenamed("pos", "parent"), ["tree", "parent"])
    children = F.expr(f"explode(filter(array({', '.join(map(child, range(FANOUT)))}), c -> c.hash IS NOT NULL)) AS child")
    return joined.select("tree", *keep, children).select("tree", *keep, "child.*")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def proof_digest(path: Column) -> Column:
    """Hash over all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def manifest(
    rows: DataFrame, fields: tuple[str, ...] = FIELDS, row_id: str = "doc_id", group: str = "lang",
    changed: dict[str, Column] | None = None, slices: int | None = None,
) -> DataFrame:
    """row_id, leaf, subroot, root, path and ``seen`` (the leaf hash with ``changed`` values) of every row.

    ``changed`` replaces fields, as a later state of the rows would; without it ``seen`` is the leaf.
    """
    slices = slices or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    changed = changed or {}
    leaf = digest(*[field(rows[c]) for c in fields])
    seen = digest(*[field(changed.get(c, rows[c])) for c in fields])
    leaves = placed(
        rows.select(group_key(rows[group]).alias("tree"), rows[row_id].alias("row_id"), leaf.alias("hash"), seen.alias("seen")),
        ["row_id", "hash"], slices,
    )
    trees = grow(leaves, "row_id", "seen")
    subroots = trees[-1].select("tree", "hash")
    tops = grow(settle(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("member"), "hash"), ["member"], slices), "merkle-subroots"), "member")
    start = tops[-1].select("tree", F.col("parent").alias("pos"), F.col("hash").alias("root"), F.expr("cast(array() as array<struct<before:string,after:string>>)").alias("path"))
    down = reduce(lambda above, level: unfold(level, above, ["root"], level is tops[0]), reversed(tops), start)
    down = down.select(F.col("kept.member").alias("tree"), F.lit(0).cast("long").alias("pos"), "root", F.col("hash").alias("subroot"), "path")
    down = reduce(lambda above, level: unfold(level, above, ["root", "subroot"], level is trees[0]), reversed(trees), down)
    return down.select(F.col("kept.row_id").alias(row_id), F.col("hash").alias("leaf"), "subroot", "root", "path", F.col("kept.seen").alias("seen"))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
