"""Permutation tests over one-dimensional walks of the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wanderloop.operators.ordered import OrderedGroups
from wanderloop.operators.walk_nulls import record_from_lifetimes, walk_extents
from wanderloop.plans.registry import query, table

N_NULLS = 200
SEED = 42
BLOCKS = (1, 5, 10, 20)


def event_walk_steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Increments of each user's cumulative, mean-free event value, and how many the longest walk has."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    ordered = OrderedGroups(events, ["user_id"], ["ts", "event_id"])
    placed = ordered.scan(position="pos")
    level = events.groupBy("user_id").agg(
        F.round(F.avg("value"), 8).alias("level"), (F.count(F.lit(1)) - 1).alias("n_steps")
    )
    steps = (
        placed.filter("pos >= 1")
        .join(level, "user_id")
        .select("user_id", "pos", (F.col("value") - F.col("level")).alias("step"), "n_steps")
    )
    return steps, ordered.largest - 1


def rounded_record(df: DataFrame) -> DataFrame:
    digits = dict.fromkeys(("Lobs", "null_med", "null_max", "delta"), 9)
    digits |= dict.fromkeys(("TSR", "pperm", "pct", "zero_frac"), 6) | {"zrob": 4}
    return df.withColumns({c: F.round(c, d) for c, d in digits.items()})


STEPS_SQL = """
placed AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos
  FROM events),
level AS (SELECT user_id, round(avg(value), 8) AS lvl FROM events GROUP BY user_id),
steps AS (
  SELECT p.user_id, p.pos, p.value - l.lvl AS step
  FROM placed p JOIN level l USING (user_id) WHERE p.pos >= 1)"""

# Places of blocks in a null: a Feistel network, gone through again while beyond the last block.
_SEEDED = "block_size, null_id, block, nb, half, k1, k2, k3, k4"


def _network(source: str, start: str) -> str:
    """The network on column ``start`` of ``source``, as a subquery with column x."""
    sql = f"SELECT *, {start} >> half AS l0, {start} & ((1::BIGINT << half) - 1) AS r0 FROM {source}"
    for r in range(1, 5):
        mixed = f"((r{r - 1} + k{r}) % 2147483647)"
        sql = f"""SELECT *, r{r - 1} AS l{r}, xor(l{r - 1}, (({mixed} * {mixed}) % 2147483647 >> 5) & ((1::BIGINT << half) - 1)) AS r{r}
          FROM ({sql})"""
    return f"SELECT *, (l4 << half) | r4 AS y FROM ({sql})"


EXTENT_SQL = """
sizes AS (
  SELECT {keys}, b.block_size, CAST((max(s.pos) + b.block_size - 1) // b.block_size AS BIGINT) AS nb
  FROM steps s CROSS JOIN (SELECT unnest([{blocks}]) AS block_size) b GROUP BY {keys}, b.block_size),
drawn AS (
  SELECT z.*, n.null_id, md5(concat_ws('|', '42', n.null_id, z.block_size, {keytext})) AS h
  FROM sizes z CROSS JOIN (SELECT range - 1 AS null_id FROM range({n_nulls} + 1)) n),
seeds AS (
  SELECT {keys}, block_size, null_id, unnest(range(nb)) AS block, nb, greatest(1, (length(bin(nb - 1)) + 1) // 2) AS half,
         ('0x' || substr(h, 1, 7))::BIGINT AS k1, ('0x' || substr(h, 8, 7))::BIGINT AS k2,
         ('0x' || substr(h, 15, 7))::BIGINT AS k3, ('0x' || substr(h, 22, 7))::BIGINT AS k4 FROM drawn),
walked AS (
  SELECT {keys}, {seeded}, y AS x FROM ({first}) UNION ALL
  SELECT {keys}, {seeded}, y AS x FROM ({again})),
places AS (
  SELECT {keys}, block_size, null_id, block, x AS place FROM walked WHERE x < nb AND null_id >= 0
  UNION ALL SELECT {keys}, block_size, null_id, block, block FROM seeds WHERE null_id = -1),
paths AS (
  SELECT {keys}, p.block_size, p.null_id,
         sum(s.step) OVER (PARTITION BY {keys}, p.block_size, p.null_id ORDER BY p.place, s.pos ROWS UNBOUNDED PRECEDING) AS path
  FROM steps s JOIN places p USING ({keys}) WHERE (s.pos - 1) // p.block_size = p.block),
lifetimes AS (
  SELECT {keys}, block_size, null_id,
         greatest(0.0, max(path)) - least(0.0, min(path)) AS l
  FROM paths GROUP BY {keys}, block_size, null_id)"""

RECORD_SQL = """
obs AS (SELECT {cell}, l AS lobs FROM lifetimes WHERE null_id = -1),
mids AS (SELECT {cell}, median(l) AS med FROM lifetimes WHERE null_id >= 0 GROUP BY {cell}),
agg AS (
  SELECT {cell}, any_value(o.lobs) AS lobs, any_value(m.med) AS med, max(x.l) AS mx,
         median(abs(x.l - m.med)) AS dev, count(*) AS n,
         sum(CASE WHEN round(x.l, 9) >= round(o.lobs, 9) THEN 1 ELSE 0 END) AS ge,
         sum(CASE WHEN round(x.l, 9) < round(o.lobs, 9) THEN 1 ELSE 0 END) AS lt,
         sum(CASE WHEN x.l <= 1e-12 THEN 1 ELSE 0 END) AS zeros
  FROM lifetimes x JOIN obs o USING ({cell}) JOIN mids m USING ({cell})
  WHERE x.null_id >= 0 GROUP BY {cell}),
rec AS (
  SELECT {cell},
    round(lobs, 9) AS "Lobs", round(med, 9) AS null_med, round(mx, 9) AS null_max,
    round(lobs / (med + 1e-12), 6) AS "TSR",
    round(CAST(1 + ge AS DOUBLE) / (n + 1), 6) AS pperm,
    round(100.0 * CAST(lt AS DOUBLE) / n, 6) AS pct,
    round((lobs - med) / greatest(1.4826 * dev, 1e-6), 4) AS zrob,
    round(lobs - mx, 9) AS delta,
    round(CAST(zeros AS DOUBLE) / n, 6) AS zero_frac,
    (CAST(zeros AS DOUBLE) / n >= 0.7 AND lobs < 0.05) AS null_collapsed,
    dev <= 1e-6 / 1.4826 AS zrob_collapsed,
    (lobs - mx >= 1e-3 AND lobs >= 5 * mx) AS fallback,
    (lobs - mx >= 1e-3 AND lobs >= 5 * mx) AS separation_flag,
    CAST(1 + ge AS DOUBLE) / (n + 1) < 0.05 AS formal_trigger,
    (CAST(1 + ge AS DOUBLE) / (n + 1) < 0.05
      OR (lobs - mx >= 1e-3 AND lobs >= 5 * mx)) AS nominal_trigger
  FROM agg)"""


def extent_sql(keys: str, blocks: str, n_nulls: int) -> str:
    return EXTENT_SQL.format(
        keys=keys, keytext=keys, blocks=blocks, n_nulls=n_nulls, seeded=_SEEDED,
        first=_network("seeds", "block"), again=_network("(SELECT * FROM walked WHERE x >= nb)", "x"),
    )


@query(
    "perm_test_events",
    "WITH RECURSIVE " + STEPS_SQL + "," + extent_sql("user_id", "1", N_NULLS) + ","
    + RECORD_SQL.format(cell="user_id") + " SELECT * FROM rec",
)
def perm_test_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched-step permutation test of every user's walk."""
    steps, longest = event_walk_steps(spark, sf_dir)
    extents = walk_extents(steps, ["user_id"], N_NULLS, (1,), SEED, longest)
    return rounded_record(record_from_lifetimes(extents, ["user_id"], tie_digits=9))


@query(
    "block_perm_test",
    "WITH RECURSIVE " + STEPS_SQL + "," + extent_sql("user_id", "1, 5, 10, 20", N_NULLS) + ","
    + RECORD_SQL.format(cell="user_id, block_size") + """
    SELECT *, CASE WHEN block_size = 1
        THEN CASE WHEN formal_trigger THEN 'matched_step_trigger' ELSE 'matched_step_non_detection' END
        ELSE CASE WHEN formal_trigger THEN 'block_diagnostic_trigger'
                  ELSE 'block_diagnostic_non_trigger' END END AS decision
    FROM rec""",
)
def block_perm_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block-permutation diagnostics; only block size 1 is a formal test."""
    from wanderloop.operators.decisions import block_decision

    steps, longest = event_walk_steps(spark, sf_dir)
    extents = walk_extents(steps, ["user_id"], N_NULLS, BLOCKS, SEED, longest)
    record = rounded_record(record_from_lifetimes(extents, ["user_id", "block_size"], tie_digits=9))
    return record.withColumn("decision", block_decision(F.col("formal_trigger"), F.col("block_size")))
