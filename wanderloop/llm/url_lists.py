"""URL filters: dated list entries as validity intervals, and an as-of join of captures.

A list entry says from which day on a pattern of a list is blocked, allowed, or no longer
listed ("remove"). For each list and pattern the entries in order of days become intervals,
each ending where the next begins. A capture is looked up under every pattern that covers
its URL (host and parent domains, path prefixes, the URL itself) in the intervals that hold
on the day of the fetch. The most specific active entry decides, of equal ones an allowing
one.

Everything is a DataFrame operation. Entries of one pattern on one day are aggregated before
they move, so a pattern has at most as many rows as there are days. Intervals are cut by
month and spread over ``SALTS`` copies, captures carry their month and a salt: a host that
holds a third of all captures meets few intervals, in many tasks.

Captures or entries with a null pattern or day take no part in the join: a capture with a
null URL or day has no active entry. Of several entries on one day a block outranks an
allow, an allow a removal. Repeated captures get equal rows; extra columns pass through
(a column that has the name of a result is replaced); empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 8
RANK = {"remove": 0, "allow": 1, "block": 2}  # of entries on the same day
KINDS = {"host": 1, "prefix": 2, "url": 3}  # by how specific they are


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def patterns_of(url: Column) -> Column:
    """All (kind, pattern) that cover a URL: domains of two labels and more, prefixes that end in a slash, the URL."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    hosts = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.struct(F.lit("host").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")),
    )
    steps = F.split(path, "/")
    prefixes = F.when(
        F.size(steps) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(steps) - 1),
            lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.array_join(F.slice(steps, 1, i), "/"), F.lit("/")).alias("pattern")),
        ),
    ).otherwise(F.array().cast("array<struct<kind:string,pattern:string>>"))
    whole = F.array(F.struct(F.lit("url").alias("kind"), F.concat(host, path).alias("pattern")))
    return F.array_distinct(F.concat(hosts, prefixes, whole))


def validity(entries: DataFrame) -> DataFrame:
    """list_name, kind, pattern, verdict, from_day and to_day (null: open) of (list_name, kind, pattern, action, day)."""
    rank = F.create_map(*[F.lit(x) for pair in RANK.items() for x in pair])
    daily = (
        entries.filter(F.col("pattern").isNotNull() & F.col("day").isNotNull() & F.col("action").isin(*RANK))
        .groupBy("list_name", "kind", "pattern", "day").agg(F.max_by("action", rank[F.col("action")]).alias("verdict"))
    )
    after = F.lead("day").over(Window.partitionBy("list_name", "kind", "pattern").orderBy("day"))
    return daily.withColumn("to_day", after).filter("verdict <> 'remove'").withColumnRenamed("day", "from_day")


def month_of(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def active_entries(captures: DataFrame, intervals: DataFrame) -> DataFrame:
    """Per (url, day): the active entries, how many, which lists, and the one that decides."""
    ends = captures.agg(F.max("day")).first()[0]
    moments = captures.select("url", "day").filter("url is not null and day is not null").distinct()
    asked = moments.select("url", "day", F.explode(patterns_of(F.col("url"))).alias("p")).select(
        "url", "day", F.col("p.kind").alias("kind"), F.col("p.pattern").alias("pattern"),
        month_of(F.col("day")).alias("month"), F.pmod(F.xxhash64("url", "day"), F.lit(SALTS)).cast("int").alias("salt"),
    )
    # An open interval need not reach beyond the last capture.
    last = F.least(F.coalesce(F.date_sub("to_day", 1), F.lit(ends)), F.lit(ends))
    spread = (
        intervals.withColumn("last", last).filter("from_day <= last")
        .withColumn("month", F.explode(F.sequence(month_of(F.col("from_day")), month_of(F.col("last")))))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    met = asked.join(spread, ["kind", "pattern", "month", "salt"]).filter(
        (F.col("from_day") <= F.col("day")) & (F.col("day") <= F.col("last"))
    )
    order = F.struct(
        F.when(F.col("kind") == "host", KINDS["host"]).when(F.col("kind") == "prefix", KINDS["prefix"]).otherwise(KINDS["url"]),
        F.length("pattern"), (F.col("verdict") == "allow").cast("int"), F.col("pattern"), F.col("list_name"),
    )
    return met.groupBy("url", "day").agg(
        F.count(F.lit(1)).alias("n_active"), F.array_join(F.array_sort(F.collect_set("list_name")), ",").alias("lists"),
        F.max_by(F.struct("pattern", "verdict"), order).alias("_decides"),
    )


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "day") -> DataFrame:
    """The captures with n_active, lists, decided_by (the pattern) and blocked."""
    names = [c for c in captures.columns if c not in ("n_active", "lists", "decided_by", "blocked")]
    known = active_entries(captures.select(F.col(url).alias("url"), F.col(day).alias("day")), validity(entries)).select(
        F.col("url").alias("_url"), F.col("day").alias("_day"), "n_active", "lists", "_decides"
    )
    rows = captures.select(*[F.col(f"`{c}`") for c in names])
    return rows.join(known, (rows[url] == known["_url"]) & (rows[day] == known["_day"]), "left").select(
        *[rows[f"`{c}`"] for c in names], F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce("lists", F.lit("")).alias("lists"), F.coalesce(F.col("_decides.pattern"), F.lit("")).alias("decided_by"),
        F.coalesce(F.col("_decides.verdict") == "block", F.lit(False)).alias("blocked"),
    )
