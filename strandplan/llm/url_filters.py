"""URL filters: an as-of join of captures with the dated entries of host lists.

An entry says that from a day on a host pattern is blocked or allowed ("block", "allow") or no longer listed
("remove").  The entries of a list for one pattern, in order of their dates, become validity intervals [from, until);
of several entries for one day the strictest holds: block before allow before remove.  A capture is evaluated at its
fetch time: its host and the host's parent domains are looked up among the intervals that are valid then, and the
longest pattern decides, on a tie between lists "allow" before "block".  No entry: the capture passes.

Only DataFrame functions are used, and plain equality joins: the list may be of any size and none is broadcast by hand.
Each host is looked up once, however many captures it has, with at most ``LABELS`` patterns, as patterns have at most so
many labels.  The intervals of a host's patterns then travel as one row to its captures, where its fetch time chooses among
them.  Both joins are salted: short patterns, which many hosts share, by host, and captures by page_id, those without
a host by themselves; so neither a common ending nor a host of very many captures meets in one task.

Captures without a host (a null or malformed url) or without a fetch time match nothing and pass.  Entries with a null
list, pattern, day or action are ignored.  Captures that repeat are each returned.  An empty table of captures gives an
empty result, an empty list lets all pass; a url of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Labels that a pattern may have; longer ones can't match a host, which has at most 127.
LABELS = 127

#: Labels of patterns that many hosts share, and the salts of either join.
SHORT, SALTS = 2, 16

#: The default list: (list_name, pattern, day, action).
ENTRIES = [
    ("spam", "spam-farm.example.org", "2024-01-15", "block"),
    ("spam", "spam-farm.example.org", "2024-07-01", "remove"),
    ("spam", "spam-farm.example.org", "2024-09-01", "block"),
    ("spam", "cheap-pills.example.com", "2024-03-01", "block"),
    ("spam", "example.net", "2024-11-01", "block"),
    ("trusted", "blog.ththan.example.net", "2024-10-15", "allow"),
    ("trusted", "ththble.example.net", "2024-06-01", "allow"),
    ("trusted", "ththble.example.net", "2024-12-01", "remove"),
    ("adult", "thther.example.org", "2024-05-01", "block"),
    ("adult", "thther.example.org", "2024-05-01", "remove"),
    ("adult", "www.ththwh.example.org", "2024-02-01", "block"),
    ("trusted", "thther.example.org", "2024-08-01", "allow"),
]


def default_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTRIES, "list_name string, pattern string, day string, action string").withColumn("day", F.to_timestamp("day"))


def host(url: str | Column) -> Column:
    """The lower-case host of an absolute URL without user, port and closing dot; null if there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#@:]+)", 1)
    return F.nullif(F.regexp_replace(F.lower(found), r"\.+$", ""), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, pattern, action, valid_from, valid_until): when an entry holds; removals leave gaps."""
    strict = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).otherwise(0)
    known = entries.where("list_name IS NOT NULL AND pattern IS NOT NULL AND day IS NOT NULL AND action IS NOT NULL")
    daily = known.select("list_name", F.lower("pattern").alias("pattern"), "day", strict.alias("strict")).groupBy("list_name", "pattern", "day").agg(F.max("strict").alias("strict"))
    later = F.lead("day").over(Window.partitionBy("list_name", "pattern").orderBy("day"))
    action = F.when(F.col("strict") == 2, "block").when(F.col("strict") == 1, "allow")
    return daily.select("list_name", "pattern", action.alias("action"), F.col("day").alias("valid_from"), later.alias("valid_until")).where("action IS NOT NULL")


def verdicts(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row for each row of ``captures``(page_id, url, fetched_at): page_id, host, fetched_at, and of the entry that
    decides list_name, pattern, action and valid_from, all null without one; kept is false where the action is block."""
    lot = F.xxhash64("page_id", "url")
    salted = F.when(F.col("host").isNotNull(), F.pmod(lot, F.lit(SALTS))).otherwise(lot)
    rows = captures.select("page_id", "url", host("url").alias("host"), "fetched_at").select("page_id", "host", "fetched_at", salted.alias("salt"))
    known = by_host(rows.select("host"), intervals(entries)).select("*", F.explode(_salts()).alias("salt"))
    time = F.col("fetched_at")
    active = F.filter("intervals", lambda i: (i.valid_from <= time) & (i.valid_until.isNull() | (time < i.valid_until)))
    out = rows.join(known, ["host", "salt"], "left").withColumn("entry", F.array_max(active))
    entry = [F.col(f"entry.{c}").alias(c) for c in ("list_name", "pattern", "action", "valid_from")]
    return out.select("page_id", "host", "fetched_at", *entry, F.coalesce(F.col("entry.action") != "block", F.lit(True)).alias("kept"))


def _salts() -> Column:
    return F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))


def by_host(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """(host, intervals): of each host of ``rows`` with any, the intervals of its own and its parents' patterns.

    Of intervals that hold at a time the largest decides: the longest pattern, "allow" first, the last list.
    """
    labels = F.split("host", r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - (LABELS - 1))
    parents = F.transform(
        F.sequence(first, F.size(labels)),
        lambda k: F.struct(F.array_join(F.slice(labels, k, F.size(labels)), ".").alias("pattern"), (F.size(labels) - k < SHORT).alias("short")),
    )
    short = F.size(F.split("pattern", r"\.")) <= SHORT
    listed = listed.select("*", F.explode(F.when(short, _salts()).otherwise(F.array(F.lit(0).cast("long")))).alias("salt"))
    asked = rows.where("host IS NOT NULL").distinct().select("host", F.explode(parents).alias("p"))
    asked = asked.select("host", "p.pattern", F.when(F.col("p.short"), F.pmod(F.xxhash64("host"), F.lit(SALTS))).otherwise(F.lit(0)).alias("salt"))
    ranked = F.struct(F.length("pattern").alias("length"), (F.col("action") == "allow").alias("allowed"), "list_name", "pattern", "action", "valid_from", "valid_until")
    return asked.join(listed, ["pattern", "salt"]).groupBy("host").agg(F.collect_list(ranked).alias("intervals"))
