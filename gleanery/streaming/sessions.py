"""Bursts, silences and replay of events, in batch and in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import kept


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def bursts(events: DataFrame, gap: str, ts: str = "ts") -> DataFrame:
    """first_ts, last_ts and n_events of runs of events less than `gap` apart: what a trailing-edge debounce acts on once.

    Works on streams too, given a watermark on `ts`. A table's events are first counted by cells of time as long as the gap, whose
    events all belong together, and cells are joined in blocks of as many each; what a block begins with may belong to a run
    from an earlier one.
    """
    if not events.isStreaming:
        return _bursts(events, gap, ts)
    return events.groupBy(F.session_window(ts, gap).alias("burst")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_events"))


#: Cells of time in a block.
CELLS = 4096


def _bursts(events: DataFrame, gap: str, ts: str) -> DataFrame:
    apart = micros(F.expr(f"timestamp_ntz'1970-01-01 00:00:00' + interval '{gap}'"))
    at = F.floor(micros(F.col(ts)) / apart)
    cells = events.where(F.col(ts).isNotNull()).groupBy(at.alias("cell")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n_events"))
    cells = kept(cells.withColumn("block", F.floor(F.col("cell") / CELLS)), "cells")
    own, blocks = Window.partitionBy("block").orderBy("cell"), Window.orderBy("block")  # a row a block
    ends = cells.groupBy("block").agg(F.max("last_ts").alias("end")).select("block", F.lag("end").over(blocks).alias("before"))
    last = F.coalesce(F.lag("last_ts").over(own), F.col("before"))
    new = last.isNull() | (micros(F.col("first_ts")) - micros(last) >= apart)
    marked = cells.join(ends, "block").withColumn("new", new)
    marked = kept(marked.withColumn("start", F.max(F.when(F.col("new"), F.col("first_ts"))).over(own)).drop("before", "new"), "marked")
    earlier = F.max("start").over(blocks.rowsBetween(Window.unboundedPreceding, -1))
    starts = marked.groupBy("block").agg(F.max("start").alias("start")).select("block", earlier.alias("earlier"))
    begun = marked.join(starts, "block").withColumn("start", F.coalesce("start", "earlier"))
    return begun.groupBy("start").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("n_events").alias("n_events")).drop("start")


def silences(events: DataFrame, by: str, interval_seconds: int, ts: str = "ts") -> DataFrame:
    """Events that follow a silence of at least twice the interval: after such a one a full reconcile is due at once."""
    order = Window.partitionBy(by).orderBy(ts, "event_id")
    gap = micros(F.col(ts)) - micros(F.lag(ts).over(order))
    return events.withColumn("gap_us", gap).where(F.col("gap_us") >= 2 * interval_seconds * 1_000_000)


def replay(events: DataFrame, last_seen: int, kept: int = 128) -> DataFrame:
    """Of the last `kept` events those after last_seen, or all of them if some that were not seen are gone."""
    ring = events.orderBy(F.desc("event_id")).limit(kept)
    oldest = ring.agg(F.min("event_id").alias("oldest"))
    return ring.crossJoin(F.broadcast(oldest)).where((F.col("event_id") > last_seen) | (F.lit(last_seen) < F.col("oldest") - 1)).drop("oldest")  # one row
