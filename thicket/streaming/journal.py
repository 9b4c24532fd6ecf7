"""Consumers of the event log: tails, inboxes and their acknowledgements, rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tail(events: DataFrame, after: int, limit: int = 500, applied: DataFrame | None = None, origin: DataFrame | None = None) -> DataFrame:
    """Events past a cursor in order of arrival, with synced (came from the hub) and via_hook (made by a hook)."""
    rows = events.filter(F.col("arrival") > after)
    for name, other in (("synced", applied), ("via_hook", origin)):
        rows = rows.join(other.select("event_id", F.lit(True).alias(name)), "event_id", "left").withColumn(name, F.coalesce(name, F.lit(False))) if other is not None else rows.withColumn(name, F.lit(False))
    return rows.orderBy("arrival").limit(limit)


def inbox(comments: DataFrame, deliveries: DataFrame, cursors: DataFrame, acked: DataFrame) -> DataFrame:
    """(agent, seq): addressed comments and hook deliveries past each agent's cursor, without those acknowledged."""
    both = comments.select("agent", "seq").union(deliveries.select("agent", "seq")).distinct()
    past = both.join(cursors, "agent", "left").filter(F.col("seq") > F.coalesce("cursor", F.lit(-1))).select("agent", "seq")
    return past.join(acked.select("agent", "seq"), ["agent", "seq"], "left_anti")


def acked_through(acked: DataFrame, cursors: DataFrame, through: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cursors, acked) after agents acknowledge all up to a number: ``through`` has (agent, seq).

    Cursors never go back; acknowledgements at or below the new cursor are
    covered by it and go.
    """
    asked = through.groupBy("agent").agg(F.max("seq").alias("asked"))
    moved = cursors.join(asked, "agent", "full").select("agent", F.greatest("cursor", "asked").alias("cursor"))
    left = acked.join(moved, "agent", "left").filter("cursor is null or seq > cursor").select("agent", "seq")
    return moved, left


def closed_gaps(delivered: DataFrame, acked: DataFrame, cursors: DataFrame) -> DataFrame:
    """(agent, cursor): each cursor moved over what is delivered past it and acknowledged without a gap.

    The first delivered number that isn't acknowledged stops it: one minimum
    for each agent, not a walk.
    """
    past = delivered.join(cursors, "agent", "left").filter("cursor is null or seq > cursor").select("agent", "seq").distinct()
    open_ = past.join(acked.select("agent", "seq"), ["agent", "seq"], "left_anti").groupBy("agent").agg(F.min("seq").alias("first"))
    done = past.join(open_, "agent", "left").filter("first is null or seq < first").groupBy("agent").agg(F.max("seq").alias("done"))
    return cursors.join(done, "agent", "full").select("agent", F.greatest("cursor", "done").alias("cursor"))


def hourly_rates(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events of each node by hour, on a stream with a watermark or a table."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "node_id").agg(F.count("*").alias("n"))
