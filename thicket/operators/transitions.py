"""Logs of status transitions as functions that compose.

A transition maps each of the seven statuses to the status after it, with what
it changes on the way and how many it refuses. Such maps compose in any
grouping, so a node's log is cut into parts of PART events, each part becomes
one map, and the maps of a node are composed again part by part, until one is
left. A node that holds a third of all events is so spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.ids import STATUSES
from thicket.operators.lifecycle import TRANSITIONS
from thicket.operators.numbering import numbered
from thicket.sources.store import checkpointed

#: Events, or maps, that become one map.
PART = 64
#: What a status turns into: the last closing and kept status with whether they were set, whether it was done, and counts.
_EFFECT = "status string, closes boolean, closed_at timestamp, keeps boolean, previous_status string, done boolean, moves long, refused long"


def _identity() -> Column:
    """Every status stays, nothing changes."""
    none = F.lit(None)
    return F.array(*[F.struct(F.lit(s).alias("status"), F.lit(False).alias("closes"), none.cast("timestamp").alias("closed_at"), F.lit(False).alias("keeps"), none.cast("string").alias("previous_status"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("moves"), F.lit(0).cast("long").alias("refused")) for s in STATUSES])


def _step(state: Column, event: Column) -> Column:
    """The state after one event (at, to): refused moves count; staying changes nothing."""
    table = F.create_map(*[F.lit(x) for a, targets in TRANSITIONS.items() for b in targets for x in (f"{a}>{b}", True)])
    was, to, at = state["status"], event["to"], event["at"]
    stays = was == to
    moves = ~stays & F.try_element_at(table, F.concat_ws(">", was, to)).isNotNull()
    ends, reopens, holds = moves & to.isin("done", "cancelled"), moves & was.isin("done", "cancelled") & (to == "open"), moves & to.isin("blocked", "invalidated")
    return F.struct(
        F.when(moves, to).otherwise(was).alias("status"),
        (state["closes"] | ends | reopens).alias("closes"),
        F.when(ends, at).when(~reopens, state["closed_at"]).alias("closed_at"),
        (state["keeps"] | holds).alias("keeps"),
        F.when(holds, was).otherwise(state["previous_status"]).alias("previous_status"),
        (state["done"] | (moves & (to == "done"))).alias("done"),
        (state["moves"] + moves.cast("long")).alias("moves"),
        (state["refused"] + (~stays & ~moves).cast("long")).alias("refused"),
    )


def _after(first: Column, then: Column) -> Column:
    """What a status turns into by one map and then another."""
    table = F.map_from_entries(F.transform(F.sequence(F.lit(0), F.lit(len(STATUSES) - 1)), lambda i: F.struct(F.element_at(F.array(*map(F.lit, STATUSES)), i + 1).alias("k"), F.element_at(then, i + 1).alias("v"))))

    def one(state: Column) -> Column:
        b = F.element_at(table, state["status"])
        return F.struct(
            b["status"].alias("status"),
            (state["closes"] | b["closes"]).alias("closes"),
            F.when(b["closes"], b["closed_at"]).otherwise(state["closed_at"]).alias("closed_at"),
            (state["keeps"] | b["keeps"]).alias("keeps"),
            F.when(b["keeps"], b["previous_status"]).otherwise(state["previous_status"]).alias("previous_status"),
            (state["done"] | b["done"]).alias("done"),
            (state["moves"] + b["moves"]).alias("moves"),
            (state["refused"] + b["refused"]).alias("refused"),
        )

    return F.transform(first, one)


def composed(log: DataFrame) -> DataFrame:
    """(node_id, effect): for each node the map of its whole log, an array by entry status in the order of STATUSES.

    ``log`` has (node_id, arrival, to, at); arrivals are whole numbers that
    differ within a node.
    """
    kind = f"array<struct<{_EFFECT.replace(' ', ':').replace(',:', ',')}>>"
    # a number within the node, from counts by ranges of arrivals
    rows = numbered(log.select("node_id", "arrival", "to", "at"), ["node_id"], ["arrival"], F.floor(F.col("arrival") / 100_000), "k", 0)
    maps = rows.groupBy("node_id", F.floor(F.col("k") / PART).alias("k")).agg(F.sort_array(F.collect_list(F.struct("arrival", "to", "at"))).alias("events"))
    maps = maps.select("node_id", "k", F.aggregate("events", _identity().cast(kind), lambda states, e: F.transform(states, lambda s: _step(s, e)).cast(kind)).alias("effect"))
    most = checkpointed(maps)
    while (most.agg(F.max("k")).first()[0] or 0) > 0:
        parts = most.groupBy("node_id", F.floor(F.col("k") / PART).alias("k")).agg(F.sort_array(F.collect_list(F.struct("k", "effect"))).alias("parts"))
        most = checkpointed(parts.select("node_id", "k", F.aggregate("parts", _identity().cast(kind), lambda a, p: _after(a, p["effect"]).cast(kind)).alias("effect")))
    return most.select("node_id", "effect")


def applied(nodes: DataFrame, log: DataFrame) -> DataFrame:
    """(id, status, previous_status, closed_at, progress, moves, refused) of live nodes after their logs, each from the status that it has.

    ``nodes`` may lack previous_status and closed_at.
    """
    was = lambda c, kind: F.col(c) if c in nodes.columns else F.lit(None).cast(kind)
    rows = nodes.filter("deleted_at is null").select("id", "status", was("previous_status", "string").alias("previous_status"), was("closed_at", "timestamp").alias("closed_at"), "progress")
    met = rows.join(composed(log).withColumnRenamed("node_id", "id"), "id", "left")
    e = F.element_at("effect", F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status")).cast("int"))
    done = met.withColumn("e", e)
    zero = F.lit(0).cast("long")
    return done.select(
        "id",
        F.coalesce("e.status", "status").alias("status"),
        F.when(F.col("e.keeps"), F.col("e.previous_status")).otherwise(F.col("previous_status")).alias("previous_status"),
        F.when(F.col("e.closes"), F.col("e.closed_at")).otherwise(F.col("closed_at")).alias("closed_at"),
        F.when(F.col("e.done"), 1.0).otherwise(F.col("progress")).alias("progress"),
        F.coalesce("e.moves", zero).alias("moves"),
        F.coalesce("e.refused", zero).alias("refused"),
    )
