"""Status transitions, claims, numbering of new nodes, updates, agents and sessions, row by row outcomes in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.ids import TERMINAL

#: Allowed transitions by status, each target with its constraint.
TRANSITIONS = {
    "open": {"in_progress": "", "deferred": "", "cancelled": "", "blocked": "auto_only", "invalidated": "auto_only"},
    "in_progress": {"done": "", "deferred": "", "cancelled": "", "open": "requires_unclaim", "blocked": "auto_only", "invalidated": "auto_only"},
    "blocked": {"open": "auto_only", "in_progress": "auto_only", "cancelled": "", "invalidated": "auto_only"},
    "done": {"open": "requires_reopen", "invalidated": "auto_only"},
    "deferred": {"open": "", "in_progress": "requires_claim", "cancelled": "", "invalidated": "auto_only"},
    "cancelled": {"open": "requires_reopen", "invalidated": "auto_only"},
    "invalidated": {"open": "requires_restore", "in_progress": "requires_restore", "deferred": "requires_restore", "cancelled": ""},
}


def constraint(status: Column, to: Column) -> Column:
    """The transition's constraint, empty if free, null if it isn't allowed; staying is free."""
    table = F.create_map(*[F.lit(x) for a, targets in TRANSITIONS.items() for b, c in targets.items() for x in (f"{a}>{b}", c)])
    return F.when(status == to, "").otherwise(F.try_element_at(table, F.concat_ws(">", status, to)))


def transition(nodes: DataFrame, to: Column, now: str) -> DataFrame:
    """Applies a local transition to each row: progress 1 and closed_at when done, closed_at when cancelled or cleared; outcome says if it was allowed.

    Staying in a status and a refused transition change nothing. ``nodes`` may lack closed_at.
    """
    allowed = constraint(F.col("status"), to).isNotNull()
    moves = allowed & (F.col("status") != to)
    was = F.col("closed_at") if "closed_at" in nodes.columns else F.lit(None).cast("timestamp")
    return nodes.withColumns(
        {
            "outcome": F.when(allowed, "ok").otherwise("invalid_transition"),
            "progress": F.when(moves & (to == "done"), 1.0).otherwise(F.col("progress")),
            "closed_at": F.when(moves & to.isin("done", "cancelled"), F.lit(now).cast("timestamp")).when(~moves | ~allowed, was),
            "status": F.when(allowed, to).otherwise(F.col("status")),
        }
    )


def claim_outcome(now: str) -> Column:
    due = F.col("defer_until").isNull() | (F.col("defer_until") <= F.lit(now).cast("timestamp"))
    s = F.col("status")
    return F.when(s == "open", "claimed").when((s == "deferred") & due, "claimed").when(s == "deferred", "still_deferred").when(s == "in_progress", "already_claimed").when(s == "blocked", "blocked").otherwise("invalid_transition")


def unclaim(nodes: DataFrame, reason: str) -> DataFrame:
    """Running nodes that someone holds go back to open without an assignee; outcome says what happened. A reason is a must."""
    if not reason.strip():
        raise ValueError("a reason is required")
    held = (F.col("status") == "in_progress") & F.col("assignee").isNotNull()
    return nodes.withColumns({"outcome": F.when(held, "ok").otherwise("invalid_transition"), "status": F.when(held, "open").otherwise(F.col("status")), "assignee": F.when(~held, F.col("assignee"))})


def progress_set(nodes: DataFrame, values: DataFrame) -> DataFrame:
    """``nodes`` with the progress that ``values`` (id, value) sets directly; it must lie between 0 and 1."""
    if values.filter(~F.coalesce(F.col("value").between(0, 1), F.lit(False))).take(1):
        raise ValueError("progress lies between 0 and 1")
    return nodes.join(values.select("id", "value"), "id", "left").withColumn("progress", F.coalesce("value", "progress")).drop("value")


def dry_numbers(new: DataFrame, nodes: DataFrame) -> DataFrame:
    """What a decomposition would make: numbers after the count of live children, so they can differ from those that ``numbered`` gives."""
    many = nodes.filter("deleted_at is null").groupBy("parent_id").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("parent_id").orderBy("title"))
    return new.join(many, "parent_id", "left").withColumn("seq", F.coalesce("n", F.lit(0)) + rank).withColumn("id", F.concat_ws(".", "parent_id", "seq")).drop("n")


def reclaimable(nodes: DataFrame, agents: DataFrame, now: str, hours: int = 24) -> DataFrame:
    """Running nodes whose agent is gone or hasn't been heard of for so long."""
    heard = agents.select(F.col("agent_id").alias("assignee"), "last_heartbeat")
    old = F.col("last_heartbeat").isNull() | (F.col("last_heartbeat") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))
    return nodes.filter("deleted_at is null and status = 'in_progress' and assignee is not null").join(heard, "assignee", "left").filter(old).select("id", "assignee")


def numbered(new: DataFrame, nodes: DataFrame) -> DataFrame:
    """New children get the numbers after the last of their parent, in order of titles; a parent that has ended or is unknown takes none."""
    last = nodes.groupBy("parent_id").agg(F.max("seq").alias("last"))
    parents = nodes.filter("deleted_at is null").filter(~F.col("status").isin(TERMINAL)).select(F.col("id").alias("parent_id"))
    rank = F.row_number().over(Window.partitionBy("parent_id").orderBy("title"))
    return new.join(parents, "parent_id", "left_semi").join(last, "parent_id", "left").withColumn("seq", F.coalesce("last", F.lit(0)) + rank).withColumn("id", F.concat_ws(".", "parent_id", "seq")).drop("last")


def updated(nodes: DataFrame, changes: DataFrame, fields: list[str]) -> DataFrame:
    """``nodes`` with the non-null fields of ``changes`` by id, and changed (whether any was given)."""
    given = changes.select("id", *[F.col(f).alias(f"new_{f}") for f in fields])
    rows = nodes.join(given, "id", "left").withColumn("changed", F.coalesce(*[F.col(f"new_{f}").cast("string") for f in fields]).isNotNull())
    return rows.withColumns({f: F.coalesce(f"new_{f}", f) for f in fields}).drop(*[f"new_{f}" for f in fields])


def session_ends(sessions: DataFrame) -> DataFrame:
    """A session ends when its agent starts the next."""
    order = Window.partitionBy("agent_id").orderBy("started_at", "id")
    return sessions.select("id", "agent_id", "started_at", F.lead("started_at").over(order).alias("ended_at"))


def restored(nodes: DataFrame) -> DataFrame:
    """Invalidated nodes go back to where they were, if that can be reached, else to open."""
    back = F.when(constraint(F.lit("invalidated"), F.col("previous_status")).isNotNull() & ~F.col("previous_status").isin("invalidated"), F.col("previous_status")).otherwise("open")
    return nodes.withColumn("status", F.when(F.col("status") == "invalidated", back).otherwise(F.col("status")))
