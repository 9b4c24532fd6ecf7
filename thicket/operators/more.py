"""Smaller operators: outbox, provisional ids, nested trees, sync state and advice, emission, agents, annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.ids import natural, provisional
from thicket.operators.events import sanitised_author
from thicket.operators.listing import live
from thicket.operators.numbering import numbered

#: The columns of a stored row that are JSON or times.
DECODED = {"labels": "array<string>", "commit_refs": "array<string>", "annotations": "array<struct<id:string,author:string,text:string,created_at:timestamp,resolved:boolean,addressee:string>>", "activity": "array<struct<id:string,type:string,author:string,text:string,created_at:timestamp,metadata:string>>"}


#: Failures in a row after which a hub counts as out of reach; what to do by state.
ERRORS = 3
ADVICE = {"solo": ["stay_solo", "init"], "sync-configured-no-hub": ["init", "clone"], "sync-active": ["carry_on"], "divergent-pending": ["list_conflicts", "resolve_conflicts"], "hub-unreachable": ["doctor", "check_tls"]}


def decoded(rows: DataFrame) -> DataFrame:
    """Stored rows with JSON columns parsed, *_at columns as times, and empty text as null for references."""
    json = {c: F.from_json(c, t) for c, t in DECODED.items() if c in rows.columns}
    times = {c: F.to_timestamp(c) for c, t in rows.dtypes if t == "string" and (c.endswith("_at") or c == "defer_until")}
    return rows.withColumns(json | times | {c: F.nullif(c, F.lit("")) for c in ("parent_id", "uid", "assignee") if c in rows.columns})


def pending(events: DataFrame, limit: int) -> DataFrame:
    """Events that wait to be pushed, by clock."""
    return events.filter("sync_status = 'pending'").orderBy("lamport", "event_id").limit(limit)


def unsettled(nodes: DataFrame) -> DataFrame:
    """Live nodes with a provisional id whose parent has none, shallow first."""
    return live(nodes).filter(provisional(F.col("id")) & (F.col("parent_id").isNull() | ~provisional(F.col("parent_id")))).orderBy("depth", "id")


def node_progress(nodes: DataFrame) -> DataFrame:
    """Each node's progress, its live children and how many of them carry ``invalidated_at``, whatever their status."""
    kids = live(nodes).filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"), F.count("invalidated_at").alias("invalidated"))
    none = F.lit(0).cast("long")
    return live(nodes).select("id", "progress", "status").join(kids, "id", "left").withColumns({c: F.coalesce(c, none) for c in ("children", "invalidated")})


def printed_tree(nodes: DataFrame) -> DataFrame:
    """id and its line, indented by depth; in natural order a tree reads from top to bottom."""
    return live(nodes).orderBy(natural(F.col("id"))).select("id", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("id"), F.lit(" ["), F.col("status"), F.lit("] "), F.col("title")).alias("line"))


def activity_slice(nodes: DataFrame, offset: int, limit: int) -> DataFrame:
    return nodes.select("id", F.slice("activity", offset + 1, limit).alias("activity"))


def sync_counts(events: DataFrame, now_ms: int) -> DataFrame:
    """One row: events by state, and how many wait for over an hour."""
    state = F.col("sync_status")
    return events.agg(*[F.count_if(state == s).alias(s) for s in ("pending", "pushed", "applied", "conflicted")], F.count_if((state == "pending") & (F.col("wall_ms") < now_ms - 3_600_000)).alias("stuck"))


def sync_state(has_hub: Column, machine: Column, errors: Column, local: Column, applied: Column, conflicts: Column) -> Column:
    """The state that asks for most, in order: open conflicts, no hub, a hub that keeps failing, a sync that runs, one that hasn't begun."""
    runs = ((local > 0) | (applied > 0)) & (F.coalesce(machine, F.lit("")) != "")
    return F.when(conflicts > 0, "divergent-pending").when(~has_hub, "solo").when(errors >= ERRORS, "hub-unreachable").when(runs, "sync-active").otherwise("sync-configured-no-hub")


def recommended(state: Column, nodes: Column, local: Column) -> Column:
    """Names of what to do in a state, in order; a store with nodes but no event of its own should fill its log first."""
    table = F.create_map(*[x for s, names in ADVICE.items() for x in (F.lit(s), F.array(*map(F.lit, names)))])
    fill = (state == "sync-configured-no-hub") & (nodes > 0) & (local == 0)
    return F.concat(F.try_element_at(table, state), F.when(fill, F.array(F.lit("backfill"))).otherwise(F.array().cast("array<string>")))


def emitted(changes: DataFrame, last: int, pending: int = 0, most: int = 0) -> DataFrame:
    """Changes as events of one store: authors in plain form, one clock that goes on from ``last`` over all authors, and each author's own count.

    Changes come in order of ``at`` (a time), node and kind. Numbers are given
    hour by hour, and the hours' counts added up, so no task sees the whole log.
    A queue that already holds ``most`` waiting events (0: any number) refuses.
    """
    if most and pending >= most:
        raise ValueError(f"{pending} events wait, {most} may")
    rows = changes.withColumn("author", sanitised_author(F.col("author")))
    hour, order = F.date_trunc("hour", "at"), ["at", "node_id", "op_type"]
    return numbered(numbered(rows, [], order, hour, "lamport", last + 1), ["author"], order, hour, "author_clock")


def registry_with_epochs(creates: DataFrame) -> DataFrame:
    """As the registry, but a first claim of an older restore epoch makes a collision, not a renumbering."""
    first = creates.groupBy("node_id").agg(F.min(F.struct("arrival", "uid", "epoch")).alias("f"))
    outcome = F.when(F.col("arrival") == F.col("f.arrival"), "free").when(F.col("uid") == F.col("f.uid"), "noop").when(F.col("epoch") == F.col("f.epoch"), "renumber").otherwise("collision")
    return creates.join(first, "node_id").select("event_id", "node_id", outcome.alias("outcome"))


def agent_states(log: DataFrame) -> DataFrame:
    """Each agent's latest state and heartbeat, from (agent_id, at, state or null)."""
    return log.groupBy("agent_id").agg(F.max_by("state", F.when(F.col("state").isNotNull(), F.col("at"))).alias("state"), F.max("at").alias("last_heartbeat"))


def bulk_outcomes(changes: DataFrame, nodes: DataFrame, most: int = 100) -> DataFrame:
    """(id, outcome) of each asked change: updated, not_found, or nothing_given."""
    if changes.count() > most:
        raise ValueError(f"at most {most} rows at once")
    known = live(nodes).select("id", F.lit(True).alias("known"))
    fields = [c for c in changes.columns if c != "id"]
    given = F.coalesce(*[F.col(f).cast("string") for f in fields]).isNotNull()
    return changes.join(known, "id", "left").select("id", F.when(F.col("known").isNull(), "not_found").when(~given, "nothing_given").otherwise("updated").alias("outcome"))


def resolved(annotations: Column, annotation_id: str) -> Column:
    return F.transform(annotations, lambda a: F.when(a["id"] == annotation_id, a.withField("resolved", F.lit(True))).otherwise(a))
