"""Applying the event log: all twelve kinds, with what they refer to found by uid first, else by path.

The log is folded set by set, not event by event. Of each node what counts is
what arrived after its first create and before its first delete. Fields that
have a last writer keep it (by clock, wall time, smallest machine hash, first
arrival) within their kind of event; a column that several kinds write has the
value that arrived last of those. All of it is maxima over structs, so a node
that a third of all events touch combines before the shuffle.

Payloads that don't parse give nulls; a priority that is no number isn't
written; events that no node answers to are left out, except that a link keeps
the path that it names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.ids import TERMINAL
from thicket.operators.events import once
from thicket.sources.store import kept

#: The fields an update may set.
FIELDS = ["title", "description", "prompt", "acceptance", "status", "priority", "labels", "assignee", "agent_state"]
#: What a payload may hold, by name.
PAYLOAD = ["field_name", "new_value", "to", "agent_id", "until", "depends_on_node_id", "dep_type", "prompt_text", "acceptance_text", "title", "description", "prompt", "acceptance", "assignee", "author_id", "body"]


def parsed(log: DataFrame) -> DataFrame:
    """The log with its JSON payload's members as columns ``p_...``, and no empty uid."""
    named = F.from_json("payload", ", ".join(f"`{n}` string" for n in PAYLOAD))
    rows = log.withColumn("p", named).withColumn("uid", F.nullif("uid", F.lit("")))
    return rows.select(*[c for c in rows.columns if c not in ("p", "payload")], *[F.col(f"p.{n}").alias(f"p_{n}") for n in PAYLOAD])


def created(rows: DataFrame) -> DataFrame:
    """A node for the first create on each path: id, uid (the event's own id where it carries none), and what the create says."""
    is_ = F.col("op_type") == "create_node"
    return rows.filter(is_).groupBy(F.col("node_id").alias("id")).agg(_first(is_).alias("f")).select("id", *_told())


def _first(when: Column) -> Column:
    """The first of these creates."""
    return F.min(F.when(when, F.struct("arrival", "event_id", "uid", "wall_ms", *[f"p_{n}" for n in ("title", "description", "prompt", "acceptance", "assignee")])))


def _told() -> list[Column]:
    said = [F.col(f"f.p_{n}").alias(f"c_{n}") for n in ("title", "description", "prompt", "acceptance", "assignee")]
    return [F.coalesce("f.uid", F.col("f.event_id").cast("string")).alias("node_uid"), F.col("f.arrival").alias("created"), F.col("f.wall_ms").alias("created_ms"), *said]


def found(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Events with the id, creation and deletion of the node they refer to: by uid where they carry one, else by path; only those that came while it lived."""
    keys = nodes.select("id", "node_uid", "created")
    later = rows.filter("op_type <> 'create_node'")
    by_uid = later.filter("uid is not null").join(keys, F.col("uid") == F.col("node_uid"))
    by_path = later.filter("uid is null").join(keys, F.col("node_id") == F.col("id"))
    own = by_uid.unionByName(by_path).filter("arrival > created")
    gone = own.filter("op_type = 'delete'").groupBy("id").agg(F.min(F.struct("arrival", "wall_ms", "author")).alias("gone"))
    return own.join(gone, "id", "left").filter("gone is null or arrival <= gone.arrival")


def _set(when: Column, value: Column) -> Column:
    """What the last of these events to arrive sets; the value may be null."""
    return F.max(F.when(when, F.struct("arrival", value.alias("value"))))


def _written(when: Column, value: Column) -> Column:
    """What the last writer of these events sets, and when that arrived."""
    turned = F.translate("machine", "0123456789abcdef", "fedcba9876543210")
    best = F.max(F.when(when, F.struct("lamport", "wall_ms", turned.alias("m"), (-F.col("arrival")).alias("back"), value.alias("value"))))
    return F.when(best.isNotNull(), F.struct((-best["back"]).alias("arrival"), best["value"].alias("value")))


def _folds() -> dict[str, Column]:
    """What the events of a node come to, by name: maxima over structs and a count."""
    op = F.col("op_type")
    text = F.lit(None).cast("string")
    fits = (F.col("p_field_name") != "priority") | F.col("p_new_value").try_cast("int").isNotNull()
    moves = op.isin("claim", "unclaim", "defer", "transition_status")
    state = F.when(op == "claim", "in_progress").when(op == "unclaim", "open").when(op == "defer", "deferred").otherwise(F.col("p_to"))
    closed = F.when(F.col("p_to").isin(*TERMINAL), F.col("wall_ms"))
    return {f"w_{f}": _written((op == "update_field") & (F.col("p_field_name") == f) & fits, F.col("p_new_value")) for f in FIELDS} | {
        "s_prompt": _written(op == "set_prompt", F.col("p_prompt_text")),
        "s_acceptance": _written(op == "set_acceptance", F.col("p_acceptance_text")),
        "s_status": _set(moves, state),
        "s_assignee": _set(op.isin("claim", "unclaim"), F.when(op == "claim", F.col("p_agent_id"))),
        "s_agent_state": _set(op.isin("claim", "unclaim"), F.when(op == "claim", "working").otherwise(text)),
        "defer_until": _set(op == "defer", F.col("p_until")),
        "closed": _set(op == "transition_status", closed),
        "comments": F.count_if(op == "comment"),
    }


def _state(whole: DataFrame, *more: str) -> DataFrame:
    """Nodes from what their creates say and what their events come to."""
    text = F.lit(None).cast("string")

    def value(name: str, first: Column, other: bool) -> Column:
        mine = F.greatest(F.col(f"w_{name}"), F.col(f"s_{name}")) if other else F.col(f"w_{name}")
        return F.when(mine.isNotNull(), mine["value"]).otherwise(first).alias(name)

    told = {n: F.col(f"c_{n}") for n in ("title", "description", "prompt", "acceptance", "assignee")}
    first = told | {"status": F.lit("open"), "priority": F.lit("3"), "labels": text, "agent_state": text}
    columns = [value(f, first[f], f in ("status", "prompt", "acceptance", "assignee", "agent_state")) for f in FIELDS]
    return whole.select("id", F.col("node_uid").alias("uid"), *columns, F.col("defer_until.value").alias("defer_until"), F.col("closed.value").alias("closed_ms"), "created_ms", "deleted_ms", F.coalesce("comments", F.lit(0)).alias("comments"), *more).withColumn("priority", F.col("priority").cast("int"))


def _by_path(rows: DataFrame) -> DataFrame:
    """The state by paths alone, with ``tidy``, ``called`` and ``there``; of a log with slices by slice and path.

    It is the replay's result if every path is ``tidy`` (its events came after
    its create, delete nothing and carry its node's uid or none), no node that
    is ``called`` by its uid shares it, and no path is in several slices. Links
    don't count: no node's state hangs on them.
    """
    later = F.col("op_type") != "create_node"
    by = ["slice"] if "slice" in rows.columns else []
    folds = _folds() | {"f": _first(F.col("op_type") == "create_node"), "came": F.min(F.when(later, F.col("arrival"))), "low": F.min(F.when(later, F.col("uid"))), "high": F.max(F.when(later, F.col("uid"))), "ended": F.count_if(F.col("op_type") == "delete")}
    found = rows.filter(~F.col("op_type").isin("link_dep", "unlink_dep")).groupBy(*by, F.col("node_id").alias("id")).agg(*[c.alias(n) for n, c in folds.items()]).select("*", *_told())
    own = (F.col("low") == F.col("node_uid")) & (F.col("high") == F.col("node_uid")) & F.col("node_uid").isNotNull()
    lives = F.col("id").isNotNull() & (F.col("ended") == 0) & (F.col("came").isNull() | (F.col("came") > F.col("created"))) & (F.col("high").isNull() | own)
    tidy = F.when(F.col("f").isNull(), F.col("high").isNull()).otherwise(F.coalesce(lives, F.lit(False)))
    return _state(found.withColumns({"deleted_ms": F.lit(None).cast("long"), "tidy": tidy, "called": F.col("high").isNotNull(), "there": F.col("f").isNotNull()}), "tidy", "called", "there")


def _all_tidy(state: DataFrame) -> bool:
    if state.filter("not tidy").take(1):
        return False
    # by hashes: two that are the same by chance only make the replay take the longer way
    each = state.select(F.explode(F.array(F.struct(F.xxhash64("id").alias("h"), F.lit(True).alias("path"), F.lit(True).alias("called")), F.when(F.col("there"), F.struct(F.xxhash64("uid").alias("h"), F.lit(False).alias("path"), F.col("called").alias("called"))))).alias("e")).filter("e is not null").select("e.*")
    # dealt first: there is next to nothing to combine, and a table of all that a task reads would fill it
    shared = each.repartition("path", "h").groupBy("path", "h").agg(F.count("*").alias("n"), F.bool_or("called").alias("called"))
    return not shared.filter("n > 1 and called").take(1)


def replay(log: DataFrame, backfilled: bool = False) -> DataFrame:
    """The state of every node that the log creates, deleted ones with ``deleted_ms``.

    Creates, references and deletions each read the log, so it is made and
    parsed once. Of a ``backfilled`` log, which holds each event once, what each
    path's events come to is looked at first: where they all are their own
    node's, as they should be, that is the result, and no event is joined.
    """
    if backfilled:
        state = kept(_by_path(parsed(log)))
        if _all_tidy(state):
            return state.filter("there").drop("tidy", "called", "there")
    rows = kept(parsed(log if backfilled else once(log)))
    nodes = created(rows)
    folded = found(rows, nodes).groupBy("id").agg(*[c.alias(n) for n, c in _folds().items()], F.max("gone.wall_ms").alias("deleted_ms"))
    return _state(nodes.join(folded, "id", "left"))


def annotations(log: DataFrame) -> DataFrame:
    """(id, event_id, author, text, at_ms) of each node's comments; by time, then event, they read in order."""
    rows = parsed(once(log))
    return found(rows, created(rows)).filter("op_type = 'comment'").select("id", "event_id", F.col("p_author_id").alias("author"), F.col("p_body").alias("text"), F.col("wall_ms").alias("at_ms"))


def _links_stay(rows: DataFrame) -> bool:
    """Whether no link's uid is that of a create on another path: then each link goes out from the path that it names, whatever lives there."""
    links = F.col("op_type") != "create_node"
    uid = F.when(links, F.col("uid")).otherwise(F.coalesce("uid", F.col("event_id").cast("string")))
    # uids by hashes: two that are the same by chance only make the replay take the longer way
    each = rows.select(F.xxhash64(uid).alias("h"), uid.alias("uid"), F.col("node_id").alias("path"), links.alias("link")).filter("uid is not null").drop("uid")
    paths = each.repartition("h").groupBy("h").agg(F.min("path").alias("low"), F.max("path").alias("high"), F.count_if(F.col("path").isNull()).alias("none"), F.bool_or("link").alias("link"))
    return not paths.filter("link and (low <> high or none > 0)").take(1)


def replay_edges(log: DataFrame, backfilled: bool = False) -> DataFrame:
    """(from_id, to_id, dep_type): edges whose last event by arrival links; unlinking without a type means ``blocks``.

    An edge goes out from the node that its event refers to while that lives,
    else from the path that the event names. In a ``backfilled`` log, which
    holds each event once, both should be the same, which is looked at first.
    """
    # not by isin, which Spark doesn't settle in advance where a kind hangs on a step
    links = (F.col("op_type") == "link_dep") | (F.col("op_type") == "unlink_dep")
    kind = F.coalesce(F.nullif("p_dep_type", F.lit("")), F.lit("blocks"))
    told = [F.col("p_depends_on_node_id").alias("to_id"), kind.alias("dep_type"), "arrival", "op_type"]
    if backfilled:
        # of creates nothing is parsed
        names = ["event_id", "node_id", "uid", "op_type", "arrival"]
        own = kept(parsed(log.filter(links)).select(*names, "p_depends_on_node_id", "p_dep_type").unionByName(log.filter("op_type = 'create_node'").select(*names).withColumn("uid", F.nullif("uid", F.lit(""))), allowMissingColumns=True))
        if _links_stay(own):
            return _linked(own.filter(links).select(F.col("node_id").alias("from_id"), *told))
    rows = kept(parsed(log if backfilled else once(log)))
    known = found(rows, created(rows)).filter(links).select("event_id", "id")
    return _linked(rows.filter(links).join(known, "event_id", "left").select(F.coalesce("id", "node_id").alias("from_id"), *told))


def _linked(named: DataFrame) -> DataFrame:
    last = named.groupBy("from_id", "to_id", "dep_type").agg(F.max(F.struct("arrival", "op_type")).alias("last"))
    return last.filter("last.op_type = 'link_dep'").select("from_id", "to_id", "dep_type")


def orphans(log: DataFrame) -> DataFrame:
    """Events that no node answers to, deletions aside: what a doctor's check for orphans lists."""
    rows = parsed(once(log))
    nodes = created(rows)
    later = rows.filter("op_type not in ('create_node', 'delete')")
    lost_uid = later.filter("uid is not null").join(nodes.select(F.col("node_uid").alias("uid")), "uid", "left_anti").select("event_id", "node_id")
    lost_path = later.filter("uid is null").join(nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti").select("event_id", "node_id")
    return lost_uid.union(lost_path)
