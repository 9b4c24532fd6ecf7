"""Filtered listings: or within a field, and across fields; deleted nodes never show."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.ids import natural, node_type, under


def live(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("deleted_at").isNull())


def clamp(limit: int) -> int:
    """A page's length: 50 if none is asked for, 500 at most."""
    return 50 if limit <= 0 else min(limit, 500)


#: Units of a duration, in nanoseconds, and the forms of a time.
UNITS = {"ns": 1, "us": 10**3, "µs": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}
FORMS = ["%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d"]


def changed_since(text: str, now: datetime) -> datetime | None:
    """A point in time from a duration before ``now`` (1h30m), or a date or time; None if nothing is given, an error if it can't be read or isn't before."""
    text = text.strip()
    if not text:
        return None
    parts = re.findall(r"([0-9]+\.?[0-9]*|\.[0-9]+)(ns|us|µs|ms|s|m|h)", text)
    if parts and "".join(a + b for a, b in parts) == text.lstrip("+-"):
        nanos = sum(float(a) * UNITS[b] for a, b in parts)
        if nanos <= 0 or text.startswith("-"):
            raise ValueError(f"the duration must be positive: {text}")
        return now - timedelta(microseconds=nanos / 1000)
    for form in FORMS:
        try:
            found = datetime.strptime(text, form)
        except ValueError:
            continue
        return found.astimezone(timezone.utc).replace(tzinfo=None) if found.tzinfo else found
    raise ValueError(f"neither a time nor a duration: {text}")


def project_scope(project: str, all_projects: bool, primary: str = "") -> str:
    """The project to read: all (empty), the one named, or the primary one; both at once is an error."""
    if project and all_projects:
        raise ValueError("a project and all projects exclude each other")
    return "" if all_projects else project or primary


def by_uid(nodes: DataFrame, uid: str) -> DataFrame:
    """The live node of a uid: its path."""
    found = live(nodes).filter(F.col("uid") == uid).select("id", "uid").limit(1)
    if not found.take(1):
        raise LookupError(f"uid {uid} not found")
    return found


def with_uids(rows: DataFrame, nodes: DataFrame, column: str = "id") -> DataFrame:
    """``rows`` with the uid of the live node on each path, null where there is none."""
    known = live(nodes).select(F.col("id").alias(column), "uid")
    return rows.join(known, column, "left")


def split_csv(text: str) -> list[str]:
    return [p.strip() for p in text.split(",") if p.strip()]


def where(status=(), under_any=(), assignee=(), types=(), priority=(), labels=(), project: str = "", since: str | None = None) -> Column:
    """One predicate from all filters; an empty filter lets everything pass. Labels must all be there."""
    tests = [F.lit(True)]
    tests += [F.col(c).isin(list(v)) for c, v in (("status", status), ("assignee", assignee), ("priority", priority)) if v]
    if types:
        tests.append(node_type(F.col("depth")).isin(list(types)))
    if under_any:
        tests.append(reduce(lambda a, b: a | b, [under(F.col("id"), u) for u in under_any]))
    tests += [F.array_contains("labels", label) for label in labels]
    if project:
        tests.append(F.col("project") == project)
    if since:
        tests.append(F.col("updated_at") > F.lit(since).cast("timestamp"))
    return reduce(lambda a, b: a & b, tests)


def list_nodes(nodes: DataFrame, **filters) -> DataFrame:
    return live(nodes).filter(where(**filters))


def get_node(nodes: DataFrame, id_: str) -> DataFrame:
    found = live(nodes).filter(F.col("id") == id_).limit(1)
    if not found.take(1):
        raise LookupError(f"node {id_} not found")
    return found


def page(nodes: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """By priority, then age; the id breaks ties, so pages don't overlap. Limit 0 asks for no rows, only for the total."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset can't be negative")
    return live(nodes).orderBy("priority", "created_at", "id").offset(offset).limit(min(limit, 500))


def page_info(nodes: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One row: total of the listing, how many rows the page holds, and whether more follow."""
    total = F.count("*")
    length = F.least(F.greatest(total - offset, F.lit(0)), F.lit(min(limit, 500)))
    return live(nodes).agg(total.alias("total"), length.alias("rows"), (length + offset < total).alias("has_more"))


def ready(nodes: DataFrame, now: str) -> DataFrame:
    """Unassigned and open, or deferred until a time that has come (or none); trusts the status."""
    due = (F.col("status") == "deferred") & (F.col("defer_until").isNull() | (F.col("defer_until") <= F.lit(now).cast("timestamp")))
    return live(nodes).filter(F.col("assignee").isNull() & ((F.col("status") == "open") | due))


def ready_strict(nodes: DataFrame, edges: DataFrame, now: str) -> DataFrame:
    """Ready and without an unresolved blocker."""
    from thicket.operators.graph import blockers

    return ready(nodes, now).join(blockers(nodes, edges).select(F.col("to_id").alias("id")), "id", "left_anti")


def roots(nodes: DataFrame) -> DataFrame:
    return live(nodes).filter(F.col("parent_id").isNull())


def natural_order(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(natural(F.col("id")))


def project_fields(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """The asked columns once each; an unknown name is an error that lists the known ones."""
    wrong = [f for f in fields if f not in nodes.columns]
    if wrong:
        raise ValueError(f"unknown fields {wrong}; known are {sorted(nodes.columns)}")
    return nodes.select(*dict.fromkeys(fields))


def stale_agents(agents: DataFrame, now: str, hours: int = 24) -> DataFrame:
    return agents.filter(F.col("last_heartbeat") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS"))


def stuck_agents(agents: DataFrame, now: str, hours: int) -> DataFrame:
    """Agents stuck for longer than so many hours; 0 switches the check off."""
    return agents.filter(F.lit(hours > 0) & (F.col("state") == "stuck") & (F.col("last_heartbeat") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")))


def expired_tombstones(nodes: DataFrame, now: str, days: int = 30) -> DataFrame:
    return nodes.filter(F.col("deleted_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def to_wake(nodes: DataFrame, now: str) -> DataFrame:
    return live(nodes).filter((F.col("status") == "deferred") & (F.col("defer_until") < F.lit(now).cast("timestamp")))


def timed_out_sessions(sessions: DataFrame, now: str, hours: int = 4) -> DataFrame:
    return sessions.filter((F.col("status") == "active") & (F.col("started_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS")))
