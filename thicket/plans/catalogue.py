"""The named queries over the test tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import clocks, ids
from thicket.operators import aggregates, events, graph, hierarchy, integrity, lifecycle, listing, text
from thicket.plans import applied, deeper, history
from thicket.sources.store import bounded, pieces, stored
from thicket.sources.views import NOW, oracle, oracle_recursive, view
from thicket.streaming import hooks, journal

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
LIVE = "deleted_at IS NULL"
TERMINAL = "('done', 'cancelled', 'invalidated')"
ROOT, CUSTOMER = "R0-1", "R1-2"
LATE = "2024-01-20 00:00:00"
LATE_MS = 1_705_708_800_000


def _add(name: str, views: str, sql: str | None, recursive: bool = False):
    """Registers a function of the named views as a query."""
    names = views.split()

    def wrap(f):
        _QUERIES[name] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in names])
        if sql is not None:
            _SQL[name] = (oracle_recursive if recursive else oracle)(sql, *names)
        return f

    return wrap


def _with_labels(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("labels", F.array_compact(F.array("label")))


def _filtered(name: str, sql: str, columns: str = "id, status, priority", **filters) -> None:
    _add(name, "nodes", f"SELECT {columns} FROM nodes WHERE {LIVE} AND {sql}")(lambda n: listing.list_nodes(_with_labels(n), **filters).select(*columns.split(", ")))


# listings
_filtered("list_status_multi", "status IN ('blocked', 'in_progress', 'deferred')", status=["blocked", "in_progress", "deferred"])
_filtered("list_under_multi", "(id = 'R0-1' OR starts_with(id, 'R0-1.') OR id = 'R3-8' OR starts_with(id, 'R3-8.'))", under_any=["R0-1", "R3-8"])
_filtered("list_priority_type", "priority IN (1, 2) AND depth IN (1, 2)", types=["story", "issue"], priority=[1, 2])
_filtered("list_labels_all", "label = 'BUILDING' AND project = 'R2'", labels=["BUILDING"], project="R2")
_filtered("list_changed_since", "updated_at > TIMESTAMP '2001-01-01 00:00:00'", since="2001-01-01 00:00:00")
_filtered("list_assignee", "assignee IN ('agent-1', 'agent-2')", columns="id, assignee", assignee=["agent-1", "agent-2"])

_add("get_node", "nodes", f"SELECT id, title, depth FROM nodes WHERE {LIVE} AND id = 'R0-1'")(lambda n: listing.get_node(n, ROOT).select("id", "title", "depth"))
_add("list_page", "nodes", f"SELECT id, priority FROM nodes WHERE {LIVE} ORDER BY priority, created_at, id LIMIT 50 OFFSET 100")(lambda n: listing.page(n, listing.clamp(0), 100).select("id", "priority"))
_add("ready", "nodes", f"SELECT id, status, priority FROM nodes WHERE {LIVE} AND assignee IS NULL AND (status = 'open' OR status = 'deferred' AND (defer_until IS NULL OR defer_until <= TIMESTAMP '{NOW}'))")(
    lambda n: listing.ready(n, NOW).select("id", "status", "priority").orderBy("priority", "id")
)
_add("ready_strict", "nodes edges", f"SELECT id FROM nodes n WHERE {LIVE} AND assignee IS NULL AND status = 'open' AND NOT EXISTS (SELECT 1 FROM edges e JOIN nodes b ON b.id = e.from_id WHERE e.to_id = n.id AND b.{LIVE} AND b.status NOT IN {TERMINAL})")(
    lambda n, e: listing.ready_strict(n, e, NOW).select("id")
)
_add("blocked", "nodes edges", f"SELECT DISTINCT e.to_id AS id FROM edges e JOIN nodes b ON b.id = e.from_id WHERE b.{LIVE} AND b.status NOT IN {TERMINAL}")(lambda n, e: graph.blockers(n, e).select(F.col("to_id").alias("id")).distinct())
_add("roots", "nodes", f"SELECT id, title FROM nodes WHERE {LIVE} AND parent_id IS NULL")(lambda n: listing.roots(n).select("id", "title"))
_add("stale_agents", "agents", f"SELECT agent_id, state FROM agents WHERE last_heartbeat < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR")(lambda a: listing.stale_agents(a, NOW).select("agent_id", "state"))
_add("stuck_agents", "agents", f"SELECT agent_id FROM agents WHERE state = 'stuck' AND last_heartbeat < TIMESTAMP '{NOW}' - INTERVAL 1 HOUR")(lambda a: listing.stuck_agents(a, NOW, 1).select("agent_id"))
_add("expired_tombstones", "nodes", f"SELECT id FROM nodes WHERE deleted_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY")(lambda n: listing.expired_tombstones(n, NOW).select("id"))
_add("wake_deferred", "nodes", f"SELECT id FROM nodes WHERE {LIVE} AND status = 'deferred' AND defer_until < TIMESTAMP '{NOW}'")(lambda n: listing.to_wake(n, NOW).select("id"))
_add("session_timeouts", "sessions", f"SELECT id, agent_id FROM sessions WHERE status = 'active' AND started_at < TIMESTAMP '{NOW}' - INTERVAL 4 HOUR")(lambda s: listing.timed_out_sessions(s, NOW).select("id", "agent_id"))

# aggregates
for _key in ("status", "priority", "depth"):
    _add(f"stats_by_{_key}", "nodes", f"SELECT CAST({_key} AS VARCHAR) AS key, count(*) AS n FROM nodes WHERE {LIVE} GROUP BY 1")(lambda n, k=_key: aggregates.stats_by(n, k))
_add("stats_weighted_progress", "nodes", f"SELECT count(*) AS total, round(sum(progress * weight) / sum(weight), 6) AS progress FROM nodes WHERE {LIVE}")(aggregates.weighted_progress)
_add("stats_subtree", "nodes", f"SELECT count(*) AS total, round(sum(progress * weight) / sum(weight), 6) AS progress FROM nodes WHERE {LIVE} AND (id = 'R0-1' OR starts_with(id, 'R0-1.'))")(lambda n: aggregates.weighted_progress(n.filter(ids.under(F.col("id"), ROOT))))
_add("status_domain_counts", "nodes", f"SELECT s AS status, count(n.id) AS n, round(count(n.id) / (SELECT count(*) FROM nodes WHERE deleted_at IS NULL), 6) AS share FROM (VALUES ('open'), ('in_progress'), ('blocked'), ('done'), ('deferred'), ('cancelled'), ('invalidated')) d(s) LEFT JOIN (SELECT * FROM nodes WHERE {LIVE}) n ON n.status = s GROUP BY 1")(aggregates.status_counts)
_add("projects", "nodes", f"SELECT project, count(*) AS n FROM nodes WHERE {LIVE} GROUP BY 1")(aggregates.projects)
_add("child_counts", "nodes", f"SELECT parent_id, count(*) AS n FROM nodes WHERE {LIVE} AND parent_id IS NOT NULL GROUP BY 1")(aggregates.child_counts)
_add("session_counts", "nodes", "SELECT session_id, count(*) AS created, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'deferred') AS deferred FROM nodes WHERE session_id IS NOT NULL GROUP BY 1")(aggregates.session_counts)
_add("max_seq", "nodes", f"SELECT project, coalesce(parent_id, '') AS parent, max(seq) AS last FROM nodes WHERE {LIVE} GROUP BY 1, 2")(aggregates.max_seq)
_add("progress_mismatch", "nodes", f"SELECT n.id, n.progress, round(m.e, 6) AS expected FROM nodes n JOIN (SELECT parent_id, sum(progress * weight) / sum(weight) AS e FROM nodes WHERE {LIVE} AND status NOT IN ('cancelled', 'invalidated') AND parent_id IS NOT NULL GROUP BY 1) m ON m.parent_id = n.id WHERE n.{LIVE} AND abs(n.progress - m.e) > 0.01")(
    aggregates.progress_mismatch
)
_add("event_counts", "ev", "SELECT op_type, count(*) AS n, min(lamport) AS first, max(lamport) AS last FROM ev GROUP BY 1")(aggregates.event_counts)

# hierarchy
_add("tree_depth", "nodes", f"SELECT id, depth, seq FROM nodes WHERE {LIVE} AND (id = 'R0-1' OR starts_with(id, 'R0-1.')) AND depth <= 2")(lambda n: hierarchy.tree(n, ROOT, 2).select("id", "depth", "seq").orderBy("depth", "seq", "id"))
_add(
    "ancestors",
    "nodes",
    f"SELECT n.id, a.id AS ancestor_id, CAST(a.depth AS BIGINT) AS level FROM (SELECT id, unnest([array_to_string(string_split(id, '.')[1:k], '.') FOR k IN range(1, len(string_split(id, '.')) + 1)]) AS p FROM nodes WHERE {LIVE}) n JOIN nodes a ON a.id = n.p WHERE a.{LIVE}",
)(hierarchy.with_ancestors)
_MEAN = "coalesce(sum(CASE WHEN status NOT IN ('cancelled', 'invalidated') THEN progress * weight END) / nullif(sum(CASE WHEN status NOT IN ('cancelled', 'invalidated') THEN weight END), 0), 0.0)"
_add(
    "progress_rollup",
    "nodes",
    f"WITH l AS (SELECT * FROM nodes WHERE {LIVE}), p3 AS (SELECT id, parent_id, status, weight, progress FROM l WHERE depth = 3), m2 AS (SELECT parent_id AS id, {_MEAN} AS m FROM p3 GROUP BY 1), p2 AS (SELECT l.id, parent_id, status, weight, coalesce(m, progress) AS progress FROM l LEFT JOIN m2 USING (id) WHERE depth = 2), m1 AS (SELECT parent_id AS id, {_MEAN} AS m FROM p2 GROUP BY 1), p1 AS (SELECT l.id, parent_id, status, weight, coalesce(m, progress) AS progress FROM l LEFT JOIN m1 USING (id) WHERE depth = 1), m0 AS (SELECT parent_id AS id, {_MEAN} AS m FROM p1 GROUP BY 1), p0 AS (SELECT l.id, parent_id, status, weight, coalesce(m, progress) AS progress FROM l LEFT JOIN m0 USING (id) WHERE depth = 0) SELECT id, round(progress, 6) AS progress FROM (SELECT id, progress FROM p0 UNION ALL SELECT id, progress FROM p1 UNION ALL SELECT id, progress FROM p2 UNION ALL SELECT id, progress FROM p3) x",
)(lambda n: hierarchy.rollup(n).select("id", F.round("progress", 6).alias("progress")))
_MOVED = "CASE WHEN {c} = 'R0-1' OR starts_with({c}, 'R0-1.') THEN 'R9-77' || substr({c}, 5) ELSE {c} END"
_add("renumber_subtree", "nodes edges", f"SELECT {_MOVED.format(c='id')} AS id, {_MOVED.format(c='parent_id')} AS parent_id FROM nodes")(lambda n, e: hierarchy.renumber(n, e, ROOT, "R9-77")[0].select("id", "parent_id"))
_add("renumber_edges", "nodes edges", f"SELECT {_MOVED.format(c='from_id')} AS from_id, {_MOVED.format(c='to_id')} AS to_id FROM edges")(lambda n, e: hierarchy.renumber(n, e, ROOT, "R9-77")[1].select("from_id", "to_id"))
_add("rename_prefix", "nodes", "SELECT id, CASE WHEN starts_with(id, 'R1-') THEN 'NEW' || substr(id, 3) ELSE id END AS new_id FROM nodes")(lambda n: n.select("id", hierarchy.renamed_prefix(F.col("id"), "R1", "NEW").alias("new_id")))
_add("import_as", "nodes", "WITH r AS (SELECT id AS root, row_number() OVER (ORDER BY id) AS k FROM nodes WHERE project = 'R1' AND parent_id IS NULL) SELECT id, 'R0-1.' || k || substr(id, length(root) + 1) AS new_id FROM nodes JOIN r ON string_split(id, '.')[1] = root WHERE project = 'R1'")(lambda n: hierarchy.import_as(n, "R1", ROOT))
_add("cascade_delete", "nodes", f"SELECT count(*) AS deleted FROM nodes WHERE deleted_at IS NOT NULL OR id = 'R0-1' OR starts_with(id, 'R0-1.')")(lambda n: hierarchy.delete_cascade(n, ROOT, NOW).filter("deleted_at is not null").agg(F.count("*").alias("deleted")))
_add("cascade_cancel", "nodes", f"SELECT id, CASE WHEN {LIVE} AND (id = 'R0-1' OR starts_with(id, 'R0-1.')) AND status NOT IN {TERMINAL} THEN 'cancelled' ELSE status END AS status FROM nodes")(lambda n: hierarchy.cancel_cascade(n, ROOT).select("id", "status"))
for _s, _w, _to in (("all", "status <> 'open'", "invalidated"), ("open_only", f"status NOT IN {TERMINAL}", "open"), ("review", "status = 'done'", "invalidated")):
    _add(f"rerun_{_s}", "nodes", f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN {LIVE} AND starts_with(id, 'R0-1.') AND {_w} THEN '{_to}' ELSE status END AS status FROM nodes) x GROUP BY 1")(lambda n, s=_s: hierarchy.rerun(n, ROOT, s, NOW).groupBy("status").agg(F.count("*").alias("n")))

# dependencies
_add("blockers", "nodes edges", f"SELECT to_id, from_id FROM edges e JOIN nodes b ON b.id = e.from_id WHERE b.{LIVE} AND b.status NOT IN {TERMINAL}")(graph.blockers)
_add(
    "auto_block",
    "nodes edges",
    f"SELECT n.id, n.status, CASE WHEN c.to_id IS NOT NULL AND n.status IN ('open', 'in_progress') THEN 'blocked' WHEN c.to_id IS NULL AND n.status = 'blocked' THEN 'open' ELSE n.status END AS new_status FROM nodes n LEFT JOIN (SELECT DISTINCT to_id FROM edges e JOIN nodes b ON b.id = e.from_id WHERE b.{LIVE} AND b.status NOT IN {TERMINAL}) c ON c.to_id = n.id WHERE n.{LIVE}",
)(lambda n, e: graph.settle_blocks(n, e).drop("previous_status"))
_add(
    "reachability",
    "nodes edges",
    "WITH s AS (SELECT min(from_id) AS id FROM edges WHERE starts_with(from_id, 'R0-1.')), r(id, steps) AS (SELECT id, 0 FROM s UNION SELECT e.to_id, r.steps + 1 FROM r JOIN edges e ON e.from_id = r.id) SELECT id, min(steps) AS steps FROM r WHERE steps > 0 GROUP BY 1",
    recursive=True,
)(lambda n, e: graph.reachable(e, e.filter(F.col("from_id").startswith("R0-1.")).agg(F.min("from_id")).first()[0]))

_LINKS = "SELECT DISTINCT concat('E-', CAST(substring(author, 2) AS INT) + 1) AS from_id, concat('E-', 1 + event_id * 7 % 101) AS to_id, 'blocks' AS dep_type FROM log WHERE op IN ('link_dep', 'unlink_dep', 'delete', 'set_prompt')"
_add("reachability_cycles", "log", f"WITH g AS ({_LINKS}), r(id, steps) AS (SELECT 'E-1', 0 UNION SELECT g.to_id, r.steps + 1 FROM r JOIN g ON g.from_id = r.id WHERE r.steps < 40) SELECT id, min(steps) AS steps FROM r WHERE id <> 'E-1' GROUP BY 1", recursive=True)(
    lambda e: graph.reachable(e.sparkSession.sql(_LINKS.replace("FROM log", "FROM {log}"), log=e), "E-1")
)

# events
_add(
    "event_violations",
    "ev",
    f"SELECT event_id, CASE WHEN wall_ms > {LATE_MS} + 86400000 THEN 'future' ELSE '' END AS faults, wall_ms < {LATE_MS} - 2592000000 AS stale FROM ev WHERE wall_ms > {LATE_MS} + 86400000 OR wall_ms < {LATE_MS} - 2592000000",
)(lambda e: events.violations(e, LATE_MS))
_LWW = "SELECT *, row_number() OVER (PARTITION BY node_id, field_name ORDER BY lamport DESC, wall_ms DESC, machine, arrival) AS rk FROM ev WHERE op_type = 'update_field'"
_add("lww_winners", "ev", f"SELECT node_id, field_name, event_id, value FROM ({_LWW}) x WHERE rk = 1")(events.lww_winners)
_add("lww_losers", "ev", f"SELECT event_id, node_id FROM ({_LWW}) x WHERE rk > 1")(lambda e: events.lww_losers(e).select("event_id", "node_id"))
_add("lww_ranks", "ev", f"SELECT event_id, rk AS rank FROM ({_LWW}) x")(lambda e: events.field_writes(e).select("event_id", F.col("rank").cast("long").alias("rank")))
_add(
    "replay_nodes",
    "ev",
    f"WITH c AS (SELECT node_id, min(arrival) AS created FROM ev WHERE op_type = 'create_node' GROUP BY 1), l AS (SELECT ev.* FROM ev JOIN c USING (node_id) WHERE arrival >= created), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node_id, field_name ORDER BY lamport DESC, wall_ms DESC, machine, arrival) AS rk FROM l WHERE op_type = 'update_field') x WHERE rk = 1), s AS (SELECT node_id, arg_max(author, arrival) FILTER (op_type = 'claim') AS assignee, coalesce(arg_max(CASE op_type WHEN 'claim' THEN 'in_progress' ELSE 'done' END, arrival) FILTER (op_type IN ('claim', 'transition_status')), 'open') AS status, count(*) FILTER (op_type = 'comment') AS comments, max(lamport) AS lamport FROM l GROUP BY 1) SELECT s.*, (SELECT max(value) FROM w WHERE w.node_id = s.node_id AND field_name = 'title') AS title, (SELECT max(value) FROM w WHERE w.node_id = s.node_id AND field_name = 'description') AS description, (SELECT max(value) FROM w WHERE w.node_id = s.node_id AND field_name = 'prompt') AS prompt, (SELECT max(value) FROM w WHERE w.node_id = s.node_id AND field_name = 'priority') AS priority FROM s",
)(events.replay)
_add("vector_merge", "ev", "SELECT node_id, author, max(lamport) AS clock FROM ev GROUP BY 1, 2")(events.author_clocks)
_CLOCK = "map_from_arrays(array(author, 'hub'), array(lamport, arrival % 5))"
_add(
    "concurrent_pairs",
    "ev",
    "WITH u AS (SELECT * FROM ev WHERE op_type = 'update_field') SELECT a.node_id, a.event_id AS a_id, b.event_id AS b_id FROM u a JOIN u b ON a.node_id = b.node_id AND a.event_id < b.event_id WHERE CASE WHEN a.author = b.author THEN (a.lamport < b.lamport AND a.arrival % 5 > b.arrival % 5) OR (a.lamport > b.lamport AND a.arrival % 5 < b.arrival % 5) ELSE (a.lamport > 0 OR a.arrival % 5 > b.arrival % 5) AND (b.lamport > 0 OR a.arrival % 5 < b.arrival % 5) END",
)(lambda e: events.concurrent_pairs(e.withColumn("clock", F.expr(_CLOCK))))


def _creates(e: DataFrame) -> DataFrame:
    return e.filter("op_type = 'create_node'").select("event_id", "node_id", "arrival", F.concat(F.lit("uid"), F.col("event_id") % 3).alias("uid"))


_CREATES = "SELECT event_id, node_id, arrival, concat('uid', event_id % 3) AS uid FROM ev WHERE op_type = 'create_node'"
_add("registry_outcome", "ev", f"WITH c AS ({_CREATES}), f AS (SELECT node_id, min(arrival) AS a, arg_min(uid, arrival) AS u FROM c GROUP BY 1) SELECT event_id, node_id, CASE WHEN arrival = a THEN 'free' WHEN uid = u THEN 'noop' ELSE 'renumber' END AS outcome FROM c JOIN f USING (node_id)")(lambda e: events.registry(_creates(e)))
_add("duplicate_losers", "ev", f"WITH m AS (SELECT node_id, uid, min(event_id) AS event_id FROM ({_CREATES}) c GROUP BY 1, 2) SELECT * FROM (SELECT *, first_value(event_id) OVER (PARTITION BY node_id ORDER BY event_id) AS winner FROM m) x WHERE event_id <> winner")(lambda e: events.duplicate_losers(_creates(e)))
_add("version_gate", "ev", f"SELECT op_type AS project, count(*) FILTER (ts >= TIMESTAMP '{LATE}' - INTERVAL 30 DAY) > 0 AND count(*) FILTER (user_id < 1) = 0 AS ok FROM ev GROUP BY 1")(
    lambda e: events.version_gate(e.select(F.col("op_type").alias("project"), F.when(F.col("user_id") < 1, "v1.2.3").otherwise("v2.0.0").alias("version"), F.col("ts").alias("seen")), (1, 9, 0), LATE)
)
_add("first_event", "ev", "SELECT node_id, event_id, sha256(concat_ws('|', node_id, lamport, event_id, op_type, author)) AS hash FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY lamport, event_id) AS k FROM ev) x WHERE k = 1")(events.first_event)
_add("backfill_counts", "nodes edges", f"SELECT kind, count(*) AS n FROM (SELECT 'create_node' AS kind FROM nodes WHERE {LIVE} UNION ALL SELECT 'transition_status' FROM nodes WHERE {LIVE} AND status <> 'open' UNION ALL SELECT 'claim' FROM nodes WHERE {LIVE} AND assignee IS NOT NULL UNION ALL SELECT 'link_dep' FROM edges) x GROUP BY 1")(events.backfill_counts)
_add(
    "free_numbers",
    "nodes",
    f"WITH t AS (SELECT parent_id, seq FROM nodes WHERE {LIVE} AND depth = 3), w AS (SELECT parent_id, id, row_number() OVER (PARTITION BY parent_id ORDER BY id) AS k FROM nodes WHERE deleted_at IS NOT NULL), g AS (SELECT parent_id, s, row_number() OVER (PARTITION BY parent_id ORDER BY s) AS k FROM (SELECT DISTINCT parent_id, unnest(range(1, 200)) AS s FROM w) y WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.parent_id = y.parent_id AND t.seq = y.s)) SELECT w.parent_id, w.id, g.s AS seq FROM w JOIN g ON g.parent_id = w.parent_id AND g.k = w.k",
)(lambda n: events.free_numbers(n.filter(f"{LIVE} and depth = 3"), n.filter("deleted_at is not null").select("parent_id", "id")))

# lifecycle
_add("claim_outcomes", "nodes", f"SELECT id, CASE WHEN status = 'open' OR status = 'deferred' AND (defer_until IS NULL OR defer_until <= TIMESTAMP '{NOW}') THEN 'claimed' WHEN status = 'deferred' THEN 'still_deferred' WHEN status = 'in_progress' THEN 'already_claimed' WHEN status = 'blocked' THEN 'blocked' ELSE 'invalid_transition' END AS outcome FROM nodes WHERE {LIVE}")(lambda n: listing.live(n).select("id", lifecycle.claim_outcome(NOW).alias("outcome")))
_add("transition_done", "nodes", "SELECT id, CASE WHEN status IN ('in_progress', 'done') THEN 'ok' ELSE 'invalid_transition' END AS outcome, CASE WHEN status = 'in_progress' OR status = 'done' THEN 1.0 ELSE progress END AS progress FROM nodes")(lambda n: lifecycle.transition(n, F.lit("done"), NOW).select("id", "outcome", "progress"))
_add("reclaimable", "nodes agents", f"SELECT id, assignee FROM nodes n LEFT JOIN agents a ON a.agent_id = n.assignee WHERE n.{LIVE} AND n.status = 'in_progress' AND assignee IS NOT NULL AND (last_heartbeat IS NULL OR last_heartbeat < TIMESTAMP '{NOW}' - INTERVAL 24 HOUR)")(lambda n, a: lifecycle.reclaimable(n, a, NOW))
_add("session_ends", "sessions", "SELECT id, agent_id, lead(started_at) OVER (PARTITION BY agent_id ORDER BY started_at, id) AS ended_at FROM sessions")(lambda s: lifecycle.session_ends(s).select("id", "agent_id", "ended_at"))

# journal
_add("journal_tail", "ev", "SELECT event_id, op_type, false AS synced, event_id % 10 = 0 AS via_hook FROM ev WHERE arrival > 100 ORDER BY arrival LIMIT 500")(lambda e: journal.tail(e, 100, origin=e.filter("event_id % 10 = 0")).select("event_id", "op_type", "synced", "via_hook"))
_add("inbox", "ev", "SELECT DISTINCT author AS agent, event_id AS seq FROM ev WHERE (op_type = 'comment' OR event_id % 11 = 0) AND event_id > user_id AND event_id % 4 <> 0")(
    lambda e: journal.inbox(
        e.filter("op_type = 'comment'").select(F.col("author").alias("agent"), F.col("event_id").alias("seq")),
        e.filter("event_id % 11 = 0").select(F.col("author").alias("agent"), F.col("event_id").alias("seq")),
        e.select(F.col("author").alias("agent"), F.col("user_id").alias("cursor")).distinct(),
        e.filter("event_id % 4 = 0").select(F.col("author").alias("agent"), F.col("event_id").alias("seq")),
    )
)


def _hooks(spark: SparkSession) -> DataFrame:
    return hooks.table_of(spark, [{"name": "all", "match": {"events": []}}, {"name": "made", "match": {"events": ["node.created"]}}, {"name": "near", "match": {"events": ["status.changed"], "under": "E-3"}}])


_add("hook_matches", "log", "SELECT 'all' AS hook, event_id FROM log WHERE op IN ('create_node', 'transition_status') OR op = 'comment' AND event_id % 3 = 0 UNION ALL SELECT 'made', event_id FROM log WHERE op = 'create_node' UNION ALL SELECT 'near', event_id FROM log WHERE op = 'transition_status' AND (node_id = 'E-3' OR starts_with(node_id, 'E-3.'))")(
    lambda e: hooks.matched(hooks.normalised(applied.log_of(e).withColumn("via_hook", F.lit(None).cast("string"))), _hooks(e.sparkSession))
)

# text and scalars
_add("id_parts", "nodes", "SELECT id, project, parent_id AS parent, depth, CASE depth WHEN 0 THEN 'epic' WHEN 1 THEN 'story' WHEN 2 THEN 'issue' ELSE 'micro' END AS node_type FROM nodes")(lambda n: n.select("id", ids.project(F.col("id")).alias("project"), ids.parent(F.col("id")).alias("parent"), ids.depth(F.col("id")).alias("depth"), ids.node_type(ids.depth(F.col("id"))).alias("node_type")))
_add("content_hash", "nodes", """SELECT id, sha256('{"acceptance":"","description":"","labels":[' || coalesce('"' || label || '"', '') || '],"prompt":"","title":"' || title || '"}') AS hash FROM nodes""")(
    lambda n: n.select("id", ids.content_hash(F.col("title"), F.lit(""), F.lit(""), F.lit(""), F.array_compact(F.array("label"))).alias("hash"))
)
_add("context_prompt", "nodes", f"WITH c AS (SELECT n.id, a.depth, a.id || ' ' || a.title AS line FROM (SELECT id, unnest([array_to_string(string_split(id, '.')[1:k], '.') FOR k IN range(1, len(string_split(id, '.')) + 1)]) AS p FROM nodes WHERE {LIVE}) n JOIN nodes a ON a.id = n.p AND a.{LIVE}) SELECT id, string_agg(line, chr(10) ORDER BY depth) AS prompt FROM c GROUP BY 1")(
    text.contexts
)
_add("briefing", "nodes", f"SELECT id, concat_ws(chr(10), repeat('=', 80), {', '.join(f"CASE WHEN {f} <> '' THEN '{f}: ' || {f} END" for f in ('title', 'status', 'assignee', 'label'))}) AS briefing FROM nodes WHERE {LIVE}")(lambda n: text.briefing(listing.live(n), ["title", "status", "assignee", "label"]))

# integrity
_add("verify_fk", "nodes", f"SELECT id, parent_id FROM nodes n WHERE {LIVE} AND parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nodes p WHERE p.id = n.parent_id AND p.{LIVE})")(integrity.dangling_parents)
_CHECKS = {
    "parents": f"SELECT n.id FROM nodes n LEFT JOIN (SELECT id FROM nodes WHERE {LIVE}) p ON p.id = n.parent_id WHERE n.{LIVE} AND n.parent_id IS NOT NULL AND p.id IS NULL",
    "edges": "SELECT DISTINCT from_id, to_id FROM edges WHERE from_id NOT IN (SELECT id FROM nodes) OR to_id NOT IN (SELECT id FROM nodes)",
    "unique_ids": "SELECT id FROM nodes GROUP BY 1 HAVING count(*) > 1",
    "progress": f"SELECT n.id FROM nodes n JOIN (SELECT parent_id, sum(progress * weight) / sum(weight) AS e FROM nodes WHERE {LIVE} AND status NOT IN ('cancelled', 'invalidated') AND parent_id IS NOT NULL GROUP BY 1) m ON m.parent_id = n.id WHERE n.{LIVE} AND abs(n.progress - m.e) > 0.01",
}
_add("verify_all", "nodes edges", " UNION ALL ".join(f"SELECT '{name}' AS \"check\", count(*) AS faults, count(*) = 0 AS ok FROM ({rows}) {name}_rows" for name, rows in _CHECKS.items()))(integrity.verify)
_add("set_diff", "nodes", "SELECT id, CASE WHEN status = 'done' THEN 'left' ELSE 'right' END AS side FROM nodes WHERE (status = 'done') <> (priority = 1)")(lambda n: integrity.set_diff(n.filter("status = 'done'"), n.filter("priority = 1")))
_add("merge_actions", "nodes", "SELECT id, CASE WHEN depth < 2 THEN 'created' WHEN priority = 2 THEN 'updated' ELSE 'skipped' END AS action FROM nodes")(lambda n: integrity.merge_actions(n.filter("depth >= 2").select("id", F.col("title").alias("content_hash")), n.select("id", F.when(F.col("priority") == 2, "other").otherwise(F.col("title")).alias("content_hash"))))
_add("recover_merge", "nodes", "SELECT id, CASE WHEN depth = 1 THEN 'placeholder' WHEN depth = 3 AND status = 'done' OR depth = 0 THEN 'primary' ELSE 'mirror' END AS origin FROM nodes n WHERE depth IN (0, 2, 3) OR depth = 1 AND EXISTS (SELECT 1 FROM nodes c WHERE c.parent_id = n.id)")(
    lambda n: integrity.recovered(n.filter("(depth = 3 and status = 'done') or depth = 0"), n.filter("depth in (2, 3)"))
)
_add("placeholder_ancestors", "nodes", "SELECT DISTINCT p.id, p.depth FROM nodes p JOIN nodes c ON c.parent_id = p.id WHERE p.depth = 1")(lambda n: hierarchy.placeholders(n.filter("depth <> 1")).filter("depth = 1"))


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of the documents, from the store."""
    path = f"{sf_dir}/documents.parquet"
    docs = spark.read.parquet(path)
    bounded(spark)
    dealt = lambda: docs.select("doc_id", "text").repartition(pieces(spark, path), "doc_id")  # noqa: E731  # texts are far smaller than their postings
    return stored(spark, "postings", lambda: text.postings(dealt(), ["text"]), "term", path, ranged=False), stored(spark, "lengths", lambda: text.lengths(docs, ["text"]), "id", path, ranged=False)


def _search(name: str, asked: list[list[text.Term]], condition: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return text.search(*_index(spark, sf_dir), asked).select(F.col("id").alias("doc_id"))

    _QUERIES[name] = run
    words = "(SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS w FROM documents) x"
    _SQL[name] = f"SELECT doc_id FROM {words} WHERE {condition}"


_search("search_and", [[text.Term("the"), text.Term("license")]], "contains(w, ' the ') AND contains(w, ' license ')")
_search("search_phrase", [[text.Term("apache license")]], "contains(w, ' apache license ')")
_search("search_prefix", [[text.Term("licen", prefix=True), text.Term("apache", without=True)]], "contains(w, ' licen') AND NOT contains(w, ' apache ')")
_search("search_or", [[text.Term("apache")], [text.Term("trash")]], "contains(w, ' apache ') OR contains(w, ' trash ')")


def _edited(docs: DataFrame) -> DataFrame:
    """Every tenth document as it is written anew."""
    return docs.filter("doc_id % 10 = 0").withColumn("text", F.concat(F.lit("Apache license of "), F.col("doc_id"), F.lit(" "), F.substring("text", 1, 200)))


def _search_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search after every tenth document was written anew and every seventh deleted, over the kept index and its delta."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index, sizes = text.upkept(*_index(spark, sf_dir), _edited(docs), docs.filter("doc_id % 7 = 0"), ["text"])
    return text.search(index, sizes, [[text.Term("apache license")]]).select(F.col("id").alias("doc_id"))


def _index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the kept index lacks if those changes weren't told to it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now = docs.filter("doc_id % 10 <> 0").unionByName(_edited(docs)).filter("doc_id % 7 <> 0")
    return text.index_faults(_index(spark, sf_dir)[0], now, ["text"]).select(F.col("id").alias("doc_id"), "fault")


_QUERIES["search_updated"] = _search_updated
_SQL["search_updated"] = "SELECT doc_id FROM (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(CASE WHEN doc_id % 10 = 0 THEN 'Apache license of ' || doc_id || ' ' || substr(text, 1, 200) ELSE text END), '[\\p{L}\\p{N}]+'), ' ') || ' ' AS w FROM documents WHERE doc_id % 7 <> 0) x WHERE contains(w, ' apache license ')"
_QUERIES["index_check"] = _index_check
_SQL["index_check"] = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'surplus' WHEN regexp_matches(lower(text), '[\\p{L}\\p{N}]') THEN 'stale' ELSE 'missing' END AS fault FROM documents WHERE CASE WHEN doc_id % 7 = 0 THEN regexp_matches(lower(coalesce(text, '')), '[\\p{L}\\p{N}]') ELSE doc_id % 10 = 0 END"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.search(*_index(spark, sf_dir), [[text.Term("apache"), text.Term("license")]]).withColumnRenamed("id", "doc_id")


_QUERIES["search_scores"] = _scored
_SQL["search_scores"] = """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents),
r AS (SELECT doc_id, len(t) AS n, len(list_filter(t, lambda x: x = 'apache')) AS a, len(list_filter(t, lambda x: x = 'license')) AS l FROM d),
c AS (SELECT count(*) AS docs, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (l > 0) AS dl FROM r)
SELECT doc_id, round(ln(1 + (docs - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + ln(1 + (docs - dl + 0.5) / (dl + 0.5)) * l * 2.2 / (l + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score FROM r, c WHERE a > 0 AND l > 0"""


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    # names at the start, inside, after a blank and with other signs, by the turn's number
    said = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("@"), "role", F.lit(" "), "text")).when(F.col("turn") % 4 == 1, F.concat("text", F.lit(" @"), "role")).when(F.col("turn") % 4 == 2, F.concat(F.lit(" @"), "role", F.lit(" x"))).otherwise(F.col("text"))
    return log.select("conv_id", "turn", ids.mention(said).alias("agent"))


_QUERIES["mentions"] = _mentions
_SQL["mentions"] = r"SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN role WHEN 1 THEN regexp_extract(text || ' @' || role, '(?:^|[^\w@])@([a-z0-9_-]{1,64})', 1) WHEN 2 THEN role ELSE regexp_extract(text, '(?:^|[^\w@])@([a-z0-9_-]{1,64})', 1) END AS agent FROM conversations"


applied.register(_add)
deeper.register(_add)
history.register(_add)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
