"""Queries over the log with payloads: state, comments, edges and orphans after applying all kinds of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.operators import collisions, replay
from thicket.streaming import hooks


def log_of(rows: DataFrame) -> DataFrame:
    """The view's typed columns as events with a JSON payload, as they come over the wire."""
    j = lambda **members: F.to_json(F.struct(*[c.alias(n) for n, c in members.items()]))
    op, c = F.col("op"), F.col
    payload = (
        F.when(op == "create_node", j(title=c("new_value")))
        .when(op == "update_field", j(field_name=c("field_name"), new_value=c("new_value")))
        .when(op == "transition_status", j(to=c("to_status")))
        .when(op == "claim", j(agent_id=c("author")))
        .when(op == "defer", j(until=c("until")))
        .when(op == "comment", j(author_id=c("author"), body=c("new_value"), to=F.when(c("event_id") % 3 == 0, F.concat(F.lit("u"), c("event_id") % 7))))
        .when(op == "link_dep", j(depends_on_node_id=c("target"), dep_type=F.lit("blocks")))
        .when(op == "unlink_dep", j(depends_on_node_id=c("target")))
        .when(op == "set_prompt", j(prompt_text=c("new_value")))
        .when(op == "set_acceptance", j(acceptance_text=c("new_value")))
        .otherwise(F.lit("{}"))
    )
    return rows.select("event_id", "node_id", "uid", op.alias("op_type"), payload.alias("payload"), "lamport", "wall_ms", "machine", "author", "arrival")


_FOUND = """n AS (SELECT node_id AS id, coalesce(uid, CAST(event_id AS VARCHAR)) AS node_uid, arrival AS created, wall_ms AS created_ms, new_value AS first_title FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY arrival) AS k FROM log WHERE op = 'create_node') x WHERE k = 1),
l AS (SELECT * FROM log WHERE op <> 'create_node'),
e AS (SELECT l.*, n.id, n.created FROM l JOIN n ON l.uid = n.node_uid WHERE l.arrival > n.created UNION ALL SELECT l.*, n.id, n.created FROM l JOIN n ON l.uid IS NULL AND l.node_id = n.id WHERE l.arrival > n.created),
d AS (SELECT id, min(arrival) AS gone, arg_min(wall_ms, arrival) AS deleted_ms FROM e WHERE op = 'delete' GROUP BY 1),
a AS (SELECT e.*, d.deleted_ms FROM e LEFT JOIN d USING (id) WHERE gone IS NULL OR arrival <= gone)"""

REPLAY = f"""WITH {_FOUND},
w AS (SELECT * FROM (SELECT id, op, field_name, new_value, arrival, row_number() OVER (PARTITION BY id, op, field_name ORDER BY lamport DESC, wall_ms DESC, machine, arrival) AS rk FROM a WHERE op IN ('update_field', 'set_prompt', 'set_acceptance')) x WHERE rk = 1),
s AS (
  SELECT id, field_name AS col, new_value AS v, arrival FROM w
  UNION ALL SELECT id, 'status', CASE op WHEN 'claim' THEN 'in_progress' WHEN 'unclaim' THEN 'open' WHEN 'defer' THEN 'deferred' ELSE to_status END, arrival FROM a WHERE op IN ('claim', 'unclaim', 'defer', 'transition_status')
  UNION ALL SELECT id, 'assignee', CASE op WHEN 'claim' THEN author ELSE '' END, arrival FROM a WHERE op IN ('claim', 'unclaim')
  UNION ALL SELECT id, 'agent_state', CASE op WHEN 'claim' THEN 'working' ELSE '' END, arrival FROM a WHERE op IN ('claim', 'unclaim')
  UNION ALL SELECT id, 'defer_until', coalesce(until, ''), arrival FROM a WHERE op = 'defer'
  UNION ALL SELECT id, 'closed', CASE WHEN to_status IN ('done', 'cancelled', 'invalidated') THEN CAST(wall_ms AS VARCHAR) ELSE '' END, arrival FROM a WHERE op = 'transition_status'),
p AS (SELECT id, col, arg_max(v, arrival) AS v FROM s GROUP BY 1, 2),
f AS (SELECT id, {', '.join(f"max(v) FILTER (col = '{c}') AS {c}" for c in ('title', 'description', 'prompt', 'acceptance', 'status', 'priority', 'assignee', 'agent_state', 'defer_until', 'closed'))} FROM p GROUP BY 1),
k AS (SELECT id, count(*) FILTER (op = 'comment') AS comments, max(deleted_ms) AS deleted_ms FROM a GROUP BY 1)
SELECT n.id, n.node_uid AS uid, coalesce(title, first_title) AS title, description, prompt, acceptance, coalesce(status, 'open') AS status, CAST(coalesce(priority, '3') AS INT) AS priority, nullif(assignee, '') AS assignee, nullif(agent_state, '') AS agent_state,
  nullif(defer_until, '') AS defer_until, CAST(nullif(closed, '') AS BIGINT) AS closed_ms, created_ms, deleted_ms, coalesce(comments, 0) AS comments FROM n LEFT JOIN f USING (id) LEFT JOIN k USING (id)"""

EDGES = f"""WITH {_FOUND},
x AS (SELECT coalesce(a.id, l.node_id) AS from_id, l.target AS to_id, 'blocks' AS dep_type, l.arrival, l.op FROM l LEFT JOIN a ON a.event_id = l.event_id WHERE l.op IN ('link_dep', 'unlink_dep'))
SELECT from_id, to_id, dep_type FROM x GROUP BY 1, 2, 3 HAVING arg_max(op, arrival) = 'link_dep'"""


HOOKS = [
    {"name": "made", "match": {"events": ["node.created"], "under": "E-3"}, "deliver": ["inbox"]},
    {"name": "ended", "match": {"events": ["status.changed"], "status_to": ["done", "cancelled"], "from_agent_not": "u5"}, "deliver": ["inbox"]},
    {"name": "asked", "match": {"events": ["comment.addressed", "status.changed"], "to_agent": "u3"}, "deliver": ["inbox"]},
]
_VIA = "CASE event_id % 10 WHEN 0 THEN 'ended' WHEN 1 THEN 'asked' END"
_NAMED = "h AS (SELECT event_id, author, node_id, CASE op WHEN 'comment' THEN 'comment.addressed' WHEN 'transition_status' THEN 'status.changed' ELSE 'node.created' END AS name, CASE WHEN op = 'comment' THEN concat('u', event_id % 7) END AS to_agent, CASE WHEN op = 'transition_status' THEN to_status END AS status_to, coalesce(" + _VIA + ", '') AS via FROM log WHERE op IN ('create_node', 'transition_status') OR op = 'comment' AND event_id % 3 = 0)"
_MATCHED = f"""{_NAMED}, m AS (SELECT 'made' AS hook, event_id FROM h WHERE name = 'node.created' AND (node_id = 'E-3' OR starts_with(node_id, 'E-3.'))
UNION ALL SELECT 'ended', event_id FROM h WHERE name = 'status.changed' AND status_to IN ('done', 'cancelled') AND author <> 'u5' AND via <> 'ended'
UNION ALL SELECT 'asked', event_id FROM h WHERE (name = 'comment.addressed' AND to_agent = 'u3' OR name = 'status.changed') AND via <> 'asked')"""
_LEDGER = "CASE event_id % 5 WHEN 0 THEN 'claimed' WHEN 1 THEN 'delivered' END"
_FIRED = "CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:50' END"
PASS = "2024-01-01 00:01:05"


def _events(e: DataFrame) -> DataFrame:
    return hooks.normalised(log_of(e).withColumn("via_hook", F.expr(_VIA)))


def _matches(e: DataFrame) -> DataFrame:
    good, _ = hooks.checked(HOOKS)
    return hooks.matched(_events(e), hooks.table_of(e.sparkSession, good))


def _pass(e: DataFrame) -> DataFrame:
    """What a pass over all matches wins, beside a ledger that holds some of them."""
    asked = _matches(e)
    ledger = asked.select("hook", F.col("event_id").alias("seq"), F.expr(_FIRED).alias("fired_at"), F.expr(_LEDGER).alias("outcome")).filter("outcome is not null")
    return hooks.claimed(asked.withColumnRenamed("event_id", "seq"), ledger, 1000, PASS)


def _collided(e: DataFrame) -> DataFrame:
    rows = e.filter("op = 'create_node'").select(F.col("event_id").alias("collision_id"), F.expr("CASE WHEN event_id % 4 = 0 THEN 'resolved' ELSE 'open' END").alias("status"), *[F.lit(None).cast("string").alias(c) for c in ("winner_event_id", "loser_new_path", "resolved_by")], F.lit(None).cast("timestamp").alias("resolved_at"))
    told = e.filter("op = 'create_node' and event_id % 3 = 0").select(F.col("event_id").alias("collision_id"), F.col("event_id").cast("string").alias("winner_event_id"), F.concat("node_id", F.lit("9")).alias("loser_new_path"), F.lit("op").alias("resolved_by"))
    return collisions.resolve(rows, told, "2024-02-01").select("collision_id", "status", "winner_event_id", "loser_new_path", "changed")


def register(add) -> None:
    add("hook_rules", "log", f"WITH {_MATCHED} SELECT hook, event_id FROM m")(_matches)
    add("hook_claims", "log", f"WITH {_MATCHED} SELECT hook, event_id AS seq FROM m WHERE {_LEDGER} IS NULL AND event_id > 1000 OR {_LEDGER} = 'claimed' AND {_FIRED} < TIMESTAMP '{PASS}' - INTERVAL 60 SECOND")(_pass)
    add("resolved_collisions", "log", "SELECT event_id AS collision_id, CASE WHEN event_id % 4 = 0 OR event_id % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, CASE WHEN event_id % 4 <> 0 AND event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) END AS winner_event_id, CASE WHEN event_id % 4 <> 0 AND event_id % 3 = 0 THEN concat(node_id, '9') END AS loser_new_path, event_id % 4 <> 0 AND event_id % 3 = 0 AS changed FROM log WHERE op = 'create_node'")(_collided)
    add("apply_nodes", "log", REPLAY)(lambda e: replay.replay(log_of(e)).drop("labels"))
    add("apply_edges", "log", EDGES)(lambda e: replay.replay_edges(log_of(e)))
    add("apply_comments", "log", f"WITH {_FOUND} SELECT id, event_id, author, new_value AS text, wall_ms AS at_ms FROM a WHERE op = 'comment'")(lambda e: replay.annotations(log_of(e)))
    add("orphan_events", "log", f"WITH {_FOUND} SELECT event_id, node_id FROM l WHERE op <> 'delete' AND CASE WHEN uid IS NULL THEN node_id NOT IN (SELECT id FROM n) ELSE uid NOT IN (SELECT node_uid FROM n) END")(lambda e: replay.orphans(log_of(e)))
