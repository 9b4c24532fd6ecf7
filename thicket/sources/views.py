"""The work graph over the star-schema tables: nodes, edges, events, agents and sessions.

One SQL text per view serves Spark and the checking engine; ``{...}`` marks
where the two spell a function differently. ``NOW`` is the fixed clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thicket.sources.store import bounded, stored

NOW = "2000-01-01 00:00:00"

NODES = """
n0 AS (SELECT concat('R', n_regionkey, '-', n_nationkey + 1) AS id, n_nationkey AS k, concat('R', n_regionkey) AS project, CAST(n_nationkey + 1 AS BIGINT) AS seq, n_name AS title FROM {nation}),
n1 AS (SELECT concat(n0.id, '.', c_custkey + 1) AS id, n0.id AS parent_id, c_custkey AS k, project, CAST(c_custkey + 1 AS BIGINT) AS seq, c_name AS title, c_mktsegment AS segment FROM {customer} JOIN n0 ON c_nationkey = n0.k),
n2 AS (SELECT concat(n1.id, '.', o_orderkey + 1) AS id, n1.id AS parent_id, o_orderkey AS k, project, CAST(o_orderkey + 1 AS BIGINT) AS seq, segment, CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'in_progress' END AS status, CAST(o_orderdate AS TIMESTAMP) AS created_at FROM {orders} JOIN n1 ON o_custkey = n1.k),
li AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS BIGINT) AS seq,
  CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'done' WHEN 'NF' THEN 'in_progress' WHEN 'RF' THEN 'cancelled' WHEN 'RO' THEN 'invalidated' WHEN 'AO' THEN 'deferred' ELSE 'open' END AS status FROM {lineitem}),
n3 AS (SELECT concat(n2.id, '.', li.seq) AS id, n2.id AS parent_id, project, li.seq, segment, priority, li.status, l_quantity AS weight, l_suppkey, CAST(l_shipdate AS TIMESTAMP) AS shipped, created_at, l_tax FROM li JOIN n2 ON l_orderkey = n2.k),
nodes AS (
  SELECT id, CAST(NULL AS STRING) AS parent_id, project, 0 AS depth, seq, title, 3 AS priority, 'open' AS status, CAST(0.0 AS DOUBLE) AS progress, CAST(1.0 AS DOUBLE) AS weight, CAST(NULL AS STRING) AS assignee, CAST(NULL AS STRING) AS label,
    TIMESTAMP '1995-01-01 00:00:00' AS created_at, TIMESTAMP '1995-01-01 00:00:00' AS updated_at, CAST(NULL AS TIMESTAMP) AS defer_until, CAST(NULL AS TIMESTAMP) AS deleted_at, CAST(NULL AS STRING) AS session_id FROM n0
  UNION ALL SELECT id, parent_id, project, 1, seq, title, 3, 'open', 0.0, 1.0, NULL, segment, TIMESTAMP '1995-01-01 00:00:00', TIMESTAMP '1995-01-01 00:00:00', NULL, NULL, NULL FROM n1
  UNION ALL SELECT id, parent_id, project, 2, seq, concat('Order ', seq, ' of ', segment), priority, status, CASE status WHEN 'done' THEN 1.0 WHEN 'in_progress' THEN 0.5 ELSE 0.0 END, 1.0, NULL, segment, created_at, created_at, NULL, NULL, concat('s', k % 50) FROM n2
  UNION ALL SELECT id, parent_id, project, 3, seq, concat('Line ', seq, ' for ', segment), priority, status, CASE status WHEN 'done' THEN 1.0 WHEN 'in_progress' THEN 0.5 ELSE 0.0 END, CAST(weight AS DOUBLE), CASE WHEN status <> 'open' THEN concat('agent-', l_suppkey) END,
    segment, created_at, shipped, CASE WHEN status = 'deferred' AND l_suppkey % 3 > 0 THEN shipped END, CASE WHEN l_tax = 0.08 THEN shipped END, concat('s', l_suppkey % 50) FROM n3)"""

EDGES = """
edges AS (SELECT from_id, id AS to_id, 'blocks' AS dep_type FROM (SELECT id, lag(id) OVER (PARTITION BY parent_id ORDER BY created_at, seq) AS from_id FROM nodes WHERE depth = 2) x WHERE from_id IS NOT NULL)"""

EVENTS = """
ev AS (SELECT event_id, concat('E-', user_id + 1, '.', CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) + 1) AS node_id, concat('u', user_id) AS author, substring(md5(CAST(user_id AS STRING)), 1, 16) AS machine,
  CASE event_type WHEN 'signup' THEN 'create_node' WHEN 'click' THEN 'update_field' WHEN 'view' THEN 'claim' WHEN 'purchase' THEN 'transition_status' ELSE 'comment' END AS op_type,
  CASE WHEN event_type = 'click' THEN CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'description' WHEN 2 THEN 'prompt' ELSE 'priority' END ELSE '' END AS field_name,
  CAST(value AS DOUBLE) AS value, {ms} AS wall_ms, CAST(event_id AS BIGINT) AS arrival, CAST(event_id - event_id % 7 AS BIGINT) AS lamport, CAST(ts AS TIMESTAMP) AS ts, CAST(user_id AS BIGINT) AS user_id FROM {events})"""

LOG = """
log AS (SELECT event_id, arrival, lamport, wall_ms, machine, author,
  CASE WHEN event_id % 13 = 0 AND event_id % 5 <> 0 AND op_type <> 'create_node' THEN concat('E-900.', event_id) ELSE node_id END AS node_id,
  CASE WHEN event_id % 5 = 0 AND (op_type <> 'create_node' OR event_id % 10 = 0) THEN CAST(NULL AS STRING) ELSE concat('n-', node_id) END AS uid, op, field_name, new_value, to_status, until, target
  FROM (SELECT *,
    CASE op WHEN 'update_field' THEN CASE event_id % 9 WHEN 0 THEN 'title' WHEN 1 THEN 'description' WHEN 2 THEN 'prompt' WHEN 3 THEN 'priority' WHEN 4 THEN 'acceptance' WHEN 5 THEN 'status' WHEN 6 THEN 'assignee' WHEN 7 THEN 'agent_state' ELSE 'title' END WHEN 'set_prompt' THEN 'prompt' WHEN 'set_acceptance' THEN 'acceptance' ELSE '' END AS field_name,
    CASE WHEN op = 'update_field' AND event_id % 9 = 3 THEN CAST(1 + event_id % 4 AS STRING) WHEN op = 'update_field' AND event_id % 9 = 5 THEN CASE event_id % 2 WHEN 0 THEN 'blocked' ELSE 'done' END ELSE concat('v', event_id) END AS new_value,
    CASE event_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'cancelled' WHEN 2 THEN 'open' WHEN 3 THEN 'in_progress' ELSE 'invalidated' END AS to_status,
    CASE WHEN event_id % 3 = 0 THEN CAST(NULL AS STRING) ELSE concat('2030-01-0', 1 + event_id % 9, 'T00:00:00Z') END AS until, concat('E-', 1 + event_id % 50, '.1') AS target
    FROM (SELECT event_id, arrival, lamport, wall_ms, machine, author, node_id, op_type, CASE op_type WHEN 'claim' THEN CASE event_id % 4 WHEN 0 THEN 'unclaim' WHEN 1 THEN 'defer' ELSE 'claim' END
      WHEN 'comment' THEN CASE event_id % 16 WHEN 0 THEN 'delete' WHEN 1 THEN 'set_prompt' WHEN 2 THEN 'set_acceptance' WHEN 3 THEN 'link_dep' WHEN 4 THEN 'unlink_dep' WHEN 5 THEN 'link_dep' ELSE 'comment' END ELSE op_type END AS op FROM ev) x) y)"""

FIRINGS = """
firings AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'claims' ELSE 'near' END AS hook, concat('E-', user_id % 7) AS node_id, CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'delivered' END AS outcome, ts AS fired_at FROM ev)"""

#: Chains of 51 levels, each level with a leaf beside it; ``{levels}`` gives a row for each level.
CHAINS = """
ck AS (SELECT c_custkey AS c, {levels} AS k FROM {customer}),
chains AS (
  SELECT concat('D', c % 7, '-', c + 1, repeat('.1', k)) AS id, CASE WHEN k > 0 THEN concat('D', c % 7, '-', c + 1, repeat('.1', k - 1)) END AS parent_id, k AS depth,
    CASE WHEN (c * 31 + k) % 97 = 0 THEN 'cancelled' ELSE 'open' END AS status, CAST(1 + k % 3 AS DOUBLE) AS weight, CAST(c % 4 AS DOUBLE) / 4 AS progress, CAST(NULL AS TIMESTAMP) AS deleted_at FROM ck
  UNION ALL SELECT concat('D', c % 7, '-', c + 1, repeat('.1', k - 1), '.2'), concat('D', c % 7, '-', c + 1, repeat('.1', k - 1)), k, CASE WHEN (c + k) % 5 = 0 THEN 'invalidated' ELSE 'done' END, CAST(1 + (c + k) % 2 AS DOUBLE), CAST(k % 2 AS DOUBLE), NULL FROM ck WHERE k > 0)"""

AGENTS = """
agents AS (SELECT concat('agent-', l_suppkey) AS agent_id, max(CAST(l_shipdate AS TIMESTAMP)) AS last_heartbeat, CASE WHEN l_suppkey % 3 = 0 THEN 'stuck' ELSE 'working' END AS state FROM {lineitem} WHERE l_shipdate < TIMESTAMP '2000-01-01 00:00:00' GROUP BY l_suppkey)"""

SESSIONS = """
sessions AS (SELECT concat('s', o_orderkey % 50) AS id, concat('agent-', o_orderkey % 10) AS agent_id, min(CAST(o_orderdate AS TIMESTAMP)) AS started_at, CASE WHEN min(o_orderkey) % 2 = 0 THEN 'active' ELSE 'ended' END AS status FROM {orders} GROUP BY 1, 2)"""

_PARTS = {"nodes": (NODES,), "edges": (NODES, EDGES), "ev": (EVENTS,), "log": (EVENTS, LOG), "firings": (EVENTS, FIRINGS), "chains": (CHAINS,), "agents": (AGENTS,), "sessions": (SESSIONS,)}
#: What the store keeps, and the column it sorts by; as the joins and windows that make it deal it, with an order's lines in one file.
_STORED = {"nodes": "id", "edges": "to_id"}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations"]


def _with(names) -> str:
    parts = dict.fromkeys(p for n in names for p in _PARTS[n])
    return "WITH " + ",".join(parts)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name; nodes and edges come from the store."""
    bounded(spark)
    if name not in _STORED:
        return _made(spark, sf_dir, name)
    text = _with([name])
    return stored(spark, name, lambda: _made(spark, sf_dir, name), _STORED[name], *[f"{sf_dir}/{t}.parquet" for t in TABLES if f"{{{t}}}" in text], ranged=False)


def _made(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "edges":
        return spark.sql(f"WITH {EDGES} SELECT * FROM edges".replace("FROM nodes", "FROM {nodes}"), nodes=view(spark, sf_dir, "nodes"))
    text = _with([name])
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    return spark.sql(f"{text.replace('{ms}', 'unix_millis(CAST(ts AS TIMESTAMP))').replace('{levels}', 'explode(sequence(0, 50))')} SELECT * FROM {name}", **used)


def oracle(query: str, *names: str) -> str:
    """The query for the checking engine, with the views it names before it."""
    text = _with(names).replace("{ms}", "CAST(epoch_us(ts) // 1000 AS BIGINT)").replace("{levels}", "CAST(unnest(range(51)) AS INT)")
    for t in TABLES:
        text = text.replace(f"{{{t}}}", t)
    for v in ("nodes", "edges", "ev", "log"):  # read once, however often the query names them
        text = text.replace(f"\n{v} AS (", f"\n{v} AS MATERIALIZED (").replace(f"  {v} AS (", f"  {v} AS MATERIALIZED (")
    query = query.strip()
    return text + (", " + query[5:] if query.upper().startswith("WITH ") else " " + query)


def oracle_recursive(query: str, *names: str) -> str:
    return oracle(query, *names).replace("WITH ", "WITH RECURSIVE ", 1)
