"""Queries on cases where near-miss rules would differ: kept statuses, refusals, totals, rebases, hooks, uids, numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions import ids
from thicket.operators import aggregates, events, graph, hierarchy, integrity, lifecycle, listing, more

LIVE = "deleted_at IS NULL"
TERMINAL = "('done', 'cancelled', 'invalidated')"
LATE = "2024-01-20 00:00:00"

#: Orders under every fourth number are blocked, with the status they had before; the same in both languages.
_BLOCKED = "CASE WHEN depth = 2 AND seq % 4 = 0 THEN 'blocked' ELSE status END"
_WAS = "CASE WHEN depth = 2 AND seq % 8 = 0 THEN 'in_progress' WHEN depth = 2 AND seq % 12 = 0 THEN '' END"
_CLOSED = "CASE WHEN status IN ('done', 'cancelled') THEN created_at END"
#: Customers with every fifth number are deleted, so chains through them are broken.
_CUT = "CASE WHEN depth = 1 AND seq % 5 = 0 THEN created_at ELSE deleted_at END"


def _cut(n: DataFrame) -> DataFrame:
    return n.withColumn("deleted_at", F.expr(_CUT))


def _blocked(n: DataFrame) -> DataFrame:
    return n.withColumns({"status": F.expr(_BLOCKED), "previous_status": F.expr(_WAS)})


def _invalid(n: DataFrame) -> DataFrame:
    return n.withColumn("invalidated_at", F.expr("CASE WHEN depth = 3 AND seq % 3 = 0 THEN created_at END"))


def _moves(n: DataFrame) -> DataFrame:
    return n.filter("(depth = 1 and seq % 7 = 0) or (depth = 2 and seq % 3 = 0)").select(F.col("id").alias("old"), F.concat(F.lit("NEW-"), "seq").alias("new"))


def _uids(n: DataFrame) -> DataFrame:
    return n.withColumn("uid", F.when(F.col("seq") % 6 != 0, F.concat(F.lit("u-"), F.col("id"))))


def _incoming(n: DataFrame) -> DataFrame:
    """Every project's tree as another store has it: some under other paths, some paths with other uids."""
    moved = F.when(F.col("seq") % 3 == 0, F.concat(F.col("id"), F.lit("9"))).otherwise(F.col("id"))
    other = F.when(F.col("seq") % 5 == 0, F.concat(F.lit("x-"), F.col("id"))).otherwise(F.concat(F.lit("u-"), F.col("id")))
    return n.select(moved.alias("id"), other.alias("uid"))


def register(add) -> None:
    add(
        "auto_block_restore",
        "nodes edges",
        f"WITH b AS (SELECT id, deleted_at, {_BLOCKED} AS status, {_WAS} AS was FROM nodes), c AS (SELECT DISTINCT to_id FROM edges e JOIN b ON b.id = e.from_id WHERE b.{LIVE} AND b.status NOT IN {TERMINAL}) "
        "SELECT b.id, b.status, CASE WHEN c.to_id IS NOT NULL AND b.status IN ('open', 'in_progress') THEN 'blocked' WHEN c.to_id IS NULL AND b.status = 'blocked' THEN coalesce(nullif(was, ''), 'open') ELSE b.status END AS new_status, "
        f"CASE WHEN c.to_id IS NOT NULL AND b.status IN ('open', 'in_progress') THEN b.status WHEN c.to_id IS NULL AND b.status = 'blocked' THEN NULL ELSE nullif(was, '') END AS previous_status FROM b LEFT JOIN c ON c.to_id = b.id WHERE b.{LIVE}",
    )(lambda n, e: graph.settle_blocks(_blocked(n), e))
    add(
        "transition_closed_at",
        "nodes",
        f"SELECT id, CASE WHEN status IN ('in_progress', 'done') THEN 'done' ELSE status END AS status, CASE WHEN status = 'in_progress' THEN TIMESTAMP '2000-01-01 00:00:00' ELSE {_CLOSED} END AS closed_at FROM nodes",
    )(lambda n: lifecycle.transition(n.withColumn("closed_at", F.expr(_CLOSED)), F.lit("done"), "2000-01-01 00:00:00").select("id", "status", "closed_at"))
    _chain = "SELECT id, unnest([array_to_string(string_split(id, '.')[1:k], '.') FOR k IN range(1, len(string_split(id, '.')) + 1)]) AS p FROM n"
    add("broken_chains", "nodes", f"WITH n AS (SELECT * FROM (SELECT id, {_CUT} AS gone FROM nodes) x WHERE gone IS NULL), c AS ({_chain}) SELECT c.id, c.p AS missing FROM c LEFT JOIN n a ON a.id = c.p WHERE a.id IS NULL")(lambda n: hierarchy.broken_chains(_cut(n)))
    add("whole_chains", "nodes", f"WITH n AS (SELECT * FROM (SELECT id, depth, {_CUT} AS gone FROM nodes) x WHERE gone IS NULL), c AS ({_chain}), j AS (SELECT c.id, a.id AS ancestor_id, CAST(a.depth AS BIGINT) AS level FROM c LEFT JOIN n a ON a.id = c.p) SELECT * FROM j WHERE id NOT IN (SELECT id FROM j WHERE ancestor_id IS NULL)")(lambda n: hierarchy.with_ancestors(_cut(n)))
    add("node_progress", "nodes", f"WITH k AS (SELECT parent_id, count(*) AS c, count(*) FILTER (depth = 3 AND seq % 3 = 0) AS i FROM nodes WHERE {LIVE} AND parent_id IS NOT NULL GROUP BY 1) SELECT id, progress, status, coalesce(c, 0) AS children, coalesce(i, 0) AS invalidated FROM nodes n LEFT JOIN k ON k.parent_id = n.id WHERE n.{LIVE}")(lambda n: more.node_progress(_invalid(n)))
    add("page_info", "nodes", f"SELECT count(*) AS total, CAST(greatest(least(count(*) - 100, 50), 0) AS BIGINT) AS rows, 150 < count(*) AS has_more FROM nodes WHERE {LIVE}")(lambda n: listing.page_info(n, 50, 100))
    add("count_only", "nodes", f"SELECT count(*) AS total, CAST(0 AS BIGINT) AS rows, count(*) > 0 AS has_more FROM nodes WHERE {LIVE} AND status = 'open'")(lambda n: listing.page_info(listing.list_nodes(n, status=["open"]), 0))
    add("unclaimed", "nodes", "SELECT id, CASE WHEN status = 'in_progress' AND assignee IS NOT NULL THEN 'ok' ELSE 'invalid_transition' END AS outcome, CASE WHEN status = 'in_progress' AND assignee IS NOT NULL THEN 'open' ELSE status END AS status, CASE WHEN NOT (status = 'in_progress' AND assignee IS NOT NULL) THEN assignee END AS assignee FROM nodes")(lambda n: lifecycle.unclaim(n, "shift over").select("id", "outcome", "status", "assignee"))
    _prefix = "starts_with(n.id, m.old || '.') OR n.id = m.old"
    add("rebased", "nodes", f"WITH m AS (SELECT id AS old, concat('NEW-', seq) AS new FROM nodes WHERE (depth = 1 AND seq % 7 = 0) OR (depth = 2 AND seq % 3 = 0)), c AS (SELECT id, unnest([array_to_string(string_split(id, '.')[1:k], '.') FOR k IN range(1, len(string_split(id, '.')) + 1)]) AS p FROM nodes), b AS (SELECT c.id, arg_max(m.old, length(m.old)) AS old, arg_max(m.new, length(m.old)) AS new FROM c JOIN m ON m.old = c.p GROUP BY 1) SELECT n.id, CASE WHEN b.id IS NULL THEN n.id ELSE b.new || substr(n.id, length(b.old) + 1) END AS new_id FROM nodes n LEFT JOIN b USING (id)")(lambda n: hierarchy.rebased(n.select("id"), _moves(n)))
    add("renamed_events", "ev", "SELECT event_id, CASE WHEN node_id = 'E-3' OR starts_with(node_id, 'E-3.') THEN 'E-77' || substr(node_id, 4) ELSE node_id END AS node_id FROM ev")(lambda e: hierarchy.renamed_everywhere({"events": (e, ["node_id"])}, "E-3", "E-77")["events"].select("event_id", "node_id"))
    add("firing_rate", "firings", f"SELECT hook, node_id, count(*) AS n, count(*) >= 2 AS limited FROM firings WHERE outcome = 'delivered' AND fired_at >= TIMESTAMP '{LATE}' - INTERVAL 1 HOUR GROUP BY 1, 2")(lambda f: aggregates.firing_rate(f, LATE, 2))
    add("newest_firings", "firings", "SELECT event_id, hook, node_id, outcome FROM firings ORDER BY fired_at DESC, event_id DESC, hook LIMIT 40")(lambda f: aggregates.newest_firings(f, 40).select("event_id", "hook", "node_id", "outcome"))
    add("session_summary", "nodes sessions", "WITH s AS (SELECT id, status FROM sessions WHERE agent_id = 'agent-3' ORDER BY started_at DESC, id DESC LIMIT 1) SELECT s.id AS session_id, s.status, count(n.id) AS created, count(*) FILTER (n.status = 'done') AS done, count(*) FILTER (n.status = 'deferred') AS deferred FROM s LEFT JOIN nodes n ON n.session_id = s.id GROUP BY 1, 2")(lambda n, s: aggregates.session_summary(n, s, "agent-3").select("session_id", "status", "created", "done", "deferred"))
    add("uid_of_path", "nodes edges", f"SELECT e.from_id AS id, e.to_id, CASE WHEN n.seq % 6 <> 0 THEN concat('u-', n.id) END AS uid FROM edges e LEFT JOIN nodes n ON n.id = e.from_id AND n.{LIVE}")(lambda n, e: listing.with_uids(e.select(F.col("from_id").alias("id"), "to_id"), _uids(n)))
    add("siblings", "nodes", f"SELECT parent_id, id, count(*) OVER (PARTITION BY parent_id) - 1 AS n_siblings FROM nodes WHERE {LIVE} AND parent_id IS NOT NULL QUALIFY n_siblings > 0")(hierarchy.siblings)
    add("duplicate_uids", "nodes", "SELECT title AS uid, count(*) AS n, min(id) AS first_id FROM nodes GROUP BY 1 HAVING count(*) > 1")(lambda n: events.duplicate_uids(n.withColumn("uid", F.col("title"))))
    add("uid_conflicts", "nodes", "WITH i AS (SELECT CASE WHEN seq % 3 = 0 THEN concat(id, '9') ELSE id END AS id, CASE WHEN seq % 5 = 0 THEN concat('x-', id) ELSE concat('u-', id) END AS uid FROM nodes), l AS (SELECT id, CASE WHEN seq % 6 <> 0 THEN concat('u-', id) END AS uid FROM nodes) SELECT i.id, 'moved' AS kind FROM i JOIN l ON l.uid = i.uid AND l.id <> i.id UNION SELECT i.id, 'taken' FROM i JOIN l ON l.id = i.id AND l.uid <> i.uid")(lambda n: events.uid_conflicts(_incoming(n), _uids(n)))
    add("project_fields", "nodes", f"SELECT id, title, status FROM nodes WHERE {LIVE}")(lambda n: listing.project_fields(listing.live(n), ["id", "title", "status", "id"]))
    add("new_numbers", "nodes", f"WITH m AS (SELECT parent_id, max(seq) AS s FROM nodes GROUP BY 1) SELECT concat_ws('.', p.id, 1 + coalesce(m.s, 0)) AS id FROM nodes p LEFT JOIN m ON m.parent_id = p.id WHERE {LIVE} AND status NOT IN {TERMINAL}")(lambda n: lifecycle.numbered(n.select(F.col("id").alias("parent_id"), F.lit("new").alias("title")), n).select("id"))
    add("dry_numbers", "nodes", f"WITH m AS (SELECT parent_id, count(*) AS c FROM nodes WHERE {LIVE} GROUP BY 1) SELECT concat_ws('.', p.id, 1 + coalesce(m.c, 0)) AS id FROM nodes p LEFT JOIN m ON m.parent_id = p.id")(lambda n: lifecycle.dry_numbers(n.select(F.col("id").alias("parent_id"), F.lit("new").alias("title")), n).select("id"))
    add("natural_neighbours", "nodes", "WITH k AS (SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY seq) AS r FROM nodes WHERE parent_id IS NOT NULL) SELECT id, r AS place FROM k")(
        lambda n: n.filter("parent_id is not null").select("id", F.row_number().over(_by_parent()).cast("long").alias("place"))
    )
    add("imported", "nodes", f"SELECT id, CASE WHEN depth = 3 AND seq = 1 THEN concat(title, '!') ELSE title END AS title, CASE WHEN seq % 6 <> 0 THEN concat('u-', id) WHEN depth < 3 OR seq = 1 THEN concat('new-', id) END AS uid FROM nodes")(
        lambda n: integrity.merged(_uids(n).filter("depth > 0 or seq % 6 <> 0").select("id", "title", "uid", F.col("title").alias("content_hash")), _arriving(n)).select("id", "title", "uid")
    )
    add("verify_hashes", "nodes", "SELECT id FROM nodes WHERE seq % 9 = 0")(
        lambda n: integrity.wrong_hashes(n.select("id", "title", *[F.lit("").alias(c) for c in ("description", "prompt", "acceptance")], F.array_compact(F.array("label")).alias("labels")).withColumn("content_hash", F.when(F.substring_index(F.replace("id", F.lit("-"), F.lit(".")), ".", -1).cast("long") % 9 == 0, "stale").otherwise(ids.content_hash(F.col("title"), F.col("description"), F.col("prompt"), F.col("acceptance"), F.col("labels")))))
    )


def _by_parent():
    from pyspark.sql import Window

    return Window.partitionBy("parent_id").orderBy(ids.natural(F.col("id")))


def _arriving(n: DataFrame) -> DataFrame:
    """An export: all but deep rows past the first, some with other titles, some without a uid."""
    title = F.when((F.col("depth") == 3) & (F.col("seq") == 1), F.concat("title", F.lit("!"))).otherwise(F.col("title"))
    rows = n.filter("depth < 3 or seq = 1").withColumn("t", title)
    return rows.select("id", F.col("t").alias("title"), F.when(F.col("seq") % 6 == 0, F.concat(F.lit("new-"), "id")).alias("uid"), F.concat("t", F.when(F.col("seq") % 6 == 0, F.lit("#")).otherwise(F.lit(""))).alias("content_hash"))
