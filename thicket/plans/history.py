"""Queries on logs as wholes: validation by batches, numbering, rate limits, concurrency, composed transitions, backfill; deep rollups and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions import ids
from thicket.operators import backfill, events, graph, hierarchy, integrity, more, numbering, replay, text, transitions
from thicket.plans.applied import log_of
from thicket.sources import exchange
from thicket.streaming import hooks, journal, ledger, pull

LIVE = "deleted_at IS NULL"
TERMINAL = "('done', 'cancelled', 'invalidated')"
LATE_MS = 1_705_708_800_000
#: Faults put into the log, the same in both languages: what an event then breaks, in the order of the rules.
_FAULTS = [("author", "event_id % 83 = 0"), ("payload", "event_id % 79 = 0"), ("payload_bytes", "event_id % 211 = 0"), ("payload_depth", "event_id % 101 = 0"), ("lamport_limit", "event_id % 89 = 0"), ("clock_entries", "event_id % 97 = 0"), ("clock_value", "event_id % 103 = 0")]
_FUTURE, _STALE = f"wall_ms > {LATE_MS} + 86400000", f"wall_ms < {LATE_MS} - 2592000000"
#: A payload that is empty breaks no rule on its size or depth, one that is too long isn't deep; of clocks the longer comes first.
_HOLDS = {"payload_bytes": "event_id % 79 <> 0 AND event_id % 211 = 0", "payload_depth": "event_id % 79 <> 0 AND event_id % 211 <> 0 AND event_id % 101 = 0", "clock_value": "event_id % 97 <> 0 AND event_id % 103 = 0"}
_TESTS = [(name, _HOLDS.get(name, test)) for name, test in _FAULTS] + [("future", _FUTURE)]


def _faulty(e: DataFrame) -> DataFrame:
    """The log with some events broken; clocks hold the author's entry, and in some texts brackets stand inside strings."""
    is_ = lambda name: F.expr(dict(_FAULTS)[name])
    deep = F.concat(F.repeat(F.lit("["), F.lit(11)), F.repeat(F.lit("]"), F.lit(11)))
    long = F.to_json(F.struct(F.repeat(F.lit("x"), F.lit(70_000)).alias("body")))
    payload = F.when(is_("payload"), "").when(is_("payload_bytes"), long).when(is_("payload_depth"), deep).otherwise(F.to_json(F.struct(F.repeat(F.lit("["), F.lit(20)).alias("body"))))
    many = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(101)), lambda i: F.concat(F.lit("w"), i)), F.transform(F.sequence(F.lit(1), F.lit(101)), lambda i: i.cast("long")))
    own = F.map_from_arrays(F.array("author"), F.array(F.when(is_("clock_value"), F.lit(2**53)).otherwise(F.col("lamport"))))
    rows = e.select("event_id", "node_id", "author", "machine", "wall_ms", "lamport", "arrival", F.col("op").alias("op_type"))
    return rows.withColumns({"payload": payload, "clock": F.when(is_("clock_entries"), many).otherwise(own), "lamport": F.when(is_("lamport_limit"), F.lit(2**53)).otherwise(F.col("lamport")), "author": F.when(is_("author"), "No Name").otherwise(F.col("author")), "batch": F.floor(F.col("arrival") / 50)})


#: Field writes by five authors on twenty nodes; a clock knows its author's own earlier events, and all of earlier epochs.
_WRITES = "SELECT event_id, arrival, concat('N-', CAST(substring(author, 2) AS INT) % 20) AS node_id, concat('w', event_id % 5) AS author, CAST(floor(arrival / 400) AS BIGINT) AS epoch FROM log WHERE op IN ('update_field', 'set_acceptance', 'set_prompt')"


def _clocked(e: DataFrame) -> DataFrame:
    rows = e.sparkSession.sql(_WRITES.replace("FROM log", "FROM {log}"), log=e)
    own = numbering.numbered(rows, ["node_id", "author"], ["arrival"], F.floor(F.col("arrival") / 10_000), "at")
    per = rows.groupBy("node_id", "epoch", "author").agg(F.count("*").alias("n")).withColumnRenamed("author", "known")
    # five authors at most by node and epoch, whatever the number of epochs; what each wrote before comes by a running sum
    grid = rows.select("node_id", "epoch").distinct().join(rows.select("node_id", F.col("author").alias("known")).distinct(), "node_id")
    each = grid.join(per, ["node_id", "epoch", "known"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    upto = numbering.running(each, ["node_id", "known"], ["epoch"], F.floor(F.col("epoch") / 1_000), "n", "upto")
    seen = upto.select("node_id", "epoch", "known", (F.col("upto") - F.col("n")).alias("n")).filter("n > 0")
    past = seen.groupBy("node_id", "epoch").agg(F.map_from_entries(F.collect_list(F.struct("known", "n"))).alias("past"))
    clock = F.map_concat(F.map_filter(F.coalesce("past", F.create_map().cast("map<string,bigint>")), lambda k, _: k != F.col("author")), F.map_from_arrays(F.array("author"), F.array("at")))
    return own.join(past, ["node_id", "epoch"], "left").select("node_id", "event_id", "author", clock.alias("clock"))


def _transitions(e: DataFrame) -> DataFrame:
    return e.filter("op = 'transition_status'").select("node_id", "arrival", F.col("to_status").alias("to"), F.timestamp_millis("wall_ms").alias("at"))


def _born(e: DataFrame) -> DataFrame:
    """The nodes that transitions name, open but for some."""
    some = F.when(F.expr("length(id) % 3 = 0"), "in_progress").otherwise("open")
    named = e.filter("op = 'transition_status'").select(F.col("node_id").alias("id")).distinct()
    return named.select("id", some.alias("status"), F.lit(0.25).alias("progress"), F.lit(None).cast("timestamp").alias("deleted_at"))


_ALLOWED = ", ".join(f"'{a}>{b}'" for a, b in [("open", x) for x in ("in_progress", "deferred", "cancelled", "blocked", "invalidated")] + [("in_progress", x) for x in ("done", "deferred", "cancelled", "open", "blocked", "invalidated")] + [("blocked", x) for x in ("open", "in_progress", "cancelled", "invalidated")] + [("done", x) for x in ("open", "invalidated")] + [("deferred", x) for x in ("open", "in_progress", "cancelled", "invalidated")] + [("cancelled", x) for x in ("open", "invalidated")] + [("invalidated", x) for x in ("open", "in_progress", "deferred", "cancelled")])

_FOLD = f"""t AS (SELECT node_id AS id, to_status AS t, make_timestamp(wall_ms * 1000) AS tm, row_number() OVER (PARTITION BY node_id ORDER BY arrival) AS k FROM log WHERE op = 'transition_status'),
r(id, k, status, previous_status, closed_at, progress, moves, refused) AS (
  SELECT DISTINCT id, CAST(0 AS BIGINT), CASE WHEN length(id) % 3 = 0 THEN 'in_progress' ELSE 'open' END, CAST(NULL AS VARCHAR), CAST(NULL AS TIMESTAMP), CAST(0.25 AS DOUBLE), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM t
  UNION ALL SELECT id, tk, CASE WHEN m THEN t ELSE status END, CASE WHEN m AND t IN ('blocked', 'invalidated') THEN status ELSE previous_status END,
    CASE WHEN m AND t IN ('done', 'cancelled') THEN tm WHEN m AND status IN ('done', 'cancelled') AND t = 'open' THEN NULL ELSE closed_at END, CASE WHEN m AND t = 'done' THEN 1.0 ELSE progress END, moves + CAST(m AS BIGINT), refused + CAST(NOT m AND t <> status AS BIGINT)
  FROM (SELECT r.*, t.t, t.tm, t.k AS tk, concat(r.status, '>', t.t) IN ({_ALLOWED}) AS m FROM r JOIN t ON t.id = r.id AND t.k = r.k + 1) s)"""


def _ranked(e: DataFrame) -> DataFrame:
    asks = e.select(F.concat(F.lit("h"), F.col("event_id") % 2).alias("hook"), F.concat(F.lit("N-"), F.col("event_id") % 3).alias("node_id"), F.col("event_id").alias("seq"), F.col("wall_ms").alias("at_ms"))
    return ledger.limited(asks, 2)


_LIMITED = """a AS (SELECT concat('h', event_id % 2) AS hook, concat('N-', event_id % 3) AS node_id, CAST(event_id AS BIGINT) AS seq, wall_ms AS tm, row_number() OVER (PARTITION BY event_id % 2, event_id % 3 ORDER BY wall_ms, event_id) AS k FROM ev),
r(hook, node_id, k, seq, fires, times) AS (
  SELECT hook, node_id, CAST(0 AS BIGINT), CAST(-1 AS BIGINT), false, CAST([] AS BIGINT[]) FROM a WHERE k = 1
  UNION ALL SELECT hook, node_id, k, seq, len(lately) < 2, CASE WHEN len(lately) < 2 THEN list_append(lately, tm) ELSE lately END
  FROM (SELECT a.hook, a.node_id, a.k, a.seq, a.tm, list_filter(r.times, lambda x: x >= a.tm - 3600000) AS lately FROM r JOIN a ON a.hook = r.hook AND a.node_id = r.node_id AND a.k = r.k + 1) s)
SELECT hook, node_id, seq, fires FROM r WHERE k > 0"""


def _told(n: DataFrame) -> DataFrame:
    """Nodes with prompts, their authors, and notes."""
    prompt = F.when(F.col("depth") < 3, F.concat(F.lit("Do "), "title", F.lit(" "), F.repeat(F.lit("well "), (F.col("seq") % 7).cast("int"))))
    creator = F.when(F.col("seq") % 2 == 0, F.lit("agent-7")).otherwise("ann")
    note = F.struct(F.lit("bob").alias("author"), F.concat(F.lit("see "), F.col("id")).alias("text"), (F.col("seq") % 3 == 0).alias("resolved"))
    return n.withColumns({"prompt": prompt, "creator": creator, "annotations": F.when(F.col("seq") % 5 == 0, F.array(note))})


_SECTION = """s AS (SELECT id, depth, '## ' || upper(CASE depth WHEN 0 THEN 'epic' WHEN 1 THEN 'story' WHEN 2 THEN 'issue' ELSE 'micro' END) || ' ' || id || ': ' || title || chr(10) AS head,
  CASE WHEN depth < 3 THEN chr(10) || CASE WHEN seq % 2 = 0 THEN '[LLM-GENERATED]' ELSE '[HUMAN-AUTHORED]' END || chr(10) || 'Do ' || title || ' ' || repeat('well ', CAST(seq % 7 AS INT)) || chr(10) ELSE '' END || CASE WHEN seq % 5 = 0 AND seq % 3 <> 0 THEN chr(10) || '[ANNOTATION by bob]' || chr(10) || 'see ' || id || chr(10) ELSE '' END AS rest FROM nodes WHERE deleted_at IS NULL),
c AS (SELECT n.id, s.depth, s.head, s.head || s.rest AS body, strlen(s.head || s.rest) // 4 AS whole, strlen(s.head) // 4 AS short FROM (SELECT id, unnest([array_to_string(string_split(id, '.')[1:k], '.') FOR k IN range(1, len(string_split(id, '.')) + 1)]) AS p FROM nodes WHERE deleted_at IS NULL) n JOIN s ON s.id = n.p)"""
_RULE = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
BUDGET = 60
_PROMPT = f"WITH {_SECTION}, b AS (SELECT to_id AS id, string_agg('- ' || from_id || ' blocks this node' || chr(10), '' ORDER BY from_id) AS held FROM edges e JOIN nodes n ON n.id = e.from_id WHERE n.{LIVE} AND n.status NOT IN {TERMINAL} GROUP BY 1) SELECT c.id, string_agg(body, {_RULE} ORDER BY depth) || coalesce({_RULE} || '## Blocking Dependencies' || chr(10) || max(held), '') AS prompt FROM c LEFT JOIN b USING (id) GROUP BY c.id"
#: Ancestors above the parent are at most two here: the first is tried, then the second.
_BUDGET = f"""WITH {_SECTION}, g AS (SELECT id, max(depth) AS d, sum(whole) FILTER (depth >= m - 1) AS kept, max(head) FILTER (depth = 0 AND m >= 2) AS h0, max(body) FILTER (depth = 0 AND m >= 2) AS b0, max(short) FILTER (depth = 0 AND m >= 2) AS s0, max(whole) FILTER (depth = 0 AND m >= 2) AS w0,
  max(head) FILTER (depth = 1 AND m >= 3) AS h1, max(body) FILTER (depth = 1 AND m >= 3) AS b1, max(short) FILTER (depth = 1 AND m >= 3) AS s1, max(whole) FILTER (depth = 1 AND m >= 3) AS w1, string_agg(body, {_RULE} ORDER BY depth) FILTER (depth >= m - 1) AS tail FROM (SELECT *, max(depth) OVER (PARTITION BY id) AS m FROM c) x GROUP BY id),
f AS (SELECT *, CASE WHEN kept + w0 <= {BUDGET} THEN 'full' WHEN kept + s0 <= {BUDGET} THEN 'head' WHEN w0 IS NOT NULL THEN 'none' END AS c0 FROM g),
u AS (SELECT *, kept + CASE c0 WHEN 'full' THEN w0 WHEN 'head' THEN s0 ELSE 0 END AS used FROM f),
v AS (SELECT *, CASE WHEN used + w1 <= {BUDGET} THEN 'full' WHEN used + s1 <= {BUDGET} THEN 'head' WHEN w1 IS NOT NULL THEN 'none' END AS c1 FROM u)
SELECT id, concat_ws({_RULE}, CASE c0 WHEN 'full' THEN b0 WHEN 'head' THEN h0 END, CASE c1 WHEN 'full' THEN b1 WHEN 'head' THEN h1 END, tail) || CASE WHEN coalesce(c0 = 'none', false) OR coalesce(c1 = 'none', false) THEN chr(10) || chr(10) || '[TRUNCATED: ' || (CAST(coalesce(c0 = 'none', false) AS INT) + CAST(coalesce(c1 = 'none', false) AS INT)) || ' ancestor prompts omitted due to token budget]' ELSE '' END AS prompt FROM v"""

_DEEP = """WITH x AS (SELECT c_custkey AS c FROM customer),
r(c, k, v) AS (SELECT c, 50, CAST(c % 4 AS DOUBLE) / 4 FROM x
  UNION ALL SELECT c, k - 1, CASE WHEN e1 * w1 + e2 * w2 = 0 THEN 0.0 ELSE (e1 * w1 * v + e2 * w2 * p2) / (e1 * w1 + e2 * w2) END FROM (SELECT c, k, v, CASE WHEN (c * 31 + k) % 97 = 0 THEN 0 ELSE 1 END AS e1, CAST(1 + k % 3 AS DOUBLE) AS w1, CASE WHEN (c + k) % 5 = 0 THEN 0 ELSE 1 END AS e2, CAST(1 + (c + k) % 2 AS DOUBLE) AS w2, CAST(k % 2 AS DOUBLE) AS p2 FROM r WHERE k > 0) s)
SELECT concat('D', c % 7, '-', c + 1, repeat('.1', k)) AS id, round(v + 1e-9, 6) AS progress FROM r
UNION ALL SELECT concat('D', c % 7, '-', c + 1, repeat('.1', k - 1), '.2'), round(CAST(k % 2 AS DOUBLE) + 1e-9, 6) FROM r WHERE k > 0"""


def _with_text(n: DataFrame) -> DataFrame:
    return n.withColumns({"description": F.when(F.col("seq") % 4 == 0, F.concat(F.lit("about "), "title")), "uid": F.when(F.col("seq") % 2 == 0, F.concat(F.lit("u-"), "id")), "creator": F.lit("Ann Lee")})


def _versions(e: DataFrame) -> DataFrame:
    tag = F.expr("CASE event_id % 5 WHEN 0 THEN '-alpha' WHEN 1 THEN '-beta' WHEN 2 THEN '+b7' WHEN 3 THEN '-rc.1+x' ELSE '' END")
    return e.select("event_id", F.when(F.col("event_id") % 17 == 0, "dev").otherwise(F.concat(F.expr("CASE event_id % 2 WHEN 0 THEN 'v' ELSE '' END"), F.col("event_id") % 3, F.lit("."), F.col("event_id") % 11, F.lit(".0"), tag)).alias("v"))


_VERSION = "SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE CASE WHEN a <> 1 THEN a > 1 WHEN b <> 10 THEN b > 10 ELSE tag = '' OR tag >= 'beta' END END AS enough FROM (SELECT event_id, event_id % 3 AS a, event_id % 11 AS b, CASE event_id % 5 WHEN 0 THEN 'alpha' WHEN 1 THEN 'beta' WHEN 3 THEN 'rc.1' ELSE '' END AS tag FROM ev) x"


def _inbox(e: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Deliveries of comments, what is acknowledged (most), and cursors."""
    own = e.filter("op_type = 'comment'").select(F.col("author").alias("agent"), F.col("event_id").cast("long").alias("seq"))
    return own, own.filter("seq % 7 <> 0"), e.groupBy(F.col("author").alias("agent")).agg((F.max("user_id") % 3).cast("long").alias("cursor"))


def register(add) -> None:
    tests = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in _TESTS)
    any_ = " OR ".join(f"({test})" for _, test in _TESTS)
    add("hub_validation", "log", f"SELECT event_id, concat_ws(',', {tests}) AS faults, {_STALE} AS stale FROM log WHERE {any_} OR {_STALE}")(lambda e: events.violations(_faulty(e), LATE_MS))
    first = f"CASE {' '.join(f"WHEN {test} THEN '{name}'" for name, test in _TESTS)} END"
    add("hub_batches", "log", f"WITH b AS (SELECT CAST(floor(arrival / 50) AS BIGINT) AS batch, arrival, event_id, {first} AS fault FROM log) SELECT batch, count(fault) = 0 AS accepted, arg_min(event_id, arrival) FILTER (fault IS NOT NULL) AS event_id, arg_min(fault, arrival) FILTER (fault IS NOT NULL) AS fault FROM b GROUP BY 1")(lambda e: events.batch_verdicts(_faulty(e), LATE_MS))
    add("rollup_deep", "chains", _DEEP, recursive=True)(lambda n: hierarchy.rollup(n).select("id", F.round(F.col("progress") + 1e-9, 6).alias("progress")))
    add("emitted_clocks", "ev", "SELECT event_id, 100 + row_number() OVER (ORDER BY ts, node_id, op_type) AS lamport, row_number() OVER (PARTITION BY author ORDER BY ts, node_id, op_type) AS author_clock FROM ev")(lambda e: more.emitted(e.select("event_id", "node_id", "op_type", "author", F.col("ts").alias("at")), 100).select("event_id", "lamport", "author_clock"))
    add("rate_limited", "ev", f"WITH {_LIMITED}", recursive=True)(_ranked)
    add("concurrent_counts", "log", f"WITH w AS ({_WRITES}) SELECT node_id, event_id, count(*) OVER (PARTITION BY node_id, epoch) - count(*) OVER (PARTITION BY node_id, epoch, author) AS concurrent FROM w")(lambda e: events.concurrent_counts(_clocked(e)).select("node_id", "event_id", "concurrent"))
    add("transition_log", "log", f"WITH {_FOLD} SELECT id, status, previous_status, closed_at, progress, moves, refused FROM r QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC) = 1", recursive=True)(lambda e: transitions.applied(_born(e), _transitions(e)))
    add("backfill_nodes", "nodes edges", f"SELECT id, title, status, assignee, CASE WHEN seq % 4 = 0 THEN 'about ' || title END AS description FROM nodes WHERE {LIVE}")(lambda n, e: replay.replay(backfill.backfilled(_with_text(n), e), backfilled=True).select("id", "title", "status", "assignee", "description"))
    add("backfill_edges", "nodes edges", "SELECT from_id, to_id, dep_type FROM edges")(lambda n, e: replay.replay_edges(backfill.backfilled(_with_text(n), e), backfilled=True))
    kinds = f"SELECT id, created_at, 0 AS step, 'create_node' AS op_type FROM nodes WHERE {LIVE} UNION ALL SELECT id, created_at, 1, 'update_field' FROM nodes WHERE {LIVE} AND seq % 4 = 0 UNION ALL SELECT id, created_at, 4, 'update_field' FROM nodes WHERE {LIVE} AND assignee IS NOT NULL UNION ALL SELECT id, created_at, 9, 'transition_status' FROM nodes WHERE {LIVE} AND status <> 'open'"
    add("backfill_order", "nodes edges", f"WITH k AS ({kinds}), o AS (SELECT id AS node_id, op_type, row_number() OVER (ORDER BY created_at, id, step) AS lamport FROM k) SELECT * FROM o UNION ALL SELECT from_id, 'link_dep', (SELECT count(*) FROM k) + row_number() OVER (ORDER BY from_id, to_id, dep_type) FROM edges")(lambda n, e: backfill.backfilled(_with_text(n), e).select("node_id", "op_type", "lamport"))
    add("prompts_full", "nodes edges", _PROMPT)(lambda n, e: text.all_prompts(_told(n), graph.blockers(n, e)))
    add("prompts_budget", "nodes", _BUDGET)(lambda n: text.all_prompts(_told(n), budget=BUDGET))
    add("version_order", "ev", _VERSION)(lambda e: _versions(e).select("event_id", (ids.semver(F.col("v")) >= ids.semver(F.lit("1.10.0-beta"))).alias("enough")))
    add("sync_states", "ev", "SELECT author, CASE WHEN conflicts > 0 THEN 'divergent-pending' WHEN NOT hub THEN 'solo' WHEN errors >= 3 THEN 'hub-unreachable' WHEN local + applied > 0 AND machine <> '' THEN 'sync-active' ELSE 'sync-configured-no-hub' END AS state FROM (SELECT author, count(*) FILTER (event_id % 101 = 0) AS conflicts, min(user_id) % 4 <> 0 AS hub, min(user_id) % 5 AS errors, count(*) FILTER (event_id % 50 = 1) AS local, count(*) FILTER (event_id % 50 = 2) AS applied, CASE WHEN min(user_id) % 3 = 0 THEN '' ELSE min(machine) END AS machine FROM ev GROUP BY 1) x")(
        lambda e: e.groupBy("author").agg(F.count_if(F.expr("event_id % 101 = 0")).alias("conflicts"), (F.min("user_id") % 4 != 0).alias("hub"), (F.min("user_id") % 5).alias("errors"), F.count_if(F.expr("event_id % 50 = 1")).alias("local"), F.count_if(F.expr("event_id % 50 = 2")).alias("applied"), F.when(F.min("user_id") % 3 == 0, "").otherwise(F.min("machine")).alias("machine")).select("author", more.sync_state(*map(F.col, ("hub", "machine", "errors", "local", "applied", "conflicts"))).alias("state"))
    )
    add("hook_event_names", "log", "SELECT event_id, CASE op WHEN 'create_node' THEN 'node.created' WHEN 'transition_status' THEN 'status.changed' WHEN 'comment' THEN CASE WHEN event_id % 3 = 0 THEN 'comment.addressed' END END AS name FROM log")(lambda e: hooks.named(log_of(e)).select("event_id", "name"))
    add("fan_out", "log", "SELECT 'board' AS subscriber, event_id FROM log WHERE op IN ('create_node', 'transition_status') OR op = 'comment' AND event_id % 3 = 0 UNION ALL SELECT 'near', event_id FROM log WHERE op = 'transition_status' AND (node_id = 'E-3' OR starts_with(node_id, 'E-3.'))")(
        lambda e: ledger.fanned_out(hooks.normalised(log_of(e)), F.col("name"), e.sparkSession.createDataFrame([("board", [], ""), ("near", ["status.changed"], "E-3")], "subscriber string, events array<string>, under string"))
    )
    swept = "WITH m AS (SELECT node_id, concat('uid', event_id % 3) AS uid, min(event_id) AS event_id FROM ev WHERE op_type = 'create_node' GROUP BY 1, 2), l AS (SELECT *, first_value(event_id) OVER (PARTITION BY node_id ORDER BY event_id) AS winner FROM m) SELECT node_id, concat(node_id, uid) AS uid, event_id, winner FROM l WHERE event_id <> winner AND event_id % 2 = 0"
    add("sweep_preview", "ev", swept)(_swept)
    add("inbox_cursors", "ev", "WITH d AS (SELECT author AS agent, CAST(event_id AS BIGINT) AS seq FROM ev WHERE op_type = 'comment'), c AS (SELECT author AS agent, max(user_id) % 3 AS cursor FROM ev GROUP BY 1), p AS (SELECT d.* FROM d JOIN c USING (agent) WHERE seq > cursor), f AS (SELECT agent, min(seq) AS first FROM p WHERE seq % 7 = 0 GROUP BY 1), t AS (SELECT agent, max(seq) AS done FROM p LEFT JOIN f USING (agent) WHERE first IS NULL OR seq < first GROUP BY 1) SELECT agent, greatest(cursor, done) AS cursor FROM c LEFT JOIN t USING (agent)")(lambda e: journal.closed_gaps(*_inbox(e)))
    add("inbox_acked_through", "ev", "WITH d AS (SELECT author AS agent, CAST(event_id AS BIGINT) AS seq FROM ev WHERE op_type = 'comment'), c AS (SELECT author AS agent, max(user_id) % 3 AS cursor FROM ev GROUP BY 1), a AS (SELECT agent, max(seq) AS s FROM d WHERE seq % 9 = 0 GROUP BY 1) SELECT d.agent, d.seq FROM d JOIN c USING (agent) LEFT JOIN a USING (agent) WHERE d.seq % 7 <> 0 AND d.seq > greatest(cursor, s)")(lambda e: journal.acked_through(*_inbox(e)[1:], _inbox(e)[0].filter("seq % 9 = 0"))[1])
    add("pulled_once", "log", "SELECT event_id, node_id, lamport, op AS op_type FROM log WHERE event_id % 5 <> 0")(_pulled)
    add("pulled_late", "log", "WITH p AS (SELECT event_id, lamport, CAST(floor(arrival / 50) AS BIGINT) AS page FROM log), m AS (SELECT page, max(max(lamport)) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS passed FROM p GROUP BY page) SELECT event_id, page, lamport, passed FROM p JOIN m USING (page) WHERE lamport <= passed")(
        lambda e: pull.late(e.withColumn("page", F.floor(F.col("arrival") / 50)), "page")
    )
    stamp = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
    number = "CASE WHEN {0} = floor({0}) THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"
    add(
        "export_records",
        "nodes",
        f"""SELECT id, sha256('{{"id":"' || id || '","parent_id":"' || coalesce(parent_id, '') || '","depth":' || depth || ',"seq":' || seq || ',"project":"' || project || '","title":"' || title || '","description":"","prompt":"","acceptance":"","node_type":"' || CASE depth WHEN 0 THEN 'epic' WHEN 1 THEN 'story' WHEN 2 THEN 'issue' ELSE 'micro' END || '","issue_type":"","priority":' || priority || ',"labels":"[' || coalesce('\\"' || label || '\\"', '') || ']","status":"' || status || '","progress":' || {number.format('progress')} || ',"assignee":"' || coalesce(assignee, '') || '","creator":"","agent_state":"","weight":' || {number.format('weight')} || ',"content_hash":"","created_at":"' || {stamp.format('created_at')} || '","updated_at":"' || {stamp.format('updated_at')} || '"' || coalesce(',"defer_until":"' || {stamp.format('defer_until')} || '"', '') || coalesce(',"deleted_at":"' || {stamp.format('deleted_at')} || '"', '') || '}}') AS digest FROM nodes""",
    )(lambda n: _records(n.withColumn("labels", F.array_compact(F.array("label")))))
    _more(add)


def _records(n: DataFrame) -> DataFrame:
    return n.select("id", F.sha2(exchange.records(n, exchange.NODE), 256).alias("digest"))


def _pulled(e: DataFrame) -> DataFrame:
    """A log of which every third event is delivered twice and every fifth was applied before."""
    log = log_of(e)
    twice = log.unionByName(log.filter("event_id % 3 = 0"))
    return events.once(twice, log.filter("event_id % 5 = 0")).select("event_id", "node_id", "lamport", "op_type")


def _swept(e: DataFrame) -> DataFrame:
    """What a sweep adds to a ledger that holds the losers with odd first events."""
    creates = e.filter("op_type = 'create_node'").select("event_id", "node_id", "arrival", F.concat("node_id", F.lit("uid"), F.col("event_id") % 3).alias("uid"))
    done = events.duplicate_losers(creates).filter("event_id % 2 = 1").select("uid")
    return events.swept(creates, done)


def _more(add) -> None:
    """Parents that are gone, which whole tables don't show."""
    cut = "CASE WHEN depth = 1 AND seq % 5 = 0 THEN created_at ELSE deleted_at END"
    add("verify_fk_broken", "nodes", f"WITH c AS (SELECT id, parent_id, depth FROM (SELECT *, {cut} AS gone FROM nodes) x WHERE gone IS NULL) SELECT c.id, c.parent_id FROM c LEFT JOIN c p ON p.id = c.parent_id WHERE c.parent_id IS NOT NULL AND p.id IS NULL")(lambda n: integrity.dangling_parents(n.withColumn("deleted_at", F.expr(cut))))
