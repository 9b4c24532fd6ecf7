"""Logs as wholes against plain folds: rollups, numbering, ledgers and limits as streams, concurrency, transitions, backfill, validation, the store."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from thicket.functions.ids import STATUSES
from thicket.operators import backfill, events, hierarchy, more, numbering, replay, text, transitions
from thicket.operators.lifecycle import TRANSITIONS
from thicket.plans import catalogue
from thicket.streaming import hooks, ledger

NODE = "id string, parent_id string, depth int, status string, weight double, progress double, deleted_at timestamp"


def got(frame, *cols):
    return sorted(tuple(r) for r in frame.select(*cols).collect())


def tree_rows(seed, n=120):
    rnd = random.Random(seed)
    paths = ["P-1", "P-2"]
    while len(paths) < n:
        p = f"{rnd.choice(paths)}.{rnd.randrange(4)}"
        if p not in paths and p.count(".") < 9:
            paths.append(p)
    return [(p, p.rpartition(".")[0] or None, p.count("."), rnd.choice(["open", "done", "deferred", "cancelled", "invalidated", "open"]), float(rnd.choice([0, 1, 2, 3.5])), rnd.choice([0.0, 0.25, 0.5, 1.0]), datetime(2026, 1, 1) if rnd.random() < 0.1 else None) for p in paths]


def plain_rollup(rows):
    live = {r[0]: r for r in rows if r[6] is None}

    def value(i):
        kids = [r for r in live.values() if r[1] == i]
        if not kids:
            return live[i][5]
        counted = [(value(k[0]), k[4]) for k in kids if k[3] not in ("cancelled", "invalidated")]
        total = sum(w for _, w in counted)
        return sum(v * w for v, w in counted) / total if total else 0.0

    return {i: value(i) for i in live}


@pytest.mark.parametrize("seed", range(4))
def test_rollup_is_the_recursive_mean(spark, seed):
    rows = tree_rows(seed)
    found = {r.id: r.progress for r in hierarchy.rollup(spark.createDataFrame(rows, NODE)).collect()}
    assert found == pytest.approx(plain_rollup(rows))


def test_rollup_worked_example_and_excluded_children(spark):
    rows = [("P-1", None, 0, "open", 1.0, 0.0, None), ("P-1.1", "P-1", 1, "done", 1.0, 1.0, None), ("P-1.2", "P-1", 1, "open", 1.0, 0.5, None), ("P-1.3", "P-1", 1, "open", 1.0, 0.0, None), ("P-2", None, 0, "open", 1.0, 0.7, None), ("P-2.1", "P-2", 1, "cancelled", 1.0, 1.0, None), ("P-3", None, 0, "open", 1.0, 0.3, None)]
    assert dict(got(hierarchy.rollup(spark.createDataFrame(rows, NODE)), "id", "progress")) == {"P-1": 0.5, "P-1.1": 1.0, "P-1.2": 0.5, "P-1.3": 0.0, "P-2": 0.0, "P-2.1": 1.0, "P-3": 0.3}


def test_rollup_plan_does_not_grow_with_depth(spark):
    def lines(depth):
        chain = ["P-1" + ".1" * k for k in range(depth)]
        frame = spark.createDataFrame([(p, p.rpartition(".")[0] or None, p.count("."), "open", 1.0, 0.5, None) for p in chain], NODE)
        rolled = hierarchy.rollup(frame)
        assert {r.progress for r in rolled.collect()} == {0.5}
        return len(rolled._jdf.queryExecution().optimizedPlan().toString().splitlines())

    assert lines(3) == lines(51)


def test_running_numbers_over_a_hot_key(spark):
    rnd = random.Random(1)
    rows = [("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(5)}", i) for i in rnd.sample(range(100_000), 3_000)] + [(None, 5), (None, 50_000)]
    found = numbering.numbered(spark.createDataFrame(rows, "k string, at long"), ["k"], ["at"], F.floor(F.col("at") / 1000), "n")
    want = []
    for key in {k for k, _ in rows}:
        want += [(key, at, n) for n, at in enumerate(sorted(at for k, at in rows if k == key), 1)]
    assert sorted(map(repr, map(tuple, found.select("k", "at", "n").collect()))) == sorted(map(repr, want))
    whole = numbering.numbered(spark.createDataFrame(rows, "k string, at long"), [], ["at", "k"], F.floor(F.col("at") / 1000), "n", 11)
    assert sorted(r.n for r in whole.collect()) == list(range(11, 11 + len(rows)))


ASK = "hook string, seq long, outcome string"
#: One batch: a stream with timers has none that is the last.
ONCE = {"once": True}


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ledger.ROCKS)


def batch_of(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(path)


def drain(frame, checkpoint, trigger=None):
    """Runs a stream over what is there, and returns the rows that it gives."""
    found = []
    query = frame.writeStream.foreachBatch(lambda df, _: found.extend(map(tuple, df.collect()))).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    if not query.awaitTermination(60):
        query.stop()
        raise AssertionError("the stream doesn't end")
    return found


def test_claims_have_one_winner_across_restarts(spark, rocks, tmp_path):
    source = lambda: spark.readStream.schema(ASK).json(f"{tmp_path}/in")
    run = lambda: sorted(drain(ledger.claims(source(), floor=5, lease=600), f"{tmp_path}/ck", ONCE))
    batch_of(spark, f"{tmp_path}/in", [("a", 7, ""), ("a", 7, ""), ("b", 7, ""), ("a", 5, ""), ("a", 3, "")], ASK)
    assert run() == [("a", 7, False), ("b", 7, False)]  # at and below the floor: refused
    batch_of(spark, f"{tmp_path}/in", [("a", 7, ""), ("a", 8, ""), ("b", 7, "delivered")], ASK)
    assert run() == [("a", 8, False)]  # claims within the lease hold after a restart
    batch_of(spark, f"{tmp_path}/in", [("b", 7, ""), ("c", 9, "delivered")], ASK)
    assert run() == []  # an outcome ends a claim for good; one without a claim is nothing


def test_a_claim_without_outcome_is_handed_out_again(spark, rocks, tmp_path):
    source = lambda: spark.readStream.schema(ASK).json(f"{tmp_path}/in")
    run = lambda: sorted(drain(ledger.claims(source(), lease=0.5), f"{tmp_path}/ck", ONCE))
    batch_of(spark, f"{tmp_path}/in", [("a", 1, ""), ("a", 2, ""), ("a", 2, "failed")], ASK)
    assert run() == [("a", 1, False), ("a", 2, False)]
    time.sleep(1)
    batch_of(spark, f"{tmp_path}/in", [("z", 1, "")], ASK)
    again = run()
    assert ("a", 1, True) in again and ("z", 1, False) in again and not any(s == 2 for _, s, _ in again)


def test_stream_and_batch_give_the_same_claims(spark, rocks, tmp_path):
    asks = [(h, s, "") for h in "abc" for s in range(1, 20)]
    batch_of(spark, f"{tmp_path}/in", asks, ASK)
    stream = sorted(x[:2] for x in drain(ledger.claims(spark.readStream.schema(ASK).json(f"{tmp_path}/in"), floor=10), f"{tmp_path}/ck", ONCE))
    empty = spark.createDataFrame([], hooks.LEDGER)
    assert stream == got(hooks.claimed(spark.createDataFrame(asks, ASK), empty, 10, "2026-01-01"), "hook", "seq")


def plain_limits(rows, most):
    kept, out = {}, {}
    for hook, node, seq, at in sorted(rows, key=lambda r: (r[0], r[1], r[3], r[2])):
        lately = [t for t in kept.get((hook, node), []) if t >= at - 3_600_000]
        out[hook, node, seq] = len(lately) < most
        kept[hook, node] = lately + [at] * out[hook, node, seq]
    return out


def test_limits_as_table_and_as_stream(spark, rocks, tmp_path):
    """A thousand asks of one key, and others, over ten hours with idle ones; the stream gets them in three parts."""
    rnd = random.Random(2)
    rows = [("h", "P-1", i, rnd.choice([0, 1, 2, 5, 6, 9]) * 3_600_000 + rnd.randrange(3_600_000)) for i in range(1_000)]
    rows += [(rnd.choice("hg"), f"P-{rnd.randrange(2, 5)}", 1_000 + i, rnd.randrange(36_000_000)) for i in range(300)]
    schema = "hook string, node_id string, seq long, at_ms long"
    want = plain_limits(rows, ledger.PER_HOUR)
    table = {tuple(r)[:3]: r.fires for r in ledger.limited(spark.createDataFrame(rows, schema)).collect()}
    assert table == want and 0 < sum(want.values()) < len(want)
    rows.sort(key=lambda r: r[3])
    found = {}
    for k in range(3):
        batch_of(spark, f"{tmp_path}/in", rows[k * 434 : (k + 1) * 434], schema)
        found |= {x[:3]: x[3] for x in drain(ledger.limits(spark.readStream.schema(schema).json(f"{tmp_path}/in")), f"{tmp_path}/ck")}
    assert found == want


def test_limit_edge_is_inclusive(spark):
    rows = [("h", "P-1", 1, 0), ("h", "P-1", 2, 3_600_000), ("h", "P-1", 3, 3_600_001)]
    found = ledger.limited(spark.createDataFrame(rows, "hook string, node_id string, seq long, at_ms long"), 1)
    assert got(found, "seq", "fires") == [(1, True), (2, False), (3, True)]


def test_dispatch_fires_once_and_keeps_its_floor(spark, rocks, tmp_path):
    schema = "event_id long, op_type string, node_id string, author string, payload string, via_hook string"
    rules, _ = hooks.checked([{"name": "ended", "match": {"events": ["status.changed"], "under": "P-1"}, "deliver": ["inbox"]}, {"name": "asked", "match": {"events": ["comment.addressed"]}, "deliver": ["inbox"]}])
    fired = []
    for rows in ([(1, "transition_status", "P-1.2", "a", '{"to": "done"}', None), (2, "transition_status", "P-12", "a", '{"to": "done"}', None), (3, "comment", "P-9", "a", "{}", None)], [(1, "transition_status", "P-1.2", "a", '{"to": "done"}', None), (4, "comment", "P-9", "a", '{"to": "bob"}', None), (5, "claim", "P-1", "a", "{}", None)]):
        batch_of(spark, f"{tmp_path}/in", rows, schema)
        (tmp_path / "out").mkdir(exist_ok=True)
        ledger.dispatch(spark.readStream.schema(schema).json(f"{tmp_path}/in"), hooks.table_of(spark, rules), spark.readStream.schema(ASK).json(f"{tmp_path}/out"), lambda df, n: fired.extend(tuple(r)[:2] for r in df.collect()), f"{tmp_path}/ck", trigger=ONCE).awaitTermination(60)
    assert sorted(fired) == [("asked", 4), ("ended", 1)]


@pytest.mark.parametrize("seed", range(3))
def test_concurrent_counts_are_those_of_all_pairs(spark, seed, monkeypatch):
    """Histories in which writers read each other's clocks at random, many on one node; positions counted in small slices."""
    monkeypatch.setattr(events, "POSITIONS", 4)
    rnd = random.Random(seed)
    clocks, rows = {}, []
    for i in range(160):
        node, author = ("N-1" if rnd.random() < 0.6 else f"N-{rnd.randrange(2, 4)}"), f"w{rnd.randrange(4)}"
        own = dict(clocks.get((node, author), {}))
        if rnd.random() < 0.4:
            other = clocks.get((node, f"w{rnd.randrange(4)}"), {})
            own = {a: max(own.get(a, 0), other.get(a, 0)) for a in {*own, *other}}
        own[author] = own.get(author, 0) + 1
        clocks[node, author] = own
        rows.append((node, i, author, own))
    inside = lambda a, b: all(b.get(k, 0) >= v for k, v in a.items())
    want = sorted((n, i, sum(1 for m, j, _, d in rows if m == n and i != j and not inside(c, d) and not inside(d, c))) for n, i, _, c in rows)
    found = events.concurrent_counts(spark.createDataFrame(rows, "node_id string, event_id long, author string, clock map<string,bigint>"))
    assert got(found, "node_id", "event_id", "concurrent") == want
    assert any(w[2] for w in want)


def plain_transitions(start, log):
    state = {"status": start, "previous": None, "closed": None, "progress": 0.25, "moves": 0, "refused": 0}
    for _, to, at in sorted(log):
        was = state["status"]
        if to == was:
            continue
        if to not in TRANSITIONS[was]:
            state["refused"] += 1
            continue
        if to in ("done", "cancelled"):
            state["closed"] = at
        elif was in ("done", "cancelled") and to == "open":
            state["closed"] = None
        if to in ("blocked", "invalidated"):
            state["previous"] = was
        if to == "done":
            state["progress"] = 1.0
        state["status"], state["moves"] = to, state["moves"] + 1
    return tuple(state.values())


def test_transitions_compose_as_they_fold(spark, monkeypatch):
    """One node holds most of the log; parts are so small that their maps are composed over several rounds."""
    monkeypatch.setattr(transitions, "PART", 4)
    rnd = random.Random(4)
    start = {f"P-{k}": rnd.choice(STATUSES) for k in range(12)}
    log = [("P-1" if rnd.random() < 0.5 else f"P-{rnd.randrange(11)}", i * 977, rnd.choice(STATUSES), datetime(2026, 1, 1) + timedelta(minutes=i)) for i in range(500)]
    nodes = spark.createDataFrame([(i, s, 0.25, None) for i, s in start.items()], "id string, status string, progress double, deleted_at timestamp")
    found = {r[0]: tuple(r)[1:] for r in transitions.applied(nodes, spark.createDataFrame(log, "node_id string, arrival long, to string, at timestamp")).collect()}
    for i, s in start.items():
        status, previous, closed, progress, moves, refused = plain_transitions(s, [(a, to, at) for n, a, to, at in log if n == i])
        assert found[i] == (status, previous, closed, progress, moves, refused), i


def test_backfill_gives_nodes_and_edges_back(spark):
    rnd = random.Random(6)
    day = lambda k: datetime(2026, 1, 1) + timedelta(days=k)
    rows = [(f"P-{k}", f"u{k}" if k % 3 else None, f"title {k} \"x\"", rnd.choice([None, "", "text\nmore"]), rnd.choice([None, "do"]), rnd.choice(STATUSES), rnd.choice([None, "agent-1"]), "Ann Lee", day(rnd.randrange(90)), day(100), day(1) if k % 10 == 0 else None) for k in range(1, 60)]
    nodes = spark.createDataFrame(rows, "id string, uid string, title string, description string, prompt string, status string, assignee string, creator string, created_at timestamp, updated_at timestamp, deleted_at timestamp")
    edges = spark.createDataFrame([("P-1", "P-2", "blocks"), ("P-3", "P-1", "related"), ("P-11", "P-4", "blocks")], "from_id string, to_id string, dep_type string")
    log = backfill.backfilled(nodes, edges, last=7)
    back = replay.replay(log)
    live = [r for r in rows if r[10] is None]
    assert got(back.fillna("", ["description", "prompt", "assignee"]), "id", "title", "description", "prompt", "status", "assignee") == sorted((r[0], r[2], r[3] or "", r[4] or "", r[5], r[6] or "") for r in live)
    assert got(replay.replay_edges(log), "from_id", "to_id", "dep_type") == sorted(map(tuple, edges.collect()))
    told = log.orderBy("lamport").collect()
    assert [r.lamport for r in told] == list(range(8, 8 + len(told)))
    creates = [r.node_id for r in told if r.op_type == "create_node"]
    assert creates == [r[0] for r in sorted(live, key=lambda r: (r[8], r[0]))]
    assert [r.op_type for r in told][-3:] == ["link_dep"] * 3 and {r.author for r in told} == {"ann-lee", "cli"}
    assert all(r.uid == (r.event_id if r.op_type == "create_node" and int(r.node_id[2:]) % 3 == 0 else f"u{r.node_id[2:]}" if int(r.node_id[2:]) % 3 else None) for r in told)
    assert backfill.backfilled(nodes.filter("false"), edges.filter("false")).count() == 0


def test_validation_rules(spark):
    """Each limit at its edge; brackets in strings don't nest; the first fault of a batch refuses it whole."""
    now = 1_700_000_000_000
    good = {"event_id": "e", "op_type": "comment", "node_id": "P-1", "author": "a-b", "machine": "0" * 16, "wall_ms": now, "lamport": 1, "payload": "{}", "clock": {"a": 1}}
    cases = {
        "": {"payload": json.dumps("x" * (64 * 1024 - 2))}, "payload_bytes": {"payload": json.dumps("x" * (64 * 1024 - 1))},
        " ": {"payload": "[" * 10 + "]" * 10}, "payload_depth": {"payload": "[" * 11 + "]" * 11},
        "  ": {"payload": json.dumps({"a": "[[[[[[[[[[[[{{\"\\"})}, "payload": {"payload": ""},
        "   ": {"lamport": 2**53 - 1}, "lamport_limit": {"lamport": 2**53}, "lamport": {"lamport": -1},
        "    ": {"clock": {f"a{k}": 1 for k in range(100)}}, "clock_entries": {"clock": {f"a{k}": 1 for k in range(101)}}, "clock_value": {"clock": {"a": 2**53}}, "clock": {"clock": None},
        "     ": {"wall_ms": now + 24 * 3_600_000}, "future": {"wall_ms": now + 24 * 3_600_000 + 1}, "wall_clock": {"wall_ms": -1},
        "op_type": {"op_type": "rename"}, "node_id,project_prefix": {"node_id": ""}, "project_prefix": {"node_id": "p-1"}, "author": {"author": "A B"}, "machine": {"machine": "xyz"}, "event_id": {"event_id": ""},
    }
    rows = [tuple((good | change).values()) + (k, k // 8) for k, change in enumerate(cases.values())]
    frame = spark.createDataFrame(rows, "event_id string, op_type string, node_id string, author string, machine string, wall_ms long, lamport long, payload string, clock map<string,bigint>, arrival int, batch int")
    numbered = frame.withColumn("event_id", F.when(F.col("event_id") == "", "").otherwise(F.concat(F.lit("e"), F.col("arrival"))))
    found = {r.event_id: r for r in events.violations(numbered, now).collect()}
    for k, name in enumerate(cases):
        key = "" if name == "event_id" else f"e{k}"
        assert (found[key].faults if key in found else "") == name.strip(), name
    verdicts = {r.batch: (r.accepted, r.fault) for r in events.batch_verdicts(numbered, now).collect()}
    assert verdicts[0] == (False, "payload_bytes") and verdicts[2][0] is False
    assert events.batch_verdicts(numbered.filter("arrival in (0, 2, 4)"), now).filter("accepted").count() == 1


def test_states_and_advice(spark):
    rows = [(True, "m", 0, 5, 0, 1), (False, "m", 9, 5, 0, 0), (True, "m", 3, 5, 0, 0), (True, "m", 2, 0, 1, 0), (True, "", 0, 5, 5, 0), (True, "m", 0, 0, 0, 0)]
    frame = spark.createDataFrame(rows, "hub boolean, machine string, errors int, local int, applied int, conflicts int")
    states = [r[0] for r in frame.select(more.sync_state(*map(F.col, frame.columns))).collect()]
    assert states == ["divergent-pending", "solo", "hub-unreachable", "sync-active", "sync-configured-no-hub", "sync-configured-no-hub"]
    told = spark.createDataFrame([("sync-configured-no-hub", 3, 0), ("sync-configured-no-hub", 3, 1), ("solo", 3, 0)], "s string, nodes int, local int")
    assert [r[0] for r in told.select(more.recommended(F.col("s"), F.col("nodes"), F.col("local"))).collect()] == [["init", "clone", "backfill"], ["init", "clone"], ["stay_solo", "init"]]


def test_prompts_hold_what_the_chain_says(spark):
    note = "annotations array<struct<author:string,text:string,resolved:boolean>>"
    rows = [("P-1", "Top", 0, "Plan.", "ann", [("bob", "mind this", False), ("bob", "old", True)]), ("P-1.1", "Mid", 1, "", "agent-2", []), ("P-1.1.1", "Leaf", 2, "Write.", "agent-2", None)]
    nodes = spark.createDataFrame(rows, f"id string, title string, depth int, prompt string, creator string, {note}").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    chain = hierarchy.with_ancestors(nodes.withColumn("parent_id", F.expr("case when depth > 0 then substring(id, 1, length(id) - 2) end")))
    held = spark.createDataFrame([("P-1.1.1", "P-9"), ("P-1.1.1", "P-8")], "to_id string, from_id string")
    found = {r.id: r.prompt for r in text.prompts(nodes, chain, held).collect()}
    rule = "\n\n---\n\n"
    top = "## EPIC P-1: Top\n\n[HUMAN-AUTHORED]\nPlan.\n\n[ANNOTATION by bob]\nmind this\n"
    assert found["P-1.1.1"] == rule.join([top, "## STORY P-1.1: Mid\n", "## ISSUE P-1.1.1: Leaf\n\n[LLM-GENERATED]\nWrite.\n", "## Blocking Dependencies\n- P-8 blocks this node\n- P-9 blocks this node\n"])
    assert found["P-1"] == top


def test_export_checksum_is_that_of_its_text(spark, tmp_path):
    """The digest of the whole text, written out by hand; the file read back, text after the object and a wrong count refused."""
    from thicket.sources import exchange

    day = datetime(2026, 1, 2, 3, 4, 5)
    rows = [("P-2", None, 0, 2, "P", "b <&>\u2028", ["x", "<"], "open", 0.5, 1.0, day, None, "u2"), ("P-1", None, 0, 1, "P", 'a "q"', [], "done", 1.0, 2.5, day, day, None), ("P-1.1", "P-1", 1, 1, "P", "é", None, "open", 0.0, 1.0, day, None, "")]
    nodes = spark.createDataFrame(rows, "id string, parent_id string, depth int, seq int, project string, title string, labels array<string>, status string, progress double, weight double, created_at timestamp, deleted_at timestamp, uid string").withColumn("priority", F.lit(3)).withColumn("updated_at", F.col("created_at"))
    edges = spark.createDataFrame([("P-2", "P-1", "blocks", day)], "from_id string, to_id string, dep_type string, created_at timestamp")

    def text_of(x):
        for plain, code in (("<", "003c"), (">", "003e"), ("&", "0026"), ("\u2028", "2028")):
            x = x.replace(plain, "\\u" + code)
        return x

    def number(x):
        return int(x) if x == int(x) else x

    def node(r):
        at = "2026-01-02T03:04:05Z"
        labels = text_of(json.dumps(r[6] or [], ensure_ascii=False, separators=(",", ":")))
        full = {"id": r[0], "parent_id": r[1] or "", "depth": r[2], "seq": r[3], "project": r[4], "title": r[5], "description": "", "prompt": "", "acceptance": "", "node_type": ["epic", "story"][r[2]], "issue_type": "", "priority": 3, "labels": labels, "status": r[7], "progress": number(r[8]), "assignee": "", "creator": "", "agent_state": "", "weight": number(r[9]), "content_hash": "", "created_at": at, "updated_at": at}
        return full | ({"deleted_at": at} if r[11] else {}) | ({"uid": r[12]} if r[12] else {})

    found = [node(r) for r in sorted(rows)]
    deps = [{"from_id": "P-2", "to_id": "P-1", "dep_type": "blocks", "created_at": "2026-01-02T03:04:05Z"}]
    dump = lambda x: text_of(json.dumps(x, ensure_ascii=False, separators=(",", ":")))
    sha = lambda x: __import__("hashlib").sha256(x.encode()).hexdigest()
    assert exchange.export_checksum(nodes, edges) == sha(dump({"nodes": found, "deps": deps}))
    assert exchange.export_checksum(nodes.filter("false"), edges.filter("false")) == sha('{"nodes":null,"deps":null}')
    whole = {"version": 1, "schema_version": "1", "project": "P", "nodes": found, "dependencies": deps, "node_count": 3, "checksum": exchange.export_checksum(nodes, edges)}
    file = tmp_path / "export.json"
    file.write_text(json.dumps(whole, indent=1))
    back, links, head = exchange.read_export(spark, str(file), "id string, title string, progress double", "from_id string, to_id string")
    assert got(back, "id", "title") == sorted((r[0], r[5]) for r in rows) and got(links, "from_id", "to_id") == [("P-2", "P-1")] and head["checksum"] == whole["checksum"]
    for wrong in (json.dumps(whole) + " {}", json.dumps(whole | {"node_count": 4}), json.dumps(whole)[:-1]):
        file.write_text(wrong)
        with pytest.raises(ValueError):
            exchange.read_export(spark, str(file), "id string", "from_id string")


def test_index_upkeep_is_a_new_index(spark):
    """Updates, deletions, a row both changed and deleted, new rows, empty texts: kept and rebuilt postings are the same, and the check says so."""
    schema = "doc_id long, title string, body string"
    base = [(i, f"title {i}", f"word{i % 5} and more {i}") for i in range(30)] + [(30, None, "")]
    old = spark.createDataFrame(base, schema)
    changed = spark.createDataFrame([(3, "new", "words here"), (4, "", None), (5, "late", "gone"), (99, "fresh", "row")], schema)
    gone = spark.createDataFrame([(5,), (6,), (12345,)], "doc_id long")
    columns = ["title", "body"]
    index, sizes = text.upkept(text.postings(old, columns), text.lengths(old, columns), changed, gone, columns)
    now = spark.createDataFrame([r for r in base if r[0] not in (3, 4, 5, 6)] + [(3, "new", "words here"), (4, "", None), (99, "fresh", "row")], schema)
    flat = lambda x: sorted(map(repr, x.select(*sorted(x.columns)).collect()))
    assert flat(index) == flat(text.postings(now, columns)) and flat(sizes) == flat(text.lengths(now, columns))
    assert text.index_faults(index, now, columns).count() == 0
    assert got(text.index_faults(text.postings(old, columns), now, columns), "id", "fault") == [(3, "stale"), (4, "surplus"), (5, "surplus"), (6, "surplus"), (99, "missing")]


def test_store_sees_changed_files(spark, tmp_path):
    """The same folder with other files gives the new answer."""
    import shutil

    folder = tmp_path / "sf"
    shutil.copytree("/root/testdata/sf0.001", folder)
    before = catalogue.queries()["roots"](spark, str(folder)).count()
    folder.chmod(0o755)
    nation = folder / "nation.parquet"
    rows = spark.read.parquet(str(nation)).filter("n_nationkey < 3").toPandas()
    nation.unlink()
    rows.to_parquet(nation)
    assert (before, catalogue.queries()["roots"](spark, str(folder)).count()) == (25, 3)
