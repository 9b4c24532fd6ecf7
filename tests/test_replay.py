"""The set-based replay against a fold of one event after the other, and rules that near misses would break."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from thicket.operators import graph, hierarchy, integrity, lifecycle, listing, replay

EVENT = "event_id bigint, node_id string, uid string, op_type string, payload string, lamport bigint, wall_ms bigint, machine string, author string, arrival bigint"
TERMINAL = ("done", "cancelled", "invalidated")


def got(frame, *cols):
    return sorted(tuple(r) for r in frame.select(*cols).collect())


def make_log(seed, n=400):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        k = rnd.randrange(12)
        op = rnd.choice(["create_node", "update_field", "update_field", "update_field", "claim", "unclaim", "defer", "transition_status", "comment", "link_dep", "unlink_dep", "set_prompt", "set_acceptance"] + ["delete"] * (rnd.random() < 0.3))
        p = {
            "create_node": {"title": f"t{i}", "assignee": rnd.choice([None, "zed"])},
            "update_field": {"field_name": rnd.choice(replay.FIELDS[:6]), "new_value": rnd.choice(["1", "2", "done"])},
            "claim": {"agent_id": f"a{i % 3}"},
            "defer": {"until": rnd.choice([None, f"2030-01-0{1 + i % 9}"])},
            "transition_status": {"to": rnd.choice(["open", "done", "cancelled", "in_progress"])},
            "comment": {"author_id": "c", "body": f"b{i}"},
            "link_dep": {"depends_on_node_id": f"P-{rnd.randrange(4)}", "dep_type": rnd.choice(["blocks", "related"])},
            "unlink_dep": {"depends_on_node_id": f"P-{rnd.randrange(4)}", "dep_type": rnd.choice(["", "related"])},
            "set_prompt": {"prompt_text": f"p{i}"},
            "set_acceptance": {"acceptance_text": f"q{i}"},
        }.get(op, {})
        uid = None if k % 4 == 0 or rnd.random() < 0.2 else f"u{k}"
        path = f"P-{k}" if op == "create_node" or rnd.random() < 0.8 or uid is None else f"OLD-{k}"
        rows.append((i, path, uid, op, json.dumps(p), rnd.randrange(6), rnd.randrange(3), rnd.choice("ab"), f"w{i % 2}", i))
    return rows


def fold(rows):
    """Events in order of arrival, each applied to what the ones before left."""
    nodes, edges, best = {}, set(), {}

    def find(e):
        hits = [n for n in nodes.values() if n["deleted"] is None and (n["uid"] == e["uid"] if e["uid"] else n["id"] == e["node_id"])]
        return hits[0] if hits else None

    for r in rows:
        e = dict(zip([c.split()[0] for c in EVENT.split(", ")], r, strict=True))
        p, op = json.loads(e["payload"]), e["op_type"]
        if op == "create_node":
            if e["node_id"] not in nodes:
                nodes[e["node_id"]] = {"id": e["node_id"], "uid": e["uid"] or str(e["event_id"]), "title": p["title"], "assignee": p["assignee"], "status": "open", "deleted": None, "comments": 0, "priority": "3", "description": None, "prompt": None, "acceptance": None, "until": None, "closed": None}
            continue
        n = find(e)
        if op in ("link_dep", "unlink_dep"):
            edge = (n["id"] if n else e["node_id"], p["depends_on_node_id"], p["dep_type"] or "blocks")
            (edges.add if op == "link_dep" else edges.discard)(edge)
            continue
        if not n:
            continue
        if p.get("field_name") == "priority" and not p["new_value"].isdigit():
            continue
        if op in ("update_field", "set_prompt", "set_acceptance"):
            key = (n["id"], op, p.get("field_name", op))
            rank = (e["lamport"], e["wall_ms"], -ord(e["machine"]))
            if key not in best or rank > best[key]:
                best[key] = rank
                n[p.get("field_name", op.removeprefix("set_"))] = p.get("new_value", p.get("prompt_text", p.get("acceptance_text")))
        elif op == "claim":
            n.update(status="in_progress", assignee=p["agent_id"])
        elif op == "unclaim":
            n.update(status="open", assignee=None)
        elif op == "defer":
            n.update(status="deferred", until=p["until"])
        elif op == "transition_status":
            n.update(status=p["to"], closed=e["wall_ms"] if p["to"] in TERMINAL else None)
        elif op == "comment":
            n["comments"] += 1
        elif op == "delete":
            n["deleted"] = e["wall_ms"]
    return nodes, edges


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_is_the_fold(spark, seed):
    rows = [r for r in make_log(seed) if not (r[3] == "create_node" and r[2] is None and r[0] % 2)]
    # one path for each uid, as the registry sees to
    nodes, edges = fold(rows)
    shuffled = rows + rows[:20]
    random.Random(seed).shuffle(shuffled)
    log = spark.createDataFrame(shuffled, EVENT)
    found = {r.id: r for r in replay.replay(log).collect()}
    assert set(found) == set(nodes)
    for i, n in nodes.items():
        r = found[i]
        assert (r.priority, r.uid, r.title, r.status, r.assignee, r.description, r.prompt, r.acceptance, r.comments) == (int(n["priority"]), n["uid"], n["title"], n["status"], n["assignee"], n["description"], n["prompt"], n["acceptance"], n["comments"]), i
        assert (r.defer_until, r.closed_ms, r.deleted_ms) == (n["until"], n["closed"], n["deleted"]), i
    assert set(got(replay.replay_edges(log), "from_id", "to_id", "dep_type")) == edges
    assert replay.annotations(log).count() == sum(n["comments"] for n in nodes.values())


def test_replay_of_nothing(spark):
    none = spark.createDataFrame([], EVENT)
    assert replay.replay(none).count() == replay.replay_edges(none).count() == replay.orphans(none).count() == 0


def test_orphans(spark):
    rows = [(1, "P-1", "u1", "create_node", "{}", 1, 1, "a", "w", 1), (2, "OLD", "u1", "claim", "{}", 1, 1, "a", "w", 2), (3, "P-9", None, "claim", "{}", 1, 1, "a", "w", 3), (4, "P-1", "u9", "claim", "{}", 1, 1, "a", "w", 4), (5, "P-8", None, "delete", "{}", 1, 1, "a", "w", 5)]
    log = spark.createDataFrame(rows, EVENT)
    assert got(replay.orphans(log), "event_id") == [(3,), (4,)]
    waiting = spark.createDataFrame([(0,), (7_000_000,)], "wall_ms bigint")
    assert got(integrity.doctor(log, waiting, 7_000_000), "check", "faults", "ok") == [("orphans", 2, False), ("queue", 1, False)]


NODE = "id string, parent_id string, depth int, seq bigint, title string, status string, progress double, weight double, assignee string, previous_status string, closed_at timestamp, deleted_at timestamp"


def nodes(spark, *rows):
    """Rows are (id, status, previous status, closed, deleted)."""
    when = datetime(2026, 1, 1)
    full = [(i, i.rpartition(".")[0] or None, i.count("."), int(i.replace("-", ".").split(".")[-1]), f"title {i}", s, 0.0, 1.0, "x" if s == "in_progress" else None, p, when if c else None, when if d else None) for i, s, p, c, d in rows]
    return spark.createDataFrame(full, NODE)


def test_blocking_keeps_the_status_before(spark):
    n = nodes(spark, ("P-1", "open", None, 0, 0), ("P-2", "in_progress", None, 0, 0), ("P-3", "blocked", "in_progress", 0, 0), ("P-4", "blocked", "", 0, 0))
    e = spark.createDataFrame([("P-1", "P-2", "blocks")], "from_id string, to_id string, dep_type string")
    assert got(graph.settle_blocks(n, e), "id", "new_status", "previous_status") == [("P-1", "open", None), ("P-2", "blocked", "in_progress"), ("P-3", "in_progress", None), ("P-4", "open", None)]
    with pytest.raises(LookupError):
        graph.remove_edge(e, "P-2", "P-1")
    assert graph.remove_edge(e, "P-1", "P-2").count() == 0


def test_reachable_counts_steps(spark):
    e = spark.createDataFrame([(f"P-{i}", f"P-{i + 1}", "blocks") for i in range(7)] + [("P-0", "P-3", "blocks"), ("P-7", "P-0", "blocks"), ("P-2", "P-99", "related")], "from_id string, to_id string, dep_type string")
    assert got(graph.reachable(e, "P-0"), "id", "steps") == [("P-1", 1), ("P-2", 2), ("P-3", 1), ("P-4", 2), ("P-5", 3), ("P-6", 4), ("P-7", 5)]
    assert graph.reachable(e, "P-99").count() == 0


def test_refused_transitions_change_nothing(spark):
    n = nodes(spark, ("P-1", "done", None, 1, 0), ("P-2", "open", None, 1, 0), ("P-3", "in_progress", None, 0, 0))
    found = {r.id: (r.outcome, r.status, r.closed_at and r.closed_at.year) for r in lifecycle.transition(n, F.lit("done"), "2031-01-01").collect()}
    assert found == {"P-1": ("ok", "done", 2026), "P-2": ("invalid_transition", "open", 2026), "P-3": ("ok", "done", 2031)}
    assert got(lifecycle.unclaim(n, "why"), "id", "outcome", "status", "assignee")[2] == ("P-3", "ok", "open", None)
    with pytest.raises(ValueError):
        lifecycle.unclaim(n, " ")
    assert got(lifecycle.progress_set(n, spark.createDataFrame([("P-2", 0.5)], "id string, value double")), "id", "progress")[1] == ("P-2", 0.5)
    with pytest.raises(ValueError):
        lifecycle.progress_set(n, spark.createDataFrame([("P-2", 1.5)], "id string, value double"))


def test_broken_chains_are_errors(spark):
    n = nodes(spark, ("P-1", "open", None, 0, 0), ("P-1.1", "open", None, 0, 1), ("P-1.1.1", "open", None, 0, 0), ("P-1.2", "open", None, 0, 0), ("P-2.1", "open", None, 0, 0))
    assert got(hierarchy.broken_chains(n), "id", "missing") == [("P-1.1.1", "P-1.1"), ("P-2.1", "P-2")]
    assert got(hierarchy.with_ancestors(n), "id", "ancestor_id") == [("P-1", "P-1"), ("P-1.2", "P-1"), ("P-1.2", "P-1.2")]
    assert [r.id for r in hierarchy.chain(n, "P-1.2").collect()] == ["P-1", "P-1.2"]
    with pytest.raises(LookupError, match="P-1.1"):
        hierarchy.chain(n, "P-1.1.1")
    assert got(hierarchy.siblings(n), "id") == []
    assert hierarchy.nested(n, "P-1", 0) == {"id": "P-1", "title": "title P-1", "status": "open", "progress": 0.0, "depth": 0}
    with pytest.raises(LookupError):
        hierarchy.nested(n, "P-1.1")


def test_rebase_takes_the_longest_prefix(spark):
    paths = spark.createDataFrame([("A-1",), ("A-1.2",), ("A-1.2.3",), ("A-12",), ("A-1.20",), (None,)], "id string")
    moves = spark.createDataFrame([("A-1", "B-5"), ("A-1.2", "C-7.1")], "old string, new string")
    assert {r.id: r.new_id for r in hierarchy.rebased(paths, moves).collect()} == {"A-1": "B-5", "A-1.2": "C-7.1", "A-1.2.3": "C-7.1.3", "A-12": "A-12", "A-1.20": "B-5.20", None: None}


def test_changed_since():
    now = datetime(2026, 3, 10, 12)
    assert listing.changed_since("", now) is None
    assert listing.changed_since("1h30m", now) == datetime(2026, 3, 10, 10, 30)
    assert listing.changed_since("2026-04-06T10:00:00Z", now) == datetime(2026, 4, 6, 10)
    assert listing.changed_since("2026-04-06T10:00:00+02:00", now) == datetime(2026, 4, 6, 8)
    assert listing.changed_since("2026-04-06", now) == datetime(2026, 4, 6)
    for bad in ("-1h", "0s", "soon", "1 h", "5"):
        with pytest.raises(ValueError):
            listing.changed_since(bad, now)
    assert listing.project_scope("", True, "P") == "" and listing.project_scope("", False, "P") == "P" and listing.project_scope("Q", False, "P") == "Q"
    with pytest.raises(ValueError):
        listing.project_scope("Q", True)


def test_imports(spark):
    base = spark.createDataFrame([("P-1", "a", "u1", "h1"), ("P-2", "b", "u2", "h2")], "id string, title string, uid string, content_hash string")
    new = spark.createDataFrame([("P-1", "z", "", "h1"), ("P-2", "c", None, "h3"), ("P-3", "d", "u3", "h4")], base.schema)
    assert got(integrity.merged(base, new), "id", "title", "uid") == [("P-1", "a", "u1"), ("P-2", "c", "u2"), ("P-3", "d", "u3")]
    after = integrity.replaced({"nodes": base, "sessions": base}, {"nodes": new.drop("uid")})
    assert after["nodes"].columns == base.columns and after["nodes"].count() == 3 and after["sessions"].count() == 0


def test_hook_configuration():
    from thicket.streaming import hooks

    ok = {"name": "a", "match": {"events": ["node.created"]}, "deliver": ["inbox"]}
    bad = [dict(ok), {}, {**ok, "name": "b", "match": {}}, {**ok, "name": "c", "deliver": []}, {**ok, "name": "d", "match": {"events": ["nope"]}}, {**ok, "name": "e", "deliver": ["pigeon"]}, {**ok, "name": "f", "deliver": ["exec"]}, {**ok, "name": "g", "deliver": ["webhook"], "webhook": {"url": ""}}]
    good, warnings = hooks.checked([ok, *bad, {**ok, "name": "h", "deliver": ["exec"], "exec": {"command": ["x"]}}])
    assert [g["name"] for g in good] == ["a", "h"] and len(warnings) == len(bad)


def test_hook_ledger(spark):
    from thicket.streaming import hooks

    ledger = spark.createDataFrame([("a", 5, datetime(2026, 1, 1), "claimed"), ("a", 6, datetime(2026, 1, 1, 0, 0, 59), "claimed"), ("a", 3, datetime(2026, 1, 1), "delivered")], hooks.LEDGER)
    asked = spark.createDataFrame([("a", n) for n in (2, 3, 5, 6, 7, 7)], "hook string, seq long")
    now = "2026-01-01 00:01:01"
    assert got(hooks.claimed(asked, ledger, 2, now), "hook", "seq") == [("a", 5), ("a", 7)]
    assert got(hooks.stale(ledger, now), "seq") == [(5,)]
    assert hooks.floor_after(ledger, 1, 9).first().floor == 4 and hooks.floor_after(ledger, 8, 9).first().floor == 8
    after = hooks.recorded(ledger, spark.createDataFrame([("a", 5, "delivered"), ("a", 6, "failed")], "hook string, seq long, outcome string"), now)
    assert hooks.floor_after(after, 1, 9).first().floor == 9 and got(hooks.pruned(after, 5), "seq") == [(6,)]


def test_provisional_ids_stay_inside(spark):
    from thicket.operators import collisions

    collisions.refuse_provisional(spark.createDataFrame([("P-1.2",), (None,)], "id string"))
    with pytest.raises(ValueError, match="P-1.u0123456789ab"):
        collisions.refuse_provisional(spark.createDataFrame([("P-1.2",), ("P-1.u0123456789ab",)], "id string"))
    rows = spark.createDataFrame([(2, "open", "P", "2026-01-02"), (1, "open", "P", "2026-01-01"), (3, "resolved", "P", "2026-01-01"), (4, "open", "Q", "2026-01-01")], "collision_id int, status string, project string, detected_at string")
    assert [r.collision_id for r in collisions.open_collisions(rows, "P").collect()] == [1, 2]
    assert collisions.restored_epoch(spark.createDataFrame([(4,)], "restore_epoch long")).first()[0] == 5
