"""Operators on small hand-made frames."""

import random

import pytest
from pyspark.sql import functions as F

from thicket.functions import clocks, ids
from thicket.operators import aggregates, events, graph, hierarchy, integrity, lifecycle, listing, text
from thicket.sources import exchange
from thicket.streaming import journal

NODE = "id string, parent_id string, project string, depth int, seq bigint, title string, priority int, status string, progress double, weight double, assignee string, deleted_at timestamp"


def nodes(spark, *rows):
    """Rows are (id, status, progress, weight)."""
    full = [(i, i.rpartition(".")[0] or None, i.split("-")[0], i.count("."), int(i.replace("-", ".").split(".")[-1]), f"title {i}", 3, s, p, w, None, None) for i, s, p, w in rows]
    return spark.createDataFrame(full, NODE)


def got(frame, *cols):
    return sorted(tuple(r) for r in frame.select(*cols).collect())


def test_rollup_example(spark):
    n = nodes(spark, ("P-42", "open", 0.0, 1.0), ("P-42.1", "done", 1.0, 1.0), ("P-42.2", "in_progress", 0.0, 1.0), ("P-42.3", "open", 0.0, 1.0), ("P-42.2.1", "done", 1.0, 1.0), ("P-42.2.2", "open", 0.0, 1.0))
    assert dict(got(hierarchy.rollup(n), "id", "progress")) == {"P-42": 0.5, "P-42.1": 1.0, "P-42.2": 0.5, "P-42.3": 0.0, "P-42.2.1": 1.0, "P-42.2.2": 0.0}


def test_rollup_leaves_out_cancelled(spark):
    n = nodes(spark, ("P-1", "open", 0.3, 1.0), ("P-1.1", "cancelled", 0.0, 1.0), ("P-1.2", "done", 1.0, 1.0), ("P-2", "open", 0.7, 1.0), ("P-2.1", "invalidated", 1.0, 1.0), ("P-3", "open", 0.0, 1.0), ("P-3.1", "deferred", 0.0, 1.0), ("P-3.2", "done", 1.0, 3.0))
    found = dict(got(hierarchy.rollup(n), "id", "progress"))
    assert (found["P-1"], found["P-2"], found["P-3"]) == (1.0, 0.0, 0.75)


def test_under_keeps_neighbours_apart(spark):
    n = nodes(spark, *((i, "open", 0.0, 1.0) for i in ("M-1", "M-1.1", "M-12", "M-3", "M-3.1", "M-2")))
    assert got(listing.list_nodes(n, under_any=["M-1", "M-3"]), "id") == [("M-1",), ("M-1.1",), ("M-3",), ("M-3.1",)]
    assert got(listing.list_nodes(n, types=["story"]), "id") == [("M-1.1",), ("M-3.1",)]


def test_natural_order(spark):
    n = spark.createDataFrame([("P-10",), ("P-2.1",), ("P-2",), ("A-9",), ("P-2.10",), ("P-2.9",), ("P-2.u0123456789ab",)], "id string")
    assert [r.id for r in listing.natural_order(n).collect()] == ["A-9", "P-2", "P-2.1", "P-2.9", "P-2.10", "P-2.u0123456789ab", "P-10"]


def test_blockers_and_cycles(spark):
    n = nodes(spark, ("P-1", "done", 1.0, 1.0), ("P-2", "open", 0.0, 1.0), ("P-3", "open", 0.0, 1.0), ("P-4", "blocked", 0.0, 1.0))
    e = spark.createDataFrame([("P-1", "P-3", "blocks"), ("P-2", "P-3", "blocks"), ("P-1", "P-4", "blocks")], "from_id string, to_id string, dep_type string")
    assert got(graph.blockers(n, e), "to_id", "from_id") == [("P-3", "P-2")]
    assert dict(got(graph.settle_blocks(n, e), "id", "new_status")) == {"P-1": "done", "P-2": "open", "P-3": "blocked", "P-4": "open"}
    assert graph.would_cycle(e, "P-3", "P-2") and not graph.would_cycle(e, "P-3", "P-4")
    ring = e.union(spark.createDataFrame([("P-3", "P-2", "blocks")], e.schema))
    assert got(graph.reachable(ring, "P-2"), "id") == [("P-3",)]
    with pytest.raises(ValueError):
        graph.add_edge(e, "P-3", "P-2")


def test_clocks(spark):
    pairs = [({"a": 1}, {"a": 1}), ({"a": 2}, {"a": 1}), ({"a": 1}, {"b": 1}), ({"a": 2, "b": 1}, {"a": 1, "b": 2}), ({}, {}), ({"a": 0}, {}), ({}, {"b": 3})]
    rows = spark.createDataFrame(pairs, "a map<string,bigint>, b map<string,bigint>")
    a, b = F.col("a"), F.col("b")
    found = [tuple(r) for r in rows.select(clocks.equal(a, b), clocks.dominates(a, b), clocks.concurrent(a, b)).collect()]
    assert found == [(True, False, False), (False, True, False), (False, False, True), (False, False, True), (True, False, False), (True, False, False), (False, False, False)]
    assert rows.select(clocks.merge(a, b).alias("m")).collect()[3].m == {"a": 2, "b": 2}
    assert rows.select(clocks.bump(a, F.lit("a")).alias("m")).collect()[1].m == {"a": 3}


def fold(log):
    """Last writer wins, one event after the other."""
    state = {}
    for e in log:
        k = (e["node_id"], e["field_name"])
        old = state.get(k)
        if old is None or (e["lamport"], e["wall_ms"]) > (old["lamport"], old["wall_ms"]) or ((e["lamport"], e["wall_ms"]) == (old["lamport"], old["wall_ms"]) and e["machine"] < old["machine"]):
            state[k] = e
    return {k: e["event_id"] for k, e in state.items()}


def test_last_writer_wins_as_a_fold_does(spark):
    rnd = random.Random(7)
    for _ in range(3):
        log = [{"event_id": i, "node_id": f"P-{rnd.randrange(4)}", "op_type": "update_field", "field_name": rnd.choice("ab"), "lamport": rnd.randrange(6), "wall_ms": rnd.randrange(3), "machine": rnd.choice("09af"), "value": 1.0} for i in range(80)]
        rnd.shuffle(log)
        for k, e in enumerate(log):
            e["arrival"] = k
        frame = spark.createDataFrame(log)
        assert {(r.node_id, r.field_name): r.event_id for r in events.lww_winners(frame).collect()} == fold(log)
        assert {(r.node_id, r.field_name): r.event_id for r in events.field_writes(frame).filter("rank = 1").collect()} == fold(log)


def test_duplicate_numbers(spark):
    c = spark.createDataFrame([("a1", "M-7", "u1"), ("a2", "M-7", "u2"), ("a3", "M-7", "u3"), ("e1", "M-8", "u9"), ("e2", "M-8", "u9")], "event_id string, node_id string, uid string")
    assert got(events.duplicate_losers(c), "event_id", "winner") == [("a2", "a1"), ("a3", "a1")]


def test_search(spark):
    T = text.Term
    d = spark.createDataFrame([(1, "Stripe authentication and login", "phrase"), (2, "login only", None), (3, "the exact phrase here", ""), (4, None, None), (5, "exact other phrase", "login"), (6, "exact", "phrase exact")], "doc_id int, text string, more string")
    index, sizes = text.postings(d, ["text", "more"]), text.lengths(d, ["text", "more"])
    hits = lambda *asked: [r[0] for r in got(text.search(index, sizes, list(asked)), "id")]
    assert hits([T("authentication"), T("LOGIN")]) == [1]
    assert hits([T("exact phrase")]) == [3]  # not over two columns
    assert hits([T("auth", prefix=True)]) == [1] and hits([T("auth", prefix=True, column="more")]) == []
    assert hits([T("login"), T("stripe", without=True)]) == [2, 5]
    assert hits([T("stripe")], [T("phrase")]) == [1, 3, 5, 6]
    assert hits([T("login", column="text")]) == [1, 2]
    assert hits([T("login"), T("exact other", without=True)]) == [1, 2] and hits([T("absent")]) == []
    for bad in ([], [[]], [[T("")]], [[T("* ( )")]], [[T("a", without=True)]], [[T("a b", prefix=True)]]):
        with pytest.raises(ValueError):
            text.search(index, sizes, bad)
    ranked = [r.id for r in text.best(text.search(index, sizes, [[T("login")]]), 2).collect()]
    assert ranked == [2, 5] and text.best(text.search(index, sizes, [[T("login")]]), 5, 2).first().id == 1


def test_text_functions(spark):
    row = spark.createDataFrame([("hi @opus-1 and x@y", "a\x00b\tc\x85", "postgres://u:secret@h/db")], "t string, c string, d string").select(ids.mention(F.col("t")).alias("m"), ids.sanitise(F.col("c")).alias("s"), ids.redact_dsn(F.col("d")).alias("r")).first()
    assert tuple(row) == ("opus-1", "a�b\tc�", "postgres://u:***@h/db")
    order = ["0.9.0", "1.2.3-alpha", "1.2.3-beta", "1.2.3-rc1+b5", "v1.2.3", "1.10.0"]
    v = spark.createDataFrame([(x,) for x in reversed(order)], "v string").orderBy(ids.semver(F.col("v"))).collect()
    assert [r.v for r in v] == order
    bad = spark.createDataFrame([(x,) for x in ("x", "dev", "", "1.2", "1.2.3-", "1.-2.3", "1.2.3.4")], "v string")
    assert bad.filter(ids.semver(F.col("v")).isNotNull()).count() == 0
    assert spark.range(1).select(ids.semver(F.lit("1.2.3+a")) == ids.semver(F.lit("v1.2.3+b"))).first()[0]


def test_truncation_keeps_the_end(spark):
    rows = [("a" * 40, "aaaa"), ("b" * 40, "bbbb"), ("c" * 40, "cccc"), ("d" * 8, "dddd")]
    s = spark.createDataFrame([(rows,)], "s array<struct<full:string,title:string>>")
    cut = lambda n: s.select(text.truncated(F.col("s"), n).alias("x")).first().x
    rule = "\n\n---\n\n"
    note = "\n\n[TRUNCATED: {} ancestor prompts omitted due to token budget]"
    assert cut(13) == rule.join(["aaaa", "c" * 40, "d" * 8]) + note.format(1)
    assert cut(1) == rule.join(["c" * 40, "d" * 8]) + note.format(2)
    assert cut(100) == rule.join(["a" * 40, "b" * 40, "c" * 40, "d" * 8])
    one = spark.createDataFrame([(rows[:1],)], "s array<struct<full:string,title:string>>")
    assert one.select(text.truncated(F.col("s"), 1).alias("x")).first().x == "a" * 40


def test_lifecycle(spark):
    n = nodes(spark, ("P-1", "open", 0.0, 1.0), ("P-2", "in_progress", 0.5, 1.0), ("P-3", "cancelled", 0.0, 1.0))
    assert dict(got(lifecycle.transition(n, F.lit("done"), "2026-01-01"), "id", "outcome")) == {"P-1": "invalid_transition", "P-2": "ok", "P-3": "invalid_transition"}
    assert sum(len(t) for t in lifecycle.TRANSITIONS.values()) == 27
    new = spark.createDataFrame([("P-1", "b"), ("P-1", "a"), ("P-3", "x"), ("P-9", "y")], "parent_id string, title string")
    assert got(lifecycle.numbered(new, n), "id", "title") == [("P-1.1", "a"), ("P-1.2", "b")]


def test_import_and_plan(spark, tmp_path):
    n = nodes(spark, ("P-1", "open", 0.0, 1.0), ("P-2", "done", 1.0, 1.0))
    exchange.export_json(n, f"{tmp_path}/x")
    back = exchange.import_json(spark, f"{tmp_path}/x", n.schema)
    assert exchange.checksum(back) == exchange.checksum(n)
    exchange.guard_import(back, 2, exchange.checksum(n))
    for wrong in ((3, None), (2, "no")):
        with pytest.raises(ValueError):
            exchange.guard_import(back, *wrong)
    (tmp_path / "plan").write_text('{"title": "a"}\n\n{"title": ""}\nnot json\n{"title": "' + "x" * 501 + '"}\n')
    rows, faults = exchange.read_plan(spark, f"{tmp_path}/plan")
    assert got(rows, "title") == [("a",)] and got(faults, "fault") == [("no title",), ("not JSON",), ("title too long",)]


def test_recovery(spark):
    a, b = spark.createDataFrame([("P-1",)], "id string"), spark.createDataFrame([("P-1",), ("P-2.1",)], "id string")
    assert got(integrity.recovered(a, b), "id", "origin") == [("P-1", "primary"), ("P-2", "placeholder"), ("P-2.1", "mirror")]


def test_inbox(spark):
    c = spark.createDataFrame([("opus", 1), ("opus", 2), ("opus", 3)], "agent string, seq bigint")
    none = c.filter("false")
    assert got(journal.inbox(c, none, none.selectExpr("agent", "seq as cursor"), c.filter("seq = 3")), "seq") == [(1,), (2,)]


def test_acknowledging(spark):
    cursors = spark.createDataFrame([("a", 2), ("b", 0)], "agent string, cursor bigint")
    acked = spark.createDataFrame([("a", 3), ("a", 5), ("a", 9), ("c", 1), ("c", 2)], "agent string, seq bigint")
    moved, left = journal.acked_through(acked, cursors, spark.createDataFrame([("a", 5), ("b", -4), ("d", 7)], "agent string, seq bigint"))
    assert got(moved, "agent", "cursor") == [("a", 5), ("b", 0), ("d", 7)]
    assert got(left, "agent", "seq") == [("a", 9), ("c", 1), ("c", 2)]
    told = spark.createDataFrame([("a", 1), ("a", 3), ("a", 4), ("a", 5), ("c", 1), ("c", 2), ("c", 9), ("b", 3)], "agent string, seq bigint")
    assert got(journal.closed_gaps(told, acked, cursors), "agent", "cursor") == [("a", 3), ("b", 0), ("c", 2)]


def test_status_counts_have_all_seven(spark):
    found = dict(got(aggregates.status_counts(nodes(spark, ("P-1", "open", 0.0, 1.0))), "status", "n"))
    assert found == {**{s: 0 for s in ids.STATUSES}, "open": 1}


def test_smaller_operators(spark):
    from thicket.operators import more

    d = spark.createDataFrame([('{"a": [1, {"b": "]]}"}]}',), ("1",), ('"[[["',), ("[[],[[]]]",)], "j string")
    assert [r[0] for r in d.select(events.json_depth(F.col("j"))).collect()] == [3, 0, 0, 3]
    n = nodes(spark, ("P-1", "open", 0.0, 1.0), ("P-1.1", "done", 1.0, 1.0), ("P-1.2", "invalidated", 0.0, 1.0))
    marked = n.withColumn("invalidated_at", F.when(F.col("id") == "P-1.1", F.lit("2026-01-01").cast("timestamp")))  # a done node, restored since
    assert got(more.node_progress(marked), "id", "children", "invalidated") == [("P-1", 2, 1), ("P-1.1", 0, 0), ("P-1.2", 0, 0)]
    assert got(more.node_progress(n.withColumn("invalidated_at", F.lit(None).cast("timestamp"))), "id", "invalidated")[0] == ("P-1", 0)
    assert [r.line for r in more.printed_tree(n).collect()][1].startswith("  P-1.1 [done]")
    c = spark.createDataFrame([("e1", "M-1", 1, "a", 0), ("e2", "M-1", 2, "b", 0), ("e3", "M-1", 3, "b", 1), ("e4", "M-1", 4, "a", 1)], "event_id string, node_id string, arrival int, uid string, epoch int")
    assert [o for _, o in got(more.registry_with_epochs(c), "event_id", "outcome")] == ["free", "renumber", "collision", "noop"]
    u = spark.createDataFrame([("P-1.1", "x"), ("P-1.9", "y"), ("P-1.2", None)], "id string, title string")
    assert dict(got(more.bulk_outcomes(u, n), "id", "outcome")) == {"P-1.1": "updated", "P-1.9": "not_found", "P-1.2": "nothing_given"}
    asked = spark.createDataFrame([("A B", "2026-01-02", "P-1", "claim"), ("a-b", "2026-01-01", "P-2", "claim"), ("Ünder", "2026-01-01", "P-1", "claim")], "author string, at string, node_id string, op_type string").withColumn("at", F.col("at").cast("timestamp"))
    e = more.emitted(asked, 10)
    assert got(e, "author", "node_id", "lamport", "author_clock") == [("a-b", "P-1", 13, 2), ("a-b", "P-2", 12, 1), ("cli", "P-1", 11, 1)]
    with pytest.raises(ValueError):
        more.emitted(asked, 10, pending=5, most=5)


def test_engine(spark):
    from thicket.engine import Engine

    n = nodes(spark, ("P-1", "open", 0.0, 1.0), ("P-1.1", "done", 1.0, 1.0), ("P-1.2", "open", 0.0, 1.0)).withColumns({"labels": F.array(F.lit("x")), "created_at": F.lit("2026-01-01").cast("timestamp"), "updated_at": F.lit("2026-01-01").cast("timestamp"), "defer_until": F.lit(None).cast("timestamp")})
    e = spark.createDataFrame([("P-1.1", "P-1.2", "blocks")], "from_id string, to_id string, dep_type string")
    own = Engine(n, e, n)
    assert got(own.ancestors("P-1.1"), "id") == [("P-1",), ("P-1.1",)]
    assert got(own.siblings("P-1.1"), "id") == [("P-1.2",)]
    assert own.list(limit=0).count() == 0 and tuple(own.total(limit=2).first()) == (3, 2, True)
    assert [c["id"] for c in own.nested("P-1")["children"]] == ["P-1.1", "P-1.2"]
    assert got(own.search([text.Term("title")]), "id") == [("P-1",), ("P-1.1",), ("P-1.2",)]
    assert own.context("P-1.2").first().prompt == "P-1 title P-1\nP-1.2 title P-1.2"
    assert own.list(fields=["id"], labels=["x"], status=["done"]).collect()[0].id == "P-1.1"
    assert own.blockers("P-1.2").count() == 0 and own.dependents("P-1.1").count() == 1
    with pytest.raises(LookupError):
        own.get("P-9")
