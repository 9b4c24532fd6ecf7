"""Steps whose cost must not outgrow their input."""

import random

import pytest
from pyspark.sql import functions as F

from thicket.operators import backfill, hierarchy, integrity, replay
from thicket.plans import catalogue, history
from thicket.sources import store
from thicket.sources.views import view
from thicket.streaming import hooks

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rollup_broadcasts_nothing(spark):
    """Small tables would be broadcast; deep ids that compress well are taken for small."""
    rows = [("A", None, "open", 1.0, 0.0), ("A.1", "A", "open", 1.0, 0.0), ("A.2", "A", "done", 1.0, 1.0), ("A.1.1", "A.1", "open", 1.0, 0.5)]
    nodes = spark.createDataFrame(rows, "id string, parent_id string, status string, weight double, progress double").withColumn("deleted_at", F.lit(None).cast("timestamp"))
    found = hierarchy.rollup(nodes)
    assert {r.id: r.progress for r in found.collect()} == {"A": 0.75, "A.1": 0.5, "A.2": 1.0, "A.1.1": 0.5}
    assert "Broadcast" not in plan(found)


def forest(seed):
    """Trees with gone nodes, ids whose numbers sort otherwise as text, and dashes where dots would stand."""
    rnd, paths = random.Random(seed), ["P-1", "P-10", "P-1-2", "Q-7"]
    while len(paths) < 300:
        up = rnd.choice(paths[-40:] if rnd.random() < 0.7 else paths)
        paths += [p for p in [f"{up}.{rnd.choice([1, 2, 10, 11, 100])}"] if p not in paths]
    return [(p, p.rpartition(".")[0] or None, rnd.choice(["open", "done", "deferred", "cancelled", "invalidated"]), rnd.choice([0.0, 1.0, 2.0, 3.5, None]), rnd.choice([0.0, 0.25, 1.0]), "x" if rnd.random() < 0.05 else None) for p in paths]


def means(rows):
    kids = {}
    for r in rows:
        kids.setdefault(r[1], []).append(r)

    def value(r):
        below = [(value(k), k[3]) for k in kids.get(r[0], []) if k[2] not in ("cancelled", "invalidated") and k[3] is not None]
        total = sum(w for _, w in below)
        return r[4] if r[0] not in kids else sum(v * w for v, w in below) / total if total else 0.0

    return {r[0]: value(r) for r in rows}


@pytest.mark.parametrize("parts", [1, 7, 60])
@pytest.mark.parametrize("written", [True, False])
def test_rollup_folds_ranges(spark, monkeypatch, parts, written):
    """Each row is shuffled once, whatever its depth, and trees that many ranges share come out as in one."""
    if not written:
        monkeypatch.setattr(hierarchy, "kept", lambda df: df)
    rows = forest(parts)
    nodes = spark.createDataFrame(rows, "id string, parent_id string, status string, weight double, progress double, gone string").withColumn("deleted_at", F.when(F.col("gone").isNotNull(), F.lit("2000-01-01").cast("timestamp")))
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = hierarchy.rollup(nodes)
        assert {r.id: r.progress for r in found.collect()} == pytest.approx(means([r for r in rows if r[5] is None]))
        text = plan(found)
        assert "Generate" not in text and "Join" not in text and "ancestor" not in text
        assert written or parts == 1 or "rangepartitioning(path" in text
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_hook_names_are_told_of_all_events(spark):
    """Kinds that hooks don't know, and comments to nobody, keep their row, with no name."""
    rows = [(1, "create_node", "{}"), (2, "claim", "{}"), (3, "comment", '{"to":"ann"}'), (4, "comment", "{}"), (5, "transition_status", '{"to":"done"}'), (6, "delete", None)]
    log = spark.createDataFrame(rows, "event_id long, op_type string, payload string")
    assert {r.event_id: r.name for r in hooks.named(log).collect()} == {1: "node.created", 2: None, 3: "comment.addressed", 4: None, 5: "status.changed", 6: None}
    assert {r.event_id for r in hooks.normalised(log).collect()} == {1, 3, 5}
    assert catalogue.queries()["hook_event_names"](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_clocks_pair_no_epochs(spark):
    """Each epoch's clocks come by running sums: rows by node, epoch and author, not by pairs of epochs."""
    n = 4_000
    log = spark.range(n).select(F.col("id").alias("event_id"), F.col("id").alias("arrival"), F.concat(F.lit("u"), F.col("id") % 2).alias("author"), F.lit("set_prompt").alias("op"))
    found = history._clocked(log.withColumn("arrival", F.col("arrival") * 400))  # an epoch for each event
    text = plan(found)
    got = {r.event_id: r.clock for r in found.collect()}
    assert "<" not in "".join(line for line in text.splitlines() if "Join" in line)
    for e in (0, 7, 3_999):
        node = [x for x in range(e + 1) if x % 2 == e % 2]
        want = {}
        for x in node:
            want[f"w{x % 5}"] = want.get(f"w{x % 5}", 0) + 1
        assert got[e] == want


def test_a_stored_file_is_of_few_rows(spark, monkeypatch):
    """A task sorts a file's rows: 13 MB of input may not go into one; the session's own setting comes back."""
    monkeypatch.setattr(store, "files", lambda *_: (("f", 13 << 20, 0),))
    advised = spark.conf.get(store._ADVISED)
    found = store.stored(spark, "few_rows", lambda: spark.range(1000).withColumnRenamed("id", "k"), "k", "f")
    assert found.rdd.getNumPartitions() >= 1 and len(found.inputFiles()) == 2
    assert [r.k for r in found.orderBy("k").collect()] == list(range(1000))
    assert spark.conf.get(store._ADVISED) == advised


def joins(df):
    return [line for line in plan(df).splitlines() if "Join" in line]


def test_differences_join_nothing(spark):
    left, right = (spark.createDataFrame([(x,) for x in xs], "id string") for xs in (["a", "a", "b", None], ["b", "c", None]))
    found = integrity.set_diff(left, right)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, [("a", "left"), ("c", "right"), (None, "left"), (None, "right")]))
    assert not joins(found)


def test_recovery_joins_nothing(spark):
    primary, mirror = (spark.createDataFrame([(x,) for x in xs], "id string") for xs in (["P-1", "P-1.2.3"], ["P-1", "P-1.2.3", "P-1.4", "P-2.1.1"]))
    found = integrity.recovered(primary, mirror)
    assert sorted(map(tuple, found.collect())) == [("P-1", "primary"), ("P-1.2", "placeholder"), ("P-1.2.3", "primary"), ("P-1.4", "mirror"), ("P-2", "placeholder"), ("P-2.1", "placeholder"), ("P-2.1.1", "mirror")]
    assert not joins(found)


def test_missing_parents_join_nothing(spark, monkeypatch):
    """Also with more missing parents than go to every task."""
    rows = [("P-1", None, None), ("P-1.1", "P-1", "x"), ("P-1.2", "P-1", None), ("P-1.1.1", "P-1.1", None), ("P-1.1.1.1", "P-1.1.1", None), ("P-1.1.1.2", "P-1.1.1", None), ("P-2.1", "P-2", None)]
    nodes = spark.createDataFrame(rows, "id string, parent_id string, gone string").withColumn("deleted_at", F.when(F.col("gone").isNotNull(), F.lit("2000-01-01").cast("timestamp")))
    lost = hierarchy.missing_parents(nodes)
    assert sorted(r.id for r in lost.collect()) == ["P-1.1", "P-2"]
    assert not joins(lost)
    for few in (hierarchy.FEW, 1):
        monkeypatch.setattr(hierarchy, "FEW", few)
        assert sorted(map(tuple, hierarchy.broken_chains(nodes).collect())) == [("P-1.1.1", "P-1.1"), ("P-1.1.1.1", "P-1.1"), ("P-1.1.1.2", "P-1.1"), ("P-2.1", "P-2")]
        assert sorted(map(tuple, hierarchy.with_ancestors(nodes).collect())) == [("P-1", "P-1", 0), ("P-1.2", "P-1", 0), ("P-1.2", "P-1.2", 1)]


def test_a_log_is_made_once(spark):
    """Replay reads the log for creates, by uid, by path and for deletions; what makes it runs once."""
    made = spark.sparkContext.accumulator(0)

    def rows(part):
        for r in part:
            made.add(1)
            yield r

    told = [(f"e{k}", "P-1", None if k else "u", "update_field" if k else "create_node", '{"title":"a","field_name":"title","new_value":"b"}', k, k, "0" * 16, "ann", k) for k in range(4)]
    schema = "event_id string, node_id string, uid string, op_type string, payload string, lamport long, wall_ms long, machine string, author string, arrival long"
    log = spark.createDataFrame(spark.sparkContext.parallelize(told, 1).mapPartitions(rows), schema)
    assert [(r.id, r.title) for r in replay.replay(log).collect()] == [("P-1", "b")]
    assert made.value == len(told)


LOG = "event_id string, node_id string, uid string, op_type string, payload string, lamport long, wall_ms long, machine string, author string, arrival long, slice int"
TIDY = [
    ("b1", "P-1", "b1", "create_node", '{"title":"a"}', 1, 1, "0" * 16, "ann", 1, 1),
    ("b2", "P-1", None, "update_field", '{"field_name":"title","new_value":"b"}', 2, 2, "0" * 16, "ann", 2, 1),
    ("b3", "P-2", "u2", "create_node", '{"title":"c"}', 3, 3, "0" * 16, "ann", 3, 2),
    ("b4", "P-2", "u2", "transition_status", '{"to":"done"}', 4, 4, "0" * 16, "ann", 4, 2),
    ("b5", "P-3", "b5", "create_node", '{"title":"d"}', 5, 5, "0" * 16, "ann", 5, 2),
    ("b6", "P-9", None, "claim", '{"agent_id":"x"}', 6, 6, "0" * 16, "ann", 6, 2),
    ("b7", "P-2", "u2", "link_dep", '{"depends_on_node_id":"P-1","dep_type":"blocks"}', 7, 7, "0" * 16, "ann", 7, None),
]
UNTIDY = {
    "early": ("c1", "P-3", None, "claim", '{"agent_id":"x"}', 1, 1, "0" * 16, "ann", 4, 2),
    "other": ("c2", "P-3", "u2", "claim", '{"agent_id":"x"}', 8, 8, "0" * 16, "ann", 8, 2),
    "moved": ("c3", "OLD", "u2", "claim", '{"agent_id":"x"}', 8, 8, "0" * 16, "ann", 8, 2),
    "gone": ("c4", "P-2", "u2", "delete", "{}", 8, 8, "0" * 16, "ann", 8, 2),
    "shared": ("c5", "P-4", "u2", "create_node", '{"title":"e"}', 1, 1, "0" * 16, "ann", 0, 3),
    "apart": ("c6", "P-1", None, "update_field", '{"field_name":"title","new_value":"e"}', 8, 8, "0" * 16, "ann", 8, 3),
}


@pytest.mark.parametrize("more", [None, *UNTIDY])
@pytest.mark.parametrize("sliced", [True, False])
def test_a_backfilled_log_may_be_of_any_kind(spark, monkeypatch, more, sliced):
    """By paths where that gives the same; else as any log."""
    log = spark.createDataFrame(TIDY + ([UNTIDY[more]] if more else []), LOG)
    log = log if sliced else log.drop("slice")
    want = sorted(map(tuple, replay.replay(log.drop("slice")).collect()))
    asked = []
    monkeypatch.setattr(replay, "created", lambda rows, made=replay.created: asked.append(1) or made(rows))
    assert sorted(map(tuple, replay.replay(log, backfilled=True).collect())) == want
    assert bool(asked) == (more is not None and (sliced or more != "apart"))


def test_a_backfilled_log_is_dealt_once(spark):
    """Nodes are numbered, not their events, and what numbers them deals the log for its replay."""
    nodes, edges = (view(spark, SF, v) for v in ("nodes", "edges"))
    log = backfill.backfilled(history._with_text(nodes), edges)
    text = plan(replay._by_path(replay.parsed(log)))
    assert text.count("Exchange hashpartitioning(slice") == text.count("Exchange hashpartitioning") == 2
    assert "step" not in "".join(line for line in text.splitlines() if "Window" in line)


STRAY = {
    "other": ("c1", "P-3", "u2", "link_dep", '{"depends_on_node_id":"P-1","dep_type":""}', 8, 8, "0" * 16, "ann", 8, None),
    "shared": ("c2", "P-4", "u2", "create_node", '{"title":"e"}', 1, 1, "0" * 16, "ann", 0, 3),
    "default": ("c3", "P-3", "b1", "unlink_dep", '{"depends_on_node_id":"P-2"}', 8, 8, "0" * 16, "ann", 8, None),
}
FINE = {
    "unlinked": ("c4", "P-2", "u2", "unlink_dep", '{"depends_on_node_id":"P-1"}', 8, 8, "0" * 16, "ann", 8, None),
    "gone": ("c5", "P-2", "u2", "delete", "{}", 6, 6, "0" * 16, "ann", 6, 2),
    "early": ("c6", "P-2", "u2", "link_dep", '{"depends_on_node_id":"P-7"}', 1, 1, "0" * 16, "ann", 0, None),
    "nobody": ("c7", "P-8", "u9", "link_dep", '{"depends_on_node_id":"P-7"}', 1, 1, "0" * 16, "ann", 0, None),
    "empty": ("c8", "P-3", "", "link_dep", '{"depends_on_node_id":"P-7"}', 9, 9, "0" * 16, "ann", 9, None),
}


@pytest.mark.parametrize("more", [None, *STRAY, *FINE])
def test_links_of_a_backfilled_log(spark, monkeypatch, more):
    """Links go out from the paths that they name, unless one has the uid of a node elsewhere."""
    log = spark.createDataFrame(TIDY + ([(STRAY | FINE)[more]] if more else []), LOG)
    want = sorted(map(tuple, replay.replay_edges(log).collect()))
    asked = []
    monkeypatch.setattr(replay, "created", lambda rows, made=replay.created: asked.append(1) or made(rows))
    assert sorted(map(tuple, replay.replay_edges(log, backfilled=True).collect())) == want
    assert bool(asked) == (more in STRAY)


def test_links_are_made_without_the_nodes_events(spark):
    """What asks for links alone, or for no text, doesn't deal the nodes' texts."""
    nodes, edges = (view(spark, SF, v) for v in ("nodes", "edges"))
    log = backfill.backfilled(history._with_text(nodes), edges)
    best = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    links = best(log.filter((F.col("op_type") == "link_dep") | (F.col("op_type") == "unlink_dep")))
    creates = best(log.filter("op_type = 'create_node'").select("node_id", "uid"))
    assert "Generate" not in links and "Union" not in links
    assert "Generate" in creates and "title" not in "".join(line for line in creates.splitlines() if "Window" in line or "Generate" in line)
