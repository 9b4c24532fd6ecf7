"""Pulling a hub's log page by page: ties at pages' edges, late and repeated pushes, restarts, a batch broken off after its rows were written."""

import os
import random

import pytest

from thicket.operators import replay
from thicket.streaming import pull

SCHEMA = "event_id string, node_id string, uid string, op_type string, author string, machine string, wall_ms long, lamport long, payload string"


def create(n, clock):
    return (f"e{n:04d}", f"P-{n}", f"u{n}", "create_node", "ann", "a" * 16, clock, clock, '{"title": "node %d"}' % n)


def update(n, node, clock, title):
    return (f"e{n:04d}", f"P-{node}", f"u{node}", "update_field", "bob", "b" * 16, clock, clock, '{"field_name": "title", "new_value": "%s"}' % title)


@pytest.fixture
def hub(spark, tmp_path):
    """(push, run, applied): pushes write a file each; a run pulls all that is there, a file a page."""
    folder, applied, checkpoint = (f"{tmp_path}/{x}" for x in ("hub", "applied", "checkpoint"))

    def push(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def run(before=None):
        query = pull.pull(pull.pages(spark, folder, SCHEMA, 1), applied, checkpoint, before)
        if not query.awaitTermination(90):
            query.stop()
            raise AssertionError("the stream doesn't end")
        return checkpoint

    return push, run, lambda: spark.read.parquet(applied)


def ids(frame):
    return sorted(r.event_id for r in frame.select("event_id").collect())


def test_ties_and_late_pushes_are_not_lost(spark, hub):
    push, run, applied = hub
    first, second = [create(1, 1), create(2, 5)], [create(3, 5), update(10, 1, 6, "six")]
    push(first)
    push(second)
    run()
    assert ids(applied()) == ["e0001", "e0002", "e0003", "e0010"]
    push([update(11, 1, 3, "three"), create(4, 2), second[1]])  # two late ones, and one again
    push([update(12, 2, 9, "nine")])
    run()
    log = first + second + [update(11, 1, 3, "three"), create(4, 2), update(12, 2, 9, "nine")]
    assert ids(applied()) == sorted(r[0] for r in log)
    titles = {r.id: r.title for r in pull.state(applied()).collect()}
    assert titles == {"P-1": "six", "P-2": "nine", "P-3": "node 3", "P-4": "node 4"}
    lost = {r.event_id: (r.lamport, r.passed) for r in pull.late(applied()).collect()}
    assert {"e0011": (3, 6), "e0004": (2, 6)}.items() <= lost.items() and len(lost) == 3  # of e0002 and e0003 the one pulled second ties


def test_batch_broken_off_after_its_rows(spark, hub):
    """The last batch's rows are there but not its commit: it runs again, and adds nothing twice."""
    push, run, applied = hub
    push([create(1, 1)])
    push([create(2, 2), create(3, 3)])
    commits = run() + "/commits"
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (str(last), f".{last}.crc"):
        if os.path.exists(f"{commits}/{name}"):
            os.remove(f"{commits}/{name}")
    push([create(4, 4), create(1, 1)])
    run()
    assert ids(applied()) == ["e0001", "e0002", "e0003", "e0004"]


def test_own_events_are_known(spark, hub):
    push, run, applied = hub
    push([create(1, 1), create(2, 2)])
    run(spark.createDataFrame([("e0001",)], "event_id string"))
    assert ids(applied()) == ["e0002"]


def test_state_does_not_hang_on_pages(spark):
    """The state of a shuffled log is that of the sorted one, with numbering by slices of the clock."""
    rnd = random.Random(3)
    log = [create(n, n // 3) for n in range(40)] + [update(100 + n, rnd.randrange(40), 14 + n // 4, f"t{n}") for n in range(200)]
    order = sorted(log, key=lambda r: (r[7], r[6], r[0]))
    want = replay.replay(spark.createDataFrame([(*r, i) for i, r in enumerate(order)], SCHEMA + ", arrival long"))
    rnd.shuffle(log)
    old, pull.CLOCKS = pull.CLOCKS, 5
    try:
        found = pull.state(spark.createDataFrame(log, SCHEMA))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    finally:
        pull.CLOCKS = old


def test_empty_log(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pull.state(empty).count() == 0
    assert pull.late(empty.withColumn("page", empty["lamport"]), "page").count() == 0
