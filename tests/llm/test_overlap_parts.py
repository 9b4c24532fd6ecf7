"""Small tables of the n-gram Jaccard join are one part: how many tasks run goes by the rows, not by the session's shuffle partitions."""

import random

import pytest
from pyspark.sql import functions as F
from test_brute_force import components

from thicket.llm import overlap


@pytest.fixture
def many_parts(spark):
    """Forty shuffle partitions that Spark doesn't put together."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.set(k, v)


def tasks(spark, run) -> int:
    """How many tasks ``run`` has Spark do."""
    context, group = spark.sparkContext, f"tasks-{random.random()}"
    context.setJobGroup(group, group)
    run()
    context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    stages = {s for job in status.getJobIdsForGroup(group) for s in status.getJobInfo(job).stageIds}
    return sum(info.numCompletedTasks for s in stages if (info := status.getStageInfo(s)))


def texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage, rows = [word() for _ in range(50)], []
    for _ in range(3):
        base = [word() for _ in range(40)]
        for _ in range(20):
            text = base[:]
            for _ in range(rnd.randint(0, 7)):
                text[rnd.randrange(40)] = word()
            rows.append((len(rows), " ".join(text + passage)))
    return rows


def test_a_turn_of_components_has_few_tasks(many_parts):
    edges = many_parts.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).repartition(40)
    found = []
    n = tasks(many_parts, lambda: found.extend(overlap.components(edges).collect()))
    assert {r.node: r.component for r in found} == dict.fromkeys(range(61), 0)
    assert n < 400


def test_rounds_have_few_tasks(many_parts, monkeypatch):
    monkeypatch.setattr(overlap, "FEW", 1)
    docs, found = many_parts.createDataFrame(texts(), "doc_id bigint, text string").repartition(4), []
    n = tasks(many_parts, lambda: found.extend(overlap.near_duplicates(docs).collect()))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(texts())
    assert n < 3000


def test_large_tables_in_many_parts_give_the_same(spark, monkeypatch):
    for name, value in (("ROWS", 3), ("FEW", 1), ("MORE", 2), ("SENT", 0)):
        monkeypatch.setattr(overlap, name, value)
    docs = spark.createDataFrame(texts(), "doc_id bigint, text string").repartition(4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in overlap.near_duplicates(docs).collect()} == components(texts())
