"""Steps that shuffle no more than their input asks for."""

import pytest
from pyspark.sql import functions as F

from thicket.operators import hierarchy, text
from thicket.plans import catalogue
from thicket.sources import store

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_shuffle_nothing(spark):
    """A text's words are grouped in its row; empty and missing texts have none; the index check joins two small sums."""
    rows = [(1, "b a B ① é a", "a"), (2, "", None), (3, None, "x-x"), (4, ". ,", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more string")
    found = text.postings(docs, ["text", "more"])
    assert "Exchange" not in plan(found)
    want = [("a", 1, "more", [text.GAP]), ("a", 1, "text", [1, 5]), ("b", 1, "text", [0, 2]), ("x", 3, "more", [text.GAP, text.GAP + 1]), ("é", 1, "text", [4]), ("①", 1, "text", [3])]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sorted(map(tuple, text.lengths(docs, ["text", "more"]).collect())) == [(1, 7), (2, 0), (3, 2), (4, 0)]


def test_a_table_may_stay_as_it_was_dealt(spark, monkeypatch):
    """No shuffle by range, and each file is sorted."""
    monkeypatch.setattr(store, "files", lambda *_: (("f", 90 << 20, 0),))
    first = spark.conf.get(store._FIRST, None)
    found = store.stored(spark, "as_dealt", lambda: spark.range(0, 100, 1, 3).select((-F.col("id")).alias("k")), "k", "f", ranged=False)
    assert len(found.inputFiles()) == 3 and spark.conf.get(store._FIRST, None) == first
    for file in found.inputFiles():
        ks = [r.k for r in spark.read.parquet(file).collect()]
        assert ks == sorted(ks)


def test_the_index_is_dealt_by_texts(spark):
    """Each document's postings are in one file, so what sums them up by document combines before the shuffle."""
    index, sizes = catalogue._index(spark, SF)
    assert index.select("id", F.input_file_name().alias("file")).distinct().groupBy("id").count().filter("count > 1").count() == 0
    assert sizes.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", ["search_and", "search_updated", "index_check"])
def test_queries_bound_the_parts_that_are_joined(spark, name):
    """Parts of shuffles are joined up to 16 MB: compressed ids of 64 MB take a task's memory; a session's own size stays."""
    before = spark.conf.get(store._ADVISED)
    try:
        spark.conf.set(store._ADVISED, "64MB")
        catalogue.queries()[name](spark, SF)
        assert spark.conf.get(store._ADVISED) == store.PART
        spark.conf.set(store._ADVISED, "8m")
        catalogue.queries()[name](spark, SF)
        assert spark.conf.get(store._ADVISED) == "8m"
    finally:
        spark.conf.set(store._ADVISED, before)


def test_prompts_come_from_the_parent(spark):
    """Chains are made for parents only; the same prompts as from whole chains, also where one above is missing or deleted."""
    rows = [("P-1", None, 0, None, "a"), ("P-1.1", "P-1", 1, None, None), ("P-1.2", "P-1", 1, "x", "c"), ("P-1.1.1", "P-1.1", 2, None, "d"), ("P-1.2.1", "P-1.2", 2, None, "e"), ("P-1.2.1.1", "P-1.2.1", 3, None, ""), ("P-2.1", "P-2", 1, None, "g"), ("P-1.1.1.3", "P-1.1.1", 3, None, "long " * 9)]
    nodes = spark.createDataFrame(rows, "id string, parent_id string, depth int, gone string, title string").withColumn("deleted_at", F.when(F.col("gone").isNotNull(), F.lit("2000-01-01").cast("timestamp"))).withColumn("prompt", F.upper("title"))
    held = spark.createDataFrame([("P-1.1.1", "P-9"), ("P-1.1.1", "P-8"), ("P-1", "P-7"), ("P-1.2", "P-1")], "to_id string, from_id string")
    chains = hierarchy.with_ancestors(nodes)
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert sorted(r.id for r in text.contexts(nodes).collect()) == ["P-1", "P-1.1", "P-1.1.1", "P-1.1.1.3"]
    assert same(text.contexts(nodes), text.context(nodes, chains))
    assert same(text.all_prompts(nodes), text.prompts(nodes, chains))
    assert same(text.all_prompts(nodes, held), text.prompts(nodes, chains, held))
    for budget in (5, 12, 20, 40):
        assert same(text.all_prompts(nodes, held, budget), text.prompts(nodes, chains, held, budget))


@pytest.mark.parametrize("name", ["context_prompt", "prompts_full", "prompts_budget"])
def test_only_parents_have_their_chains_put_together(spark, name):
    """Rows of chains are made from distinct parents, not from each node."""
    lines = catalogue.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [k for k, line in enumerate(lines) if "Generate posexplode" in line]
    assert at and all("Aggregate" in "".join(lines[k + 1 : k + 3]) for k in at)


def test_nodes_stay_dealt_by_orders(spark):
    """An order's lines are in one file, sorted; nothing is shuffled by range."""
    from thicket.sources.views import view

    nodes = view(spark, SF, "nodes")
    lines = nodes.filter("depth = 3").select("parent_id", F.input_file_name().alias("file")).distinct()
    assert lines.groupBy("parent_id").count().filter("count > 1").count() == 0
    ids = [r.id for r in spark.read.parquet(max(nodes.inputFiles())).collect()]
    assert ids == sorted(ids)
