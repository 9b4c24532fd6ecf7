"""The block tables are met without a broadcast."""

from thicket.llm import simhash


def test_near_broadcasts_nothing(spark):
    prints = spark.createDataFrame([(0,), (7,), (15,), (-1,)], "bits long")
    found = simhash.near(prints.filter("bits >= 0"), prints)
    assert sorted(map(tuple, found.collect())) == [(0, 7, 3), (7, 0, 3), (7, 15, 1), (15, 7, 1)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
