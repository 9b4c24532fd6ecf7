"""The quality classifier: its vectors and updates against plain Python, its fit on given labels and on awkward ones."""

import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm import ftrl, queries


def plain_step(z, n, at, value, label):
    """One follow-the-regularised-leader update, coordinate by coordinate."""
    w = {}
    for i in at:
        last = i == ftrl.BUCKETS
        l1, l2 = (0, 0) if last else (ftrl.L1, ftrl.L2)
        w[i] = 0.0 if abs(z.get(i, 0)) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((ftrl.BETA + math.sqrt(n.get(i, 0))) / ftrl.ALPHA + l2)
    p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, value, strict=True))))
    for i, v in zip(at, value, strict=True):
        g = (p - label) * v
        sigma = (math.sqrt(n.get(i, 0) + g * g) - math.sqrt(n.get(i, 0))) / ftrl.ALPHA
        z[i] = z.get(i, 0) + g - sigma * w[i]
        n[i] = n.get(i, 0) + g * g


def test_updates_are_those_of_the_method():
    texts = ["a b c d a b", "the the the the", "x y z", "##### $$$ a", "Une Été été 12 12"]
    state, z, n = ftrl.State.start(0.6), {}, {}
    z[ftrl.BUCKETS] = float(state.z[-1])
    for k in range(20):
        at, value = next(ftrl.vectors([texts[k % 5]]))
        state.learn(at, value, k % 2)
        plain_step(z, n, [*at.tolist(), ftrl.BUCKETS], [*value.tolist(), 1.0], k % 2)
    assert np.allclose(state.z[list(z)], list(z.values()))
    assert np.allclose(state.n[list(n)], list(n.values()))


def test_a_vector_is_the_same_alone_and_in_company(rows):
    texts = [t or "" for _, t in rows]
    together = list(ftrl.vectors(texts))
    weights = np.random.default_rng(1).normal(size=ftrl.BUCKETS + 1)
    dots = np.concatenate(list(ftrl.dots(texts, weights)))
    for text, (at, value), dot in zip(texts, together, dots, strict=True):
        one_at, one = next(ftrl.vectors([text]))
        assert at.tolist() == one_at.tolist() and np.allclose(value, one)
        assert dot == pytest.approx(float(weights[at] @ value), abs=1e-4)
        families = 0 if not text.split() else 2 if len(text.split()) == 1 else 3
        assert value.sum() == pytest.approx(families, abs=1e-3)


def test_repeats_and_case_show():
    of = lambda t: set(next(ftrl.vectors([t]))[0].tolist())
    assert of("Cat cat") != of("cat cat") != of("cat dog") - of("dog")
    assert of("u v w x and u v w x") - of("u v w x and") - of("and u v w x"), "that four words come again is an n-gram of its own"


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_held_out_labels(spark, sf):
    folder = f"/root/testdata/{sf}"
    got = {r.doc_id: r for r in queries.op11_ftrl_quality(spark, folder).collect()}
    labels = duckdb.sql(f"SELECT doc_id, quality FROM '{folder}/labels.parquet'").fetchall()
    assert len(got) == duckdb.sql(f"SELECT count(*) FROM '{folder}/documents.parquet'").fetchall()[0][0]
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(got[i], q) for i, q in labels if got[i].held_out]
    good, bad = [r for r, q in held if q], [r for r, q in held if not q]
    assert sum(r.predicted for r in good) >= 0.99 * len(good)
    assert sum(r.predicted for r in bad) <= max(1, 0.1 * len(bad))
    pairs = [a.score > b.score for a in good for b in bad]
    assert sum(pairs) >= 0.99 * len(pairs)


def test_awkward_rows_and_labels(spark, docs, none, rows):
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(50)] + [(4, 0), (4, 1), (7, None), (None, 1)], "doc_id long, quality int")
    weights = ftrl.fit(docs, labels, F.lit(True))
    found = ftrl.scored(docs, weights)
    assert found.columns == ["doc_id", "score"] and found.count() == len(rows)
    base = 1 / (1 + math.exp(-weights[-1]))
    for r in found.collect():
        assert 0 <= r.score <= 1
        if r.doc_id is None or rows[r.doc_id][1] and rows[r.doc_id][1].split():
            continue
        assert r.score == pytest.approx(base)
    again = ftrl.fit(docs.repartition(3), labels, F.lit(True))
    assert np.allclose(weights, again)
    assert ftrl.scored(none, weights).count() == 0


def test_nothing_to_learn(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    for d, n, share in ((docs, labels, 1.0), (none, labels, 0.5), (docs, labels.filter("false"), 0.5), (docs, labels.select("doc_id", F.lit(0).alias("quality")), 0.0)):
        weights = ftrl.fit(d, n, F.lit(True))
        assert {round(r.score, 6) for r in ftrl.scored(docs, weights).collect()} == {share}


def test_shards_are_averaged(spark, docs, monkeypatch):
    """Two shards by hand give the state that Spark gives."""
    monkeypatch.setattr(ftrl, "SHARD", 10)
    monkeypatch.setattr(ftrl, "ROUNDS", 2)
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(25)], "doc_id long, quality int")
    got = ftrl.fit(docs, labels, F.lit(True))
    made, n, ones = ftrl._examples(docs, labels, F.lit(True), "doc_id", "text", "quality")
    rows = sorted(made.collect(), key=lambda r: (r.shard, r.place, bytes(r.at), bytes(r.value), r.label))
    assert len({r.shard for r in rows}) == 2
    state = ftrl.State.start(ones / n)
    for _ in range(2):
        ends = []
        for shard in range(2):
            own = ftrl.State(state.z.copy(), state.n.copy())
            for r in rows:
                if r.shard == shard:
                    own.learn(np.frombuffer(r.at, np.int32), np.frombuffer(r.value, np.float32), r.label)
            ends.append(own)
        state = ftrl.State(sum(e.z for e in ends) / 2, sum(e.n for e in ends) / 2)
    assert np.allclose(state.weights(), got, atol=1e-9)
