"""Later rounds of the n-gram Jaccard join take what has pairs left, not whole blocks."""

import random

import numpy as np
from test_brute_force import components

from thicket.llm import overlap


def test_a_block_tells_the_ends_of_what_is_left():
    """One of another component tries its best partner; it and the others come again, the rest of the block doesn't."""
    base = np.arange(100, dtype=np.uint64) * np.uint64(7919)
    far = np.arange(100, dtype=np.uint64) + np.uint64(10**9)
    sets = [np.sort(base[k : 90 + k]) for k in range(4)] + [np.sort(far[k : 90 + k]) for k in range(3)] + [base]
    ids, sizes = np.arange(8), np.array([len(s) for s in sets])
    labels = np.array([0, 0, 0, 0, 0, 0, 0, 7])
    firsts = np.full((8, overlap.FIRSTS), np.iinfo(np.int64).max)
    block = lambda few: overlap.block_pairs(1, ids, sizes, labels, [overlap.point(s) for s in sets], np.zeros(8, int), firsts, few)
    every, none = block(None)
    assert every == {(i, 7) for i in range(4)} and not none
    tried, left = block(1)
    assert len(tried) == 1 and tried < every
    assert left == {i for pair in every - tried for i in pair}


def test_two_of_a_block_may_be_all_that_is_left(spark):
    rows = spark.createDataFrame([(1, 10, 90, 10), (1, 11, 92, 11), (2, 10, 90, 10), (2, 12, 900, 12)], "key long, doc long, n int, label long")
    assert sorted((r.key, r.doc, r.m) for r in overlap._open(rows, 1).collect()) == [(1, 10, 2), (1, 11, 2)]
    assert not overlap._open(rows, 2).count()


def test_rounds_take_only_what_is_left(spark, monkeypatch):
    """Groups of near copies around a passage that all have; each round's rows are of the last one's, and nothing joins blocks by key to get them."""
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage, texts = [word() for _ in range(50)], []
    for _ in range(3):
        base = [word() for _ in range(40)]
        for _ in range(25):
            text = base[:]
            for _ in range(rnd.randint(0, 7)):
                text[rnd.randrange(40)] = word()
            texts.append(text + passage)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    taken, plans, first = [], [], overlap._open

    def seen(given, *more):
        plans.append(given._jdf.queryExecution().optimizedPlan().toString())
        taken.append({(r.key, r.doc) for r in given.select("key", "doc").collect()})
        return first(given, *more)

    for name, value in (("_open", seen), ("FEW", 1), ("MORE", 2), ("PART", 16)):
        monkeypatch.setattr(overlap, name, value)
    found = overlap.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(rows)
    assert len(taken) > 1 and all(b < a for a, b in zip(taken, taken[1:], strict=False))
    assert not any("LeftSemi" in p for p in plans)
    again = {key for key, _ in taken[1]}
    assert len(taken[1]) < sum(key in again for key, _ in taken[0])
