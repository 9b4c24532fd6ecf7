"""Toxicity on given labels at every size, in any order, and where labels say little or nothing."""

import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.llm import queries, toxicity

#: By size the true and false positives among held-out labelled texts: at least so many, at most such a share.
EXPECTED = {"sf0.001": (1, 0.05), "sf0.01": (12, 0.05), "sf0.1": (95, 0.05)}


def labelled(sf):
    folder = f"/root/testdata/{sf}"
    return duckdb.sql(f"SELECT doc_id, text, toxic FROM '{folder}/documents.parquet' JOIN '{folder}/labels.parquet' USING (doc_id)").fetchall()


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_held_out_labels(spark, sf):
    score = {r.doc_id: r for r in queries.op2_compression_toxicity(spark, f"/root/testdata/{sf}").collect()}
    held = [(score[i], y) for i, _, y in labelled(sf) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r.held_out for r, _ in held)
    found, wrong = sum(r.predicted for r, y in held if y), sum(r.predicted for r, y in held if not y)
    least, most = EXPECTED[sf]
    assert found >= least
    assert wrong <= most * sum(not y for _, y in held), (found, wrong)
    assert sum(r.predicted for r in score.values()) <= 0.2 * len(score)


def test_order_does_not_matter():
    rows = [r for r in labelled("sf0.01") if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    models = []
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        models.append(toxicity.learn([t for _, t, y in rows if y], [t for _, t, y in rows if not y]))
    assert all(m.toxic == models[0].toxic and m.ordinary == models[0].ordinary and np.array_equal(m.weights, models[0].weights) for m in models)


def test_other_parts_agree(monkeypatch):
    """With the texts dealt into other parts, held-out precision and recall stay near."""
    rows = labelled("sf0.01")
    learn, held = ([r for r in rows if (zlib.crc32(str(r[0]).encode()) % 3 == 1) == out] for out in (False, True))
    found = []
    for seed in range(3):
        monkeypatch.setattr(toxicity, "fold", lambda t, seed=seed: zlib.crc32(b"%d" % seed + t.encode()) % toxicity.FOLDS)
        model = toxicity.learn([t for _, t, y in learn if y], [t for _, t, y in learn if not y])
        distances = toxicity.Distances(model)
        flagged = [y for _, t, y in held if toxicity.score(t, model, distances) >= toxicity.SCORE_AT]
        found.append((sum(flagged) / len(flagged), sum(flagged) / sum(y for *_, y in held)))
    assert all(abs(a - b) <= 0.12 for x, y in zip(found, found[1:], strict=False) for a, b in zip(x, y, strict=True)), found


def test_labels_without_signal_flag_nothing():
    """Random labels: no curve beats calling all toxic, or it flags next to nothing."""
    rnd = random.Random(5)
    stock = ["".join(rnd.choice("bcdfgaeiou") for _ in range(6)) for _ in range(400)]
    texts = [" ".join(rnd.choice(stock) for _ in range(60)) for _ in range(300)]
    model = toxicity.learn(texts[:60], texts[60:])
    distances = toxicity.Distances(model)
    assert sum(toxicity.score(t, model, distances) >= toxicity.SCORE_AT for t in texts) <= 0.05 * len(texts) + 60
    fresh = [" ".join(rnd.choice(stock) for _ in range(60)) for _ in range(300)]
    assert sum(toxicity.score(t, model, distances) >= toxicity.SCORE_AT for t in fresh) <= 0.05 * len(fresh)


def test_few_and_conflicting_labels(spark):
    """Under FOLDS texts of a kind nothing is learned; ids labelled both ways teach nothing; equal texts of both kinds give a constant under the cut."""
    rows = [(i, f"w{i} x{i} y{i}") for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    label = lambda pairs: spark.createDataFrame(pairs, "doc_id long, toxic int")
    assert toxicity.fit(table, label([(1, 1), (2, 1), (3, 0), (4, 0), (5, 0)]), F.lit(True)) is None
    assert toxicity.fit(table, label([(i, y) for i in range(20) for y in (0, 1)]), F.lit(True)) is None
    same = toxicity.learn(["a b c", "d e f", "g h i"], ["a b c", "d e f", "g h i"])
    distances = toxicity.Distances(same)
    scores = {toxicity.score(t, same, distances) for t in ("a b c", "zzz", "q")}
    assert len(scores) == 1 and max(scores) < toxicity.SCORE_AT and toxicity.score("", same, distances) == 0.0


def test_savings_never_speak_for_a_text():
    rows = labelled("sf0.01")
    model = toxicity.learn([t for _, t, y in rows if y], [t for _, t, y in rows if not y])
    assert (model.weights[1:] >= 0).all()
