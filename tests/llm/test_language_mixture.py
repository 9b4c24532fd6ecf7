"""Language mixtures against expectation-maximisation in plain loops, over the smallest table."""

import math
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from thicket.llm import common, languages

SF = "/root/testdata/sf0.001"


def plain_counts(text):
    """Trigrams of the bytes, ASCII that is no letter as space, by their hash."""
    raw = f" {text.lower()} ".encode()
    keep = [32 if b < 65 or 91 <= b < 97 or 123 <= b < 128 else b for b in raw]
    return Counter((((a << 16 | b << 8 | c) * 2654435761) & 0xFFFFFFFF) >> 17 for a, b, c in zip(keep, keep[1:], keep[2:], strict=False))


def plain_em(counts, probabilities):
    w = [1 / len(probabilities)] * len(probabilities)
    total = sum(counts.values())
    for _ in range(languages.TURNS):
        new = [0.0] * len(w)
        for gram, n in counts.items():
            mixed = sum(a * p[gram] for a, p in zip(w, probabilities, strict=True))
            for j, p in enumerate(probabilities):
                new[j] += n * w[j] * p[gram] / mixed
        w = [x / total for x in new]
    return w, sum(n * math.log(sum(a * p[g] for a, p in zip(w, probabilities, strict=True))) for g, n in counts.items())


def plain_shares(text, logs):
    counts = plain_counts(text)
    p = [np.exp(row).tolist() for row in logs]
    price = languages.PENALTY * 0.5 * math.log(sum(counts.values()))
    alone = [sum(n * row[g] for g, n in counts.items()) for row in logs]
    shares = [0.0] * len(p)
    shares[alone.index(max(alone))] = 1.0
    w, value = plain_em(counts, p)
    top = max(alone)
    if value - top > price:
        order = sorted(range(len(p)), key=lambda j: (-w[j], j))
        for k in range(2, len(p) + 1):
            w, value = plain_em(counts, [p[j] for j in order[:k]])
            if value - (k - 1) * price <= top:
                break
            top = value - (k - 1) * price
            shares = [0.0] * len(p)
            for j, x in zip(order, w, strict=False):
                shares[j] = x
    return shares


def test_predictions_are_those_of_plain_loops(spark):
    docs = common.table(spark, SF, "documents")
    langs, logs = languages.fit(docs, common.remainder(F.col("doc_id"), 4) != 2)
    texts = {d["doc_id"]: d["text"] for d in pq.read_table(f"{SF}/documents.parquet").to_pylist() if 0 < len(d["text"] or "") < 1_500}
    some = sorted(texts)[:25]
    mixed = [(10_000 + k, f"{texts[a]} {texts[b]}") for k, (a, b) in enumerate(zip(some, some[7:], strict=False))][:8]
    rows = [(i, texts[i]) for i in some] + mixed
    found = {r.doc_id: r for r in languages.predict(spark.createDataFrame(rows, "doc_id long, text string"), (langs, logs)).collect()}
    for i, text in rows:
        shares = plain_shares(text, logs)
        best = max(range(len(langs)), key=lambda j: (shares[j], -j))
        assert found[i].lang_pred == langs[best]
        assert found[i].score == pytest.approx(min(1.0, shares[best]), abs=1e-6)
        assert found[i].mixture == pytest.approx({langs[j]: x for j, x in enumerate(shares) if x > 0.01}, abs=1e-6)


def test_a_half_of_each_shows(spark):
    """A text made of two languages' halves gets both, about equally."""
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()
    langs, logs = languages.fit(common.table(spark, "/root/testdata/sf0.01", "documents"), F.lit(True))
    part = {x: " ".join(d["text"] for d in docs if d["lang"] == x and d["text"])[:4_000] for x in ("de", "fr")}
    shares = languages.proportions(part["de"] + " " + part["fr"], logs)
    assert all(0.3 < shares[langs.index(x)] < 0.7 for x in part)
