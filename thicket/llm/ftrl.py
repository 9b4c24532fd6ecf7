"""Quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

A text's n-grams fall into three families: its words (lower case), its pairs of
words, and the forms of one to three words: their letter case, whether they
hold digits, letters beyond ASCII or signs, whether they repeat the word before
or the one before that, and whether the last four words occurred in the text
before. Each n-gram is hashed to one of BUCKETS numbers, with its share of its
family as its value; a text is a sparse vector, its score the logistic of a dot
product.

Training takes labelled rows dealt into shards of about SHARD by a hash of the
id. In each of ROUNDS rounds every shard, in a fixed order of its rows, goes on
from the state of the round before (sums of gradients and of their squares);
the new state is the mean of what the shards reach, summed up by Spark. At most
LEARN rows on average are learned from, chosen by the same hash.

Every text is scored from its whole length. Null and empty texts have no
n-grams and get the score of the constant alone. Ids with both labels, and rows
without a text, teach nothing; repeated rows teach as often as they occur. If
nothing can be learned, or all labels are the same, the score is the share of
label 1, 0.5 without any. Null ids pass through; repeated rows give repeated
rows; columns other than those named are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import cut, small_batches
from thicket.llm.shingles import AT_ONCE, U, mix, word_hashes

BUCKETS = 1 << 17
LEARN, SHARD, ROUNDS = 40_000, 2_500, 4
ALPHA, BETA, L1, L2 = 20.0, 1.0, 0.002, 0.001
SCORE_AT = 0.3
_SHIFT = U(64 - 17)
#: By byte: lower case, upper case, digit, beyond ASCII, sign.
_KIND = np.full(256, 4, np.uint8)
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 3
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_FACTOR = mix(np.arange(1, 9, dtype=U)) | U(1)


def _forms(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A number for each word's form: which kinds of characters it holds, which it starts and ends with."""
    kinds = _KIND[raw]
    gap = _SPACES[raw]
    held = np.bitwise_or.reduceat(np.where(gap, np.uint8(0), np.left_shift(np.uint8(1), kinds)), starts)
    past = np.flatnonzero(gap[1:] & ~gap[:-1])
    last = np.r_[past, len(raw) - 1][: len(starts)]
    return held.astype(U) * U(25) + kinds[starts] * U(5) + kinds[last] + U(1)


def grams(texts: list[str]) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """Runs of texts (from, to), and for each family the buckets of all their n-grams, and in which text of the run each stands."""
    raws = [t.encode() for t in texts]
    at = 0
    while at < len(raws):
        to, size = at, 0
        while to < len(raws) and (to == at or size + len(raws[to]) <= AT_ONCE):
            size += len(raws[to]) + 1
            to += 1
        raw = np.frombuffer(b"\n".join(raws[at:to]), np.uint8)
        starts, h = word_hashes(raw)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raws[at:to])]))
        doc = np.repeat(np.arange(to - at), np.diff(bounds))
        if not len(h):
            yield at, to, []
        else:
            one, two = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
            repeats = np.zeros(len(h), U)
            repeats[1:] += (h[1:] == h[:-1]) & one
            repeats[2:] += U(2) * ((h[2:] == h[:-2]) & two)
            if len(h) >= 4:
                four = sum(h[k : len(h) - 3 + k] * _FACTOR[k] for k in range(4)) + doc[:-3].astype(U) * _FACTOR[6]
                again = np.ones(len(four), bool)
                again[np.unique(four, return_index=True)[1]] = False
                repeats[3:] += U(4) * (again & (doc[3:] == doc[:-3]))
            form = _forms(raw, starts) * U(8) + repeats
            pairs = (h[:-1] * _FACTOR[4] + h[1:] * _FACTOR[5])[one]
            twos = (form[:-1] * U(8192) + form[1:] + U(1 << 40))[one]
            threes = ((form[:-2] * U(8192) + form[1:-1]) * U(8192) + form[2:] + U(1 << 60))[two]
            shapes = np.concatenate([form + U(1 << 20), twos, threes]), np.concatenate([doc, doc[1:][one], doc[2:][two]])
            yield at, to, [((mix(x) >> _SHIFT).astype(np.int32), d) for x, d in ((h, doc), (pairs, doc[1:][one]), shapes)]
        at = to


def vectors(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's buckets in order, and their values: the shares of their family, of all families summed up."""
    for at, to, families in grams(texts):
        parts = [[] for _ in range(at, to)]
        for buckets, doc in families:
            key, n = np.unique(doc * BUCKETS + buckets, return_counts=True)
            own = key // BUCKETS
            share = n / np.bincount(own, n)[own]
            edge = np.searchsorted(own, np.arange(to - at + 1))
            for i in np.unique(own).tolist():
                parts[i].append((key[edge[i] : edge[i + 1]] % BUCKETS, share[edge[i] : edge[i + 1]]))
        for found in parts:
            if not found:
                yield np.zeros(0, np.int32), np.zeros(0, np.float32)
            else:
                buckets, where = np.unique(np.concatenate([b for b, _ in found]), return_inverse=True)
                yield buckets.astype(np.int32), np.bincount(where, np.concatenate([v for _, v in found])).astype(np.float32)


def dots(texts: list[str], weights: np.ndarray) -> Iterator[np.ndarray]:
    """The dot products of the texts' vectors with the weights, without the constant: in each family the mean of the weights met."""
    for at, to, families in grams(texts):
        total = np.zeros(to - at)
        for buckets, doc in families:
            total += np.bincount(doc, weights[buckets], to - at) / np.maximum(1, np.bincount(doc, minlength=to - at))
        yield total


@dataclass
class State:
    """Sums of gradients less what the weights stand for (z) and of squared gradients (n), by bucket; the last entry is the constant's."""

    z: np.ndarray
    n: np.ndarray

    @classmethod
    def start(cls, share: float = 0.5) -> State:
        """Nothing seen yet but the share of label 1, which the constant stands for."""
        at = cls(np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1))
        at.z[-1] = -np.log(share / (1 - share)) * (BETA / ALPHA)
        return at

    def weights(self, at=slice(None)) -> np.ndarray:
        """The weights that lead, given all gradients so far; the constant isn't held back."""
        z, n = self.z[at], self.n[at]
        held = np.full(z.shape, L1)
        ridge = np.full(z.shape, L2)
        last = np.arange(BUCKETS + 1)[at] == BUCKETS
        held[last] = ridge[last] = 0
        return -np.sign(z) * np.maximum(np.abs(z) - held, 0) / ((BETA + np.sqrt(n)) / ALPHA + ridge)

    def learn(self, at: np.ndarray, value: np.ndarray, label: int) -> None:
        at, value = np.append(at, BUCKETS), np.append(value, np.float32(1))
        w = self.weights(at)
        g = (_logistic(w @ value) - label) * value
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = grown


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _examples(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str, text_col: str, label_col: str) -> tuple[DataFrame, int, int]:
    """(shard, place, label, at, value) of the rows to learn from, how many there are, and how many have label 1."""
    known = labels.select(id_col, F.col(label_col).alias("label")).filter("label in (0, 1)").groupBy(id_col).agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").drop("other")
    usable = docs.filter(learn_from & F.col(text_col).isNotNull())
    n = usable.select(id_col).join(known, id_col).count()
    place = F.xxhash64(F.col(id_col))
    shards = max(1, min(n, LEARN) // SHARD)
    chosen = usable.select(id_col, F.col(text_col).alias("text")).join(known, id_col)
    if n > LEARN:
        chosen = chosen.filter(F.pmod(F.xxhash64(F.lit("chosen"), F.col(id_col)), F.lit(1_000_000)) < int(LEARN / n * 1_000_000))
    rows = chosen.select(F.pmod(place, F.lit(shards)).cast("int").alias("shard"), place.alias("place"), F.col("label").cast("int").alias("label"), "text")

    def run(batches):
        for batch in batches:
            pairs = list(vectors(batch["text"].to_pylist()))
            yield pa.RecordBatch.from_arrays([batch["shard"], batch["place"], batch["label"], pa.array([a.tobytes() for a, _ in pairs], pa.binary()), pa.array([v.tobytes() for _, v in pairs], pa.binary())], ["shard", "place", "label", "at", "value"])

    # dealt and sorted once: what is read back keeps its partitions and their order, so no round shuffles
    made = cut(rows.mapInArrow(run, "shard int, place long, label int, at binary, value binary").repartition(shards, "shard").sortWithinPartitions("shard", "place", "at", "value", "label"))
    total = made.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
    return made, total["n"], total["ones"] or 0


def _round(examples: DataFrame, shards: int, state: State) -> State:
    """The mean of what the shards reach from ``state``; each shard's examples lie in a row in one partition."""
    spark = examples.sparkSession
    told = spark.sparkContext.broadcast(state)

    def moved(own: State, shard_from: State):
        at = np.flatnonzero((own.n != shard_from.n) | (own.z != shard_from.z))
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array((own.z - shard_from.z)[at]), pa.array((own.n - shard_from.n)[at])], ["bucket", "z", "n"])

    def run(batches) -> Iterator[pa.RecordBatch]:
        shard, own = None, None
        for batch in batches:
            for s, label, at, value in zip(*(batch[c].to_pylist() for c in ("shard", "label", "at", "value")), strict=True):
                if s != shard:
                    if own is not None:
                        yield moved(own, told.value)
                    shard, own = s, State(told.value.z.copy(), told.value.n.copy())
                own.learn(np.frombuffer(at, np.int32), np.frombuffer(value, np.float32), label)
        if own is not None:
            yield moved(own, told.value)

    sums = examples.mapInArrow(run, "bucket int, z double, n double").groupBy("bucket").agg(F.sum("z").alias("z"), F.sum("n").alias("n")).toPandas()
    new = State(state.z.copy(), state.n.copy())
    at = sums["bucket"].to_numpy()
    new.z[at] += sums["z"].to_numpy() / shards
    new.n[at] += sums["n"].to_numpy() / shards
    return new


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights by bucket and, last, the constant, from labelled texts whose rows of ``docs`` meet ``learn_from``."""
    small_batches(docs.sparkSession)
    examples, n, ones = _examples(docs, labels, learn_from, id_col, text_col, label_col)
    if not 0 < ones < n:
        weights = np.zeros(BUCKETS + 1)
        weights[-1] = 30.0 * np.sign(ones - (n - ones))
        return weights
    state = State.start(ones / n)
    for _ in range(ROUNDS):
        state = _round(examples, max(1, min(n, LEARN) // SHARD), state)
    return state.weights()


def scored(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and score of every row."""
    small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(weights)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        w = told.value
        for batch in batches:
            scores = _logistic(w[-1] + np.concatenate(list(dots([t or "" for t in batch["text"].to_pylist()], w))))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(scores, pa.float64())], [id_col, "score"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, score double")
