"""Toxicity by compression distance: which of two zstandard dictionaries suits a text's windows better.

Two dictionaries are trained apart by zstandard's own trainer: one on the
windows of ordinary texts, the other on toxic texts. A toxic text is mostly
ordinary, so the toxic dictionary's samples are those of its words that tell:
whose beginning occurs in many toxic texts, and much more often than in
ordinary ones, whatever stands before it. Near copies of one text count once:
those that share half of a sketch of their word runs.

Each window (a word, its characters written TIMES times over, as a match must
weigh more than zstandard's fixed bytes) is compressed with both dictionaries;
the share of bytes that the toxic one saves is the window's distance, zero if
it saves none. A worker compresses a window once. The distances of a text's windows
give its score by a curve with weights of zero or more, so a saving never
speaks for a text. The curve is calibrated by cross-fitting: the labelled texts
are dealt into FOLDS parts, near copies together, and each part is measured
with dictionaries of the others. Of a few bounds on how many toxic texts a
telling word needs, the one with the best cross-fitted F1 is taken. The cut,
SCORE_AT, is where that F1 is best among cuts that at most CLEAN of the
ordinary texts reach. If no cut beats calling everything toxic, every text gets
the toxic share of the sample (at most half) as its score.

The fit takes at most LEARN labelled ids of each kind, one text of at most
LONGEST characters of each, chosen by a hash of the id; what it finds depends
on the set of texts, not on their order. Ids labelled both ways teach nothing.
Every text is scored from its whole length. Null and empty texts, and all texts
if one kind has under FOLDS labelled texts, get score 0. Null ids pass through,
repeated rows give repeated rows, columns other than those named are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import small_batches

LEARN = 3_000
LONGEST = 20_000
#: Words of a sample of ordinary text.
SAMPLE = 8
#: A beginning must occur in one of so many toxic texts, and in one of these numbers of them at least, and so much more often than in ordinary ones.
ONE_OF, LEASTS, RATIO = 120, (6, 3, 2), 12
#: Parts of the labelled texts for cross-fitting; the share of ordinary ones that may reach the cut.
FOLDS, CLEAN = 3, 0.02
#: Hashes by which near copies are told.
SKETCH = 32
#: Bytes of the dictionaries at most, and of the trainer's segments: an ordinary one is a run of words, a toxic one holds several words that tell.
ORDINARY, TOXIC = (131_072, 32), (32_768, 96)
SCORE_AT = 0.7
TIMES = 3
#: zstandard's level; deep enough to find what a dictionary holds.
LEVEL = 12
#: Distances from which a window counts.
SOME, MANY = 0.3, 0.4
#: Windows whose distance a worker keeps.
KEPT = 300_000
_WORD = re.compile(r"[^\W\d_]+")


def windows(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Spelling(dict):
    """Words with each character written TIMES times; a bounded cache."""

    def __missing__(self, word: str) -> bytes:
        if len(self) > 200_000:
            self.clear()
        found = self[word] = "".join([c * TIMES for c in word]).encode()
        return found


_SPELL = _Spelling()


def _beginnings(word: str) -> list[str]:
    """A word's first letters, and the whole of it with a mark."""
    return [word[:k] for k in (4, 5, 6) if len(word) > k] + [word + "$"]


def text_classes(texts: list[str]) -> list[int]:
    """For each text the first one that it is a near copy of, itself if there is none: half of the SKETCH least hashes of runs of four words are the same."""
    holders: defaultdict[int, list[int]] = defaultdict(list)
    found = []
    for i, t in enumerate(texts):
        words = _WORD.findall(t.lower())
        own = sorted({zlib.crc32(" ".join(words[k : k + 4]).encode()) for k in range(max(1, len(words) - 3))})[:SKETCH]
        shared = Counter(j for h in own for j in holders[h])
        first = min((j for j, n in shared.items() if 2 * n >= len(own)), default=i)
        if first == i:
            for h in own:
                holders[h].append(i)
        found.append(first)
    return found


def _anywhere(word: str) -> set[str]:
    """All that a beginning could match inside the word, and the whole of it with a mark."""
    return {word[i : i + k] for k in (4, 5, 6) for i in range(len(word) - k + 1)} | {word + "$"}


def _folds_with(texts: list[str], classes: list[int], keys) -> dict[str, np.ndarray]:
    """In how many classes of texts each word beginning occurs, by fold; those in ``keys`` count inside words too, as a compressor finds them there.

    Without ``keys`` all that enough classes have count; hashes tell them first, so the many that one class has are never held.
    """
    members: defaultdict[int, list[str]] = defaultdict(list)
    for t, c in zip(texts, classes, strict=True):
        members[c].append(t)

    def of_class(own: list[str]) -> set[str]:
        words = {w for t in own for w in _WORD.findall(t.lower())}
        return {k for w in words for k in (_beginnings(w) if keys is None else _anywhere(w)) if keys is None or k in keys}

    often: set[int] = set()
    if keys is None:
        hashes = [np.fromiter(map(hash, of_class(own)), np.int64) for own in members.values()]
        at, n = np.unique(np.concatenate(hashes), return_counts=True)
        often = set(at[n >= min(LEASTS)].tolist())
    found: defaultdict[str, np.ndarray] = defaultdict(lambda: np.zeros(FOLDS, np.int64))
    for c, own in members.items():
        f = fold(texts[c])
        for k in of_class(own):
            if keys is not None or hash(k) in often:
                found[k][f] += 1
    return dict(found)


def fold(text: str) -> int:
    return zlib.crc32(text.encode()) % FOLDS


class Tells:
    """Counts of word beginnings in classes of near copies, from which the telling words of any folds follow."""

    def __init__(self, toxic: list[str], ordinary: list[str]):
        bad, good = text_classes(toxic), text_classes(ordinary)
        #: Near copies share the fold of their first.
        self.fold_bad, self.fold_good = [fold(toxic[c]) for c in bad], [fold(ordinary[c]) for c in good]
        self.bad = _folds_with(toxic, bad, None)
        self.good = _folds_with(ordinary, good, self.bad)
        self.n_bad, self.n_good = (np.bincount([fold(texts[c]) for c in set(own)], minlength=FOLDS) for texts, own in ((toxic, bad), (ordinary, good)))
        self.words = {w for t in toxic for w in _WORD.findall(t.lower())}

    def telling(self, least: int, without: int = -1) -> set[str]:
        """Words of toxic texts whose beginning occurs in many classes of them, and in few of ordinary texts, in all folds but one."""
        here = np.arange(FOLDS) != without
        need = max(least, int(self.n_bad[here].sum()) // ONE_OF)
        share = self.n_bad[here].sum() / max(1, self.n_good[here].sum())
        none = np.zeros(FOLDS, int)
        keys = {k for k, n in self.bad.items() if (own := n[here].sum()) >= need and own >= RATIO * share * (self.good.get(k, none)[here].sum() + 0.5)}
        return {w for w in self.words if not keys.isdisjoint(_beginnings(w))}


def _samples(text: str, n: int) -> list[bytes]:
    words = _WORD.findall(text.lower())
    return [b"  %b  " % b"  ".join([_SPELL[w] for w in words[i : i + n]]) for i in range(0, len(words), n)]


def _train(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary trained on the samples; the samples themselves where they are too few."""
    try:
        return zstandard.train_dictionary(size, samples, d=6, k=segment).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        own = []
        for raw in (self.ordinary, self.toxic):
            how = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)  # no entropy tables: a found word saves more
            d.precompute_compress(compression_params=how)
            own.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d))
        return own[0], own[1]


class Distances(dict):
    """A window's share of saved bytes, by window; holds a bounded number."""

    def __init__(self, model: Model):
        super().__init__()
        self.ordinary, self.toxic = (c.compress for c in model.compressors()) if model.toxic else (len, len)

    def __missing__(self, word: str) -> float:
        if self.toxic is len:
            return 0.0
        if len(self) > KEPT:
            self.clear()
        window = b"  %b  " % _SPELL[word]
        plain = len(self.ordinary(window))
        found = self[word] = max(0.0, (plain - len(self.toxic(window))) / plain)
        return found


def features(text: str, distances: Distances) -> np.ndarray:
    """One, then of the windows' distances: the largest, the sum of the three largest, how many reach SOME and MANY, and the latter's share."""
    parts = windows(text)
    if not parts:
        return np.zeros(6)
    saved = np.array([distances[w] for w in parts])
    top = np.sort(saved)[::-1][:3]
    some, many = int((saved >= SOME).sum()), int((saved >= MANY).sum())
    return np.array([1.0, top[0], top.sum(), np.log1p(some), np.log1p(many), many / len(parts)])


def _curve(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights of zero or more, but for the first, the constant: Newton's steps coordinate by coordinate, with a small ridge."""
    w = np.zeros(x.shape[1])
    w[0] = np.log(y.mean() / (1 - y.mean()))
    z = x @ w
    for _ in range(200):
        before = w.copy()
        for j in range(x.shape[1]):
            p = 1 / (1 + np.exp(-z.clip(-30, 30)))
            ridge = 0.1 if j else 0.0
            step = ((y - p) @ x[:, j] - ridge * w[j]) / ((p * (1 - p)) @ (x[:, j] ** 2) + ridge + 1e-9)
            new = w[j] + float(np.clip(step, -2, 2))
            new = new if j == 0 else max(0.0, new)
            z += (new - w[j]) * x[:, j]
            w[j] = new
        if np.abs(w - before).max() < 1e-4:
            break
    return w


def _best_cut(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(F1, cut) of the best cut between two different values that few ordinary texts reach; (0, 0) if there is none."""
    order = np.argsort(-z, kind="stable")
    v, hits = z[order], np.cumsum(y[order])
    n = np.arange(1, len(y) + 1)
    f1 = 2 * hits / (n + y.sum())
    usable = np.r_[v[:-1] > v[1:] + 1e-9, False] & (n - hits <= CLEAN * (len(y) - y.sum()))
    if not usable.any():
        return 0.0, 0.0
    k = int(np.where(usable, f1, 0).argmax())
    return float(f1[k]), float((v[k] + v[k + 1]) / 2)


def _trained(toxic: list[str], ordinary: list[str], telling: set[str], usual: bytes | None = None) -> Model:
    told = [s for t in toxic for w in _WORD.findall(t.lower()) if w in telling for s in _samples(w, 1)]
    return Model(usual or _usual(ordinary), _train(told, *TOXIC), np.zeros(6))


def _usual(ordinary: list[str]) -> bytes:
    return _train([w for t in ordinary for w in _samples(t, SAMPLE)], *ORDINARY)


def learn(toxic: list[str], ordinary: list[str]) -> Model | None:
    """Dictionaries of all texts, with the curve that cross-fitting gives."""
    toxic, ordinary = (sorted({t for t in texts if t}, key=lambda t: (zlib.crc32(t.encode()[::-1]), t)) for texts in (toxic, ordinary))
    if len(toxic) < FOLDS or len(ordinary) < FOLDS:
        return None
    tells = Tells(toxic, ordinary)
    parts = []
    for f in range(FOLDS):
        inside = [[t for t, own in zip(texts, folds, strict=True) if own != f] for texts, folds in ((toxic, tells.fold_bad), (ordinary, tells.fold_good))]
        outside = [[t for t, own in zip(texts, folds, strict=True) if own == f] for texts, folds in ((toxic, tells.fold_bad), (ordinary, tells.fold_good))]
        parts.append((inside, outside, _usual(inside[1])))
    y = np.array([float(kind == 0) for _, outside, _ in parts for kind in (0, 1) for _ in outside[kind]])
    share = y.mean()
    best = (2 * share / (1 + share), None)
    tried: set[tuple] = set()
    for least in LEASTS:
        chosen = [tells.telling(least, f) for f in range(FOLDS)]
        key = tuple(map(frozenset, chosen))
        if key in tried or not all(chosen):
            continue
        tried.add(key)
        x = []
        for f, (inside, outside, usual) in enumerate(parts):
            distances = Distances(_trained(inside[0], inside[1], chosen[f], usual))
            x += [features(t, distances) for kind in (0, 1) for t in outside[kind]]
        x = np.stack(x)
        w = _curve(x, y)
        f1, at = _best_cut(x @ w, y)
        if f1 > best[0] + 0.05 * (best[1] is not None):
            w[0] += np.log(SCORE_AT / (1 - SCORE_AT)) - at
            best = f1, (least, w)
    if best[1] is None:
        model = Model(b"", b"", np.zeros(6))
        share = min(share, 0.5)
        model.weights[0] = np.log(share / (1 - share))
        return model
    least, weights = best[1]
    _SPELL.clear()
    model = _trained(toxic, ordinary, tells.telling(least))
    model.weights = weights
    return model


def score(text: str | None, model: Model, distances: Distances) -> float:
    f = features(text or "", distances)
    return float(1 / (1 + np.exp(-np.clip(f @ model.weights, -30, 30)))) if f[0] else 0.0


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """A model from labelled texts whose rows of ``docs`` meet ``learn_from``; of rows with one id one text counts.

    Ids are chosen first; only the texts of those chosen are fetched, each once,
    by one task, whose sample LEARN and LONGEST bound; only the model comes to
    the driver.
    """
    small_batches(docs.sparkSession)
    usable = docs.filter(learn_from & F.length(text_col).between(1, LONGEST)).select(id_col, F.col(text_col).alias("text"))
    told = labels.select(id_col, F.col(label_col).alias("label")).filter("label in (0, 1)").groupBy(id_col).agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other")
    known = usable.select(id_col).join(told.drop("other"), id_col)

    def own(y: int) -> DataFrame:
        ids = known.filter(F.col("label") == y).select(id_col).distinct().orderBy(F.xxhash64(id_col), id_col).limit(LEARN)
        return usable.join(F.broadcast(ids), id_col).groupBy(id_col).agg(F.min("text").alias("text")).select("text", F.lit(y).alias("label"))

    found = own(1).union(own(0)).coalesce(1).mapInPandas(_learned, "ordinary binary, toxic binary, weights array<double>").collect()
    return Model(bytes(found[0]["ordinary"]), bytes(found[0]["toxic"]), np.array(found[0]["weights"])) if found else None


def _learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The model of the one task that has all labelled texts; no row if they are too few."""
    texts: tuple[list[str], list[str]] = [], []
    for batch in batches:
        for text, label in zip(batch["text"], batch["label"], strict=True):
            texts[label].append(text)
    model = learn(texts[1], texts[0])
    if model:
        yield pd.DataFrame({"ordinary": [model.ordinary], "toxic": [model.toxic], "weights": [model.weights.tolist()]})


def _scores(docs: DataFrame, model: Model | None, text_col: str) -> Column:
    """The score as a column; only the texts go to Python."""
    small_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = told.value
        distances = Distances(own) if own else None
        for texts in batches:
            yield pd.Series([score(t, own, distances) if own else 0.0 for t in texts], dtype="float64")

    return run(text_col)


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and score of every row."""
    return docs.select(F.col(id_col), _scores(docs, model, text_col).alias("score"))


def without_toxic(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows whose score is under SCORE_AT, with all their columns."""
    return docs.filter(_scores(docs, model, text_col) < SCORE_AT)
