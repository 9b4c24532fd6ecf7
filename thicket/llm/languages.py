"""Language identification as a mixture: which languages a text holds, and how much of each.

Counts of hashed byte trigrams of labelled texts give each language's n-gram
likelihoods. For a text, expectation-maximisation estimates the proportions of
the languages; a language stays in the set only if the likelihood it adds
outweighs a penalty that grows with the logarithm of the text's length.

Fitted on a share of each language's labelled texts, chosen by a hash of their
id, that makes PER_LANGUAGE of them on average (all, where there are fewer);
every text is predicted from its whole length. A text that is null, empty or without a letter (of Unicode's categories L*) is ``und``
with score 0, as is any text if nothing could be learned. Ties go to the
language first by name. Null ids pass through; repeated rows give repeated
rows; columns other than those named are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import small_batches

BUCKETS = 1 << 15
PER_LANGUAGE = 5_000
TURNS = 12
#: What a language must add to the logarithm of the likelihood, times half the
#: logarithm of the n-grams' number; overlapping n-grams say most things thrice.
PENALTY = 6.0
_KEEP = np.arange(256, dtype=np.uint32)
_KEEP[:65] = 32
_KEEP[91:97] = 32
_KEEP[123:128] = 32


def has_letter(text: str) -> bool:
    """Whether a character is of Unicode's letter categories; superscripts, fractions and Roman numerals are not."""
    return any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """How often each bucket's trigrams occur; ASCII that is no letter counts as space."""
    b = _KEEP[np.frombuffer(f" {text.lower()} ".encode(), np.uint8)]
    code = ((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)
    return np.bincount(code >> np.uint32(17), minlength=BUCKETS)


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities by language and bucket) from the rows that ``learn`` is true for."""
    small_batches(docs.sparkSession)
    rows = docs.filter(learn).filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    share = {r["lang"]: PER_LANGUAGE / r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not share:
        return [], np.zeros((0, BUCKETS))
    chance = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < chance[F.col("lang")] * 1_000_000)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                sums[lang] = sums.get(lang, 0) + gram_counts(text)
        for lang, c in sums.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))], ["lang", "bucket", "n"])

    total = chosen.select("lang", "text").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(total["lang"]))
    table = np.full((len(langs), BUCKETS), 0.1)
    table[[langs.index(x) for x in total["lang"]], total["bucket"].to_numpy()] += total["n"].to_numpy()
    return langs, np.log(table / table.sum(1, keepdims=True))


def mixture(c: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions of the rows of ``p`` in counts ``c`` by expectation-maximisation, and the log likelihood."""
    w = np.full(len(p), 1 / len(p))
    for _ in range(TURNS):
        mixed = w @ p
        w = w * (p @ (c / mixed)) / c.sum()
    return w, float(c @ np.log(w @ p))


def proportions(text: str, logs: np.ndarray) -> np.ndarray:
    """Each language's share of a text; zero for those outside the chosen set."""
    c = gram_counts(text)
    at = np.flatnonzero(c)
    c, logp = c[at].astype(float), logs[:, at]
    alone = logp @ c
    best = np.zeros(len(logs))
    best[alone.argmax()] = 1.0
    if len(logs) == 1:
        return best
    price = PENALTY * 0.5 * np.log(c.sum())
    p = np.exp(logp)
    w, value = mixture(c, p)
    top = alone.max()
    if value - top > price:
        order = np.argsort(-w, kind="stable")
        for k in range(2, len(logs) + 1):
            some = order[:k]
            w, value = mixture(c, p[some])
            if value - (k - 1) * price <= top:
                break
            top = value - (k - 1) * price
            best[:] = 0
            best[some] = w
    return best


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred (largest share), score (that share), and all shares over one hundredth as mixture."""
    small_batches(docs.sparkSession)
    langs, logs = model
    told = docs.sparkSession.sparkContext.broadcast(logs)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            names, scores, shares = [], [], []
            for text in batch["text"].to_pylist():
                if not langs or not text or not has_letter(text):
                    names.append("und")
                    scores.append(0.0)
                    shares.append([])
                    continue
                w = proportions(text, told.value)
                names.append(langs[w.argmax()])
                scores.append(min(1.0, float(w.max())))
                shares.append([(langs[i], float(w[i])) for i in np.flatnonzero(w > 0.01)])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))], [id_col, "lang_pred", "score", "mixture"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"{id_col} {kind}, lang_pred string, score double, mixture map<string,double>")
