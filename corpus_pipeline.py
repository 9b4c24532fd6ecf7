"""A corpus pipeline: toxic texts go, junk goes, one of each group of copies stays, personal data is masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns the documents that go on,
with the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm import overlap, packing, pii, quality, toxicity
from thicket.llm.common import cut, table
from thicket.llm.queries import vocabulary

LENGTH = 2048


def clean_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what scores as toxic; learns from all labels of the documents at hand."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.without_toxic(docs, model)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the current policy of quality rules rejects."""
    return quality.only_kept(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near copies."""
    return overlap.without_copies(docs)


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that disclose it, by their kind; n_chars follows the text."""
    clean = pii.redact(docs, pii.find(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), LENGTH)


STAGES = [
    ("toxicity", clean_language),
    ("quality rules", good_quality),
    ("n-gram Jaccard join", one_of_each),
    ("PII", masked),
    ("best-fit packing", packed),
]

#: The dictionaries, shingle hashes and token ids have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
