"""The queries opN_<name> over the synthetic tables, and their SQL where DuckDB can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import remainder, table



def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.overlap import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.toxicity import SCORE_AT, fit, scored

    docs = table(spark, sf_dir, "documents")
    fold = remainder(F.col("doc_id"), 3)
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels"), fold != 1))
    return found.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= SCORE_AT).cast("int").alias("predicted"))


def op3_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.chat import format_chats

    return format_chats(table(spark, sf_dir, "conversations"))


def op4_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.quality import apply_policy, ledger

    rows = apply_policy(ledger(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from thicket.llm.bpe import encode_decode

    return encode_decode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.warc import derive, responses

    return derive(responses(table(spark, sf_dir, "pages")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 2048)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.simhash import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents"))


def simhash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprints within three bits of those of every fiftieth id, by the block tables."""
    from thicket.llm.simhash import search

    return search(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0)


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.quality import ablation, ledger

    return ablation(ledger(table(spark, sf_dir, "documents")))


def op9_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.pii import find, report

    return report(find(table(spark, sf_dir, "documents")))


def op10_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.languages import fit, predict

    docs = table(spark, sf_dir, "documents")
    fold = remainder(F.col("doc_id"), 4)
    found = predict(docs, fit(docs, fold != 2))
    return found.select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score", "mixture")


def op11_ftrl_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.ftrl import SCORE_AT, fit, scored

    docs = table(spark, sf_dir, "documents")
    fold = remainder(F.col("doc_id"), 5)
    found = scored(docs, fit(docs, table(spark, sf_dir, "labels"), fold != 0))
    return found.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= SCORE_AT).cast("int").alias("predicted"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.alignment import align

    found = align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def _made_periodic(docs: DataFrame) -> DataFrame:
    """(doc_id, text): a tenth of the documents repeat some of their words to the end, as the operator's contract says."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), F.floor(h / 10).alias("g"))
    n, g = F.size("words"), F.col("g")
    a = F.when(n > 0, g % n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
    periodic = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: F.element_at("words", (at(i) + 1).cast("int"))), " ")
    return rows.select("doc_id", F.when(n > 0, periodic).otherwise(F.col("text")).alias("text"))


def op13_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.llm.periods import find_runs

    found = find_runs(_made_periodic(table(spark, sf_dir, "documents")))
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    # runs come by start, then period, so the first of equal ones stays
    best = F.aggregate("runs", none, lambda most, r: F.when(most.isNull() | (r["length"] * most["period"] > most["length"] * r["period"]), r).otherwise(most))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    own = [F.col(f"b.{c}").alias(c) for c in ("start", "length", "period")]
    return rows.select("doc_id", "n_runs", *own, F.floor(1000 * F.col("b.length") / F.col("b.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith(("op", "simhash_", "quality_")) and callable(f)}


def oracle_sql() -> dict[str, str]:
    from thicket.llm import chat, overlap, quality, warc

    return {"op1_count_vector_join": overlap.ORACLE, "op3_chat_collapse": chat.ORACLE, "op4_quality_ledger": quality.ORACLE, "op6_warc_derivatives": warc.ORACLE, "quality_ablation": quality.ABLATION}
