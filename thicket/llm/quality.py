"""Quality rules as a ledger: every rule is evaluated once, policies are bit masks.

``ledger`` measures a text and sets one bit for each rule that it fails.
``apply_policy`` reads those bits under a version of the policy; changing or
comparing versions doesn't touch the texts again. ``ablation`` counts what each
rule rejects alone and what would come back without it, all from the bits.

Null texts count as empty ones; an empty text has no words and fails the rule
on their number. Null ids pass through, repeated rows give repeated rows; only
the id is kept of the other columns, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from thicket.llm.common import every

#: White space between words, and the characters that count as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

#: Rules by bit: (name, the condition that fails it, over the measurements).
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("exclamations", "10 * n_exclaims > 3 * n_words"),
    ("shouting", "2 * n_capitals > word_chars"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("word_length", "word_chars < 3 * n_words or word_chars > 12 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versions of the policy: which rules reject. Both have the base rules.
BASE = BIT["few_words"] | BIT["repeated_words"]
POLICIES = {
    1: BASE | BIT["symbols"] | BIT["exclamations"] | BIT["shouting"] | BIT["repeated_lines"],
    2: BASE | BIT["symbols"] | BIT["exclamations"] | BIT["shouting"] | BIT["repeated_lines"] | BIT["word_length"],
}
CURRENT = 2


def _without(text: str, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeat_words(words: str) -> Column:
    """Words inside 3-word windows that the text has twice or more.

    The windows' 64-bit hashes are sorted with their places; neighbours of one
    hash and the same three words repeat. (Two windows that repeat could be
    missed only if a third, different one had the same 64 bits.) Their places
    in order then say how many words they cover.
    """

    def same(a: Column, b: Column) -> Column:
        alike = [F.get(words, a["i"] + k) == F.get(words, b["i"] + k) for k in range(3)]
        return (a["h"] == b["h"]) & alike[0] & alike[1] & alike[2]

    def again(x, i):
        return same(x, F.get("windows", i + 1)) | ((i > 0) & same(x, F.get("windows", F.greatest(i - 1, F.lit(0)))))

    places = F.sort_array(F.transform(F.filter("windows", lambda x, i: F.coalesce(again(x, i), F.lit(False))), lambda x: x["i"]))
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((p.cast("long") + 3).alias("end"), (a["n"] + p + 3 - F.greatest(a["end"], p.cast("long"))).alias("n")), lambda a: a["n"])
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(covered)


def _hash_at(i: Column) -> Column:
    return F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """The id (with ``carry`` the whole row, as a struct of the id's name) and what the rules go by."""
    n = F.size("words")
    places = F.sequence(F.lit(0), n - 3)
    texts = docs.select((F.struct(*every(docs)) if carry else F.col(id_col)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = texts.select("id", "text", F.array_remove(F.split(F.translate("text", SPACES, " " * len(SPACES)), " "), "").alias("words"), F.filter(F.split("text", "\n"), lambda x: F.length(F.rtrim(F.translate(x, SPACES, " " * len(SPACES)))) > 0).alias("lines"))
    windows = F.when(n >= 3, F.sort_array(F.transform(places, lambda i: F.struct(_hash_at(i).alias("h"), i.alias("i")))))
    found = parts.select("*", windows.alias("windows"))
    return found.select(
        F.col("id").alias(id_col),
        n.cast("long").alias("n_words"),
        F.length(_without("text", SPACES)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without("text", SYMBOLS))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words("words").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - F.length(_without("text", "!"))).cast("long").alias("n_exclaims"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Measurements, and ``failed``: bit i is set if rule i fails."""
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return measure(docs, id_col, text_col, carry).withColumn("failed", failed.cast("int"))


def apply_policy(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """Adds base_failed and kept."""
    return rows.withColumns({"base_failed": F.col("failed").bitwiseAND(F.lit(BASE)) != 0, "kept": F.col("failed").bitwiseAND(F.lit(BASE | POLICIES[version])) == 0})


def ablation(rows: DataFrame, version: int = CURRENT) -> DataFrame:
    """By rule of a policy: rejected (rows that it fails) and only (rows that no other rule of it fails), from the bits alone."""
    mask = POLICIES[version]
    own = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).alias("bit")) for name, bit in BIT.items() if bit & mask]))
    each = own.select("bits", "n", rules.alias("r"))
    has, alone = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    return each.groupBy("r.rule").agg(F.sum(F.when(has, F.col("n")).otherwise(0)).alias("rejected"), F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("only"))


def only_kept(docs: DataFrame, version: int = CURRENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the policy keeps, with all their columns."""
    rows = apply_policy(ledger(docs, id_col, text_col, carry=True), version)
    # as an explode, not a filter: a filter would be evaluated below the measurements, with all of them written out again
    return rows.select(F.explode(F.when(F.col("kept"), F.array(id_col)).otherwise(F.array().cast(ArrayType(docs.schema)))).alias("row")).select("row.*")


_WHITE = r"[\x20\x09-\x0D]"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w) x),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) x WHERE c > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) x GROUP BY r),
m AS (
  SELECT d.doc_id, len(w.w) AS n_words, length(regexp_replace(t, '{_WHITE}', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
    len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_distinct,
    coalesce(c.n, 0) AS n_repeat_words, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_capitals
  FROM d JOIN w USING (r) LEFT JOIN covered c USING (r)),
b AS (SELECT *, n_lines - n_distinct AS n_dup_lines FROM m),
f AS (SELECT *, {" + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES)} AS failed FROM b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed & {BASE} <> 0 AS base_failed, failed & {BASE | POLICIES[CURRENT]} = 0 AS kept, CAST(failed AS INT) AS failed FROM f
"""

_MASK = POLICIES[CURRENT]
ABLATION = f"SELECT rule, CAST(sum(CASE WHEN b & bit <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS rejected, CAST(sum(CASE WHEN b = bit THEN 1 ELSE 0 END) AS BIGINT) AS only FROM (SELECT failed & {_MASK} AS b FROM ({ORACLE}) o) x, (VALUES {', '.join(f"('{name}', {bit})" for name, bit in BIT.items() if bit & _MASK)}) r(rule, bit) GROUP BY rule"
