"""Chat formatting: logged snapshots of growing conversations collapse into the longest ones.

A turn's hash runs on over the conversation, so a conversation's last hash
stands for all of it. A conversation is dropped if its last hash is an earlier
turn's hash of a longer one: it's a snapshot of it. Of equal conversations the
one with the smallest id stays. What stays is rendered as one text.

Turns are ordered by number (nulls first), then by a digest of role (with its length) and text;
repeated rows count once. Null roles and texts count as empty. Rows without a
conversation id belong to none and are left out, as are other columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_HASH = ["h0", "h1", "h2", "h3"]


def turns(log: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    rows = log.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.filter("conv_id is not null").withColumn("digest", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, place, n_turns and the hash of all turns up to that place.

    The hash is four sums of 32-bit halves of place-salted hashes: they can be
    run on turn by turn, and don't overflow.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    placed = rows.select("conv_id", "turn", "digest").distinct().withColumn("place", F.row_number().over(order))
    a, b = F.xxhash64("place", "digest"), F.xxhash64("digest", "place", F.lit("b"))
    low = F.lit(0xFFFFFFFF)
    halves = [a.bitwiseAND(low), F.shiftrightunsigned(a, 32), b.bitwiseAND(low), F.shiftrightunsigned(b, 32)]
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select("conv_id", "place", F.count("*").over(Window.partitionBy("conv_id")).alias("n_turns"), *[F.sum(h).over(running).alias(name) for h, name in zip(halves, _HASH, strict=True)])


def maximal(rows: DataFrame) -> DataFrame:
    """conv_id, n_turns and n_logged (equal conversations in the log) of those that no longer one begins with."""
    steps = prefixes(rows)
    inner = steps.filter("place < n_turns").select(F.col("place").alias("n_turns"), *_HASH).distinct()
    whole = steps.filter("place = n_turns").groupBy("n_turns", *_HASH).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    return whole.join(inner, ["n_turns", *_HASH], "left_anti").select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), "n_logged")


def render(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """A text for each kept conversation, of its turns between marks."""
    told = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    own = rows.join(kept, "conv_id").groupBy("conv_id", "n_turns", "n_logged")
    ordered = F.array_distinct(F.sort_array(F.collect_list(F.struct("turn", "digest", told.alias("told")))))
    return own.agg(F.array_join(F.transform(ordered, lambda x: x["told"]), "").alias("rendered"))


def format_chats(log: DataFrame, **columns: str) -> DataFrame:
    rows = turns(log, **columns)
    return render(rows, maximal(rows))


ORACLE = """
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n,
         md5(string_agg(d, ',') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d)),
whole AS (SELECT n, h, min(conv_id) AS conv_id, count(*) AS n_logged FROM p WHERE place = n GROUP BY n, h),
kept AS (SELECT * FROM whole WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n AND p.place = whole.n AND p.h = whole.h))
SELECT k.conv_id, CAST(k.n AS BIGINT) AS n_turns, CAST(k.n_logged AS BIGINT) AS n_logged,
       string_agg('<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10), '' ORDER BY t.turn NULLS FIRST, t.d) AS rendered
FROM kept k JOIN t USING (conv_id) GROUP BY ALL
"""
