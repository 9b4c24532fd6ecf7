"""Document fingerprints by SimHash, and the search for near ones by permuted block tables.

Each word of the lower-cased text votes with its weight, the square of its
length up to eight characters, on the 64 bits of its hash; a bit is set if more
than half of the weight says so. Votes are summed two bits to a long, so Spark
sums 32 numbers for each text while words stream by.

``near`` finds all fingerprints within a Hamming radius of those asked: the 64
bits are cut into blocks, twice as many as bits may differ, and for every choice
of blocks that must then be equal there is a table keyed by them.

Null texts count as empty ones; an empty text's fingerprint is 0. Ids that are
null come last. Rows with equal ids are ordered by text. Other columns are left
out.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.common import cut

BITS = 64
#: Rows of one range of ids, about.
RANGE = 2_000
RANGES = 32_768


def _lanes() -> list[Column]:
    """What a word adds to the sums: lane i of the low half is bit i, of the high half bit i + 32."""
    pair = F.lit((1 << 32) | 1)
    return [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(pair) * F.col("w")).alias(f"lane{i}") for i in range(32)]


def fingerprints(rows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """The keys and ``bits``, the fingerprint as a long; the keys tell rows apart.

    No shuffle is added if rows are partitioned by some of the keys already.
    """
    spaced = F.translate(F.lower(text_col), "\t\n\x0b\x0c\r", "     ")
    words = rows.select(*keys, F.explode_outer(F.split(spaced, " ")).alias("word"))
    long = F.least(F.coalesce(F.length("word"), F.lit(0)), F.lit(8)).cast("long")
    votes = words.select(*keys, F.xxhash64("word").alias("h"), (long * long).alias("w"))
    sums = votes.groupBy(*keys).agg(F.sum("w").alias("all"), *_lanes())
    low = F.lit(0xFFFFFFFF)
    bits = None
    for i in range(32):
        for half, votes_for in ((0, F.col(f"lane{i}").bitwiseAND(low)), (32, F.shiftrightunsigned(f"lane{i}", 32))):
            place = 1 << (i + half)
            one = F.when(votes_for * 2 > F.col("all"), F.lit(place - (1 << 64) if place >> 63 else place)).otherwise(F.lit(0).cast("long"))
            bits = one if bits is None else bits.bitwiseOR(one)
    return sums.select(*keys, bits.alias("bits"))


def written(bits: str) -> Column:
    """A fingerprint as 16 hexadecimal digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def likeness(a: str, b: str) -> Column:
    """The share of equal bits."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(float(BITS))


def in_ranges(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt to ranges of ids, each range's rows followed by the next one's first (``head``), in falling order of ids.

    Only the ranges' bounds and first rows are looked at as a whole; their
    number has a bound.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = rows.count()
    parts = 1 << min(max(1, -(-n // RANGE)), RANGES).bit_length()
    # a bounded sample chooses the bounds; any bounds give the same result
    chosen = rows.filter("id is not null").select("id").filter(F.pmod(F.xxhash64("id"), F.lit(max(1, n // (32 * parts)))) == 0).groupBy("id").count()
    cuts = chosen.select("id", F.ntile(parts).over(Window.orderBy("id")).alias("t")).groupBy("t").agg(F.max("id").alias("id")).orderBy("id")
    bounds = [r["id"] for r in cuts.select("id").distinct().orderBy("id").collect()][:-1]
    steps = F.lit(0)
    if bounds:
        # how many bounds are at most the id, by halving; null ids below all
        size = len(bounds)
        told = F.array(*[F.lit(b) for b in bounds]).cast(f"array<{rows.schema['id'].dataType.simpleString()}>")
        jumps = F.array(*[F.lit(1 << k) for k in range(size.bit_length() - 1, -1, -1)])
        steps = F.aggregate(jumps, F.lit(0), lambda at, jump: F.when((at + jump <= size) & (F.get(told, at + jump - 1) <= F.col("id")), at + jump).otherwise(at))
    dealt = rows.withColumn("range", steps)
    first = dealt.groupBy("range").agg(F.max("id").alias("id"))
    order = Window.orderBy(F.desc("range"))
    tops = first.select("range", "id", F.lead("range").over(order).alias("after"), F.first("range").over(order).alias("top"))
    follows = tops.select(F.col("range").alias("before"), F.coalesce("after", "top").alias("range")).join(first, "range")
    heads = dealt.join(F.broadcast(follows), dealt["range"].eqNullSafe(follows["range"]) & dealt["id"].eqNullSafe(follows["id"])).groupBy("before").agg(F.max(F.struct(follows["id"], "text")).alias("m")).select(F.col("m.id").alias("id"), F.col("m.text").alias("text"), F.col("before").alias("range"), F.lit(True).alias("head"))
    return dealt.withColumn("head", F.lit(False)).unionByName(heads)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint, that of the text whose second half is the next document's beginning, and how near they are.

    The next document is the one before in the order of ids, the last one's is
    the first; a single document follows itself.
    """
    order = Window.partitionBy("range").orderBy("head", F.desc_nulls_last("id"), F.desc("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = in_ranges(docs, id_col, text_col).select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next"))
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 2)))"), F.expr("substring(coalesce(next, ''), 1, int(floor(length(text) / 2)))"))
    both = rows.select("range", "place", "head", "id", n.cast("long").alias("n_chars"), "text", F.when(~F.col("head"), edited).alias("edited"))
    keyed = both.select("range", "place", "head", "id", "n_chars", F.unhex(F.sha2("edited", 256)).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))).alias("v"))
    keys = ["range", "place", "head", "id", "n_chars", "sha", "kind"]
    found = fingerprints(keyed.select(*keys[:-1], "v.kind", "v.text").filter("not head or kind = 0"), keys)
    one = found.groupBy(*keys[:-1]).agg(F.max(F.when(F.col("kind") == 0, F.col("bits"))).alias("own"), F.max(F.when(F.col("kind") == 1, F.col("bits"))).alias("edited"))
    after = one.withColumn("next", F.lead("own").over(Window.partitionBy("range").orderBy("place"))).filter("not head")
    return after.select(F.col("id").alias(id_col), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), written("own").alias("fingerprint"), written("edited").alias("edited_fingerprint"), likeness("own", "edited").alias("near_edited"), likeness("own", "next").alias("near_next"))


def _tables(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """bits, t, key: each fingerprint in each of the permuted tables, keyed by the blocks that must be equal."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def signed(m: int) -> int:
        return m - (1 << 64) if m >> 63 else m

    tables = [F.struct(F.lit(k).alias("t"), F.col("bits").bitwiseAND(F.lit(signed(sum(masks[i] for i in chosen)))).alias("key")) for k, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    own = prints.select("bits").filter("bits is not null").distinct()
    return own.select("bits", F.explode(F.array(*tables)).alias("k")).select("bits", "k.t", "k.key")


def near(asked: DataFrame, prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """(a, b, distance): for each fingerprint asked all different ones at most ``radius`` bits apart; both tables have a column ``bits``.

    Equal fingerprints count once. Of ``blocks`` blocks at most ``radius`` hold
    a difference, so some choice of the others is equal: a table for each. A
    pair counts in the first table where it meets. The join is told to merge:
    before its rows are repeated for each table, either side looks small enough
    to broadcast.
    """
    blocks = blocks or max(1, 2 * radius)
    one, other = (_tables(rows, radius, blocks).withColumnRenamed("bits", name) for rows, name in ((asked, "a"), (prints, "b")))
    met = one.join(other.hint("merge"), ["t", "key"]).filter("a <> b").withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))))
    return met.filter(F.col("distance") <= radius).select("a", "b", "distance").distinct()


def near_pairs(prints: DataFrame, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """Pairs (a, b, distance) of different fingerprints, a < b, at most ``radius`` bits apart."""
    return near(prints, prints, radius, blocks).filter("a < b")


def search(docs: DataFrame, asked, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row that ``asked`` holds for, every fingerprint of the table within the radius, its own too: id, fingerprint, near, distance, n_docs."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    texts = rows.groupBy("version").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    prints = cut(fingerprints(texts, ["version", "n"]))
    queries = docs.filter(asked).select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("version")).join(prints, "version").select("id", "bits")
    counts = prints.groupBy("bits").agg(F.sum("n").alias("n_docs"))
    own = queries.select(F.col("bits").alias("a"), F.col("bits").alias("b"), F.lit(0).alias("distance")).distinct()
    found = near(queries, prints, radius).unionByName(own).join(counts.hint("merge"), F.col("b") == F.col("bits")).drop("bits")
    return queries.join(found.hint("merge"), F.col("bits") == F.col("a")).select(F.col("id").alias(id_col), written("a").alias("fingerprint"), written("b").alias("near"), F.col("distance").cast("int").alias("distance"), "n_docs")
