"""Personal data: exact patterns, and terms that give an entity away by how they occur with it.

``base_spans`` finds e-mail addresses, IP addresses, card and phone numbers.
``telling_terms`` then looks over the whole corpus. Protected are single
entities and what several of them share: the domain of addresses, the network
of IP addresses, the issuer of cards, the area of phone numbers. The
information that a term carries on one of them is log2(p(entity | term) /
p(entity)). A term that names it with a chance of at least CHANCE, over enough
documents, and is no common word, discloses it and gets spans of kind ``term``;
redaction replaces each span by its kind. A term is any run of letters or
digits outside the base spans, in lower case; its spans count in the text as it
is. Different texts are counted: exact copies count once, near copies each.

Null texts count as empty ones. Null ids pass through; repeated rows give
repeated rows; columns other than id and text are left out by ``find`` and
kept by ``redact``, whatever their names. Spans are counted in code points,
their end is exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.common import cut, every

KINDS = ["email", "ip", "card", "phone"]
#: An entity, and a term with it, must be seen in so many different documents.
SEEN = 5
#: The chance of the entity, given the term, from which the term discloses it.
CHANCE = 0.8
#: The least information of a disclosing term on its entity, in bits.
BITS = 4.0
#: Terms of at most so many rows go to every task whole; else they are joined by shuffle.
SENT = 500_000
#: Spans of at most so many texts go to every task whole.
MARKED = 100_000

#: Stands for a separator inside a number or a name; what it was before becomes another unused character.
_MARK, _OTHER = "\ue000", "\ue001"
_WORD = r"[\p{L}\p{N}]+"
_PLACES = "array<struct<kind:string,start:int,end:int>>"
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
#: Matches of one text whose places are listed at a time.
BLOCK = 256


def _marked(text: Column, before: str, separator: str, after: str) -> Column:
    """The text with single separators between two characters marked, so that one character class tells what belongs together."""
    return F.regexp_replace(F.replace(text, F.lit(_MARK), F.lit(_OTHER)), f"(?<={before}){separator}(?={after})", _MARK)


#: By kind: what a text with a match must have, how it is marked, the pattern over the marked text.
_PATTERNS = {
    "email": (lambda t: t.contains("@"), lambda t: _marked(t, "[A-Za-z0-9-]", r"\.", "[A-Za-z0-9-]"), rf"(?:\G|(?<![A-Za-z0-9._%+{_MARK}-]))[A-Za-z0-9._%+{_MARK}-]+@[A-Za-z0-9-]+{_MARK}[A-Za-z0-9{_MARK}-]+"),
    "ip": (lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda t: t, r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"),
    "card": (lambda t: t.rlike("[0-9]"), lambda t: _marked(t, "[0-9]", r"[\x20-]", "[0-9]"), rf"[0-9][0-9{_MARK}]+"),
    "phone": (lambda t: t.contains("+"), lambda t: t, r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), lambda x, i: (x.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """The condition on a match besides its pattern."""
    if kind == "ip":

        def small(part: Column) -> Column:
            plain = F.regexp_replace(part, "^0+", "")
            return (F.length(plain) < 3) | ((F.length(plain) == 3) & (plain <= "255"))

        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(_digits(value)).between(16, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _held(kind: str):
    return lambda s: _holds(kind, s["value"])


def _runs(steps: Column, at: Column, kind: str) -> Column:
    """Where the matches of some steps, from ``at`` on, start and end; and where the last one ends."""
    start = F.struct(at.alias("at"), F.array().cast(_PLACES).alias("out"))

    def step(a: Column, s: Column) -> Column:
        first, past = a["at"] + s["g"], a["at"] + s["g"] + s["h"]
        return F.struct(past.alias("at"), F.concat(a["out"], F.array(F.struct(F.lit(kind).alias("kind"), first.alias("start"), past.alias("end")))).alias("out"))

    return F.aggregate(steps, start, step)


def _matches(marked: Column, pattern: str, kind: str) -> Column:
    """kind, start, end of all matches: the lengths of what is between them and of themselves, run on.

    Lists grow by blocks of matches, so a text with very many isn't copied once for each.
    """
    hits = F.regexp_extract_all(marked, F.lit(pattern), 0)
    gaps = F.split(marked, pattern, -1)
    steps = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("g"), F.length(h).alias("h")))
    blocks = F.transform(F.array(steps), lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int")), lambda b: F.slice(all_, b * BLOCK + 1, F.lit(BLOCK))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_PLACES}>").alias("out"))

    def step(a: Column, block: Column) -> Column:
        return F.get(F.transform(F.array(_runs(block, a["at"], kind)), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(r["out"])).alias("out"))), F.lit(0))

    return F.aggregate(F.get(blocks, F.lit(0)), start, step, lambda a: F.flatten(a["out"]))


def _prepared(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, and an array of spans with their values for each kind."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = texts.select("id", "text", *[F.when(has(F.col("text")), mark(F.col("text"))).alias(f"{kind}_text") for kind, (has, mark, _) in _PATTERNS.items()])
    none = F.array().cast(_PLACES)
    spans = found.select("id", "text", *[F.when(F.col(f"{kind}_text").rlike(pattern), _matches(F.col(f"{kind}_text"), pattern, kind)).otherwise(none).alias(kind) for kind, (_, _, pattern) in _PATTERNS.items()])

    def told(s: Column) -> Column:
        value = F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), value.alias("value"))

    kept = [F.filter(F.transform(F.col(kind), told), _held(kind)) for kind in KINDS]
    return spans.select("id", "text", *[F.when(F.size(kind) > 0, k).otherwise(F.array().cast(_SPAN)).alias(kind) for kind, k in zip(KINDS, kept, strict=True)])


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, version (a hash of the text) and spans, each with its value."""
    return _prepared(docs, id_col, text_col).select("id", F.xxhash64("text").alias("version"), *KINDS)


def _blanked(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, version, spans (null if there are none) and ``plain``: the text with blanks for base spans, all else in its place."""
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    own = cut(spans.filter(F.greatest(*[F.size(kind) for kind in KINDS]) > 0).select("version", *KINDS).dropDuplicates(["version"]))
    prepared = texts.join(F.broadcast(own) if own.count() <= MARKED else own, "version", "left")
    text, start = F.col("text"), F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    spans = F.sort_array(F.concat(*[F.transform(kind, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for kind in KINDS]))

    def step(a: Column, s: Column) -> Column:
        first, past = F.greatest(a["at"], s["start"]), F.greatest(a["at"], s["end"])
        return F.struct(past.alias("at"), F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, first - a["at"]), F.repeat(F.lit(" "), past - first))).alias("out"))

    blanked = F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    return prepared.withColumn("plain", F.when(F.col("email").isNotNull(), blanked).otherwise(text))


def _terms(plain: Column) -> Column:
    """The different runs of letters or digits, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(_WORD), 0), F.lower))


def _entities(spans: Column) -> Column:
    """Hashes of what a text's spans name: each entity, and the group it belongs to."""

    def named(s: Column) -> Column:
        value = F.regexp_replace(F.lower(s["value"]), r"[\s().-]", "")
        digits = _digits(s["value"])
        group = F.when(s["kind"] == "email", F.substring_index(F.lower(s["value"]), "@", -1)).when(s["kind"] == "ip", F.substring_index(s["value"], ".", 2)).otherwise(F.substring(digits, 1, 6))
        return F.array(F.xxhash64(s["kind"], value), F.xxhash64(s["kind"], F.lit("group"), group))

    return F.array_distinct(F.flatten(F.transform(spans, named)))


def telling_terms(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """term, entity (that it discloses best), chance and bits; None if no entity is seen often enough.

    What can't reach CHANCE or BITS is left out before the whole corpus is
    counted: entities in too many documents (no chance over CHANCE then carries
    BITS), and terms with too many documents among those that have an entity.
    A document's own row stands beside those of its entities, so one count by
    term and entity, and one by term over it, need no join.
    """
    total = spans.select(F.countDistinct("version").alias("n")).first()["n"]
    every = spans.select("version", F.explode(_entities(F.concat(*KINDS))).alias("entity"))
    often = cut(every.groupBy("entity").agg(F.countDistinct("version").alias("seen")).filter((F.col("seen") >= SEEN) & (F.col("seen") * 2**BITS <= CHANCE * total)))
    n_often = often.count()
    if not n_often:
        return None
    known = F.broadcast(often) if n_often <= SENT else often
    texts = _blanked(docs, spans, id_col, text_col)
    held = texts.filter(F.col("email").isNotNull()).dropDuplicates(["version"]).select(_entities(F.concat(*KINDS)).alias("entities"), _terms(F.col("plain")).alias("terms"))
    told = held.withColumn("doc", F.monotonically_increasing_id()).select("doc", "terms", F.explode("entities").alias("entity")).join(known, "entity").select("terms", "entity")
    rows = held.select("terms", F.lit(None).cast("long").alias("entity")).unionByName(told)
    pairs = rows.select("entity", F.explode("terms").alias("term")).groupBy("term", "entity").agg(F.count("*").alias("n"))
    alone = F.sum(F.when(F.col("entity").isNull(), F.col("n")))
    best = F.max(F.when(F.col("entity").isNotNull(), F.struct(F.col("n").alias("together"), "entity")))
    likely = pairs.groupBy("term").agg(alone.alias("held"), best.alias("best")).select("term", "held", "best.*")
    both = cut(likely.filter((F.col("together") >= SEEN) & (F.col("together") >= CHANCE * F.col("held"))))
    few = F.broadcast(both) if both.count() <= SENT else both
    counted = texts.select("version", F.explode(_terms(F.col("plain"))).alias("term")).join(few.select("term"), "term").groupBy("term").agg(F.countDistinct("version").alias("n"))
    likely = counted.join(few, "term").join(known, "entity").withColumn("chance", F.col("together") / F.col("n"))
    return likely.withColumn("bits", F.log2(F.col("chance") * total / F.col("seen"))).filter((F.col("chance") >= CHANCE) & (F.col("bits") >= BITS)).select("term", "entity", "chance", "bits")


def term_spans(docs: DataFrame, spans: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, version and the spans of disclosing terms, of texts that have any."""
    names = cut(terms.select("term").distinct())
    asked = F.broadcast(names) if names.count() <= SENT else names
    texts = _blanked(docs, spans, id_col, text_col).select("id", "version", "plain")
    having = texts.select("id", "version", "plain", F.explode(_terms(F.col("plain"))).alias("term")).join(asked, "term")
    own = having.groupBy("id", "version").agg(F.first("plain").alias("plain"), F.collect_set("term").alias("terms"))
    words = own.select("id", "version", "terms", "plain", _matches(F.col("plain"), _WORD, "term").alias("all"))
    kept = F.filter("all", lambda s: F.array_contains("terms", F.lower(F.substring(F.col("plain"), s["start"] + 1, s["end"] - s["start"]))))
    return words.select("id", "version", kept.alias("term"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, version, and an array of spans for each kind and for ``term``."""
    spans = cut(base_spans(docs, id_col, text_col))
    terms = telling_terms(docs, spans, id_col, text_col)
    none = F.array().cast(_PLACES)
    if terms is None:
        return spans.withColumn("term", none)
    added = term_spans(docs, spans, terms, id_col, text_col).withColumnsRenamed({"id": "i", "version": "v", "term": "found"})
    joined = spans.join(added, spans["id"].eqNullSafe(added["i"]) & (spans["version"] == added["v"]), "left")
    return joined.select(*spans.columns, F.coalesce("found", none).alias("term"))


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of each kind, a digest of the base spans, all spans as text, and how many terms and spans there are."""
    base = F.concat_ws(",", *[F.when(F.size(kind) > 0, _listed(F.col(kind))) for kind in KINDS])
    spans = F.concat_ws(",", F.when(base != "", base), F.when(F.size("term") > 0, _listed(F.col("term"))))
    total = sum((F.size(kind) for kind in KINDS), F.size("term"))
    return found.select(F.col("id").alias(id_col), *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS], F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), F.size("term").cast("long").alias("n_term"), total.cast("long").alias("n_spans"))


def redact(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with spans replaced by their kind in brackets; where spans overlap, the first and longest counts."""
    plain = "array<struct<start:int,rest:int,kind:string>>"
    ordered = F.sort_array(F.concat(*[F.transform(kind, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("rest"), s["kind"].alias("kind"))).cast(plain) for kind in [*KINDS, "term"]]))
    marks = cut(found.select("id", "version", ordered.alias("spans")).filter(F.size("spans") > 0).dropDuplicates(["id", "version"]))
    rows = docs.select(F.struct(*every(docs)).alias("doc"))
    text = F.col("doc")[text_col]
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        fits = s["start"] >= a["at"]
        grown = F.concat(a["out"], F.array(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.struct(F.when(fits, -s["rest"]).otherwise(a["at"]).alias("at"), F.when(fits, grown).otherwise(a["out"]).alias("out"))

    clean = F.aggregate("spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    same = F.col("doc")[id_col].eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("version"))
    joined = rows.join(F.broadcast(marks) if marks.count() <= MARKED else marks, same, "left")
    return joined.select(*[F.when(F.col("spans").isNull(), text).otherwise(clean).alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])
