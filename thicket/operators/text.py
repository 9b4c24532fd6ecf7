"""Full-text search over postings, context of a node with a token budget, and briefings."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.ids import node_type, tokens
from thicket.operators.hierarchy import inherited
from thicket.operators.listing import live

#: Places between the columns of a row.
GAP = 1 << 24
_WORD = r"[\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), 0)


@dataclass(frozen=True)
class Term:
    """One condition of a search: a word, a phrase of several, or a word's beginning; in one column or any; there or not there."""

    words: str
    prefix: bool = False
    without: bool = False
    column: str = ""

    def tokens(self) -> list[str]:
        return re.findall(r"[^\W_]+", self.words.lower())


def postings(rows: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """(term, id, column, places): where each word stands in each text. Stored sorted by term, a search reads only its words.

    A text's words are grouped inside its row, so nothing is shuffled. Columns
    follow each other at a distance that no phrase crosses.
    """
    each = [rows.select(F.col(id_col).alias("id"), F.lit(c).alias("column"), F.inline(_grouped(terms(F.coalesce(F.col(c), F.lit(""))), k * GAP))) for k, c in enumerate(columns)]
    return reduce(DataFrame.unionByName, each).select("term", "id", "column", "places")


def _grouped(words: Column, first: int) -> Column:
    """(term, places) of a text's words: sorted with their places, then cut where the word changes."""
    one = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  # names a value that is used several times
    sorted_ = F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("term"), (i + first).alias("place"))))
    changes = lambda s: F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1)["term"] != F.get(s, i - 2)["term"]))
    places = lambda s, i, next_: F.transform(F.slice(s, i, next_ - i), lambda x: x["place"])
    cut = lambda s, at: F.transform(at, lambda i, k: F.struct(F.get(s, i - 1)["term"].alias("term"), places(s, i, F.coalesce(F.get(at, k + 1), F.size(s) + 1)).alias("places")))
    none = F.array().cast("array<struct<term:string,places:array<int>>>")
    return one(sorted_, lambda s: F.when(F.size(s) > 0, one(changes(s), lambda at: cut(s, at))).otherwise(none))


def lengths(rows: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """(id, n): how many words each row's columns have."""
    return rows.select(F.col(id_col).alias("id"), sum((F.regexp_count(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(_WORD)) for c in columns), F.lit(0)).alias("n"))


def upkept(index: DataFrame, sizes: DataFrame, changed: DataFrame, gone: DataFrame, columns: list[str], id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The index and its lengths after some rows were written anew (or for the first time) and others deleted (``gone`` has their ids).

    What the base holds of touched rows counts no more; only changed rows are
    read for words. A search over the result reads base and delta; written
    out, it is the compacted base.
    """
    touched = changed.select(F.col(id_col).alias("id")).union(gone.select(F.col(id_col).alias("id"))).distinct()
    fresh = changed.join(gone.select(id_col), id_col, "left_anti")
    return index.join(touched, "id", "left_anti").select(*index.columns).unionByName(postings(fresh, columns, id_col)), sizes.join(touched, "id", "left_anti").select(*sizes.columns).unionByName(lengths(fresh, columns, id_col))


def index_faults(index: DataFrame, rows: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """(id, fault) where an index doesn't hold what the texts say: missing, surplus or stale.

    A row's postings are told by a sum of their hashes, which needs no order
    and combines before the shuffle.
    """
    told = lambda p: p.groupBy("id").agg(F.sum(F.xxhash64("term", "column", "places").cast("decimal(38,0)")).alias("sum"))
    here, want = told(index).withColumnRenamed("sum", "here"), told(postings(rows, columns, id_col)).withColumnRenamed("sum", "want")
    fault = F.when(F.col("here").isNull(), "missing").when(F.col("want").isNull(), "surplus").when(F.col("here") != F.col("want"), "stale")
    return here.join(want, "id", "full").select("id", fault.alias("fault")).filter("fault is not null")


def search(index: DataFrame, sizes: DataFrame, asked: list[list[Term]], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id and BM25 score of the rows that meet all terms of one of the alternatives; equal scores go by id when paged.

    Only the postings of the words asked for are read; they meet by row, so a
    common word's postings spread over all tasks.
    """
    if not asked or any(not t.tokens() for part in asked for t in part):
        raise ValueError("a search needs words")
    if any(all(t.without for t in part) for part in asked):
        raise ValueError("each alternative needs a word that must be there")
    if any(t.prefix and len(t.tokens()) > 1 for part in asked for t in part):
        raise ValueError("a beginning is of one word")
    every = list(dict.fromkeys(t for part in asked for t in part))
    exact = sorted({w for t in every if not t.prefix or not t.without for w in t.tokens()})
    scoring = sorted({w for t in every if not t.without for w in t.tokens()})
    wanted = F.col("term").isin(exact)
    for t in every:
        wanted = wanted | F.col("term").startswith(t.tokens()[0]) if t.prefix else wanted
    rows = index.filter(wanted)
    of = lambda t: F.lit(True) if not t.column else F.col("column") == t.column
    parts = {f"p{i}_{k}": F.flatten(F.collect_list(F.when((F.col("term") == w) & of(t), F.col("places")))) for i, t in enumerate(every) if not t.prefix for k, w in enumerate(t.tokens())}
    begins = {f"q{i}": F.coalesce(F.bool_or(F.col("term").startswith(t.tokens()[0]) & of(t)), F.lit(False)) for i, t in enumerate(every) if t.prefix}
    counts = {f"tf{i}": F.coalesce(F.sum(F.when(F.col("term") == w, F.size("places"))), F.lit(0)) for i, w in enumerate(scoring)}
    found = rows.groupBy("id").agg(*[c.alias(n) for n, c in (parts | begins | counts).items()])

    def holds(i: int, t: Term):
        if t.prefix:
            hit = F.col(f"q{i}")
        else:
            later = [(k, F.col(f"p{i}_{k}")) for k in range(1, len(t.tokens()))]
            hit = F.exists(f"p{i}_0", lambda at: reduce(lambda a, x: a & F.array_contains(x[1], at + x[0]), later, F.lit(True)))
        return ~hit if t.without else hit

    test = {t: holds(i, t) for i, t in enumerate(every)}
    met = reduce(lambda a, x: a | x, [reduce(lambda a, x: a & x, [test[t] for t in part]) for part in asked])
    corpus = sizes.agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).join(found.agg(*[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(scoring))]))
    score = F.lit(0.0)
    for i in range(len(scoring)):
        idf = F.log(1 + (F.col("docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (k1 + 1) / (F.col(f"tf{i}") + k1 * (1 - b + b * F.col("n") / F.greatest("mean", F.lit(1.0))))
    return found.filter(met).join(sizes, "id").join(F.broadcast(corpus)).select("id", F.round(score, 6).alias("score"))


def best(found: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of a search, the best first."""
    return found.orderBy(F.desc("score"), "id").offset(offset).limit(limit)


def _title(id_col: str) -> Column:
    return F.concat_ws(" ", F.col(id_col), F.col("title"))


def context(nodes: DataFrame, chains: DataFrame) -> DataFrame:
    """id and its titles from the root down, one line each. ``chains`` has (id, ancestor_id, level)."""
    line = F.struct("level", _title("ancestor_id").alias("line"))
    named = chains.join(live(nodes).select(F.col("id").alias("ancestor_id"), "title"), "ancestor_id")
    return named.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n").alias("prompt"))


def contexts(nodes: DataFrame) -> DataFrame:
    """``context`` of every node whose chain is whole; what is above a node comes from its parent."""
    lines = inherited(live(nodes).select("id", _title("id").alias("line")), "line")
    return lines.select("id", F.array_join(F.concat("above", F.array("line")), "\n").alias("prompt"))


#: Fixed value: what stands between the sections of a prompt.
RULE = "\n\n---\n\n"


def sections(nodes: DataFrame) -> DataFrame:
    """(id, title, full): a node's part of a prompt, with its heading alone and with its prompt, whose author is told from an agent, and its open annotations.

    ``nodes`` may lack prompt, creator and annotations (author, text, resolved).
    """
    own = lambda c: F.coalesce(c, F.lit("")) if c in nodes.columns else F.lit("")
    heading = F.concat(F.lit("## "), F.upper(node_type(F.col("depth"))), F.lit(" "), F.col("id"), F.lit(": "), F.coalesce("title", F.lit("")), F.lit("\n"))
    by = F.when(own("creator").startswith("agent-"), "[LLM-GENERATED]").otherwise("[HUMAN-AUTHORED]")
    prompt = F.when(own("prompt") != "", F.concat(F.lit("\n"), by, F.lit("\n"), own("prompt"), F.lit("\n"))).otherwise("")
    notes = F.lit("")
    if "annotations" in nodes.columns:
        open_ = F.filter(F.coalesce("annotations", F.array().cast(nodes.schema["annotations"].dataType)), lambda a: ~F.coalesce(a["resolved"], F.lit(False)))
        notes = F.array_join(F.transform(open_, lambda a: F.concat(F.lit("\n[ANNOTATION by "), a["author"], F.lit("]\n"), a["text"], F.lit("\n"))), "")
    return live(nodes).select("id", heading.alias("title"), F.concat(heading, prompt, notes).alias("full"))


def prompts(nodes: DataFrame, chains: DataFrame, blockers: DataFrame | None = None, budget: int = 0) -> DataFrame:
    """id and its prompt: the sections from the root down to it, and what blocks it; with a budget of tokens, cut to it and without blockers.

    ``chains`` has (id, ancestor_id, level), ``blockers`` (to_id, from_id).
    A chain's sections are as many as its levels, so they fit one row.
    """
    parts = sections(nodes).withColumnRenamed("id", "ancestor_id")
    found = chains.join(parts, "ancestor_id").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("level", "title", "full"))), lambda x: F.struct(x["title"].alias("title"), x["full"].alias("full"))).alias("parts"))
    if budget > 0:
        return found.select("id", truncated(F.col("parts"), budget).alias("prompt"))
    whole = F.array_join(F.transform("parts", lambda x: x["full"]), RULE)
    if blockers is None:
        return found.select("id", whole.alias("prompt"))
    return found.join(_held(blockers), "id", "left").select("id", F.concat(whole, _blocked()).alias("prompt"))


def all_prompts(nodes: DataFrame, blockers: DataFrame | None = None, budget: int = 0) -> DataFrame:
    """``prompts`` of every node whose chain is whole; what is above a node comes from its parent.

    What blocks a node is met by its own section, before the long texts are put together.
    """
    own = sections(nodes)
    rest = F.expr("substring(full, length(title) + 1)").alias("rest")
    own = own.select("id", F.struct("title", rest).alias("part") if budget > 0 else F.col("full").alias("part"))
    if blockers is not None and budget <= 0:
        own = own.join(_held(blockers), "id", "left")
    found = inherited(own, "part").withColumn("parts", F.concat("above", F.array("part")))
    if budget > 0:
        parts = F.transform("parts", lambda x: F.struct(x["title"].alias("title"), F.concat(x["title"], x["rest"]).alias("full")))
        return found.select("id", parts.alias("parts")).select("id", truncated(F.col("parts"), budget).alias("prompt"))
    text = F.array_join("parts", RULE)
    return found.select("id", (text if blockers is None else F.concat(text, _blocked())).alias("prompt"))


def _held(blockers: DataFrame) -> DataFrame:
    return blockers.groupBy(F.col("to_id").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("from_id")), lambda b: F.concat(F.lit("- "), b, F.lit(" blocks this node\n"))), "").alias("held"))


def _blocked() -> Column:
    return F.when(F.col("held").isNotNull(), F.concat(F.lit(RULE + "## Blocking Dependencies\n"), "held")).otherwise("")


def truncated(sections: Column, budget: int) -> Column:
    """A prompt of sections (full, title), root first, cut to a budget of tokens.

    The last two stay whole. From the root on, each other one comes in full if
    that still fits, else by its title, else not at all; a note at the end
    says how many are left out.
    """
    n = F.size(sections)
    last = F.slice(sections, F.greatest(n - 1, F.lit(1)), 2)
    kept = F.aggregate(last, F.lit(0).cast("long"), lambda a, s: a + tokens(s["full"]))
    start = F.struct(kept.alias("used"), F.array().cast("array<string>").alias("out"), F.lit(0).alias("omitted"))

    def step(a: Column, s: Column) -> Column:
        full, title = tokens(s["full"]), tokens(s["title"])
        whole, name = a["used"] + full <= budget, a["used"] + title <= budget
        text = F.when(whole, s["full"]).when(name, s["title"])
        return F.struct((a["used"] + F.when(whole, full).when(name, title).otherwise(0)).alias("used"), F.when(text.isNotNull(), F.concat(a["out"], F.array(text))).otherwise(a["out"]).alias("out"), (a["omitted"] + F.when(text.isNull(), 1).otherwise(0)).alias("omitted"))

    def finish(a: Column) -> Column:
        body = F.array_join(F.concat(a["out"], F.transform(last, lambda s: s["full"])), RULE)
        note = F.concat(F.lit("\n\n[TRUNCATED: "), a["omitted"].cast("string"), F.lit(" ancestor prompts omitted due to token budget]"))
        return F.concat(body, F.when(a["omitted"] > 0, note).otherwise(""))

    return F.aggregate(F.slice(sections, 1, F.greatest(n - 2, F.lit(0))), start, step, finish)


def briefing(nodes: DataFrame, fields: list[str]) -> DataFrame:
    """A block of text for each node: a rule, then its fields in order; empty ones are left out, long ones get lines of their own."""
    parts = []
    for f in fields:
        v = F.col(f).cast("string")
        parts.append(F.when(v != "", F.when(v.contains("\n"), F.concat(F.lit(f"{f}:\n"), v)).otherwise(F.concat(F.lit(f"{f}: "), v))))
    return nodes.select("id", F.concat_ws("\n", F.lit("=" * 80), *parts).alias("briefing"))
