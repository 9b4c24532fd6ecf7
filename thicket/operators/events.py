"""The event log: validation, last-writer-wins, replay, conflicts, registry and duplicates, all set-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.clocks import concurrent
from thicket.functions.ids import project
from thicket.operators.numbering import running

#: The kinds of events, and the limits a hub sets.
OPS = ["create_node", "update_field", "transition_status", "claim", "unclaim", "defer", "comment", "link_dep", "unlink_dep", "delete", "set_acceptance", "set_prompt"]
SENT_STATES = ["pending", "pushed", "applied", "conflicted"]
PAYLOAD_BYTES, PAYLOAD_DEPTH, CLOCK_ENTRIES, NUMBERS_BELOW, AHEAD_HOURS, OLD_DAYS = 64 * 1024, 10, 100, 2**53, 24, 30


def sanitised_author(name: Column) -> Column:
    """The name if it is of the plain form, else in lower case with dashes for blanks and dots, else ``cli``."""
    form = "^[a-z0-9_-]{1,64}$"
    plain = F.regexp_replace(F.lower(name), "[ .]", "-")
    return F.when(name.rlike(form), name).when(plain.rlike(form), plain).otherwise("cli")


def json_depth(text: Column) -> Column:
    """How deep brackets nest outside strings.

    Strings go first; what is left of the text is its brackets, whose running
    sum is folded in one pass.
    """
    brackets = F.regexp_replace(F.regexp_replace(text, r'"(?:[^"\\]|\\.)*+"', ""), r"[^\[\]{}]", "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    step = lambda a, c: F.struct((a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("now"), F.greatest(a["most"], a["now"] + F.when(c.isin("[", "{"), 1).otherwise(-1)).alias("most"))
    return F.aggregate(F.filter(F.split(brackets, ""), lambda c: c != ""), start, step, lambda a: a["most"])


def _rules(columns: list[str], now_ms: int) -> list[tuple[str, Column]]:
    """What makes an event wrong, in the order in which it is looked at; rules on columns that aren't there fall away."""
    c = F.col
    outside = lambda name: F.exists(F.map_values(name), lambda v: (v < 0) | (v >= NUMBERS_BELOW))
    rules = [
        ("event_id", "event_id", F.coalesce(c("event_id").cast("string"), F.lit("")) == ""),
        ("op_type", "op_type", ~c("op_type").isin(OPS)),
        ("sync_status", "sync_status", (c("sync_status") != "") & ~c("sync_status").isin(SENT_STATES)),
        ("node_id", "node_id", F.coalesce("node_id", F.lit("")) == ""),
        ("project_prefix", "node_id", ~project(c("node_id")).rlike("^[A-Z][A-Z0-9_-]{0,19}$")),
        ("author", "author", ~c("author").rlike("^[a-z0-9_-]{1,64}$")),
        ("machine", "machine", ~c("machine").rlike("^[a-f0-9]{16}$")),
        ("wall_clock", "wall_ms", c("wall_ms") < 0),
        ("lamport", "lamport", c("lamport") < 0),
        ("payload", "payload", F.coalesce("payload", F.lit("")) == ""),
        ("clock", "clock", c("clock").isNull()),
        ("payload_bytes", "payload", F.octet_length("payload") > PAYLOAD_BYTES),
        ("payload_depth", "payload", json_depth(c("payload")) > PAYLOAD_DEPTH),
        ("lamport_limit", "lamport", c("lamport") >= NUMBERS_BELOW),
        ("clock_entries", "clock", F.size("clock") > CLOCK_ENTRIES),
        ("clock_value", "clock", outside("clock")),
        ("future", "wall_ms", c("wall_ms") > now_ms + AHEAD_HOURS * 3_600_000),
    ]
    wrong = {"op_type", "project_prefix", "author", "machine", "wall_clock", "lamport"}  # if the value is missing
    return [(name, F.coalesce(test, F.lit(name in wrong))) for name, column, test in rules if column in columns]


def violations(events: DataFrame, now_ms: int) -> DataFrame:
    """event_id, all faults in order, and whether its time is old, which is but a warning; events with neither don't show."""
    found = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in _rules(events.columns, now_ms)]))
    old = F.coalesce(F.col("wall_ms") < now_ms - OLD_DAYS * 86_400_000, F.lit(False))
    return events.select("event_id", F.array_join(found, ",").alias("faults"), old.alias("stale")).filter("faults <> '' or stale")


def batch_verdicts(events: DataFrame, now_ms: int, batch: str = "batch") -> DataFrame:
    """(batch, accepted, event_id, fault): a batch with a faulty event is refused whole; the first such event by arrival, and its first fault, say why."""
    faults = [F.when(test, F.lit(name)) for name, test in _rules(events.columns, now_ms)]
    each = events.select(batch, "arrival", "event_id", F.coalesce(*faults).alias("fault"))
    first = F.min(F.when(F.col("fault").isNotNull(), F.struct("arrival", "event_id", "fault")))
    return each.groupBy(batch).agg(first.alias("f")).select(batch, F.col("f").isNull().alias("accepted"), "f.event_id", "f.fault")


#: Positions of an author's events that are counted in one task.
POSITIONS = 100_000


def _last_writer(keys: list[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(F.desc("lamport"), F.desc("wall_ms"), F.asc("machine"), F.asc("arrival"))


def field_writes(events: DataFrame) -> DataFrame:
    """Writes of fields with their rank by clock, wall time, smallest machine hash, then arrival; the first wins."""
    writes = events.filter("op_type = 'update_field'")
    return writes.withColumn("rank", F.row_number().over(_last_writer(["node_id", "op_type", "field_name"])))


def lww_winners(events: DataFrame) -> DataFrame:
    """One row for each node and field. A max over a struct: it combines before the shuffle, so hot nodes don't gather."""
    writes = events.filter("op_type = 'update_field'")
    # the smallest hash wins a tie: its digits' complement is largest
    order = F.struct("lamport", "wall_ms", F.translate("machine", "0123456789abcdef", "fedcba9876543210").alias("m"), (-F.col("arrival")).alias("a"), "event_id", "value")
    return writes.groupBy("node_id", "field_name").agg(F.max(order).alias("w")).select("node_id", "field_name", "w.event_id", "w.value")


def lww_losers(events: DataFrame) -> DataFrame:
    writes = events.filter("op_type = 'update_field'")
    return writes.join(lww_winners(events).select("event_id"), "event_id", "left_anti")


def once(events: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """Each event id once, without those applied before."""
    fresh = events.dropDuplicates(["event_id"])
    return fresh.join(applied.select("event_id"), "event_id", "left_anti") if applied is not None else fresh


def replay(events: DataFrame) -> DataFrame:
    """A summary of logs without payloads: fields by last writer, claims and completions by last arrival, comments counted.

    It knows no other kinds of events; ``thicket.operators.replay`` applies all of them from their payloads.
    """
    log = once(events)
    first = log.filter("op_type = 'create_node'").groupBy("node_id").agg(F.min("arrival").alias("created"))
    later = log.join(first, "node_id").filter("arrival >= created")
    last = later.groupBy("node_id").agg(
        F.max_by(F.col("author"), F.when(F.col("op_type") == "claim", F.col("arrival"))).alias("assignee"),
        F.max(F.when(F.col("op_type").isin("claim", "transition_status"), F.struct("arrival", F.when(F.col("op_type") == "claim", "in_progress").otherwise("done").alias("status")))).alias("s"),
        F.count_if(F.col("op_type") == "comment").alias("comments"),
        F.max("lamport").alias("lamport"),
    )
    fields = lww_winners(later).groupBy("node_id").pivot("field_name", ["title", "description", "prompt", "priority"]).agg(F.first("value"))
    return last.join(fields, "node_id", "left").select("node_id", "assignee", F.coalesce("s.status", F.lit("open")).alias("status"), "comments", "lamport", "title", "description", "prompt", "priority")


def author_clocks(events: DataFrame) -> DataFrame:
    """Per node the merged vector clock, as rows: the highest clock of each author."""
    return events.groupBy("node_id", "author").agg(F.max("lamport").alias("clock"))


def concurrent_pairs(events: DataFrame, same_field: bool = False) -> DataFrame:
    """Pairs of field writes of a node, neither of whose clocks includes the other; ``events`` has a column ``clock``."""
    own = events.filter("op_type = 'update_field'")
    a, b = (own.select("node_id", F.col("event_id").alias(f"{x}_id"), F.col("clock").alias(f"{x}_clock"), F.col("field_name").alias(f"{x}_field")) for x in "ab")
    met = a.join(b, "node_id").filter("a_id < b_id")
    return (met.filter("a_field = b_field") if same_field else met).filter(concurrent(F.col("a_clock"), F.col("b_clock"))).select("node_id", "a_id", "b_id")


def concurrent_counts(events: DataFrame) -> DataFrame:
    """(node_id, event_id, includes, included_by, concurrent): of the other field writes of its node, how many an event's clock includes, how many include it, and how many do neither.

    ``events`` has node_id, event_id, author and clock, the author's own entry
    being the event's position among theirs; a clock that includes an event
    has an entry for its author at or past that position. So both counts are
    running counts along each author's positions: of events up to an entry,
    and of entries from a position on. No pair is made, and positions are
    counted slice by slice, so a node that holds a third of all events spreads.
    """
    own = events.select("node_id", "event_id", "author", F.try_element_at("clock", F.col("author")).alias("at"), "clock")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    points = own.select("node_id", "event_id", "author", "at", one.alias("event"), none.alias("entry"))
    entries = own.select("node_id", "event_id", F.explode("clock").alias("author", "at")).select("node_id", "event_id", "author", "at", none.alias("event"), one.alias("entry"))
    # events stand before entries of the same position when events are counted, after them when entries are
    both = points.unionByName(entries)
    piece = F.floor(F.col("at") / POSITIONS)
    up = running(both, ["node_id", "author"], ["at", "entry"], piece, "event", "seen").filter("entry = 1").groupBy("node_id", "event_id").agg((F.sum("seen") - 1).alias("includes"))
    down = running(both.withColumn("back", -F.col("at")), ["node_id", "author"], ["back", "event"], -piece, "entry", "seen").filter("event = 1").select("node_id", "event_id", (F.col("seen") - 1).alias("included_by"))
    total = own.groupBy("node_id").agg((F.count("*") - 1).alias("others"))
    met = up.join(down, ["node_id", "event_id"]).join(total, "node_id")
    return met.select("node_id", "event_id", "includes", "included_by", (F.col("others") - F.col("includes") - F.col("included_by")).alias("concurrent"))


def registry(creates: DataFrame) -> DataFrame:
    """What becomes of each create: free (first on its path), noop (same uid as the first), else renumber."""
    first = creates.groupBy("node_id").agg(F.min(F.struct("arrival", "uid")).alias("f"))
    outcome = F.when(F.col("arrival") == F.col("f.arrival"), "free").when(F.col("uid") == F.col("f.uid"), "noop").otherwise("renumber")
    return creates.join(first, "node_id").select("event_id", "node_id", outcome.alias("outcome"))


def duplicate_losers(creates: DataFrame) -> DataFrame:
    """Of nodes that hold one number, all but the first: (node_id, uid, event_id, winner). One event stands for each uid."""
    each = creates.groupBy("node_id", "uid").agg(F.min("event_id").alias("event_id"))
    first = each.groupBy("node_id").agg(F.min("event_id").alias("winner"))
    return each.join(first, "node_id").filter("event_id <> winner").select("node_id", "uid", "event_id", "winner")


def swept(creates: DataFrame, remaps: DataFrame) -> DataFrame:
    """The duplicate losers that no earlier sweep has recorded in ``remaps`` (uid): what a sweep adds to it, and what a preview counts.

    A second sweep finds nothing more.
    """
    return duplicate_losers(creates).join(remaps.select("uid"), "uid", "left_anti").select("node_id", "uid", "event_id", "winner")


def version_gate(clients: DataFrame, least: tuple[int, int, int], now: str, days: int = 30) -> DataFrame:
    """project, ok: all clients seen lately have at least the version; false if none was seen. ``clients`` has (project, version, seen)."""
    from thicket.functions.ids import semver

    lately = F.col("seen") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    new = semver(F.col("version")) >= semver(F.lit(".".join(map(str, least))))
    return clients.groupBy("project").agg(((F.count_if(lately) > 0) & (F.count_if(lately & ~F.coalesce(new, F.lit(False))) == 0)).alias("ok"))


def first_event(events: DataFrame) -> DataFrame:
    """Per node the first event by clock and id, and its hash: histories that differ there have diverged."""
    first = events.groupBy("node_id").agg(F.min(F.struct("lamport", "event_id", "op_type", "author")).alias("f"))
    return first.select("node_id", F.col("f.event_id").alias("event_id"), F.sha2(F.concat_ws("|", "node_id", "f.lamport", "f.event_id", "f.op_type", "f.author"), 256).alias("hash"))


def backfill_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """How many events of each kind the present nodes and edges stand for."""
    live = nodes.filter("deleted_at is null")
    kinds = F.explode(F.array_compact(F.array(F.lit("create_node"), F.when(F.col("status") != "open", F.lit("transition_status")), F.when(F.col("assignee").isNotNull(), F.lit("claim")))))
    own = live.select(kinds.alias("kind")).union(edges.select(F.lit("link_dep")))
    return own.groupBy("kind").agg(F.count("*").alias("n"))


def duplicate_uids(nodes: DataFrame) -> DataFrame:
    return nodes.filter("uid is not null and uid <> ''").groupBy("uid").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def uid_conflicts(incoming: DataFrame, local: DataFrame) -> DataFrame:
    """(id, kind): a known uid at another path, or a taken path with another uid."""
    by_uid = incoming.select("id", "uid").join(local.select(F.col("id").alias("there"), "uid"), "uid").filter("id <> there").select("id", F.lit("moved").alias("kind"))
    by_id = incoming.select("id", "uid").join(local.select("id", F.col("uid").alias("own")), "id").filter("uid <> own").select("id", F.lit("taken").alias("kind"))
    return by_uid.union(by_id).distinct()


def free_numbers(taken: DataFrame, wanted: DataFrame) -> DataFrame:
    """(parent_id, id, seq): each wanted child gets the lowest number free under its parent, in order of ids.

    Free numbers are the taken ones' gaps and what follows them, ranked within
    each parent; at most as many are looked at as are wanted.
    """
    used = taken.select("parent_id", "seq").distinct()
    n = wanted.groupBy("parent_id").agg(F.count("*").alias("n"))
    limits = n.join(used.groupBy("parent_id").agg(F.count("*").alias("used")), "parent_id", "left").select("parent_id", "n", (F.col("n") + F.coalesce("used", F.lit(0))).alias("most"))
    numbers = limits.select("parent_id", "n", F.explode(F.sequence(F.lit(1).cast("long"), "most")).alias("seq")).join(used, ["parent_id", "seq"], "left_anti")
    free = numbers.withColumn("k", F.row_number().over(Window.partitionBy("parent_id").orderBy("seq"))).filter("k <= n")
    own = wanted.select("parent_id", "id", F.row_number().over(Window.partitionBy("parent_id").orderBy("id")).alias("k"))
    return own.join(free, ["parent_id", "k"]).select("parent_id", "id", "seq")
