"""Hooks: which events they answer to, and a ledger in which each hook and event has one winner.

Events come with a JSON payload. Hooks are configuration, a few rows that go to
every task. Ledger functions take the ledger as a table and return it as it
then is, so a batch or ``foreachBatch`` can write it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The events that hooks know, and what can deliver them with what it must name.
EVENTS = ["comment.addressed", "status.changed", "node.created"]
ADAPTERS = {"inbox": None, "exec": ("exec", "command"), "webhook": ("webhook", "url"), "append-file": ("append-file", "path")}
HOOK = "name string, events array<string>, to_agent string, from_agent_not string, under string, status_to array<string>"
LEDGER = "hook string, seq long, fired_at timestamp, outcome string"


def checked(hooks: list[dict]) -> tuple[list[dict], list[str]]:
    """The hooks of a configuration that can work, and a warning for each that can't."""
    good: list[dict] = []
    warnings = []
    for i, h in enumerate(hooks):
        match, deliver = h.get("match") or {}, h.get("deliver") or []
        wrong = [e for e in match.get("events") or [] if e not in EVENTS]
        strange = [d for d in deliver if d not in ADAPTERS]
        lacking = [d for d in deliver if d in ADAPTERS and ADAPTERS[d] and not (h.get(ADAPTERS[d][0]) or {}).get(ADAPTERS[d][1])]
        faults = [
            (not h.get("name"), "it has no name"),
            (any(g["name"] == h.get("name") for g in good), "its name is taken"),
            (not match.get("events"), "it names no event"),
            (not deliver, "it names no way to deliver"),
            (bool(wrong), f"unknown event {wrong[:1]}"),
            (bool(strange), f"unknown way to deliver {strange[:1]}"),
            (bool(lacking), f"{lacking[:1]} lacks its setting"),
        ]
        fault = next((text for bad, text in faults if bad), None)
        if fault:
            warnings.append(f"hook {h.get('name') or i} is off: {fault}")
        else:
            good.append(h)
    return good, warnings


def table_of(spark: SparkSession, hooks: list[dict]) -> DataFrame:
    """Checked hooks as rows."""
    rows = [(h["name"], h["match"]["events"], h["match"].get("to_agent", ""), h["match"].get("from_agent_not", ""), h["match"].get("under", ""), h["match"].get("status_to", [])) for h in hooks]
    return spark.createDataFrame(rows, HOOK)


def named(events: DataFrame) -> DataFrame:
    """All events with name, to_agent and status_to; the name is null where hooks know none: other kinds, and comments without an addressee."""
    to = F.coalesce(F.get_json_object("payload", "$.to"), F.lit(""))
    op = F.col("op_type")
    name = F.when((op == "comment") & (to != ""), EVENTS[0]).when(op == "transition_status", EVENTS[1]).when(op == "create_node", EVENTS[2])
    own = {"name": name, "to_agent": F.when(op == "comment", to), "status_to": F.when(op == "transition_status", to)}
    return events.withColumns(own)


def normalised(events: DataFrame) -> DataFrame:
    """Events that hooks can answer to, named."""
    return named(events).filter("name is not null")


def matched(events: DataFrame, hooks: DataFrame) -> DataFrame:
    """(hook, event_id): every filter that a hook has must hold, and a hook doesn't answer to its own doing (``via_hook``)."""
    h = lambda c: F.col(f"h.{c}")
    lets: list[Column] = [
        ~F.coalesce(F.col("via_hook") == h("name"), F.lit(False)),
        (F.size(h("events")) == 0) | F.array_contains(h("events"), F.col("name")),
        (h("to_agent") == "") | (F.col("name") != EVENTS[0]) | (h("to_agent") == F.col("to_agent")),
        (h("from_agent_not") == "") | (h("from_agent_not") != F.col("author")),
        (h("under") == "") | (F.col("node_id") == h("under")) | F.col("node_id").startswith(F.concat(h("under"), F.lit("."))),
        (F.size(h("status_to")) == 0) | F.coalesce(F.array_contains(h("status_to"), F.col("status_to")), F.lit(False)),
    ]
    whole = lets[0]
    for one in lets[1:]:
        whole = whole & one
    return events.join(F.broadcast(hooks.select(F.struct("*").alias("h"))), whole).select(h("name").alias("hook"), "event_id")


def claimed(asked: DataFrame, ledger: DataFrame, floor: int, now: str, lease: int = 60) -> DataFrame:
    """(hook, seq) that a pass wins: never claimed and past the floor, or claimed longer ago than the lease (in seconds) without an outcome."""
    there = ledger.select("hook", "seq", "fired_at", "outcome")
    old = (F.col("outcome") == "claimed") & (F.col("fired_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {lease} SECONDS"))
    fresh = F.col("outcome").isNull() & (F.col("seq") > floor)
    return asked.select("hook", "seq").distinct().join(there, ["hook", "seq"], "left").filter(old | fresh).select("hook", "seq")


def recorded(ledger: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """The ledger with new outcomes: claims that were won, or what became of them. ``outcomes`` has (hook, seq, outcome), one for each."""
    new = outcomes.select("hook", "seq", F.lit(now).cast("timestamp").alias("fired_at"), "outcome")
    return ledger.join(new, ["hook", "seq"], "left_anti").select("hook", "seq", "fired_at", "outcome").unionByName(new)


def stale(ledger: DataFrame, now: str, lease: int = 60) -> DataFrame:
    """Claims whose lease has run out, in order."""
    return ledger.filter((F.col("outcome") == "claimed") & (F.col("fired_at") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {lease} SECONDS"))).select("hook", "seq").orderBy("seq", "hook")


def floor_after(ledger: DataFrame, floor: int, target: int) -> DataFrame:
    """One row: the scan floor moved to ``target``, but under the lowest open claim, and never back."""
    lowest = F.min(F.when(F.col("outcome") == "claimed", F.col("seq")))
    return ledger.agg(F.greatest(F.lit(floor), F.least(F.lit(target), lowest - 1)).cast("long").alias("floor"))


def pruned(ledger: DataFrame, floor: int) -> DataFrame:
    """The ledger without what has ended at or below the floor."""
    return ledger.filter(f"outcome = 'claimed' or seq > {int(floor)}")
