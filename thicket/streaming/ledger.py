"""Hook dispatch as keyed state: a claim ledger with leases, and a sliding limit of firings.

Both keep their state per key in the stream's state store, so a stream that is
restarted from its checkpoint goes on where it was. ``claims`` has its batch
twin in ``hooks.claimed``; ``limited`` is the batch twin of ``limits``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from thicket.streaming import hooks

#: A claim's lease in seconds; firings of a hook on a node in an hour.
LEASE, PER_HOUR = 60, 20
HOUR_MS = 3_600_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Claims(StatefulProcessor):
    """One winner for each hook and event.

    Rows are asks (outcome empty) and outcomes of what was fired. An ask wins
    if nothing is known and it is past the floor, or if the claim that is known
    is older than the lease; an outcome ends a claim for good. A claim whose
    lease runs out without an outcome is handed out again by a timer.
    """

    def __init__(self, floor: int, lease_ms: int):
        self.floor, self.lease = floor, lease_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.claim = handle.getValueState("claim", "fired long, outcome string")

    def _take(self, now: int) -> None:
        self.claim.update((now, "claimed"))
        self.handle.registerTimer(now + self.lease)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        asked, ended = False, None
        for part in rows:
            asked = asked or bool((part["outcome"] == "").any())
            told = part.loc[part["outcome"] != "", "outcome"]
            ended = told.iloc[-1] if len(told) else ended
        fired, outcome = self.claim.get() if self.claim.exists() else (None, None)
        if asked and (outcome is None and key[1] > self.floor or outcome == "claimed" and fired < now - self.lease):
            self._take(now)
            yield pd.DataFrame({"hook": [key[0]], "seq": [key[1]], "again": [outcome is not None]})
        if ended and self.claim.exists():
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.claim.update((now, ended))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.claim.exists() and self.claim.get()[1] == "claimed":
            self._take(timerValues.getCurrentProcessingTimeInMs())
            yield pd.DataFrame({"hook": [key[0]], "seq": [key[1]], "again": [True]})

    def close(self) -> None:
        pass


class Limits(StatefulProcessor):
    """Which asks to fire: at most so many per hook and node within the hour before; only what is let through counts."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        self.times = handle.getListState("times", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lately = [t[0] for t in self.times.get()]
        for part in rows:
            part = part.sort_values(["at_ms", "seq"])
            fires = []
            for at in part["at_ms"]:
                lately = [t for t in lately if t >= at - HOUR_MS]
                fires.append(len(lately) < self.most)
                lately += [at] * fires[-1]
            yield pd.DataFrame({"hook": part["hook"], "node_id": part["node_id"], "seq": part["seq"], "fires": fires})
        self.times.put([(int(t),) for t in lately])

    def close(self) -> None:
        pass


def claims(asks: DataFrame, floor: int = 0, lease: float = LEASE) -> DataFrame:
    """(hook, seq, again): what a stream of (hook, seq, outcome) wins; ``again`` if a claim was taken over."""
    return asks.select("hook", "seq", F.coalesce("outcome", F.lit("")).alias("outcome")).groupBy("hook", "seq").transformWithStateInPandas(Claims(floor, int(lease * 1000)), "hook string, seq long, again boolean", "Append", "ProcessingTime")


def limits(asks: DataFrame, most: int = PER_HOUR) -> DataFrame:
    """(hook, node_id, seq, fires) for a stream of (hook, node_id, seq, at_ms)."""
    return asks.select("hook", "node_id", "seq", "at_ms").groupBy("hook", "node_id").transformWithStateInPandas(Limits(most), "hook string, node_id string, seq long, fires boolean", "Append", "None")


def limited(asks: DataFrame, most: int = PER_HOUR) -> DataFrame:
    """(hook, node_id, seq, fires) for a table of (hook, node_id, seq, at_ms), decided in order of time, then seq.

    Each decision hangs on those of the hour before, so a key's asks are folded
    in order, by a stream through sorted partitions that holds ``most`` times.
    An hour without asks ends what hangs together: runs of hours in a row are
    found from the hours' counts, and each is dealt out by itself.
    """
    hour = F.floor(F.col("at_ms") / HOUR_MS)
    key = ["hook", "node_id"]
    hours = asks.select(*key, hour.alias("hour")).distinct()
    order = Window.partitionBy(*key).orderBy("hour")
    starts = hours.withColumn("new", F.coalesce((F.col("hour") - F.lag("hour").over(order) > 1).cast("int"), F.lit(1)))
    runs = starts.withColumn("run", F.sum("new").over(order)).select(*key, "hour", "run")
    dealt = asks.select(*key, "seq", "at_ms", hour.alias("hour")).join(runs, [*key, "hour"]).repartition(*key, "run").sortWithinPartitions(*key, "run", "at_ms", "seq")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, lately = None, []
        for part in parts:
            fires = []
            for hook, node, run, at in zip(part["hook"], part["node_id"], part["run"], part["at_ms"], strict=True):
                if (hook, node, run) != last:
                    last, lately = (hook, node, run), []
                lately = [t for t in lately if t >= at - HOUR_MS]
                fires.append(len(lately) < most)
                lately += [at] * fires[-1]
            yield part[["hook", "node_id", "seq"]].assign(fires=fires)

    return dealt.select(*key, "run", "seq", "at_ms").mapInPandas(fold, "hook string, node_id string, seq long, fires boolean")


def dispatch(events: DataFrame, rules: DataFrame, outcomes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, floor: int = 0, lease: float = LEASE, trigger: dict | None = None) -> StreamingQuery:
    """Fires hooks for a stream of events (event_id as their number); ``outcomes`` is a stream of (hook, seq, outcome) that ends claims.

    At least once: a batch that is run again hands its claims to the sink
    again, and a claim without an outcome comes again when its lease is over.
    So the stream has no end by itself: it runs by intervals, or one batch.
    """
    named = hooks.matched(hooks.normalised(events), rules)
    asks = named.select("hook", F.col("event_id").alias("seq"), F.lit("").alias("outcome"))
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    won = claims(asks.unionByName(outcomes.select("hook", "seq", "outcome")), floor, lease)
    return won.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def fanned_out(events: DataFrame, name: Column, subscribers: DataFrame) -> DataFrame:
    """(subscriber, event_id): events whose name and node a subscriber asked for; no names, or no node, let all pass.

    ``subscribers`` has (subscriber, events, under): configuration, a few rows that go to every task.
    """
    s = lambda c: F.col(f"s.{c}")
    asked = (F.size(s("events")) == 0) | F.array_contains(s("events"), F.col("_name"))
    inside = (s("under") == "") | (F.col("node_id") == s("under")) | F.col("node_id").startswith(F.concat(s("under"), F.lit(".")))
    return events.withColumn("_name", name).filter("_name is not null").join(F.broadcast(subscribers.select(F.struct("subscriber", "events", "under").alias("s"))), asked & inside).select(s("subscriber").alias("subscriber"), "event_id")
