"""Pulling a hub's log as a stream: pages of Parquet files, each event applied once, the state folded from what is applied.

A stream's place is which files it has read, not a clock. So nothing hangs on
the order of clocks: events with one clock may lie on two pages, and a push
that comes late, with a clock that was passed long ago, is a new file like any
other. What is pulled twice is known by its id for ever, in RocksDB by key.
The applied table is a Parquet sink that Spark commits by batches: a batch
that was broken off leaves nothing that readers see, and a stream that goes on
from its checkpoint adds each event once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from thicket.operators import replay
from thicket.operators.events import once
from thicket.operators.numbering import numbered
from thicket.streaming.ledger import ROCKS

#: Clocks whose events are numbered in one task.
CLOCKS = 10_000


def pages(spark: SparkSession, hub: str, schema: StructType | str, files: int = 1000) -> DataFrame:
    """The hub's log as a stream; a page is at most ``files`` files of it."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(hub)


def pull(log: DataFrame, applied: str, checkpoint: str, before: DataFrame | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Adds what a stream of events brings to the table ``applied``, each event id once.

    ``before`` has the ids that were applied by other ways, such as the store's
    own events. Without a trigger all that is there is pulled, page by page,
    and the stream ends.
    """
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    fresh = once(log, before).withColumn("pulled_at", F.current_timestamp())
    return fresh.writeStream.format("parquet").option("path", applied).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def ordered(applied: DataFrame) -> DataFrame:
    """The applied log with ``arrival`` numbered by clock, wall time and id: the order in which replicas agree, whatever page an event came on.

    Numbers are given by slices of the clock and added up.
    """
    slices = F.floor(F.col("lamport") / CLOCKS)
    return numbered(applied.drop("arrival"), [], ["lamport", "wall_ms", "event_id"], slices, "arrival")


def state(applied: DataFrame) -> DataFrame:
    """The nodes that the applied events make, the same in every replica that has the same events."""
    return replay.replay(ordered(applied))


def late(applied: DataFrame, page: str = "pulled_at") -> DataFrame:
    """(event_id, page, lamport, passed): events whose clock an earlier page had reached already; by a clock as cursor they would be lost.

    What pages reach is a running maximum over one row for each page.
    """
    reached = applied.groupBy(page).agg(F.max("lamport").alias("most"))
    before = reached.select(page, F.max("most").over(Window.orderBy(page).rowsBetween(Window.unboundedPreceding, -1)).alias("passed"))
    return applied.join(before, page).filter("lamport <= passed").select("event_id", page, "lamport", "passed")
