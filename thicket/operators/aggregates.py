"""Counts, weighted means and integrity sums over nodes, sessions and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.ids import STATUSES
from thicket.operators.listing import live


def stats_by(nodes: DataFrame, key: str) -> DataFrame:
    """Live nodes by a column, keys as text, nulls dropped."""
    return live(nodes).filter(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n"))


def weighted(progress: Column, weight: Column) -> Column:
    return F.coalesce(F.sum(progress * weight) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.0))


def weighted_progress(nodes: DataFrame) -> DataFrame:
    """The store's number: over all live nodes, parents and cancelled ones included."""
    return live(nodes).agg(F.count("*").alias("total"), F.round(weighted(F.col("progress"), F.col("weight")), 6).alias("progress"))


def status_counts(nodes: DataFrame) -> DataFrame:
    """All seven statuses, those without nodes too, and each one's share of the live nodes."""
    spark = nodes.sparkSession
    domain = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    n = live(nodes).groupBy("status").agg(F.count("*").alias("n"))
    total = live(nodes).agg(F.count("*").alias("total"))
    rows = F.broadcast(domain).join(n, "status", "left").join(F.broadcast(total))
    share = F.coalesce(F.col("n") / F.nullif("total", F.lit(0)), F.lit(0.0))
    return rows.select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(share, 6).alias("share"))


def projects(nodes: DataFrame) -> DataFrame:
    return live(nodes).groupBy("project").agg(F.count("*").alias("n"))


def child_counts(nodes: DataFrame) -> DataFrame:
    return live(nodes).filter("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n"))


def session_summary(nodes: DataFrame, sessions: DataFrame, agent: str) -> DataFrame:
    """One row: an agent's latest session with how many nodes it made, finished and deferred; deleted nodes count."""
    last = sessions.filter(F.col("agent_id") == agent).orderBy(F.desc("started_at"), F.desc("id")).limit(1)
    return last.select(F.col("id").alias("session_id"), "status", "started_at").join(session_counts(nodes), "session_id", "left").na.fill(0, ["created", "done", "deferred"])


def session_counts(nodes: DataFrame) -> DataFrame:
    """Per session; deleted nodes count here."""
    return nodes.filter("session_id is not null").groupBy("session_id").agg(F.count("*").alias("created"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "deferred").alias("deferred"))


def max_seq(nodes: DataFrame, all_rows: bool = False) -> DataFrame:
    """The last number under each parent: of live rows to verify, of all to rebuild."""
    rows = nodes if all_rows else live(nodes)
    return rows.groupBy("project", F.coalesce("parent_id", F.lit("")).alias("parent")).agg(F.max("seq").alias("last"))


def progress_mismatch(nodes: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Parents whose stored progress isn't their children's weighted mean."""
    fits = live(nodes).filter(~F.col("status").isin("cancelled", "invalidated") & F.col("parent_id").isNotNull())
    means = fits.groupBy(F.col("parent_id").alias("id")).agg(weighted(F.col("progress"), F.col("weight")).alias("expected"))
    return live(nodes).select("id", "progress").join(means, "id").filter(F.abs(F.col("progress") - F.col("expected")) > tolerance).select("id", "progress", F.round("expected", 6).alias("expected"))


def firing_rate(firings: DataFrame, now: str, cap: int = 20) -> DataFrame:
    """Delivered firings of each hook on each node since an hour before, and whether the cap is reached; ``firings`` has (hook, node_id, outcome, fired_at)."""
    since = F.lit(now).cast("timestamp") - F.expr("INTERVAL 1 HOUR")
    own = firings.filter((F.col("outcome") == "delivered") & (F.col("fired_at") >= since))
    return own.groupBy("hook", "node_id").agg(F.count("*").alias("n"), (F.count("*") >= cap).alias("limited"))


def newest_firings(firings: DataFrame, limit: int = 50) -> DataFrame:
    """The log of firings, newest first."""
    return firings.orderBy(F.desc("fired_at"), F.desc("event_id"), "hook").limit(limit)


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("op_type").agg(F.count("*").alias("n"), F.min("lamport").alias("first"), F.max("lamport").alias("last"))
