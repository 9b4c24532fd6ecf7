"""Collisions of a hub's numbers: open ones in order, each resolved once; restore epochs; ids that mustn't leave yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.ids import provisional


def open_collisions(rows: DataFrame, project: str) -> DataFrame:
    """A project's open collisions, the oldest first."""
    return rows.filter((F.col("status") == "open") & (F.col("project") == project)).orderBy("detected_at", "collision_id")


def resolve(rows: DataFrame, decisions: DataFrame, now: str) -> DataFrame:
    """The table after decisions (collision_id, winner_event_id, loser_new_path, resolved_by); only open ones change, and ``changed`` says which did."""
    told = ["winner_event_id", "loser_new_path", "resolved_by"]
    new = decisions.groupBy("collision_id").agg(F.min(F.struct(*told)).alias("new"))
    both = rows.join(new, "collision_id", "left").withColumn("changed", F.col("new").isNotNull() & (F.col("status") == "open"))
    done = {c: F.when(F.col("changed"), F.col(f"new.{c}")).otherwise(F.col(c)) for c in told}
    when = F.when(F.col("changed"), F.lit(now).cast("timestamp")).otherwise(F.col("resolved_at"))
    return both.withColumns(done | {"resolved_at": when}).withColumn("status", F.when(F.col("changed"), "resolved").otherwise(F.col("status"))).drop("new")


def restored_epoch(state: DataFrame) -> DataFrame:
    """The hub's state after a restore: one epoch on."""
    return state.withColumn("restore_epoch", F.col("restore_epoch") + 1)


def unfit_ids(rows: DataFrame, column: str = "id") -> DataFrame:
    """Provisional ids, which must not be written outside; none means that all may."""
    return rows.filter(provisional(F.col(column))).select(column).distinct()


def refuse_provisional(rows: DataFrame, column: str = "id") -> None:
    """An error that names them all, if any id is provisional."""
    found = sorted(r[0] for r in unfit_ids(rows, column).collect())
    if found:
        raise ValueError(f"numbers not settled: {', '.join(found)}")
