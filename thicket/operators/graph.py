"""Dependencies: blockers, blocking as one pass over all nodes, and what is reachable."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.ids import TERMINAL
from thicket.operators.listing import live
from thicket.sources.store import checkpointed


def blockers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(to_id, from_id): live, unfinished nodes that block another."""
    open_ = live(nodes).filter(~F.col("status").isin(TERMINAL)).select(F.col("id").alias("from_id"))
    return edges.filter("dep_type = 'blocks'").join(open_, "from_id", "left_semi").select("to_id", "from_id")


def settle_blocks(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, status, new_status, previous_status) after blocking and unblocking everywhere at once.

    Open and running nodes with a blocker become blocked and keep the status
    they had; blocked ones without go back to it, or to open if none is kept.
    ``nodes`` may lack ``previous_status``.
    """
    held = blockers(nodes, edges).groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n"))
    has = F.coalesce("n", F.lit(0)) > 0
    was = F.nullif(F.col("previous_status"), F.lit("")) if "previous_status" in nodes.columns else F.lit(None).cast("string")
    block, free = has & F.col("status").isin("open", "in_progress"), ~has & (F.col("status") == "blocked")
    new = F.when(block, "blocked").when(free, F.coalesce("was", F.lit("open"))).otherwise(F.col("status"))
    kept = F.when(block, F.col("status")).when(~free, F.col("was"))
    return live(nodes).select("id", "status", was.alias("was")).join(held, "id", "left").select("id", "status", new.alias("new_status"), kept.alias("previous_status"))


def reachable(edges: DataFrame, start: str) -> DataFrame:
    """(id, steps): what blocks edges lead to from a node, by frontiers until none is new; the visited are left out, so cycles end.

    Each round looks two edges ahead, so a chain takes half as many rounds.
    """
    step = checkpointed(edges.filter("dep_type = 'blocks'").select("from_id", "to_id").distinct())
    seen = checkpointed(step.sparkSession.createDataFrame([(start, 0)], "id string, steps int"))
    edge, k = seen, 0
    while edge.take(1):
        near = edge.select(F.col("id").alias("from_id")).join(step, "from_id").select(F.col("to_id").alias("id")).distinct()
        far = near.select(F.col("id").alias("from_id")).join(step, "from_id").select(F.col("to_id").alias("id")).distinct()
        found = near.withColumn("steps", F.lit(k + 1)).union(far.withColumn("steps", F.lit(k + 2))).groupBy("id").agg(F.min("steps").alias("steps"))
        both = checkpointed(found.join(seen, "id", "left_anti"))
        seen, edge, k = checkpointed(seen.union(both)), both.filter(F.col("steps") == k + 2), k + 2
    return seen.filter("steps > 0")


def would_cycle(edges: DataFrame, from_id: str, to_id: str) -> bool:
    """Whether an edge from -> to closes a cycle."""
    return from_id == to_id or bool(reachable(edges, to_id).filter(F.col("id") == from_id).take(1))


def add_edge(edges: DataFrame, from_id: str, to_id: str, dep_type: str = "blocks") -> DataFrame:
    if from_id == to_id:
        raise ValueError("a node can't depend on itself")
    if edges.filter((F.col("from_id") == from_id) & (F.col("to_id") == to_id) & (F.col("dep_type") == dep_type)).take(1):
        raise ValueError("the dependency exists")
    if dep_type == "blocks" and would_cycle(edges, from_id, to_id):
        raise ValueError("the dependency would close a cycle")
    return edges.select("from_id", "to_id", "dep_type").union(edges.sparkSession.createDataFrame([(from_id, to_id, dep_type)], "from_id string, to_id string, dep_type string"))


def remove_edge(edges: DataFrame, from_id: str, to_id: str, dep_type: str = "blocks") -> DataFrame:
    if not edges.filter((F.col("from_id") == from_id) & (F.col("to_id") == to_id) & (F.col("dep_type") == dep_type)).take(1):
        raise LookupError("the dependency doesn't exist")
    return edges.filter(~((F.col("from_id") == from_id) & (F.col("to_id") == to_id) & (F.col("dep_type") == dep_type)))
