"""Checks, differences and recovery over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions.ids import ancestors
from thicket.operators.listing import live


def dangling_parents(nodes: DataFrame) -> DataFrame:
    """Live nodes whose parent has no live row."""
    own = live(nodes)
    return own.filter("parent_id is not null").join(own.select(F.col("id").alias("parent_id")), "parent_id", "left_anti").select("id", "parent_id")


def dangling_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ids = nodes.select("id")
    lost = [edges.join(ids.withColumnRenamed("id", c), c, "left_anti").select("from_id", "to_id") for c in ("from_id", "to_id")]
    return lost[0].union(lost[1]).distinct()


def set_diff(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """(key, side): in one table only. Both are shuffled once, and no side is joined with the other; null keys equal nothing."""
    sides = left.select(key, F.lit("left").alias("side")).unionByName(right.select(key, F.lit("right").alias("side")))
    met = sides.groupBy(key, F.when(F.col(key).isNull(), F.col("side")).alias("_null")).agg(F.min("side").alias("side"), F.max("side").alias("_last"))
    return met.filter(F.col("side") == F.col("_last")).select(key, "side")


def merge_actions(base: DataFrame, incoming: DataFrame, key: str = "id", digest: str = "content_hash") -> DataFrame:
    """(key, action): created, skipped (same digest) or updated."""
    there = base.select(key, F.col(digest).alias("old"), F.lit(True).alias("known"))
    action = F.when(F.col("known").isNull(), "created").when(F.col(digest).eqNullSafe(F.col("old")), "skipped").otherwise("updated")
    return incoming.join(there, key, "left").select(key, action.alias("action"))


def merged(base: DataFrame, incoming: DataFrame, key: str = "id", digest: str = "content_hash") -> DataFrame:
    """The table after a merge import: new rows come in, rows of the same digest stay, others are replaced but keep their uid where the import has none."""
    columns = base.columns
    theirs = incoming.select(F.col(key).alias("_key"), F.struct(*[F.col(c) for c in columns if c in incoming.columns]).alias("_new"))
    both = base.join(theirs, base[key] == theirs["_key"], "full")
    takes = F.col("_new").isNotNull() & (base[key].isNull() | ~F.col(f"_new.{digest}").eqNullSafe(base[digest]))

    def column(c: str):
        new = F.col(f"_new.{c}") if c in incoming.columns else base[c]
        return F.when(takes, F.coalesce(F.nullif(new, F.lit("")), base[c]) if c == "uid" else new).otherwise(base[c]).alias(c)

    return both.select(*[column(c) for c in columns])


def replaced(base: dict[str, DataFrame], incoming: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables after a replace import: what the import has, with the shape of what was there; tables that it lacks are emptied."""
    return {name: (incoming[name].select(*[F.col(c) if c in incoming[name].columns else F.lit(None).alias(c) for c in rows.columns]) if name in incoming else rows.limit(0)) for name, rows in base.items()}


def wrong_hashes(nodes: DataFrame) -> DataFrame:
    """Nodes whose stored content hash isn't that of their content, or is missing."""
    from thicket.functions.ids import content_hash

    own = content_hash(*[F.coalesce(c, F.lit("")) for c in ("title", "description", "prompt", "acceptance")], F.coalesce("labels", F.array().cast("array<string>")))
    return nodes.filter(~F.col("content_hash").eqNullSafe(own)).select("id")


def doctor(log: DataFrame, pending: DataFrame, now_ms: int, hours: int = 1) -> DataFrame:
    """(check, faults, ok): the push queue drains, and every applied event has its node. ``pending`` has wall_ms of events that wait."""
    from thicket.operators.replay import orphans

    old = pending.filter(F.col("wall_ms") < now_ms - hours * 3_600_000).agg(F.lit("queue").alias("check"), F.count("*").alias("faults"))
    lost = orphans(log).agg(F.lit("orphans").alias("check"), F.count("*").alias("faults"))
    return old.union(lost).withColumn("ok", F.col("faults") == 0)


def recovered(primary: DataFrame, mirror: DataFrame) -> DataFrame:
    """(id, origin): what the primary has, what only the mirror has, and placeholders for ancestors that neither has."""
    ranks = ["primary", "mirror", "placeholder"]
    rows = primary.select("id", F.lit(0).alias("rank")).unionByName(mirror.select("id", F.lit(1).alias("rank")))
    above = rows.select(F.explode(ancestors(F.col("id"))).alias("id")).select("id", F.lit(2).alias("rank"))
    # one shuffle, before which repeated ancestors combine
    best = rows.unionByName(above).groupBy("id").agg(F.min("rank").alias("rank"))
    return best.select("id", F.element_at(F.array(*map(F.lit, ranks)), F.col("rank") + 1).alias("origin"))


def clean_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge once, with both ends there."""
    ids = nodes.select("id")
    return edges.dropDuplicates(["from_id", "to_id", "dep_type"]).join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_semi")


def verify(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, faults, ok) of all checks."""
    from thicket.operators.aggregates import progress_mismatch

    checks = {"parents": dangling_parents(nodes), "edges": dangling_edges(nodes, edges), "unique_ids": nodes.groupBy("id").count().filter("count > 1"), "progress": progress_mismatch(nodes)}
    rows = None
    for name, faults in checks.items():
        row = faults.agg(F.lit(name).alias("check"), F.count("*").alias("faults"))
        rows = row if rows is None else rows.union(row)
    return rows.withColumn("ok", F.col("faults") == 0)
