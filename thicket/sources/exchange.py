"""Export, import and plan files."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.ids import canonical_json, node_type

PLAN = "title string, description string, prompt string, acceptance string, priority int, labels array<string>, parent string, _corrupt string"


def export_json(nodes: DataFrame, path: str) -> None:
    """All rows, deleted ones too, ordered by id across the files."""
    nodes.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").json(path)


#: The members of an exported node and edge, in order; those that are left out when empty.
NODE = ["id", "parent_id", "depth", "seq", "project", "title", "description", "prompt", "acceptance", "node_type", "issue_type", "priority", "labels", "status", "progress", "assignee", "creator", "agent_state", "weight", "content_hash", "created_at", "updated_at", "closed_at", "defer_until", "deleted_at", "uid"]
EDGE = ["from_id", "to_id", "dep_type", "created_at"]
OPTIONAL = {"closed_at", "defer_until", "deleted_at", "uid"}
NUMBERS = {"depth": "int", "seq": "bigint", "priority": "int", "progress": "double", "weight": "double"}


def _member(rows: DataFrame, name: str) -> Column:
    kind = dict(rows.dtypes).get(name)
    if name == "node_type":
        return node_type(F.col("depth"))
    if name in NUMBERS:
        return F.coalesce(F.col(name), F.lit(0)).cast(NUMBERS[name]) if kind else F.lit(0).cast(NUMBERS[name])
    if kind is None:
        text = F.lit(None).cast("string")
    elif kind == "timestamp":
        text = F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    elif kind.startswith("array"):
        text = canonical_json(F.to_json(name))
    else:
        text = F.col(name).cast("string")
    return F.nullif(text, F.lit("")) if name in OPTIONAL else F.coalesce(text, F.lit("[]" if name == "labels" else ""))


def records(rows: DataFrame, members: list[str]) -> Column:
    """The JSON of a row as an export writes it: members in order, no blanks, whole numbers without a fraction."""
    text = canonical_json(F.to_json(F.struct(*[_member(rows, m).alias(m) for m in members])))
    return F.regexp_replace(text, r'"(progress|weight)":(-?[0-9]+)\.0([,}])', r'"$1":$2$3')


def export_checksum(nodes: DataFrame, edges: DataFrame) -> str:
    """The digest that an export carries: sha-256 of its nodes by id and edges by their ends, deleted ones too, as one JSON text.

    Such a digest has no parts, so the records, made and sorted by Spark, are
    read one partition after the other and hashed as they come.
    """
    total = hashlib.sha256()

    def add(rows: DataFrame, members: list[str], order: list[str]) -> None:
        first = True
        for r in rows.select(*order, records(rows, members).alias("record")).orderBy(*order).select("record").toLocalIterator():
            total.update(("" if first else ",").encode() + r.record.encode())
            first = False

    # an export without rows of a kind says null
    total.update(b'{"nodes":')
    for k, (rows, members, order) in enumerate(((nodes, NODE, ["id"]), (edges, EDGE, ["from_id", "to_id"]))):
        some = bool(rows.take(1))
        total.update((b',"deps":' if k else b"") + (b"[" if some else b"null"))
        if some:
            add(rows, members, order)
            total.update(b"]")
    total.update(b"}")
    return total.hexdigest()


def read_export(spark: SparkSession, path: str, nodes: str, edges: str) -> tuple[DataFrame, DataFrame, dict]:
    """(nodes, edges, header) of an export file, one JSON object and nothing after it; ``nodes`` and ``edges`` are their schemas.

    Refuses text after the object, and a node count other than the one declared.
    """
    head = "version int, schema_version string, project string, node_count long, checksum string"
    told = spark.read.schema(f"{head}, nodes array<struct<{_typed(nodes)}>>, dependencies array<struct<{_typed(edges)}>>, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    # Spark's own readers stop where the object closes, so a task looks at the whole text
    rest = not spark.read.text(path, wholetext=True).select(F.pandas_udf(_whole, "boolean")("value").alias("one")).first()["one"]
    rows = told.select(*[c.split()[0] for c in head.split(", ")], F.size("nodes").alias("found"), "_corrupt").take(2)
    if rest or len(rows) != 1 or rows[0]["_corrupt"] is not None:
        raise ValueError("an export is one JSON object")
    header = rows[0].asDict()
    if header["node_count"] != max(0, header["found"] or 0):
        raise ValueError(f"{header['node_count']} nodes declared, {header['found']} found")
    return told.select(F.inline("nodes")), told.select(F.inline("dependencies")), header


def _whole(texts: pd.Series) -> pd.Series:
    """Whether a text is one JSON object and nothing else."""

    def one(text: str) -> bool:
        try:
            return isinstance(json.loads(text), dict)
        except ValueError:
            return False

    return texts.map(one)


def _typed(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (c.strip().split(" ", 1) for c in schema.split(",")))


def import_json(spark: SparkSession, path: str, schema) -> DataFrame:
    """Rows of an export; anything malformed fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def checksum(rows: DataFrame) -> str:
    """A digest of a table that doesn't depend on the order of its rows: row hashes summed as decimals."""
    text = F.to_json(F.struct(*sorted(rows.columns)))
    parts = rows.select([F.conv(F.substring(F.sha2(text, 256), 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"h{i}") for i in range(4)])
    sums = parts.agg(*[F.sum(f"h{i}").alias(f"h{i}") for i in range(4)], F.count("*").alias("n")).first()
    return "-".join(str(v) for v in sums)


def guard_import(rows: DataFrame, declared: int, digest: str | None = None, force: bool = False) -> None:
    """Refuses an import whose count or digest isn't as declared, or that is empty without force."""
    n = rows.count()
    if n != declared:
        raise ValueError(f"{declared} rows declared, {n} found")
    if not n and not force:
        raise ValueError("nothing to import")
    if digest is not None and checksum(rows) != digest:
        raise ValueError("the checksum differs")


def read_plan(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a plan of one JSON object a line: blank lines are skipped, a title of at most 500 bytes is a must."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).filter(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", PLAN, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("p"))
    title = F.coalesce(F.trim("p.title"), F.lit(""))
    fault = F.when(F.col("p._corrupt").isNotNull(), "not JSON").when(title == "", "no title").when(F.octet_length("p.title") > 500, "title too long")
    judged = parsed.withColumn("fault", fault)
    return judged.filter("fault is null").select("p.*").drop("_corrupt"), judged.filter("fault is not null").select(F.col("value").alias("line"), "fault")


def query(spark: SparkSession, text: str, args: dict | None = None, **tables: DataFrame) -> DataFrame:
    """SQL with named parameters over the given tables."""
    return spark.sql(text, args, **tables)
