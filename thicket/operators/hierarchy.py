"""Trees by dot-paths: no recursion is needed."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.ids import TERMINAL, ancestors, depth, parent, under
from thicket.operators.listing import live
from thicket.operators.numbering import running
from thicket.sources.store import kept

#: So many missing parents at most go to every task.
FEW = 100_000


def tree(nodes: DataFrame, root: str, levels: int) -> DataFrame:
    """The root and what is at most so many levels below it."""
    top = root.count(".")
    return live(nodes).filter(under(F.col("id"), root) & (F.col("depth") <= top + levels))


def missing_parents(nodes: DataFrame) -> DataFrame:
    """Ids that live nodes have for a parent, but no live node has."""
    own = live(nodes)
    named = own.filter("parent_id is not null").select(F.col("parent_id").alias("id"), F.lit(False).alias("there"))
    return named.unionByName(own.select("id", F.lit(True).alias("there"))).groupBy("id").agg(F.bool_or("there").alias("there")).filter("not there").select("id")


def _with_parent(nodes: DataFrame) -> DataFrame:
    return live(nodes).select("id", parent(F.col("id")).alias("above"))


def _broken(own: DataFrame, lost: DataFrame, few: bool) -> DataFrame:
    """(above, missing): parents by path, each once, with what is lost of their chains, themselves included."""
    each = own.filter("above is not null").select("above").distinct().select("above", F.explode(ancestors(F.col("above"))).alias("missing"))
    gone = lost.select(F.col("id").alias("missing"))
    return each.join(F.broadcast(gone) if few else gone, "missing", "left_semi").select("above", "missing")


def broken_chains(nodes: DataFrame) -> DataFrame:
    """(id, missing): live nodes with an ancestor that is deleted or was never there; asking for their chain is an error.

    Siblings share what is above them, so chains are looked at once for each parent.
    """
    lost, own = missing_parents(nodes), _with_parent(nodes)
    few = lost.limit(FEW + 1).count() <= FEW
    return own.join(_broken(own, lost, few), "above").select("id", "missing")


def _chains(ids: DataFrame) -> DataFrame:
    return ids.select("id", F.posexplode(ancestors(F.col("id"))).alias("level", "ancestor_id")).select("id", "ancestor_id", F.col("level").cast("long").alias("level"))


def with_ancestors(nodes: DataFrame) -> DataFrame:
    """(id, ancestor_id, level) for each node and each node above it, itself included; nodes with a broken chain have no rows.

    A path holds its ancestors, so only the parents that are missing are looked
    up, and joined by broadcast while they are few.
    """
    own, lost = _with_parent(nodes), missing_parents(nodes)
    found = lost.limit(FEW + 1).count()
    if found:
        own = own.join(_broken(own, lost, found <= FEW).select("above").distinct(), "above", "left_anti")
    return _chains(own)


def inherited(parts: DataFrame, value: str) -> DataFrame:
    """``parts``, one row for each id, with ``above``: the ``value`` of each node above it, from the root down; ids with one missing above are left out.

    Chains are put together for each parent only, and each node meets its
    parent's: so what many nodes have above them is not shuffled once for each.
    """
    own = parts.withColumn("_parent", parent(F.col("id")))
    parents = own.filter("_parent is not null").select(F.col("_parent").alias("id")).distinct()
    met = _chains(parents).join(parts.select(F.col("id").alias("ancestor_id"), F.col(value).alias("_value")), "ancestor_id")
    heads = met.groupBy(F.col("id").alias("_parent")).agg(F.transform(F.sort_array(F.collect_list(F.struct("level", F.col("_value").alias("value")))), lambda x: x["value"]).alias("above"))
    above = F.coalesce("above", F.array().cast(heads.schema["above"].dataType))
    return own.join(heads, "_parent", "left").withColumn("above", above).filter(F.size("above") == F.size(ancestors(F.col("id"))) - 1).drop("_parent")


def chain(nodes: DataFrame, id_: str) -> DataFrame:
    """The live nodes from the root down to ``id_``; an error names what is missing."""
    names = [".".join(id_.split(".")[: k + 1]) for k in range(id_.count(".") + 1)]
    found = live(nodes).filter(F.col("id").isin(names))
    missing = sorted(set(names) - {r.id for r in found.select("id").collect()})
    if missing:
        raise LookupError(f"not found: {', '.join(missing)}")
    return found.orderBy("depth")


def nested(nodes: DataFrame, root: str, levels: int = 10) -> dict:
    """The tree below a node as nested dicts (id, title, status, progress, depth from the root, children by number), for one asked node.

    The subtree's rows come to the driver: it is what one reply holds.
    """
    rows = tree(nodes, root, levels).select("id", "parent_id", "title", "status", "progress", "depth", "seq").orderBy("depth", "seq").collect()
    if not rows or rows[0].id != root:
        raise LookupError(f"node {root} not found")
    top = rows[0].depth
    made = {r.id: {"id": r.id, "title": r.title, "status": r.status, "progress": r.progress, "depth": r.depth - top} | ({"children": []} if r.depth - top < levels else {}) for r in rows}
    for r in rows[1:]:
        if r.parent_id in made:
            made[r.parent_id]["children"].append(made[r.id])
    return made[root]


def renamed_everywhere(tables: dict[str, tuple[DataFrame, list[str]]], old: str, new: str) -> dict[str, DataFrame]:
    """Tables (name to frame and its id columns) after a subtree moved: nodes, edges, events and conflicts alike."""
    return {name: rows.withColumns({c: moved(F.col(c), old, new) for c in ids}) for name, (rows, ids) in tables.items()}


def rebased(rows: DataFrame, moves: DataFrame, column: str = "id") -> DataFrame:
    """``rows`` with ``new_`` + column: the path after the longest of the moves (old, new) that is the path or above it; unmoved paths stay.

    Each path's prefixes are looked up, so moves are joined by equality, however many there are.
    """
    named = moves.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    asked = rows.select(column).distinct()
    each = asked.select(column, F.explode(ancestors(F.col(column))).alias("_old")).join(named, "_old")
    best = each.groupBy(column).agg(F.max_by(F.struct("_old", "_new"), F.length("_old")).alias("_best"))
    tail = F.expr(f"substring(`{column}`, length(_best._old) + 1)")
    return rows.join(best, column, "left").withColumn(f"new_{column}", F.when(F.col("_best").isNull(), F.col(column)).otherwise(F.concat("_best._new", tail))).drop("_best")


def siblings(nodes: DataFrame) -> DataFrame:
    """(parent_id, id, n_siblings): who shares a parent, without listing pairs; roots and only children have none."""
    kids = live(nodes).filter("parent_id is not null").select("parent_id", "id")
    many = kids.groupBy("parent_id").agg((F.count("*") - 1).alias("n_siblings")).filter("n_siblings > 0")
    return kids.join(many, "parent_id").select("parent_id", "id", "n_siblings")


def siblings_of(nodes: DataFrame, id_: str) -> DataFrame:
    """The live siblings of one node, by number; a root has none."""
    parent = id_.rpartition(".")[0]
    return live(nodes).filter((F.col("parent_id") == parent) & (F.col("id") != id_)).orderBy("seq")


#: Sorts before all that an id holds, so a path in whose place it stands sorts right before what is below it.
_SEP = "\x01"
#: ``row``: whether the node itself was seen, not only what is below it. Sums are null where a node is done.
_OPEN = "id string, progress double, row boolean, counted boolean, weight double, inner boolean, total double, done double"


def _folded(last: bool):
    """Rows sorted by path to nodes with their progress, for ``mapInArrow``; a stack holds the nodes above a row.

    What may have more below it in other parts is left open, with the sums so
    far: the nodes above the first row and above the last. The ``last`` pass,
    over all that is open, leaves nothing so.
    """
    #: What a row has of its own, and what it has if it isn't told.
    names = {"row": True, "counted": None, "weight": None, "inner": False, "total": 0.0, "done": 0.0, "progress": None}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.string()), ("progress", pa.float64()), ("row", pa.bool_()), ("counted", pa.bool_()), ("weight", pa.float64()), ("inner", pa.bool_()), ("total", pa.float64()), ("done", pa.float64())])
        # of each node on the stack: its path as those below begin with it, then ``names``
        stack: list[list] = []
        ready: list[tuple] = []
        values: list = []
        opened: list[tuple] = []

        def leave() -> None:
            head, row, counted, weight, inner, total, done, progress = stack.pop()
            if row:
                if inner:
                    progress = done / total if total else 0.0
                ready.append(head[:-1])
                values.append(progress)
                # the node above, unless that one is missing
                if counted and stack and head.find(_SEP, len(stack[-1][0])) == len(head) - 1:
                    above = stack[-1]
                    above[4] = True
                    if weight is not None:
                        above[5] += weight
                        above[6] += weight * progress if progress is not None else 0.0
            elif not last:
                opened.append((head[:-1], None, False, False, None, inner, total, done))

        def given() -> pa.RecordBatch:
            n, m = len(ready), len(opened)
            left = list(zip(*opened)) if m else [()] * 8
            columns = [pa.array([*ready, *left[0]], pa.string()), pa.array([*values, *left[1]], pa.float64())]
            columns += [pa.array([None] * n + list(left[k]), schema.field(k).type) for k in range(2, 8)]
            columns[0] = pc.replace_substring(columns[0], _SEP, ".")
            ready.clear(), values.clear(), opened.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            rows = [batch.column(n).to_pylist() if n in batch.schema.names else repeat(other) for n, other in names.items()]
            for path, row, counted, weight, inner, total, done, progress in zip(batch.column("path").to_pylist(), *rows):
                if path is None:
                    ready.append(None)
                    values.append(progress)
                    continue
                if not stack and not last:
                    stack += [[path[: k + 1], False, False, None, False, 0.0, 0.0, None] for k, c in enumerate(path) if c == _SEP]
                while stack and not path.startswith(stack[-1][0]):
                    leave()
                stack.append([path + _SEP, row, counted, weight, inner, total, done, progress])
            if ready or opened:
                yield given()
        if last:
            while stack:
                leave()
        opened += [(head[:-1], progress, *rest) for head, *rest, progress in stack]
        if ready or opened:
            yield given()

    return fold


def rollup(nodes: DataFrame) -> DataFrame:
    """(id, progress): leaves keep theirs, parents get their children's weighted mean.

    Cancelled and invalidated children don't count, deferred ones do; a parent
    none of whose children count has 0. Above a missing node nothing of what is
    below it counts.

    No level waits for the one below, and each row is shuffled once however deep
    it is: dealt by ranges of paths, a parent comes right before all that is
    below it, so a task folds its range with a stack as high as the tree. Only
    the nodes above a range's first and last row stay open; the rows on them,
    a depth's number for each range, are summed up by node and folded once more.
    """
    rows = live(nodes)
    fits = ~F.col("status").isin("cancelled", "invalidated")
    path = F.replace("id", F.lit("."), F.lit(_SEP)).alias("path")
    told = rows.select(path, F.col("parent_id").isNotNull().alias("counted"), F.when(fits, F.col("weight")).cast("double").alias("weight"), F.col("progress").cast("double").alias("progress"))
    folded = told.repartitionByRange("path").sortWithinPartitions("path").mapInArrow(_folded(False), _OPEN)
    # read twice from one dealing: another one would leave other nodes open
    found = kept(folded)
    if found is folded:
        found = folded.persist(StorageLevel.DISK_ONLY)
    ready = found.filter("row is null").select("id", "progress")
    sums = [F.bool_or("row").alias("row"), F.bool_or("counted").alias("counted"), F.max("weight").alias("weight"), F.bool_or("inner").alias("inner"), F.sum("total").alias("total"), F.sum("done").alias("done"), F.max("progress").alias("progress")]
    left = found.filter("row is not null").groupBy(path).agg(*sums)
    rest = left.repartition(1).sortWithinPartitions("path").mapInArrow(_folded(True), _OPEN)
    return ready.unionByName(rest.select("id", "progress"))


def moved(id_: Column, old: str, new: str) -> Column:
    """The id, with the subtree ``old`` renamed to ``new``."""
    return F.when(under(id_, old), F.concat(F.lit(new), F.substring(id_, len(old) + 1, 1_000_000))).otherwise(id_)


def renumber(nodes: DataFrame, edges: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a subtree moved; the target must be free, deleted nodes included."""
    if nodes.filter(under(F.col("id"), new)).take(1):
        raise ValueError(f"{new} is taken")
    return nodes.withColumns({"id": moved(F.col("id"), old, new), "parent_id": moved(F.col("parent_id"), old, new)}), edges.withColumns({c: moved(F.col(c), old, new) for c in ("from_id", "to_id")})


def renamed_prefix(id_: Column, old: str, new: str) -> Column:
    return F.when(id_.startswith(f"{old}-"), F.concat(F.lit(new), F.substring(id_, len(old) + 1, 1_000_000))).otherwise(id_)


def import_as(nodes: DataFrame, project: str, parent: str, first: int = 1) -> DataFrame:
    """(id, new_id): a project's roots become numbered children of ``parent``, in the order of their ids, with all below them.

    Only the roots are numbered, by counts per beginning of their ids.
    """
    own = nodes.filter(F.col("project") == project)
    roots = own.filter("parent_id is null").select(F.col("id").alias("root"))
    numbered = running(roots.withColumn("one", F.lit(1)), [], ["root"], F.substring("root", 1, len(project) + 3), "one", "n")
    return own.select("id", F.substring_index("id", ".", 1).alias("root")).join(numbered, "root").select("id", F.concat(F.lit(f"{parent}."), F.col("n") + first - 1, F.expr("substring(id, length(root) + 1)")).alias("new_id"))


def delete_cascade(nodes: DataFrame, root: str, now: str) -> DataFrame:
    return nodes.withColumn("deleted_at", F.when(under(F.col("id"), root) & F.col("deleted_at").isNull(), F.lit(now).cast("timestamp")).otherwise(F.col("deleted_at")))


def undelete_cascade(nodes: DataFrame, root: str) -> DataFrame:
    return nodes.withColumn("deleted_at", F.when(~under(F.col("id"), root), F.col("deleted_at")))


def cancel_cascade(nodes: DataFrame, root: str) -> DataFrame:
    hit = under(F.col("id"), root) & F.col("deleted_at").isNull() & ~F.col("status").isin(TERMINAL)
    return nodes.withColumn("status", F.when(hit, "cancelled").otherwise(F.col("status")))


def rerun(nodes: DataFrame, root: str, strategy: str, now: str) -> DataFrame:
    """What is below the root starts over: all of it, the open part, deleted, or put up for review."""
    below = F.col("id").startswith(f"{root}.") & F.col("deleted_at").isNull()
    if strategy == "delete":
        return nodes.withColumn("deleted_at", F.when(below, F.lit(now).cast("timestamp")).otherwise(F.col("deleted_at")))
    change = {"all": (below & (F.col("status") != "open"), "invalidated"), "open_only": (below & ~F.col("status").isin(TERMINAL), "open"), "review": (below & (F.col("status") == "done"), "invalidated")}[strategy]
    return nodes.withColumn("status", F.when(change[0], change[1]).otherwise(F.col("status")))


def placeholders(nodes: DataFrame) -> DataFrame:
    """Ids of ancestors that no row has."""
    above = nodes.select(F.explode(ancestors(F.col("id"))).alias("id")).distinct()
    return above.join(nodes.select("id"), "id", "left_anti").select("id", depth(F.col("id")).alias("depth"))


