"""One object for the read operations over a set of tables; each takes the clock it needs and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.ids import under
from thicket.operators import aggregates, graph, hierarchy, integrity, listing, replay, text
from thicket.sources import views
from thicket.sources.store import checkpointed


class Engine:
    """``nodes`` and ``edges`` are tables of the shapes that thicket.sources.views makes; ``log`` holds events with a JSON payload."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, log: DataFrame):
        self.nodes, self.edges, self.log = nodes, edges, log
        self._words: tuple[DataFrame, DataFrame] | None = None

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str) -> Engine:
        from thicket.plans.applied import log_of

        return cls(views.view(spark, sf_dir, "nodes"), views.view(spark, sf_dir, "edges"), log_of(views.view(spark, sf_dir, "log")))

    def get(self, id_: str) -> DataFrame:
        return listing.get_node(self.nodes, id_)

    def list(self, limit: int = 50, offset: int = 0, fields: list[str] | None = None, **filters) -> DataFrame:
        page = listing.page(listing.list_nodes(self.nodes, **filters), limit, offset)
        return listing.project_fields(page, fields) if fields else page

    def total(self, limit: int = 50, offset: int = 0, **filters) -> DataFrame:
        return listing.page_info(listing.list_nodes(self.nodes, **filters), limit, offset)

    def nested(self, root: str, levels: int = 10) -> dict:
        return hierarchy.nested(self.nodes, root, levels)

    def ready(self, now: str, strict: bool = False) -> DataFrame:
        return listing.ready_strict(self.nodes, self.edges, now) if strict else listing.ready(self.nodes, now)

    def roots(self) -> DataFrame:
        return listing.roots(self.nodes)

    def tree(self, root: str, levels: int = 10) -> DataFrame:
        return hierarchy.tree(self.nodes, root, levels)

    def children(self, id_: str) -> DataFrame:
        return listing.live(self.nodes).filter(F.col("parent_id") == id_).orderBy("seq")

    def ancestors(self, id_: str) -> DataFrame:
        return hierarchy.chain(self.nodes, id_)

    def siblings(self, id_: str) -> DataFrame:
        return hierarchy.siblings_of(self.nodes, id_)

    def progress(self) -> DataFrame:
        return hierarchy.rollup(self.nodes)

    def stats(self, by: str = "status", root: str = "") -> DataFrame:
        return aggregates.stats_by(self.nodes.filter(under(F.col("id"), root)) if root else self.nodes, by)

    def projects(self) -> DataFrame:
        return aggregates.projects(self.nodes)

    def blockers(self, id_: str) -> DataFrame:
        return graph.blockers(self.nodes, self.edges).filter(F.col("to_id") == id_)

    def dependents(self, id_: str) -> DataFrame:
        return self.edges.filter(F.col("from_id") == id_)

    def search(self, *asked: list[text.Term], limit: int = 20, offset: int = 0) -> DataFrame:
        """A page of the live nodes that meet one of the alternatives in their texts."""
        return text.best(text.search(*self.index(), list(asked)), limit, offset)

    def index(self) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths of the live nodes' texts, made at the first search and kept in the checkpoint folder."""
        if self._words is None:
            columns = [c for c in ("title", "description", "prompt") if c in self.nodes.columns]
            rows = listing.live(self.nodes)
            self._words = checkpointed(text.postings(rows, columns, "id")), checkpointed(text.lengths(rows, columns, "id"))
        return self._words

    def prompt(self, id_: str, budget: int = 0) -> DataFrame:
        """The node's prompt with what stands above it, cut to a budget of tokens if one is given."""
        named = self.ancestors(id_).select(F.lit(id_).alias("id"), F.col("id").alias("ancestor_id"), F.col("depth").cast("long").alias("level"))
        return text.prompts(self.nodes, named, self.blockers(id_), budget)

    def context(self, id_: str) -> DataFrame:
        named = self.ancestors(id_).select(F.lit(id_).alias("id"), F.col("id").alias("ancestor_id"), F.col("depth").cast("long").alias("level"))
        return text.context(self.nodes, named)

    def replay(self) -> DataFrame:
        return replay.replay(self.log)

    def verify(self) -> DataFrame:
        return integrity.verify(self.nodes, self.edges)
