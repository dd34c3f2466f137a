"""The link graph as two tables in buckets: edges by the page they start from, and by the page they lead to, changed together in one commit.

The neighbours of a search pool are found in the buckets of its pages; nothing reads or orders the edges of others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.log import SnapshotLog
from ..sources.merge import BUCKETS, MergeTable
from ..sources.staging import held, settled
from . import graph

COLUMNS = ["source_page_id", "target_page_id", "link_type"]
SCHEMA = "source_page_id long, target_page_id long, link_type string"
#: Targets of a pool's links whose buckets are looked up; with more all buckets are read.
MAX_TARGETS = 100_000


class Adjacency:
    def __init__(self, log: SnapshotLog, name: str = "edges", buckets: int = BUCKETS):
        self.log, self.spark = log, log.spark
        schema = self.spark.createDataFrame([], SCHEMA).schema
        self.out = MergeTable(log, f"{name}-out", schema, ["source_page_id", "link_type"], ["source_page_id"], buckets)
        self.into = MergeTable(log, f"{name}-into", schema, ["target_page_id", "source_page_id", "link_type"], ["target_page_id"], buckets)

    def build(self, edges: DataFrame) -> int:
        rows = settled(edges.select(*COLUMNS).distinct())
        new = self.out.replaced(rows) | self.into.replaced(rows)
        return self.log.transact(lambda _: new)

    def _change(self, new: DataFrame, groups: DataFrame, old: DataFrame) -> int:
        """``new`` edges in place of the ``old`` ones, which are all of these ``groups`` (source_page_id, link_type)."""
        deltas = self.out.delta(new, groups), self.into.delta(new, old)
        return self.log.transact(lambda state: self.out.added(state, deltas[0]) | self.into.added(state, deltas[1]))

    def replace_links(self, pages: list[int], links: DataFrame, link_type: str = "link") -> int:
        """The links of this type that these pages have now, in place of those they had."""
        groups = self.spark.createDataFrame([(p, link_type) for p in pages], "source_page_id long, link_type string")
        old = self.out.read([(p,) for p in pages]).join(groups, ["source_page_id", "link_type"], "left_semi")
        return self._change(settled(links.select(*COLUMNS).distinct()), groups, settled(old.select(*COLUMNS)))

    def delete_pages(self, pages: list[int]) -> int:
        """Without all edges from or to these pages."""
        ids = [(p,) for p in pages]
        old = settled(self.out.read(ids).filter(F.col("source_page_id").isin(pages)).unionByName(self.into.read(ids).filter(F.col("target_page_id").isin(pages)).select(*COLUMNS)).distinct())
        groups = old.select("source_page_id", "link_type").distinct()
        sources = [r[0] for r in groups.select("source_page_id").distinct().limit(MAX_TARGETS + 1).collect()]
        rest = self.out.read([(s,) for s in sources] if len(sources) <= MAX_TARGETS else None).join(groups, ["source_page_id", "link_type"], "left_semi").join(old, COLUMNS, "left_anti")
        return self._change(settled(rest.select(*COLUMNS)), groups, old)

    def edges(self) -> DataFrame:
        return self.out.read().select(*COLUMNS)

    def blanket(self, pages: DataFrame, wanted: list[int] | DataFrame) -> DataFrame:
        """(page_id, relation, neighbour_id) of these pages, as ``graph.blanket``; of the edges, only the buckets of these pages and of what they link to are read.

        ``wanted`` is a list, or a table (page_id), of which at most a search pool's ids come to the driver: more than these lie in all buckets, and are joined."""
        _, state = self.log.state()
        if isinstance(wanted, DataFrame):
            ids = [r.page_id for r in wanted.select("page_id").distinct().limit(graph.MAX_POOL + 1).collect()]
            if len(ids) > graph.MAX_POOL:
                return graph.blanket_of_many(self.out.read(None, state).select(*COLUMNS), pages, wanted)
        else:
            ids = wanted
        own = [(i,) for i in ids]
        outgoing = held(self.out.read(own, state).filter(F.col("source_page_id").isin(ids)).select(*COLUMNS))
        incoming = self.into.read(own, state).filter(F.col("target_page_id").isin(ids)).select(*COLUMNS)
        targets = [r[0] for r in outgoing.select("target_page_id").distinct().limit(MAX_TARGETS + 1).collect()]
        shared = self.into.read([(t,) for t in targets] if len(targets) <= MAX_TARGETS else None, state).select(*COLUMNS)
        return graph.blanket_of_edges(outgoing, held(incoming), shared, pages, ids)
