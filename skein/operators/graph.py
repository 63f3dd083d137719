"""Lookup, search and statistics over a property graph of two tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["project", "id"]


def dedupe_first(nodes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The first delivered row of every id holds (building a graph)."""
    return _dedupe(nodes, key or KEY, F.min_by)


def dedupe_last(nodes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The last delivered row of every id holds, at the place of the first one
    (serving a graph).  A map-side combined aggregate: redelivered copies of one
    id are never gathered in a task."""
    return _dedupe(nodes, key or KEY, F.max_by)


def _dedupe(nodes: DataFrame, key: list[str], pick) -> DataFrame:
    rest = [c for c in nodes.columns if c not in key and c != "seq"]
    # one aggregate a column, so that columns nobody asks for are not read
    held = nodes.groupBy(*key).agg(*[pick(F.col(c), F.col("seq")).alias(c) for c in rest], F.min("seq").alias("_first"))
    return held.select(*[F.col("_first" if c == "seq" else c).alias(c) for c in nodes.columns])


def contains_folded(column: Column, query: str) -> Column:
    """Case-insensitive substring test in which no character is special."""
    return F.lower(column).contains(F.lower(F.lit(query)))


@dataclass
class Graph:
    """``nodes`` and ``edges`` of one or more projects (see :mod:`skein.schema`).

    Ids are compared within a project.  Edges are a bag: parallel edges, loops
    and targets without a node are all kept.
    """

    nodes: DataFrame
    edges: DataFrame

    def of_project(self, project: str) -> Graph:
        return Graph(self.nodes.where(F.col("project") == project), self.edges.where(F.col("project") == project))

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == node_id)

    def nodes_in_order(self) -> DataFrame:
        return self.nodes.orderBy("seq")

    def edges_in_order(self) -> DataFrame:
        return self.edges.orderBy("seq")

    def nodes_by_file(self, filepath: str) -> DataFrame:
        return self.nodes.where(F.col("filepath") == filepath)

    def nodes_by_type(self, node_type: str) -> DataFrame:
        return self.nodes.where(F.col("type") == node_type)

    def edges_from(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("sourceid") == node_id)

    def edges_to(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("targetid") == node_id)

    def connected_edges(self, node_id: str) -> DataFrame:
        """Outgoing then incoming edges; a loop is in both."""
        out = self.edges_from(node_id).withColumn("direction", F.lit("out"))
        return out.unionByName(self.edges_to(node_id).withColumn("direction", F.lit("in")))

    def search(self, query: str, node_type: str | None = None) -> DataFrame:
        """Nodes whose name or any domain concept holds ``query``, with the rank
        of their match: names before concepts, keys by first appearance."""
        concept = lambda c: contains_folded(c, query)
        by_name = contains_folded(F.col("name"), query)
        concepts = F.coalesce(F.col("semantic.domainconcepts"), F.array().cast("array<string>"))
        hit = F.filter(concepts, concept)
        found = self.nodes.where(F.coalesce(by_name, F.lit(False)) | F.exists(concepts, lambda c: F.coalesce(concept(c), F.lit(False))))
        if node_type:
            found = found.where(F.col("type") == node_type)
        return found.withColumn("match_kind", F.when(by_name, "name").otherwise("concept")).withColumn(
            "match_key", F.lower(F.when(by_name, F.col("name")).otherwise(hit[0]))
        )

    @staticmethod
    def in_match_order(found: DataFrame) -> DataFrame:
        key = Window.partitionBy("match_kind", "match_key")
        return found.withColumn("_first", F.min("seq").over(key)).orderBy(
            (F.col("match_kind") == "concept").cast("int"), "_first", "seq"
        ).drop("_first")

    def induced_edges(self, of: DataFrame) -> DataFrame:
        """Edges whose both ends are among the nodes ``of``."""
        ids = of.select("project", "id").distinct()
        source = ids.withColumnRenamed("id", "sourceid")
        target = ids.withColumnRenamed("id", "targetid")
        return self.edges.join(source, ["project", "sourceid"], "left_semi").join(target, ["project", "targetid"], "left_semi").select(*self.edges.columns)

    def add_nodes(self, new: DataFrame) -> Graph:
        """Upsert: a new row of a known id replaces it in place."""
        return Graph(dedupe_last(self.nodes.unionByName(new)), self.edges)

    def append_edges(self, new: DataFrame) -> Graph:
        return Graph(self.nodes, self.edges.unionByName(new))

    def stats(self) -> DataFrame:
        """One row: nodecount, edgecount, filecount (distinct file paths of nodes)."""
        files = self.nodes.select("project", "filepath").where(F.col("filepath").isNotNull()).distinct().agg(F.count("*").alias("filecount"))
        return (
            self.nodes.agg(F.count("*").alias("nodecount"))
            .crossJoin(self.edges.agg(F.count("*").alias("edgecount")))
            .crossJoin(files)
        )  # three rows of one

    def dangling_edges(self) -> DataFrame:
        """Edges whose target is no node of their project."""
        ids = self.nodes.select("project", F.col("id").alias("targetid"))
        return self.edges.join(ids, ["project", "targetid"], "left_anti").select(*self.edges.columns)

    def degrees(self) -> DataFrame:
        """Incoming and outgoing edges of every node, zero included."""
        out = self.edges.groupBy("project", F.col("sourceid").alias("id")).agg(F.count("*").alias("out_degree"))
        into = self.edges.where(F.col("targetid").isNotNull()).groupBy("project", F.col("targetid").alias("id")).agg(F.count("*").alias("in_degree"))
        return (
            self.nodes.select("project", "id", "type")
            .join(out, KEY, "left").join(into, KEY, "left")
            .fillna(0, ["out_degree", "in_degree"])
        )

    def resolve_edges(self) -> DataFrame:
        """Edges with bare-name targets pointed at the only node of that name in
        the project; an extension, never applied by default."""
        names = (
            self.nodes.where(F.col("type") != "file")
            .groupBy("project", F.col("name").alias("targetid"))
            .agg(F.count("*").alias("n"), F.min("id").alias("resolved"))
            .where("n = 1")
            .select("project", "targetid", "resolved")
        )
        return self.edges.join(names, ["project", "targetid"], "left").select(
            *[F.coalesce("resolved", "targetid").alias(c) if c == "targetid" else F.col(c) for c in self.edges.columns]
        )

    def create_views(self, prefix: str = "") -> None:
        """Register the tables for SQL."""
        self.nodes.createOrReplaceTempView(f"{prefix}nodes")
        self.edges.createOrReplaceTempView(f"{prefix}edges")
