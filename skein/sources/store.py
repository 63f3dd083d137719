"""Graphs of a workspace, kept in memory least-recently-used.

The cache is keyed by workspace and project.  Writes go to a new file that
replaces the old one and refresh both the metadata and the cached graph; there
may be one writer at a time.
"""

from __future__ import annotations

import os
import re
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession

from skein.operators import mutate
from skein.operators.graph import Graph
from skein.sources import jsonl
from skein.workspace import materialise

CAPACITY = 3  # fixed value: graphs kept
_LAYOUT = "Projects/{project}/.beads/graph"  # fixed value: where a project's graph lies
_SOURCES = "Projects/{project}/repo"  # fixed value: where its sources lie


class GraphStore:
    def __init__(self, spark: SparkSession, root: str, capacity: int = CAPACITY):
        self.spark, self.root, self.capacity = spark, root, capacity
        self.cached: OrderedDict[tuple[str, str], Graph] = OrderedDict()

    def _inside(self, layout: str, project: str) -> str:
        if not project or re.search(r"[/\\]|\.\.", project):
            raise ValueError(f"Not a project name: {project!r}")
        return os.path.join(self.root, layout.format(project=project))

    def folder(self, project: str) -> str:
        return self._inside(_LAYOUT, project)

    def sources(self, project: str) -> str:
        return self._inside(_SOURCES, project)

    def get(self, project: str) -> Graph:
        """The project's graph; an empty one where nothing is stored."""
        key = (self.root, project)
        if key in self.cached:
            self.cached.move_to_end(key)
            return self.cached[key]
        while len(self.cached) >= self.capacity:
            _, old = self.cached.popitem(last=False)
            self._drop(old)
        g = jsonl.read_graph(self.spark, self.folder(project), project, strict=False)
        self.cached[key] = Graph(g.nodes.cache(), g.edges.cache())
        return self.cached[key]

    @staticmethod
    def _drop(graph: Graph) -> None:
        graph.nodes.unpersist()
        graph.edges.unpersist()

    def flush(self, project: str) -> None:
        graph = self.cached.pop((self.root, project), None)
        if graph:
            self._drop(graph)

    def save_nodes(self, project: str, nodes: DataFrame) -> None:
        edges = self.get(project).edges
        jsonl.save_nodes(nodes, self.folder(project))
        jsonl.write_metadata(Graph(nodes, edges), self.folder(project))
        self.flush(project)

    def save_edges(self, project: str, edges: DataFrame) -> None:
        nodes = self.get(project).nodes
        jsonl.save_edges(edges, self.folder(project))
        jsonl.write_metadata(Graph(nodes, edges), self.folder(project))
        self.flush(project)

    def add_edges(self, project: str, requests: DataFrame) -> DataFrame:
        """Judge and add requests; written only if one was added."""
        after, judged = mutate.add_edges(self.get(project), requests)
        judged = materialise(judged, "judged")
        if not judged.where("status = 'added'").isEmpty():
            self.save_edges(project, materialise(after.edges, "edges"))
        return judged
