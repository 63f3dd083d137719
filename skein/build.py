"""Building a project's graph from a source tree."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import SparkSession

from skein.functions.languages import Registry
from skein.operators import mutate
from skein.operators.extract import build_graph
from skein.operators.graph import Graph
from skein.sources import jsonl
from skein.sources.files import read_files
from skein.sources.fs import Files
from skein.workspace import materialise


@dataclass
class BuildResult:
    files: int
    nodes: int = 0
    edges: int = 0
    preserved: int = 0
    written: bool = False


def build(spark: SparkSession, target: str, output: str, use_import: bool = False, preserve_edges: bool = False, registry: Registry | None = None) -> BuildResult:
    """Scan ``target`` and export its graph to ``output``.

    With ``use_import`` semantic records of an earlier export are carried over by
    id; edges injected since are lost unless ``preserve_edges`` keeps those whose
    key the scan does not give.  Nothing is written if there is no file to scan.
    """
    if not os.path.isdir(target):
        raise FileNotFoundError(f"Target directory not found: {target}")
    if ".." in output:
        raise ValueError(f"Output directory must not contain '..': {output}")
    files = materialise(read_files(spark, target, registry=registry), "files")
    n_files = files.count()
    if not n_files:
        return BuildResult(0)
    fresh = build_graph(files, registry)
    graph = Graph(materialise(fresh.nodes, "nodes"), materialise(fresh.edges, "edges"))
    preserved = 0
    if use_import and Files(spark).is_dir(output):
        old = jsonl.read_graph(spark, output, strict=True)
        old = Graph(materialise(old.nodes, "old"), materialise(old.edges, "old"))
        preserved = mutate.preserved_count(graph.nodes, old.nodes).first()[0]
        edges = graph.edges
        if preserve_edges:
            known = edges.select(*mutate.EDGE_KEY).distinct()
            edges = edges.unionByName(old.edges.join(known, mutate.EDGE_KEY, "left_anti").select(*edges.columns))
        graph = Graph(mutate.merge_semantic(graph.nodes, old.nodes), edges)
    jsonl.write_graph(graph, output)
    s = graph.stats().first()
    return BuildResult(n_files, s["nodecount"], s["edgecount"], preserved, True)
