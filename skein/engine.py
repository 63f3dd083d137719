"""The query API over a workspace of projects, and its JSON answers."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import bundle, mutate, traverse
from skein.operators.graph import Graph
from skein.schema import COMPLEXITIES, EDGE_FIELDS, NODE_FIELDS, REQUEST_RELATIONS, to_interchange
from skein.sources import jsonl
from skein.sources.files import read_files
from skein.sources.store import GraphStore
from skein.workspace import materialise


def _records(df: DataFrame) -> list[dict]:
    """Rows as plain objects in order, null fields left out."""
    return [json.loads(r[0]) for r in df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).collect()]


class GraphEngine:
    """Methods give DataFrames; ``*_answer`` methods give what the protocol returns."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, GraphStore(spark, root)

    def graph(self, project: str) -> Graph:
        return self.store.get(project)

    # -- queries ------------------------------------------------------------

    def query(self, project: str, node_type: str | None = None, pattern: str | None = None) -> DataFrame:
        g = self.graph(project)
        if pattern:
            return g.in_match_order(g.search(pattern, node_type)).drop("match_kind", "match_key")
        nodes = g.nodes.where(F.col("type") == node_type) if node_type else g.nodes
        return nodes.orderBy("seq")

    def edges(self, project: str, node_id: str) -> DataFrame:
        return self.graph(project).connected_edges(node_id).orderBy(F.desc("direction"), "seq").drop("direction")

    def _start(self, project: str, node_id: str) -> DataFrame:
        return self.spark.createDataFrame([(project, node_id)], "project string, id string")

    def impact(self, project: str, node_id: str, depth: float = 2, direction: str = "upstream") -> DataFrame:
        return traverse.impact_report(self.graph(project), self._start(project, node_id), depth=depth, direction=direction).orderBy("rank")

    def context_bundle(self, project: str, node_id: str, files: DataFrame | None = None) -> DataFrame:
        g = self.graph(project)
        if files is None:
            files = read_files(self.spark, self.store.sources(project), project)
        return bundle.context_bundles(g, self._start(project, node_id), files)

    def enrich(self, project: str, updates: DataFrame) -> DataFrame:
        """Apply and store a batch of updates; one verdict a row."""
        after, judged = mutate.enrich(self.graph(project), updates.withColumn("project", F.lit(project)))
        judged = materialise(judged, "judged")
        if not judged.where("success").isEmpty():
            self.store.save_nodes(project, materialise(after.nodes, "nodes"))
        return judged

    def add_edges(self, project: str, requests: DataFrame) -> DataFrame:
        filled = mutate.edge_defaults(self.graph(project), requests.withColumn("project", F.lit(project)))
        return self.store.add_edges(project, filled)

    def is_stale(self, project: str, days: int = 7) -> bool:
        """Whether the metadata is older than ``days`` or missing."""
        created = json.loads(jsonl.resource(self.spark, self.store.folder(project), "metadata")[0]).get("createdAt")
        if not created:
            return True
        return datetime.now(timezone.utc) - datetime.fromisoformat(created.replace("Z", "+00:00")) > timedelta(days=days)

    # -- answers of the protocol --------------------------------------------

    def _nodes_json(self, df: DataFrame) -> list[dict]:
        return _records(to_interchange(df, NODE_FIELDS))

    def query_answer(self, projectName: str, nodeType: str | None = None, namePattern: str | None = None):
        return self._nodes_json(self.query(projectName, nodeType, namePattern)), False

    def edges_answer(self, projectName: str, nodeId: str):
        return _records(to_interchange(self.edges(projectName, nodeId), EDGE_FIELDS)), False

    def enrich_answer(self, projectName: str, nodeId: str, summary: str, complexity: str, domainConcepts: list[str]):
        if complexity not in COMPLEXITIES:
            raise ValueError("complexity must be one of " + ", ".join(COMPLEXITIES))
        updates = self.spark.createDataFrame([(nodeId, summary, complexity, domainConcepts)], "id string, summary string, complexity string, domainconcepts array<string>")
        verdict = self.enrich(projectName, updates).first()
        if not verdict["success"]:
            return {"success": False, "error": verdict["error"]}, True
        return {"success": True, "updatedNode": self._nodes_json(self.graph(projectName).node(nodeId))[0]}, False

    def impact_answer(self, projectName: str, nodeId: str, depth: float = 2, direction: str = "upstream"):
        target = self.graph(projectName).node(nodeId).first()
        if target is None:
            return {"error": f"Node not found: {nodeId}"}, True
        brief = lambda r: {"id": r["id"], "name": r["name"], "type": r["type"], "filePath": r["filepath"]}
        rows = self.impact(projectName, nodeId, depth, direction).collect()  # at most MAX_NODES rows
        return {
            "targetNode": brief(target),
            "affectedNodes": [brief(r) for r in rows],
            "affectedFiles": list(dict.fromkeys(r["filepath"] for r in rows)),
            "totalAffected": len(rows),
            "depth": depth,
            "direction": direction,
            "paths": [list(r["path"]) for r in rows],
        }, False

    def bundle_answer(self, projectName: str, nodeId: str):
        row = self.context_bundle(projectName, nodeId).first()
        if row is None:
            return {"error": f"Node not found: {nodeId}"}, True
        brief = lambda n, *keys: {k: n[k.lower()] for k in keys}
        return {
            "target": {**brief(row, "id", "name", "type", "filePath", "startLine", "endLine"), "summary": row["summary"]},
            "sourceCode": row["source_code"],
            "truncated": row["truncated"],
            "callers": [brief(n, "id", "name", "type", "filePath") for n in row["callers"]],
            "callees": [brief(n, "id", "name", "type", "filePath") for n in row["callees"]],
            "imports": [brief(e, *EDGE_FIELDS) for e in row["imports"]],
            "relatedTests": [brief(n, "id", "name", "filePath") for n in row["related_tests"]],
            "warnings": list(row["warnings"]),
        }, False

    def add_edges_answer(self, projectName: str, edges: list[dict]):
        for e in edges:
            if e.get("relation") not in REQUEST_RELATIONS:
                raise ValueError("relation must be one of " + ", ".join(REQUEST_RELATIONS))
        rows = [(i, e["sourceId"], e["targetId"], e["relation"], e.get("sourceFile"), e.get("sourceLine")) for i, e in enumerate(edges)]
        requests = self.spark.createDataFrame(rows, "pos bigint, sourceid string, targetid string, relation string, sourcefile string, sourceline int")
        judged = self.add_edges(projectName, requests).orderBy("pos").collect()  # as many rows as asked for
        count = lambda s: sum(r["status"] == s for r in judged)
        errors = [{"sourceId": r["sourceid"], "targetId": r["targetid"], "reason": r["reason"]} for r in judged if r["status"] == "error"]
        return {"added": count("added"), "skipped": count("skipped"), "errors": errors}, bool(errors) and not count("added")
