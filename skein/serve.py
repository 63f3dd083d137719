"""JSON-RPC over standard input and output: six tools and three resources."""

from __future__ import annotations

import json
import sys
from typing import IO

from pyspark.sql import SparkSession

from skein.engine import GraphEngine
from skein.schema import COMPLEXITIES, REQUEST_RELATIONS
from skein.sources import jsonl
from skein.workspace import freeing

_TEXT, _LIST = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
_EDGE = {
    "type": "object",
    "properties": {"sourceId": _TEXT, "targetId": _TEXT, "relation": {"enum": list(REQUEST_RELATIONS)}, "sourceFile": _TEXT, "sourceLine": {"type": "number"}},
    "required": ["sourceId", "targetId", "relation"],
}

#: name: (method, what it does, parameters, required ones)
TOOLS = {
    "graph_query": ("query_answer", "Nodes by type and by part of a name or concept", {"projectName": _TEXT, "nodeType": _TEXT, "namePattern": _TEXT}, ["projectName"]),
    "graph_edges": ("edges_answer", "Edges out of and into a node", {"projectName": _TEXT, "nodeId": _TEXT}, ["projectName", "nodeId"]),
    "graph_enrich": (
        "enrich_answer", "Set a node's semantic record",
        {"projectName": _TEXT, "nodeId": _TEXT, "summary": _TEXT, "complexity": {"enum": list(COMPLEXITIES)}, "domainConcepts": _LIST},
        ["projectName", "nodeId", "summary", "complexity", "domainConcepts"],
    ),
    "graph_impact_analysis": (
        "impact_answer", "Nodes that depend on a node, or that it depends on, with paths",
        {"projectName": _TEXT, "nodeId": _TEXT, "depth": {"type": "number"}, "direction": {"enum": ["upstream", "downstream", "both"]}}, ["projectName", "nodeId"],
    ),
    "graph_context_bundle": ("bundle_answer", "A node's source, callers, callees, imports and tests", {"projectName": _TEXT, "nodeId": _TEXT}, ["projectName", "nodeId"]),
    "graph_add_edges": ("add_edges_answer", "Add edges between known nodes", {"projectName": _TEXT, "edges": {"type": "array", "items": _EDGE}}, ["projectName", "edges"]),
}
RESOURCES = ("entities", "relations", "metadata")
SCHEME = "graph://"


def _version() -> str:
    from skein import __version__

    return __version__


class Server:
    def __init__(self, engine: GraphEngine):
        self.engine = engine

    def call_tool(self, name: str, arguments: dict) -> dict:
        if name not in TOOLS:
            raise KeyError(f"Unknown tool: {name}")
        method, _, known, required = TOOLS[name]
        missing = [k for k in required if arguments.get(k) is None]
        unknown = [k for k in arguments if k not in known]
        if missing or unknown:
            raise ValueError(f"Invalid arguments: missing {missing}, unknown {unknown}")
        with freeing():
            answer, failed = getattr(self.engine, method)(**{k: v for k, v in arguments.items() if v is not None})
        out = {"content": [{"type": "text", "text": json.dumps(answer, indent=2, ensure_ascii=False)}]}
        return out | {"isError": True} if failed else out

    def read_resource(self, uri: str) -> dict:
        project, _, name = uri.removeprefix(SCHEME).rpartition("/")
        if not uri.startswith(SCHEME) or name not in RESOURCES:
            raise KeyError(f"Unknown resource: {uri}")
        text, kind = jsonl.resource(self.engine.spark, self.engine.store.folder(project), name)
        return {"contents": [{"uri": uri, "mimeType": kind, "text": text}]}

    def handle(self, request: dict) -> dict | None:
        method, params = request.get("method"), request.get("params") or {}
        try:
            if method == "initialize":
                result = {
                    "protocolVersion": params.get("protocolVersion", "2024-11-05"),
                    "capabilities": {"tools": {}, "resources": {}},
                    "serverInfo": {"name": "skein", "version": _version()},
                }
            elif method == "tools/list":
                result = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (_, d, p, r) in TOOLS.items()]}
            elif method == "tools/call":
                result = self.call_tool(params.get("name", ""), params.get("arguments") or {})
            elif method == "resources/templates/list":
                result = {"resourceTemplates": [{"uriTemplate": f"{SCHEME}{{projectName}}/{n}", "name": n} for n in RESOURCES]}
            elif method == "resources/list":
                result = {"resources": []}
            elif method == "resources/read":
                result = self.read_resource(params.get("uri", ""))
            elif method == "ping":
                result = {}
            elif "id" not in request:
                return None
            else:
                return {"jsonrpc": "2.0", "id": request["id"], "error": {"code": -32601, "message": f"Unknown method: {method}"}}
        except (ValueError, KeyError, TypeError) as e:
            return {"jsonrpc": "2.0", "id": request.get("id"), "error": {"code": -32602, "message": str(e)}}
        return {"jsonrpc": "2.0", "id": request["id"], "result": result} if "id" in request else None


def serve(spark: SparkSession, root: str, lines: IO[str] | None = None, out: IO[str] | None = None) -> None:
    """Answer one request a line until the input ends."""
    server, out = Server(GraphEngine(spark, root)), out or sys.stdout
    for line in lines or sys.stdin:
        if not line.strip():
            continue
        try:
            reply = server.handle(json.loads(line))
        except json.JSONDecodeError as e:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}}
        if reply is not None:
            out.write(json.dumps(reply, ensure_ascii=False) + "\n")
            out.flush()
