"""Connectors, store, engine, server, command line and stream."""

from __future__ import annotations

import io
import json
import os

import pytest

from skein.__main__ import main
from skein.build import build
from skein.engine import GraphEngine
from skein.operators.graph import Graph
from skein.schema import EDGES, FILES, NODES
from skein.serve import TOOLS, Server, serve
from skein.sources import jsonl
from skein.sources.files import extension_of, read_files, walk
from skein.streaming.rescan import current, file_stream, rescan


def small(spark):
    sem = ("does", "low", ["x"], "time", "agent")
    nodes = [(i, "", n, "function", n.split("::")[1], n.split("::")[0], 1, 1, "named", "f", sem if i == 1 else None) for i, n in enumerate(["b.sh::b", "a.sh::a", "B.sh::c", "_x.sh::d"])]
    edges = [(0, "", "b.sh::b", "a.sh::a", "CALLS", "b.sh", 1), (1, "", "a.sh::a", "gone", "CALLS", "a.sh", 2)]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES))


def test_round_trip_order_and_shape(spark, tmp_path):
    out = str(tmp_path / "g")
    jsonl.write_graph(small(spark), out)
    lines = [json.loads(x) for x in open(f"{out}/entities.jsonl")]
    assert [x["filePath"] for x in lines] == ["_x.sh", "a.sh", "b.sh", "B.sh"]
    assert "semantic" not in lines[0] and list(lines[1]["semantic"]) == ["summary", "complexity", "domainConcepts", "enrichedAt", "enrichedBy"]
    assert list(lines[0]) == ["id", "type", "name", "filePath", "startLine", "endLine", "exportType", "signature"]
    meta = json.load(open(f"{out}/metadata.json"))
    assert (meta["version"], meta["nodeCount"], meta["edgeCount"], meta["fileCount"]) == ("0.1.0", 4, 2, 4)
    again = jsonl.read_graph(spark, out)
    assert again.stats().first().asDict() == {"nodecount": 4, "edgecount": 2, "filecount": 4}
    assert jsonl.read_metadata(spark, out).first()["nodeCount"] == 4
    assert again.node("a.sh::a").first()["semantic"]["enrichedat"] == "time"


def test_import_strict_and_lenient(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        jsonl.read_graph(spark, str(tmp_path / "none"))
    assert jsonl.read_graph(spark, str(tmp_path / "none"), strict=False).stats().first()["nodecount"] == 0
    row = {"id": "a", "type": "file", "name": "1", "filePath": "a", "startLine": 1, "endLine": 1, "exportType": "none", "signature": "a"}
    (tmp_path / "entities.jsonl").write_text(json.dumps(row) + "\n\n" + json.dumps(row | {"name": "2"}) + "\n")
    assert jsonl.read_graph(spark, str(tmp_path)).nodes.first()["name"] == "1"
    assert jsonl.read_graph(spark, str(tmp_path), strict=False).nodes.first()["name"] == "2"
    (tmp_path / "relations.jsonl").write_text("not json\n")
    with pytest.raises(Exception):
        jsonl.read_graph(spark, str(tmp_path)).edges.collect()


def test_empty_export_and_guard(spark, tmp_path):
    empty = Graph(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))
    jsonl.write_graph(empty, str(tmp_path / "e"))
    assert (tmp_path / "e/entities.jsonl").read_text() == "\n"
    assert jsonl.read_graph(spark, str(tmp_path / "e")).stats().first()["nodecount"] == 0
    with pytest.raises(ValueError):
        jsonl.write_graph(empty, str(tmp_path / "../x"))


def test_parquet(spark, tmp_path):
    jsonl.write_parquet(Graph(small(spark).nodes.replace("", "p", "project"), small(spark).edges.replace("", "p", "project")), str(tmp_path))
    assert jsonl.read_parquet(spark, str(tmp_path)).stats().first()["nodecount"] == 4


@pytest.fixture()
def tree(tmp_path):
    for path, text in {
        "src/a.ts": "export function go() { helper(); }\n", "src/types.d.ts": "declare const x;\n", "src/B.TS": "x\n", "node_modules/m.ts": "function no() {}\n",
        "src/dist/n.py": "x = 1\n", "tool.py": "def run():\n    go()\n", "README": "hi\n", ".py": "x\n",
    }.items():
        f = tmp_path / path
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    os.symlink(tmp_path / "tool.py", tmp_path / "link.py")
    return tmp_path


def test_walk_and_read(spark, tree):
    assert [os.path.relpath(p, tree) for p in walk(str(tree))] == ["src/a.ts", "tool.py"]
    assert len(walk(str(tree), max_files=1)) == 1 and walk(str(tree / "nowhere")) == []
    rows = read_files(spark, str(tree)).orderBy("seq").collect()
    assert [(r["relpath"], r["lang"]) for r in rows] == [("src/a.ts", "typescript"), ("tool.py", "python")]
    exts = spark.createDataFrame([("a/.py",), ("a/b.test.ts",), ("x",), ("d.d/x",)], "p string")
    assert [r[0] for r in exts.select(extension_of(exts["p"])).collect()] == ["", ".ts", "", ""]


def test_build_and_import(spark, tree, tmp_path):
    out = str(tmp_path / "out")
    first = build(spark, str(tree), out)
    assert (first.files, first.nodes, first.edges) == (2, 4, 2)
    g = jsonl.read_graph(spark, out)
    sem = ("s", "low", [], "t", "manual")
    rows = [tuple(r)[:-1] + (sem if r["name"] == "run" else None,) for r in g.nodes.collect()]
    extra = spark.createDataFrame([(99, "", "tool.py::run", "src/a.ts::go", "CALLS", "tool.py", 2)], EDGES)
    jsonl.write_graph(Graph(spark.createDataFrame(rows, NODES), g.edges.unionByName(extra)), out)
    assert build(spark, str(tree), out, use_import=True).preserved == 1
    again = jsonl.read_graph(spark, out)
    assert again.node("tool.py::run").first()["semantic"]["summary"] == "s" and again.edges.count() == 2
    jsonl.write_graph(Graph(spark.createDataFrame(rows, NODES), g.edges.unionByName(extra)), out)
    assert build(spark, str(tree), out, use_import=True, preserve_edges=True).edges == 3


def test_command_line(spark, tree, tmp_path, capsys):
    assert main(["--help"]) == main(["-h"]) == 0
    assert main([]) == main(["nothing"]) == main(["build"]) == main(["serve"]) == 1
    assert main(["build", str(tmp_path / "missing")]) == 1
    (tmp_path / "bare").mkdir()
    assert main(["build", str(tmp_path / "bare"), str(tmp_path / "o")]) == 0 and not (tmp_path / "o").exists()


@pytest.fixture()
def workspace(spark, tmp_path):
    folder = tmp_path / "Projects/demo/.beads/graph"
    jsonl.write_graph(small(spark), str(folder))
    repo = tmp_path / "Projects/demo/repo"
    repo.mkdir(parents=True)
    (repo / "a.sh").write_text("a() { b; }\n")
    return tmp_path


def call(server, tool, **arguments):
    reply = server.handle({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": tool, "arguments": arguments}})
    if "error" in reply:
        return reply["error"], None
    return json.loads(reply["result"]["content"][0]["text"]), reply["result"].get("isError", False)


def test_tools(spark, workspace):
    s = Server(GraphEngine(spark, str(workspace)))
    p = {"projectName": "demo"}
    assert [n["id"] for n in call(s, "graph_query", **p)[0]] == ["_x.sh::d", "a.sh::a", "b.sh::b", "B.sh::c"]
    assert [n["id"] for n in call(s, "graph_query", **p, namePattern="x")[0]] == ["a.sh::a"]
    assert call(s, "graph_query", **p, nodeType="class")[0] == []
    assert len(call(s, "graph_edges", **p, nodeId="a.sh::a")[0]) == 2
    hit, bad = call(s, "graph_impact_analysis", **p, nodeId="a.sh::a", depth=99)
    assert (hit["totalAffected"], hit["depth"], hit["paths"], hit["affectedFiles"], bad) == (1, 99, [["a.sh::a", "b.sh::b"]], ["b.sh"], False)
    assert call(s, "graph_impact_analysis", **p, nodeId="zz") == ({"error": "Node not found: zz"}, True)
    b, _ = call(s, "graph_context_bundle", **p, nodeId="a.sh::a")
    assert b["sourceCode"] == "a() { b; }" and b["target"]["summary"] == "does" and [c["id"] for c in b["callers"]] == ["b.sh::b"]
    assert call(s, "graph_context_bundle", **p, nodeId="zz")[1] is True
    done, bad = call(s, "graph_enrich", **p, nodeId="b.sh::b", summary="new", complexity="high", domainConcepts=["q"])
    assert done["success"] and done["updatedNode"]["semantic"]["enrichedBy"] == "agent" and not bad
    assert call(s, "graph_enrich", **p, nodeId="zz", summary="", complexity="low", domainConcepts=[])[1] is True
    assert call(s, "graph_enrich", **p, nodeId="b.sh::b", summary="", complexity="huge", domainConcepts=[])[1] is None
    edge = {"sourceId": "b.sh::b", "targetId": "B.sh::c", "relation": "CALLS"}
    assert call(s, "graph_add_edges", **p, edges=[edge, edge, edge | {"targetId": "zz"}])[0]["added"] == 1
    assert call(s, "graph_add_edges", **p, edges=[edge]) == ({"added": 0, "skipped": 1, "errors": []}, False)
    assert call(s, "graph_add_edges", **p, edges=[edge | {"sourceId": "zz"}])[1] is True
    assert call(s, "graph_add_edges", **p, edges=[edge | {"relation": "INHERITS"}])[1] is None
    assert json.loads(s.read_resource("graph://demo/metadata")["contents"][0]["text"])["edgeCount"] == 3
    assert s.read_resource("graph://none/entities")["contents"][0]["text"] == ""
    assert call(s, "graph_query", projectName="../x")[1] is None and call(s, "nothing")[1] is None
    assert not s.engine.is_stale("demo") and s.engine.is_stale("none")


def test_serve_loop(spark, workspace):
    asks = [{"jsonrpc": "2.0", "id": 1, "method": "initialize"}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 3, "method": "what"}]
    out = io.StringIO()
    serve(spark, str(workspace), io.StringIO("\n".join(map(json.dumps, asks)) + "\n{bad\n"), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [r["id"] for r in replies] == [1, 2, 3, None]
    assert {t["name"] for t in replies[1]["result"]["tools"]} == set(TOOLS) and replies[2]["error"]["code"] == -32601


def test_store_evicts_the_oldest(spark, workspace):
    store = GraphEngine(spark, str(workspace)).store
    for name in ("demo", "b", "c", "demo", "d"):
        store.get(name)
    assert [k[1] for k in store.cached] == ["c", "demo", "d"]
    store.flush("demo")
    assert [k[1] for k in store.cached] == ["c", "d"]


def test_stream_of_changed_files(spark, tmp_path):
    drop, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    one = [(1, "p", "a.py", ".py", "python", "def f():\n    g()\n"), (2, "p", "b.py", ".py", "python", "def h(): pass\n")]
    for rows in (one, [(1, "p", "a.py", ".py", "python", "def f2(): pass\n")]):
        spark.createDataFrame(rows, FILES).write.mode("append").parquet(drop)
        rescan(file_stream(spark, drop), out, ck).awaitTermination()
    g = current(spark, out)
    assert sorted(r["id"] for r in g.nodes.collect()) == ["a.py", "a.py::f2", "b.py", "b.py::h"] and g.edges.count() == 0
