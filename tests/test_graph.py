"""Lookup, search, traversal, bundles and mutations on small graphs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from skein.operators import bundle, mutate
from skein.operators.graph import Graph, dedupe_first, dedupe_last
from skein.operators.traverse import impact, impact_report, affected_files
from skein.schema import EDGES, FILES, NODES, semantic_error


def node(i, id_, name=None, kind="function", path=None, semantic=None, start=1, end=1, project="p"):
    return (i, project, id_, kind, name or id_, path or f"src/{id_}.ts", start, end, "named", f"function {id_}", semantic)


def graph(spark, nodes, edges):
    rows = [(i, "p", *e[:3], e[3] if len(e) > 3 else f"{e[0]}.ts", 1) for i, e in enumerate(edges)]
    return Graph(spark.createDataFrame(nodes, NODES), spark.createDataFrame(rows, EDGES))


def starts(spark, *ids):
    return spark.createDataFrame([("p", i) for i in ids], "project string, id string")


@pytest.fixture(scope="module")
def chain(spark):
    """A calls B calls C calls D, B calls E, F imports B."""
    names = "ABCDEF"
    edges = [("A", "B", "CALLS"), ("B", "C", "CALLS"), ("C", "D", "CALLS"), ("B", "E", "CALLS"), ("F", "B", "IMPORTS_FROM")]
    return graph(spark, [node(i, n) for i, n in enumerate(names)], edges)


def reached(spark, g, start, depth, direction="upstream"):
    return {r["id"]: r for r in impact(g, starts(spark, start), depth, direction).collect()}


def test_upstream(spark, chain):
    assert set(reached(spark, chain, "B", 1)) == {"A", "F"}


def test_downstream_with_paths(spark, chain):
    found = reached(spark, chain, "B", 2, "downstream")
    assert set(found) == {"C", "E", "D"}
    assert list(found["D"]["path"]) == ["B", "C", "D"]


def test_both(spark, chain):
    assert set(reached(spark, chain, "B", 2, "both")) == {"A", "F", "C", "E", "D"}


def test_unknown_start_depth_zero_and_bad_direction(spark, chain):
    assert reached(spark, chain, "nope", 2) == {}
    assert reached(spark, chain, "B", 0) == {}
    with pytest.raises(ValueError):
        impact(chain, starts(spark, "B"), 2, "sideways")


def test_depth_is_clamped_and_cycles_end(spark):
    ids = [f"n{i}" for i in range(9)]
    edges = [(a, b, "CALLS") for a, b in zip(ids, ids[1:])] + [("n8", "n0", "CALLS"), ("n3", "n3", "CALLS")]
    g = graph(spark, [node(i, n) for i, n in enumerate(ids)], edges)
    assert set(reached(spark, g, "n0", 99, "downstream")) == {"n1", "n2", "n3", "n4", "n5"}


def test_cap_keeps_the_first_neighbours(spark):
    nodes = [node(0, "hub")] + [node(i, f"x{i:03}") for i in range(1, 151)]
    g = graph(spark, nodes, [(f"x{i:03}", "hub", "CALLS") for i in range(150, 0, -1)])
    rows = impact(g, starts(spark, "hub"), 1).orderBy("rank").collect()
    assert [r["id"] for r in rows] == [f"x{i:03}" for i in range(150, 50, -1)]


def model_bfs(nodes, edges, start, depth, direction, cap=100):
    if start not in nodes:
        return []
    seen, queue, out = {start}, [(start, 0, [start])], []
    while queue and len(out) < cap:
        at, level, path = queue.pop(0)
        if level >= depth:
            continue
        steps = [e[0] for e in edges if e[1] == at] if direction != "downstream" else []
        steps += [e[1] for e in edges if e[0] == at] if direction != "upstream" else []
        for nxt in steps:
            if len(out) >= cap:
                break
            if nxt in seen or nxt not in nodes:
                continue
            seen.add(nxt)
            out.append((nxt, path + [nxt]))
            queue.append((nxt, level + 1, path + [nxt]))
    return out


@pytest.mark.parametrize("case", range(3))
def test_bfs_equals_a_queue(spark, case):
    rng = random.Random(case)
    ids = [f"n{i}" for i in range(rng.choice([8, 40]))]
    pool = [*ids, "gone1", "gone2"]
    edges = [(rng.choice(pool), rng.choice(pool), "CALLS") for _ in range(len(ids) * 2)]
    g = graph(spark, [node(i, n) for i, n in enumerate(ids)], edges)
    direction = ["upstream", "downstream", "both"][case]
    picked = ids[:3]
    rows = impact(g, starts(spark, *picked), 3, direction, cap=10).orderBy("start_id", "rank").collect()
    for s in picked:
        got = [(r["id"], list(r["path"])) for r in rows if r["start_id"] == s]
        assert got == model_bfs(set(ids), edges, s, 3, direction, cap=10)


def test_report_and_files(spark, chain):
    report = impact_report(chain, starts(spark, "D"), depth=2)
    assert {(r["id"], r["relation"]) for r in report.collect()} == {("C", "CALLS"), ("B", "CALLS")}
    assert [r["filepath"] for r in affected_files(report).orderBy("first_rank").collect()] == ["src/C.ts", "src/B.ts"]


SEM = ("does", "low", ["Test", "other"], "time", "agent")


@pytest.fixture(scope="module")
def two(spark):
    return graph(spark, [node(1, "src/X.ts::A", "A", "class"), node(2, "src/X.ts::B", "B", "class", semantic=SEM)], [("src/X.ts::A", "src/X.ts::B", "CALLS"), ("src/X.ts::B", "src/X.ts::B", "CALLS")])


def test_lookup_and_search(two):
    ids = lambda df: [r["id"][-1] for r in df.collect()]
    assert ids(two.node("src/X.ts::A")) == ["A"] and ids(two.node("x")) == []
    assert ids(two.search("a")) == ["A"] and ids(two.search("test")) == ["B"]
    assert ids(two.search("b", "class")) == ["B"] and ids(two.search("b", "function")) == []
    assert ids(two.search("%")) == [] and ids(two.search("_")) == []
    assert ids(two.in_match_order(two.search("t"))) == ["B"]


def test_connected_edges_count_a_loop_twice(two):
    assert two.connected_edges("src/X.ts::B").count() == 3
    assert two.connected_edges("unknown").count() == 0


def test_induced_edges_and_stats(two):
    assert two.induced_edges(two.nodes).count() == 2
    assert two.induced_edges(two.node("src/X.ts::A")).count() == 0
    assert two.stats().first().asDict() == {"nodecount": 2, "edgecount": 2, "filecount": 2}


def test_dedupe(spark):
    rows = spark.createDataFrame([node(1, "a", "one"), node(2, "b"), node(3, "a", "two")], NODES)
    first = {r["id"]: (r["name"], r["seq"]) for r in dedupe_first(rows).collect()}
    last = {r["id"]: (r["name"], r["seq"]) for r in dedupe_last(rows).collect()}
    assert first == {"a": ("one", 1), "b": ("b", 2)} and last == {"a": ("two", 1), "b": ("b", 2)}


def test_add_nodes_and_resolve(spark, two):
    more = two.add_nodes(spark.createDataFrame([node(9, "src/X.ts::A", "renamed", "class"), node(10, "c")], NODES))
    assert {r["name"] for r in more.nodes.collect()} == {"renamed", "B", "c"}
    loose = two.append_edges(spark.createDataFrame([(9, "p", "src/X.ts::A", "B", "CALLS", "f", 1), (10, "p", "src/X.ts::A", "zzz", "CALLS", "f", 1)], EDGES))
    assert [r["targetid"] for r in loose.resolve_edges().where("seq >= 9").orderBy("seq").collect()] == ["src/X.ts::B", "zzz"]


# --- bundle ----------------------------------------------------------------


@pytest.fixture(scope="module")
def greeter(spark):
    nodes = [
        node(1, "g.ts", "g.ts", "file", "g.ts", end=9), node(2, "app.ts", "app.ts", "file", "app.ts"),
        node(3, "g.ts::greet", "greet", path="g.ts", start=2, end=4), node(4, "g.ts::farewell", "farewell", path="g.ts", start=6, end=6),
        node(5, "app.ts::main", "main", path="app.ts"), node(6, "test/g.test.ts::greet works", "greet works", path="test/g.test.ts"),
        node(7, "tests/other.ts::greet", "greet", path="tests/other.ts"), node(8, "long.ts::big", "big", path="long.ts", end=300),
    ]
    edges = [("app.ts::main", "g.ts::greet", "CALLS"), ("app.ts::main", "g.ts::greet", "CALLS"), ("g.ts::greet", "g.ts::farewell", "CALLS"), ("g.ts", "./gone", "IMPORTS_FROM"), ("g.ts::greet", "nowhere", "CALLS")]
    return graph(spark, nodes, edges)


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(1, "p", "g.ts", ".ts", "typescript", "\n".join(f"line {i}" for i in range(1, 9))), (2, "p", "long.ts", ".ts", "typescript", "\n".join(map(str, range(1, 301)))), (3, "p", "app.ts", ".ts", "typescript", None)]
    return spark.createDataFrame(rows, FILES)


def test_bundle(spark, greeter, texts):
    rows = {r["id"]: r for r in bundle.context_bundles(greeter, starts(spark, "g.ts::greet", "app.ts::main", "long.ts::big", "tests/other.ts::greet", "unknown"), texts).collect()}
    assert set(rows) == {"g.ts::greet", "app.ts::main", "long.ts::big", "tests/other.ts::greet"}
    greet = rows["g.ts::greet"]
    assert [n["name"] for n in greet["callers"]] == ["main", "main"]
    assert [n["name"] for n in greet["callees"]] == ["farewell"]
    assert [e["targetid"] for e in greet["imports"]] == ["./gone"]
    assert [n["name"] for n in greet["related_tests"]] == ["greet works"]
    assert greet["source_code"] == "line 2\nline 3\nline 4" and not greet["truncated"] and greet["warnings"] == []
    assert rows["app.ts::main"]["source_code"] is None and "Failed to read" in rows["app.ts::main"]["warnings"][0]
    assert "not found" in rows["tests/other.ts::greet"]["warnings"][0]
    big = rows["long.ts::big"]
    assert big["truncated"] and big["source_code"].count("\n") == 199 and "300 lines → 200" in big["warnings"][0]


# --- mutations -------------------------------------------------------------


def asked(spark, *rows):
    return spark.createDataFrame([(i, "p", *r, None, None) for i, r in enumerate(rows)], "pos bigint, project string, sourceid string, targetid string, relation string, sourcefile string, sourceline int")


def counts(spark, g, *rows):
    return tuple(mutate.edge_counts(mutate.judge_edges(g, asked(spark, *rows))).first())


def test_add_edges(spark):
    g = graph(spark, [node(i, n) for i, n in enumerate(("a", "b", "c"))], [("a", "c", "CALLS")])
    assert counts(spark, g, ("a", "b", "CALLS"), ("b", "c", "CALLS")) == (2, 0, 0)
    assert counts(spark, g, ("x", "b", "CALLS")) == counts(spark, g, ("a", "y", "CALLS")) == (0, 0, 1)
    assert counts(spark, g, ("a", "c", "CALLS")) == (0, 1, 0)
    assert counts(spark, g, ("a", "b", "CALLS"), ("a", "b", "IMPORTS_FROM")) == (2, 0, 0)
    assert counts(spark, g, ("a", "b", "CALLS"), ("a", "b", "CALLS"), ("x", "y", "CALLS"), ("x", "y", "CALLS")) == (1, 1, 2)
    judged = mutate.judge_edges(g, asked(spark, ("x", "y", "CALLS"), ("a", "y", "CALLS"))).orderBy("pos").collect()
    assert [r["reason"] for r in judged] == ['Node not found: sourceId "x", targetId "y"', 'Node not found: targetId "y"']
    after, _ = mutate.add_edges(g, asked(spark, ("a", "b", "CALLS"), ("a", "b", "CALLS")))
    assert [(r["sourceid"], r["targetid"]) for r in after.edges_in_order().collect()] == [("a", "c"), ("a", "b")]


def test_edge_defaults(spark):
    g = graph(spark, [node(1, "a.sh::f", path="a.sh", start=7)], [])
    rows = mutate.edge_defaults(g, asked(spark, ("a.sh::f", "x", "CALLS"), ("b.sh::g", "x", "CALLS"))).orderBy("pos").collect()
    assert [(r["sourcefile"], r["sourceline"]) for r in rows] == [("a.sh", 7), ("b.sh", 0)]


def test_enrich_and_merge(spark, two):
    ups = spark.createDataFrame(
        [(1, "p", "src/X.ts::A", "first", "low", ["x"]), (2, "p", "src/X.ts::A", "second", "high", []), (3, "p", "src/X.ts::B", "bad", "huge", []), (4, "p", "gone", "s", "low", [])],
        "pos int, project string, id string, summary string, complexity string, domainconcepts array<string>",
    )
    after, verdicts = mutate.enrich(two, ups)
    held = {r["id"][-1]: r["semantic"] for r in after.nodes.collect()}
    assert held["A"]["summary"] == "second" and held["A"]["enrichedby"] == "agent" and held["A"]["enrichedat"].endswith("Z")
    assert held["B"]["enrichedat"] == "time"
    assert sorted(r["error"] or "" for r in verdicts.collect()) == ["", "", "Node not found: gone", 'semantic.complexity must be "low" | "medium" | "high"']
    scanned = dedupe_last(two.nodes.withColumn("semantic", F.lit(None).cast(NODES["semantic"].dataType)))
    merged = {r["id"][-1]: r["semantic"] for r in mutate.merge_semantic(scanned, after.nodes.where("name = 'B'")).collect()}
    assert merged["A"] is None and merged["B"]["summary"] == "does"
    assert mutate.preserved_count(scanned, two.nodes).first()[0] == 1


def test_semantic_error_order(spark):
    rows = [(None,), ((None, "x", None, None, None),), (("s", "x", None, None, None),), (("s", "low", None, None, None),), (("s", "low", [], None, "agent"),), (("s", "low", [], "t", "bot"),), (("s", "low", [], "t", "manual"),)]
    df = spark.createDataFrame(rows, "semantic struct<summary:string, complexity:string, domainconcepts:array<string>, enrichedat:string, enrichedby:string>")
    errors = [r[0] for r in df.select(semantic_error(F.col("semantic"))).collect()]
    assert [e and e.split()[0] for e in errors] == ["semantic", "semantic.summary", "semantic.complexity", "semantic.domainConcepts", "semantic.enrichedAt", "semantic.enrichedBy", None]


def test_empty_graph(spark):
    g = graph(spark, [], [])
    assert g.stats().first()["nodecount"] == 0 and impact(g, starts(spark, "a")).count() == 0
    assert g.degrees().count() == 0 and g.search("x").count() == 0
