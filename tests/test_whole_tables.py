"""Queries and operators that take whole tables leave nothing out."""

from __future__ import annotations

import json
from collections import Counter, defaultdict

import pytest
from conftest import SF
from pyspark.sql import functions as F

from skein.operators import bundle
from skein.operators.traverse import impact
from skein.plans import graph_queries as q
from test_graph import graph, node, starts


@pytest.fixture(scope="module")
def tables(spark):
    """The serving graph of the smallest tables, as nodes by key and edges."""
    g = q.graph(spark, str(SF))
    return {(n["project"], n["id"]): n for n in g.nodes.collect()}, g.edges.collect()


def test_impact_without_cap_counts_all(spark):
    nodes = [node(0, "hub")] + [node(i, f"x{i:03}") for i in range(1, 151)] + [node(200 + i, f"y{i:03}") for i in range(1, 151)]
    edges = [(f"x{i:03}", "hub", "CALLS") for i in range(1, 151)] + [(f"y{i:03}", f"x{i:03}", "CALLS") for i in range(1, 151)]
    rows = impact(graph(spark, nodes, edges), starts(spark, "hub"), cap=None).collect()
    assert Counter(r["level"] for r in rows) == {1: 150, 2: 150}
    assert sorted(r["rank"] for r in rows) == list(range(1, 301))


def test_every_class_has_all_its_dependants(spark, tables):
    nodes, edges = tables
    into = defaultdict(set)
    for e in edges:
        if (e["project"], e["sourceid"]) in nodes:
            into[e["project"], e["targetid"]].add((e["project"], e["sourceid"]))
    expected = {}
    for key, n in nodes.items():
        direct = into[key]
        affected = direct.union(*[into[k] for k in direct]) - {key}
        if n["type"] == "class" and affected:
            expected[key] = len(affected)
    rows = q.impact_every_class(spark, str(SF)).collect()
    assert {(r["project"], r["id"]): r["affected"] for r in rows} == expected and len(rows) == len(expected)


def test_every_node_has_its_imports(spark, tables):
    nodes, edges = tables
    of = defaultdict(list)
    for e in edges:
        if e["relation"] == "IMPORTS_FROM":
            of[e["project"], e["sourceid"]].append((e["seq"], e["targetid"]))
    expected = Counter((*key, *e) for key, n in nodes.items() for e in of[n["project"], n["filepath"]])
    rows = q.ctx_imports(spark, str(SF)).collect()
    assert Counter(tuple(r) for r in rows) == expected
    assert {nodes[r["project"], r["target_id"]]["type"] for r in rows} > {"interface"}


def test_every_node_has_its_related_tests(spark, tables):
    nodes, _ = tables
    tests = defaultdict(list)
    for n in nodes.values():
        if any(s in (n["filepath"] or "").lower() for s in ("test/", ".test.", ".spec.")) and n["name"] is not None:
            tests[n["project"]].append(n)
    expected = Counter(
        (p, i, t["id"], t["name"]) for (p, i), n in nodes.items() if n["name"] is not None
        for t in tests[p] if n["name"].lower() in t["name"].lower() and t["id"] != i
    )
    g = q.graph(spark, str(SF))
    got = Counter(tuple(r) for r in bundle.related_tests(g, g.nodes).select("project", "target_id", "id", "name").collect())
    assert got == expected and expected
    counts = {(r["project"], r["target_id"]): r["tests"] for r in q.ctx_related_tests(spark, str(SF)).collect()}
    assert counts == Counter((p, i) for p, i, *_ in expected.elements())


def test_related_tests_of_more_than_ten_thousand(spark):
    names = ["", "é", "Ab", "abcde", "ABCDEF", "bcdefg", "xyz"]
    called = lambda n, name: (*n[:4], name, *n[5:])  # noqa: E731  (an empty name, too)
    nodes = [called(node(i, f"n{i}"), names[i % len(names)]) for i in range(10_500)]
    nodes += [called(node(20_000 + i, f"t{i}", path="test/a.ts"), name) for i, name in enumerate(["zabcdefg", "", "ÉAB"], 1)]
    g = graph(spark, nodes, [])
    got = Counter((r["id"], names[int(r["target_id"][1:]) % len(names)]) for r in bundle.related_tests(g, g.nodes.where("id like 'n%'")).collect())
    each = 10_500 // len(names)
    held = {"t1": ["", "Ab", "abcde", "ABCDEF", "bcdefg"], "t2": [""], "t3": ["", "é", "Ab"]}
    assert got == {(t, n): each for t, ns in held.items() for n in ns}


@pytest.mark.parametrize("called", [False, True])
def test_context_bundle_gives_its_lists(spark, tables, monkeypatch, called):
    nodes, edges = tables
    if called:  # the seed of these tables is a file, which nothing calls
        into = Counter((e["project"], e["targetid"]) for e in edges if e["relation"] == "CALLS" and (e["project"], e["targetid"]) in nodes and (e["project"], e["sourceid"]) in nodes)
        most = max(into, key=lambda k: (into[k], k))
        monkeypatch.setattr(q, "seed", lambda g: spark.createDataFrame([most], "project string, id string"))
    brief = ["id", "type", "name", "filepath", "startline", "endline", "exporttype", "signature"]
    ends = ["sourceid", "targetid", "relation", "sourcefile", "sourceline"]
    row = q.context_bundle(spark, str(SF)).first()
    project, own = row["project"], nodes[row["project"], row["id"]]
    mine = sorted((e for e in edges if e["project"] == project), key=lambda e: e["seq"])
    of = lambda end: nodes.get((project, end))
    short = lambda n: {c: n[c] for c in brief}
    calls = [e for e in mine if e["relation"] == "CALLS"]
    assert json.loads(row["callers"]) == [short(of(e["sourceid"])) for e in calls if e["targetid"] == own["id"] and of(e["sourceid"])]
    assert json.loads(row["callees"]) == [short(of(e["targetid"])) for e in calls if e["sourceid"] == own["id"] and of(e["targetid"])]
    assert json.loads(row["imports"]) == [{c: e[c] for c in ends} for e in mine if e["relation"] == "IMPORTS_FROM" and e["sourceid"] == own["filepath"]]
    tests = sorted((n for (p, _), n in nodes.items() if p == project), key=lambda n: n["seq"])
    tests = [n for n in tests if any(s in n["filepath"].lower() for s in ("test/", ".test.", ".spec."))]
    assert json.loads(row["related_tests"]) == [short(n) for n in tests if own["name"].lower() in n["name"].lower() and n["id"] != own["id"]]
    texts = [r["content"] for r in q.table(spark, str(SF), "source_files").where((F.col("project") == project) & (F.col("relpath") == own["filepath"])).collect() if r["content"] is not None]
    span = max(texts).split("\n")[max(1, own["startline"]) - 1 : own["endline"]] if texts else None
    assert row["source_code"] == (span and "\n".join(span[:200])) and len(json.loads(row["warnings"])) == (not texts or len(span) > 200)
    assert bool(json.loads(row["callers"])) == called
