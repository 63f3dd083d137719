"""Captures and graphs of newly written sources in five languages."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from skein.functions.captures import captures_of
from skein.functions.languages import Language, Registry, mask
from skein.operators.extract import build_graph, captures, with_context
from skein.operators.graph import Graph
from skein.schema import FILES

TS = '''/** A store. */
// class Hidden {}
export class Shelf {
  put(item: string): void {
    const local = (n: number): number => n + 1;
    this.items.push(item);
    if (ready(item)) { new Box(item); }
  }

  take(n: number) { return "call(me)"; }
}
import { a } from "./alpha";
import './side';
const lift = async (x) => wrap(x);
let twice = y => y;
interface Shape { area(): number; }
function plain(n: number) { return lift(n); }
'''
PY = '''import os
import sys as system
from pathlib import Path
from . import near


class Keeper:
    """def hidden(): pass"""

    def __init__(self):
        self.at = Path(os.getcwd())

    def open(self):
        return load("x()").strip()


class Second:
    def __init__(self):
        pass


def load(p):
    return str(p)
'''
GO = '''package main

import (
    "fmt"
    alias "net/url"
)
import "os"

type Reader interface {
    Read(n int) error
}

type Box struct {
    n int
}

func New(n int) *Box { return &Box{n: n} }

func (b *Box) Open() error {
    fmt.Println("call(me)")
    return helper(b.n)
}
'''
PHP = r'''<?php
namespace App;
use App\Models\Item;
use Single;

interface Opens { public function open(); }

class Till {
    public function ring($x) {
        $this->log($x); Item::find($x); return count_all(new Bag());
    }
}
function outside() { return \Lib\make(1); }
'''
SH = '''#!/bin/bash
source ./common.sh
. lib.sh
function setup { mkdir -p "$OUT"; }
teardown() {
  # rm commented
  local x=1
  if [ -n "$x" ]; then echo "done; not_a_call" | grep d; fi
}
NAME=1 setup && teardown
'''


def found(text, lang):
    by = defaultdict(list)
    for _, tag, name, row, *_ in captures_of(text, lang):
        by[tag].append((name, row + 1))
    return by


def test_typescript():
    f = found(TS, "typescript")
    assert f["class"] == [("Shelf", 3)]
    assert f["method"] == [("put", 4), ("take", 10)]
    assert f["variable"] == [("local", 5), ("lift", 14), ("twice", 15)]
    assert f["interface"] == [("Shape", 16)] and f["function"] == [("plain", 17)]
    assert f["import"] == [('"./alpha"', 12), ("'./side'", 13)]
    assert f["call"] == [("ready", 7), ("wrap", 14), ("lift", 17)]


def test_python():
    f = found(PY, "python")
    assert f["class"] == [("Keeper", 7), ("Second", 17)]
    assert [n for n, _ in f["function"]] == ["__init__", "open", "__init__", "load"]
    assert f["import"] == [("os", 1), ("pathlib", 3)]
    assert [n for n, _ in f["call"]] == ["Path", "getcwd", "load", "strip", "str"]


def test_python_that_does_not_parse():
    f = found("def f(:\n    g(1)\nclass A\nfrom a.b import c\nimport d, e as x\n", "python")
    assert f["class"] == [("A", 3)] and ("g", 2) in f["call"] and [n for n, _ in f["import"]] == ["a.b", "d"]


def test_go():
    f = found(GO, "go")
    assert f["interface"] == [("Reader", 9)] and f["class"] == [("Box", 13)]
    assert f["function"] == [("New", 17)] and f["method"] == [("Open", 19)]
    assert [n for n, _ in f["import"]] == ['"fmt"', '"net/url"', '"os"']
    assert [n for n, _ in f["call"]] == ["Println", "helper"]


def test_php():
    f = found(PHP, "php")
    assert f["class"] == [("Till", 8)] and f["interface"] == [("Opens", 6)]
    assert f["method"] == [("open", 6), ("ring", 9)] and f["function"] == [("outside", 13)]
    assert f["import"] == [(r"App\Models\Item", 3)]
    assert [n for n, _ in f["call"]] == ["log", "find", "count_all", r"\Lib\make"]


def test_bash():
    f = found(SH, "bash")
    assert f["function"] == [("setup", 4), ("teardown", 5)]
    assert [n for n, _ in f["import"]] == ["./common.sh", "lib.sh"]
    assert [n for n, _ in f["call"]] == ["source", ".", "mkdir", "echo", "grep", "setup", "teardown"]


@pytest.mark.parametrize("lang,text", [("typescript", TS), ("python", PY), ("go", GO), ("php", PHP), ("bash", SH), ("bash", "cat <<EOF\nrm x\nEOF\n"), ("go", "'\"`")])
def test_mask_keeps_offsets(lang, text):
    masked = mask(text, lang)
    assert len(masked) == len(text) and [i for i, c in enumerate(masked) if c == "\n"] == [i for i, c in enumerate(text) if c == "\n"]


@pytest.mark.parametrize("lang", ["typescript", "tsx", "python", "go", "php", "bash"])
def test_odd_texts_do_not_fail(lang):
    for text in ("", "\n", "(((", "class", "}" * 50, "export", "function", "\x00", "é" * 20, "import '", "x" * 100_000, "const a = ("):
        captures_of(text, lang)


def files(spark, *rows):
    return spark.createDataFrame([(i, "p", path, "", lang, text) for i, (path, lang, text) in enumerate(rows)], FILES)


def test_graph_of_sources(spark):
    g = build_graph(files(spark, ("a/shelf.ts", "typescript", TS), ("k.py", "python", PY), ("b.go", "go", GO), ("none.ts", "typescript", None), ("odd.rs", "rust", "fn x() {}")))
    nodes = {r["id"]: r for r in g.nodes.collect()}
    assert nodes["a/shelf.ts"]["endline"] == TS.count("\n") + 1 and "none.ts" not in nodes and "odd.rs" not in nodes
    assert nodes["a/shelf.ts::Shelf"]["exporttype"] == "named" and nodes["a/shelf.ts::Shelf"]["startline"] == 3
    put = nodes["a/shelf.ts::Shelf.put"]
    assert (put["type"], put["name"], put["exporttype"]) == ("function", "Shelf.put", "none")
    assert nodes["a/shelf.ts::local"]["exporttype"] == "named"  # inside the rows of the export
    assert nodes["a/shelf.ts::plain"]["exporttype"] == "none" and nodes["a/shelf.ts::lift"]["type"] == "function"
    assert nodes["k.py::__init__"]["startline"] == 10  # the first of two holds
    assert nodes["b.go::Open"]["name"] == "Open"
    assert nodes["k.py::load"]["signature"] == "def load(p):"
    edges = {(r["sourceid"], r["targetid"], r["relation"]) for r in g.edges.collect()}
    assert ("a/shelf.ts", "./alpha", "IMPORTS_FROM") in edges and ("k.py", "strip", "CALLS") in edges


def test_context_is_a_single_slot(spark):
    """Windows equal a sequential walk, over random class ranges."""
    rng = random.Random(3)
    rows, expected = [], []
    for f in range(4):
        name, end, exported = None, -1, -1
        row = 0
        for i in range(40):
            row += rng.randint(0, 2)
            tag = rng.choice(["class", "method", "function", "export"])
            last = row + rng.randint(0, 8)
            if tag == "class":
                name, end = f"C{i}", last
            if tag == "export":
                exported = max(exported, last)
            rows.append((f, "p", f"f{f}", "typescript", i, tag, f"C{i}" if tag == "class" else f"m{i}", row, 0, last, ""))
            expected.append((f"f{f}", i, name if row <= end else None, row <= exported))
    from skein.operators.extract import CAPTURES

    got = with_context(spark.createDataFrame(rows, CAPTURES)).collect()
    assert sorted((r["filepath"], r["idx"], r["class_name"] if r["in_class"] else None, r["exported"]) for r in got) == sorted(expected, key=lambda x: x[:2])


def test_hook_and_registry(spark):
    def hook(caps, nodes, edges):
        return nodes.where("type <> 'file'"), edges

    registry = Registry()
    registry.register(Language("go", (".go",), hook))
    text = files(spark, ("b.go", "go", GO))
    from skein.operators.extract import captures_to_graph

    g = captures_to_graph(captures(text), registry)
    assert isinstance(g, Graph) and g.nodes.where("type = 'file'").count() == 0
    assert Registry().language_of(".pyw") == "python" and Registry().language_of(".TS") is None
