"""Sources that are odd, large or cannot be parsed."""

from __future__ import annotations

import time

import pytest

from skein.functions import captures as C
from skein.functions.languages import mask, without_comments
from skein.operators.extract import build_graph, captures, parse_errors
from skein.schema import FILES


def tagged(text, lang, tag):
    return [(name, row + 1) for _, t, name, row, *_ in C.captures_of(text, lang) if t == tag]


def test_python_names_and_line_ends():
    assert tagged("def ﬁn(): pass\n", "python", "function") == [("fin", 1)]
    assert tagged("from a . b import c\n", "python", "import") == [("a.b", 1)]
    assert [n for n, _ in tagged("import os\rdef f():\r    return g(1)\r", "python", "call")] == ["g"]
    assert tagged("x = 1\r\nclass  K :\r\n    async  def  m(self): pass\r\n", "python", "function") == [("m", 3)]
    assert tagged("@d('é')\nclass É(d): pass\n", "python", "class") == [("É", 2)]


def test_typescript_calls():
    calls = lambda text: [n for n, _ in tagged(text, "typescript", "call")]
    assert calls("const s = `a ${one(`${two(1)} three(2)`)} four(5) ${ {a: five()} } six()`; seven()") == ["one", "two", "five", "seven"]
    assert calls("f?.(1); g?.<T>(2); h<Array<Map<a, b>>>(3); all(...k(4)); a.b?.(5)") == ["f", "g", "h", "all", "k"]
    assert calls("new            \n\n          Far(1); near(2)") == ["near"]
    assert calls("if (a < b) { c(1) } else if (d > (e)) f(2)") == ["c", "f"]
    assert calls("`open ${ x") == [] and calls("`never closed { run() }") == []


def test_mask_keeps_offsets():
    for text in ("a `b${c}d` e", "`${`${1}`}`", "`\\`${x}`", "`a\nb${ '}' }c` // `d`\n`e`", "`${", "}`x`", "`\\"):
        code = mask(text, "typescript")
        assert len(code) == len(text) and code.count("\n") == text.count("\n")
    assert without_comments('a = "/* no */"; /* yes */ // it`s\nb', "typescript").split() == ["a", "=", '"/*', "no", '*/";', "b"]
    assert without_comments("a = '#' # gone\n", "python").split() == ["a", "=", "'#'"]


def test_go_generic_calls():
    assert [n for n, _ in tagged("package p\n\nfunc f() { Map[int](3); Of[map[string]int, T](4); x[1] = g(2) }\n", "go", "call")] == ["Map", "Of", "g"]


def test_bash_lists_of_any_length():
    text = "for x in " + " ".join(f"item{i}" for i in range(40)) + "; do run $x; done\n"
    assert [n for n, _ in tagged(text, "bash", "call")] == ["run"]


@pytest.mark.parametrize("lang,line", [
    ("typescript", "interface I{n} {{ a(): b; }} class C{n} {{ m{n}(a: {{ x: [number] }}): void {{ f{n}(`${{g(1)}}`); }} }}\n"),
    ("go", "func F{n}(a []int) {{ G{n}(a[0]) }}\n"), ("php", "class C{n} {{ function m{n}() {{ f{n}(1); }} }}\n"), ("bash", "f{n}() {{ g{n} | h{n}; }}\n"),
])
def test_large_files_take_time_in_proportion(lang, line):
    def seconds(n):
        text = "".join(line.format(n=i) for i in range(n))
        began = time.process_time()
        found = C.captures_of(text, lang)
        assert len(found) >= n
        return time.process_time() - began

    seconds(200)
    assert seconds(8_000) < 30 * max(0.02, seconds(1_000))


def test_a_file_that_cannot_be_parsed_stops_no_other(spark, monkeypatch):
    rows = [(1, "p", "a.py", ".py", "python", "def ok(): pass\n"), (2, "p", "bad.go", ".go", "go", "package p\n"), (3, "p", "c.rs", ".rs", "rust", "fn x() {}")]
    files = spark.createDataFrame(rows, FILES)
    def breaks(text):
        raise IndexError("no such row")

    from skein.operators import extract

    monkeypatch.setattr(extract, "captures_of", lambda text, lang: breaks(text) if lang == "go" else C.captures_of(text, lang))
    found = captures(files)
    assert [tuple(r) for r in parse_errors(found).collect()] == [("p", "bad.go", "IndexError: no such row")]
    assert {r["id"] for r in build_graph(files).nodes.collect()} == {"a.py", "a.py::ok"}
