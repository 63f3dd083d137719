"""Return types of any length and nesting do not hide what they annotate."""

from __future__ import annotations

import pytest

from skein.functions.captures import _typescript
from skein.functions.languages import mask

LONG = " | ".join(f"Alternative{i}" for i in range(60))
TYPES = [
    "void", "A | B", "x is Map<string, { a: { b: number } }>", "{ a: { b: number }; c: string }", "{ a: 1 } | { b: 2 }",
    LONG, "{ " + "; ".join(f"field{i}: string" for i in range(60)) + " }", f"Promise<{{ a: {LONG} }}>", "'a' | `b`", "keyof T[]",
    "T extends (infer U)[] ? U : never", "\n  | A<B>\n  | C.D[]",
]


@pytest.mark.parametrize("kind", TYPES)
def test_methods_and_arrows_behind_long_types(kind):
    text = f"class K {{\n  run(a: number): {kind} {{\n    go();\n  }}\n}}\nconst f = (a: number): {kind} => a;\n"
    found = {(c.tag, c.text) for c in _typescript(text, mask(text, "typescript"))}
    assert ("method", "run") in found and ("variable", "f") in found
    assert ("call", "go") in found and ("call", "run") not in found


def test_calls_stay_calls():
    text = "const x = c ?\n  run(a)\n  : { b: 1 };\nconst y = (a + b) * 2;\nrun(" + "a, " * 200 + "b);\n"
    found = {(c.tag, c.text) for c in _typescript(text, mask(text, "typescript"))}
    assert ("call", "run") in found and ("method", "run") not in found and ("variable", "y") not in found
