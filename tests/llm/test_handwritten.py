from __future__ import annotations

import random
from collections import Counter

import pytest

from skein.llm import handwritten as H

SCHEMA = "project string, relpath string, lang string, content string, language string"
VERBS = "load save open close merge split draw parse sort trim plan fold wait push pull mark".split()
NOUNS = "Queue Packet Ledger Roster Basket Window Meter Cursor Signal Ticket".split()


def plain(rng):
    out = ["import { a } from './a';"]
    for _ in range(rng.randint(2, 8)):
        lines = [rng.choice([f"    this.{rng.choice(NOUNS).lower()} = {rng.choice(NOUNS).lower()};", f"    return {rng.choice(VERBS)}({rng.choice(NOUNS).lower()});", "    if (!x) { return null; }"]) for _ in range(rng.randint(2, 5))]
        out += [f"function {rng.choice(VERBS)}{rng.choice(NOUNS)}(a: number) {{", *lines, "}"]
    return "\n".join(out) + "\n"


def odd(rng):
    w = "abcdefghijk"
    return {
        "mangled": "".join(f"function {rng.choice(w)}(e,t){{for(;{rng.choice(w)}<{rng.choice(w)};q++)z[q]^={i};return{{p:m,r:k}}}}" for i in range(20)),
        "template": "\n".join(f"function call{n}(a) {{\n  req = build('{n}Service', {i});\n  return send(req);\n}}" for i, n in enumerate(NOUNS)),
        "foreign": "\n".join(f"function {rng.choice(VERBS)}Stale{n}(a) {{\n  this.{n.lower()} = {rng.choice(VERBS)}(a);\n}}" for n in rng.sample(NOUNS, 6)),
        "data": "const TABLE = [\n" + "\n".join("  " + ", ".join(str(rng.randint(-9999, 9999)) for _ in range(8)) + "," for _ in range(40)) + "\n];\n",
        "hex": "const BLOB = `\n" + "\n".join(" ".join(f"{rng.getrandbits(16):04x}" for _ in range(12)) for _ in range(60)) + "\n`;\n",
    }


@pytest.fixture(scope="module")
def judged(spark):
    rng = random.Random(2)
    rows = [("p", f"plain{i}.ts", "typescript", plain(rng), "clash") for i in range(120)]
    rows += [("p", f"{k}.ts", "typescript", v, "clash") for k, v in odd(rng).items()]
    decoy = "// Code generated by a tool, DO NOT EDIT; minified, vendored from upstream 1.2.3\n" + plain(rng)
    rows += [("p", "speaks.ts", "typescript", decoy, ""), ("p", "null.ts", "typescript", None, ""), ("p", "empty.ts", None, "", ""), ("q", "blank.xx", "rust", "\n\n", "")]
    rows += [("p", "twice.ts", "typescript", None, ""), ("p", "twice.ts", "typescript", odd(rng)["mangled"], ""), ("p", "long.ts", "typescript", "".join(plain(rng) for _ in range(200)), "")]
    return H.judge_files(spark.createDataFrame(rows, SCHEMA)).cache()


def test_each_kind_is_told(judged):
    why = {r["relpath"]: r["reasons"] for r in judged.collect() if r["reasons"]}
    assert "mangled" in why["mangled.ts"] and "template" in why["template.ts"] and why["foreign.ts"] == ["foreign"]
    assert why["data.ts"] and why["hex.ts"]
    assert {r["relpath"] for r in H.not_handwritten(judged).collect()} == {"mangled.ts", "template.ts", "foreign.ts", "data.ts", "hex.ts", "twice.ts"}


def test_every_row_is_judged(judged):
    assert judged.count() == 120 + 5 + 4 + 3


def test_helpers():
    assert H.name_words("_getHTTPCode12") == ["_", "get", "http", "code", "#"] and H.name_words("snake_case_x") == ["snake", "case", "x"]
    assert H.effective(["a", "a", "b", "b"]) == pytest.approx(2) and H.effective(["a"]) == pytest.approx(1)


def test_empty(spark):
    out = H.judge_files(spark.createDataFrame([], "project string, relpath string, lang string, content string"))
    assert H.not_handwritten(out).count() == 0


def test_trigrams_against_brute_force():
    rng = random.Random(6)
    for words in ([], [""], ["a"], ["abc", "abc", "b_9"], ["".join(rng.choice("abc_1") for _ in range(rng.randint(1, 9))) for _ in range(50)]):
        by_hand = Counter(p[i : i + 3] for p in (f"^^{w}$" for w in words) for i in range(len(p) - 2))
        at, n = H.trigrams(words, H.SYMBOLS, H._NAME_CODES)
        k = len(H.SYMBOLS)
        assert {H.SYMBOLS[a // k // k] + H.SYMBOLS[a // k % k] + H.SYMBOLS[a % k]: c for a, c in zip(at.tolist(), n.tolist())} == by_hand


def test_model_counts_each_file_once(spark):
    files = spark.createDataFrame([("a", "go", "abc " * 50), ("b", "go", " ".join(f"zz{i}q" for i in range(500))), ("c", "Go ", None)], "relpath string, lang string, content string")
    _, model = H._read(files, ("relpath",))
    held = {r["gram"]: r["w"] for r in model.groupBy("gram").sum("weight").toDF("gram", "w").collect()}
    abc, _ = H.trigrams(["abc"], H.SYMBOLS, H._NAME_CODES)
    assert sum(held[g] for g in abc.tolist()) == pytest.approx(1_000_000, abs=4) and sum(held.values()) == pytest.approx(2_000_000, rel=0.01)


def test_comment_marks_in_strings_and_short_files(spark):
    """A path pattern in a string begins no comment; a file is not exempt for being small."""
    rng = random.Random(8)
    hidden = 'const at = "lib/*/x.ts";\n' + odd(rng)["mangled"] + '\nconst end = "*/";\n'
    small = "const B = '" + " ".join(f"{rng.getrandbits(16):04x}" for _ in range(12)) + "';\n"
    rows = [("p", f"plain{i}.ts", "typescript", plain(rng), "") for i in range(80)] + [("p", "hidden.ts", "typescript", hidden, ""), ("p", "small.ts", "typescript", small, "")]
    judged = H.judge_files(spark.createDataFrame(rows, SCHEMA))
    assert {r["relpath"] for r in H.not_handwritten(judged).collect()} == {"hidden.ts", "small.ts"}
    assert {r["relpath"]: r["end_line"] for r in judged.collect()}["small.ts"] == 2
