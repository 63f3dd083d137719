from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from skein.llm.terms import field_values, term_frequency, term_marks

SCHEMA = "project string, id string, type string, name string, semantic struct<summary string, domainconcepts array<string>>, term string, occurrences int"


def by_hand(rows):
    occ, recs, all_recs = Counter(), defaultdict(set), defaultdict(set)
    for p, i, kind, name, sem in rows:
        values = []
        if kind != "file":
            all_recs["name"].add((p, i))
            values.append(("name", name))
        if sem is not None and sem[1] is not None:
            all_recs["domainconcepts"].add((p, i))
            values += [("domainconcepts", c) for c in sem[1]]
        for field, v in values:
            t = v.strip().lower() if v is not None else ""
            if t:
                occ[field, t] += 1
                recs[field, t].add((p, i))
    return occ, {k: len(v) for k, v in recs.items()}, {k: len(v) for k, v in all_recs.items()}


@pytest.mark.parametrize("blocks,range_size", [(1, 2), (7, 3), (64, 4096)])
def test_counts_equal_brute_force(spark, blocks, range_size):
    rng = random.Random(blocks)
    words = ["hot", " Hot\t", "HOT", "a", "b ", "", "  ", None, "é", " x ", "long" * 2000] + [f"w{i}" for i in range(20)]
    rows = [
        (rng.choice(["p", "q", None]), f"i{rng.randint(0, 60)}", rng.choice(["file", "class", "function", None]), rng.choice(words),
         rng.choice([None, ("s", None), ("s", []), ("s", [rng.choice(words) for _ in range(3)])]))
        for _ in range(300)
    ]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    counts, records = term_frequency(field_values(df), blocks, range_size)
    occ, recs, totals = by_hand(rows)
    got = {(r["field_name"], r["term"]): (r["occurrences"], r["n_records"]) for r in counts.collect()}
    assert got == {k: (occ[k], recs[k]) for k in occ} and records == totals
    marks = {(r["field_name"], r["term"]): (r["is_rare"], r["is_common"]) for r in term_marks(counts, records, 2, {"name": 10, "domainconcepts": 20}).collect()}
    need = {"name": 10, "domainconcepts": 20}
    assert marks == {k: (n <= 2, n * 100 >= totals[k[0]] * need[k[0]]) for k, n in recs.items()}


def test_empty(spark):
    counts, records = term_frequency(field_values(spark.createDataFrame([], SCHEMA)))
    assert counts.count() == 0 and records == {}
