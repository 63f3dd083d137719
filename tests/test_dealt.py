"""Orphan references, hot keys and snapshot changes against brute force."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from skein.operators.hotkeys import dominant_keys, key_profile
from skein.operators.keyfilter import key_filter, may_be_among
from skein.operators.ordering import global_index
from skein.operators.orphans import OrphanFinder, references
from skein.operators.snapshots import snapshot_changes

T0 = datetime(2026, 1, 1)
EDGE = "seq bigint, project string, sourceid string, targetid string, loadedat timestamp_ntz, side string, id string"
NODE = "project string, id string, loadedat timestamp_ntz, deletedat timestamp_ntz, extra int"


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def finder(spark, edges, nodes, known=(), **how):
    rows = [(i, *e[:3], day(e[3]), "clash", "clash") for i, e in enumerate(edges)]
    df = spark.createDataFrame(rows, EDGE)
    refs = references(df, "edges", "seq", "loadedat", {"source": "sourceid", "target": "targetid"})
    ns = spark.createDataFrame([(p, i, day(a), day(b), 0) for p, i, a, b in nodes], NODE)
    return OrphanFinder(refs, ns, spark.createDataFrame([(k,) for k in known], "symbol string"), **how)


def orphans_by_hand(edges, nodes, known=()):
    out = set()
    for i, (p, s, t, at) in enumerate(edges):
        for side, x in (("source", s), ("target", t)):
            if x is None or x in known:
                continue
            live = at is not None and p is not None and any(
                (q, j) == (p, x) and a is not None and a <= at and (b is None or at < b) for q, j, a, b in nodes
            )
            if not live:
                out.add((i, side))
    return out


@pytest.mark.parametrize("heavy_keys,broadcast_rows,filter_bits", [(4_000, 200_000, 26), (10, 200_000, 16), (10, 0, 16), (0, 0, 16)])
def test_orphans_equal_brute_force(spark, heavy_keys, broadcast_rows, filter_bits):
    rng = random.Random(heavy_keys)
    ids = ["hot"] * 6 + [f"n{i}" for i in range(15)] + [None, "", "lib", "ghost"]
    nodes = []
    for p in ("p", "q"):
        for i in sorted({x for x in ids if x not in (None, "ghost", "lib")}):
            for _ in range(rng.randint(0, 2)):
                a = rng.choice([None, *range(0, 100)])
                nodes.append((p, i, a, rng.choice([None, (a or 0) + rng.randint(0, 40)])))
    nodes += [("p", "hot", 10, 20), ("p", "hot", 33, 50), ("p", "n1", 35, 36)]
    edges = [(rng.choice(["p", "p", "q", None]), rng.choice(ids), rng.choice(ids), rng.choice([None, *range(0, 120)])) for _ in range(300)]
    edges += edges[:20]
    f = finder(spark, edges, nodes, ["lib", None], heavy_keys=heavy_keys, broadcast_rows=broadcast_rows, filter_bits=filter_bits)
    got = sorted((r["row_no"], r["side"]) for r in f.rows().collect())
    assert got == sorted(orphans_by_hand(edges, nodes, {"lib"}))
    by = Counter((r["table_name"], r["side"], r["period"]) for r in f.rows().collect())
    assert {(r["table_name"], r["side"], r["period"]): r["orphans"] for r in f.counts().collect()} == by
    kinds = {(r["hot"], r["verdict"]) for r in f.groups().select("hot", "verdict").distinct().collect()}
    assert {v for _, v in kinds} == {"live", "mixed", "orphan"}
    if heavy_keys == 10:
        assert {(True, "mixed"), (False, "mixed"), (False, "orphan")} <= kinds


def test_filter_lets_every_key_pass_and_few_others(spark):
    keys = spark.range(0, 3000, 3).selectExpr("cast(id % 7 as string) as a", "cast(id as string) as b")
    rows = spark.range(3000).selectExpr("cast(id % 7 as string) as a", "cast(id as string) as b", "id as slot", "id as words")
    for bits, most in ((26, 5), (16, 80)):
        got = {r["words"] for r in may_be_among(rows, ["a", "b"], key_filter(keys, ["a", "b"], bits), bits).collect()}
        assert set(range(0, 3000, 3)) <= got and len(got) <= 1000 + most
    assert may_be_among(rows, ["a", "b"], key_filter(keys.limit(0), ["a", "b"])).count() == 0
    nulls = spark.createDataFrame([(None, "x"), (None, None)], "a string, b string")
    assert may_be_among(nulls, ["a", "b"], key_filter(nulls, ["a", "b"])).count() == 2


def test_orphans_at_the_edges_of_a_lifetime(spark):
    nodes = [("p", "a", 10, 20), ("p", "a", 30, None)]
    edges = [("p", "a", None, d) for d in (9, 10, 19, 20, 29, 30, 400)]
    assert {r["row_no"] for r in finder(spark, edges, nodes).rows().collect()} == {0, 3, 4}


def test_orphans_of_empty_tables(spark):
    assert finder(spark, [], []).rows().count() == 0
    assert finder(spark, [("p", "a", "b", 1)], []).counts().agg(F.sum("orphans")).first()[0] == 2


# --- hot keys --------------------------------------------------------------

ROW = "k string, g string, m string, t timestamp_ntz, n_rows int"


def profile_by_hand(rows):
    by = {}
    for k, g, m, t in rows:
        if k is not None:
            by.setdefault(k, []).append((g, m, t))
    return {
        k: (
            len(v), len({g for g, _, _ in v if g is not None}), len({(g, m) for g, m, _ in v if m is not None}),
            min((t for *_, t in v if t is not None), default=None), max((t for *_, t in v if t is not None), default=None),
        )
        for k, v in by.items()
    }


@pytest.mark.parametrize("chunk_rows", [1, 3, 17, 1_000_000, None])
def test_profile_equals_brute_force(spark, chunk_rows):
    rng = random.Random(chunk_rows or 0)
    rows = [(rng.choice(["hot", "hot", "hot", "a", "b", "", None]), rng.choice(["x", "y", "z", None]), rng.choice(["f", "g", "h", "i", None]), rng.choice([None, T0, day(3), day(9)])) for _ in range(400)]
    rows += [("hot", "x", "f", T0)] * 200 + [("null only", None, None, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], ROW).repartition(5)
    out = key_profile(df, "k", "g", "m", "t", chunk_rows=chunk_rows).collect()
    assert {r["k"]: tuple(r)[1:] for r in out} == profile_by_hand(rows)
    assert len(out) == len(profile_by_hand(rows))


def test_dominant_keys(spark):
    df = spark.createDataFrame([("a", None, None, None, 1)] * 2 + [("b", None, None, None, 1)] * 97 + [(None, None, None, None, 1)], ROW)
    profile = key_profile(df, "k", "g", "m", "t")
    assert {r["k"] for r in dominant_keys(profile, "k", 100).collect()} == {"a", "b"}
    assert {r["k"] for r in dominant_keys(profile, "k", 101).collect()} == {"b"}
    none = key_profile(df.limit(0), "k", "g", "m", "t")
    assert none.count() == 0 and dominant_keys(none, "k", 0).count() == 0


def test_global_index_is_dense_and_ordered(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(500)], "a int, b int").repartition(9)
    rows = global_index(df, ["a", F.desc("b")]).orderBy("gno").collect()
    assert [r["gno"] for r in rows] == list(range(500))
    assert [(r["a"], -r["b"]) for r in rows] == sorted((r["a"], -r["b"]) for r in rows)
    assert global_index(df.limit(0), ["a"]).count() == 0


# --- snapshots -------------------------------------------------------------

SNAP = "seq bigint, snap int, project string, id string, signature string, endline int, change_kind string"


def changes_by_hand(rows):
    held = {}
    for seq, snap, p, i, sig, end in rows:
        if snap is None:
            continue
        key = (snap, p, i)
        if key not in held or (seq if seq is not None else -1) > held[key][0]:
            held[key] = (seq if seq is not None else -1, sig, end)
    snaps = sorted({k[0] for k in held})
    out = []
    for a, b in zip(snaps, snaps[1:]):
        before = {k[1:]: v[1:] for k, v in held.items() if k[0] == a}
        after = {k[1:]: v[1:] for k, v in held.items() if k[0] == b}
        out += [(*k, b, "added") for k in after.keys() - before.keys()]
        out += [(*k, b, "removed") for k in before.keys() - after.keys()]
        out += [(*k, b, "changed") for k in after.keys() & before.keys() if after[k] != before[k]]
    return out


def test_changes_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for seq in range(400):
        rows.append((seq, rng.choice([1, 2, 3, 5, None]), rng.choice(["p", "q", None]), rng.choice([f"i{i}" for i in range(12)] + [None]), rng.choice(["s", "", None, "t"]), rng.choice([1, 2, None])))
    rows.append((None, 3, "p", "i0", "late", 1))
    df = spark.createDataFrame([(*r, "clash") for r in rows], SNAP)
    got = snapshot_changes(df, ["project", "id"], ["signature", "endline"], "snap", "seq").collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, changes_by_hand(rows)))
    assert len(got) > 50


def test_changes_need_two_snapshots(spark):
    df = spark.createDataFrame([(1, 1, "p", "a", "s", 1, "")], SNAP)
    for d in (df, df.limit(0)):
        assert snapshot_changes(d, ["project", "id"], ["signature"], "snap", "seq").count() == 0


def test_null_differs_from_the_empty_string(spark):
    df = spark.createDataFrame([(1, 1, "p", "a", None, 1, ""), (2, 2, "p", "a", "", 1, ""), (3, 3, "p", "a", "", 1, "")], SNAP)
    rows = snapshot_changes(df, ["project", "id"], ["signature", "endline"], "snap", "seq").collect()
    assert [(r["snap"], r["change_kind"]) for r in rows] == [(2, "changed")]
