from __future__ import annotations

import random

import pytest

from skein.llm.mixing import Mixture, language_name, leaf_budgets, source_name, water_fill
from pyspark.sql import functions as F

DOCS = "doc_id bigint, source string, lang string, n_tokens bigint, item bigint, domain string"
TARGETS = "source string, target_share double, max_repeats int"


def test_water_fill():
    assert water_fill(10, {"a": 1, "b": 1}, {"a": 100, "b": 100}) == {"a": 5, "b": 5}
    assert water_fill(10, {"a": 1, "b": 1}, {"a": 2, "b": 100}) == {"a": 2, "b": 8}
    assert water_fill(10, {"a": 1, "b": 1}, {"a": 2, "b": 3}) == {"a": 2, "b": 3}
    assert water_fill(10, {"a": 0, "b": 1}, {"a": 9, "b": 0}) == {"a": 0, "b": 0}


def test_siblings_come_before_ancestors():
    leaves = [(("d1", "en", "a"), 0.4, 10), (("d1", "en", "b"), 0.1, 1000), (("d2", "en", "c"), 0.5, 1000)]
    assert leaf_budgets(leaves, 100) == {("d1", "en", "a"): 10, ("d1", "en", "b"): 40, ("d2", "en", "c"): 50}
    leaves[1] = (("d1", "en", "b"), 0.1, 15)
    assert leaf_budgets(leaves, 100) == {("d1", "en", "a"): 10, ("d1", "en", "b"): 15, ("d2", "en", "c"): 75}
    assert leaf_budgets([], 10) == {}


@pytest.mark.parametrize("seed", range(3))
def test_mixture(spark, seed):
    rng = random.Random(seed)
    spell = {"big": ["big", "Big ", "BIG"], "small": ["small"], "mid_size": ["mid-size", "MID_SIZE", "mid size"]}
    rows = []
    for i in range(600):
        s = rng.choices(["big", "small", "mid_size", "unlisted", None], [60, 4, 25, 8, 3])[0]
        rows.append((i, rng.choice(spell.get(s, [s])), rng.choice(["en", "EN", "en-GB", "de", None]), rng.choice([0, 5, 40, 300]), i, "clash"))
    rows += [(5, "big", "en", 1, 700, "clash"), (None, "big", "en", 9, 701, "clash"), (None, "big", "en", 9, 702, "clash")]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.2, 3), ("mid_size", 0.3, 2), ("absent", 0.1, 2), (None, 0.5, 1)], TARGETS)
    mix = Mixture(docs, targets, seed=seed, domains={"big": "d", "small": "e", "mid_size": "e"})
    chosen = mix.chosen().collect()
    keys = [r["doc_id"] for r in chosen if r["doc_id"] is not None]
    assert len(keys) == len(set(keys)) and all(r["times_used"] >= 1 and r["n_tokens"] > 0 for r in chosen)
    limit = {"big": 1, "small": 3, "mid_size": 2}
    assert all(r["times_used"] <= limit[r["source"]] for r in chosen)
    longest = max((r[3] for r in rows), default=0)
    for leaf, budget in mix.budgets.items():
        own = [r for r in chosen if (r["domain"], r["lang"], r["source"]) == leaf]
        used = sum(r["n_tokens"] * r["times_used"] for r in own)
        assert used <= budget and (budget - used <= longest), leaf
        times = {r["times_used"] for r in own}
        assert not times or max(times) - min(times) <= 1  # whole epochs and one prefix
    used = sum(r["n_tokens"] * r["times_used"] for r in chosen)
    assert 0 <= sum(mix.budgets.values()) - used < longest and mix.total - used < longest
    assert all(r["repeats_kept"] and r["budget_kept"] and r["spent"] for r in mix.check(mix.chosen()).collect())
    shares = {r["source"]: r for r in mix.shares(mix.chosen()).collect()}
    assert set(shares) == {"big", "small", "mid_size", "absent"} and shares["absent"]["used_tokens"] == 0
    assert abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
    again = Mixture(docs.repartition(7), targets, seed=seed, domains={"big": "d", "small": "e", "mid_size": "e"}).chosen()
    assert sorted(tuple(map(str, r)) for r in again.collect()) == sorted(tuple(map(str, r)) for r in chosen)


def test_prefix_follows_the_seeded_order(spark):
    docs = spark.createDataFrame([(i, "s", "en", 10, i, "") for i in range(200)], DOCS)
    targets = spark.createDataFrame([("s", 1.0, 3)], TARGETS)
    one = {r["doc_id"] for r in Mixture(docs, targets, total_tokens=995, seed=1).chosen().collect()}
    two = {r["doc_id"] for r in Mixture(docs, targets, total_tokens=995, seed=2).chosen().collect()}
    more = {r["doc_id"] for r in Mixture(docs, targets, total_tokens=1500, seed=1).chosen().collect()}
    assert len(one) == 99 and one != two and one < more


def test_remainders_go_to_siblings_first(spark):
    """Documents of 10 and 7 tokens: what a leaf cannot spend buys documents of its siblings."""
    rows = [(i, "a" if i % 2 else "b", "en", 10 if i % 2 else 7, i, "") for i in range(200)] + [(i, "c", "en", 9, i, "") for i in range(200, 300)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.4, 1), ("c", 0.2, 1)], TARGETS)
    mix = Mixture(docs, targets, total_tokens=1009, domains={"a": "d", "b": "d"})
    used = {r["source"]: r["used_tokens"] for r in mix.shares(mix.chosen()).collect()}
    assert {leaf[2]: b for leaf, b in mix.planned.items()} == {"a": 403, "b": 403, "c": 201}
    assert used["a"] == 400 and used["b"] == 406 and used["c"] == 198 and 1009 - sum(used.values()) < 10
    none = Mixture(docs, targets, total_tokens=10**6)  # everything used up
    assert sum(r["used_tokens"] for r in none.shares(none.chosen()).collect()) == 100 * 26


def test_names(spark):
    df = spark.createDataFrame([(" Commit-Log\t", "en-GB"), ("a b", "DE"), (None, None), ("x", "12")], "s string, l string")
    rows = df.select(source_name(F.col("s")).alias("s"), language_name(F.col("l")).alias("l")).collect()
    assert [tuple(r) for r in rows] == [("commit_log", "en"), ("a_b", "de"), (None, "und"), ("x", "und")]


def test_empty(spark):
    docs, targets = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    for d, t in ((docs, targets), (docs, targets.limit(0))):
        mix = Mixture(d, t)
        assert mix.chosen().count() == 0 and mix.shares(mix.chosen()).count() == t.count()
