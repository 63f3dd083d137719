from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from skein.llm.packing import Pattern, fill_report, layout, pack_check, pack_documents, pack_histogram, step_groups, tiers_of
from skein.llm.tokens import encoding, DEFAULT_RANKS, sized


def best_fit_decreasing(sizes, capacity):
    """One item at a time, the plain way."""
    bins = []
    for s in sorted(sizes, reverse=True):
        fits = [b for b in bins if b + s <= capacity]
        if fits:
            bins.remove(max(fits))
            bins.append(max(fits) + s)
        else:
            bins.append(s)
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_patterns_hold_everything(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 64, 256])
    counts = Counter(rng.randint(1, capacity) for _ in range(rng.choice([1, 50, 2000])))
    patterns = pack_histogram(counts, capacity)
    held = Counter()
    for p in patterns:
        assert sum(n * k for n, k in p.runs) == capacity - p.free and p.repeat > 0 and p.free >= 0
        for n, k in p.runs:
            held[n] += k * p.repeat
    assert held == counts
    bins, total = sum(p.repeat for p in patterns), sum(n * k for n, k in counts.items())
    assert bins <= best_fit_decreasing(list(counts.elements()), capacity) * 1.02 + 1
    assert bins >= -(-total // capacity)
    plan = layout(patterns, counts)
    assert plan.containers == bins and list(plan.starts) == sorted(plan.starts)


def test_hot_length_is_packed_by_groups():
    patterns = pack_histogram({3: 10**12, 1: 10}, 10)
    assert sum(p.repeat * k for p in patterns for n, k in p.runs if n == 3) == 10**12 and len(patterns) < 6


DOCS = "doc_id bigint, text string, n_tokens bigint, item bigint, capacity int"


@pytest.mark.parametrize("sizes", [[1, 5, 9, 10, 10, 11, 25, 40, 3, 3, 3], [10] * 30, [1], [1000]])
def test_documents_are_placed_whole(spark, sizes):
    docs = spark.createDataFrame([(i // 2, "t", n, i, 0) for i, n in enumerate([*sizes, 0])], DOCS).repartition(3)
    packs = spark.createDataFrame([(1, 10), (2, 25), (2, None), (None, 5), (3, 0)], "pack_id int, capacity_tokens int")
    packed = pack_documents(docs, packs, step_containers=2)
    rows = packed.collect()
    for pack, capacity in ((1, 10), (2, 25)):
        own = [r for r in rows if r["pack_id"] == pack]
        assert sum(r["n_tokens"] for r in own) == sum(sizes)
        spans = defaultdict(list)
        for r in own:
            spans[r["container"]].append((r["at_token"], r["at_token"] + r["n_tokens"]))
        for s in spans.values():
            s.sort()
            assert s[0][0] == 0 and s[-1][1] <= capacity and all(a[1] == b[0] for a, b in zip(s, s[1:]))
        assert sorted(spans) == list(range(len(spans)))
        pieces = sum(-(-n // capacity) for n in sizes)
        assert len(own) == pieces  # only what is larger than a container is cut
        assert {r["step_group"] for r in own} == set(range(-(-len(spans) // 2)))
        assert all(r["n_tokens"] <= r["tier_tokens"] <= capacity for r in own)
    assert fill_report(packed).count() == 2
    for r in pack_check(packed).collect():
        assert (r["documents"], r["overfull"], r["overlapping"], r["needlessly_split"]) == (len(sizes), 0, 0, 0)


def test_longer_tiers_open_and_shorter_ones_fill():
    assert tiers_of(256, 4) == [32, 64, 128, 256] and tiers_of(1, 4) == [1] and tiers_of(10, 1) == [10]
    # 6 and 5 are of the tier of 10, packed on their own; 3 and 4 fill what they leave, the rest are packed last
    patterns = pack_histogram({6: 2, 5: 2, 4: 1, 3: 4}, 10, tiers=2)
    assert sorted(p.runs for p in patterns) == sorted([((5, 2),), ((6, 1), (3, 1)), ((6, 1), (4, 1)), ((3, 3),)])


@pytest.mark.parametrize("seed", range(4))
def test_step_groups_are_dealt_largest_first(seed):
    rng = random.Random(seed)
    patterns = [Pattern(rng.randint(1, 30), 0, ((rng.randint(1, 50), 1),)) for _ in range(40)]
    patterns.sort(key=lambda p: -p.cost)
    n = sum(p.repeat for p in patterns)
    groups = -(-n // 8)
    starts, first = step_groups(patterns, groups)
    load, by_hand = [0] * groups, [0] * groups
    for container, cost in enumerate(c for p in patterns for c in [p.cost] * p.repeat):
        j = max(i for i, s in enumerate(starts) if s <= container)
        load[first[j] + container - starts[j]] += cost
        by_hand[by_hand.index(min(by_hand))] += cost
    assert max(load) <= max(by_hand) * 1.02 and max(load) <= 1.05 * sum(load) / groups
    assert len(step_groups([Pattern(10**12, 0, ((3, 1),))], 10**11)[0]) == 10


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    packs = spark.createDataFrame([(1, 10)], "pack_id int, capacity_tokens int")
    assert pack_documents(docs, packs).count() == 0
    assert pack_documents(docs, packs.limit(0)).count() == 0
    assert fill_report(pack_documents(docs, packs)).count() == 0


def test_sizes_are_those_of_the_tokenizer(spark):
    texts = [None, "", " ", "hello world", "naïve 北京 <|endoftext|>", "x " * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in sized(df, "doc_id").collect()}
    enc = encoding(DEFAULT_RANKS)
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary(texts[4])) == texts[4]
