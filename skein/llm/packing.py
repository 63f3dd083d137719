"""Filling fixed-capacity containers with documents.

Hierarchical packing over lengths.  Below each capacity lie context-size tiers,
each half as long as the one above; a document is routed to the shortest tier that
holds it.  From the longest tier down each tier is packed on its own, and what its
containers leave free is then filled from the shorter tiers, the longest documents
first; only what no gap of a longer tier took is packed with its own tier.  Within
a pass best fit in decreasing length places the documents.

Sizes are integers of at most the capacity, so the whole collection is described
by a histogram of at most ``capacity`` counts.  The driver packs that histogram
tier by tier - whole groups of equal containers at a time - and gets patterns with repeat counts.  Documents are numbered in the order of
their length over all partitions, and that number alone tells container and
place, so assignment is a lookup and no document moves to the driver.

Containers are numbered by falling cost (sum of squared lengths, the cost of
attention within documents) and go to step groups largest first, each to the group
that costs least so far, whole ranges of equal containers at a time.  There is one
group for every ``step_containers`` containers; groups cost about the same and may
differ in containers.

Defined results: a document larger than the capacity is cut into full pieces and
one rest, all others stay whole; documents without a token (null or empty text)
are in no container; copies and repeated rows are items of their own; capacities
that are null or below 1 are ignored; empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.ordering import global_index
from skein.workspace import materialise, ship


@dataclass
class Pattern:
    """``repeat`` containers of equal content: runs of (length, how often)."""

    repeat: int
    free: int
    runs: tuple[tuple[int, int], ...]

    @property
    def cost(self) -> int:
        return sum(length * length * n for length, n in self.runs)


def tiers_of(capacity: int, tiers: int) -> list[int]:
    """Longest document of each tier, ascending; the last is the capacity."""
    return sorted({max(1, capacity >> k) for k in range(max(1, tiers))})


class _Open:
    """Containers that take more, by what they have free."""

    def __init__(self, capacity: int):
        self.capacity, self.by_free, self.frees, self.full = capacity, {}, [], []

    def put(self, p: Pattern) -> None:
        if p.free == 0:
            self.full.append(p)
            return
        if p.free not in self.by_free:
            self.by_free[p.free] = []
            insort(self.frees, p.free)
        self.by_free[p.free].append(p)

    def take(self, length: int) -> Pattern | None:
        at = bisect_left(self.frees, length)
        if at == len(self.frees):
            return None
        free = self.frees[at]
        p = self.by_free[free].pop()
        if not self.by_free[free]:
            del self.by_free[free], self.frees[at]
        return p

    def place(self, length: int, left: int, opening: bool) -> int:
        """Best fit for ``left`` documents of a length; gives how many found no place,
        none if new containers may be opened."""
        while left > 0:
            p = self.take(length)
            if p is None:
                if not opening:
                    break
                p = Pattern(-(-left // (self.capacity // length)), self.capacity, ())
            fits = p.free // length
            full = min(p.repeat, left // fits)
            rest = left - full * fits
            if full:
                self.put(Pattern(full, p.free - fits * length, (*p.runs, (length, fits))))
            unused, left = p.repeat - full, rest
            if unused and 0 < rest < fits:
                self.put(Pattern(1, p.free - rest * length, (*p.runs, (length, rest))))
                unused, left = unused - 1, 0
            if unused and p.runs:
                self.put(Pattern(unused, p.free, p.runs))
        return left

    def all(self) -> list[Pattern]:
        return [*self.full, *(p for free in self.frees for p in self.by_free[free])]


def pack_histogram(counts: dict[int, int], capacity: int, tiers: int = 4) -> list[Pattern]:
    """Containers for a histogram of lengths, tier by tier, in falling cost."""
    left, done = dict(counts), []
    bounds = [0, *tiers_of(capacity, tiers)]
    for shorter in reversed(bounds[:-1]):
        space = _Open(capacity)
        for length in sorted((x for x in left if x > shorter), reverse=True):  # this tier, packed
            space.place(length, left.pop(length), opening=True)
        for length in sorted(left, reverse=True):  # its gaps, filled from the shorter ones
            left[length] = space.place(length, left[length], opening=False)
        done += space.all()
    return sorted(done, key=lambda p: (-p.cost, p.free, p.runs))


def step_groups(patterns: list[Pattern], groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest first onto the lightest group.  (container, group) starts of ranges in
    which container and group numbers rise together."""
    lightest: list[tuple[int, int, int]] = [(0, 0, groups)]  # (cost so far, first group, how many)
    starts, container = [], 0
    for p in patterns:
        left = p.repeat
        while left:
            cost, first, n = heappop(lightest)
            taken = min(n, left)
            starts.append((container, first))
            heappush(lightest, (cost + p.cost, first, taken))
            if n > taken:
                heappush(lightest, (cost, first + taken, n - taken))
            container, left = container + taken, left - taken
    table = np.array(starts, np.int64).reshape(-1, 2)
    return table[:, 0].copy(), table[:, 1].copy()


@dataclass
class Layout:
    """Where the i-th piece in falling length goes: sorted interval starts and
    for each interval its container, offset, pieces per container, length and the
    length that opened the container."""

    starts: np.ndarray
    container: np.ndarray
    offset: np.ndarray
    per: np.ndarray
    length: np.ndarray
    opened: np.ndarray
    containers: int
    step_starts: np.ndarray
    step_first: np.ndarray


def layout(patterns: list[Pattern], counts: dict[int, int], step_containers: int = 8) -> Layout:
    begin, at = {}, 0
    for length in sorted(counts, reverse=True):
        begin[length] = at
        at += counts[length]
    rows, container = [], 0
    for p in patterns:
        offset = 0
        for length, per in p.runs:
            rows.append((begin[length], container, offset, per, length, p.runs[0][0]))
            begin[length] += per * p.repeat
            offset += per * length
        container += p.repeat
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    steps = step_groups(patterns, -(-container // step_containers))
    return Layout(*(table[:, i].copy() for i in range(6)), container, *steps)


def pack_documents(documents: DataFrame, pack_sizes: DataFrame, step_containers: int = 8, tiers: int = 4) -> DataFrame:
    """Pieces (pack_id, capacity_tokens, container, step_group, at_token, doc_id,
    piece, start_token, n_tokens, tier_tokens, fills_gap) of the sized
    ``documents`` (doc_id, n_tokens, item)."""
    spark = documents.sparkSession
    sizes = sorted(
        {(r["pack_id"], r["capacity_tokens"]) for r in pack_sizes.select("pack_id", "capacity_tokens").distinct().collect()
         if r["pack_id"] is not None and (r["capacity_tokens"] or 0) > 0}
    )
    out = (
        "pack_id int, capacity_tokens int, container bigint, step_group bigint, at_token bigint, doc_id bigint, "
        "piece bigint, start_token bigint, n_tokens bigint, tier_tokens int, fills_gap boolean"
    )
    if not sizes:
        return spark.createDataFrame([], out)
    ship(spark)
    docs = materialise(documents.where("n_tokens > 0").select("doc_id", "n_tokens", "item"), "sized")
    # a piece per full container and one for the rest, per capacity
    packs = F.explode(F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("int").alias("capacity")) for p, c in sizes]))
    pieces = (
        docs.select("*", packs.alias("k")).select("doc_id", "item", F.col("n_tokens").alias("whole"), "k.*")
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("whole") - 1) / F.col("capacity")))))
        .withColumn("start_token", F.col("piece") * F.col("capacity"))
        .withColumn("n_tokens", F.least(F.col("capacity").cast("bigint"), F.col("whole") - F.col("start_token")))
        .drop("whole")
    )
    ordered = global_index(
        pieces, [F.col("pack_id"), F.col("capacity"), F.desc("n_tokens"), F.col("item"), F.col("piece")], "gno", "pieces"
    )
    counts: dict[tuple[int, int], dict[int, int]] = {s: {} for s in sizes}
    for r in ordered.groupBy("pack_id", "capacity", "n_tokens").agg(F.count("*").alias("n")).collect():  # at most the sum of capacities
        counts[r["pack_id"], r["capacity"]][r["n_tokens"]] = r["n"]
    plans, first, at = {}, {}, 0
    for s in sizes:
        plans[s] = layout(pack_histogram(counts[s], s[1], tiers), counts[s], step_containers)
        first[s] = at
        at += sum(counts[s].values())
    shared = spark.sparkContext.broadcast((plans, first))
    limits = {c: np.array(tiers_of(c, tiers)) for _, c in sizes}

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plans, first = shared.value
        for batch in batches:
            for (pack, capacity), rows in batch.groupby(["pack_id", "capacity"], sort=False):
                plan = plans[pack, capacity]
                no = rows["gno"].to_numpy() - first[pack, capacity]
                j = np.searchsorted(plan.starts, no, side="right") - 1
                within = no - plan.starts[j]
                container = plan.container[j] + within // plan.per[j]
                step = np.searchsorted(plan.step_starts, container, side="right") - 1
                n = rows["n_tokens"].to_numpy()
                offset = plan.offset[j] + within % plan.per[j] * plan.length[j]
                limit = limits[capacity]
                tier = limit[np.searchsorted(limit, n)]
                yield pd.DataFrame(
                    {
                        "pack_id": rows["pack_id"], "capacity_tokens": rows["capacity"], "container": container,
                        "step_group": plan.step_first[step] + container - plan.step_starts[step], "at_token": offset,
                        "doc_id": rows["doc_id"].astype("Int64"), "piece": rows["piece"], "start_token": rows["start_token"], "n_tokens": n,
                        "tier_tokens": tier, "fills_gap": tier < limit[np.searchsorted(limit, plan.opened[j])],
                    }
                )

    return ordered.select("pack_id", "capacity", "gno", "n_tokens", "doc_id", "piece", "start_token").mapInPandas(assign, out)


def pack_check(packed: DataFrame) -> DataFrame:
    """Per capacity: documents placed, and how often something is wrong - containers that
    hold too much, pieces that do not begin where the one before ends, documents cut that
    a container holds - and whether fill and step groups are as close as they should be."""
    in_place = Window.partitionBy("pack_id", "capacity_tokens", "container").orderBy("at_token", "doc_id", "piece")
    end = F.col("at_token") + F.col("n_tokens")
    wrong = packed.withColumn("gap", F.col("at_token") != F.coalesce(F.lag(end).over(in_place), F.lit(0)))
    checked = wrong.groupBy("pack_id", "capacity_tokens").agg(
        F.count_if(F.col("piece") == 0).alias("documents"),
        F.count_if(end > F.col("capacity_tokens")).alias("overfull"),
        F.count_if("gap").alias("overlapping"),
        F.count_if((F.col("piece") == 1) & (F.col("start_token") != F.col("capacity_tokens"))).alias("needlessly_split"),
    )
    report = fill_report(packed).select(
        "pack_id", "capacity_tokens",
        (F.col("containers") <= F.ceil(F.col("least_containers") * 1.005) + 1).alias("tight"), (F.col("step_cost_over_mean") <= 1.05).alias("balanced"),
    )
    return checked.join(report, ["pack_id", "capacity_tokens"])


def fill_report(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, the share in use, split documents and step costs."""
    per_container = packed.groupBy("pack_id", "capacity_tokens", "container").agg(
        F.sum("n_tokens").alias("used"), F.first("step_group").alias("step_group"),
        F.sum(F.col("n_tokens") * F.col("n_tokens")).alias("cost"), F.count("*").alias("pieces"),
        F.sum(F.when(F.col("piece") == 1, 1).otherwise(0)).alias("split"), F.count_if("fills_gap").alias("gap_pieces"),
    )
    per_step = per_container.groupBy("pack_id", "capacity_tokens", "step_group").agg(
        *[F.sum(c).alias(c) for c in ("used", "cost", "pieces", "split", "gap_pieces")], F.count("*").alias("containers")
    )
    return per_step.groupBy("pack_id", "capacity_tokens").agg(
        F.sum("containers").alias("containers"),
        F.sum("used").alias("tokens"),
        (F.sum("used") / (F.sum("containers") * F.first("capacity_tokens"))).alias("fill"),
        F.ceil(F.sum("used") / F.first("capacity_tokens")).alias("least_containers"),
        F.sum("pieces").alias("pieces"),
        F.sum("split").alias("split_documents"),
        F.sum("gap_pieces").alias("gap_pieces"),
        F.count("*").alias("step_groups"),
        (F.max("cost") / F.avg("cost")).alias("step_cost_over_mean"),
    )
