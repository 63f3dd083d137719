"""Mixing sources to target weights.

Weights run down a tree domain - language - source.  A leaf's weight is its
source's target share times the leaf's share of the source's tokens; it can give
at most its tokens times the source's ``max_repeats``.  A node's budget is dealt
to its children by weight; what a child cannot take goes to its siblings, and
only what the whole node cannot take goes to the node's own siblings.  Which domain
a source belongs to is up to the caller; sources not named are domains of their own.

A leaf spends its budget in seeded epochs: whole epochs use every document once,
the last one takes the longest prefix, in an order drawn from (seed, epoch,
document), that does not exceed the budget.  What a prefix leaves over - less than a
document - goes to one sibling of the leaf, what that one leaves over to a sibling of
their parent and so on, so that in the end less than one document is missing, unless
every leaf is used up.  The cut is found from a histogram
over the leading bits of the order key; only documents of the one cell that
straddles the cut are sorted.

Defined results: spellings of a source count as that source (lower case, outer
white space dropped, hyphen and space as underscore); languages count by their
primary subtag, unknown ones as 'und'; a repeated row of a ``doc_id`` is the same
document, its largest version holds; a row with null ``doc_id`` is a document of
its own; documents without a token or whose source is not listed are not chosen;
null shares and repeats count as 0; a source listed twice has the sum of its
shares and the least of its repeats; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.workspace import materialise

_CELL_BITS = 16


def source_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"[\s\-]+", "_")


def language_name(c: Column) -> Column:
    tag = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    return F.when(tag != "", tag).otherwise("und")


def water_fill(budget: float, weights: Mapping, caps: Mapping) -> dict:
    """Deal ``budget`` by weight; nobody exceeds its cap, shortages go to the others."""
    given = dict.fromkeys(weights, 0.0)
    open_ = {k for k in weights if weights[k] > 0 and caps[k] > 0}
    left = min(float(budget), float(sum(caps[k] for k in open_)))
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if given[k] + left * weights[k] / total >= caps[k]}
        if not full:
            for k in open_:
                given[k] += left * weights[k] / total
            break
        for k in full:
            left -= caps[k] - given[k]
            given[k] = float(caps[k])
        open_ -= full
    return given


def leaf_budgets(leaves: list[tuple[tuple[str, str, str], float, int]], budget: float) -> dict[tuple[str, str, str], int]:
    """Token budgets of leaves ((domain, language, source), weight, cap)."""

    def deal(rows: list, budget: float, level: int) -> dict:
        if level == 3:
            return {rows[0][0]: int(min(budget, rows[0][2]) + 1e-6)}
        children: dict = {}
        for row in rows:
            children.setdefault(row[0][level], []).append(row)
        given = water_fill(
            budget,
            {k: sum(r[1] for r in rs) for k, rs in children.items()},
            {k: sum(r[2] for r in rs if r[1] > 0) for k, rs in children.items()},
        )
        return {leaf: b for k, rs in children.items() for leaf, b in deal(rs, given[k], level + 1).items()}

    return deal(leaves, budget, 0) if leaves else {}


class Mixture:
    """Chosen documents of sized ``documents`` (doc_id, source, lang, n_tokens, item)."""

    def __init__(self, documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 17, domains: Mapping[str, str] | None = None):
        self.spark, self.seed = documents.sparkSession, seed
        domains = domains or {}
        self.targets: dict[str, tuple[float, int]] = {}
        for r in targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").collect():
            if r["s"]:
                share, repeats = self.targets.get(r["s"], (0.0, r["max_repeats"] or 0))
                self.targets[r["s"]] = (share + (r["target_share"] or 0.0), min(repeats, r["max_repeats"] or 0))
        listed = self.spark.createDataFrame(
            [(s, domains.get(s, s)) for s in self.targets], "source string, domain string"
        )
        one = (
            documents.withColumn("source", source_name(F.col("source")))
            .withColumn("lang", language_name(F.col("lang")))
            .groupBy("doc_id", F.when(F.col("doc_id").isNull(), F.col("item")).alias("_own"))
            .agg(F.max(F.struct("n_tokens", "source", "lang")).alias("d"))
            .select("doc_id", "_own", "d.*")
            .where("n_tokens > 0")
            .join(F.broadcast(listed), "source")
        )
        self.docs = materialise(one, "mix")
        per_leaf = self.docs.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("t"), F.avg("n_tokens").alias("mean"), F.min("n_tokens").alias("least")).collect()
        self.least = min((r["least"] for r in per_leaf), default=0)
        self.mean = {(r["domain"], r["lang"], r["source"]): r["mean"] for r in per_leaf}
        self.tokens = {(r["domain"], r["lang"], r["source"]): r["t"] for r in per_leaf}
        self.available = dict.fromkeys(self.targets, 0)
        for leaf, t in self.tokens.items():
            self.available[leaf[2]] += t
        self.total = sum(self.available.values()) if total_tokens is None else total_tokens
        leaves = [
            (leaf, self.targets[leaf[2]][0] * t / self.available[leaf[2]], t * self.targets[leaf[2]][1])
            for leaf, t in sorted(self.tokens.items())
        ]
        leaves += [((domains.get(s, s), "und", s), w, 0) for s, (w, _) in sorted(self.targets.items()) if not self.available[s]]
        self.budgets = leaf_budgets(leaves, self.total)
        self.planned = dict(self.budgets)
        self._spend_remainders()

    def _spend_remainders(self) -> None:
        """Raise the budget of one leaf a group by what the group's prefixes leave over:
        first among the sources of a language, then in a domain, then of all."""
        caps = {leaf: t * self.targets[leaf[2]][1] for leaf, t in self.tokens.items()}
        for level in (2, 1, 0):
            used = dict.fromkeys(caps, 0)
            for r in self._chosen(self.budgets).groupBy("domain", "lang", "source").agg(F.sum(F.col("n_tokens") * F.col("times_used")).alias("t")).collect():  # a row a leaf
                used[r["domain"], r["lang"], r["source"]] = r["t"]
            left: dict = {}
            for leaf in caps:
                left[leaf[:level]] = left.get(leaf[:level], 0) + self.budgets[leaf] - used[leaf]
                self.budgets[leaf] = used[leaf]
            if sum(left.values()) < self.least:  # no document is that short
                break
            for group, rest in left.items():
                room = {x: caps[x] - used[x] for x in caps if x[:level] == group and self.targets[x[2]][0] > 0}
                if room:  # where there is room for it, the leaf of the shortest documents
                    leaf = max(room, key=lambda x: (min(room[x], rest), -self.mean[x], x))
                    self.budgets[leaf] += min(rest, room[leaf])

    def chosen(self) -> DataFrame:
        """(doc_id, domain, lang, source, n_tokens, times_used) with times_used > 0."""
        return self._chosen(self.budgets)

    def _chosen(self, budgets: Mapping[tuple[str, str, str], int]) -> DataFrame:
        plan = []
        for leaf, t in self.tokens.items():
            full, rest = divmod(budgets[leaf], t)
            if full >= self.targets[leaf[2]][1]:
                full, rest = self.targets[leaf[2]][1], 0
            plan.append((*leaf, full, rest))
        leaf_cols = ["domain", "lang", "source"]
        plans = F.broadcast(self.spark.createDataFrame(plan, "domain string, lang string, source string, full bigint, rest bigint"))
        keyed = self.docs.join(plans, leaf_cols).withColumn(
            "key", F.xxhash64(F.lit(self.seed), F.col("full") + 1, "doc_id", "_own")
        ).withColumn("cell", F.shiftrightunsigned("key", 64 - _CELL_BITS))
        # at most 2^16 rows a leaf
        upto = Window.partitionBy(*leaf_cols).orderBy("cell")
        cells = (
            keyed.where("rest > 0").groupBy(*leaf_cols, "cell", "rest").agg(F.sum("n_tokens").alias("held"))
            .withColumn("cum", F.sum("held").over(upto))
            .select(*leaf_cols, "cell", (F.col("rest") - F.col("cum") + F.col("held")).alias("room"), "held")
            .where("room > 0")
        )
        whole = cells.where("held <= room").select(*leaf_cols, "cell", F.lit(True).alias("all_in"), F.lit(0).cast("bigint").alias("room"))
        cut = cells.where("held > room").select(*leaf_cols, "cell", F.lit(False).alias("all_in"), "room")
        marked = keyed.join(whole.unionByName(cut), [*leaf_cols, "cell"], "left")
        run = Window.partitionBy(*leaf_cols).orderBy("key", "doc_id", "_own").rowsBetween(Window.unboundedPreceding, 0)
        straddling = (
            marked.where(F.col("all_in") == F.lit(False)).withColumn("extra", (F.sum("n_tokens").over(run) <= F.col("room")).cast("int"))
        )
        others = marked.where(F.col("all_in").isNull() | F.col("all_in")).withColumn("extra", F.coalesce(F.col("all_in"), F.lit(False)).cast("int"))
        return (
            others.unionByName(straddling)
            .select("doc_id", *leaf_cols, "n_tokens", (F.col("full") + F.col("extra")).alias("times_used"))
            .where("times_used > 0")
        )

    def shares(self, chosen: DataFrame) -> DataFrame:
        """Per listed source its target, what it could give, its budget and its actual share."""
        budget = dict.fromkeys(self.targets, 0)
        for leaf, b in self.planned.items():
            budget[leaf[2]] += b
        rows = [(s, w, self.available[s], self.available[s] * r, budget[s]) for s, (w, r) in sorted(self.targets.items())]
        listed = self.spark.createDataFrame(rows, "source string, target_share double, available_tokens bigint, most_tokens bigint, budget_tokens bigint")
        used = chosen.groupBy("source").agg(
            F.sum(F.col("n_tokens") * F.col("times_used")).alias("used_tokens"), F.count("*").alias("documents"), F.max("times_used").alias("most_repeats")
        )
        every = Window.partitionBy()
        return (
            listed.join(used, "source", "left").fillna(0, ["used_tokens", "documents", "most_repeats"])
            .withColumn("actual_share", F.coalesce(F.col("used_tokens") / F.sum("used_tokens").over(every), F.lit(0.0)))
        )

    def check(self, chosen: DataFrame) -> DataFrame:
        """Per listed source: documents it has, and whether no document is used too often, no
        leaf exceeds its budget, and less than the largest document is missing from the total."""
        largest = self.docs.agg(F.max("n_tokens")).first()[0] or 0
        wanted = min(self.total, sum(t * self.targets[leaf[2]][1] for leaf, t in self.tokens.items() if self.targets[leaf[2]][0] > 0))
        final = dict.fromkeys(self.targets, 0)
        for leaf, b in self.budgets.items():
            final[leaf[2]] += b
        limits = self.spark.createDataFrame([(s, r, final[s]) for s, (_, r) in self.targets.items()], "source string, max_repeats int, final bigint")
        there = self.docs.groupBy("source").agg(F.count("*").alias("available_documents"))
        every = Window.partitionBy()  # a row a source
        return (
            self.shares(chosen).join(there, "source", "left").fillna(0, ["available_documents"]).join(limits, "source")
            .select(
                "source", "target_share", "available_documents",
                (F.col("most_repeats") <= F.col("max_repeats")).alias("repeats_kept"), (F.col("used_tokens") <= F.col("final")).alias("budget_kept"),
                (F.lit(wanted) - F.sum("used_tokens").over(every) < F.lit(max(1, largest))).alias("spent"),
            )
        )
