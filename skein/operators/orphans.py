"""References to records that do not exist.

``references`` turns any table into one row per named id; the finder decides for
each of them whether the record it names was live at the time of the reference.

Plan: ids that need no record (library symbols) are removed by an anti-join: ahead
of everything where their number, which is checked, allows a broadcast, else from
the groups, where no id holds many rows.  References are pre-aggregated per table,
side, key and period to (count, first, last).  Keys that hold at least one
``heavy_keys``-th of the references - at most ``heavy_keys`` of them, and never
fewer than would fill a mean shuffle partition on their own - are answered by
broadcasting their groups against the records; all others by a shuffle join.  A
group is live (one lifetime covers first..last), orphan (no lifetime touches it) or
mixed.  Counts of orphan groups are final; only references of mixed groups are
looked at one by one, for counts as for rows.

To find the references of groups again they pass a filter of fixed size over the
keys in doubt (:mod:`skein.operators.keyfilter`), on at every size; those of heavy
keys then meet their groups and lifetimes by broadcast, all others by shuffle.

Defined results: null ids are no references; a reference with a null time meets
no lifetime, hence is an orphan; a record with null ``loadedat`` is never live; ids and projects are compared as they stand and a null project
matches nothing; repeated rows each count; empty tables give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.keyfilter import key_filter, may_be_among
from skein.workspace import materialise

REF_COLUMNS = ["table_name", "row_no", "side", "project", "id", "at"]
_KEY = ["project", "id"]
_GROUP = ["table_name", "side", *_KEY, "period"]


def references(df: DataFrame, table: str, row_no: str, at: str, sides: dict[str, str], project: str = "project") -> DataFrame:
    """One row per non-null id that a row of ``df`` names; ``sides`` maps side -> column."""
    named = F.array(*[F.struct(F.lit(side).alias("side"), F.col(c).alias("id")) for side, c in sides.items()])
    return (
        df.select(
            F.lit(table).alias("table_name"),
            F.col(row_no).cast("bigint").alias("row_no"),
            F.col(project).alias("project"),
            F.col(at).alias("at"),
            F.explode(named).alias("named"),
        )
        .select("table_name", "row_no", "named.side", "project", "named.id", "at")
        .where(F.col("id").isNotNull())
    )


@dataclass
class OrphanFinder:
    """Orphans among ``refs`` (columns :data:`REF_COLUMNS`) against ``nodes``
    (project, id, loadedat, deletedat) and ``known`` (a column ``symbol``).

    ``broadcast_rows`` bounds the broadcasts whose size is counted first: known
    symbols and lifetimes of heavy keys.  Beyond it they are joined by shuffle.
    """

    refs: DataFrame
    nodes: DataFrame
    known: DataFrame
    heavy_keys: int = 4_000
    broadcast_rows: int = 200_000
    filter_bits: int = 26

    def __post_init__(self) -> None:
        known = self.known.select(F.col("symbol").alias("id")).where(F.col("id").isNotNull())
        self.refs = self.refs.select(*REF_COLUMNS).withColumn("period", F.year("at") * 100 + F.month("at"))
        self.late_known = None
        if self._small(known):
            self.refs = self.refs.join(F.broadcast(known), "id", "left_anti").select(*REF_COLUMNS, "period")
        else:
            self.late_known = known.distinct()
        # redeliveries of a lifetime collapse: only its earliest start matters
        self.lives = (
            self.nodes.where(F.col("loadedat").isNotNull())
            .groupBy(*_KEY, "deletedat")
            .agg(F.min("loadedat").alias("loadedat"))
        )

    def _small(self, df: DataFrame) -> bool:
        return df.limit(self.broadcast_rows + 1).count() <= self.broadcast_rows

    def groups(self) -> DataFrame:
        """(table_name, side, project, id, period, n, verdict, hot) of every group of references."""
        pre = self.refs.groupBy(*_GROUP).agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
        if self.late_known is not None:
            pre = pre.join(self.late_known, "id", "left_anti").select(*_GROUP, "n", "lo", "hi")
        pre = materialise(pre, "refs")
        total = pre.agg(F.sum("n")).first()[0] or 0
        most = max(self.heavy_keys, int(pre.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        heavy = pre.groupBy(*_KEY).agg(F.sum("n").alias("held")).where(F.col("held") * most >= total)
        # at most `most` keys, and as many groups as there are tables, sides and periods for each
        self.heavy = heavy = materialise(heavy.select(*_KEY), "heavy")
        heavy_groups = pre.join(F.broadcast(heavy), _KEY, "left_semi")
        light_groups = pre.join(F.broadcast(heavy), _KEY, "left_anti")

        far = F.lit("9999-12-31").cast(self.nodes.schema["deletedat"].dataType)
        lives = self.lives.select(F.col("project").alias("p"), F.col("id").alias("i"), "loadedat", F.coalesce("deletedat", far).alias("until"))
        same = (F.col("project") == F.col("p")) & (F.col("id") == F.col("i"))
        touches = (F.col("loadedat") <= F.col("hi")) & (F.col("until") > F.col("lo"))
        covers = (F.col("loadedat") <= F.col("lo")) & (F.col("until") > F.col("hi"))

        def judged(found: DataFrame, hot: bool) -> DataFrame:
            return (
                found.groupBy(*_GROUP).agg(
                    F.first("n").alias("n"),
                    F.max(F.coalesce("touch", F.lit(False))).alias("touch"),
                    F.max(F.coalesce("cover", F.lit(False))).alias("cover"),
                )
                .withColumn("verdict", F.when(F.col("cover"), "live").when(F.col("touch"), "mixed").otherwise("orphan"))
                .select(*_GROUP, "n", "verdict", F.lit(hot).alias("hot"))
            )

        flags = [*[F.col(c) for c in (*_GROUP, "n")], touches.alias("touch"), covers.alias("cover")]
        light = judged(light_groups.join(lives, same, "left").select(*flags), hot=False)
        hit = lives.join(F.broadcast(heavy_groups), same, "inner").select(*flags)
        none = heavy_groups.select(*_GROUP, "n", F.lit(False).alias("touch"), F.lit(False).alias("cover"))
        return light.unionByName(judged(none.unionByName(hit), hot=True))

    def _bad(self) -> DataFrame:
        return materialise(self.groups().where("verdict <> 'live'"), "bad")

    def _references_of(self, bad: DataFrame) -> DataFrame:
        """References of the groups ``bad``, with their verdict and whether they are hot."""
        held = key_filter(bad, _KEY, self.filter_bits)
        refs = materialise(may_be_among(self.refs, _KEY, held, self.filter_bits), "maybe")
        same = F.lit(True)
        for c in _GROUP:
            same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}"))
        kept = [*[F.col(f"r.{c}") for c in (*REF_COLUMNS, "period")], "b.verdict", "b.hot"]
        light = refs.join(F.broadcast(self.heavy), _KEY, "left_anti").alias("r").join(bad.where("not hot").alias("b"), same)
        hot = refs.alias("r").join(F.broadcast(bad.where("hot")).alias("b"), same)
        return light.select(*kept).unionByName(hot.select(*kept))

    def _without_life(self, doubt: DataFrame) -> DataFrame:
        """References of mixed groups that meet no lifetime."""
        alive = (
            (F.col("d.project") == F.col("l.project"))
            & (F.col("d.id") == F.col("l.id"))
            & (F.col("l.loadedat") <= F.col("d.at"))
            & (F.col("l.deletedat").isNull() | (F.col("d.at") < F.col("l.deletedat")))
        )
        of_heavy = materialise(self.lives.join(F.broadcast(self.heavy), _KEY, "left_semi"), "lives")
        of_heavy = F.broadcast(of_heavy) if self._small(of_heavy) else of_heavy
        light = doubt.where("not hot").alias("d").join(self.lives.alias("l"), alive, "left_anti")
        hot = doubt.where("hot").alias("d").join(of_heavy.alias("l"), alive, "left_anti")
        return light.unionByName(hot)

    def rows(self) -> DataFrame:
        """(table_name, row_no, side, period) of every orphan reference."""
        found = materialise(self._references_of(self._bad()), "suspects")
        out = ["table_name", "row_no", "side", "period"]
        orphans = found.where("verdict = 'orphan'").unionByName(self._without_life(found.where("verdict = 'mixed'")))
        return orphans.select(*out)

    def counts(self) -> DataFrame:
        """Orphan references per (table_name, side, period); period is yyyymm."""
        bad = self._bad()
        sure = bad.where("verdict = 'orphan'").select("table_name", "side", "period", "n")
        doubt = materialise(self._references_of(bad.where("verdict = 'mixed'")), "doubt")
        single = self._without_life(doubt).select("table_name", "side", "period", F.lit(1).cast("bigint").alias("n"))
        return sure.unionByName(single).groupBy("table_name", "side", "period").agg(F.sum("n").alias("orphans"))
