"""Per-key results when a handful of keys hold most rows.

Exact offset chunking.  Rows are pre-aggregated per (key, group, member), which
also folds copies, then sorted by that order over equal ranges.  Counting rows
per sorted partition and prefix-summing the counts numbers every row.  A chunk is
``chunk_rows`` consecutive numbers: unless given, the rows are cut into
``CHUNKS_PER_TASK`` equal chunks a shuffle partition, of at most ``MOST_ROWS``, so
that a key that would overburden a task spans several.  Each (key, chunk) yields a small ordered state;
the states of a key are merged in chunk order, a group that crosses a chunk
boundary being counted once because the left state's last group equals the right
state's first.

Defined results: rows with a null key are left out; null groups and members are
counted as rows but not as distinct values; repeated rows each count as rows;
null times are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.ordering import numbered


CHUNKS_PER_TASK = 4
MOST_ROWS = 1_000_000


def key_profile(df: DataFrame, key: str, group: str, member: str, at: str, chunk_rows: int | None = None) -> DataFrame:
    """Per ``key``: n_rows, n_groups, n_members (distinct (group, member)), first_at, last_at."""
    pre = (
        df.where(F.col(key).isNotNull())
        .select(F.col(key).alias("k"), F.col(group).alias("g"), F.col(member).alias("m"), F.col(at).alias("t"))
        .groupBy("k", "g", "m")
        .agg(F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    )
    rows, total = numbered(pre, ["k", "g", "m"], out="gno", label="keys")
    if chunk_rows is None:
        chunks = CHUNKS_PER_TASK * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chunk_rows = min(MOST_ROWS, max(1, -(-total // chunks)))
    states = (
        rows.withColumn("chunk", F.floor(F.col("gno") / chunk_rows))
        .groupBy("k", "chunk", "g")
        .agg(
            F.sum("n").alias("n"),
            F.count("m").alias("members"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )
        .groupBy("k", "chunk")
        .agg(
            F.sum("n").alias("n"),
            F.sum("members").alias("members"),
            F.count("g").alias("groups"),
            F.min("g").alias("first_g"),
            F.max("g").alias("last_g"),
            F.min("lo").alias("lo"),
            F.max("hi").alias("hi"),
        )
    )
    in_order = Window.partitionBy("k").orderBy("chunk")
    before = F.last("last_g", ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        states.withColumn("shared", F.coalesce((before == F.col("first_g")).cast("int"), F.lit(0)))
        .groupBy("k")
        .agg(
            F.sum("n").alias("n_rows"),
            (F.sum("groups") - F.sum("shared")).alias("n_groups"),
            F.sum("members").alias("n_members"),
            F.min("lo").alias("first_at"),
            F.max("hi").alias("last_at"),
        )
        .withColumnRenamed("k", key)
    )


def dominant_keys(profile: DataFrame, key: str, total: int, share_percent: int = 2) -> DataFrame:
    """Keys of a :func:`key_profile` that hold at least ``share_percent`` % of ``total`` rows."""
    return profile.where(F.col("n_rows") * 100 >= F.lit(total) * share_percent).where(F.lit(total > 0)).select(key)
