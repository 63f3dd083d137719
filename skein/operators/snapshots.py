"""What changed between consecutive full snapshots.

Within a snapshot the row with the highest delivery number of a key holds; that
is a map-side combined aggregate, so redelivered copies never pile up in a task.
Each key is then windowed by snapshot index: a lagging content hash that differs
reveals a change, an index gap a removal and a later addition.

Defined results: null differs from any value (also from the empty string), null
equals null; a null key column is a value like any other; rows with a null
snapshot number are ignored; a null delivery number is lower than any other; of
rows that tie on it the one with the greater hash holds; snapshots are compared
in the order of their numbers, numbers that no row has are skipped; one or no
snapshot gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(columns: list[str]) -> Column:
    """64-bit hash of the columns in which null and any value differ."""
    parts: list[Column] = []
    for c in columns:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)


def snapshot_changes(df: DataFrame, keys: list[str], compared: list[str], snapshot: str, delivery: str) -> DataFrame:
    """(keys..., snapshot, change_kind) for every snapshot after the first."""
    numbers = sorted(r[0] for r in df.select(snapshot).where(F.col(snapshot).isNotNull()).distinct().collect())
    spark = df.sparkSession
    schema = df.select(*keys, snapshot).schema.add("change_kind", "string")
    if len(numbers) < 2:
        return spark.createDataFrame([], schema)
    order = F.create_map(*[F.lit(x) for pair in ((n, i) for i, n in enumerate(numbers)) for x in pair])
    held = (
        df.where(F.col(snapshot).isNotNull())
        .select(*keys, F.element_at(order, F.col(snapshot)).alias("_i"), F.coalesce(F.col(delivery).cast("bigint"), F.lit(-(2**63))).alias("_seq"), content_hash(compared).alias("_h"))
        .groupBy(*keys, "_i")
        .agg(F.max(F.struct("_seq", "_h")).alias("_top"))
        .select(*keys, "_i", F.col("_top._h").alias("_h"))
    )
    per_key = Window.partitionBy(*keys).orderBy("_i")
    last = len(numbers) - 1
    stepped = held.select(
        *keys, "_i", "_h",
        F.lag("_i").over(per_key).alias("_before"),
        F.lag("_h").over(per_key).alias("_was"),
        F.lead("_i").over(per_key).alias("_after"),
    )
    event = lambda at, kind: F.struct(at.alias("_at"), F.lit(kind).alias("change_kind"))
    i = F.col("_i")
    starts = F.when((i > 0) & (F.col("_before").isNull() | (F.col("_before") < i - 1)), event(i, "added")).when(
        (F.col("_before") == i - 1) & (F.col("_was") != F.col("_h")), event(i, "changed")
    )
    ends = F.when((i < last) & (F.col("_after").isNull() | (F.col("_after") > i + 1)), event(i + 1, "removed"))
    back = F.create_map(*[F.lit(x) for pair in enumerate(numbers) for x in pair])
    return (
        stepped.select(*keys, F.explode(F.array(starts, ends)).alias("_e"))
        .where(F.col("_e").isNotNull())
        .select(*keys, F.element_at(back, F.col("_e._at")).cast(schema[snapshot].dataType).alias(snapshot), F.col("_e.change_kind").alias("change_kind"))
    )
