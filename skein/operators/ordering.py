"""Global row numbers without a single-partition window.

Range-partition and sort by the keys, write the result, count rows per written
partition, prefix-sum the counts and add the partition's offset to the local
position.  The only data that reaches the driver is one number per partition.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.workspace import materialise

_LOCAL_BITS = 33


def global_index(df: DataFrame, keys: list[str | Column], out: str = "gno", label: str = "sorted") -> DataFrame:
    return numbered(df, keys, out, label)[0]


def numbered(df: DataFrame, keys: list[str | Column], out: str = "gno", label: str = "sorted") -> tuple[DataFrame, int]:
    """``df`` plus a dense 0-based bigint ``out`` in the order of ``keys``, and the number of rows.

    Rows that tie on every key share a partition, so ``keys`` should end in
    something that tells copies apart.  An empty input gives an empty frame.
    """
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
    )
    written = materialise(placed, label)
    part = F.shiftright(F.col("_at"), _LOCAL_BITS)
    local = F.col("_at").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    sizes = sorted(
        (r["part"], r["n"])
        for r in written.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    )
    starts = list(accumulate((n for _, n in sizes), initial=0))
    offsets = df.sparkSession.createDataFrame(
        [(p, s) for (p, _), s in zip(sizes, starts)], "_part bigint, _start bigint"
    )
    frame = (
        written.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(out, F.col("_start") + local)
        .drop("_part", "_start", "_at")
    )
    return frame, starts[-1]
