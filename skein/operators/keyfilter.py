"""A filter of fixed size for rows whose key may be among many.

Each key sets one of 2^bits bits.  The bits are kept as rows of 512 words, so the
whole filter is at most 2^bits / 8 bytes however many keys there are, which bounds
the broadcast; it is built by map-side combined aggregates and never reaches the
driver's Python.  Rows whose key is among the keys always pass; of the others
about (number of keys) / 2^bits do, so what follows must compare keys itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORDS = 9  # words of 64 bits in a row, as a power of two


def _slot(columns: list[str], bits: int) -> Column:
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << bits) - 1))


def key_filter(keys: DataFrame, columns: list[str], bits: int = 26) -> DataFrame:
    """Rows (_bucket, _words) of the filter over the ``columns`` of ``keys``."""
    words = (
        keys.select(_slot(columns, bits).alias("slot"))
        .groupBy(F.expr("shiftright(slot, 6)").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63L as int)))").alias("set"))
    )
    at = F.map_from_entries(F.collect_list(F.struct((F.col("word") % (1 << _WORDS)).cast("int").alias("i"), "set")))
    return (
        words.groupBy(F.shiftright("word", _WORDS).alias("_bucket")).agg(at.alias("held"))  # at most 512 entries
        .select("_bucket", F.transform(F.sequence(F.lit(0), F.lit((1 << _WORDS) - 1)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0).cast("bigint"))).alias("_words"))
    )


def may_be_among(rows: DataFrame, columns: list[str], held: DataFrame, bits: int = 26) -> DataFrame:
    """``rows`` that may have one of the keys of the filter ``held``."""
    slot = rows.select(*rows.columns, _slot(columns, bits).alias("_slot"))
    word = F.expr(f"_words[cast(shiftright(_slot, 6) % {1 << _WORDS} as int)]")
    return (
        slot.join(F.broadcast(held), F.shiftright("_slot", 6 + _WORDS) == F.col("_bucket"))
        .where(F.call_function("shiftright", word, F.expr("cast(_slot & 63L as int)")).bitwiseAND(F.lit(1)) == 1)
        .select(*rows.columns)
    )

