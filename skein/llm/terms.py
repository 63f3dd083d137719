"""How often every distinct term occurs, in how many records, and which terms
are too rare or too common.

A global integer dictionary numbers the distinct terms in sorted order.  Records
are dealt to ``blocks``; each block accumulates count arrays over ranges of
``range_size`` identifiers, one for occurrences and one for record presence, and
the arrays of a range are summed over the blocks.  A block's arrays hold the slots
of the range that occur in it, at most ``range_size``; only the sum is dense.  Every record lies in exactly
one block, so presence adds up exactly.  A hot term reaches the encoding join
with at most ``blocks`` rows however many records hold it.

Defined results: a term is the value in lower case without white space at either
end, empty and null values are no terms; a record is a distinct (project, id), in
which null is a value like any other; a record counts for its field even if it
holds no term; redelivered rows count as occurrences but not as records; a term
may be both rare and common; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.ordering import global_index
from skein.workspace import materialise, ship


def term_of(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""))


def field_values(nodes: DataFrame) -> DataFrame:
    """(field_name, term, project, id), term null where a record holds none."""
    names = nodes.where(~F.col("type").eqNullSafe("file")).select(
        F.lit("name").alias("field_name"), F.col("name").alias("raw"), "project", "id"
    )
    concepts = nodes.where(F.col("semantic.domainconcepts").isNotNull()).select(
        F.lit("domainconcepts").alias("field_name"), F.explode_outer("semantic.domainconcepts").alias("raw"), "project", "id"
    )
    term = term_of(F.col("raw"))
    return names.unionByName(concepts).select(
        "field_name", F.when(term != "", term).alias("term"), "project", "id"
    )


def term_frequency(values: DataFrame, blocks: int = 64, range_size: int = 4096) -> tuple[DataFrame, dict[str, int]]:
    """Frame (field_name, term, occurrences, n_records) and the records per field."""
    ship(values.sparkSession)
    per_record = materialise(
        values.groupBy("field_name", "term", "project", "id").agg(F.count("*").alias("occ")), "terms"
    )
    records = {
        r["field_name"]: r["n"]
        for r in per_record.select("field_name", "project", "id").distinct()
        .groupBy("field_name").agg(F.count("*").alias("n")).collect()
    }
    by_block = materialise(
        per_record.where(F.col("term").isNotNull())
        .groupBy("field_name", "term", F.pmod(F.xxhash64("project", "id"), F.lit(blocks)).cast("int").alias("block"))
        .agg(F.sum("occ").alias("occ"), F.count("*").alias("presence")),
        "blocks",
    )
    dictionary = global_index(by_block.select("field_name", "term").distinct(), ["field_name", "term"], "term_id", "dictionary")
    encoded = by_block.join(dictionary, ["field_name", "term"]).select(
        F.floor(F.col("term_id") / range_size).alias("range_no"),
        (F.col("term_id") % range_size).cast("int").alias("slot"),
        "block", "occ", "presence",
    )

    def sum_arrays(key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        occ, presence = np.zeros(range_size, np.int64), np.zeros(range_size, np.int64)
        for part in rows:
            for slot, o, p in zip(part["slot"], part["occ"], part["presence"]):  # no slot twice in a block
                occ[slot] += o
                presence[slot] += p
        slot = np.flatnonzero(presence)
        yield pd.DataFrame({"term_id": key[0] * range_size + slot, "occurrences": occ[slot], "n_records": presence[slot]})

    counts = F.collect_list(F.struct("slot", "occ", "presence"))
    arrays = encoded.groupBy("range_no", "block").agg(counts.alias("held")).select("range_no", *[F.col(f"held.{c}").alias(c) for c in ("slot", "occ", "presence")])
    sums = arrays.groupBy("range_no").applyInPandas(sum_arrays, "term_id bigint, occurrences bigint, n_records bigint")
    return dictionary.join(sums, "term_id").drop("term_id"), records


def term_marks(counts: DataFrame, records: dict[str, int], rare_records: int, common_percent: dict[str, int]) -> DataFrame:
    """``counts`` plus is_rare and is_common."""
    common = F.lit(False)
    for field, percent in common_percent.items():
        common = common | ((F.col("field_name") == field) & (F.col("n_records") * 100 >= records.get(field, 0) * percent))
    return counts.withColumn("is_rare", F.col("n_records") <= rare_records).withColumn("is_common", common)
