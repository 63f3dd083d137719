"""Source files to captures to graph.

Only the search for captures runs in Python workers (Arrow batches, one file at a
time, nothing shared); everything after it - class context, export flags, ids,
signatures, duplicates - is windows and projections over one file's captures.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.captures import captures_of
from skein.functions.languages import Registry
from skein.operators.graph import Graph, dedupe_first
from skein.schema import semantic_type
from skein.workspace import ship

CAPTURES = "fileseq bigint, project string, filepath string, lang string, idx int, tag string, text string, startrow int, startcol int, endrow int, line string"
_FILE_BITS = 24


def captures(files: DataFrame) -> DataFrame:
    """Captures of ``files`` (seq, project, relpath, lang, content), after one of the tag
    ``file`` for each file that was read.  A file that cannot be parsed has a single
    capture of the tag ``error`` that says why; unreadable files (null content) and
    unknown languages have none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                place = (f.seq, f.project, f.relpath, f.lang)
                try:
                    found = captures_of(f.content, f.lang)
                except Exception as e:  # whatever one file does, the others go on
                    rows.append((*place, -1, "error", f"{type(e).__name__}: {e}", 0, 0, 0, ""))
                    continue
                rows.append((*place, -1, "file", f.relpath, 0, 0, f.content.count("\n"), f.relpath))
                rows += [(*place, *c) for c in found]
            yield pd.DataFrame(rows, columns=["fileseq", "project", "filepath", "lang", "idx", "tag", "text", "startrow", "startcol", "endrow", "line"])

    ship(files.sparkSession)
    known = sorted({p.name for p in Registry().by_extension.values()})
    readable = files.where(F.col("content").isNotNull() & F.col("lang").isin(known))
    return readable.select("seq", "project", "relpath", "lang", "content").mapInPandas(read, CAPTURES)


def parse_errors(found: DataFrame) -> DataFrame:
    """(project, filepath, error) of the files that could not be parsed."""
    return found.where(F.col("tag") == "error").select("project", "filepath", F.col("text").alias("error"))


def file_nodes(found: DataFrame) -> DataFrame:
    """One node per file read; a trailing line break counts as one more line."""
    return found.where(F.col("tag") == "file").select(
        (F.col("fileseq") * (1 << _FILE_BITS)).alias("seq"), "project", F.col("filepath").alias("id"), F.lit("file").alias("type"),
        F.col("filepath").alias("name"), "filepath", F.lit(1).alias("startline"),
        (F.col("endrow") + 1).alias("endline"), F.lit("none").alias("exporttype"), F.col("filepath").alias("signature"),
        F.lit(None).cast(semantic_type()).alias("semantic"),
    )


def with_context(found: DataFrame) -> DataFrame:
    """``found`` plus the class a capture falls under and whether it is exported.

    There is one class at a time: a later class replaces an earlier one and does
    not give way to it again.  Exported is what starts in the rows of an export
    statement seen before.
    """
    so_far = Window.partitionBy("project", "filepath", "fileseq").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    is_class = F.col("tag") == "class"
    return (
        found.withColumn("class_name", F.last(F.when(is_class, F.col("text")), ignorenulls=True).over(so_far))
        .withColumn("class_end", F.last(F.when(is_class, F.col("endrow")), ignorenulls=True).over(so_far))
        .withColumn("export_end", F.max(F.when(F.col("tag") == "export", F.col("endrow"))).over(so_far))
        .withColumn("in_class", F.coalesce(F.col("startrow") <= F.col("class_end"), F.lit(False)))
        .withColumn("exported", F.coalesce(F.col("startrow") <= F.col("export_end"), F.lit(False)))
    )


def captures_to_graph(found: DataFrame, registry: Registry | None = None) -> Graph:
    """Nodes and edges of the captures; of nodes with one id the first holds."""
    placed = with_context(found)
    seq = (F.col("fileseq") * (1 << _FILE_BITS) + F.col("idx") + 1).alias("seq")
    method = (F.col("tag") == "method") & F.col("in_class")
    name = F.when(method, F.concat_ws(".", "class_name", "text")).otherwise(F.col("text"))
    kind = F.when(F.col("tag").isin("method", "variable"), "function").otherwise(F.col("tag"))
    entities = placed.where(F.col("tag").isin("class", "function", "interface", "method", "variable")).select(
        seq, "project", F.concat(F.col("filepath"), F.lit("::"), name).alias("id"), kind.alias("type"), name.alias("name"), "filepath",
        (F.col("startrow") + 1).alias("startline"), (F.col("startrow") + 1).alias("endline"),
        F.when(F.col("exported") & (F.col("tag") != "method"), "named").otherwise("none").alias("exporttype"),
        F.col("line").alias("signature"), F.lit(None).cast(semantic_type()).alias("semantic"),
    )
    nodes = dedupe_first(file_nodes(found).unionByName(entities))
    edges = found.where(F.col("tag").isin("import", "call")).select(
        seq, "project", F.col("filepath").alias("sourceid"),
        F.when(F.col("tag") == "import", F.regexp_replace("text", "['\"]", "")).otherwise(F.col("text")).alias("targetid"),
        F.when(F.col("tag") == "import", "IMPORTS_FROM").otherwise("CALLS").alias("relation"),
        F.col("filepath").alias("sourcefile"), (F.col("startrow") + 1).alias("sourceline"),
    )
    graph = Graph(nodes, edges)
    for lang, hook in (registry.hooks() if registry else {}).items():
        graph = Graph(*hook(found.where(F.col("lang") == lang), graph.nodes, graph.edges))
    return graph


def build_graph(files: DataFrame, registry: Registry | None = None) -> Graph:
    """The graph of ``files``; a file that is unreadable, in an unknown language or
    cannot be parsed gives nothing."""
    return captures_to_graph(captures(files), registry)
