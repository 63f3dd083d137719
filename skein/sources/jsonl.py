"""The interchange format: entities.jsonl, relations.jsonl and metadata.json.

A graph is written in the order of ``filePath`` / ``sourceFile`` under the root
locale collation, ties in the order of insertion; fields that are null are left
out.  Big graphs stay in Parquet; this format is for exchange and is one file
each, which is written partition by partition and moved into place at the end.
"""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.graph import Graph, dedupe_first, dedupe_last
from skein.schema import EDGE_FIELDS, EDGES, METADATA, NODE_FIELDS, NODES, edge_type, node_type, to_interchange
from skein.sources.fs import Files
from skein.workspace import materialise, scratch_folder

ENTITIES, RELATIONS_FILE, METADATA_FILE = "entities.jsonl", "relations.jsonl", "metadata.json"
FORMAT_VERSION = "0.1.0"  # fixed value: version of the format


def _lines(spark: SparkSession, path: str, schema, mode: str) -> DataFrame:
    """Rows of a line file with ``_line``, their place in it; empty if it is missing."""
    if not Files(spark).exists(path):
        return spark.createDataFrame([], schema).withColumn("_line", F.lit(0).cast("bigint"))
    text = spark.read.text(path).select(F.monotonically_increasing_id().alias("_line"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("value")).where("value <> ''")
    parsed = text.select("_line", F.from_json("value", schema, {"mode": mode}).alias("r"))
    return parsed.select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields], "_line")


def _engine(df: DataFrame, fields: tuple[str, ...], schema, project: str) -> DataFrame:
    columns = [F.col("_line").alias("seq"), F.lit(project).alias("project")]
    for name in fields:
        kind = schema[name.lower()].dataType
        columns.append(F.col(name).cast(kind).alias(name.lower()))
    return df.select(*columns)


def read_graph(spark: SparkSession, folder: str, project: str = "", strict: bool = True) -> Graph:
    """Strict: the folder must exist, a malformed line fails, the first row of an
    id holds.  Lenient: what is missing is empty and the last row holds."""
    if strict and not Files(spark).is_dir(folder):
        raise FileNotFoundError(f"Graph directory not found: {folder}")
    nodes = _engine(_lines(spark, f"{folder}/{ENTITIES}", node_type(lower=False), "FAILFAST"), NODE_FIELDS, NODES, project)
    edges = _engine(_lines(spark, f"{folder}/{RELATIONS_FILE}", edge_type(lower=False), "FAILFAST"), EDGE_FIELDS, EDGES, project)
    return Graph((dedupe_first if strict else dedupe_last)(nodes), edges)


def _write_lines(df: DataFrame, order: list, fields: tuple[str, ...], path: str) -> None:
    """One JSON object a line, in order: sorted parts by the executors, joined and
    swapped into place when complete."""
    rows = to_interchange(df.orderBy(*order), fields).select(F.to_json(F.struct(*fields)).alias("line"))
    parts = scratch_folder(df.sparkSession, "lines")
    rows.write.text(parts)
    Files(df.sparkSession).join(parts, path)


def _safe(spark: SparkSession, folder: str) -> str:
    if ".." in folder:
        raise ValueError(f"Output directory must not contain '..': {folder}")
    Files(spark).make_dir(folder)
    return folder


def metadata(graph: Graph) -> dict:
    s = graph.stats().first()
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z"
    return {"version": FORMAT_VERSION, "nodeCount": s["nodecount"], "edgeCount": s["edgecount"], "fileCount": s["filecount"], "createdAt": now}


def write_graph(graph: Graph, folder: str) -> None:
    """Export both tables and the metadata."""
    _safe(graph.nodes.sparkSession, folder)
    nodes, edges = materialise(graph.nodes, "export"), materialise(graph.edges, "export")
    _write_lines(nodes, [F.collate("filepath", "UNICODE"), "seq"], NODE_FIELDS, f"{folder}/{ENTITIES}")
    _write_lines(edges, [F.collate("sourcefile", "UNICODE"), "seq"], EDGE_FIELDS, f"{folder}/{RELATIONS_FILE}")
    write_metadata(Graph(nodes, edges), folder)


def write_metadata(graph: Graph, folder: str) -> None:
    Files(graph.nodes.sparkSession).replace(f"{folder}/{METADATA_FILE}", [json.dumps(metadata(graph), indent=2)])


def save_nodes(nodes: DataFrame, folder: str) -> None:
    """Overwrite the entities in the order of insertion."""
    _write_lines(materialise(nodes, "save"), ["seq"], NODE_FIELDS, f"{_safe(nodes.sparkSession, folder)}/{ENTITIES}")


def save_edges(edges: DataFrame, folder: str) -> None:
    """Overwrite the relations in the order of insertion."""
    _write_lines(materialise(edges, "save"), ["seq"], EDGE_FIELDS, f"{_safe(edges.sparkSession, folder)}/{RELATIONS_FILE}")


def resource(spark: SparkSession, folder: str, name: str) -> tuple[str, str]:
    """Raw text and MIME type of entities, relations or metadata."""
    file, kind, empty = {
        "entities": (ENTITIES, "application/jsonl", ""),
        "relations": (RELATIONS_FILE, "application/jsonl", ""),
        "metadata": (METADATA_FILE, "application/json", "{}"),
    }[name]
    files, path = Files(spark), f"{folder}/{file}"
    return (files.read(path) if files.exists(path) else empty), kind


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(METADATA).option("multiLine", True).json(f"{folder}/{METADATA_FILE}")


def write_parquet(graph: Graph, folder: str) -> None:
    """The scalable form: Parquet partitioned by project."""
    graph.nodes.write.mode("overwrite").partitionBy("project").parquet(f"{folder}/nodes")
    graph.edges.write.mode("overwrite").partitionBy("project").parquet(f"{folder}/edges")


def read_parquet(spark: SparkSession, folder: str) -> Graph:
    return Graph(spark.read.parquet(f"{folder}/nodes").select(*NODES.names), spark.read.parquet(f"{folder}/edges").select(*EDGES.names))
