"""Keeping a graph up to date from a stream of changed files.

Each micro-batch of file rows is extracted and written as one version of the
graph's node and edge tables, partitioned by batch, so a batch that runs again
after a failure replaces itself.  Reading takes the last batch that touched a
file; semantic records carry over by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators.extract import build_graph
from skein.operators.graph import Graph
from skein.schema import EDGES, FILES, NODES


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Parquet files of source rows that arrive in ``folder``."""
    return spark.readStream.schema(FILES).parquet(folder)


def rescan(files: DataFrame, output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start extracting a stream of files into ``output``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        graph = build_graph(batch)
        for name, table in (("nodes", graph.nodes), ("edges", graph.edges)):
            table.write.mode("overwrite").parquet(f"{output}/{name}/batch={batch_id}")
        touched = batch.select("project", F.col("relpath").alias("filepath"), F.col("content").isNull().alias("unreadable")).distinct()
        touched.write.mode("overwrite").parquet(f"{output}/files/batch={batch_id}")

    writer = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(spark: SparkSession, output: str) -> Graph:
    """The graph as of the last batch of every file."""
    last = spark.read.parquet(f"{output}/files").groupBy("project", "filepath").agg(F.max("batch").alias("batch"))
    nodes = spark.read.parquet(f"{output}/nodes").join(last, ["project", "filepath", "batch"], "left_semi")
    edges = spark.read.parquet(f"{output}/edges").join(last.withColumnRenamed("filepath", "sourcefile"), ["project", "sourcefile", "batch"], "left_semi")
    return Graph(nodes.select(*NODES.names), edges.select(*EDGES.names))
