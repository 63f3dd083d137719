"""Changes to a graph as pure functions from frames to frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import Graph
from skein.schema import REQUEST_RELATIONS, semantic_error

EDGE_KEY = ["project", "sourceid", "targetid", "relation"]


def edge_defaults(graph: Graph, requests: DataFrame) -> DataFrame:
    """Fill in what a request leaves out: the file from its source node or the
    source id up to ``::``, the line from its source node or 0."""
    node = graph.nodes.select("project", F.col("id").alias("sourceid"), "filepath", "startline")
    return (
        requests.join(node, ["project", "sourceid"], "left")
        .withColumn("sourcefile", F.coalesce("sourcefile", "filepath", F.split_part("sourceid", F.lit("::"), F.lit(1))))
        .withColumn("sourceline", F.coalesce("sourceline", "startline", F.lit(0)))
        .select(*requests.columns)
    )


def judge_edges(graph: Graph, requests: DataFrame, order: str = "pos") -> DataFrame:
    """``requests`` plus status (added, skipped, error) and reason.

    A missing end is an error before anything else; a request whose
    (source, target, relation) is already an edge, or was valid earlier in the
    batch, is skipped.  Requests are numbered per key only, and pre-aggregated to
    the first of each key, so a key asked for very often burdens no task.
    """
    ids = graph.nodes.select("project", "id").distinct().withColumn("known", F.lit(True))
    source = ids.select("project", F.col("id").alias("sourceid"), F.col("known").alias("has_source"))
    target = ids.select("project", F.col("id").alias("targetid"), F.col("known").alias("has_target"))
    checked = requests.join(source, ["project", "sourceid"], "left").join(target, ["project", "targetid"], "left")
    quoted = lambda name, column: F.concat(F.lit(f'{name} "'), F.coalesce(F.col(column), F.lit("null")), F.lit('"'))
    missing = F.concat(
        F.lit("Node not found: "),
        F.array_join(
            F.array_compact(F.array(F.when(F.col("has_source").isNull(), quoted("sourceId", "sourceid")), F.when(F.col("has_target").isNull(), quoted("targetId", "targetid")))),
            ", ",
        ),
    )
    valid = F.col("has_source").isNotNull() & F.col("has_target").isNotNull()
    checked = checked.withColumn("reason", F.when(~valid, missing))
    first = checked.where("reason is null").groupBy(*EDGE_KEY).agg(F.min(order).alias("first_pos"))
    existing = graph.edges.select(*EDGE_KEY).distinct().withColumn("exists", F.lit(True))
    first = first.join(existing, EDGE_KEY, "left")
    return (
        checked.join(first, EDGE_KEY, "left")
        .withColumn(
            "status",
            F.when(F.col("reason").isNotNull(), "error")
            .when(F.col("exists").isNotNull() | (F.col(order) > F.col("first_pos")), "skipped")
            .otherwise("added"),
        )
        .select(*requests.columns, "status", "reason")
    )


def add_edges(graph: Graph, requests: DataFrame, order: str = "pos") -> tuple[Graph, DataFrame]:
    """The graph with the added edges at its end, and the verdicts."""
    judged = judge_edges(graph, requests, order)
    last = graph.edges.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))
    new = judged.where("status = 'added'").crossJoin(F.broadcast(last)).withColumn("seq", F.col("last") + F.col(order) + 1)
    columns = [c for c in graph.edges.columns if c in new.columns]
    return graph.append_edges(new.select(*columns)), judged


def edge_counts(judged: DataFrame) -> DataFrame:
    """One row: added, skipped, errors."""
    return judged.agg(*[F.count_if(F.col("status") == s).alias(n) for s, n in (("added", "added"), ("skipped", "skipped"), ("error", "errors"))])


def request_error(relation: Column) -> Column:
    """Relations an agent may ask for."""
    return F.when(~F.coalesce(relation.isin(*REQUEST_RELATIONS), F.lit(False)), F.lit("relation must be one of " + ", ".join(REQUEST_RELATIONS)))


def enrich(graph: Graph, updates: DataFrame, at: Column | None = None) -> tuple[Graph, DataFrame]:
    """Replace the semantic record of nodes by ``updates`` (project, id, summary,
    complexity, domainconcepts).

    Returns the new graph and one verdict per update: success and error.  Of
    several valid updates of a node the last one (greatest ``pos`` where there is
    one) holds; an update that is not valid changes nothing.
    """
    stamp = at if at is not None else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    semantic = F.struct(
        F.col("summary").alias("summary"), F.col("complexity").alias("complexity"), F.col("domainconcepts").alias("domainconcepts"),
        stamp.alias("enrichedat"), F.lit("agent").alias("enrichedby"),
    )
    ids = graph.nodes.select("project", "id").distinct().withColumn("known", F.lit(True))
    judged = (
        updates.join(ids, ["project", "id"], "left")
        .withColumn("new_semantic", semantic)
        .withColumn("error", F.when(F.col("known").isNull(), F.concat(F.lit("Node not found: "), "id")).otherwise(semantic_error(F.col("new_semantic"))))
        .withColumn("success", F.col("error").isNull())
    )
    order = F.col("pos") if "pos" in updates.columns else F.lit(0)
    held = judged.where("success").groupBy("project", "id").agg(F.max_by("new_semantic", order).alias("new_semantic"))
    nodes = graph.nodes.join(held, ["project", "id"], "left").withColumn("semantic", F.coalesce("new_semantic", "semantic")).select(*graph.nodes.columns)
    return Graph(nodes, graph.edges), judged.select("project", "id", "success", "error")


def merge_semantic(new_nodes: DataFrame, old_nodes: DataFrame) -> DataFrame:
    """Carry semantic records over to a new scan by id; all else is as scanned."""
    old = old_nodes.where(F.col("semantic").isNotNull()).groupBy("project", "id").agg(F.max_by("semantic", "seq").alias("old_semantic"))
    return (
        new_nodes.join(old, ["project", "id"], "left")
        .withColumn("semantic", F.coalesce("old_semantic", "semantic"))
        .select(*new_nodes.columns)
    )


def preserved_count(new_nodes: DataFrame, old_nodes: DataFrame) -> DataFrame:
    """How many scanned nodes kept a semantic record."""
    old = old_nodes.where(F.col("semantic").isNotNull()).select("project", "id").distinct()
    return new_nodes.join(old, ["project", "id"], "left_semi").agg(F.count("*").alias("preserved"))


