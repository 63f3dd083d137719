"""Everything needed to understand a node, in one row - for one node or many.

Callers, callees and imports are equi-joins over all wanted nodes at once and
grouped back per node.  Related tests compare names by substring: a name that
holds another holds the first ``GRAM`` characters of it, so distinct names are
joined on those and then compared in full, for any number of wanted nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.graph import Graph
from skein.operators.keyfilter import key_filter, may_be_among

MAX_LINES = 200
GRAM = 5

_BRIEF = ["id", "type", "name", "filepath", "startline", "endline", "exporttype", "signature"]


def span_lines(content: Column, start: Column, end: Column) -> Column:
    """Lines start..end (from 1) of a text, clamped to what there is."""
    lines = F.split(content, "\n", -1)
    first = F.greatest(F.lit(1), start)
    return F.slice(lines, first, F.greatest(F.lit(0), F.least(end, F.size(lines)) - first + 1))


def is_test_file(path: Column) -> Column:
    p = F.lower(path)
    return p.contains("test/") | p.contains(".test.") | p.contains(".spec.")


def callers(graph: Graph, wanted: DataFrame) -> DataFrame:
    """(project, target_id, seq, node columns): sources of incoming calls, one per edge."""
    calls = graph.edges.where("relation = 'CALLS'").select("project", F.col("targetid").alias("target_id"), F.col("sourceid").alias("id"), F.col("seq").alias("edge_seq"))
    keys = _keys(wanted)
    # a library symbol may be the target of a tenth of the edges; such leave ahead of the shuffle
    calls = may_be_among(calls, ["project", "target_id"], key_filter(keys, ["project", "target_id"]))
    return calls.join(keys, ["project", "target_id"], "left_semi").join(graph.nodes.select("project", *_BRIEF), ["project", "id"])


def callees(graph: Graph, wanted: DataFrame) -> DataFrame:
    """Targets of outgoing calls that are nodes, one per edge."""
    calls = graph.edges.where("relation = 'CALLS'").select("project", F.col("sourceid").alias("target_id"), F.col("targetid").alias("id"), F.col("seq").alias("edge_seq"))
    return calls.join(_keys(wanted), ["project", "target_id"], "left_semi").join(graph.nodes.select("project", *_BRIEF), ["project", "id"])


def imports(graph: Graph, wanted: DataFrame) -> DataFrame:
    """Import edges of the wanted nodes' files, dangling targets included."""
    of = graph.nodes.join(_keys(wanted).withColumnRenamed("target_id", "id"), ["project", "id"], "left_semi").select("project", F.col("id").alias("target_id"), F.col("filepath").alias("sourceid"))
    return graph.edges.where("relation = 'IMPORTS_FROM'").join(of, ["project", "sourceid"])


def related_tests(graph: Graph, wanted: DataFrame) -> DataFrame:
    """Nodes in test files whose name holds the wanted node's name."""
    named, tests, pairs = _names_in_tests(graph, wanted)
    return (
        tests.join(pairs, ["project", "whole"]).join(named.drop("filepath"), ["project", "part"])
        .where(F.col("id") != F.col("target_id")).select("project", "target_id", "seq", *_BRIEF)
    )


def related_test_counts(graph: Graph, wanted: DataFrame) -> DataFrame:
    """(project, target_id, tests) of the wanted nodes that have any: how many related
    tests, counted by name, so that nodes and tests are never paired one by one."""
    named, tests, pairs = _names_in_tests(graph, wanted)
    held = tests.groupBy("project", "whole").agg(F.count("*").alias("n"))
    per_name = pairs.join(held, ["project", "whole"]).groupBy("project", "part").agg(F.sum("n").alias("n"))
    itself = is_test_file(F.col("filepath")).cast("bigint")  # a node is no test of its own
    return (
        named.join(per_name, ["project", "part"])
        .select("project", "target_id", (F.col("n") - F.coalesce(itself, F.lit(0))).alias("tests")).where("tests > 0")
    )


def _names_in_tests(graph: Graph, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Wanted nodes, nodes in test files, and which name of the first is part of which of the second."""
    named = graph.nodes.join(_keys(wanted).withColumnRenamed("target_id", "id"), ["project", "id"], "left_semi").select("project", F.col("id").alias("target_id"), "filepath", F.lower("name").alias("part"))
    tests = graph.nodes.where(is_test_file(F.col("filepath"))).select("project", "seq", *_BRIEF, F.lower("name").alias("whole"))
    at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("whole")))
    # the whole gram at every place, and every shorter one, the empty one included, for names as short
    grams = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(0), F.lit(GRAM)), lambda n: F.substring("whole", i, n)))))
    parts = named.select("project", "part", F.substring("part", 1, GRAM).alias("gram")).distinct()
    wholes = tests.select("project", "whole").where("whole is not null").distinct().withColumn("gram", F.explode(grams))
    pairs = wholes.join(parts, ["project", "gram"]).where(F.col("whole").contains(F.col("part"))).select("project", "part", "whole")
    return named, tests, pairs


def sources(graph: Graph, wanted: DataFrame, files: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """(project, target_id, source_code, truncated, n_lines, warning)."""
    of = graph.nodes.join(_keys(wanted).withColumnRenamed("target_id", "id"), ["project", "id"], "left_semi").select("project", F.col("id").alias("target_id"), "filepath", "startline", "endline")
    # of several deliveries of a file the first readable one holds
    texts = files.groupBy("project", F.col("relpath").alias("filepath")).agg(F.max("content").alias("content"), F.lit(True).alias("known"))
    joined = of.join(texts, ["project", "filepath"], "left").withColumn("span", span_lines(F.col("content"), F.col("startline"), F.col("endline")))
    n = F.size("span")
    cut = F.col("content").isNotNull() & (n > max_lines)
    return joined.select(
        "project", "target_id",
        F.when(F.col("content").isNotNull(), F.array_join(F.slice("span", 1, max_lines), "\n")).alias("source_code"),
        cut.alias("truncated"),
        F.when(F.col("content").isNotNull(), n).alias("n_lines"),
        F.when(F.col("known").isNull(), F.concat(F.lit("Source file not found: "), "filepath", F.lit(" (graph may be stale)")))
        .when(F.col("content").isNull(), F.concat(F.lit("Failed to read source file: "), "filepath"))
        .when(cut, F.concat(F.lit("Source code truncated: "), n.cast("string"), F.lit(f" lines → {max_lines} lines")))
        .alias("warning"),
    )


def context_bundles(graph: Graph, wanted: DataFrame, files: DataFrame) -> DataFrame:
    """One row per wanted (project, id) that is a node."""
    brief = F.struct(*_BRIEF)

    def gathered(rows: DataFrame, name: str, order: str, item: Column) -> DataFrame:
        return rows.groupBy("project", "target_id").agg(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("v")))), lambda x: x["v"]).alias(name)
        )

    edge = F.struct("sourceid", "targetid", "relation", "sourcefile", "sourceline")
    out = graph.nodes.join(_keys(wanted).withColumnRenamed("target_id", "id"), ["project", "id"], "left_semi").withColumnRenamed("id", "target_id")
    parts = [
        gathered(callers(graph, wanted), "callers", "edge_seq", brief),
        gathered(callees(graph, wanted), "callees", "edge_seq", brief),
        gathered(imports(graph, wanted), "imports", "seq", edge),
        gathered(related_tests(graph, wanted), "related_tests", "seq", brief),
        sources(graph, wanted, files),
    ]
    for part in parts:
        out = out.join(part, ["project", "target_id"], "left")
    lists = ["callers", "callees", "imports", "related_tests"]
    return (
        out.withColumn("summary", F.col("semantic.summary"))
        .withColumn("warnings", F.array_compact(F.array("warning")))
        .withColumns({c: F.coalesce(F.col(c), F.array()) for c in lists})
        .drop("warning")
        .withColumnRenamed("target_id", "id")
    )


def _keys(wanted: DataFrame) -> DataFrame:
    return wanted.select("project", F.col("id").alias("target_id")).distinct()
