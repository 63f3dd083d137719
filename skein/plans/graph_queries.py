"""Queries of the graph engine over the driver's code-graph tables, with their SQL.

The serving graph takes the last delivered row of every node and all delivered
edges.  Queries about one node take the node that most edges point to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import bundle, mutate
from skein.operators.extract import build_graph, captures, with_context
from skein.operators.graph import Graph, dedupe_first, dedupe_last
from skein.operators.traverse import affected_files, impact, impact_report, oracle_sql
from skein.plans.dealt import table
from skein.schema import EDGES, NODES, NODE_FIELDS, domain_error, semantic_error, to_interchange
from skein.schema import NODE_TYPES, RELATIONS
from skein.sources.files import extension_of, is_scanned, registry_frame

_NODE = ["project", "id", "type", "name", "filepath", "startline", "endline", "exporttype", "signature"]
_EDGE = ["project", "sourceid", "targetid", "relation", "sourcefile", "sourceline"]


def delivered_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nodes").select(*NODES.names)


def graph(spark: SparkSession, d: str) -> Graph:
    return Graph(dedupe_last(delivered_nodes(spark, d)), table(spark, d, "edges").select(*EDGES.names))


def seed(g: Graph) -> DataFrame:
    """The node most edges point to, as (project, id)."""
    ids = g.nodes.select("project", "id")
    return (
        g.edges.groupBy("project", F.col("targetid").alias("id")).agg(F.count("*").alias("n"))
        .join(ids, ["project", "id"], "left_semi")
        .orderBy(F.desc("n"), "project", "id").limit(1).select("project", "id")
    )


def _seeded(spark: SparkSession, d: str) -> tuple[Graph, str, str]:
    g = graph(spark, d)
    row = seed(g).first()
    return g, *(tuple(row) if row else ("", ""))


def requests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edge_requests").select(F.col("req_id").alias("pos"), "project", "sourceid", "targetid", "relation", "sourcefile", "sourceline")


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """Readable files, one row each, numbered by project and path."""
    held = table(spark, d, "source_files").groupBy("project", "relpath", "ext", "lang").agg(F.max("content").alias("content"))
    return held.withColumn("seq", F.abs(F.xxhash64("project", "relpath")) % (1 << 38))


# --- lookups ---------------------------------------------------------------


def stats(spark, d):
    return graph(spark, d).stats()


def node_by_id(spark, d):
    g, project, node = _seeded(spark, d)
    return g.of_project(project).node(node).select(*_NODE)


def nodes_by_file(spark, d):
    g, project, node = _seeded(spark, d)
    return g.of_project(project).nodes_by_file(node.split("::")[0]).select(*_NODE)


def nodes_by_type(spark, d):
    return graph(spark, d).nodes_by_type("interface").select(*_NODE)


def all_nodes(spark, d):
    return graph(spark, d).nodes.select("seq", *_NODE)


def all_edges(spark, d):
    return graph(spark, d).edges.select("seq", *_EDGE)


def edges_from(spark, d):
    g, project, node = _seeded(spark, d)
    return g.of_project(project).edges_from(node).select("seq", *_EDGE)


def edges_to(spark, d):
    g, project, node = _seeded(spark, d)
    return g.of_project(project).edges_to(node).select("seq", *_EDGE)


def connected_edges(spark, d):
    g, project, node = _seeded(spark, d)
    return g.of_project(project).connected_edges(node).select("direction", "seq", *_EDGE)


def search_name(spark, d):
    return graph(spark, d).search("Writer").select("project", "id", "match_kind", "match_key")


def search_concept(spark, d):
    return graph(spark, d).search("caching").select("project", "id", "match_kind", "match_key")


def search_union_typed(spark, d):
    return graph(spark, d).search("Index", "class").select("project", "id", "match_kind")


def search_induced_edges(spark, d):
    g = graph(spark, d)
    return g.induced_edges(g.search("render")).select("seq", *_EDGE)


def dangling_edges(spark, d):
    return graph(spark, d).dangling_edges().groupBy("project", "relation").agg(F.count("*").alias("n"))


def degrees(spark, d):
    return graph(spark, d).degrees()


def resolved_edges(spark, d):
    return graph(spark, d).resolve_edges().select("seq", "project", "targetid")


def dedupe_first_nodes(spark, d):
    return dedupe_first(delivered_nodes(spark, d)).select("seq", *_NODE)


def domain_errors(spark, d):
    g = graph(spark, d)
    bad = g.nodes.select(F.lit("type").alias("field"), domain_error("type", NODE_TYPES).alias("value")).unionByName(
        g.edges.select(F.lit("relation").alias("field"), domain_error("relation", RELATIONS).alias("value"))
    )
    return bad.where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))


# --- traversal -------------------------------------------------------------


def _impact(depth: int, direction: str):
    def query(spark, d):
        g = graph(spark, d)
        return impact(g, seed(g), depth, direction).select("rank", "level", "id", F.array_join("path", ">").alias("path"))

    return query


def impact_affected_files(spark, d):
    g = graph(spark, d)
    return affected_files(impact_report(g, seed(g), depth=3, direction="upstream")).select("filepath", "first_rank")


def impact_every_class(spark, d):
    """Direct and indirect dependants of every class to the operator's default depth, however many."""
    g = graph(spark, d)
    found = impact(g, g.nodes.where("type = 'class'"), direction="upstream", cap=None)
    return found.groupBy("project", F.col("start_id").alias("id")).agg(F.count("*").alias("affected"))


# --- context ---------------------------------------------------------------


def ctx_callers(spark, d):
    g = graph(spark, d)
    return bundle.callers(g, g.nodes).select("project", "target_id", "edge_seq", "id", "name")


def ctx_callees(spark, d):
    g = graph(spark, d)
    return bundle.callees(g, g.nodes).select("project", "target_id", "edge_seq", "id", "name")


def ctx_imports(spark, d):
    g = graph(spark, d)
    return bundle.imports(g, g.nodes).select("project", "target_id", "seq", "targetid")


def ctx_related_tests(spark, d):
    """How many tests are related to each node; context_bundle lists those of one."""
    g = graph(spark, d)
    return bundle.related_test_counts(g, g.nodes)


def ctx_source_span(spark, d):
    g = graph(spark, d)
    return bundle.sources(g, g.nodes.where("type <> 'file'"), table(spark, d, "source_files")).select("project", "target_id", "source_code", "truncated", "warning")


def ctx_truncate(spark, d):
    g = graph(spark, d)
    return bundle.sources(g, g.nodes.where("type = 'file'"), table(spark, d, "source_files"), max_lines=40).select(
        "project", "target_id", F.length("source_code").alias("n_chars"), "truncated", "n_lines", "warning"
    )


def context_bundle(spark, d):
    g = graph(spark, d)
    return bundle.context_bundles(g, seed(g), table(spark, d, "source_files")).select(
        "project", "id", "name", "summary", "source_code", "truncated",
        *[F.to_json(c, {"ignoreNullFields": "false"}).alias(c) for c in ("callers", "callees", "imports", "related_tests", "warnings")],
    )


# --- changes ---------------------------------------------------------------


def add_edges_status(spark, d):
    return mutate.judge_edges(graph(spark, d), requests(spark, d)).select("pos", "status", "reason")


def add_edges_counts(spark, d):
    return mutate.edge_counts(mutate.judge_edges(graph(spark, d), requests(spark, d)))


def add_edges_defaults(spark, d):
    return mutate.edge_defaults(graph(spark, d), requests(spark, d)).select("pos", "sourcefile", "sourceline")


def edges_after_adding(spark, d):
    after, _ = mutate.add_edges(graph(spark, d), mutate.edge_defaults(graph(spark, d), requests(spark, d)))
    return after.edges.groupBy("project", "relation").agg(F.count("*").alias("n"))


def enrich_nodes(spark, d):
    """Give every class without a semantic record one."""
    g = graph(spark, d)
    updates = g.nodes.where("type = 'class' and semantic is null").select(
        "project", "id", F.concat(F.lit("Class "), "name").alias("summary"), F.lit("low").alias("complexity"), F.array(F.lower("name")).alias("domainconcepts")
    )
    after, _ = mutate.enrich(g, updates, F.lit("2026-01-01T00:00:00.000Z"))
    return after.nodes.where("semantic is not null").select("project", "id", "semantic.summary", "semantic.complexity", "semantic.enrichedat", "semantic.enrichedby")


def semantic_validate(spark, d):
    return (
        delivered_nodes(spark, d).where("semantic is not null")
        .select(semantic_error(F.col("semantic")).alias("error")).groupBy("error").agg(F.count("*").alias("n"))
    )


def merge_semantic(spark, d):
    """Merge what the serving graph knows into the last snapshot."""
    snapshots = table(spark, d, "node_snapshots")
    last = snapshots.join(F.broadcast(snapshots.agg(F.max("snapshot_no").alias("snapshot_no"))), "snapshot_no", "left_semi")
    scanned = dedupe_last(last.withColumn("semantic", F.lit(None).cast(NODES["semantic"].dataType)).select(*NODES.names))
    return mutate.merge_semantic(scanned, graph(spark, d).nodes).select("project", "id", F.col("semantic.summary").alias("summary"), F.col("semantic.enrichedby").alias("enrichedby"))


# --- sources and sinks -----------------------------------------------------


def export_entities_json(spark, d):
    return to_interchange(graph(spark, d).nodes, NODE_FIELDS[:-1]).select("id", F.to_json(F.struct(*NODE_FIELDS[:-1])).alias("line"))


def jsonl_roundtrip(spark, d):
    from skein.sources.jsonl import read_graph, write_graph
    from skein.workspace import scratch_folder

    g = graph(spark, d)
    path = scratch_folder(spark, "roundtrip")
    single = Graph(g.nodes.withColumn("id", F.concat_ws("/", "project", "id")), g.edges)
    write_graph(single, path)
    return read_graph(spark, path).stats()


def walk_filter(spark, d):
    files = table(spark, d, "source_files").select("project", "relpath").distinct()
    return files.where(is_scanned(F.col("relpath")))


def ext_registry(spark, d):
    files = table(spark, d, "source_files").select("project", "relpath").distinct().withColumn("ext", extension_of(F.col("relpath")))
    return files.join(F.broadcast(registry_frame(spark)), "ext").groupBy("ext", "lang").agg(F.count("*").alias("files"))


# --- extraction ------------------------------------------------------------


def extract_files(spark, d):
    return build_graph(source_files(spark, d)).nodes.where("type = 'file'").select("project", "id", "startline", "endline", "exporttype")


def extract_imports(spark, d):
    g = build_graph(source_files(spark, d))
    return g.edges.where("relation = 'IMPORTS_FROM'").select("project", "sourceid", "targetid", "sourceline")


def extract_calls(spark, d):
    g = build_graph(source_files(spark, d))
    return g.edges.where("relation = 'CALLS'").groupBy("project", "sourceid", "targetid").agg(F.count("*").alias("calls"))


def extract_entities(spark, d):
    return build_graph(source_files(spark, d)).nodes.where("type <> 'file'").select("project", "id", "type", "startline", "signature")


def class_texts(spark, d):
    """A TypeScript file for every class of the serving graph: two methods, a call in each
    and one outside, a nested arrow function, an export."""
    n = graph(spark, d).nodes.where("type = 'class'")
    text = F.concat(
        F.lit("import { a } from './a';\nexport class "), "name", F.lit(" {\n  run(a: { b: number }): Map<string, () => void> {\n    const local = (x) => `${outer"), "name",
        F.lit("(x)}`;\n  }\n\n  async stop() {\n    return this.run(helper?.("), F.col("startline").cast("string"), F.lit("));\n  }\n}\nfunction after() { return new "), "name", F.lit("(); }\n"),
    )
    at = F.concat("id", F.lit(".ts"))
    return n.select((F.abs(F.xxhash64("project", "id")) % (1 << 38)).alias("seq"), "project", at.alias("relpath"), F.lit(".ts").alias("ext"), F.lit("typescript").alias("lang"), text.alias("content"))


def extract_methods_class_ctx(spark, d):
    found = with_context(captures(class_texts(spark, d)))
    return found.where("tag = 'method'").select("project", "filepath", "text", "startrow", "class_name", "in_class")


def extract_class_calls(spark, d):
    g = build_graph(class_texts(spark, d))
    return g.edges.where("relation = 'CALLS'").select("project", "sourceid", "targetid", "sourceline")


def extract_export_flag(spark, d):
    return build_graph(class_texts(spark, d)).nodes.select("project", "id", "type", "exporttype", "startline", "endline")


# --- the tools over a stored project ---------------------------------------


def tool_answers(spark, d):
    """What the six tools and a resource say of the seed's project, stored in a workspace:
    (tool, answer) with a number each."""
    from skein.engine import GraphEngine
    from skein.sources.jsonl import resource, write_graph
    from skein.workspace import scratch_folder

    g, project, node = _seeded(spark, d)
    engine = GraphEngine(spark, scratch_folder(spark, "tools"))
    own = g.of_project(project)
    write_graph(own, engine.store.folder(project))
    asked = own.nodes.where(F.col("type") != "file").groupBy().agg(F.min("id").alias("a"), F.max("id").alias("b")).first()
    edges = [{"sourceId": asked["a"], "targetId": asked["b"], "relation": "CALLS", "sourceFile": "x"}] * 2 + [{"sourceId": "none", "targetId": node, "relation": "CALLS"}]
    before = len(engine.edges_answer(project, node)[0])
    rows = [
        ("graph_query", len(engine.query_answer(project, "class")[0])),
        ("graph_query_pattern", len(engine.query_answer(project, None, "index")[0])),
        ("graph_edges", before),
        ("graph_impact_analysis", engine.impact_answer(project, node)[0]["totalAffected"]),
        ("graph_context_bundle", len(engine.bundle_answer(project, node)[0]["callers"])),
    ]
    added = engine.add_edges_answer(project, edges)[0]
    rows += [("graph_add_edges_tried", added["added"] + added["skipped"]), ("graph_add_edges_errors", len(added["errors"]))]
    rows += [("graph_enrich", int(engine.enrich_answer(project, node, "s", "low", ["c"])[0]["success"]))]
    rows += [("resource_entities", len(resource(spark, engine.store.folder(project), "entities")[0].splitlines()))]
    return spark.createDataFrame(rows, "tool string, answer bigint")


QUERIES = {
    "stats": stats, "node_by_id": node_by_id, "nodes_by_file": nodes_by_file, "nodes_by_type": nodes_by_type,
    "all_nodes": all_nodes, "all_edges": all_edges, "edges_from": edges_from, "edges_to": edges_to,
    "connected_edges": connected_edges, "search_name": search_name, "search_concept": search_concept,
    "search_union_typed": search_union_typed, "search_induced_edges": search_induced_edges,
    "impact_up_d1": _impact(1, "upstream"), "impact_up_d2": _impact(2, "upstream"), "impact_down_d2": _impact(2, "downstream"),
    "impact_both_d2_capped": _impact(2, "both"), "impact_depth_clamp": _impact(99, "upstream"), "impact_both_d5": _impact(5, "both"),
    "impact_affected_files": impact_affected_files, "impact_every_class": impact_every_class,
    "ctx_callers": ctx_callers, "ctx_callees": ctx_callees, "ctx_imports": ctx_imports, "ctx_related_tests": ctx_related_tests,
    "ctx_source_span": ctx_source_span, "ctx_truncate": ctx_truncate, "context_bundle": context_bundle,
    "add_edges_status": add_edges_status, "add_edges_counts": add_edges_counts, "add_edges_defaults": add_edges_defaults,
    "edges_after_adding": edges_after_adding, "enrich_nodes": enrich_nodes, "semantic_validate": semantic_validate,
    "merge_semantic": merge_semantic, "dedupe_first": dedupe_first_nodes, "dangling_edges": dangling_edges, "degrees": degrees,
    "resolved_edges": resolved_edges, "domain_errors": domain_errors, "export_entities_json": export_entities_json,
    "jsonl_roundtrip": jsonl_roundtrip, "walk_filter": walk_filter, "ext_registry": ext_registry,
    "extract_files": extract_files, "extract_imports": extract_imports, "extract_calls": extract_calls,
    "extract_entities": extract_entities, "extract_methods_class_ctx": extract_methods_class_ctx, "extract_class_calls": extract_class_calls,
    "extract_export_flag": extract_export_flag, "tool_answers": tool_answers,
}

# --- the same in SQL -------------------------------------------------------

_G = """
WITH n AS (
  SELECT * EXCLUDE (rn, seq), first_seq AS seq FROM (
    SELECT *, row_number() OVER (PARTITION BY project, id ORDER BY seq DESC) AS rn, min(seq) OVER (PARTITION BY project, id) AS first_seq FROM nodes)
  WHERE rn = 1
), seed AS (
  SELECT e.project, e.targetid AS id FROM edges e JOIN n ON n.project = e.project AND n.id = e.targetid
  GROUP BY ALL ORDER BY count(*) DESC, 1, 2 LIMIT 1
), f AS (
  SELECT project, relpath, ext, lang, max(content) AS content FROM source_files GROUP BY ALL
)
"""
_N = "n.project, n.id, n.type, n.name, n.filepath, n.startline, n.endline, n.exporttype, n.signature"
_E = "e.project, e.sourceid, e.targetid, e.relation, e.sourcefile, e.sourceline"


def _impact_sql(depth: int, direction: str) -> str:
    start = oracle_sql("@", "@", depth, direction, nodes="n")
    start = start.replace("project = '@' AND id = '@'", "(project, id) IN (SELECT (project, id) FROM seed)")
    return _G + ", " + start.replace("project = '@'", "project = (SELECT project FROM seed)")


def _search_sql(query: str) -> str:
    q = query.lower()
    return f"""hits AS (
      SELECT n.*, coalesce(contains(lower(name), '{q}'), false) AS by_name,
        lower(list_filter(coalesce(semantic.domainconcepts, []), lambda c: contains(lower(c), '{q}'))[1]) AS concept
      FROM n), found AS (
      SELECT *, CASE WHEN by_name THEN 'name' ELSE 'concept' END AS match_kind, CASE WHEN by_name THEN lower(name) ELSE concept END AS match_key
      FROM hits WHERE by_name OR concept IS NOT NULL)"""


_JUDGED = """, req AS (
  SELECT r.req_id AS pos, r.*, s.id AS sid, t.id AS tid,
    CASE WHEN s.id IS NULL OR t.id IS NULL THEN 'Node not found: ' || concat_ws(', ',
      CASE WHEN s.id IS NULL THEN 'sourceId "' || coalesce(r.sourceid, 'null') || '"' END,
      CASE WHEN t.id IS NULL THEN 'targetId "' || coalesce(r.targetid, 'null') || '"' END) END AS reason
  FROM edge_requests r LEFT JOIN n s ON s.project = r.project AND s.id = r.sourceid LEFT JOIN n t ON t.project = r.project AND t.id = r.targetid
), judged AS (
  SELECT pos, reason, project, relation, CASE WHEN reason IS NOT NULL THEN 'error'
    WHEN EXISTS (SELECT 1 FROM edges e WHERE e.project = q.project AND e.sourceid = q.sourceid AND e.targetid = q.targetid AND e.relation = q.relation)
      OR pos > min(CASE WHEN reason IS NULL THEN pos END) OVER (PARTITION BY project, sourceid, targetid, relation) THEN 'skipped'
    ELSE 'added' END AS status FROM req q
)"""

_SPAN = """, spans AS (
  SELECT n.project, n.id AS target_id, n.type, n.filepath, f.relpath, f.content,
    list_slice(string_split(f.content, chr(10)), greatest(1, n.startline), n.endline) AS span
  FROM n LEFT JOIN (SELECT project, relpath, max(content) AS content FROM source_files GROUP BY ALL) f ON f.project = n.project AND f.relpath = n.filepath
)"""


def _span_sql(max_lines: int) -> str:
    return _SPAN + f""", cut AS (
  SELECT *, len(span) AS n_lines, content IS NOT NULL AND len(span) > {max_lines} AS truncated,
    CASE WHEN content IS NOT NULL THEN array_to_string(list_slice(span, 1, {max_lines}), chr(10)) END AS source_code,
    CASE WHEN relpath IS NULL THEN 'Source file not found: ' || filepath || ' (graph may be stale)'
         WHEN content IS NULL THEN 'Failed to read source file: ' || filepath
         WHEN len(span) > {max_lines} THEN 'Source code truncated: ' || len(span) || ' lines → {max_lines} lines' END AS warning
  FROM spans)"""


def _list_sql(rows: str) -> str:
    """JSON of the values v of ``rows`` in the order o."""
    brief = "{" + ", ".join(f"'{c}': x.{c}" for c in bundle._BRIEF) + "}"
    return f"coalesce((SELECT CAST(to_json(list(v ORDER BY o)) AS VARCHAR) FROM ({rows.replace('{b}', brief)})), '[]')"


#: What the line of a language imports, where the files of the tables do so.
_IMPORT_LINES = r"""
  SELECT project, relpath AS sourceid, lang, generate_subscripts(string_split(content, chr(10)), 1) AS sourceline,
         unnest(string_split(content, chr(10))) AS line FROM f WHERE content IS NOT NULL
"""

SQL = {
    "stats": _G + """SELECT (SELECT count(*) FROM n) AS nodecount, (SELECT count(*) FROM edges) AS edgecount,
        (SELECT count(DISTINCT (project, filepath)) FROM n WHERE filepath IS NOT NULL) AS filecount""",
    "node_by_id": _G + f"SELECT {_N} FROM n JOIN seed USING (project, id)",
    "nodes_by_file": _G + f"SELECT {_N} FROM n JOIN seed ON seed.project = n.project AND n.filepath = split_part(seed.id, '::', 1)",
    "nodes_by_type": _G + f"SELECT {_N} FROM n WHERE type = 'interface'",
    "all_nodes": _G + f"SELECT n.seq, {_N} FROM n",
    "all_edges": f"SELECT e.seq, {_E} FROM edges e",
    "edges_from": _G + f"SELECT e.seq, {_E} FROM edges e JOIN seed ON e.project = seed.project AND e.sourceid = seed.id",
    "edges_to": _G + f"SELECT e.seq, {_E} FROM edges e JOIN seed ON e.project = seed.project AND e.targetid = seed.id",
    "connected_edges": _G + f"""SELECT 'out' AS direction, e.seq, {_E} FROM edges e JOIN seed ON e.project = seed.project AND e.sourceid = seed.id
        UNION ALL SELECT 'in', e.seq, {_E} FROM edges e JOIN seed ON e.project = seed.project AND e.targetid = seed.id""",
    "search_name": _G + "," + _search_sql("Writer") + " SELECT project, id, match_kind, match_key FROM found",
    "search_concept": _G + "," + _search_sql("caching") + " SELECT project, id, match_kind, match_key FROM found",
    "search_union_typed": _G + "," + _search_sql("Index") + " SELECT project, id, match_kind FROM found WHERE type = 'class'",
    "search_induced_edges": _G + "," + _search_sql("render") + f"""
        SELECT e.seq, {_E} FROM edges e WHERE EXISTS (SELECT 1 FROM found x WHERE x.project = e.project AND x.id = e.sourceid)
          AND EXISTS (SELECT 1 FROM found x WHERE x.project = e.project AND x.id = e.targetid)""",
    "impact_up_d1": _impact_sql(1, "upstream"),
    "impact_up_d2": _impact_sql(2, "upstream"),
    "impact_down_d2": _impact_sql(2, "downstream"),
    "impact_both_d2_capped": _impact_sql(2, "both"),
    "impact_depth_clamp": _impact_sql(99, "upstream"),
    "impact_both_d5": _impact_sql(5, "both"),
    "impact_affected_files": _impact_sql(3, "upstream").replace(
        "SELECT rank, level, id, path FROM s3 WHERE rank > 0",
        "SELECT n.filepath, min(s3.rank) AS first_rank FROM s3 JOIN n ON n.id = s3.id AND n.project = (SELECT project FROM seed) WHERE s3.rank > 0 GROUP BY ALL",
    ),
    "impact_every_class": _G + """, up AS (
          SELECT DISTINCT e.project, e.targetid AS at_, e.sourceid AS id FROM edges e JOIN n ON n.project = e.project AND n.id = e.sourceid WHERE e.targetid IS NOT NULL
        ), l1 AS (SELECT c.project, c.id AS start, up.id FROM n c JOIN up ON up.project = c.project AND up.at_ = c.id WHERE c.type = 'class' AND up.id <> c.id
        ), l2 AS (SELECT l1.project, l1.start, up.id FROM l1 JOIN up ON up.project = l1.project AND up.at_ = l1.id WHERE up.id <> l1.start
        ) SELECT project, start AS id, count(*) AS affected FROM (SELECT * FROM l1 UNION SELECT * FROM l2) GROUP BY ALL""",
    "ctx_callers": _G + """SELECT e.project, e.targetid AS target_id, e.seq AS edge_seq, s.id, s.name
        FROM edges e JOIN n t ON t.project = e.project AND t.id = e.targetid JOIN n s ON s.project = e.project AND s.id = e.sourceid WHERE e.relation = 'CALLS'""",
    "ctx_callees": _G + """SELECT e.project, e.sourceid AS target_id, e.seq AS edge_seq, t.id, t.name
        FROM edges e JOIN n t ON t.project = e.project AND t.id = e.targetid JOIN n s ON s.project = e.project AND s.id = e.sourceid WHERE e.relation = 'CALLS'""",
    "ctx_imports": _G + """SELECT e.project, n.id AS target_id, e.seq, e.targetid FROM n JOIN edges e ON e.project = n.project AND e.sourceid = n.filepath
        WHERE e.relation = 'IMPORTS_FROM'""",
    "ctx_related_tests": _G + """SELECT s.project, s.id AS target_id, count(*) AS tests FROM n s JOIN n t ON t.project = s.project AND t.id <> s.id
        WHERE (contains(lower(t.filepath), 'test/') OR contains(lower(t.filepath), '.test.') OR contains(lower(t.filepath), '.spec.'))
          AND contains(lower(t.name), lower(s.name)) GROUP BY ALL""",
    "context_bundle": _G + _span_sql(200) + f""", s AS (SELECT n.* FROM n JOIN seed USING (project, id))
        SELECT s.project, s.id, s.name, s.semantic.summary AS summary, cut.source_code, cut.truncated,
          {_list_sql("SELECT {b} AS v, e.seq AS o FROM edges e JOIN n x ON x.project = e.project AND x.id = e.sourceid JOIN seed ON e.project = seed.project AND e.targetid = seed.id WHERE e.relation = 'CALLS'")} AS callers,
          {_list_sql("SELECT {b} AS v, e.seq AS o FROM edges e JOIN n x ON x.project = e.project AND x.id = e.targetid JOIN seed ON e.project = seed.project AND e.sourceid = seed.id WHERE e.relation = 'CALLS'")} AS callees,
          {_list_sql("SELECT {'sourceid': e.sourceid, 'targetid': e.targetid, 'relation': e.relation, 'sourcefile': e.sourcefile, 'sourceline': e.sourceline} AS v, e.seq AS o FROM edges e JOIN n y ON y.project = e.project AND y.filepath = e.sourceid JOIN seed ON y.project = seed.project AND y.id = seed.id WHERE e.relation = 'IMPORTS_FROM'")} AS imports,
          {_list_sql("SELECT {b} AS v, x.seq AS o FROM n x JOIN n y ON x.project = y.project AND x.id <> y.id JOIN seed ON y.project = seed.project AND y.id = seed.id WHERE (contains(lower(x.filepath), 'test/') OR contains(lower(x.filepath), '.test.') OR contains(lower(x.filepath), '.spec.')) AND contains(lower(x.name), lower(y.name))")} AS related_tests,
          CAST(to_json(list_filter([cut.warning], lambda w: w IS NOT NULL)) AS VARCHAR) AS warnings
        FROM s JOIN cut ON cut.project = s.project AND cut.target_id = s.id""",
    "export_entities_json": _G + "SELECT id, '{' || concat_ws(',', " + ", ".join(
        f"""'"{c}":' || CAST(to_json({c.lower()}) AS VARCHAR)""" for c in NODE_FIELDS[:-1]) + ") || '}' AS line FROM n",
    "extract_methods_class_ctx": _G + """SELECT project, id || '.ts' AS filepath, m.text, CAST(m.startrow AS INT) AS startrow, name AS class_name, true AS in_class
        FROM n, (VALUES ('run', 2), ('stop', 6)) m(text, startrow) WHERE type = 'class'""",
    "extract_class_calls": _G + """SELECT project, id || '.ts' AS sourceid, CASE line WHEN 4 THEN 'outer' || name ELSE 'helper' END AS targetid, CAST(line AS INT) AS sourceline
        FROM n, (VALUES (4), (8)) v(line) WHERE type = 'class'""",
    "extract_export_flag": _G + """SELECT project, id || '.ts' || CASE k WHEN 'file' THEN '' WHEN 'class' THEN '::' || name WHEN 'run' THEN '::' || name || '.run'
          WHEN 'stop' THEN '::' || name || '.stop' ELSE '::' || k END AS id,
          CASE k WHEN 'file' THEN 'file' WHEN 'class' THEN 'class' ELSE 'function' END AS type, CASE k WHEN 'class' THEN 'named' WHEN 'local' THEN 'named' ELSE 'none' END AS exporttype,
          CAST(line AS INT) AS startline, CAST(CASE k WHEN 'file' THEN 12 ELSE line END AS INT) AS endline
        FROM n, (VALUES ('file', 1), ('class', 2), ('run', 3), ('local', 4), ('stop', 7), ('after', 11)) v(k, line) WHERE type = 'class'""",
    "tool_answers": _impact_sql(2, "upstream").rsplit(" SELECT rank, level, id, path FROM ", 1)[0] + """, p AS (SELECT n.* FROM n JOIN seed ON n.project = seed.project
        ), pe AS (SELECT e.*, seed.id AS seed_id FROM edges e JOIN seed ON e.project = seed.project)
        SELECT 'graph_query' AS tool, (SELECT count(*) FROM p WHERE type = 'class') AS answer
        UNION ALL SELECT 'graph_query_pattern', (SELECT count(*) FROM p WHERE coalesce(contains(lower(name), 'index'), false)
          OR len(list_filter(coalesce(semantic.domainconcepts, []), lambda c: contains(lower(c), 'index'))) > 0)
        UNION ALL SELECT 'graph_edges', (SELECT count(*) FROM pe WHERE sourceid = seed_id) + (SELECT count(*) FROM pe WHERE targetid = seed_id)
        UNION ALL SELECT 'graph_impact_analysis', (SELECT count(*) FROM s2 WHERE rank > 0)
        UNION ALL SELECT 'graph_context_bundle', (SELECT count(*) FROM pe JOIN p ON p.id = pe.sourceid WHERE targetid = seed_id AND relation = 'CALLS')
        UNION ALL SELECT 'graph_add_edges_tried', 2 UNION ALL SELECT 'graph_add_edges_errors', 1 UNION ALL SELECT 'graph_enrich', 1
        UNION ALL SELECT 'resource_entities', (SELECT count(*) FROM p)""",
    "ctx_source_span": _G + _span_sql(200) + " SELECT project, target_id, source_code, truncated, warning FROM cut WHERE type <> 'file'",
    "ctx_truncate": _G + _span_sql(40) + """ SELECT project, target_id, CAST(length(source_code) AS INT) AS n_chars, truncated,
        CAST(CASE WHEN content IS NOT NULL THEN n_lines END AS INT) AS n_lines, warning FROM cut WHERE type = 'file'""",
    "add_edges_status": _G + _JUDGED + " SELECT pos, status, reason FROM judged",
    "add_edges_counts": _G + _JUDGED + """ SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'skipped') AS skipped,
        count(*) FILTER (status = 'error') AS errors FROM judged""",
    "add_edges_defaults": _G + """SELECT r.req_id AS pos, coalesce(r.sourcefile, n.filepath, split_part(r.sourceid, '::', 1)) AS sourcefile,
        coalesce(r.sourceline, n.startline, 0) AS sourceline FROM edge_requests r LEFT JOIN n ON n.project = r.project AND n.id = r.sourceid""",
    "edges_after_adding": _G + _JUDGED + """ SELECT project, relation, count(*) AS n FROM (SELECT project, relation FROM edges
        UNION ALL SELECT project, relation FROM judged WHERE status = 'added') GROUP BY ALL""",
    "enrich_nodes": _G + """SELECT project, id, semantic.summary, semantic.complexity, semantic.enrichedat, semantic.enrichedby FROM n WHERE semantic IS NOT NULL
        UNION ALL SELECT project, id, 'Class ' || name, 'low', '2026-01-01T00:00:00.000Z', 'agent' FROM n WHERE semantic IS NULL AND type = 'class'""",
    "semantic_validate": """SELECT error, count(*) AS n FROM (SELECT CASE WHEN semantic.summary IS NULL THEN 'semantic.summary must be a string'
          WHEN NOT coalesce(semantic.complexity IN ('low', 'medium', 'high'), false) THEN 'semantic.complexity must be "low" | "medium" | "high"'
          WHEN semantic.domainconcepts IS NULL THEN 'semantic.domainConcepts must be an array'
          WHEN semantic.enrichedat IS NULL THEN 'semantic.enrichedAt must be a string'
          WHEN NOT coalesce(semantic.enrichedby IN ('agent', 'manual'), false) THEN 'semantic.enrichedBy must be "agent" | "manual"' END AS error
        FROM nodes WHERE semantic IS NOT NULL) GROUP BY ALL""",
    "merge_semantic": _G + """SELECT s.project, s.id, n.semantic.summary AS summary, n.semantic.enrichedby AS enrichedby
        FROM (SELECT DISTINCT project, id FROM node_snapshots WHERE snapshot_no = (SELECT max(snapshot_no) FROM node_snapshots)) s
        LEFT JOIN n USING (project, id)""",
    "dedupe_first": f"SELECT n.seq, {_N} FROM (SELECT *, row_number() OVER (PARTITION BY project, id ORDER BY seq) AS rn FROM nodes) n WHERE rn = 1",
    "dangling_edges": _G + """SELECT e.project, e.relation, count(*) AS n FROM edges e
        WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.project = e.project AND n.id = e.targetid) GROUP BY ALL""",
    "degrees": _G + """SELECT n.project, n.id, n.type, (SELECT count(*) FROM edges e WHERE e.project = n.project AND e.sourceid = n.id) AS out_degree,
        (SELECT count(*) FROM edges e WHERE e.project = n.project AND e.targetid = n.id) AS in_degree FROM n""",
    "resolved_edges": _G + """, one AS (SELECT project, name, min(id) AS id FROM n WHERE type <> 'file' GROUP BY ALL HAVING count(*) = 1)
        SELECT e.seq, e.project, coalesce(one.id, e.targetid) AS targetid FROM edges e LEFT JOIN one ON one.project = e.project AND one.name = e.targetid""",
    "domain_errors": _G + """SELECT field, value, count(*) AS n FROM (
          SELECT 'type' AS field, coalesce(type, 'null') AS value FROM n WHERE coalesce(type NOT IN ('file', 'class', 'function', 'interface', 'variable'), true)
          UNION ALL SELECT 'relation', coalesce(relation, 'null') FROM edges WHERE coalesce(relation NOT IN ('CALLS', 'IMPORTS_FROM', 'INHERITS', 'IMPLEMENTS'), true))
        GROUP BY ALL""",
    "jsonl_roundtrip": _G + """SELECT (SELECT count(*) FROM n) AS nodecount, (SELECT count(*) FROM edges) AS edgecount,
        (SELECT count(DISTINCT filepath) FROM n) AS filecount""",
    "walk_filter": r"""SELECT DISTINCT project, relpath FROM source_files
        WHERE NOT regexp_matches(relpath, '(^|/)(node_modules|dist|\.git|output|coverage)/') AND NOT suffix(relpath, '.d.ts')
          AND regexp_extract(relpath, '[^/]*$') SIMILAR TO '.+\.(ts|tsx|py|pyw|go|php|sh|bash)'""",
    "ext_registry": r"""SELECT ext, lang, count(*) AS files FROM (SELECT DISTINCT project, relpath, '.' || regexp_extract(relpath, '\.([^./]*)$', 1) AS ext FROM source_files)
        JOIN (VALUES ('.ts', 'typescript'), ('.tsx', 'tsx'), ('.py', 'python'), ('.pyw', 'python'), ('.go', 'go'), ('.php', 'php'), ('.sh', 'bash'), ('.bash', 'bash')) v(ext, lang) USING (ext)
        GROUP BY ALL""",
    "extract_files": _G + """SELECT project, relpath AS id, 1 AS startline, CAST(len(string_split(content, chr(10))) AS INT) AS endline, 'none' AS exporttype
        FROM f WHERE content IS NOT NULL""",
    "extract_imports": _G + ", l AS (" + _IMPORT_LINES + r""") SELECT project, sourceid, CASE lang
          WHEN 'python' THEN regexp_extract(line, '^from (\w[\w.]*) import', 1) WHEN 'go' THEN regexp_extract(line, '^import "([^"]+)"', 1)
          WHEN 'php' THEN regexp_extract(line, '^use (\w+(?:\\\w+)+);', 1) WHEN 'bash' THEN regexp_extract(line, '^source (\S+)', 1)
          ELSE regexp_extract(line, '^import .* from ''([^'']+)'';', 1) END AS targetid, CAST(sourceline AS INT) AS sourceline
        FROM l WHERE targetid <> ''""",
    "extract_entities": _G + ", l AS (" + _IMPORT_LINES + r"""), p AS (
          SELECT *, coalesce(regexp_matches(lag(line) OVER (PARTITION BY project, sourceid ORDER BY sourceline), '(?:^|[;{}])\s*function\s*$'), false) AS goes_on FROM l
        ), named AS (
          SELECT project, sourceid, sourceline, line, unnest(CASE
            WHEN lang = 'python' THEN [regexp_extract(line, '^(class|def) (\w+)', ['k', 'name'])]
            WHEN lang = 'go' THEN CASE WHEN line LIKE 'func %' THEN [{'k': 'function', 'name': regexp_extract(line, '^func (\w+)', 1)}]
              ELSE [{'k': CASE regexp_extract(line, '^type \w+ (\w+) \{', 1) WHEN 'struct' THEN 'class' WHEN 'interface' THEN 'interface' ELSE '' END, 'name': regexp_extract(line, '^type (\w+) ', 1)}] END
            WHEN lang = 'bash' THEN [{'k': 'function', 'name': regexp_extract(line, '^(\w+)\(\) \{', 1)}]
            WHEN lang = 'php' THEN list_concat([regexp_extract(line, '^(class|interface) (\w+)', ['k', 'name'])],
              list_transform(regexp_extract_all(line, '(?:^|[^\w$])function (\w+)', 1), lambda x: {'k': 'function', 'name': x}), split)
            ELSE list_concat([regexp_extract(line, '^(?:export )?(?:default )?(class|interface) (\w+)', ['k', 'name'])],
              list_transform(regexp_extract_all(line, '(?:^|[;{}])[ \t]*(?:export )?(?:default )?(?:async )?function (\w+)', 1), lambda x: {'k': 'function', 'name': x}), split) END) AS r
          FROM (SELECT *, CASE WHEN goes_on THEN [{'k': 'function', 'name': regexp_extract(line, '^\s*(\w+)', 1)}] ELSE [] END AS split FROM p)
        ), kept AS (
          SELECT *, r['name'] AS nm, row_number() OVER (PARTITION BY project, sourceid, r['name'] ORDER BY sourceline) AS rn FROM named WHERE r['name'] <> '' AND r['k'] <> ''
        ) SELECT project, sourceid || '::' || nm AS id, CASE r['k'] WHEN 'def' THEN 'function' ELSE r['k'] END AS type, CAST(sourceline AS INT) AS startline, trim(line) AS signature
        FROM kept WHERE rn = 1""",
}
