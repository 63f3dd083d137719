"""Queries of the general data problems over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.hotkeys import dominant_keys, key_profile
from skein.operators.orphans import OrphanFinder, references
from skein.operators.snapshots import snapshot_changes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _finder(spark: SparkSession, d: str) -> OrphanFinder:
    sides = {"source": "sourceid", "target": "targetid"}
    refs = references(table(spark, d, "edges"), "edges", "seq", "loadedat", sides).unionByName(
        references(table(spark, d, "edge_requests"), "edge_requests", "req_id", "requestedat", sides)
    )
    return OrphanFinder(refs, table(spark, d, "nodes"), table(spark, d, "library_symbols"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _finder(spark, d).rows().select("table_name", "row_no", "side")


def p1_orphan_counts(spark: SparkSession, d: str) -> DataFrame:
    return _finder(spark, d).counts()


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return dominant_keys(p2_target_profile(spark, d).withColumnRenamed("n_edges", "n_rows"), "targetid", table(spark, d, "edges").count())


def p2_target_profile(spark: SparkSession, d: str) -> DataFrame:
    return key_profile(table(spark, d, "edges"), "targetid", "project", "sourcefile", "loadedat").select(
        "targetid",
        F.col("n_rows").alias("n_edges"),
        F.col("n_members").alias("n_source_files"),
        F.col("n_groups").alias("n_projects"),
        F.col("first_at").alias("first_loadedat"),
        F.col("last_at").alias("last_loadedat"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(
        table(spark, d, "node_snapshots"), ["project", "id"], ["signature", "endline"], "snapshot_no", "seq"
    )


def p4_change_counts(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("snapshot_no", "change_kind").agg(F.count("*").alias("n"))


_P1 = """
WITH refs AS (
  SELECT 'edges' AS table_name, seq AS row_no, 'source' AS side, project, sourceid AS id, loadedat AS t FROM edges
  UNION ALL SELECT 'edges', seq, 'target', project, targetid, loadedat FROM edges
  UNION ALL SELECT 'edge_requests', req_id, 'source', project, sourceid, requestedat FROM edge_requests
  UNION ALL SELECT 'edge_requests', req_id, 'target', project, targetid, requestedat FROM edge_requests
), orphans AS (
  SELECT * FROM refs r WHERE id IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM library_symbols s WHERE s.symbol = r.id)
    AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.project = r.project AND n.id = r.id
                    AND n.loadedat <= r.t AND (n.deletedat IS NULL OR r.t < n.deletedat))
)
"""

_P4 = """
WITH held AS (
  SELECT project, id, snapshot_no, signature, endline FROM (
    SELECT *, row_number() OVER (PARTITION BY project, id, snapshot_no ORDER BY seq DESC) AS rn FROM node_snapshots)
  WHERE rn = 1
), pairs AS (
  SELECT coalesce(b.project, a.project) AS project, coalesce(b.id, a.id) AS id,
         coalesce(b.snapshot_no, a.snapshot_no + 1) AS snapshot_no,
         CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed'
              WHEN a.signature IS DISTINCT FROM b.signature OR a.endline IS DISTINCT FROM b.endline THEN 'changed' END AS change_kind
  FROM held a FULL JOIN held b ON a.project = b.project AND a.id = b.id AND b.snapshot_no = a.snapshot_no + 1
), changes AS (
  SELECT project, id, CAST(snapshot_no AS INT) AS snapshot_no, change_kind FROM pairs
  WHERE change_kind IS NOT NULL AND snapshot_no BETWEEN 2 AND (SELECT max(snapshot_no) FROM node_snapshots)
)
"""

QUERIES = {
    "p1_found": p1_found,
    "p1_orphan_counts": p1_orphan_counts,
    "p2_found": p2_found,
    "p2_target_profile": p2_target_profile,
    "p4_found": p4_found,
    "p4_change_counts": p4_change_counts,
}

SQL = {
    "p1_found": _P1 + "SELECT table_name, row_no, side FROM orphans",
    "p1_orphan_counts": _P1
    + """SELECT table_name, side, CAST(year(t) * 100 + month(t) AS INT) AS period, count(*) AS orphans
         FROM orphans GROUP BY ALL""",
    "p2_found": """SELECT targetid FROM edges WHERE targetid IS NOT NULL GROUP BY targetid
                   HAVING count(*) * 50 >= (SELECT count(*) FROM edges)""",
    "p2_target_profile": """
        SELECT e.targetid, count(*) AS n_edges,
               count(DISTINCT CASE WHEN sourcefile IS NOT NULL THEN (project, sourcefile) END) AS n_source_files,
               count(DISTINCT project) AS n_projects, min(loadedat) AS first_loadedat, max(loadedat) AS last_loadedat
        FROM edges e WHERE targetid IS NOT NULL GROUP BY e.targetid""",
    "p4_found": _P4 + "SELECT * FROM changes",
    "p4_change_counts": _P4 + "SELECT snapshot_no, change_kind, count(*) AS n FROM changes GROUP BY ALL",
}
