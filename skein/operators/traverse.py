"""Bounded breadth-first impact analysis with paths, from one or many start nodes.

Levels are evaluated one after another.  Per start node each neighbour keeps the
candidate that is least in (rank of its parent, incoming before outgoing, order
of the edge), which is the edge a queue would have reached it by; known nodes and
ids without a node are dropped, and ranks continue in that order up to ``cap``,
or to the last where ``cap`` is None.

A frontier has at most ``cap`` rows per start node.  It is broadcast where the
number of start nodes is known to keep it small, so a level reads the edges once
without shuffling them; otherwise, and always without a cap, it is joined by key.
Before that, edges at ends that are no node - a library symbol may hold a tenth of
them - are dropped by a filter of fixed size.  Levels are written to the shared
folder, which cuts the lineage of the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.graph import Graph
from skein.operators.keyfilter import key_filter, may_be_among
from skein.workspace import materialise

MAX_DEPTH = 5
MAX_NODES = 100
DIRECTIONS = ("upstream", "downstream", "both")
_BROADCAST_ROWS = 200_000


def impact(graph: Graph, starts: DataFrame, depth: float = 2, direction: str = "upstream", cap: int | None = MAX_NODES) -> DataFrame:
    """Rows (project, start_id, rank, level, id, path, via_seq) for ``starts``
    (project, id); a start that is no node has none."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {', '.join(DIRECTIONS)}")
    levels = min(depth, MAX_DEPTH)
    key = ["project", "start_id"]
    ids = materialise(graph.nodes.select("project", "id").distinct(), "ids")  # every level asks for them
    seeds = starts.select("project", "id").distinct().join(ids, ["project", "id"], "left_semi")
    seeds = materialise(
        seeds.select("project", F.col("id").alias("start_id"), "id", F.lit(0).cast("bigint").alias("rank"), F.lit(0).alias("level"), F.array("id").alias("path"), F.lit(None).cast("bigint").alias("via_seq")),
        "bfs",
    )
    small = cap is not None and seeds.limit(_BROADCAST_ROWS // cap + 1).count() <= _BROADCAST_ROWS // cap
    hint = F.broadcast if small else (lambda df: df)

    sides = []
    if direction in ("upstream", "both"):
        sides.append(F.struct(F.col("targetid").alias("at"), F.col("sourceid").alias("next"), F.lit(0).alias("dir")))
    if direction in ("downstream", "both"):
        sides.append(F.struct(F.col("sourceid").alias("at"), F.col("targetid").alias("next"), F.lit(1).alias("dir")))
    steps = graph.edges.select("project", "seq", F.explode(F.array(*sides)).alias("e")).select("project", "seq", "e.*").where("at is not null and next is not null")

    if not small:
        steps = may_be_among(steps, ["project", "at"], key_filter(ids, ["project", "id"]))

    found, frontier, level = seeds, seeds, 0
    while level < levels:
        level += 1
        reached = (
            steps.join(hint(frontier.select("project", "start_id", F.col("id").alias("at"), "rank")), ["project", "at"])
            .groupBy(*key, F.col("next").alias("id"))
            .agg(F.min(F.struct("rank", "dir", "seq", "at")).alias("by"))
        )
        fresh = reached.join(hint(found.select(*key, "id")), [*key, "id"], "left_anti").join(ids, ["project", "id"], "left_semi")
        held = found.groupBy(*key).agg(F.max("rank").alias("held"))
        order = Window.partitionBy(*key).orderBy("by.rank", "by.dir", "by.seq")
        numbered = fresh.withColumn("n", F.row_number().over(order))
        if cap is not None:
            numbered = numbered.where(F.col("n") <= cap)
        ranked = numbered.join(hint(held), key).withColumn("new_rank", F.col("held") + F.col("n"))
        if cap is not None:
            ranked = ranked.where(F.col("new_rank") <= cap)
        parents = frontier.select(*key, F.col("id").alias("from_id"), F.col("path").alias("parent_path"))
        new = materialise(
            ranked.withColumn("from_id", F.col("by.at"))
            .join(hint(parents), [*key, "from_id"])
            .select(
                *key, "id", F.col("new_rank").alias("rank"), F.lit(level).alias("level"),
                F.concat("parent_path", F.array("id")).alias("path"), F.col("by.seq").alias("via_seq"),
            ),
            "bfs",
        )
        if new.isEmpty():
            break
        found, frontier = found.unionByName(new), new
    return found.where("rank > 0")


def impact_report(graph: Graph, starts: DataFrame, **how) -> DataFrame:
    """:func:`impact` with the found node and the edge that reached it."""
    found = impact(graph, starts, **how)
    nodes = graph.nodes.select("project", "id", "type", "name", "filepath")
    edges = graph.edges.select("project", F.col("seq").alias("via_seq"), "sourceid", "targetid", "relation", "sourcefile", "sourceline")
    return found.join(nodes, ["project", "id"]).join(edges, ["project", "via_seq"])


def affected_files(report: DataFrame) -> DataFrame:
    """Distinct files of a report, in order of first discovery."""
    return report.groupBy("project", "start_id", "filepath").agg(F.min("rank").alias("first_rank"))


def oracle_sql(start_project: str, start_id: str, depth: int, direction: str, nodes: str = "nodes", edges: str = "edges", cap: int = MAX_NODES) -> str:
    """Unrolled SQL for one start node, for checking against another engine."""
    quoted = start_id.replace("'", "''")
    sides = []
    if direction in ("upstream", "both"):
        sides.append(f"SELECT targetid AS at_, sourceid AS next_, 0 AS dir, seq FROM {edges} WHERE project = '{start_project}'")
    if direction in ("downstream", "both"):
        sides.append(f"SELECT sourceid AS at_, targetid AS next_, 1 AS dir, seq FROM {edges} WHERE project = '{start_project}'")
    ctes = [
        "steps AS (" + " UNION ALL ".join(sides) + ")",
        f"l0 AS (SELECT id, CAST(0 AS BIGINT) AS rank, 0 AS level, id AS path FROM {nodes} WHERE project = '{start_project}' AND id = '{quoted}')",
    ]
    seen = "l0"
    for i in range(1, min(depth, MAX_DEPTH) + 1):
        ctes += [
            f"""c{i} AS (SELECT next_ AS id, f.rank AS pr, f.path AS pp, s.dir, s.seq,
                   row_number() OVER (PARTITION BY next_ ORDER BY f.rank, s.dir, s.seq) AS rn
                 FROM steps s JOIN {'l0' if i == 1 else f'n{i - 1}'} f ON s.at_ = f.id)""",
            f"""n{i} AS (SELECT * FROM (
                   SELECT id, (SELECT max(rank) FROM {seen}) + row_number() OVER (ORDER BY pr, dir, seq) AS rank, {i} AS level, pp || '>' || id AS path
                   FROM c{i} WHERE rn = 1 AND id NOT IN (SELECT id FROM {seen})
                     AND id IN (SELECT id FROM {nodes} WHERE project = '{start_project}')) WHERE rank <= {cap})""",
            f"s{i} AS (SELECT * FROM {seen} UNION ALL SELECT * FROM n{i})",
        ]
        seen = f"s{i}"
    return ", ".join(ctes) + f" SELECT rank, level, id, path FROM {seen} WHERE rank > 0"
