"""Queries of the general data problems (p1, p3, p4) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.operators.hierarchy import all_descendants, cycle_members, descendants, hierarchy, parent_edges, resolve_children
from engramlake.operators.history import attribute_history
from engramlake.operators.references import Referrer, orphan_counts, orphan_references
from engramlake.session import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = parent_edges(table(spark, sf_dir, "memories"))
    return resolve_children(edges).select("id", "root_id", "depth", "path")


def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy(table(spark, sf_dir, "memories"))


def p1_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p1_nodes`` as a residue of any size comes about: by distributed rounds and doubling alone, no task peels by itself."""
    return hierarchy(table(spark, sf_dir, "memories"), local_edges=0)


def p1_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = parent_edges(table(spark, sf_dir, "memories"))
    return descendants(resolve_children(edges))


def p1_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = parent_edges(table(spark, sf_dir, "memories"))
    return all_descendants(edges)


def p1_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = parent_edges(table(spark, sf_dir, "memories"))
    edges = cut(edges)
    return cycle_members(edges, resolve_children(edges))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    memories = table(spark, sf_dir, "memories")
    return orphan_references(
        [
            Referrer("triples", table(spark, sf_dir, "triples"), "id", "source_id", check_late=True),
            Referrer("memories", memories, "id", "parent_id"),
        ],
        memories,
        table(spark, sf_dir, "deletions"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir)


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(_references(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribute_history(table(spark, sf_dir, "triples")).drop("change")


def p4_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the periods of each relation began: counts of inserted and changed values."""
    found = attribute_history(table(spark, sf_dir, "triples"))
    return found.groupBy("relation", "change").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("until_s") == -1).alias("n_open")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_nodes": p1_nodes,
    "p1_rounds": p1_rounds,
    "p1_descendants": p1_descendants,
    "p1_below": p1_below,
    "p1_cycles": p1_cycles,
    "p3_found": p3_found,
    "p3_counts": p3_counts,
    "p4_found": p4_found,
    "p4_changes": p4_changes,
}

_NODES = """
WITH RECURSIVE n AS (SELECT id, min(parent_id) AS parent_id FROM memories WHERE id IS NOT NULL GROUP BY id),
edge AS (SELECT n.id, n.parent_id FROM n WHERE n.parent_id IN (SELECT id FROM n)),
walk AS (
  SELECT id, id AS root_id, 0 AS depth, CAST(id AS VARCHAR) AS path FROM n WHERE id NOT IN (SELECT id FROM edge)
  UNION ALL
  SELECT e.id, w.root_id, w.depth + 1, w.path || '/' || CAST(e.id AS VARCHAR) FROM edge e JOIN walk w ON e.parent_id = w.id
)"""

_PAIRS = """,
pair AS (
  SELECT CAST(u.s AS BIGINT) AS ancestor_id, w.id, w.depth - u.at + 1 AS distance
  FROM walk w, LATERAL (SELECT unnest(string_split(w.path, '/')) AS s, generate_subscripts(string_split(w.path, '/'), 1) AS at) u
  WHERE w.depth > 0 AND u.at <= w.depth
)"""

_LOOP = """,
hop AS (
  SELECT id AS start, parent_id AS cur FROM edge WHERE id NOT IN (SELECT id FROM walk)
  UNION
  SELECT h.start, e.parent_id FROM hop h JOIN edge e ON e.id = h.cur
),
looped AS (SELECT DISTINCT start AS id FROM hop WHERE start = cur)"""

_REFS = """
WITH m AS (SELECT id, min(created_at) AS since FROM memories WHERE id IS NOT NULL GROUP BY id),
gone AS (SELECT DISTINCT memory_id FROM deletions WHERE memory_id IS NOT NULL),
r AS (
  SELECT DISTINCT 'triples' AS ref_table, id AS row_id, source_id AS key, created_at FROM triples
  UNION ALL
  SELECT DISTINCT 'memories', id, parent_id, created_at FROM memories
),
cases AS (
  SELECT r.ref_table, r.row_id,
    CASE WHEN m.id IS NULL AND g.memory_id IS NOT NULL THEN 'deleted' WHEN m.id IS NULL THEN 'missing'
         WHEN r.ref_table = 'triples' AND m.since > r.created_at THEN 'late' END AS kind,
    strftime(make_timestamp(CAST(floor(r.created_at) AS BIGINT) * 1000000), '%Y-%m') AS period
  FROM r LEFT JOIN m ON m.id = r.key LEFT JOIN gone g ON g.memory_id = r.key
  WHERE r.key IS NOT NULL AND r.key NOT IN (0, -1)
)"""

_HISTORY = """
WITH o AS (
  SELECT subject, relation, object, id, created_at, valid_until, coalesce(valid_from, created_at) AS start FROM triples
  WHERE relation IN ('name_is', 'works_at', 'located_in', 'currently_doing')
),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject, relation, start ORDER BY created_at DESC, id DESC) AS rn FROM o WHERE start IS NOT NULL) WHERE rn = 1
),
nxt AS (SELECT *, lead(start) OVER (PARTITION BY subject, relation ORDER BY start) AS next_start FROM best),
span AS (
  SELECT *, CASE WHEN valid_until > start AND (next_start IS NULL OR valid_until < next_start) THEN valid_until ELSE next_start END AS stop FROM nxt
),
mark AS (
  SELECT *, lag(object) OVER w AS old_object, lag(stop) OVER w AS old_stop,
    CASE WHEN lag(stop) OVER w = start AND lag(object) OVER w IS NOT DISTINCT FROM object THEN 0 ELSE 1 END AS fresh
  FROM span WINDOW w AS (PARTITION BY subject, relation ORDER BY start)
),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY subject, relation ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM mark),
period AS (
  SELECT subject, relation, g, min(object) AS object, CAST(floor(min(start)) AS BIGINT) AS from_s,
    CASE WHEN bool_or(stop IS NULL) THEN -1 ELSE CAST(floor(max(stop)) AS BIGINT) END AS until_s,
    CASE WHEN arg_min(old_stop, start) = min(start) THEN 'changed' ELSE 'inserted' END AS change
  FROM run GROUP BY subject, relation, g
)"""

ORACLE: dict[str, str] = {
    "p1_found": _NODES
    + """
SELECT e.id, coalesce(w.root_id, -1) AS root_id, CAST(coalesce(w.depth, -1) AS INTEGER) AS depth, coalesce(w.path, '') AS path
FROM edge e LEFT JOIN walk w ON w.id = e.id""",
    "p1_nodes": _NODES
    + _PAIRS
    + _LOOP
    + """
, cnt AS (SELECT ancestor_id, count(*) AS n FROM pair GROUP BY 1),
loose AS (SELECT cur AS anc, count(DISTINCT start) AS n FROM hop WHERE start NOT IN (SELECT id FROM looped) AND cur NOT IN (SELECT id FROM looped) GROUP BY 1)
SELECT n.id, coalesce(w.root_id, -1) AS root_id, CAST(coalesce(w.depth, -1) AS INTEGER) AS depth, coalesce(w.path, '') AS path,
  CAST(CASE WHEN n.id IN (SELECT id FROM looped) THEN -1 WHEN w.id IS NULL THEN coalesce(l.n, 0) ELSE coalesce(c.n, 0) END AS BIGINT) AS n_below
FROM n LEFT JOIN walk w ON w.id = n.id LEFT JOIN cnt c ON c.ancestor_id = n.id LEFT JOIN loose l ON l.anc = n.id""",
    "p1_descendants": _NODES + _PAIRS + " SELECT ancestor_id, id, CAST(distance AS INTEGER) AS distance FROM pair",
    "p1_below": _NODES
    + _PAIRS
    + _LOOP
    + """,
up AS (
  SELECT id AS start, parent_id AS cur, [parent_id] AS seen FROM edge WHERE id NOT IN (SELECT id FROM walk) AND id NOT IN (SELECT id FROM looped)
  UNION ALL
  SELECT u.start, e.parent_id, list_append(u.seen, e.parent_id) FROM up u JOIN edge e ON e.id = u.cur WHERE NOT list_contains(u.seen, e.parent_id)
)
SELECT ancestor_id, id, CAST(distance AS INTEGER) AS distance FROM pair
UNION ALL
SELECT cur, start, CAST(len(seen) AS INTEGER) FROM up""",
    "p1_cycles": _NODES + _LOOP + " SELECT e.id, e.parent_id FROM edge e WHERE e.id IN (SELECT id FROM looped)",
    "p3_found": _REFS + " SELECT * FROM cases WHERE kind IS NOT NULL",
    "p3_counts": _REFS + " SELECT ref_table, kind, period, count(*) AS n FROM cases WHERE kind IS NOT NULL GROUP BY ALL",
    "p4_found": _HISTORY + " SELECT DISTINCT subject, relation, object, from_s, until_s FROM period",
    "p4_changes": _HISTORY
    + " SELECT relation, change, count(*) AS n, count(*) FILTER (until_s = -1) AS n_open FROM period GROUP BY ALL",
}
ORACLE["p1_rounds"] = ORACLE["p1_nodes"]
