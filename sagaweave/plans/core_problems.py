"""Queries of the general problems: interval coverage (2) and hierarchies (6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hierarchy import descendants, resolve_hierarchy
from ..operators.intervals import coverage, gaps
from ..runtime import latest_by_id, table

TREES = {"cycles": "parent_cycle_id", "taxonomies": "parent_taxonomy_id", "scope_registry": "parent_scope_id"}
STAMP = "yyyy-MM-dd HH:mm:ss"


def _instances(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["id", "updated_at", "framework_id", "start_date", "end_date"]
    return latest_by_id(table(spark, sf, "arc_instances").select(*cols), "id", "updated_at")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every stretch between two consecutive covered periods of a framework."""
    return gaps(_instances(spark, sf), "framework_id", "start_date", "end_date").select(
        F.col("entity").alias("framework_id"),
        F.date_format("gap_from", STAMP).alias("gap_from"),
        F.date_format("gap_to", STAMP).alias("gap_to"),
    )


def p2_periods(spark: SparkSession, sf: str) -> DataFrame:
    """The continuous covered periods of each framework."""
    return coverage(_instances(spark, sf), "framework_id", "start_date", "end_date").select(
        F.col("entity").alias("framework_id"),
        F.date_format("period_start", STAMP).alias("period_start"),
        F.date_format("period_end", STAMP).alias("period_end"),
    )


def _trees(spark: SparkSession, sf: str, paths: bool) -> DataFrame:
    """All three trees in one run: node ids carry their table in front."""
    mark = lambda tab, c: F.concat(F.lit(f"{tab}/"), F.col(c))
    links = reduce(
        DataFrame.unionByName,
        [table(spark, sf, t).select(mark(t, "id").alias("id"), mark(t, p).alias("parent")) for t, p in TREES.items()],
    )
    return resolve_hierarchy(links, "id", "parent", paths)


def _split(col: str) -> list:
    return [F.substring_index(col, "/", 1), F.expr(f"substring({col}, instr({col}, '/') + 1)")]


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Root and depth of every node of the three trees."""
    tab, node = _split("node_id")
    return _trees(spark, sf, False).select(
        tab.alias("tab"), node.alias("node_id"), _split("root_id")[1].alias("root_id"), "depth"
    )


def p6_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Full path, root and depth of every node; the path is null on and below circles."""
    tab, node = _split("node_id")
    strip = F.transform("path", lambda x: F.regexp_replace(x, "^[a-z_]+/", ""))
    return _trees(spark, sf, True).select(
        tab.alias("tab"),
        node.alias("node_id"),
        _split("root_id")[1].alias("root_id"),
        "depth",
        F.array_join(strip, " > ").alias("path"),
    )


def p6_descendants(spark: SparkSession, sf: str) -> DataFrame:
    """(ancestor, node, distance) for every node below another."""
    tab, node = _split("node_id")
    return descendants(_trees(spark, sf, True)).select(
        tab.alias("tab"), _split("ancestor_id")[1].alias("ancestor_id"), node.alias("node_id"), "distance"
    )


_LATEST = """latest AS (
  SELECT framework_id f, start_date s, end_date e FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST) rn FROM arc_instances)
  WHERE rn = 1 AND framework_id IS NOT NULL AND start_date < end_date),
reach AS (SELECT *, max(e) OVER (PARTITION BY f ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM latest)"""

_WALK = """WITH RECURSIVE links AS (
  SELECT DISTINCT 'cycles' tab, id, parent_cycle_id parent FROM cycles
  UNION SELECT DISTINCT 'taxonomies', id, parent_taxonomy_id FROM taxonomies
  UNION SELECT DISTINCT 'scope_registry', id, parent_scope_id FROM scope_registry),
n AS (SELECT l.tab, l.id, p.id AS parent FROM links l LEFT JOIN links p ON p.tab = l.tab AND p.id = l.parent),
up AS (
  SELECT tab, id AS node_id, id AS here, parent, [id] AS seen FROM n
  UNION ALL
  SELECT up.tab, node_id, n.id, n.parent, list_append(seen, n.id) FROM up JOIN n ON n.tab = up.tab AND n.id = up.parent
  WHERE NOT list_contains(seen, up.parent)),
ended AS (SELECT * FROM up WHERE parent IS NULL OR list_contains(seen, parent)),
res AS (
  SELECT tab, node_id,
    CASE WHEN parent IS NULL THEN here ELSE list_min(list_slice(seen, list_position(seen, parent), len(seen))) END AS root_id,
    CASE WHEN parent IS NULL THEN len(seen) - 1 ELSE -1 END::INTEGER AS depth,
    CASE WHEN parent IS NULL THEN list_reverse(seen) END AS path
  FROM ended)
"""

QUERIES = {
    "p2_found": p2_found,
    "p2_periods": p2_periods,
    "p6_found": p6_found,
    "p6_paths": p6_paths,
    "p6_descendants": p6_descendants,
}
ORACLE = {
    "p2_found": f"""WITH {_LATEST}
SELECT f AS framework_id, strftime(before, '%Y-%m-%d %H:%M:%S') AS gap_from, strftime(s, '%Y-%m-%d %H:%M:%S') AS gap_to
FROM reach WHERE s > before""",
    "p2_periods": f"""WITH {_LATEST},
isl AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END)
  OVER (PARTITION BY f ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM reach)
SELECT f AS framework_id, strftime(min(s), '%Y-%m-%d %H:%M:%S') AS period_start,
  strftime(max(e), '%Y-%m-%d %H:%M:%S') AS period_end FROM isl GROUP BY f, k""",
    "p6_found": _WALK + "SELECT tab, node_id, root_id, depth FROM res",
    "p6_paths": _WALK + "SELECT tab, node_id, root_id, depth, array_to_string(path, ' > ') AS path FROM res",
    "p6_descendants": _WALK
    + """SELECT tab, path[k] AS ancestor_id, node_id, (depth + 1 - k)::INTEGER AS distance
FROM (SELECT *, unnest(range(1, depth + 1)) AS k FROM res WHERE depth > 0)""",
}
