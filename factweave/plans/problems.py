"""Queries of the general problems: nested records (1), heavy keys (3) and hierarchies (5), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import hierarchy, nested, skew
from ..sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.flatten_values(table(spark, folder, "annotation_sites"), fields=False)


def p1_values(spark: SparkSession, folder: str) -> DataFrame:
    """With what each value object holds; '' and -1 stand for nothing."""
    v = nested.flatten_values(table(spark, folder, "annotation_sites"))
    return v.fillna("", ["kind", "value", "enum_type", "annotation_type"]).fillna(-1, ["item_count"])


def p1_annotations(spark: SparkSession, folder: str) -> DataFrame:
    return nested.flatten_sites(table(spark, folder, "annotation_sites"))["annotations"]


def p1_sites(spark: SparkSession, folder: str) -> DataFrame:
    return nested.flatten_sites(table(spark, folder, "annotation_sites"))["sites"].select("site_id", "owner_fqn", "target", "member", "ann_type")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return skew.dependent_counts(table(spark, folder, "type_refs"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.hierarchy_paths(table(spark, folder, "types"))


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendant_pairs(hierarchy.hierarchy_paths(table(spark, folder, "types")))


def p5_all_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """With the descendants in and below loops, which p5_descendants leaves out."""
    return hierarchy.all_descendants(table(spark, folder, "types"))


QUERIES = {f.__name__: f for f in (p1_found, p1_values, p1_annotations, p1_sites, p3_found, p5_found, p5_descendants, p5_all_descendants)}

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"

VALUES_CTE = """
WITH RECURSIVE whole AS (
  SELECT site_id, CASE WHEN json_type(attrs) = 'VARCHAR' THEN attrs::JSON ->> '$' ELSE attrs END AS js
  FROM annotation_sites WHERE site_id IS NOT NULL AND json_valid(attrs)
), good AS (
  SELECT site_id, min(js) AS js FROM whole WHERE json_valid(js) AND json_type(js) = 'OBJECT' GROUP BY site_id
), vals(site_id, path, parent_path, js) AS (
  SELECT site_id, e.key, '', e.value FROM good, json_each(js) e
  WHERE json_type(e.value) = 'OBJECT' AND list_contains(json_keys(e.value), 'kind')
  UNION ALL
  SELECT site_id, path || suffix, path, value FROM (
    SELECT v.site_id, v.path, '[' || e.key || ']' AS suffix, e.value
    FROM vals v, json_each(v.js, '$.items') e WHERE json_type(v.js, '$.items') = 'ARRAY'
    UNION ALL
    SELECT v.site_id, v.path, '.' || e.key, e.value
    FROM vals v, json_each(v.js, '$.annotation.parameters') e WHERE json_type(v.js, '$.annotation.parameters') = 'OBJECT'
  ) WHERE json_type(value) = 'OBJECT' AND list_contains(json_keys(value), 'kind')
)
"""

VALUE_COLUMNS = """coalesce(js ->> '$.kind', '') AS kind, coalesce(js ->> '$.value', '') AS value, coalesce(js ->> '$.enumType', '') AS enum_type,
  coalesce(js ->> '$.annotation.type', '') AS annotation_type, CASE WHEN json_type(js, '$.items') = 'ARRAY' THEN json_array_length(js, '$.items')::BIGINT ELSE -1 END AS item_count"""

SQL = {
    "p1_found": VALUES_CTE + "SELECT site_id, path, parent_path FROM vals",
    "p1_values": VALUES_CTE + f"SELECT site_id, path, parent_path, {VALUE_COLUMNS} FROM vals",
    "p1_annotations": VALUES_CTE + "SELECT site_id, path, parent_path, js ->> '$.annotation.type' AS annotation_type FROM vals WHERE js ->> '$.annotation.type' IS NOT NULL",
    "p1_sites": """
SELECT site_id, r.owner_fqn, r.target, r.member, r.ann_type FROM (
  SELECT site_id, max(struct_pack(owner_fqn := owner_fqn, target := target, member := member, ann_type := ann_type)) AS r
  FROM annotation_sites WHERE site_id IS NOT NULL GROUP BY site_id)""",
    "p3_found": f"""
WITH named AS (
  SELECT trim(regexp_replace(trim(replace(type_fqn, '/', '.'), {_BLANKS}), '\\[\\]$', ''), {_BLANKS}) AS type_fqn,
         trim(replace(from_fqn, '/', '.'), {_BLANKS}) AS origin
  FROM type_refs)
SELECT type_fqn, count(DISTINCT origin) AS dependent_count FROM named
WHERE type_fqn <> '' AND origin <> '' AND type_fqn <> origin GROUP BY type_fqn""",
}

_GRAPH = f"""
WITH RECURSIVE held AS (
  SELECT fqn, superclass, interfaces FROM (
    SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY scanned_at DESC NULLS LAST, superclass DESC, interfaces DESC) AS n FROM types WHERE fqn IS NOT NULL) WHERE n = 1
), edges AS (
  SELECT DISTINCT fqn AS child, parent FROM (
    SELECT fqn, trim(split_part(replace(trim(p, {_BLANKS}), '/', '.'), '<', 1), {_BLANKS}) AS parent
    FROM (SELECT fqn, unnest(list_append(coalesce(interfaces, []), superclass)) AS p FROM held))
  WHERE parent <> '' AND parent <> 'java.lang.Object'
), above(fqn, anc) AS (
  SELECT child, parent FROM edges UNION SELECT a.fqn, e.parent FROM above a JOIN edges e ON e.child = a.anc
), loops AS (SELECT fqn FROM above WHERE fqn = anc),
stuck AS (SELECT DISTINCT fqn FROM above WHERE anc IN (SELECT fqn FROM loops)),
roots AS (
  SELECT DISTINCT e.parent AS fqn FROM edges e LEFT JOIN held h ON h.fqn = e.parent WHERE h.fqn IS NULL
  UNION ALL SELECT h.fqn FROM held h LEFT JOIN edges e ON e.child = h.fqn WHERE e.child IS NULL
), ways(fqn, root_fqn, depth, path) AS (
  SELECT fqn, fqn, 0, fqn FROM roots
  UNION ALL
  SELECT e.child, w.root_fqn, w.depth + 1, w.path || '>' || e.child FROM ways w JOIN edges e ON e.parent = w.fqn
  WHERE e.child NOT IN (SELECT fqn FROM stuck)
)
"""

SQL["p5_found"] = _GRAPH + """
SELECT w.fqn, w.root_fqn, w.depth, w.path FROM ways w JOIN held h ON h.fqn = w.fqn
UNION ALL
SELECT fqn, '', CASE WHEN fqn IN (SELECT fqn FROM loops) THEN -1 ELSE -2 END, '' FROM stuck"""
SQL["p5_descendants"] = _GRAPH + "SELECT DISTINCT anc AS fqn, fqn AS descendant_fqn FROM above WHERE fqn NOT IN (SELECT fqn FROM stuck)"
SQL["p5_all_descendants"] = _GRAPH + "SELECT anc AS fqn, fqn AS descendant_fqn FROM above"
