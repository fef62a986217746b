"""Queries of the code-fact operators over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls, catalog, graph, paging, usages, xref
from ..sources import sinks
from ..sources.facts import Facts
from ..streaming import refresh
from .problems import VALUE_COLUMNS, VALUES_CTE

#: Parameters of the registered queries.
PACKAGE, NAME, METHOD, RETURNS = "com.vetchway.*", "*Client", "load*", "java.util"
ANNOTATION, RECEIVER, FACE = "org.tarnfell.meta.ElementMapping", "java.util.List", "java.lang.annotation.Annotation"
ANY_ANNOTATION, PROJECT_RETURNS, COMMON_METHOD, SCOPE = "org.tarnfell.*", "com.vetchway.", "removePolicy", "com.vetchway.quota.babadi.web.FinalChannelProvider"

QUERIES: dict = {}
SHORT = lambda c: f"regexp_replace({c}, '([\\p{{L}}_$][\\p{{L}}\\p{{N}}_$]*\\.)+', '', 'g')"


def query(f):
    QUERIES[f.__name__] = lambda spark, folder: f(Facts(spark, folder))
    return f


@query
def classes_list(f: Facts) -> DataFrame:
    return catalog.list_classes(f, package=PACKAGE)


@query
def classes_libraries(f: Facts) -> DataFrame:
    return catalog.list_classes(f, name=NAME, include_libraries=True)


@query
def classes_interfaces(f: Facts) -> DataFrame:
    return catalog.list_classes(f, interfaces_only=True).select("fqn", "method_count", "field_count")


@query
def classes_annotated(f: Facts) -> DataFrame:
    return catalog.list_classes(f, annotation=ANNOTATION, classes_only=True).select("fqn", "source", "visibility")


@query
def classes_extending(f: Facts) -> DataFrame:
    return catalog.list_classes(f, extends="java.lang.Enum").select("fqn", "source")


@query
def classes_implementing(f: Facts) -> DataFrame:
    return catalog.list_classes(f, implements=FACE, include_libraries=True).select("fqn", "source")


@query
def classes_page(f: Facts) -> DataFrame:
    """The second page of 20 of all project types; a page is the feature."""
    return paging.paginate(catalog.select_types(f).select("fqn", "visibility"), [F.col("fqn")], 1, 20)


@query
def classes_show(f: Facts) -> DataFrame:
    """Every project type with its annotations and members as text."""
    d = catalog.class_detail(f, catalog.select_types(f))
    member = F.transform("members", lambda m: F.concat_ws(" ", m["kind"], m["name"], m["type_text"]))
    return d.select("fqn", catalog.class_kind().alias("label"), F.coalesce("superclass", F.lit("")).alias("superclass"), F.coalesce(F.array_join("annotations", ","), F.lit("")).alias("annotations"), F.coalesce(F.array_join(member, ","), F.lit("")).alias("members"))


@query
def classes_stats(f: Facts) -> DataFrame:
    return catalog.statistics(f)


@query
def methods_search(f: Facts) -> DataFrame:
    return catalog.search_methods(f, name=METHOD, return_type=RETURNS)


@query
def methods_annotated(f: Facts) -> DataFrame:
    return catalog.search_methods(f, annotation=ANY_ANNOTATION, include_libraries=True)


def _interfaces(f: Facts) -> DataFrame:
    return f.types.where("is_interface and source = 'PROJECT'").select(F.col("fqn").alias("target"))


@query
def implementations(f: Facts) -> DataFrame:
    return graph.implementations(f, _interfaces(f))


@query
def hierarchy_parents(f: Facts) -> DataFrame:
    return graph.parent_chain(f, f.types.where("source = 'PROJECT'").select(F.col("fqn").alias("target")))


@query
def hierarchy_children(f: Facts) -> DataFrame:
    """Down from every library interface and every project class: the types of any source below them, by each way."""
    starts = f.types.where("(is_interface and source = 'LIBRARY') or (not is_interface and source = 'PROJECT')")
    return graph.children_tree(f, starts.select(F.col("fqn").alias("target")))


@query
def hierarchy_interfaces(f: Facts) -> DataFrame:
    return graph.declared_interfaces(f, f.types.select(F.col("fqn").alias("target")))


@query
def dependencies(f: Facts) -> DataFrame:
    d = graph.dependencies(f, _interfaces(f))
    return d.withColumn("location", F.coalesce("location", F.lit("")))


@query
def dependencies_libraries(f: Facts) -> DataFrame:
    d = graph.dependencies(f, f.types.where("is_enum").select(F.col("fqn").alias("target")), include_libraries=True)
    return d.groupBy("target", "direction", "source", "type").agg(F.count("*").alias("n"))


@query
def deps_edges(f: Facts) -> DataFrame:
    return graph.graph_edges(f)


@query
def deps_nodes(f: Facts) -> DataFrame:
    return graph.graph_nodes(f)


@query
def deps_dot(f: Facts) -> DataFrame:
    edges = graph.graph_edges(f)
    return graph.dot_lines(f.types.where("source = 'PROJECT'").select("fqn", "simple_name"), edges)


@query
def deps_foundation(f: Facts) -> DataFrame:
    return graph.foundation(f, 2)


@query
def deps_foundation_links(f: Facts) -> DataFrame:
    return graph.foundation_links(f, 2)


@query
def referenced_types(f: Facts) -> DataFrame:
    return graph.referenced_types(f)


@query
def deps_foundation_all(f: Facts) -> DataFrame:
    return graph.foundation(f, 0)


@query
def annotation_usages(f: Facts) -> DataFrame:
    u = usages.annotation_usages(f, ANNOTATION).orderBy(*usages.usage_order())
    return u.drop("ann_type", "param_type").fillna("", ["member", "descriptor", "field", "param_name"]).fillna(-1, ["param_index"])


@query
def annotation_usage_values(f: Facts) -> DataFrame:
    v = usages.usage_values(f, usages.annotation_usages(f, ANNOTATION))
    v = v.select("site_id", "owner_fqn", "target", "path", "kind", "value", "enum_type", "annotation_type", "item_count")
    return v.fillna("", ["kind", "value", "enum_type", "annotation_type"]).fillna(-1, ["item_count"])


@query
def annotation_usages_text(f: Facts) -> DataFrame:
    u = usages.with_attributes(f, usages.annotation_usages(f))
    return u.orderBy(*usages.usage_order(attributes=True)).select("site_id", "owner_fqn", "ann_type", "attributes")


@query
def annotation_usages_methods(f: Facts) -> DataFrame:
    return usages.annotation_usages(f, scope="METHOD", include_libraries=True).select("site_id", "owner_fqn", "target", "member", "ann_type")


@query
def annotation_usages_page(f: Facts) -> DataFrame:
    """The third page of 50 of all usages, in total order; a page is the feature."""
    return paging.paginate(usages.annotation_usages(f), usages.usage_order(), 2, 50).select("row_no", "site_id", "owner_fqn", "target")


@query
def annotation_counts(f: Facts) -> DataFrame:
    return usages.counts_by_target(usages.annotation_usages(f))


@query
def call_windows(f: Facts) -> DataFrame:
    return calls.call_windows(f.calls).withColumn("constants", F.array_join("constants", "|"))


@query
def calls_of_method(f: Facts) -> DataFrame:
    return calls.methods_with_calls(f, method=COMMON_METHOD)


@query
def calls_returning(f: Facts) -> DataFrame:
    return calls.calls_in(f, in_methods_returning=PROJECT_RETURNS).select("call_id", "caller_fqn", "caller_method", "owner_type", "method_name")


@query
def calls_annotated(f: Facts) -> DataFrame:
    return calls.calls_in(f, in_methods_annotated=ANY_ANNOTATION).select("call_id", "caller_fqn", "caller_method", "owner_type", "method_name")


@query
def calls_per_method(f: Facts) -> DataFrame:
    return calls.calls_per_method(calls.calls_in(f))


@query
def xref_rows(f: Facts) -> DataFrame:
    x = xref.xref(f, RECEIVER).orderBy(*xref.reference_order())
    return x.fillna("", ["member", "detail"]).fillna(-1, ["line"])


@query
def xref_by_kind(f: Facts) -> DataFrame:
    return xref.counts_by_kind(xref.xref(f, include_libraries=True))


@query
def xref_by_package(f: Facts) -> DataFrame:
    return xref.counts_by_package(xref.xref(f, kind="CALL_RECEIVER"))


@query
def xref_scope(f: Facts) -> DataFrame:
    """References from types that implement any project interface, by referring type and kind."""
    inside = graph.implementations(f, _interfaces(f)).select(F.col("fqn").alias("from_fqn"))
    return xref.xref(f).join(inside, "from_fqn", "left_semi").groupBy("from_fqn", "kind").agg(F.count("*").alias("n"))


@query
def xref_implementing(f: Facts) -> DataFrame:
    """References from the types below one type, as rows of JSON."""
    x = xref.xref(f, scope_implementing=SCOPE, include_libraries=True).select("type_fqn", "from_fqn", "kind").distinct()
    return sinks.as_json(x)


@query
def references_by_day(f: Facts) -> DataFrame:
    """The streaming count, over the whole table: a batch has no late rows."""
    return refresh.reference_counts(f.raw("type_refs")).withColumn("start", F.date_format("start", "yyyy-MM-dd"))


B = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
PLAIN = lambda c: f"trim(replace({c}, '/', '.'), {B})"
RAW = lambda c: f"trim(split_part({PLAIN(c)}, '<', 1), {B})"
_LIST = lambda c: f"list_filter(list_transform(coalesce({c}, []), lambda x: {RAW('x')}), lambda x: x IS NOT NULL AND x <> '')"

CTE = {
    "t": f"""t AS MATERIALIZED (
  SELECT fqn, simple_name, package_name, coalesce(source, 'LIBRARY') AS source, visibility, is_interface, is_abstract, is_final, is_enum, is_annotation, is_synthetic,
         nullif({RAW('superclass')}, '') AS superclass, {_LIST('interfaces')} AS interfaces, {_LIST('superclass_args')} AS superclass_args, {_LIST('interface_args')} AS interface_args, location
  FROM (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY scanned_at DESC NULLS LAST) AS rn FROM types WHERE fqn IS NOT NULL) WHERE rn = 1)""",
    "r": f"""r AS MATERIALIZED (
  SELECT DISTINCT ref_id, regexp_replace({PLAIN('type_fqn')}, '\\[\\]$', '') AS type_fqn, {PLAIN('from_fqn')} AS from_fqn, from_source, kind, member, detail, line_number
  FROM type_refs WHERE regexp_replace({PLAIN('type_fqn')}, '\\[\\]$', '') <> '' AND {PLAIN('from_fqn')} <> '')""",
    "c": f"""c AS MATERIALIZED (
  SELECT call_id, {PLAIN('caller_fqn')} AS caller_fqn, caller_method, call_idx, {PLAIN('owner_type')} AS owner_type, method_name, descriptor, is_interface, constant_args, line_number, invoke_dynamic, impl_method_owner, impl_method_name
  FROM call_sites WHERE caller_fqn IS NOT NULL AND call_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY call_id ORDER BY scanned_at DESC NULLS LAST, to_json(constant_args)::VARCHAR DESC, owner_type DESC) = 1)""",
    "s": f"""s AS MATERIALIZED (
  SELECT DISTINCT site_id, {PLAIN('owner_fqn')} AS owner_fqn, target, member, descriptor, field, param_name, param_index, param_type, {PLAIN('ann_type')} AS ann_type
  FROM annotation_sites WHERE owner_fqn IS NOT NULL)""",
    "m": """m AS MATERIALIZED (
  SELECT DISTINCT from_fqn AS owner_fqn, CASE kind WHEN 'RETURN' THEN 'METHOD' ELSE 'FIELD' END AS kind, member AS name, type_fqn AS type_text
  FROM r WHERE kind IN ('RETURN', 'FIELD') AND member IS NOT NULL)""",
    "mt": f"""mt AS MATERIALIZED (
  SELECT n.owner_fqn, n.name, m.type_text FROM (
    SELECT DISTINCT * FROM (
      SELECT from_fqn AS owner_fqn, member AS name FROM r WHERE kind IN ('RETURN', 'PARAM')
      UNION ALL SELECT {PLAIN('caller_fqn')}, caller_method FROM call_sites
      UNION ALL SELECT owner_fqn, member FROM s WHERE target IN ('METHOD', 'PARAMETER')
    ) WHERE owner_fqn IS NOT NULL AND name IS NOT NULL AND name <> '<init>' AND NOT starts_with(name, 'lambda$') AND NOT starts_with(name, 'access$')) n
  LEFT JOIN m ON m.kind = 'METHOD' AND m.owner_fqn = n.owner_fqn AND m.name = n.name)""",
    "mc": """mc AS (
  SELECT owner_fqn AS fqn, count(DISTINCT name) FILTER (kind = 'METHOD') AS method_count, count(DISTINCT name) FILTER (kind = 'FIELD') AS field_count FROM (
    SELECT owner_fqn, name, 'METHOD' AS kind FROM mt UNION ALL SELECT owner_fqn, name, kind FROM m WHERE kind = 'FIELD'
    UNION ALL SELECT owner_fqn, field, 'FIELD' FROM s WHERE target = 'FIELD' AND field IS NOT NULL) GROUP BY 1)""",
    "se": """se AS (
  SELECT DISTINCT super, fqn AS sub FROM (SELECT fqn, unnest(list_append(interfaces, superclass)) AS super FROM t WHERE source = 'PROJECT') WHERE super IS NOT NULL AND super <> fqn)""",
    "e": """e AS MATERIALIZED (
  SELECT DISTINCT * FROM (
    SELECT fqn AS src, unnest(list_append(superclass_args, CASE WHEN superclass <> 'java.lang.Object' THEN superclass END)) AS dst, 'EXTENDS' AS type, 0 AS ord, NULL AS location FROM t
    UNION ALL SELECT fqn, unnest(list_concat(interfaces, interface_args)), 'IMPLEMENTS', 1, NULL FROM t
    UNION ALL SELECT from_fqn, type_fqn, CASE kind WHEN 'FIELD' THEN 'FIELD_TYPE' WHEN 'RETURN' THEN 'METHOD_RETURN_TYPE' ELSE 'METHOD_PARAMETER' END,
      CASE kind WHEN 'FIELD' THEN 2 WHEN 'RETURN' THEN 3 ELSE 4 END, CASE kind WHEN 'FIELD' THEN member ELSE member || '()' END FROM r WHERE kind IN ('FIELD', 'RETURN', 'PARAM')
  ) WHERE src <> dst)""",
    "g": """g AS (
  SELECT src AS source, dst AS target, arg_min(type, ord) AS type FROM e
  WHERE src IN (SELECT fqn FROM t WHERE source = 'PROJECT') AND dst IN (SELECT fqn FROM t WHERE source = 'PROJECT') GROUP BY 1, 2)""",
    "u": """u AS (
  SELECT site_id, owner_fqn, target, CASE target WHEN 'CONSTRUCTOR' THEN '<init>' ELSE member END AS member, CASE WHEN trim(descriptor) <> '' THEN descriptor END AS descriptor, field, param_index, param_name, param_type, ann_type
  FROM s WHERE owner_fqn IN (SELECT fqn FROM t WHERE source = 'PROJECT') AND target IN ('CLASS', 'METHOD', 'CONSTRUCTOR', 'FIELD', 'PARAMETER'))""",
    "named": """named AS (
  SELECT DISTINCT unnest(list_append(superclass_args, superclass)) AS type_fqn, fqn AS from_fqn, 'EXTENDS' AS kind, NULL AS member, NULL AS detail, NULL::INT AS line FROM t
  UNION ALL SELECT DISTINCT unnest(list_concat(interfaces, interface_args)), fqn, 'IMPLEMENTS', NULL, NULL, NULL FROM t
  UNION ALL SELECT type_fqn, from_fqn, kind, member, CASE kind WHEN 'FIELD' THEN detail END, NULL FROM r WHERE kind IN ('FIELD', 'RETURN', 'PARAM')
  UNION ALL SELECT ann_type, owner_fqn, 'ANNOTATION', m, NULL, NULL FROM (
    SELECT DISTINCT owner_fqn, ann_type, CASE target WHEN 'FIELD' THEN field WHEN 'CONSTRUCTOR' THEN '<init>' ELSE member END AS m, descriptor FROM s WHERE target <> 'PARAMETER' AND ann_type IS NOT NULL))""",
    "x": """x AS (
  SELECT * FROM (
    SELECT * FROM named {where}
    UNION ALL SELECT owner_type, caller_fqn, CASE method_name WHEN '<init>' THEN 'INSTANTIATION' ELSE 'CALL_RECEIVER' END, caller_method, CASE WHEN method_name <> '<init>' THEN method_name END, line_number
    FROM c WHERE NOT invoke_dynamic AND owner_type IS NOT NULL AND method_name IS NOT NULL AND caller_fqn IN (SELECT fqn FROM t WHERE source = 'PROJECT')
  ) WHERE type_fqn <> from_fqn)""",
    "impl": """reach(target, fqn) AS (
  SELECT super, sub FROM se WHERE super IN (SELECT fqn FROM t WHERE is_interface AND source = 'PROJECT')
  UNION SELECT a.target, se.sub FROM reach a JOIN se ON se.super = a.fqn
), impl AS (
  SELECT target, fqn, CASE WHEN EXISTS (SELECT 1 FROM se WHERE se.super = target AND se.sub = reach.fqn) THEN 'DIRECT' ELSE 'INDIRECT' END AS relation FROM reach WHERE target <> fqn)""",
}
_PROJECT = "WHERE from_fqn IN (SELECT fqn FROM t WHERE source = 'PROJECT')"


def _sql(names: str, body: str, where: str = _PROJECT) -> str:
    return "WITH RECURSIVE " + ", ".join(CTE[n].replace("{where}", where) for n in names.split()) + body


_SUMMARY = "SELECT t.fqn, simple_name, package_name, source, visibility, is_interface, is_abstract, is_enum, is_annotation, coalesce(method_count, 0) AS method_count, coalesce(field_count, 0) AS field_count FROM t LEFT JOIN mc USING (fqn)"
_TARGET_NO = "CASE target WHEN 'CLASS' THEN 0 WHEN 'METHOD' THEN 1 WHEN 'CONSTRUCTOR' THEN 2 WHEN 'FIELD' THEN 3 WHEN 'PARAMETER' THEN 4 ELSE 5 END"

SQL = {
    "classes_list": _sql("t r s m mt mc", f" {_SUMMARY} WHERE source = 'PROJECT' AND regexp_full_match(package_name, 'com\\.vetchway\\..*')"),
    "classes_libraries": _sql("t r s m mt mc", f" {_SUMMARY} WHERE regexp_full_match(simple_name, '.*Client') OR regexp_full_match(t.fqn, '.*Client')"),
    "classes_interfaces": _sql("t r s m mt mc", " SELECT t.fqn, coalesce(method_count, 0) AS method_count, coalesce(field_count, 0) AS field_count FROM t LEFT JOIN mc USING (fqn) WHERE is_interface AND source = 'PROJECT'"),
    "classes_annotated": _sql("t s", f" SELECT fqn, source, visibility FROM t WHERE source = 'PROJECT' AND NOT is_interface AND fqn IN (SELECT owner_fqn FROM s WHERE target = 'CLASS' AND ann_type = '{ANNOTATION}')"),
    "classes_extending": _sql("t", " SELECT fqn, source FROM t WHERE source = 'PROJECT' AND superclass = 'java.lang.Enum'"),
    "classes_implementing": _sql("t", f" SELECT fqn, source FROM t WHERE list_contains(interfaces, '{FACE}')"),
    "classes_page": _sql("t", " SELECT fqn, visibility, row_number() OVER (ORDER BY fqn) AS row_no FROM t WHERE source = 'PROJECT' ORDER BY fqn LIMIT 20 OFFSET 20"),
    "classes_show": _sql("t r m s", """ SELECT fqn, CASE WHEN is_interface THEN 'interface' WHEN is_annotation THEN 'annotation' WHEN is_enum THEN 'enum' WHEN is_abstract THEN 'abstract' ELSE 'class' END AS label,
  coalesce(superclass, '') AS superclass,
  coalesce((SELECT string_agg(a, ',' ORDER BY a) FROM (SELECT DISTINCT ann_type AS a FROM s WHERE target = 'CLASS' AND owner_fqn = t.fqn)), '') AS annotations,
  coalesce((SELECT string_agg(concat_ws(' ', kind, name, type_text), ',' ORDER BY kind, name, type_text) FROM m WHERE owner_fqn = t.fqn), '') AS members
FROM t WHERE source = 'PROJECT'"""),
    "classes_stats": _sql("t r s m mt mc", """ SELECT count(*) FILTER (source = 'PROJECT') AS project_classes, count(*) FILTER (source = 'LIBRARY') AS library_classes, count(*) FILTER (source = 'JDK') AS jdk_classes,
  count(*) FILTER (source = 'PROJECT' AND is_interface) AS interfaces, count(*) FILTER (source = 'PROJECT' AND is_abstract AND NOT is_interface) AS abstract_classes,
  count(*) FILTER (source = 'PROJECT' AND is_enum) AS enums, count(*) FILTER (source = 'PROJECT' AND is_annotation) AS annotations,
  coalesce(sum(method_count) FILTER (source = 'PROJECT'), 0)::BIGINT AS methods, coalesce(sum(field_count) FILTER (source = 'PROJECT'), 0)::BIGINT AS fields FROM t LEFT JOIN mc USING (fqn)"""),
    "methods_search": _sql("t r s m mt", " SELECT mt.owner_fqn AS class_fqn, name, coalesce(type_text, '') AS return_type, source FROM mt JOIN t ON t.fqn = mt.owner_fqn WHERE source = 'PROJECT' AND regexp_full_match(name, 'load.*') AND contains(type_text, 'java.util')"),
    "methods_annotated": _sql("t r s m mt", " SELECT mt.owner_fqn AS class_fqn, name, coalesce(type_text, '') AS return_type, source FROM mt JOIN t ON t.fqn = mt.owner_fqn WHERE EXISTS (SELECT 1 FROM s WHERE s.target = 'METHOD' AND starts_with(s.ann_type, 'org.tarnfell.') AND s.owner_fqn = mt.owner_fqn AND s.member = mt.name)"),
    "hierarchy_interfaces": _sql("t", f""" , pos AS (
  SELECT target, fqn, row_number() OVER (PARTITION BY target ORDER BY i) - 1 AS position FROM (
    SELECT fqn AS target, f AS fqn, min(i) AS i FROM (SELECT fqn, unnest(interfaces) AS f, generate_subscripts(interfaces, 1) AS i FROM t) GROUP BY 1, 2))
SELECT target, fqn, position::INT AS position FROM pos WHERE fqn IN (SELECT fqn FROM t)"""),
    "dependencies": _sql("t r e", """ , targets AS (SELECT fqn FROM t WHERE is_interface AND source = 'PROJECT'),
d AS (SELECT src AS target, 'OUTGOING' AS direction, dst AS class_fqn, type, location FROM e WHERE src IN (SELECT fqn FROM targets)
  UNION ALL SELECT dst, 'INCOMING', src, type, location FROM e WHERE dst IN (SELECT fqn FROM targets))
SELECT target, direction, class_fqn, type, coalesce(d.location, '') AS location, t.source FROM d JOIN t ON t.fqn = class_fqn WHERE t.source = 'PROJECT'"""),
    "dependencies_libraries": _sql("t r e", """ , targets AS (SELECT fqn FROM t WHERE is_enum),
d AS (SELECT src AS target, 'OUTGOING' AS direction, dst AS class_fqn, type, location FROM e WHERE src IN (SELECT fqn FROM targets)
  UNION ALL SELECT dst, 'INCOMING', src, type, location FROM e WHERE dst IN (SELECT fqn FROM targets))
SELECT target, direction, coalesce(t.source, 'LIBRARY') AS source, type, count(*) AS n FROM d LEFT JOIN t ON t.fqn = class_fqn GROUP BY ALL"""),
    "deps_edges": _sql("t r e g", " SELECT source, target, type FROM g"),
    "deps_nodes": _sql("t r e g", " SELECT fqn, simple_name, (SELECT count(*) FROM g WHERE g.target = t.fqn) AS in_degree, (SELECT count(*) FROM g WHERE g.source = t.fqn) AS out_degree FROM t WHERE source = 'PROJECT'"),
    "deps_dot": _sql("t r e g", """ SELECT 0 AS section, '' AS fqn, '' AS target, 'digraph dependencies {' AS line
UNION ALL SELECT 1, fqn, '', '  "' || fqn || '" [label="' || simple_name || '"];' FROM t WHERE source = 'PROJECT'
UNION ALL SELECT 2, source, target, '  "' || source || '" -> "' || target || '" [style=' || CASE type WHEN 'EXTENDS' THEN 'bold' WHEN 'IMPLEMENTS' THEN 'dashed' ELSE 'solid' END || '];' FROM g
UNION ALL SELECT 3, '', '', '}'"""),
    "deps_foundation": _sql("t r e g", " SELECT target AS fqn, count(*) AS dependent_count FROM g GROUP BY 1 HAVING count(*) >= 2"),
    "deps_foundation_links": _sql("t r e g", " SELECT target AS fqn, source AS dependent FROM g WHERE target IN (SELECT target FROM g GROUP BY 1 HAVING count(*) >= 2)"),
    "referenced_types": _sql("t r s", f""" , named_types AS (
  SELECT fqn, unnest(list_concat([superclass], superclass_args, interfaces, interface_args)) AS type_fqn FROM t
  UNION ALL SELECT from_fqn, trim(split_part(trim(replace(type_fqn, '[]', '')), '<', 1)) FROM r
  UNION ALL SELECT owner_fqn, ann_type FROM s
  UNION ALL SELECT {PLAIN('caller_fqn')}, trim(split_part(trim(replace({PLAIN('owner_type')}, '[]', '')), '<', 1)) FROM call_sites WHERE NOT invoke_dynamic)
SELECT DISTINCT fqn, type_fqn FROM named_types WHERE type_fqn <> '' AND fqn <> type_fqn AND type_fqn NOT IN ('void', 'boolean', 'byte', 'char', 'short', 'int', 'long', 'float', 'double')"""),
    "deps_foundation_all": _sql("t r e g", " SELECT fqn, (SELECT count(*) FROM g WHERE g.target = t.fqn) AS dependent_count FROM t WHERE source = 'PROJECT'"),
    "annotation_usages": _sql("t s u", f" SELECT site_id, owner_fqn, target, coalesce(member, '') AS member, coalesce(descriptor, '') AS descriptor, coalesce(field, '') AS field, coalesce(param_index, -1) AS param_index, coalesce(param_name, '') AS param_name FROM u WHERE ann_type = '{ANNOTATION}'"),
    "annotation_usage_values": VALUES_CTE + ", " + _sql("t s u", f""" SELECT u.site_id, owner_fqn, target, path, {VALUE_COLUMNS} FROM u JOIN vals USING (site_id) WHERE ann_type = '{ANNOTATION}'""").removeprefix("WITH RECURSIVE "),
    "annotation_usages_text": VALUES_CTE + ", " + _sql("t s u", """, leaf AS (
  SELECT site_id, path, path || '=' || coalesce(CASE js ->> '$.kind' WHEN 'STRING' THEN '"' || (js ->> '$.value') || '"' WHEN 'CLASS' THEN SHORT(js ->> '$.value') WHEN 'ANNOTATION' THEN '@' || SHORT(js ->> '$.annotation.type') ELSE js ->> '$.value' END, '') AS text
  FROM vals WHERE js ->> '$.kind' <> 'ARRAY' AND NOT (js ->> '$.kind' = 'STRING' AND coalesce(js ->> '$.value', '') = '')
), attrs_text AS (SELECT site_id, string_agg(text, ', ' ORDER BY path) AS attributes FROM leaf GROUP BY 1)
SELECT u.site_id, owner_fqn, ann_type, coalesce(attributes, '') AS attributes FROM u LEFT JOIN attrs_text USING (site_id)""".replace("SHORT(js ->> '$.value')", SHORT("(js ->> '$.value')")).replace("SHORT(js ->> '$.annotation.type')", SHORT("(js ->> '$.annotation.type')"))).removeprefix("WITH RECURSIVE "),
    "annotation_usages_methods": _sql("s", " SELECT site_id, owner_fqn, target, CASE target WHEN 'CONSTRUCTOR' THEN '<init>' ELSE member END AS member, ann_type FROM s WHERE target IN ('METHOD', 'CONSTRUCTOR')"),
    "annotation_usages_page": _sql("t s u", f" SELECT row_number() OVER (ORDER BY owner_fqn, {_TARGET_NO}, coalesce(member, ''), coalesce(descriptor, ''), coalesce(field, ''), coalesce(param_index, -1), coalesce(param_name, ''), ann_type, site_id) AS row_no, site_id, owner_fqn, target FROM u QUALIFY row_no BETWEEN 101 AND 150"),
    "annotation_counts": _sql("t s u", " SELECT target, count(*) AS n FROM u GROUP BY 1"),
    "call_windows": _sql("c", """ SELECT caller_fqn, caller_method, call_idx, call_id, line_number,
  CASE WHEN invoke_dynamic THEN '' ELSE coalesce(array_to_string(list_transform(list_slice(constant_args, greatest(len(constant_args) - 15, 1), len(constant_args)), lambda a: a.kind || ':' || coalesce(a.value, '')), '|'), '') END AS constants
FROM c WHERE caller_method IS NOT NULL AND (invoke_dynamic OR (owner_type IS NOT NULL AND method_name IS NOT NULL))"""),
    "calls_of_method": _sql("r s m mt c", f""", n AS (SELECT caller_fqn AS owner_fqn, caller_method AS name, count(*) AS calls FROM c WHERE caller_method = '{COMMON_METHOD}' GROUP BY 1, 2)
SELECT coalesce(k.owner_fqn, n.owner_fqn) AS owner_fqn, coalesce(k.name, n.name) AS name, coalesce(calls, 0) AS calls
FROM (SELECT DISTINCT owner_fqn, name FROM mt WHERE name = '{COMMON_METHOD}') k FULL JOIN n ON k.owner_fqn = n.owner_fqn AND k.name = n.name"""),
    "calls_returning": _sql("r m c", " SELECT call_id, caller_fqn, caller_method, owner_type, method_name FROM c WHERE EXISTS (SELECT 1 FROM m WHERE kind = 'METHOD' AND contains(type_text, 'com.vetchway.') AND m.owner_fqn = c.caller_fqn AND m.name = c.caller_method)"),
    "calls_annotated": _sql("s c", f" SELECT call_id, caller_fqn, caller_method, owner_type, method_name FROM c WHERE EXISTS (SELECT 1 FROM s WHERE target = 'METHOD' AND starts_with(ann_type, 'org.tarnfell.') AND s.owner_fqn = c.caller_fqn AND s.member = c.caller_method)"),
    "calls_per_method": _sql("c", " SELECT caller_fqn, caller_method, count(*) AS calls FROM c GROUP BY 1, 2"),
    "xref_rows": _sql("t r s c named x", f" SELECT type_fqn, from_fqn, kind, coalesce(member, '') AS member, coalesce(detail, '') AS detail, coalesce(line, -1) AS line FROM x WHERE type_fqn = '{RECEIVER}'"),
    "xref_by_kind": _sql("t r s c named x", " SELECT kind, count(*) AS n FROM x GROUP BY 1", ""),
    "xref_by_package": _sql("t r s c named x", " SELECT regexp_extract(from_fqn, '^(.*)\\.[^.]*$', 1) AS package, count(*) AS n FROM x WHERE kind = 'CALL_RECEIVER' GROUP BY 1"),
    "xref_scope": _sql("t r s c named x se impl", " SELECT from_fqn, kind, count(*) AS n FROM x WHERE from_fqn IN (SELECT fqn FROM impl) GROUP BY 1, 2"),
    "xref_implementing": _sql("t r s c named x", f""", sub AS (
  SELECT DISTINCT super, fqn AS sub FROM (SELECT fqn, unnest(list_append(interfaces, superclass)) AS super FROM t) WHERE super IS NOT NULL AND super <> fqn
), inside AS (
  SELECT sub AS fqn FROM sub WHERE super = '{SCOPE}' AND super IN (SELECT fqn FROM t) UNION SELECT s2.sub FROM inside i JOIN sub s2 ON s2.super = i.fqn)
SELECT DISTINCT to_json(struct_pack(type_fqn := type_fqn, from_fqn := from_fqn, kind := kind))::VARCHAR AS json FROM x WHERE from_fqn IN (SELECT fqn FROM inside WHERE fqn <> '{SCOPE}')""", ""),
    "references_by_day": """SELECT strftime(start, '%Y-%m-%d') AS start, kind, count(*) AS n FROM (
  SELECT DISTINCT ON (ref_id) ref_id, kind, date_trunc('day', seen_at) AS start FROM type_refs WHERE seen_at IS NOT NULL AND ref_id IS NOT NULL) GROUP BY 1, 2""",
    "implementations": _sql("t se impl", " SELECT target, fqn, relation, depth FROM (SELECT *, (SELECT min(d) FROM hops WHERE hops.target = impl.target AND hops.fqn = impl.fqn) AS depth FROM impl)").replace("), impl AS (", "), hops(target, fqn, d) AS (SELECT super, sub, 1 FROM se WHERE super IN (SELECT fqn FROM t WHERE is_interface AND source = 'PROJECT') UNION SELECT h.target, se.sub, h.d + 1 FROM hops h JOIN se ON se.super = h.fqn WHERE h.d < 60), impl AS ("),
    "hierarchy_parents": _sql("t", """ , up AS (
  SELECT fqn, coalesce(superclass, CASE WHEN NOT is_interface AND NOT is_annotation AND fqn <> 'java.lang.Object' THEN 'java.lang.Object' END) AS parent FROM t
), chain(target, fqn, depth, way) AS (
  SELECT fqn, parent, 1, [fqn] FROM up WHERE source_of(fqn) AND parent IS NOT NULL AND parent <> fqn
  UNION ALL SELECT c.target, up.parent, c.depth + 1, list_append(c.way, c.fqn) FROM chain c JOIN up ON up.fqn = c.fqn WHERE up.parent IS NOT NULL AND NOT list_contains(list_append(c.way, c.fqn), up.parent)
)
SELECT target, depth, chain.fqn, CASE WHEN chain.fqn = 'java.lang.Object' THEN 'JDK' ELSE coalesce(t.source, 'LIBRARY') END AS source FROM chain LEFT JOIN t ON t.fqn = chain.fqn""".replace("source_of(fqn)", "fqn IN (SELECT fqn FROM t WHERE source = 'PROJECT')")),
    "hierarchy_children": _sql("t", """ , ce AS (
  SELECT DISTINCT super, sub FROM (
    SELECT superclass AS super, fqn AS sub, false AS face FROM t WHERE superclass IS NOT NULL
    UNION ALL SELECT unnest(interfaces), fqn, true FROM t) x JOIN t k ON k.fqn = x.super AND k.is_interface = x.face
), tree(target, depth, way) AS (
  SELECT fqn, 0, [fqn] FROM t WHERE (is_interface AND source = 'LIBRARY') OR (NOT is_interface AND source = 'PROJECT')
  UNION ALL SELECT target, depth + 1, list_append(way, ce.sub) FROM tree JOIN ce ON ce.super = way[-1] WHERE NOT list_contains(way, ce.sub)
)
SELECT target, depth, array_to_string(way, '>') AS path, way[-1] AS fqn FROM tree WHERE depth > 0"""),
}
