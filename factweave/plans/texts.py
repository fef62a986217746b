"""Queries of the text, stub, class path and recipe operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import stubs, text
from ..sources import classpath
from ..sources.facts import Facts
from . import recipes
from .problems import VALUES_CTE
from .reference import ANY_ANNOTATION, PROJECT_RETURNS, SHORT, _sql

QUERIES: dict = {}

#: Parameters of the registered queries.
STACK = {"collections": "java.util.", "kotlin": "kotlin.", "logging": "org.tarnfell.log.", "wiring": "io.pallowick.wire.", "absent": "com.absent."}
RULES = [("boxed-check", "INFO", "kotlin.jvm.internal.", "checkNotNull"), ("string-building", "WARNING", "java.lang.StringBuilder", ""), ("route-debug", "ERROR", "org.tarnfell.web.", "debug")]
ROUTING = ("get", "of", "equals", "size", "hasNext", "iterator", "checkNotNull")
CENSUS = ["java.lang.String", "java.util.List", "java.util.Map", "org.tarnfell.log.Journal", "io.pallowick.wire.Injector"]


def query(f):
    QUERIES[f.__name__] = lambda spark, folder: f(Facts(spark, folder))
    return f


@query
def lint_findings(f: Facts) -> DataFrame:
    return text.lint(f.sources)


@query
def lint_rollup(f: Facts) -> DataFrame:
    return text.lint_rollup(text.lint(f.sources))


@query
def lint_summary(f: Facts) -> DataFrame:
    return text.lint_summary(f.sources)


@query
def lint_documents(f: Facts) -> DataFrame:
    """The same rules over every document, counted by rule."""
    docs = f.raw("documents").select("doc_id", "text")
    return text.lint(docs, "doc_id", "text").groupBy("rule").agg(F.count("*").alias("n"))


@query
def format_files(f: Facts) -> DataFrame:
    return text.format_files(f.sources).select("path", "changed", "remaining", F.md5("content").alias("digest"))


@query
def source_docs(f: Facts) -> DataFrame:
    """Whether each file has documentation, and how many lines."""
    held = f.sources.where("content is not null")
    return held.select("path", text.has_docs(F.col("content")).alias("documented"), F.size(F.split("content", "\r\n|\n|\r")).alias("lines"))


@query
def source_signatures(f: Facts) -> DataFrame:
    return text.doc_signatures(f.sources)


@query
def source_methods(f: Facts) -> DataFrame:
    """Of every file with text the first declaration of each name before an opening bracket, with two lines around it."""
    named = F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_]\w*)\s*\("), F.lit(1)))
    found = text.methods_in_files(f.sources.select("path", "content", named.alias("method_names")), context=2)
    return found.select("path", "method_name", "start_line", "end_line", F.md5("code").alias("code_digest"), F.length("before").alias("before_chars"), F.length("after").alias("after_chars"))


@query
def source_declarations(f: Facts) -> DataFrame:
    """For every tenth line of every file, and for every line that a call or reference names, the nearest declaration
    above it."""
    lines = text.source_lines(f.sources)
    named = f.refs.select(F.col("from_fqn").alias("fqn"), "line_number").union(f.calls.select(F.col("caller_fqn").alias("fqn"), "line_number")).distinct()
    at = f.sources.select("fqn", "path", F.size(F.split("content", "\r\n|\n|\r")).alias("n")).where("n > 0")
    said = named.join(at, "fqn").where("line_number between 1 and n").select("path", F.col("line_number").alias("at"))
    places = lines.where("line_no % 10 = 0").select("path", F.col("line_no").alias("at")).union(said).distinct()
    return text.declaration_starts(lines, places)


@query
def sources_resolved(f: Facts) -> DataFrame:
    return classpath.resolve_sources(f.types, f.sources).fillna("", ["path"])


@query
def sources_or_stubs(f: Facts) -> DataFrame:
    """What can be shown of each type, its file or its stub."""
    shown = classpath.source_or_stub(f.types, f.sources, stubs.stubs(f, include_libraries=True))
    return shown.select("fqn", "found", F.md5("text").alias("digest"))


@query
def source_entries(f: Facts) -> DataFrame:
    """The files as entries of an archive for each origin: which holds each type."""
    entries = f.sources.select(F.coalesce("origin", F.lit("")).alias("archive"), F.regexp_replace("path", "^/+", "").alias("entry"))
    return classpath.entry_for_type(classpath.source_listing(entries), f.types)


@query
def classpath_sections(f: Facts) -> DataFrame:
    """The types' locations written as a text with a section for each source, and read again."""
    rows = f.types.where("location is not null").select("source", F.concat_ws("|", "location", "fqn").alias("value"))
    heads = f.types.select("source", F.concat(F.lit("# "), "source").alias("value")).distinct()
    lines = heads.withColumn("ordinal", F.lit("")).unionByName(rows.withColumn("ordinal", F.col("value"))).select(F.col("source").alias("file"), "ordinal", "value")
    found = classpath.parse_sections(lines)
    return found.select("section", F.element_at("fields", 1).alias("location"), F.element_at("fields", 2).alias("fqn"), F.size("fields").alias("parts"))


@query
def jar_coordinates(f: Facts) -> DataFrame:
    """Every second archive, by its name, is given a mapping line; the types in it and in the others get coordinates, and
    the names and texts these are written as."""
    jars = f.types.where("location like '%.jar'").select("location").distinct()
    line = F.concat(F.lit("org.mapped:"), F.substring(F.md5("location"), 1, 8), F.lit(":1.0:extra|"), "location")
    mapping = classpath.mapped_coordinates(jars.where("length(location) % 2 = 0").select(F.col("location").alias("ordinal"), line.alias("value")))
    c = classpath.located_coordinates(f.types, mapping).withColumn("group", F.coalesce("group", F.lit("")))
    return c.select("fqn", "group", "artifact", "version", classpath.artifact_path(F.col("group"), F.col("artifact"), F.col("version")).alias("path"), classpath.jar_name(F.col("artifact"), F.col("version"), "sources").alias("jar"), names.percent_encoded(F.col("fqn")).alias("encoded"), classpath.cacheable_name(F.col("fqn")).alias("cacheable"))


@query
def method_durations(f: Facts) -> DataFrame:
    """The seconds between the first and the last request for methods of each class, as text."""
    asked = f.raw("method_sources").where("requested_at is not null").groupBy("class_fqn").agg((F.unix_seconds(F.max("requested_at")) - F.unix_seconds(F.min("requested_at"))).alias("seconds"))
    return asked.select("class_fqn", names.duration_text(F.col("seconds")).alias("took"), names.timeout_minutes(F.concat(F.col("seconds"), F.lit("h"))).alias("minutes"))


@query
def cache_stats(f: Facts) -> DataFrame:
    return classpath.cache_statistics(f.sources)


@query
def cache_keys(f: Facts) -> DataFrame:
    """The cache key, artifact and version of every jar that types come from."""
    jars = f.types.where("location like '%.jar'").groupBy("location").agg(F.count("*").alias("types"))
    parts = classpath.jar_parts(F.col("location"))
    return jars.select("location", "types", classpath.cache_key(F.col("location")).alias("key"), F.coalesce(parts["artifact"], F.lit("")).alias("artifact"), F.coalesce(parts["version"], F.lit("")).alias("version"))


@query
def classpath_entries(f: Facts) -> DataFrame:
    """The locations of all types as a class path; an entry's place is the least fqn found in it."""
    lines = f.types.where("location is not null").select(F.col("fqn").alias("ordinal"), F.col("location").alias("value"))
    return classpath.parse_classpath_file(lines, "/build")


@query
def types_classified(f: Facts) -> DataFrame:
    found = f.types.select("fqn", "location", classpath.classify(F.col("fqn"), F.col("location"), ("/build/",)).alias("class_source"))
    return found.groupBy("class_source", F.coalesce("location", F.lit("")).alias("location")).agg(F.count("*").alias("n"))


@query
def stubs_java(f: Facts) -> DataFrame:
    return stubs.stubs(f)


@query
def stubs_kotlin(f: Facts) -> DataFrame:
    return stubs.stub_lines(f, language="KOTLIN", visibility="PUBLIC_PROTECTED")


@query
def recipe_endpoints(f: Facts) -> DataFrame:
    return recipes.endpoints(f)


@query
def recipe_stack(f: Facts) -> DataFrame:
    return recipes.stack(f, STACK)


@query
def recipe_antipatterns(f: Facts) -> DataFrame:
    return recipes.calls_by_rules(f, RULES)


@query
def recipe_blocking(f: Facts) -> DataFrame:
    return recipes.blocking_calls(f, PROJECT_RETURNS, "org.")


@query
def recipe_functional_routes(f: Facts) -> DataFrame:
    return recipes.functional_routes(f, PROJECT_RETURNS, ROUTING)


@query
def recipe_self_invocations(f: Facts) -> DataFrame:
    return recipes.self_invocations(f, ANY_ANNOTATION)


@query
def recipe_lambda_strings(f: Facts) -> DataFrame:
    return recipes.string_constants(f, "lambda$")


@query
def recipe_handler_routes(f: Facts) -> DataFrame:
    r = recipes.next_calls(f)
    return r.fillna("", ["impl_method_name", "next_owner", "next_method"])


@query
def recipe_unused(f: Facts) -> DataFrame:
    from ..operators.graph import isolated

    return isolated(f)


@query
def recipe_migration(f: Facts) -> DataFrame:
    """The measures; recipe_migration_order has each type's place too."""
    return recipes.migration_measures(f)


@query
def recipe_migration_order(f: Facts) -> DataFrame:
    return recipes.migration_order(f)


@query
def recipe_trace(f: Facts) -> DataFrame:
    return recipes.call_trace(f, ANY_ANNOTATION, 3)


@query
def recipe_census(f: Facts) -> DataFrame:
    return recipes.census(f, CENSUS)


_FILES = """src AS MATERIALIZED (
  SELECT * FROM sources WHERE path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY origin, module, path ORDER BY fqn DESC NULLS LAST, language DESC NULLS LAST, source_set DESC NULLS LAST, content DESC NULLS LAST) = 1)"""
_LINES = """ln AS MATERIALIZED (
  SELECT {key}, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS line_no, len(parts) AS last_no
  FROM (SELECT {key}, string_split_regex({text}, '\\r\\n|\\n|\\r') AS parts FROM {table} WHERE {text} IS NOT NULL))"""
_LINT = """, prev AS (SELECT *, lag(line) OVER (PARTITION BY {key} ORDER BY line_no) AS before FROM ln),
hits AS (
  SELECT {key}, line_no, 'max-line-length' AS rule, false AS fixable FROM prev WHERE length(line) > 140
  UNION ALL SELECT {key}, line_no, 'no-trailing-spaces', true FROM prev WHERE regexp_matches(line, '[ \\t]$')
  UNION ALL SELECT {key}, line_no, 'no-tabs', true FROM prev WHERE contains(line, chr(9))
  UNION ALL SELECT {key}, line_no, 'no-consecutive-blank-lines', true FROM prev WHERE trim(line) = '' AND trim(before) = '' AND line_no < last_no
  UNION ALL SELECT {key}, line_no, 'no-wildcard-imports', false FROM prev WHERE regexp_matches(line, '^\\s*import\\s+(static\\s+)?[\\w.]+\\.\\*;?\\s*$')
  UNION ALL SELECT {key}, line_no, 'final-newline', true FROM prev WHERE line_no = last_no AND line <> '')"""


def _lint_sql(key: str, column: str, table: str, body: str, files: str = "") -> str:
    return "WITH " + files + _LINES.format(key=key, text=column, table=table) + _LINT.format(key=key) + body


_F = _FILES + ", "
_KOTLIN = "CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in stubs.KOTLIN_NAMES.items()) + " ELSE {c} END"
_KT = lambda c: _KOTLIN.replace("{c}", c)


def _stub_sql(java: bool, where: str, body: str) -> str:
    access = "CASE WHEN visibility IN ('PUBLIC', 'PROTECTED', 'PRIVATE') THEN lower(visibility) || ' ' ELSE '' END" if java else "CASE visibility WHEN 'PUBLIC' THEN '' WHEN 'PACKAGE_PRIVATE' THEN 'internal ' WHEN 'PROTECTED' THEN 'protected ' WHEN 'PRIVATE' THEN 'private ' ELSE '' END"
    third = "WHEN is_final AND NOT is_enum THEN 'final '" if java else "WHEN NOT is_final AND NOT is_interface AND NOT is_abstract THEN 'open '"
    words = ("interface ", "@interface ", "enum ", "class ") if java else ("interface ", "annotation class ", "enum class ", "class ")
    ups = "list_transform(list_filter([superclass], lambda x: x IS NOT NULL AND x NOT IN ('java.lang.Object', 'java.lang.Enum')), lambda x: " + SHORT("x") + ")"
    faces = "list_transform(list_filter(interfaces, lambda x, i: list_position(interfaces, x) = i), lambda x: " + SHORT("x") + ")"
    if java:
        tail = f"CASE WHEN len({ups}) > 0 THEN ' extends ' || array_to_string({ups}, ', ') ELSE '' END || CASE WHEN len({faces}) > 0 THEN CASE WHEN is_interface THEN ' extends ' ELSE ' implements ' END || array_to_string({faces}, ', ') ELSE '' END"
        field = f"'    ' || {SHORT('type_text')} || ' ' || name || ';'"
        maker = "'    ' || simple_name || '(' || params || ') {{ /* ... */ }}'"
        kind = f"SHORT_KIND || ' p' || i"
        method = f"'    ' || {SHORT('type_text')} || ' ' || name || '(' || params || ')' || CASE WHEN is_interface THEN ';' ELSE ' {{ /* ... */ }}' END"
    else:
        tail = f"CASE WHEN len({ups}) + len({faces}) > 0 THEN ' : ' || array_to_string(list_concat({ups}, {faces}), ', ') ELSE '' END"
        field = f"'    val ' || name || ': ' || {_KT(SHORT('type_text'))}"
        maker = "'    constructor(' || params || ')'"
        kind = f"'p' || i || ': ' || {_KT('SHORT_KIND')}"
        method = f"'    ' || CASE WHEN is_open THEN 'open ' ELSE '' END || 'fun ' || name || '(' || params || '): ' || {_KT(SHORT('type_text'))} || CASE WHEN is_interface THEN '' ELSE ' = TODO()' END"
    end = ";" if java else ""
    kind = kind.replace("SHORT_KIND", SHORT("type_fqn"))
    return _sql("t r s m mt", f""", st AS (SELECT * FROM t WHERE {where}),
pa AS (SELECT from_fqn AS fqn, member AS name, string_agg({kind}, ', ' ORDER BY i) AS params FROM (
  SELECT *, row_number() OVER (PARTITION BY from_fqn, member ORDER BY ref_id, type_fqn) - 1 AS i FROM r WHERE kind = 'PARAM' AND member IS NOT NULL) GROUP BY 1, 2),
mm AS (SELECT st.fqn, is_interface, NOT is_final AND NOT is_interface AS is_open, k.kind, k.name, k.type_text, coalesce(params, '') AS params
  FROM (SELECT owner_fqn, 'METHOD' AS kind, name, coalesce(type_text, 'void') AS type_text FROM mt UNION ALL SELECT owner_fqn, kind, name, type_text FROM m WHERE kind = 'FIELD') k
  JOIN st ON st.fqn = k.owner_fqn LEFT JOIN pa ON pa.fqn = k.owner_fqn AND pa.name = k.name
  WHERE NOT contains(k.name, '$') AND k.name NOT IN ('serialVersionUID', '<init>')),
stub AS (
  SELECT fqn, 0 AS section, '' AS ordinal, 'package ' || package_name || '{end}' AS text FROM st WHERE package_name <> ''
  UNION ALL SELECT DISTINCT st.fqn, 1, ann_type, '@' || {SHORT('ann_type')} FROM s JOIN st ON st.fqn = s.owner_fqn WHERE s.target = 'CLASS' AND ann_type IS NOT NULL AND NOT starts_with(ann_type, 'kotlin.')
  UNION ALL SELECT fqn, 2, '', {access} || CASE WHEN is_abstract AND NOT is_interface THEN 'abstract ' {third} ELSE '' END
    || CASE WHEN is_interface THEN '{words[0]}' WHEN is_annotation THEN '{words[1]}' WHEN is_enum THEN '{words[2]}' ELSE '{words[3]}' END || simple_name || {tail} || ' {{' FROM st
  UNION ALL SELECT fqn, 3, name || ' ' || type_text, {field} FROM mm WHERE kind = 'FIELD'
  UNION ALL SELECT st.fqn, 4, '', {maker} FROM pa JOIN st ON st.fqn = pa.fqn WHERE name = '<init>'
  UNION ALL SELECT fqn, 5, name || ' ' || type_text, {method} FROM mm WHERE kind = 'METHOD'
  UNION ALL SELECT fqn, 6, '', '}}' FROM st)
""" + body)


SQL = {
    "lint_findings": _lint_sql("path", "content", "src", " SELECT DISTINCT * FROM hits", _F),
    "lint_rollup": _lint_sql("path", "content", "src", " SELECT path, count(*) AS errors, count(*) FILTER (fixable) AS fixable FROM (SELECT DISTINCT * FROM hits) GROUP BY 1", _F),
    "lint_summary": _lint_sql("path", "content", "src", " SELECT (SELECT count(*) FROM src WHERE content IS NOT NULL) AS files, count(DISTINCT path) AS files_with_errors, count(*) AS errors FROM (SELECT DISTINCT * FROM hits)", _F),
    "format_files": "WITH " + _F + """made AS (SELECT path, content, CASE WHEN t = '' THEN t ELSE t || chr(10) END AS new FROM (
  SELECT path, content, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(content, '\\r\\n|\\r', chr(10), 'g'), chr(9), '    '), '(?m)[ ]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '\\n+$', '') AS t FROM src WHERE content IS NOT NULL))
SELECT path, new <> content AS changed, md5(new) AS digest, len(list_filter(string_split(new, chr(10)), lambda x: length(x) > 140 OR regexp_matches(x, '[ \\t]$')))::INT
  + len(list_filter(string_split(new, chr(10)), lambda x: regexp_matches(x, '^\\s*import\\s+(static\\s+)?[\\w.]+\\.\\*;?\\s*$')))::INT AS remaining FROM made""",
    "lint_documents": _lint_sql("doc_id", "text", "documents", " SELECT rule, count(*) AS n FROM (SELECT DISTINCT * FROM hits) GROUP BY 1"),
    "source_docs": "WITH " + _FILES + " SELECT path, contains(content, '/**') AS documented, len(string_split_regex(content, '\\r\\n|\\n|\\r')) AS lines FROM src WHERE content IS NOT NULL",
    "source_declarations": _sql("r c", ", " + _F + _LINES.format(key="path, fqn", text="content", table="src") + """, places AS (
  SELECT DISTINCT path, line_no AS at FROM ln WHERE line_no % 10 = 0 OR EXISTS (SELECT 1 FROM r WHERE from_fqn = ln.fqn AND line_number = line_no) OR EXISTS (SELECT 1 FROM c WHERE caller_fqn = ln.fqn AND line_number = line_no)
), marked AS (SELECT path, line_no, trim(line, ' ' || chr(9)) AS s FROM ln)
SELECT p.path, p.at, coalesce(max(a.line_no) FILTER (
    (contains(s, '(') AND CASE WHEN regexp_matches(lower(p.path), '\\.kts?$') THEN contains(s, 'fun ') ELSE regexp_matches(s, '(void|public|private|protected|static|final|abstract) ') END)
    OR (starts_with(s, '@') AND a.line_no < p.at)), p.at) AS start
FROM places p LEFT JOIN marked a ON a.path = p.path AND a.line_no BETWEEN p.at - 10 AND p.at GROUP BY 1, 2"""),
    "source_entries": _sql("t", ", " + _FILES + """, en AS (SELECT coalesce(origin, '') AS archive, regexp_replace(path, '^/+', '') AS entry FROM src WHERE (ends_with(path, '.java') OR ends_with(path, '.kt')) AND NOT regexp_matches(path, '(^|[/\\\\])\\.\\.([/\\\\]|$)')
), w AS (SELECT fqn, replace(unnest([fqn || '.java', fqn || '.kt', split_part(fqn, '$', 1) || '.java', split_part(fqn, '$', 1) || '.kt']), '.', '/') AS slashed, unnest([0, 1, 2, 3]) AS rank FROM t
), w2 AS (SELECT fqn, rank, regexp_replace(slashed, '/(java|kt)$', '.\\1') AS tail FROM w
), tails AS (SELECT archive, entry, array_to_string(list_slice(string_split(entry, '/'), i, len(string_split(entry, '/'))), '/') AS tail FROM (SELECT archive, entry, unnest(range(1, len(string_split(entry, '/')) + 1)) AS i FROM en))
SELECT fqn, archive, entry FROM w2 JOIN tails USING (tail) QUALIFY row_number() OVER (PARTITION BY fqn ORDER BY rank, archive, entry) = 1"""),
    "classpath_sections": _sql("t", " SELECT source AS section, location, fqn, 2 AS parts FROM t WHERE location IS NOT NULL"),
    "jar_coordinates": _sql("t", """ SELECT fqn, "group", artifact, version, concat_ws('/', replace("group", '.', '/'), artifact, version) AS path, artifact || '-' || version || '-sources.jar' AS jar,
  replace(fqn, '$', '%24') AS encoded, regexp_full_match(fqn, '[a-zA-Z0-9._$]+') AND NOT contains(fqn, '..') AS cacheable FROM (
  SELECT fqn, CASE WHEN mapped THEN 'org.mapped' ELSE '' END AS "group",
    CASE WHEN mapped THEN left(md5(location), 8) ELSE nullif(regexp_extract(location, '([^/]+)-(\\d[^/-]*)\\.jar$', 1), '') END AS artifact,
    CASE WHEN mapped THEN '1.0' ELSE nullif(regexp_extract(location, '([^/]+)-(\\d[^/-]*)\\.jar$', 2), '') END AS version
  FROM (SELECT fqn, location, length(location) % 2 = 0 AND location LIKE '%.jar' AS mapped FROM t WHERE location IS NOT NULL)) WHERE artifact IS NOT NULL"""),
    "method_durations": """SELECT class_fqn, CASE WHEN s >= 3600 THEN format('{}h {}m {}s', s // 3600, s % 3600 // 60, s % 60) WHEN s >= 60 THEN format('{}m {}s', s // 60, s % 60) ELSE format('{}s', s) END AS took,
  (CASE WHEN s < 10000000 THEN s * 60 ELSE 30 END)::INT AS minutes
FROM (SELECT class_fqn, epoch(date_trunc('second', max(requested_at)))::BIGINT - epoch(date_trunc('second', min(requested_at)))::BIGINT AS s FROM method_sources WHERE requested_at IS NOT NULL GROUP BY 1)""",
    "sources_resolved": _sql("t", ", " + _FILES + """, best AS (
  SELECT fqn AS outer_fqn, path, coalesce(origin, '') AS origin FROM src WHERE content IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY fqn ORDER BY coalesce(source_set, '') <> 'main', coalesce(list_position(['PROJECT_SOURCE', 'SOURCE_JAR', 'JDK_SOURCE', 'DECOMPILED'], origin), 5), NOT ends_with(path, '.java'), coalesce(module, ''), path) = 1)
SELECT t.fqn, coalesce(path, '') AS path, coalesce(origin, 'SOURCE_NOT_FOUND') AS found FROM t LEFT JOIN best ON outer_fqn = split_part(t.fqn, '$', 1)"""),
    "cache_stats": "WITH " + _FILES + " SELECT coalesce(origin, 'UNKNOWN') AS origin, count(*) AS files, coalesce(sum(length(content)), 0)::BIGINT AS chars FROM src GROUP BY 1",
    "cache_keys": _sql("t", """ SELECT location, count(*) AS types, left(sha256(location), 16) AS key,
  regexp_extract(location, '([^/]+)-(\\d[^/-]*)\\.jar$', 1) AS artifact, regexp_extract(location, '([^/]+)-(\\d[^/-]*)\\.jar$', 2) AS version FROM t WHERE location LIKE '%.jar' GROUP BY location"""),
    "classpath_entries": _sql("t", """ SELECT min(fqn) AS ordinal, trim(location) AS path, CASE WHEN ends_with(trim(location), '.jar') THEN 'JAR' ELSE 'DIRECTORY' END AS kind,
  starts_with(trim(location), '/build') AND contains(trim(location), '/build/') AS is_project_output FROM t WHERE trim(location) <> '' AND NOT starts_with(trim(location), '#') GROUP BY trim(location)"""),
    "types_classified": _sql("t", """ SELECT CASE WHEN location IS NULL THEN 'LIBRARY' WHEN starts_with(location, '/build/') THEN 'PROJECT'
  WHEN regexp_matches(fqn, '^(java|javax|jdk|sun|com\\.sun|org\\.w3c\\.dom|org\\.xml\\.sax|org\\.ietf\\.jgss)\\.') OR starts_with(location, '/opt/java') THEN 'JDK' ELSE 'LIBRARY' END AS class_source,
  coalesce(location, '') AS location, count(*) AS n FROM t GROUP BY 1, 2"""),
    "stubs_java": _stub_sql(True, "source = 'PROJECT'", "SELECT fqn, string_agg(text, chr(10) ORDER BY section, ordinal) AS text FROM stub GROUP BY fqn"),
    "stubs_kotlin": _stub_sql(False, "source = 'PROJECT' AND visibility IN ('PUBLIC', 'PROTECTED')", "SELECT * FROM stub"),
    "recipe_endpoints": VALUES_CTE + ", " + _sql("s r m", """, txt AS (
  SELECT site_id, coalesce(js ->> '$.path.value', js ->> '$.path.items[0].value', js ->> '$.value.value', js ->> '$.value.items[0].value') AS text, coalesce(js ->> '$.method.value', js ->> '$.method.items[0].value') AS asked FROM good
), base AS (
  SELECT owner_fqn, min(text) AS base FROM s LEFT JOIN txt USING (site_id) WHERE target = 'CLASS' AND ends_with(ann_type, 'Mapping') GROUP BY 1
), own AS (
  SELECT site_id, owner_fqn, member, upper(regexp_extract(ann_type, '(Get|Post|Put|Delete|Patch)Mapping$', 1)) AS verb, asked, coalesce(returns, '') AS returns,
    regexp_replace(coalesce(base, ''), '/$', '') || CASE WHEN coalesce(text, '') <> '' THEN '/' || regexp_replace(text, '^/', '') ELSE '' END AS path
  FROM s LEFT JOIN txt USING (site_id) LEFT JOIN base USING (owner_fqn)
    LEFT JOIN (SELECT owner_fqn AS o, name, min(type_text) AS returns FROM m WHERE kind = 'METHOD' GROUP BY 1, 2) ret ON o = owner_fqn AND name = member WHERE target = 'METHOD' AND ends_with(ann_type, 'Mapping'))
SELECT site_id, owner_fqn AS class_fqn, member AS method_name, CASE WHEN verb <> '' THEN verb WHEN asked <> '' THEN upper(asked) ELSE 'ANY' END AS verb, CASE path WHEN '' THEN '(no path)' ELSE path END AS path, returns,
  contains(returns, 'reactor.core.publisher.') OR contains(returns, 'org.reactivestreams.Publisher') AS reactive FROM own""").removeprefix("WITH RECURSIVE "),
    "recipe_stack": _sql("r", ", p(name, prefix) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in STACK.items()) + ") SELECT name, (SELECT count(DISTINCT type_fqn) FROM r WHERE starts_with(type_fqn, prefix)) AS types FROM p"),
    "recipe_antipatterns": _sql("c", ", p(rule, severity, prefix, method) AS (VALUES " + ", ".join(str(x) for x in RULES) + ") SELECT rule, severity, caller_fqn, caller_method, call_id FROM c JOIN p ON starts_with(owner_type, prefix) AND (method = '' OR method = method_name)"),
    "recipe_blocking": _sql("r m c", " SELECT call_id, caller_fqn, caller_method, owner_type, method_name FROM c WHERE starts_with(owner_type, 'org.') AND EXISTS (SELECT 1 FROM m WHERE kind = 'METHOD' AND contains(type_text, 'com.vetchway.') AND m.owner_fqn = c.caller_fqn AND m.name = c.caller_method)"),
    "recipe_functional_routes": _sql("r m c", f""" SELECT call_id, caller_fqn, caller_method, call_idx, coalesce(method_name, '') AS method_name, coalesce(impl_method_name, '') AS handler,
  coalesce(array_to_string(list_transform(list_filter(constant_args, lambda a: a.kind = 'STRING'), lambda a: coalesce(a.value, '')), ','), '') AS strings
FROM c WHERE (method_name IN {ROUTING} OR invoke_dynamic) AND EXISTS (SELECT 1 FROM m WHERE kind = 'METHOD' AND contains(type_text, '{PROJECT_RETURNS}') AND m.owner_fqn = c.caller_fqn AND m.name = c.caller_method)"""),
    "recipe_self_invocations": _sql("s c", " SELECT call_id, caller_fqn, caller_method, method_name FROM c WHERE owner_type = caller_fqn AND method_name <> '<init>' AND EXISTS (SELECT 1 FROM s WHERE starts_with(ann_type, 'org.tarnfell.') AND s.owner_fqn = c.owner_type AND (target = 'CLASS' OR (target = 'METHOD' AND s.member = c.method_name)))"),
    "recipe_lambda_strings": _sql("c", " SELECT * FROM (SELECT call_id, caller_fqn, array_to_string(list_transform(list_filter(constant_args, lambda a: a.kind = 'STRING'), lambda a: a.value), '|') AS strings FROM c WHERE starts_with(method_name, 'lambda$')) WHERE strings <> ''"),
    "recipe_handler_routes": _sql("c", """, n AS (SELECT *, lead(owner_type) OVER w AS no, lead(method_name) OVER w AS nm FROM c WHERE caller_method IS NOT NULL WINDOW w AS (PARTITION BY caller_fqn, caller_method ORDER BY call_idx, call_id))
SELECT call_id, coalesce(impl_method_name, '') AS impl_method_name, coalesce(no, '') AS next_owner, coalesce(nm, '') AS next_method FROM n WHERE invoke_dynamic"""),
    "recipe_unused": _sql("t r e g", " SELECT fqn FROM t WHERE source = 'PROJECT' AND fqn NOT IN (SELECT target FROM g)"),
    "recipe_migration": _sql("t r s m mt mc e g", """ SELECT *, CASE WHEN size <= 10 THEN 'LOW' WHEN size <= 30 THEN 'MEDIUM' ELSE 'HIGH' END AS size_bucket, CASE WHEN dependencies <= 3 THEN 'LOW' WHEN dependencies <= 8 THEN 'MEDIUM' ELSE 'HIGH' END AS dependency_bucket
FROM (SELECT t.fqn, (SELECT count(*) FROM g WHERE g.target = t.fqn) AS dependents, (SELECT count(*) FROM g WHERE g.source = t.fqn) AS dependencies, coalesce(method_count + field_count, 0) AS size FROM t LEFT JOIN mc USING (fqn) WHERE source = 'PROJECT')"""),
    "recipe_trace": _sql("t s c se", f""", faces(target, fqn) AS (
  SELECT super, sub FROM se WHERE super IN (SELECT fqn FROM t WHERE is_interface) UNION SELECT a.target, se.sub FROM faces a JOIN se ON se.super = a.fqn
), d AS (SELECT DISTINCT caller_fqn || '#' || caller_method AS src, owner_type, method_name FROM c WHERE caller_method IS NOT NULL AND owner_type IS NOT NULL AND method_name IS NOT NULL
), ed AS (SELECT DISTINCT * FROM (SELECT src, owner_type || '#' || method_name AS dst FROM d UNION ALL SELECT src, faces.fqn || '#' || method_name FROM d JOIN faces ON faces.target = owner_type AND faces.fqn <> faces.target) WHERE src <> dst
), st AS (SELECT DISTINCT owner_fqn || '#' || member AS start FROM s WHERE target = 'METHOD' AND starts_with(ann_type, 'org.tarnfell.') AND member IS NOT NULL
), one AS (SELECT DISTINCT start, dst AS fqn FROM st JOIN ed ON ed.src = start
), two AS (SELECT DISTINCT start, dst AS fqn FROM one JOIN ed ON ed.src = one.fqn
), three AS (SELECT DISTINCT start, dst AS fqn FROM two JOIN ed ON ed.src = two.fqn)
SELECT start, fqn, min(depth) AS depth FROM (SELECT start, fqn, 1 AS depth FROM one UNION ALL SELECT start, fqn, 2 FROM two UNION ALL SELECT start, fqn, 3 FROM three) WHERE start <> fqn GROUP BY 1, 2"""),
    "recipe_census": _sql("r", " SELECT type_fqn, kind, count(*) AS n FROM r WHERE type_fqn IN (" + ", ".join(f"'{x}'" for x in CENSUS) + ") GROUP BY 1, 2"),
}

SQL["recipe_migration_order"] = "SELECT *, row_number() OVER (ORDER BY dependencies, dependents DESC, fqn) AS place FROM (" + SQL["recipe_migration"] + ")"

_RESOLVED = SQL["sources_resolved"].split("SELECT t.fqn, coalesce(path")[0].removeprefix("WITH RECURSIVE ")
SQL["sources_or_stubs"] = _stub_sql(True, "true", "").rstrip() + ", " + _RESOLVED.split("WHERE rn = 1), ", 1)[1] + """
, texts AS (SELECT fqn, string_agg(text, chr(10) ORDER BY section, ordinal) AS text FROM stub GROUP BY fqn)
SELECT t.fqn, CASE WHEN best.path IS NULL THEN 'STUB' ELSE best.origin END AS found, md5(coalesce(src.content, texts.text)) AS digest
FROM t LEFT JOIN best ON outer_fqn = split_part(t.fqn, '$', 1) LEFT JOIN src ON src.path = best.path AND src.fqn = outer_fqn LEFT JOIN texts ON texts.fqn = t.fqn"""
