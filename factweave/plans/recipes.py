"""Recipes: compositions of the operators that answer broader questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import returns_match
from ..operators import calls, catalog, graph, nested, paging, usages
from ..session import cut
from ..sources.facts import Facts


def first_values(facts: Facts, names: tuple[str, ...]) -> DataFrame:
    """(site_id, text): the first text of an attribute, of the names in order; of an array its first element."""
    v = nested.flatten_values(facts.raw("annotation_sites")).where("value is not null")
    rank = F.lit(None).cast("int")
    for i, n in enumerate(names):
        rank = F.coalesce(rank, F.when(F.col("path").isin(n, f"{n}[0]"), i))
    return v.withColumn("rank", rank).where("rank is not null").groupBy("site_id").agg(F.min_by("value", F.struct("rank", "path")).alias("text"))


#: The verbs that annotations of endpoints are named after, and return types that mean a reactive one.
VERBS = ("Get", "Post", "Put", "Delete", "Patch")
REACTIVE = ("reactor.core.publisher.", "org.reactivestreams.Publisher")


def endpoints(facts: Facts, suffix: str = "Mapping") -> DataFrame:
    """(site_id, class_fqn, method_name, verb, path, returns, reactive): methods with a mapping annotation, their class's
    base path (the least, if it has several) and their own joined by one slash. The verb is that of the annotation's name,
    else the first value of its `method`, else ANY; `returns` is the method's return type (the least), '' if unknown."""
    sites = facts.sites.where(F.endswith("ann_type", F.lit(suffix))).join(first_values(facts, ("path", "value")), "site_id", "left")
    base = sites.where("target = 'CLASS'").groupBy("owner_fqn").agg(F.min("text").alias("base"))
    asked = first_values(facts, ("method",)).withColumnRenamed("text", "asked")
    named = F.upper(F.regexp_extract("ann_type", rf"({'|'.join(VERBS)}){suffix}$", 1))
    verb = F.when(named != "", named).otherwise(F.coalesce(F.when(F.col("asked") != "", F.upper("asked")), F.lit("ANY")))
    returns = facts.members.where("kind = 'METHOD'").groupBy("owner_fqn", F.col("name").alias("member")).agg(F.min("type_text").alias("returns"))
    own = sites.where("target = 'METHOD'").join(base, "owner_fqn", "left").join(asked, "site_id", "left").join(returns, ["owner_fqn", "member"], "left").fillna("", ["returns"])
    reactive = F.lit(False)
    for r in REACTIVE:
        reactive = reactive | F.contains("returns", F.lit(r))
    path = F.concat(F.regexp_replace(F.coalesce("base", F.lit("")), "/$", ""), F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit("/"), F.regexp_replace("text", "^/", ""))).otherwise(""))
    return own.select("site_id", F.col("owner_fqn").alias("class_fqn"), F.col("member").alias("method_name"), verb.alias("verb"), F.when(path == "", "(no path)").otherwise(path).alias("path"), "returns", reactive.alias("reactive"))


def functional_routes(facts: Facts, returning: str, names: tuple[str, ...]) -> DataFrame:
    """(call_id, caller_fqn, caller_method, call_idx, method_name, handler, strings): the calls by which methods that return
    the router's type put routes together, in order: those named like a verb, with their texts, and dynamic ones, with the
    handler they stand for."""
    c = calls.calls_in(facts, in_methods_returning=returning).where(F.col("method_name").isin(*names) | F.col("invoke_dynamic"))
    texts = F.transform(F.filter("constant_args", lambda a: a["kind"] == "STRING"), lambda a: F.coalesce(a["value"], F.lit("")))
    return c.select("call_id", "caller_fqn", "caller_method", "call_idx", F.coalesce("method_name", F.lit("")).alias("method_name"), F.coalesce("impl_method_name", F.lit("")).alias("handler"), F.coalesce(F.array_join(texts, ","), F.lit("")).alias("strings"))


def stack(facts: Facts, prefixes: dict[str, str]) -> DataFrame:
    """(name, types): how many different types of each technology the code refers to, by name prefix; absent ones 0."""
    rows = facts.spark.createDataFrame(sorted(prefixes.items()), "name string, prefix string")
    seen = facts.refs.select("type_fqn").distinct()
    # a handful of prefixes: the table is as small as the question
    hits = seen.join(F.broadcast(rows), F.expr("startswith(type_fqn, prefix)")).groupBy("name").agg(F.count("*").alias("types"))
    return rows.select("name").join(hits, "name", "left").fillna(0, ["types"])


def calls_by_rules(facts: Facts, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """(rule, severity, caller_fqn, caller_method, call_id): calls that a rule (name, severity, owner prefix, method)
    describes; an empty method stands for any."""
    table = facts.spark.createDataFrame(rules, "rule string, severity string, prefix string, method string")
    hit = F.expr("startswith(owner_type, prefix) and (method = '' or method = method_name)")
    return facts.calls.join(F.broadcast(table), hit).select("rule", "severity", "caller_fqn", "caller_method", "call_id")


def blocking_calls(facts: Facts, returning: str, owners: str) -> DataFrame:
    """Calls on owners with the prefix in methods that return the type."""
    c = calls.calls_in(facts, in_methods_returning=returning)
    return c.where(F.startswith("owner_type", F.lit(owners))).select("call_id", "caller_fqn", "caller_method", "owner_type", "method_name")


def self_invocations(facts: Facts, annotation: str) -> DataFrame:
    """Calls within one class of a method that carries the annotation (a name or pattern), itself or by its class, which a
    proxy doesn't see; constructors aren't meant."""
    own = facts.calls.where("owner_type = caller_fqn and method_name <> '<init>'").select("call_id", "caller_fqn", "caller_method", "method_name")
    sites = usages.sites_with(facts, annotation, ("METHOD", "CLASS"))
    methods = sites.where("target = 'METHOD'").select(F.col("owner_fqn").alias("caller_fqn"), F.col("member").alias("method_name"))
    classes = sites.where("target = 'CLASS'").select(F.col("owner_fqn").alias("caller_fqn"))
    return own.join(methods, ["caller_fqn", "method_name"], "left_semi").unionByName(own.join(classes, "caller_fqn", "left_semi")).distinct()


def string_constants(facts: Facts, method_prefix: str) -> DataFrame:
    """(call_id, strings): the text constants of calls to methods with the prefix, as lambda bodies have."""
    texts = F.transform(F.filter("constant_args", lambda a: a["kind"] == "STRING"), lambda a: a["value"])
    return facts.calls.where(F.startswith("method_name", F.lit(method_prefix))).select("call_id", "caller_fqn", F.coalesce(F.array_join(texts, "|"), F.lit("")).alias("strings")).where("strings <> ''")


def next_calls(facts: Facts) -> DataFrame:
    """(call_id, impl_method_name, next_owner, next_method): every dynamic call with the call after it in its method, as
    handlers stand before the route they are given to."""
    order = Window.partitionBy("caller_fqn", "caller_method").orderBy("call_idx", "call_id")
    c = facts.calls.where("caller_method is not null").withColumn("next_owner", F.lead("owner_type").over(order)).withColumn("next_method", F.lead("method_name").over(order))
    return c.where("invoke_dynamic").select("call_id", "impl_method_name", "next_owner", "next_method")


def migration_measures(facts: Facts) -> DataFrame:
    """(fqn, dependents, dependencies, size, size_bucket, dependency_bucket): project types with the measures that decide
    when to move them."""
    nodes = graph.graph_nodes(facts).select("fqn", F.col("in_degree").alias("dependents"), F.col("out_degree").alias("dependencies"))
    counts = catalog.member_counts(facts).select("fqn", (F.col("method_count") + F.col("field_count")).alias("size"))
    n = nodes.join(counts, "fqn", "left").fillna(0, ["size"])
    bucket = lambda c, steps: F.when(F.col(c) <= steps[0], "LOW").when(F.col(c) <= steps[1], "MEDIUM").otherwise("HIGH")
    return n.withColumn("size_bucket", bucket("size", (10, 30))).withColumn("dependency_bucket", bucket("dependencies", (3, 8)))


def migration_order(facts: Facts) -> DataFrame:
    """The measures with `place`, from 1: types that depend on the least come first, of equals the most depended on."""
    return paging.number_rows(migration_measures(facts), [F.col("dependencies"), F.col("dependents").desc(), F.col("fqn")], "place")


def call_trace(facts: Facts, annotation: str, depth: int = 3) -> DataFrame:
    """(start, fqn, depth): methods (`type#method`) that methods with the annotation reach by calls within so many steps;
    a call on an interface goes on in the project types that implement it."""
    noted = usages.sites_with(facts, annotation, ("METHOD",)).where("member is not null")
    start = noted.select(F.concat_ws("#", "owner_fqn", "member").alias("start")).distinct()
    direct = facts.calls.where("caller_method is not null and owner_type is not null and method_name is not null").select(F.concat_ws("#", "caller_fqn", "caller_method").alias("src"), "owner_type", "method_name").distinct()
    faces = facts.types.where("is_interface").select(F.col("fqn").alias("target"))
    inside = graph.implementations(facts, faces).select(F.col("target").alias("owner_type"), F.col("fqn").alias("impl"))
    through = direct.join(inside, "owner_type").select("src", F.concat_ws("#", "impl", "method_name").alias("dst"))
    edges = direct.select("src", F.concat_ws("#", "owner_type", "method_name").alias("dst")).union(through)
    return graph.closure(cut(edges.where("src <> dst")), start, depth)


def census(facts: Facts, types: list[str]) -> DataFrame:
    """(type_fqn, kind, n): references to each of a list of types, from one pass."""
    wanted = facts.spark.createDataFrame([(t,) for t in types], "type_fqn string")
    return facts.refs.join(F.broadcast(wanted), "type_fqn").groupBy("type_fqn", "kind").agg(F.count("*").alias("n"))


def methods_returning(facts: Facts, wanted: str) -> DataFrame:
    return facts.members.where(F.col("kind") == "METHOD").where(returns_match(F.col("type_text"), wanted))
