"""Inverse references: who refers to a type, and how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import package_of
from ..sources.facts import REFERENCE_KINDS, Facts, ordinal
from .graph import implementations


def references(facts: Facts, include_libraries: bool = False) -> DataFrame:
    """(type_fqn, from_fqn, kind, member, detail, line): all references between different types. Supertypes and their
    arguments count once per class, fields, returns and parameters as recorded, annotations once per member (not on
    parameters), constructor calls as INSTANTIATION, other calls that aren't dynamic as CALL_RECEIVER. Only from
    project types unless libraries are included; calls always only from those."""
    t = facts.types
    none, no_line = F.lit(None).cast("string"), F.lit(None).cast("int")
    row = lambda df, target, source, kind, member, detail, line: df.select(target.alias("type_fqn"), source.alias("from_fqn"), kind.alias("kind"), member.alias("member"), detail.alias("detail"), line.alias("line"))
    ups = F.array_distinct(F.filter(F.concat(F.array("superclass"), "superclass_args"), lambda x: x.isNotNull()))
    ext = row(t.select("fqn", F.explode(ups).alias("x")), F.col("x"), F.col("fqn"), F.lit("EXTENDS"), none, none, no_line)
    faces = F.array_distinct(F.concat("interfaces", "interface_args"))
    imp = row(t.select("fqn", F.explode(faces).alias("x")), F.col("x"), F.col("fqn"), F.lit("IMPLEMENTS"), none, none, no_line)
    r = facts.refs.where(F.col("kind").isin("FIELD", "RETURN", "PARAM"))
    sig = row(r, F.col("type_fqn"), F.col("from_fqn"), F.col("kind"), F.col("member"), F.when(F.col("kind") == "FIELD", F.col("detail")), no_line)
    member = F.when(F.col("target") == "FIELD", F.col("field")).when(F.col("target") == "CONSTRUCTOR", "<init>").otherwise(F.col("member"))
    ann = facts.sites.where("target <> 'PARAMETER' and ann_type is not null").select("owner_fqn", "ann_type", member.alias("m"), F.col("descriptor").alias("d")).distinct()
    notes = row(ann, F.col("ann_type"), F.col("owner_fqn"), F.lit("ANNOTATION"), F.col("m"), none, no_line)
    project = t.where("source = 'PROJECT'").select("fqn")
    c = facts.calls.where("not invoke_dynamic and owner_type is not null and method_name is not null").join(project.select(F.col("fqn").alias("caller_fqn")), "caller_fqn", "left_semi")
    new = F.col("method_name") == "<init>"
    body = row(c, F.col("owner_type"), F.col("caller_fqn"), F.when(new, "INSTANTIATION").otherwise("CALL_RECEIVER"), F.col("caller_method"), F.when(~new, F.col("method_name")), F.col("line_number"))
    named = ext.unionByName(imp).unionByName(sig).unionByName(notes)
    if not include_libraries:
        named = named.join(project.select(F.col("fqn").alias("from_fqn")), "from_fqn", "left_semi")
    return named.unionByName(body).where("type_fqn <> from_fqn")


def xref(facts: Facts, target: str | None = None, *, kind: str | None = None, scope_implementing: str | None = None, include_libraries: bool = False) -> DataFrame:
    """The references to a type (or to all), by kind, only from types that implement another if asked for."""
    if kind and kind not in REFERENCE_KINDS:
        raise ValueError(f"kind must be one of {', '.join(REFERENCE_KINDS)}")
    found = references(facts, include_libraries)
    if target:
        found = found.where(F.col("type_fqn") == target)
    if kind:
        found = found.where(F.col("kind") == kind)
    if scope_implementing:
        scope = facts.spark.createDataFrame([(scope_implementing,)], "target string")
        found = found.join(implementations(facts, scope, include_libraries).select(F.col("fqn").alias("from_fqn")), "from_fqn", "left_semi")
    return found


def counts_by_kind(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").alias("n"))


def counts_by_package(found: DataFrame) -> DataFrame:
    """By the referring type's package, '' for none."""
    return found.groupBy(package_of(F.col("from_fqn")).alias("package")).agg(F.count("*").alias("n"))


def reference_order() -> list[Column]:
    return [F.col("from_fqn"), ordinal(F.col("kind"), REFERENCE_KINDS), F.coalesce("member", F.lit("")), F.coalesce("line", F.lit(-1)), F.coalesce("detail", F.lit(""))]
