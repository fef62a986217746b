"""Lists of types and methods, point lookups and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import glob, returns_match
from ..sources.facts import Facts
from .usages import sites_with

_FLAGS = ("is_interface", "is_abstract", "is_enum", "is_annotation")


def member_counts(facts: Facts) -> DataFrame:
    """(fqn, method_count, field_count) of types that have any: the different names of methods and fields that facts name
    (see `Facts.methods`), since no table lists members; overloads count once."""
    fields = facts.members.where("kind = 'FIELD'").select("owner_fqn", F.lit("FIELD").alias("kind"), "name")
    noted = facts.sites.where("target = 'FIELD' and field is not null").select("owner_fqn", F.lit("FIELD").alias("kind"), F.col("field").alias("name"))
    names = facts.methods.select("owner_fqn", F.lit("METHOD").alias("kind"), "name").unionByName(fields).unionByName(noted).distinct()
    return names.groupBy(F.col("owner_fqn").alias("fqn")).agg(F.count_if(F.col("kind") == "METHOD").alias("method_count"), F.count_if(F.col("kind") == "FIELD").alias("field_count"))


def select_types(facts: Facts, *, package: str | None = None, name: str | None = None, annotation: str | None = None, extends: str | None = None, implements: str | None = None, source: str | None = None, interfaces_only: bool = False, classes_only: bool = False, include_libraries: bool = False, strict: bool = True) -> DataFrame:
    """The types that meet every filter given: globs on package and on simple or full name, a class annotation (itself or
    as a meta-annotation), the direct superclass, a direct interface. Only project types unless a source is named or
    libraries are included."""
    t = facts.types
    if source or not include_libraries:
        t = t.where(F.col("source") == (source or "PROJECT"))
    if interfaces_only:
        t = t.where("is_interface")
    if classes_only:
        t = t.where("not is_interface")
    if package:
        t = t.where(glob(F.col("package_name"), package, strict))
    if name:
        t = t.where(glob(F.col("simple_name"), name, strict) | glob(F.col("fqn"), name, strict))
    if extends:
        t = t.where(F.col("superclass") == extends)
    if implements:
        t = t.where(F.array_contains("interfaces", implements))
    if annotation:
        on = sites_with(facts, annotation, ("CLASS",)).select(F.col("owner_fqn").alias("fqn"))
        t = t.join(on, "fqn", "left_semi")
    return t


def list_classes(facts: Facts, **filters) -> DataFrame:
    """Summaries in order of fqn."""
    t = select_types(facts, **filters).select("fqn", "simple_name", "package_name", "source", "visibility", *_FLAGS)
    return t.join(member_counts(facts), "fqn", "left").fillna(0, ["method_count", "field_count"]).orderBy("fqn")


def class_detail(facts: Facts, fqns: DataFrame | None = None, fqn: str | None = None) -> DataFrame:
    """The types asked for (one, or a DataFrame of fqn), each with its annotations and members as sorted arrays.
    A name without a row gives none."""
    t = facts.types
    t = t.where(F.col("fqn") == fqn) if fqn else t.join(fqns.select("fqn"), "fqn", "left_semi") if fqns is not None else t
    notes = facts.sites.where("target = 'CLASS'").groupBy(F.col("owner_fqn").alias("fqn")).agg(F.array_sort(F.collect_set("ann_type")).alias("annotations"))
    members = facts.members.groupBy(F.col("owner_fqn").alias("fqn")).agg(F.array_sort(F.collect_set(F.struct("kind", "name", "type_text"))).alias("members"))
    return t.join(notes, "fqn", "left").join(members, "fqn", "left")


def class_kind() -> Column:
    """The label of a type: interface before annotation, enum, abstract and class."""
    return F.when(F.col("is_interface"), "interface").when(F.col("is_annotation"), "annotation").when(F.col("is_enum"), "enum").when(F.col("is_abstract"), "abstract").otherwise("class")


def statistics(facts: Facts) -> DataFrame:
    """One row: types by source, kinds of project types, and the methods and fields of project types."""
    project = F.col("source") == "PROJECT"
    t = facts.types.join(member_counts(facts), "fqn", "left")
    return t.agg(
        F.count_if(project).alias("project_classes"),
        F.count_if(F.col("source") == "LIBRARY").alias("library_classes"),
        F.count_if(F.col("source") == "JDK").alias("jdk_classes"),
        F.count_if(project & F.col("is_interface")).alias("interfaces"),
        F.count_if(project & F.col("is_abstract") & ~F.col("is_interface")).alias("abstract_classes"),
        F.count_if(project & F.col("is_enum")).alias("enums"),
        F.count_if(project & F.col("is_annotation")).alias("annotations"),
        F.coalesce(F.sum(F.when(project, F.col("method_count"))), F.lit(0)).alias("methods"),
        F.coalesce(F.sum(F.when(project, F.col("field_count"))), F.lit(0)).alias("fields"),
    )


def search_methods(facts: Facts, *, name: str | None = None, return_type: str | None = None, annotation: str | None = None, in_class: str | None = None, in_package: str | None = None, include_libraries: bool = False, strict: bool = True) -> DataFrame:
    """Methods of the types asked for, in total order, '' where the return type isn't known; constructors and what
    compilers add never match, a return type matches if its base contains the text, primitives and void never do."""
    t = facts.types
    if not include_libraries:
        t = t.where("source = 'PROJECT'")
    if in_class:
        t = t.where(F.col("fqn") == in_class)
    if in_package:
        t = t.where(glob(F.col("package_name"), in_package, strict))
    m = facts.methods
    if name:
        m = m.where(glob(F.col("name"), name, strict))
    if return_type:
        m = m.where(returns_match(F.col("type_text"), return_type))
    if annotation:
        on = sites_with(facts, annotation, ("METHOD",)).select("owner_fqn", F.col("member").alias("name"))
        m = m.join(on, ["owner_fqn", "name"], "left_semi")
    found = m.join(t.select(F.col("fqn").alias("owner_fqn"), "source"), "owner_fqn")
    return found.select(F.col("owner_fqn").alias("class_fqn"), "name", F.coalesce("type_text", F.lit("")).alias("return_type"), "source").orderBy("class_fqn", "name", "return_type")
