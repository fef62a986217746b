"""Where annotations are used."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import glob, short_type
from ..session import cut
from ..sources.facts import TARGETS, Facts, ordinal
from .graph import closure
from .nested import flatten_values

#: The scopes and the targets each takes in.
SCOPES = {"ALL": TARGETS, "CLASS": ("CLASS",), "METHOD": ("METHOD", "CONSTRUCTOR"), "FIELD": ("FIELD",), "PARAM": ("PARAMETER",)}


def sites_with(facts: Facts, annotation: str, targets: tuple[str, ...] | None = None, meta: bool = True) -> DataFrame:
    """The sites of an annotation, given by name or pattern with `*`, on these targets; with `meta` also those of annotations
    that carry it, or carry one that does."""
    named = glob(F.col("ann_type"), annotation)
    sites = facts.sites.where(F.col("target").isin(*targets)) if targets else facts.sites
    if meta:
        used = facts.sites.select(F.col("ann_type").alias("dst")).distinct()
        carried = facts.sites.where("target = 'CLASS' and ann_type is not null").select(F.col("ann_type").alias("src"), F.col("owner_fqn").alias("dst"))
        carried = cut(carried.join(used, "dst", "left_semi").distinct())  # annotations on annotations: few or none
        if carried.head(1):
            start = facts.sites.select("ann_type").where(named).union(carried.select("src").where(glob(F.col("src"), annotation))).select(F.col("ann_type").alias("start")).distinct()
            all_ = closure(carried, start).select(F.col("fqn").alias("ann_type")).union(start).distinct()
            return sites.join(all_, "ann_type", "left_semi")
    return sites.where(named)


def annotation_usages(facts: Facts, annotation: str | None = None, scope: str = "ALL", include_libraries: bool = False, meta: bool = True) -> DataFrame:
    """The sites of one annotation (or of all), by scope; those in project types unless libraries are included.
    Sites on constructors are named `<init>`; blank descriptors are null. Meta-annotations count as in `sites_with`."""
    if scope not in SCOPES:
        raise ValueError(f"scope must be one of {', '.join(SCOPES)}")
    s = sites_with(facts, annotation, SCOPES[scope], meta) if annotation else facts.sites.where(F.col("target").isin(*SCOPES[scope]))
    if not include_libraries:
        s = s.join(facts.types.where("source = 'PROJECT'").select(F.col("fqn").alias("owner_fqn")), "owner_fqn", "left_semi")
    member = F.when(F.col("target") == "CONSTRUCTOR", "<init>").otherwise(F.col("member"))
    return s.select("site_id", "owner_fqn", "target", member.alias("member"), F.when(F.trim("descriptor") != "", F.col("descriptor")).alias("descriptor"), "field", "param_index", "param_name", "param_type", "ann_type")


def usage_values(facts: Facts, usages: DataFrame) -> DataFrame:
    """The usages with their annotation's values: one row for each value object, by path; usages without values have none.

    Spark can't tell how many values a text holds and takes them for few enough to be broadcast: the join is a merge."""
    values = flatten_values(facts.raw("annotation_sites")).select("site_id", "path", "parent_path", "kind", "value", "enum_type", "annotation_type", "item_count")
    return usages.hint("merge").join(values, "site_id")


def with_attributes(facts: Facts, usages: DataFrame) -> DataFrame:
    """The usages with `attributes`, a text of their annotation's values in the order of their paths: `path=value`, texts in
    quotes, class literals and nested annotations (`@Name`) by their simple names. Empty texts and arrays are left out,
    arrays and nested annotations with values stand for themselves by these."""
    v = flatten_values(facts.raw("annotation_sites"))
    empty = (F.col("kind") == "STRING") & (F.coalesce("value", F.lit("")) == "")
    text = F.when(F.col("kind") == "STRING", F.concat(F.lit('"'), "value", F.lit('"'))).when(F.col("kind") == "CLASS", short_type(F.col("value"))).when(F.col("kind") == "ANNOTATION", F.concat(F.lit("@"), short_type(F.col("annotation_type")))).otherwise(F.col("value"))
    leaf = v.where(~empty & (F.col("kind") != "ARRAY")).select("site_id", F.struct("path", F.concat(F.col("path"), F.lit("="), F.coalesce(text, F.lit(""))).alias("text")).alias("p"))
    # a site's values are as many as its own text holds
    whole = leaf.groupBy("site_id").agg(F.array_sort(F.collect_list("p")).alias("ps")).select("site_id", F.array_join(F.transform("ps", lambda p: p["text"]), ", ").alias("attributes"))
    return usages.join(whole, "site_id", "left").fillna("", ["attributes"])


def usage_order(attributes: bool = False) -> list:
    """The total order of usages; with their attributes' text, if they have it, before the last tie."""
    return [F.col("owner_fqn"), ordinal(F.col("target"), TARGETS), *[F.coalesce(c, F.lit("")) for c in ("member", "descriptor", "field")], F.coalesce("param_index", F.lit(-1)), F.coalesce("param_name", F.lit("")), F.col("ann_type"), *([F.col("attributes")] if attributes else []), F.col("site_id")]


def counts_by_target(usages: DataFrame) -> DataFrame:
    """(target, n) in the fixed order of targets; absent targets have no row."""
    return usages.groupBy("target").agg(F.count("*").alias("n")).orderBy(ordinal(F.col("target"), TARGETS))
