"""Calls in methods: what they are given, and filters on the methods they stand in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import returns_match
from ..sources.facts import Facts
from .usages import sites_with

#: Fixed value: how many constants before a call are kept at most.
WINDOW = 16


def call_windows(calls: DataFrame, window: int = WINDOW) -> DataFrame:
    """(caller_fqn, caller_method, call_idx, call_id, line_number, constants): each call with the constants it is given,
    the last `window` of them, as `KIND:value`. A dynamic call has none; a call without an owner or a name has no row."""
    c = calls.where("caller_method is not null and (invoke_dynamic or (owner_type is not null and method_name is not null))")
    given = F.coalesce("constant_args", F.expr("cast(array() as array<struct<kind:string,value:string>>)"))
    last = F.slice(given, F.greatest(F.size(given) - window + 1, F.lit(1)), window)
    texts = F.transform(last, lambda a: F.concat_ws(":", a["kind"], F.coalesce(a["value"], F.lit(""))))
    return c.select("caller_fqn", "caller_method", "call_idx", "call_id", "line_number", F.when(F.col("invoke_dynamic"), F.array().cast("array<string>")).otherwise(texts).alias("constants"))


def calls_in(facts: Facts, *, in_class: str | None = None, method: str | None = None, in_methods_returning: str | None = None, in_methods_annotated: str | None = None) -> DataFrame:
    """The call sites of a class or method, or of all; only those in methods with the return type or the annotation asked
    for. Overloads can't be told apart: the table names no descriptor of the calling method."""
    c = facts.calls
    if in_class:
        c = c.where(F.col("caller_fqn") == in_class)
    if method:
        c = c.where(F.col("caller_method") == method)
    if in_methods_returning:
        m = facts.members.where(F.col("kind") == "METHOD").where(returns_match(F.col("type_text"), in_methods_returning))
        c = c.join(m.select(F.col("owner_fqn").alias("caller_fqn"), F.col("name").alias("caller_method")), ["caller_fqn", "caller_method"], "left_semi")
    if in_methods_annotated:
        a = sites_with(facts, in_methods_annotated, ("METHOD",))
        c = c.join(a.select(F.col("owner_fqn").alias("caller_fqn"), F.col("member").alias("caller_method")), ["caller_fqn", "caller_method"], "left_semi")
    return c


def calls_per_method(calls: DataFrame) -> DataFrame:
    """(caller_fqn, caller_method, calls): calls of each method that has any."""
    return calls.groupBy("caller_fqn", "caller_method").agg(F.count("*").alias("calls"))


def methods_with_calls(facts: Facts, in_class: str | None = None, method: str | None = None) -> DataFrame:
    """(owner_fqn, name, calls): the methods of a class, or of all, that have calls; with a method's name all methods of
    that name, those without calls too."""
    counted = calls_per_method(calls_in(facts, in_class=in_class, method=method).where("caller_method is not null"))
    counted = counted.select(F.col("caller_fqn").alias("owner_fqn"), F.col("caller_method").alias("name"), "calls")
    if not method:
        return counted
    known = facts.methods.where(F.col("name") == method).select("owner_fqn", "name").distinct()
    if in_class:
        known = known.where(F.col("owner_fqn") == in_class)
    return known.join(counted, ["owner_fqn", "name"], "full").fillna(0, ["calls"])
