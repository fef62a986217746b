"""Stub text of types from their facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import short_type
from ..sources.facts import ROOT_CLASS, Facts

#: What types are called in Kotlin.
KOTLIN_NAMES = {"void": "Unit", "boolean": "Boolean", "byte": "Byte", "char": "Char", "short": "Short", "int": "Int", "long": "Long", "float": "Float", "double": "Double", "Object": "Any", "Integer": "Int", "Character": "Char"}
VISIBILITIES = {"ALL": None, "PUBLIC": ("PUBLIC",), "PUBLIC_PROTECTED": ("PUBLIC", "PROTECTED")}


def kotlin_type(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in KOTLIN_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, c), c)


def stub_lines(facts: Facts, language: str = "JAVA", visibility: str = "ALL", bodies: bool = True, include_libraries: bool = False) -> DataFrame:
    """(fqn, section, ordinal, text): package, annotations, declaration, fields, constructors, methods and end of each
    project type, in the order of section and ordinal. Names with `$` and `serialVersionUID` are hidden; methods of
    interfaces, and all without `bodies`, have none.

    Parameters are those that references name, in the order of their ids, as `p0`, `p1` and so on: overloads fall
    together, and primitive ones aren't known. Methods whose return type isn't known are `void`; of an `open` Kotlin
    class they are `open`."""
    if language not in ("JAVA", "KOTLIN"):
        raise ValueError("language must be JAVA or KOTLIN")
    if visibility not in VISIBILITIES:
        raise ValueError(f"visibility must be one of {', '.join(VISIBILITIES)}")
    java = language == "JAVA"
    t = facts.types if include_libraries else facts.types.where("source = 'PROJECT'")
    if VISIBILITIES[visibility]:
        t = t.where(F.col("visibility").isin(*VISIBILITIES[visibility]))
    is_open = ~F.col("is_final") & ~F.col("is_interface")
    shown = t.select("fqn", "is_interface", is_open.alias("is_open"))
    end = F.lit(";" if java else "")
    row = lambda df, section, ordinal, text: df.select("fqn", F.lit(section).alias("section"), ordinal.alias("ordinal"), text.alias("text"))
    zero = F.lit("")
    package = row(t.where("package_name <> ''"), 0, zero, F.concat(F.lit("package "), "package_name", end))
    notes = facts.sites.where("target = 'CLASS' and ann_type is not null and not startswith(ann_type, 'kotlin.')").select(F.col("owner_fqn").alias("fqn"), "ann_type").distinct().join(shown, "fqn", "left_semi")
    annotations = row(notes, 1, F.col("ann_type"), F.concat(F.lit("@"), short_type(F.col("ann_type"))))
    access = F.when(F.col("visibility").isin("PUBLIC", "PROTECTED", "PRIVATE"), F.concat(F.lower("visibility"), F.lit(" "))).otherwise("")
    if not java:
        access = F.when(F.col("visibility") == "PUBLIC", "").when(F.col("visibility") == "PACKAGE_PRIVATE", "internal ").otherwise(access)
    abstract = F.when(F.col("is_abstract") & ~F.col("is_interface"), "abstract ").when(F.lit(java) & F.col("is_final") & ~F.col("is_enum"), "final ").when(F.lit(not java) & ~F.col("is_final") & ~F.col("is_interface") & ~F.col("is_abstract"), "open ").otherwise("")
    words = ("interface ", "@interface ", "enum ", "class ") if java else ("interface ", "annotation class ", "enum class ", "class ")
    kind = F.when(F.col("is_interface"), words[0]).when(F.col("is_annotation"), words[1]).when(F.col("is_enum"), words[2]).otherwise(words[3])
    ups = F.transform(F.filter(F.array("superclass"), lambda x: x.isNotNull() & ~x.isin(ROOT_CLASS, "java.lang.Enum")), short_type)
    faces = F.transform("interfaces", short_type)
    if java:
        tail = F.concat(F.when(F.size(ups) > 0, F.concat(F.lit(" extends "), F.array_join(ups, ", "))).otherwise(""), F.when(F.size(faces) > 0, F.concat(F.when(F.col("is_interface"), " extends ").otherwise(" implements "), F.array_join(faces, ", "))).otherwise(""))
    else:
        both = F.concat(ups, faces)
        tail = F.when(F.size(both) > 0, F.concat(F.lit(" : "), F.array_join(both, ", "))).otherwise("")
    head = row(t, 2, zero, F.concat(access, abstract, kind, "simple_name", tail, F.lit(" {")))
    fields_of = facts.members.where("kind = 'FIELD'").select("owner_fqn", "kind", "name", "type_text")
    methods_of = facts.methods.select("owner_fqn", F.lit("METHOD").alias("kind"), "name", F.coalesce("type_text", F.lit("void")).alias("type_text"))
    # a method's parameters are as many as its descriptor allows
    kinds = F.transform(F.array_sort(F.collect_list(F.struct("ref_id", "type_fqn"))), lambda p, i: F.concat(short_type(p["type_fqn"]), F.lit(" p"), i) if java else F.concat(F.lit("p"), i, F.lit(": "), kotlin_type(short_type(p["type_fqn"]))))
    params = facts.refs.where("kind = 'PARAM' and member is not null").groupBy(F.col("from_fqn").alias("fqn"), F.col("member").alias("name")).agg(F.array_join(kinds, ", ").alias("params"))
    m = fields_of.unionByName(methods_of).where("not contains(name, '$') and name <> 'serialVersionUID' and name <> '<init>'").withColumnRenamed("owner_fqn", "fqn").join(shown, "fqn").join(params, ["fqn", "name"], "left").fillna("", ["params"])
    built = params.where("name = '<init>'").join(t.select("fqn", "simple_name"), "fqn")
    kind_text = short_type(F.col("type_text"))
    if java:
        field = F.concat(F.lit("    "), kind_text, F.lit(" "), "name", F.lit(";"))
        maker = F.concat(F.lit("    "), "simple_name", F.lit("("), "params", F.lit(")"), F.lit(" { /* ... */ }" if bodies else ";"))
        method = F.concat(F.lit("    "), kind_text, F.lit(" "), "name", F.lit("("), "params", F.lit(")"), F.when(F.col("is_interface") | F.lit(not bodies), ";").otherwise(" { /* ... */ }"))
    else:
        field = F.concat(F.lit("    val "), "name", F.lit(": "), kotlin_type(kind_text))
        maker = F.concat(F.lit("    constructor("), "params", F.lit(")"))
        method = F.concat(F.lit("    "), F.when(F.col("is_open"), "open ").otherwise(""), F.lit("fun "), "name", F.lit("("), "params", F.lit("): "), kotlin_type(kind_text), F.when(F.col("is_interface") | F.lit(not bodies), "").otherwise(" = TODO()"))
    place = F.concat_ws(" ", "name", "type_text")
    fields = row(m.where("kind = 'FIELD'"), 3, place, field)
    makers = row(built, 4, F.lit(""), maker)
    methods = row(m.where("kind = 'METHOD'"), 5, place, method)
    return package.unionByName(annotations).unionByName(head).unionByName(fields).unionByName(makers).unionByName(methods).unionByName(row(t, 6, zero, F.lit("}")))


def stubs(facts: Facts, **how) -> DataFrame:
    """(fqn, text): the stub of each type as one text."""
    lines = stub_lines(facts, **how).groupBy("fqn").agg(F.array_sort(F.collect_list(F.struct("section", "ordinal", "text"))).alias("lines"))
    return lines.select("fqn", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))
