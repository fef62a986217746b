"""The fact tables of one snapshot, read plainly: cleaned names, each fact once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import plain_name, raw_name
from ..operators.hierarchy import latest_rows
from .tables import table

#: Dependency kinds and reference kinds in the order that sorts and priorities use.
DEPENDENCY_KINDS = ("EXTENDS", "IMPLEMENTS", "FIELD_TYPE", "METHOD_RETURN_TYPE", "METHOD_PARAMETER")
REFERENCE_KINDS = ("EXTENDS", "IMPLEMENTS", "FIELD", "RETURN", "PARAM", "ANNOTATION", "INSTANTIATION", "CALL_RECEIVER")
#: Annotation targets in the order that sorts use.
TARGETS = ("CLASS", "METHOD", "CONSTRUCTOR", "FIELD", "PARAMETER")
ROOT_CLASS = "java.lang.Object"


def ordinal(c, values: tuple[str, ...]):
    """The place of a value in a fixed order; unknown values come last."""
    out = F.lit(len(values))
    for i, v in reversed(list(enumerate(values))):
        out = F.when(c == v, i).otherwise(out)
    return out


def _names(c: str):
    """An array of names read plainly, without type arguments, nulls and blanks, each once."""
    read = F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), raw_name)
    return F.array_distinct(F.filter(read, lambda x: x.isNotNull() & (x != "")))


@dataclass(frozen=True)
class Facts:
    """Lazily read facts of a snapshot folder; each property is a DataFrame."""

    spark: SparkSession
    folder: str

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)

    @cached_property
    def types(self) -> DataFrame:
        """One row per fqn, the latest: supertypes are plain names, an unknown source is LIBRARY."""
        columns = ("fqn", "simple_name", "package_name", "source", "visibility", "is_interface", "is_abstract", "is_final", "is_enum", "is_annotation", "is_synthetic", "superclass", "interfaces", "superclass_args", "interface_args", "location", "scanned_at")
        held = latest_rows(self.raw("types").select(*columns))
        sup = raw_name("superclass")
        return held.select(
            "fqn", "simple_name", "package_name", F.coalesce("source", F.lit("LIBRARY")).alias("source"), "visibility", "is_interface", "is_abstract", "is_final", "is_enum", "is_annotation", "is_synthetic",
            F.when(sup != "", sup).alias("superclass"), _names("interfaces").alias("interfaces"), _names("superclass_args").alias("superclass_args"), _names("interface_args").alias("interface_args"), "location",
        )

    @cached_property
    def refs(self) -> DataFrame:
        """Each reference once, without those whose names are null or blank."""
        name = plain_name("type_fqn")
        target = F.when(F.endswith(name, F.lit("[]")), name.substr(F.lit(1), F.length(name) - 2)).otherwise(name)
        rows = self.raw("type_refs").select("ref_id", target.alias("type_fqn"), plain_name("from_fqn").alias("from_fqn"), "from_source", "kind", "member", "detail", "line_number")
        return rows.where("type_fqn <> '' and from_fqn <> ''").distinct()

    @cached_property
    def calls(self) -> DataFrame:
        """One row per call_id, the latest delivery; of equally late ones that whose constants sort last."""
        columns = ("call_idx", "method_name", "descriptor", "is_interface", "constant_args", "line_number", "invoke_dynamic", "impl_method_owner", "impl_method_name")
        rows = self.raw("call_sites").where("caller_fqn is not null and call_id is not null")
        row = F.struct("scanned_at", F.to_json("constant_args").alias("_j"), plain_name("caller_fqn").alias("caller_fqn"), "caller_method", plain_name("owner_type").alias("owner_type"), *columns)
        return rows.groupBy("call_id").agg(F.max(row).alias("r")).select("call_id", "r.*").drop("scanned_at", "_j")

    @cached_property
    def sites(self) -> DataFrame:
        """Each annotation site once, without its attributes."""
        rows = self.raw("annotation_sites").select("site_id", plain_name("owner_fqn").alias("owner_fqn"), "target", "member", "descriptor", "field", "param_name", "param_index", "param_type", plain_name("ann_type").alias("ann_type"))
        return rows.where("owner_fqn is not null").distinct()

    @cached_property
    def members(self) -> DataFrame:
        """(owner_fqn, kind, name, type_text): methods with their return types and fields with theirs."""
        kind = F.when(F.col("kind") == "RETURN", "METHOD").when(F.col("kind") == "FIELD", "FIELD")
        return self.refs.select(F.col("from_fqn").alias("owner_fqn"), kind.alias("kind"), F.col("member").alias("name"), F.col("type_fqn").alias("type_text")).where("kind is not null and name is not null").distinct()

    @cached_property
    def methods(self) -> DataFrame:
        """(owner_fqn, name, type_text): every method that any fact names, by its return types, null where none is known:
        methods with a return type, parameters, annotations or calls of their own. Overloads of one return type are one;
        what compilers add (`lambda$...`, `access$...`) is left out."""
        names = self.refs.where("kind in ('RETURN', 'PARAM')").select(F.col("from_fqn").alias("owner_fqn"), F.col("member").alias("name"))
        names = names.unionByName(self.raw("call_sites").select(plain_name("caller_fqn").alias("owner_fqn"), F.col("caller_method").alias("name")))
        names = names.unionByName(self.sites.where("target in ('METHOD', 'PARAMETER')").select("owner_fqn", F.col("member").alias("name")))
        names = names.where("owner_fqn is not null and name is not null and name <> '<init>' and not startswith(name, 'lambda$') and not startswith(name, 'access$')").distinct()
        typed = self.members.where("kind = 'METHOD'").select("owner_fqn", "name", "type_text")
        return names.join(typed, ["owner_fqn", "name"], "left")

    @cached_property
    def sources(self) -> DataFrame:
        """One row per file, told by origin, module and path."""
        rows = self.raw("sources").select("fqn", "path", "language", "module", "source_set", "origin", "content")
        return rows.where("path is not null").groupBy("origin", "module", "path").agg(F.max(F.struct("fqn", "language", "source_set", "content")).alias("r")).select("origin", "module", "path", "r.*")

    @cached_property
    def dep_edges(self) -> DataFrame:
        """(src, dst, type, ord, location): what each type depends on, each once; constructors and annotations don't
        count, nor do references to the type itself."""
        t = self.types
        up = t.select("fqn", F.when(F.col("superclass") != ROOT_CLASS, F.col("superclass")).alias("superclass"), "superclass_args", "interfaces", "interface_args")
        bases = F.filter(F.concat(F.array("superclass"), "superclass_args"), lambda x: x.isNotNull())
        ext = up.select(F.col("fqn").alias("src"), F.explode(bases).alias("dst"), F.lit("EXTENDS").alias("type"), F.lit(None).cast("string").alias("location"))
        imp = up.select(F.col("fqn").alias("src"), F.explode(F.concat("interfaces", "interface_args")).alias("dst"), F.lit("IMPLEMENTS").alias("type"), F.lit(None).cast("string").alias("location"))
        r = self.refs
        kind = F.when(F.col("kind") == "FIELD", "FIELD_TYPE").when(F.col("kind") == "RETURN", "METHOD_RETURN_TYPE").when(F.col("kind") == "PARAM", "METHOD_PARAMETER")
        place = F.when(F.col("kind") == "FIELD", F.col("member")).otherwise(F.concat("member", F.lit("()")))
        body = r.select(F.col("from_fqn").alias("src"), F.col("type_fqn").alias("dst"), kind.alias("type"), place.alias("location")).where("type is not null")
        edges = ext.unionByName(imp).unionByName(body).where("src <> dst").distinct()
        return edges.withColumn("ord", ordinal(F.col("type"), DEPENDENCY_KINDS))
