"""Class paths, coordinates of artifacts, where sources come from, and what a cache of them holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import truncated_sha256

#: Prefixes of names that count as the platform's own.
JDK_PREFIXES = ("java.", "javax.", "jdk.", "sun.", "com.sun.", "org.w3c.dom.", "org.xml.sax.", "org.ietf.jgss.")


#: Where sources come from, in the order in which they are preferred.
ORIGINS = ("PROJECT_SOURCE", "SOURCE_JAR", "JDK_SOURCE", "DECOMPILED")


def is_jdk(name: Column) -> Column:
    return name.rlike("^(" + "|".join(p.replace(".", r"\.") for p in JDK_PREFIXES) + ")")


def classify(name: Column, location: Column, output_dirs: tuple[str, ...], java_home: str = "/opt/java") -> Column:
    """PROJECT below an output directory, JDK by name or place, else LIBRARY; without a place LIBRARY."""
    inside = F.lit(False)
    for d in output_dirs:
        inside = inside | F.startswith(location, F.lit(d))
    return F.when(location.isNull(), "LIBRARY").when(inside, "PROJECT").when(is_jdk(name) | F.startswith(location, F.lit(java_home)), "JDK").otherwise("LIBRARY")


def parse_classpath_file(lines: DataFrame, project_dir: str) -> DataFrame:
    """(ordinal, path, kind, is_project_output) from lines(ordinal, value): blank lines and those that begin with `#`
    are left out, a path counts where it comes first, and outputs are paths below the project with `/build/` in them."""
    path = F.trim("value")
    kept = lines.select("ordinal", path.alias("path")).where("path <> '' and not startswith(path, '#')").groupBy("path").agg(F.min("ordinal").alias("ordinal"))
    output = F.startswith("path", F.lit(project_dir)) & F.contains("path", F.lit("/build/"))
    return kept.select("ordinal", "path", F.when(F.endswith("path", F.lit(".jar")), "JAR").otherwise("DIRECTORY").alias("kind"), output.alias("is_project_output"))


def parse_sections(lines: DataFrame) -> DataFrame:
    """(section, ordinal, fields) from lines(file, ordinal, value) of texts with `#` headings and rows of fields parted
    by `|`: each row belongs to the heading last seen; rows before any heading are left out."""
    order = Window.partitionBy("file").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.startswith("value", F.lit("#")), F.trim(F.substring("value", 2, 1 << 30)))
    marked = lines.withColumn("heading", heading).withColumn("section", F.last("heading", ignorenulls=True).over(order))
    rows = marked.where("heading is null and section is not null and trim(value) <> ''")
    return rows.select("file", "section", "ordinal", F.split(F.trim("value"), r"\|").alias("fields"))


def coordinates(text: Column) -> Column:
    """struct(group, artifact, version) of `group:artifact:version`; further parts are ignored, fewer give null."""
    parts = F.split(text, ":")
    return F.when(F.size(parts) >= 3, F.struct(parts[0].alias("group"), parts[1].alias("artifact"), parts[2].alias("version")))


def artifact_path(group: Column, artifact: Column, version: Column) -> Column:
    return F.concat_ws("/", F.replace(group, F.lit("."), F.lit("/")), artifact, version)


def jar_name(artifact: Column, version: Column, classifier: str = "") -> Column:
    return F.concat(artifact, F.lit("-"), version, F.lit(f"-{classifier}" if classifier else ""), F.lit(".jar"))


def jar_parts(location: Column) -> Column:
    """struct(artifact, version) of a jar's path `.../artifact-version.jar`; null for other paths."""
    rx = r"([^/]+)-(\d[^/-]*)\.jar$"
    return F.when(location.rlike(rx), F.struct(F.regexp_extract(location, rx, 1).alias("artifact"), F.regexp_extract(location, rx, 2).alias("version")))


def mapped_coordinates(lines: DataFrame) -> DataFrame:
    """(path, group, artifact, version) from lines(ordinal, value) of the form `group:artifact:version|path`, parted at the
    first `|`; of lines with one path the last holds, lines without a path or with fewer parts are left out."""
    at = F.locate("|", "value")
    parted = lines.where(at > 0).select("ordinal", F.trim(F.expr("substring(value, locate('|', value) + 1)")).alias("path"), coordinates(F.trim(F.substring_index("value", "|", 1))).alias("c"))
    last = parted.where("path <> '' and c is not null").groupBy("path").agg(F.max_by("c", "ordinal").alias("c"))
    return last.select("path", "c.*")


def located_coordinates(types: DataFrame, mapping: DataFrame) -> DataFrame:
    """(fqn, group, artifact, version): the coordinates of the archive each type comes from, by the mapping of its path,
    else by the path's own name, without a group; types from elsewhere have none."""
    named = types.where("location is not null").select("fqn", F.col("location").alias("path"), jar_parts(F.col("location")).alias("own"))
    found = named.join(mapping.select("path", F.struct("group", "artifact", "version").alias("c")), "path", "left")
    return found.where("c is not null or own is not null").select("fqn", F.col("c.group").alias("group"), F.coalesce("c.artifact", "own.artifact").alias("artifact"), F.coalesce("c.version", "own.version").alias("version"))


def cacheable_name(name: Column) -> Column:
    """Whether a class name may be the name of a cached file."""
    return F.coalesce(name.rlike(r"^[a-zA-Z0-9._$]+$") & ~F.contains(name, F.lit("..")), F.lit(False))


def source_listing(entries: DataFrame, endings: tuple[str, ...] = (".java", ".kt")) -> DataFrame:
    """The source files among entries(archive, entry, ...) of archives; folders, and entries that would leave the folder
    they are extracted to, are none."""
    ends = F.lit(False)
    for e in endings:
        ends = ends | F.endswith("entry", F.lit(e))
    return entries.where(ends & safe_entry(F.col("entry")))


def entry_for_type(entries: DataFrame, types: DataFrame) -> DataFrame:
    """(fqn, archive, entry): of entries(archive, entry) the one that holds each type, by its name as a path below any
    module folder: `.java` before `.kt`, its own before its outermost type's, then the least."""
    path = lambda c: F.replace(c, F.lit("."), F.lit("/"))
    outer = F.substring_index("fqn", "$", 1)
    wanted = types.select("fqn", F.explode(F.array(*[F.struct(F.concat(path(n), F.lit(e)).alias("tail"), F.lit(2 * i + j).alias("rank")) for i, n in enumerate((F.col("fqn"), outer)) for j, e in enumerate((".java", ".kt"))])).alias("w"))
    wanted = wanted.select("fqn", "w.tail", "w.rank")
    # every tail of an entry's path, so that folders before the package don't matter
    parts = F.split("entry", "/")
    tails = entries.select("archive", "entry", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("tail"))
    best = wanted.join(tails, "tail").groupBy("fqn").agg(F.min(F.struct("rank", "archive", "entry")).alias("b"))
    return best.select("fqn", "b.archive", "b.entry")


def cache_key(path: Column) -> Column:
    return truncated_sha256(path, 16)


def is_zip(data: Column) -> Column:
    """Whether bytes begin as a zip archive does."""
    return F.substring(data, 1, 4) == F.lit(bytes([0x50, 0x4B, 0x03, 0x04]))


def safe_entry(name: Column) -> Column:
    """Whether an archive entry stays inside the folder it is extracted to."""
    return ~name.rlike(r"(^|[/\\])\.\.([/\\]|$)") & ~name.rlike(r"^([/\\]|[A-Za-z]:)")


def cache_statistics(sources: DataFrame) -> DataFrame:
    """(origin, files, chars) of each origin."""
    return sources.groupBy(F.coalesce("origin", F.lit("UNKNOWN")).alias("origin")).agg(F.count("*").alias("files"), F.coalesce(F.sum(F.length("content")), F.lit(0)).alias("chars"))


def resolve_sources(types: DataFrame, sources: DataFrame) -> DataFrame:
    """(fqn, path, found): the file that holds each type, or its outermost type: of several the main one, then by
    the order of origins (a project's own file, a source jar's, the platform's, a decompiled one, any other), Java before
    Kotlin, then the least module and path. A type without a file is SOURCE_NOT_FOUND,
    and a stub made from its facts stands in for it (`source_or_stub`)."""
    outer = F.substring_index("fqn", "$", 1)
    rank = F.struct(
        (F.col("source_set") != "main").alias("other_set"),
        F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(o) for o in ORIGINS]), F.col("origin")).cast("int"), F.lit(0)), F.lit(len(ORIGINS) + 1)).alias("preferred"),
        (~F.endswith("path", F.lit(".java"))).alias("other_language"),
        F.coalesce("module", F.lit("")).alias("module"),
        F.col("path").alias("path"),
    )
    files = sources.where("content is not null").select(F.col("fqn").alias("outer"), F.coalesce("source_set", F.lit("")).alias("source_set"), F.coalesce("origin", F.lit("")).alias("origin"), "module", "path")
    best = files.groupBy("outer").agg(F.min(rank).alias("best"), F.min_by("origin", rank).alias("origin"))
    named = types.select("fqn", outer.alias("outer"))
    return named.join(best, "outer", "left").select("fqn", F.col("best.path").alias("path"), F.coalesce("origin", F.lit("SOURCE_NOT_FOUND")).alias("found"))


def source_or_stub(types: DataFrame, sources: DataFrame, stubs: DataFrame) -> DataFrame:
    """(fqn, found, text): what can be shown of each type: the file that holds it, by `resolve_sources`, with its origin; else
    its stub from stubs(fqn, text), as STUB; else no text, as SOURCE_NOT_FOUND."""
    best = resolve_sources(types, sources)
    outer = F.substring_index("fqn", "$", 1)
    files = sources.where("content is not null").select(F.col("fqn").alias("outer"), "path", F.coalesce("origin", F.lit("")).alias("found"), "content").groupBy("outer", "path", "found").agg(F.max("content").alias("content"))
    held = best.withColumn("outer", outer).join(files, ["outer", "path", "found"], "left").join(stubs.select("fqn", "text"), "fqn", "left")
    stubbed = F.col("content").isNull() & F.col("text").isNotNull()
    return held.select("fqn", F.when(stubbed, "STUB").otherwise(F.col("found")).alias("found"), F.coalesce("content", "text").alias("text"))


def source_files(spark: SparkSession, folder: str, include_tests: bool = True, pattern: str | None = None) -> DataFrame:
    """(path, content) of the Kotlin files below a folder, whole; build folders and, if asked, tests are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{kt,kts}").text(folder, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")).where("not contains(path, '/build/')")
    if not include_tests:
        files = files.where("not contains(path, '/test/') and not contains(path, '/testFixtures/')")
    if pattern:
        from ..functions.names import glob

        files = files.where(glob(F.col("path"), pattern) | glob(F.element_at(F.split("path", "/"), -1), pattern))
    return files
