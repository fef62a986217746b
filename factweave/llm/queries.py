"""Queries of the corpus problems 2, 4, 6, 7 and 8, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut
from ..sources.tables import table
from . import docpairs, frequent, mixing, packing, spans


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return docpairs.documented_places(table(spark, folder, "sources"), table(spark, folder, "method_sources"))


def p2_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """The pairs themselves: each documented function's code and its description."""
    return docpairs.documented_functions(table(spark, folder, "sources"), table(spark, folder, "method_sources"))


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "call_sites").select(F.replace("owner_type", F.lit("/"), F.lit(".")).alias("owner_type"), "method_name")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return frequent.most_frequent(_calls(spark, folder), ["owner_type", "method_name"], 25).drop("n")


def p4_intervals(spark: SparkSession, folder: str) -> DataFrame:
    """Every call that may be among the 25 most frequent, with the interval lossy counting guarantees for its count."""
    return frequent.contenders(cut(frequent.count_intervals(_calls(spark, folder), ["owner_type", "method_name"])), 25)


def p4_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """The 25 most frequent calls with their counts, and whether lossy counting's intervals hold them."""
    columns = ["owner_type", "method_name"]
    top = frequent.most_frequent(_calls(spark, folder), columns, 25)
    held = top.join(p4_intervals(spark, folder), columns, "left")
    return held.select(*columns, "n", F.coalesce(F.col("n").between(F.col("lower"), F.col("upper")), F.lit(False)).alias("within"))


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def p6_unused(spark: SparkSession, folder: str) -> DataFrame:
    return packing.container_fill(packing.pack_documents(table(spark, folder, "documents")))


def p6_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """One row: documents packed, and of what must not be: containers beyond their capacity, documents split that would
    have fitted, and documents whose pieces don't follow one another."""
    packed = cut(packing.pack_documents(table(spark, folder, "documents")))
    over = packed.groupBy("container_id").agg(F.sum("size").alias("n")).agg(F.count_if(F.col("n") > 2048).alias("overfull"))
    whole = packed.groupBy("doc_id").agg(F.sum("size").alias("n"), F.count("*").alias("pieces"), F.max(F.col("start") + F.col("size")).alias("end"))
    docs = whole.agg(F.count("*").alias("documents"), F.count_if((F.col("n") <= 2048) & (F.col("pieces") > 1)).alias("split"), F.count_if(F.col("end") != F.col("n")).alias("broken"))
    both = docs.withColumn("overfull", F.lit(0)).unionByName(over.select(*[F.lit(0).alias(c) for c in ("documents", "split", "broken")], "overfull"))
    return both.agg(*[F.sum(c).alias(c) for c in both.columns])


def p7_mixed(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    targets = table(spark, folder, "mix_targets")
    return mixing.mix_shares(mixing.mix(table(spark, folder, "documents"), targets), targets)


def p7_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Of each source of the targets whether its blocks come too often, and whether it lacks a share that it could give."""
    targets = table(spark, folder, "mix_targets")
    s = mixing.mix_shares(mixing.mix(table(spark, folder, "documents"), targets), targets)
    lacks = (F.col("share") < F.col("target_share") - 0.02) & (F.col("most_uses") < F.col("max_repeats"))
    return s.select("source", "target_share", "max_repeats", (F.col("most_uses") > F.col("max_repeats")).alias("too_often"), lacks.alias("lacks"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spans.shared_chars(table(spark, folder, "documents"))


def p8_spans(spark: SparkSession, folder: str) -> DataFrame:
    """The shared stretches themselves: where each begins in its document and how long it is."""
    return spans.shared_spans(table(spark, folder, "documents")).drop("text_key")


QUERIES = {f.__name__: f for f in (p2_found, p2_pairs, p4_found, p4_intervals, p4_bounds, p6_packed, p6_unused, p6_invariants, p7_mixed, p7_shares, p7_invariants, p8_found, p8_spans)}

#: Every run of 200 characters of every text, and where those begin that another document has too.
_SHARED = """
WITH run AS (
  SELECT doc_id, i, substring(text, i, 200) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200)
), shared AS (SELECT DISTINCT doc_id, i FROM run WHERE s IN (SELECT s FROM run GROUP BY s HAVING min(doc_id) <> max(doc_id)))"""

SQL = {
    "p4_found": """
SELECT replace(owner_type, '/', '.') AS owner_type, method_name FROM call_sites
WHERE owner_type IS NOT NULL AND method_name IS NOT NULL
GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 25""",
    "p4_bounds": """
SELECT replace(owner_type, '/', '.') AS owner_type, method_name, count(*) AS n, true AS within FROM call_sites
WHERE owner_type IS NOT NULL AND method_name IS NOT NULL
GROUP BY 1, 2 ORDER BY count(*) DESC, 1, 2 LIMIT 25""",
    "p6_invariants": "SELECT count(DISTINCT doc_id) AS documents, 0 AS split, 0 AS broken, 0 AS overfull FROM documents",
    "p7_invariants": "SELECT DISTINCT lower(trim(source)) AS source, target_share, max_repeats, false AS too_often, false AS lacks FROM mix_targets",
    "p8_found": _SHARED + """
SELECT doc_id, sum(least(200, coalesce(ahead - i, 200)))::BIGINT AS shared_chars
FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS ahead FROM shared) GROUP BY 1""",
    "p8_spans": _SHARED + """
SELECT doc_id, min(i) - 1 AS start, max(i) - min(i) + 200 AS length FROM (
  SELECT doc_id, i, sum(CASE WHEN i - behind <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS piece
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS behind FROM shared)) GROUP BY doc_id, piece""",
}
