"""Pages of totally ordered results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def check_page(page: int = 0, size: int = 50) -> tuple[int, int]:
    if page < 0 or size < 1:
        raise ValueError("page must be at least 0 and size at least 1")
    return page, size


def page_arguments(page: str | None = None, size: str | None = None) -> tuple[int, int]:
    """Page and size from texts: what is blank or no whole number is the default, what is out of range an error."""

    def read(text: str | None, default: int) -> int:
        try:
            return int((text or "").strip())
        except ValueError:
            return default

    return check_page(read(page, 0), read(size, 50))


def flag(text: str | None) -> bool:
    """Whether a text is `true`, in any case."""
    return (text or "").strip().lower() == "true"


def total_pages(total: int, size: int) -> int:
    """At least one page, even of an empty result."""
    return max(1, -(-total // size))


#: Pages that end at or before this row come from a top-k, later ones from numbered range partitions: a top-k brings all
#: rows up to the page's end to one task.
EARLY_ROWS = 100_000


def paginate(df: DataFrame, keys: list[Column], page: int = 0, size: int = 50) -> DataFrame:
    """The rows of one page, counted from 0, in the order of the keys (which has to be total), with their place in
    `row_no` (from 1). A page beyond the end is empty; pages may lie anywhere, their places are bigints."""
    page, size = check_page(page, size)
    end = (page + 1) * size
    if end > EARLY_ROWS:
        return number_rows(df, keys, "row_no").where(F.col("row_no").between(page * size + 1, end))
    top = df.orderBy(*keys).limit(end).offset(page * size)
    # at most `size` rows are left to number
    return top.withColumn("row_no", F.row_number().over(Window.orderBy(*keys)).cast("bigint") + page * size)


def page_of(df: DataFrame, keys: list[Column], page: int = 0, size: int = 50) -> tuple[DataFrame, int, int]:
    """The rows of a page, how many rows there are in all, and how many pages."""
    rows = paginate(df, keys, page, size)
    total = df.count()
    return rows, total, total_pages(total, size)


def number_rows(df: DataFrame, keys: list[Column], name: str, partitions: int | None = None) -> DataFrame:
    """All rows with their place from 1 in the order of the keys, which has to be total. Rows are numbered within range
    partitions; what the partitions before hold is added."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    # a row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*keys)).cast("bigint")
    return ranged.withColumn("_own", own).join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_own") + F.col("_before")).alias(name))
