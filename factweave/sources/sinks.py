"""Results as JSON rows, and ordered lines as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_json(df: DataFrame, keep_nulls: bool = True) -> DataFrame:
    """(json): each row as one JSON object; without `keep_nulls` null fields are left out."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": str(not keep_nulls).lower()}).alias("json"))


def write_lines(lines: DataFrame, order: list[Column | str], path: str, column: str = "line") -> None:
    """The lines in order as text files: read by name, the files hold them one after another."""
    lines.orderBy(*order).select(column).write.mode("overwrite").text(path)
