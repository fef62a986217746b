"""Most frequent items in bounded memory, by lossy counting."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


class LossyCounter:
    """Counts of one stream of rows with `keys` string columns.

    Rows come in buckets of `width`. An entry holds the rows counted since it was (last) taken in and `delta`, the
    most that may have been missed before. At the end of bucket b entries with n + delta <= b go, so a value that
    isn't held has at most b rows, and at most about width * log(rows / width) entries are held.
    """

    def __init__(self, keys: int, width: int) -> None:
        self.names = [f"k{i}" for i in range(keys)]
        self.width, self.done, self.waiting, self.waiting_rows = width, 0, [], 0
        self.entries = pa.table([pa.array([], pa.string())] * keys + [pa.array([], pa.int64())] * 2, names=[*self.names, "n", "delta"])

    def add(self, batch: pa.RecordBatch) -> None:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, self.width - self.waiting_rows)
            self.waiting.append(part.rename_columns(self.names))
            self.waiting_rows += part.num_rows
            at += part.num_rows
            if self.waiting_rows == self.width:
                self._take_in()
                self.done += 1
                self.entries = self.entries.filter(pc.greater(pc.add(self.entries["n"], self.entries["delta"]), self.done))

    def _take_in(self) -> None:
        if self.waiting:
            new = pa.Table.from_batches(self.waiting).group_by(self.names).aggregate([([], "count_all")]).rename_columns([*self.names, "n"])
            new = new.append_column("delta", pa.array(np.full(len(new), self.done)))  # an older entry's delta is smaller
            both = pa.concat_tables([self.entries, new]).group_by(self.names).aggregate([("n", "sum"), ("delta", "min")])
            self.entries = both.rename_columns([*self.names, "n", "delta"])
        self.waiting, self.waiting_rows = [], 0

    def summary(self) -> pa.Table:
        """The entries, with `base`, the most rows of a value that isn't held; and a row of nulls with n = 0 and
        delta = base, so that base is known even without entries."""
        self._take_in()
        held = self.entries.append_column("base", pa.array(np.full(len(self.entries), self.done)))
        mark = pa.table([pa.array([None], pa.string()) for _ in self.names] + [pa.array([x]) for x in (0, self.done, 0)], names=held.column_names)
        return pa.concat_tables([held, mark])


def count_intervals(rows: DataFrame, columns: list[str], width: int = 10_000) -> DataFrame:
    """(columns..., lower, upper): for every value held by any partition the interval its count is in.

    Each partition sends one summary; summaries merge by adding counts and deltas, a partition that doesn't hold a
    value adding its base. A value that is missing altogether has at most sum(base) rows. Rows with a null in any
    column are left out; an empty table gives no rows.
    """
    return _intervals(rows, columns, width)[0]


def _intervals(rows: DataFrame, columns: list[str], width: int) -> tuple[DataFrame, int]:
    """The rows of `count_intervals`, and sum(base), the most rows of a value that no partition holds."""
    names = [f"k{i}" for i in range(len(columns))]
    keep = rows.select(*[F.col(f"`{c}`").cast("string").alias(k) for c, k in zip(columns, names, strict=True)]).dropna()

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = LossyCounter(len(names), width)
        for batch in batches:
            counter.add(batch)
        yield from counter.summary().combine_chunks().to_batches()

    schema = ", ".join(f"{k} string" for k in names) + ", n bigint, delta bigint, base bigint"
    merged = keep.mapInArrow(summarise, schema).groupBy(*names).agg(F.sum("n").alias("n"), F.sum(F.col("delta") - F.col("base")).alias("gap"))
    merged = cut(merged)
    missed = merged.where("k0 is null").agg(F.sum("gap")).head()[0] or 0  # one number
    held = merged.where("k0 is not null")
    return held.select(*[F.col(k).alias(c) for c, k in zip(columns, names, strict=True)], F.col("n").alias("lower"), (F.col("n") + F.col("gap") + missed).alias("upper")), missed


def contenders(intervals: DataFrame, k: int) -> DataFrame:
    """Every value that may be among the k most frequent: its upper bound reaches the k-th largest lower bound."""
    lowers = [r[0] for r in intervals.select("lower").orderBy(F.desc("lower")).limit(k).collect()]  # k numbers
    return intervals.where(F.col("upper") >= (lowers[-1] if len(lowers) == k else 0))


def _top(counts: DataFrame, columns: list[str], k: int) -> DataFrame:
    return cut(counts.orderBy(F.desc("n"), *columns).limit(k))


def most_frequent(rows: DataFrame, columns: list[str], k: int, width: int = 10_000, widest: int = 1_000_000) -> DataFrame:
    """(columns..., n): the k most frequent values with their exact counts; ties go to the smaller value.

    Lossy counting names the contenders; a second pass counts only those. That is the answer if the k-th count is
    larger than what a value may have that lossy counting doesn't hold, or if the contenders are all rows. Otherwise
    the width was too small for so even a distribution: it is tried once more with buckets of `widest` rows, about
    the most a task may hold in memory, and where that doesn't tell the k first apart either, all values are counted
    in one partially aggregated groupBy, which spills. Rows with a null are left out; an empty table gives no rows.
    """
    keep = rows.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).dropna()
    for w in sorted({width, max(width, widest)}):
        intervals, missed = _intervals(rows, columns, w)
        some = cut(contenders(cut(intervals), k))
        top = _top(keep.join(some.select(*columns), columns, "left_semi").groupBy(*columns).agg(F.count("*").alias("n")), columns, k)
        least, found, covered = top.agg(F.min("n"), F.count("*"), F.sum("n")).head()
        if not missed or (found == k and least > missed) or covered == keep.count():
            return top
    return _top(keep.groupBy(*columns).agg(F.count("*").alias("n")), columns, k)
