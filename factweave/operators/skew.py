"""Distinct counts per key when a few keys, or a few (key, member) pairs, hold most rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import BLANKS, plain_name


def _differs(a: pa.Array) -> np.ndarray:
    """Whether each entry differs from the one before; the first does."""
    out = np.ones(len(a), bool)
    if len(a) > 1:
        out[1:] = pc.not_equal(a.slice(1), a.slice(0, len(a) - 1)).to_numpy(zero_copy_only=False)
    return out


def _counts(key: pa.Array, member: pa.Array) -> pa.Array:
    """Which pairs count: both ends named, and not the same; a null counts as no name."""
    named = pc.and_(pc.not_equal(key, ""), pc.not_equal(member, ""))
    return pc.fill_null(pc.and_(named, pc.not_equal(key, member)), False)


def _partial_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (key, member): per key the number of different members. The first and the last key of
    the partition may go on in a neighbour, so their states also carry place, first and last member."""
    schema = pa.schema([("key", pa.string()), ("n", pa.int64()), ("part", pa.int32()), ("first", pa.string()), ("last", pa.string())])
    held: tuple | None = None  # key, n, first member, last member of the key that isn't finished
    is_first, part = True, 0

    def emit(key: str, n: int, first: str, last: str, edge: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"key": key, "n": n, "part": part, "first": first if edge else None, "last": last if edge else None}], schema)

    for batch in batches:
        batch = batch.filter(_counts(batch.column(0), batch.column(1)))
        if not batch.num_rows:
            continue
        key, member, part = batch.column(0), batch.column(1), batch.column(2)[0].as_py()
        new_key = _differs(key)
        new_pair = new_key | _differs(member)
        starts = np.flatnonzero(new_key)
        counts = np.add.reduceat(new_pair.astype(np.int64), starts)
        ends = np.append(starts[1:], len(new_key)) - 1
        keys, firsts, lasts = (x.take(pa.array(at)) for x, at in ((key, starts), (member, starts), (member, ends)))
        lo, head = 0, (keys[0].as_py(), int(counts[0]), firsts[0].as_py(), lasts[0].as_py())
        if held and held[0] == head[0]:
            held = (held[0], held[1] + head[1] - (held[3] == head[2]), held[2], head[3])
            lo = 1
        if lo < len(starts):  # at least one key begins in this batch
            if held:
                yield emit(*held, edge=is_first)
                is_first = False
            if is_first:  # the partition's first key
                held, lo = (keys[lo].as_py(), int(counts[lo]), firsts[lo].as_py(), lasts[lo].as_py()), lo + 1
                if lo < len(starts):
                    yield emit(*held, edge=True)
                    is_first = False
            if lo < len(starts):
                k, last = slice(lo, len(starts) - 1), len(starts) - 1
                n = last - lo
                if n:
                    nothing = pa.nulls(n, pa.string())
                    yield pa.RecordBatch.from_arrays([keys.slice(lo, n), pa.array(counts[k]), pa.array(np.full(n, part, np.int32)), nothing, nothing], schema=schema)
                held = (keys[last].as_py(), int(counts[last]), firsts[last].as_py(), lasts[last].as_py())
    if held:
        yield emit(*held, edge=True)


def distinct_members_per_key(rows: DataFrame, key: Column, member: Column, tie: Column, partitions: int | None = None) -> DataFrame:
    """(key, n): how many different members other than itself each key has; rows whose key or member is null or empty are
    left out.

    Rows are range-partitioned by (key, member, tie) at sampled quantiles, so a heavy key spreads over as many
    partitions as its rows fill, and so does a heavy (key, member) pair as long as `tie` varies. Each partition
    sends one small state per key; a key cut by a boundary is stitched in order of the partitions: a member that
    ends one part and begins the next counts once. `tie` may be null or repeat, which only makes parts less even.
    """
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # what doesn't count goes where the states are made: a filter here would work out both expressions once more
    pairs = rows.select(key.alias("key"), member.alias("member"), tie.alias("tie"))
    ranged = pairs.repartitionByRange(n, "key", "member", "tie").sortWithinPartitions("key", "member")
    states = ranged.select("key", "member", F.spark_partition_id().alias("part")).mapInArrow(_partial_states, "key string, n bigint, part int, first string, last string")
    edges = F.array_sort(F.collect_list(F.when(F.col("first").isNotNull(), F.struct("part", "first", "last"))))
    stitched = states.groupBy("key").agg(F.sum("n").alias("n"), edges.alias("edges"))
    doubled = F.size(F.filter(F.zip_with(F.slice("edges", 2, F.size("edges")), F.slice("edges", 1, F.greatest(F.size("edges") - 1, F.lit(0))), lambda b, a: b["first"] == a["last"]), lambda same: same))
    return stitched.select("key", (F.col("n") - F.when(F.size("edges") > 1, doubled).otherwise(0)).alias("n"))


def dependent_counts(refs: DataFrame, type_col: str = "type_fqn", from_col: str = "from_fqn", tie_col: str | None = "ref_id", partitions: int | None = None) -> DataFrame:
    """(type_fqn, dependent_count): by how many other types each type is referred to.

    Names are read without surrounding white space, with `.` for `/`, and the referred type without a final `[]`.
    Null and blank names and references of a type to itself are left out; repeated rows count once. An empty table
    gives no rows; other columns are ignored.
    """
    name = plain_name(F.col(f"`{type_col}`"))
    target = F.when(F.endswith(name, F.lit("[]")), F.btrim(name.substr(F.lit(1), F.length(name) - 2), F.lit(BLANKS))).otherwise(name)
    some = refs.where(F.col(f"`{type_col}`").isNotNull() & F.col(f"`{from_col}`").isNotNull())
    counts = distinct_members_per_key(some, target, plain_name(F.col(f"`{from_col}`")), F.col(f"`{tie_col}`") if tie_col else F.lit(0), partitions)
    return counts.select(F.col("key").alias("type_fqn"), F.col("n").alias("dependent_count"))
