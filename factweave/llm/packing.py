"""Items of varying length into containers of fixed capacity, by pattern packing.

Only the histogram of lengths (at most capacity + 1 numbers) reaches the driver. There, few-document length patterns
are fitted to it by non-negative least squares, rounded down to repeat counts, and what is left is packed best-fit
into the gaps and new containers. The outcome is a table of slots (length, first rank, how many, first container);
documents find their container by length and rank, where they are: nothing but the histogram is gathered.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .tokens import VOCABULARY, with_token_counts


def patterns(cells: int, present: np.ndarray, most: int = 12) -> np.ndarray:
    """Patterns over cells of length: how many documents of each of up to three lengths fill a container of `cells`
    cells. One row per pattern; documents per pattern at most `most`. Two lengths in any multiple, and three single
    ones, as long as not more than one cell stays empty."""
    have = [int(c) for c in np.flatnonzero(present) if c > 0]
    is_there = set(have)
    found: set[tuple[tuple[int, int], ...]] = set()
    for i, a in enumerate(have):
        for m in range(1, min(most, cells // a) + 1):
            rest = cells - m * a
            if rest <= 1:
                found.add(((a, m),))
            for n in range(1, most - m + 1):
                for b in {rest // n, (rest - 1) // n if rest > 0 else 0}:
                    if b in is_there and b != a and rest - 1 <= n * b <= rest:
                        found.add(tuple(sorted(((a, m), (b, n)))))
        for b in have[i + 1 :]:
            for c in (cells - a - b, cells - a - b - 1):
                if c > b and c in is_there:
                    found.add(((a, 1), (b, 1), (c, 1)))
    out = np.zeros((len(found), cells + 1))
    for k, p in enumerate(sorted(found)):
        for c, m in p:
            out[k, c] = m
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active-set method: at most as many x as rows are positive."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[passive] = -np.inf
        j = int(np.argmax(slope)) if n else -1
        if j < 0 or slope[j] <= 1e-9 * max(1.0, float(np.abs(b).max(initial=0))):
            break
        passive[j] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            low = s <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - s[low], 1e-300))
            x[at] += step * (s - x[at])
            passive[at[x[at] <= 1e-12]] = False
            x[~passive] = 0
    return x


def plan_slots(histogram: np.ndarray, cell: int = 16, filler: int = 96) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, documents, per container, first container) and the number of containers, from the
    number of items of each length 0..capacity. The `documents` ranks of a slot go to consecutive containers from
    the first on, `per container` to each. Patterns are fitted to lengths in cells; items of up to `filler` are kept
    back to fill what cells leave open. Work depends on the capacity, not on the number of items."""
    capacity = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    rank = np.zeros(capacity + 1, np.int64)
    slots: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> runs of containers (first, how many)
    used = 0

    def place(length: int, documents: int, per: int, first: int) -> None:
        slots.append((length, int(rank[length]), documents, per, first))
        rank[length] += documents
        left[length] -= documents

    def fill(runs: list[tuple[int, int, int]], lengths: Iterator[int]) -> list[tuple[int, int, int]]:
        """One document into each container of the runs (first, how many, gap), lengths in the order given."""
        out, current = [], next(lengths, None)
        for first, count, gap in runs:
            while count:
                while not left[current]:
                    current = next(lengths)
                n = min(count, int(left[current]))
                place(current, n, 1, first)
                out.append((first, n, gap - current))
                first, count = first + n, count - n
        return out

    # whole containers of one document
    if left[capacity]:
        n = int(left[capacity])
        place(capacity, n, 1, used)
        used += n
    cells = capacity // cell
    of_cell = lambda c: range(min(c * cell, capacity), max((c - 1) * cell, 0), -1)
    by_cell = np.array([0] + [left[max((c - 1) * cell, 0) + 1 : c * cell + 1].sum() for c in range(1, cells + 1)])
    by_cell[: filler // cell + 1] = 0
    if cells > 1 and by_cell.sum():
        table = patterns(cells, by_cell > 0)
        weight = np.sqrt(np.arange(cells + 1))  # long documents are harder to place than short ones
        scale = max(1.0, by_cell.sum() / 1e6)
        x = non_negative_least_squares((table * weight).T, by_cell / scale * weight) * scale
        for k in np.argsort(-x, kind="stable"):
            need = np.flatnonzero(table[k])
            repeats = int(min([np.floor(x[k] + 1e-9), *(left[list(of_cell(c))].sum() // table[k, c] for c in need)]))
            if repeats < 1:
                continue
            runs = [(used, repeats, capacity)]
            used += repeats
            for c in need[::-1]:
                for _ in range(int(table[k, c])):
                    runs = fill(runs, iter(of_cell(c)))
            for first, count, gap in runs:
                gaps[gap].append((first, count))
    # what is left goes where it fits best, the longest first
    for length in range(capacity, 0, -1):
        while left[length]:
            fits = [g for g, runs in gaps.items() if g >= length and runs]
            n = int(left[length])
            if fits:
                gap = min(fits)
                first, count = gaps[gap].pop()
            else:
                gap, first, count = capacity, used, -(-n // (capacity // length))
                used += count
            per = gap // length
            full = min(count, n // per)
            if full:
                place(length, full * per, per, first)
                gaps[gap - per * length].append((first, full))
                first, count, n = first + full, count - full, n - full * per
            if count and 0 < n < per:
                place(length, n, n, first)
                gaps[gap - n * length].append((first, 1))
                first, count = first + 1, count - 1
            if count:
                gaps[gap].append((first, count))
    if left[0]:  # items without size go round the containers
        used = max(used, 1)
        n, first = int(left[0]), 0
        while n:
            per = -(-n // used)
            full = min(n // per, used - first)
            place(0, full * per, per, first)
            n, first = n - full * per, first + full
            if n and n < per:
                place(0, n, n, first)
                n = 0
    return np.array(sorted(slots), np.int64).reshape(-1, 5), used


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int, cell: int = 16) -> DataFrame:
    """(id, piece, start, size, container_id): every item in one container, one larger than the capacity cut into
    pieces of the capacity and a rest. Sizes are whole numbers; null and negative ones count as 0. Items without an
    id are packed too. Repeated ids are packed as often as they come. An empty table gives no rows.
    """
    spark = items.sparkSession
    size = F.greatest(F.coalesce(F.col(f"`{size_col}`").cast("bigint"), F.lit(0)), F.lit(0))
    sized = cut(items.select(F.col(f"`{id_col}`").alias("id"), size.alias("whole")))  # the ranges are sampled: count tokens once
    pieces = sized.select("id", "whole", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("whole") / capacity) - 1, F.lit(0)))).alias("piece"))
    pieces = pieces.select("id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * capacity).alias("start"), F.least(F.col("whole") - F.col("piece") * capacity, F.lit(capacity)).cast("bigint").alias("size"))
    # ranges of (size, id): a size that very many items share spreads over as many partitions as it fills
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            sizes = batch.column(3).to_numpy()
            order = np.argsort(sizes, kind="stable")
            counts = np.bincount(sizes, minlength=capacity + 1)
            within = np.empty(len(sizes), np.int64)
            within[order] = np.arange(len(sizes)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(seen[sizes] + within)], names=["id", "piece", "start", "size", "part", "place"])
            seen += counts

    id_type = dict(items.dtypes)[id_col]
    ranged = pieces.repartitionByRange(n, "size", "id", "piece").withColumn("part", F.spark_partition_id())
    ranged = cut(ranged.mapInArrow(numbered, f"id {id_type}, piece int, start bigint, size bigint, part int, place bigint"))
    counts = ranged.groupBy("size", "part").agg(F.count("*").alias("n"))
    # per size and part the rank its first item has; a size lies in neighbouring parts, so there are at most
    # capacity + 1 + number of partitions rows
    here = counts.orderBy("size", "part").collect()
    histogram, before = np.zeros(capacity + 1, np.int64), {}
    for r in here:
        before[(r["part"], r["size"])] = histogram[r["size"]]
        histogram[r["size"]] += r["n"]
    slots, _ = plan_slots(histogram, cell)
    shared = spark.sparkContext.broadcast((slots, before))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, before = shared.value
        begins = np.searchsorted(slots[:, 0], np.arange(capacity + 2))
        for batch in batches:
            sizes, parts, place = (batch.column(i).to_numpy() for i in (3, 4, 5))
            pairs, back = np.unique(np.stack([parts, sizes]), axis=1, return_inverse=True)
            rank = place + np.array([before[(int(p), int(s))] for p, s in pairs.T], np.int64)[back.ravel()]
            container = np.zeros(len(sizes), np.int64)
            for s in np.unique(sizes):
                own, at = slots[begins[s] : begins[s + 1]], np.flatnonzero(sizes == s)
                hit = own[np.searchsorted(own[:, 1], rank[at], "right") - 1]
                container[at] = hit[:, 4] + (rank[at] - hit[:, 1]) // hit[:, 3]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(container)], names=["id", "piece", "start", "size", "container_id"])

    packed = ranged.mapInArrow(assign, f"id {id_type}, piece int, start bigint, size bigint, container_id bigint")
    return packed.withColumnRenamed("id", id_col)


def pack_documents(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """As `pack`, for texts sized in tokens: `start` and `size` count tokens. Null and empty texts have no tokens."""
    return pack(with_token_counts(docs, [id_col], text_col, vocabulary), id_col, "n_tokens", capacity)


def container_fill(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(container_id, items, tokens, unused) of each container."""
    filled = packed.groupBy("container_id").agg(F.count("*").alias("items"), F.sum("size").alias("tokens"))
    return filled.withColumn("unused", F.lit(capacity) - F.col("tokens"))
