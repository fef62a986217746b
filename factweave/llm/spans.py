"""Long stretches that stand verbatim in more than one document.

Of every stretch of `least` characters the window (a shorter run of characters) with the smallest hash is chosen, so
equal stretches choose equal windows, and about one window in fifty is looked at.

* A count-min sketch of fixed size, one per partition and merged, overestimates how many texts hold a window. A window
  estimated in one text is in one text only and goes no further; a text without any other goes no further either.
* What is left is grouped by the window's hash alone, without text: only windows of two documents go on. However full
  the sketch may be, this is all that more windows cost.
* Those windows are cut out of their texts with the characters around them and grouped exactly, by text: a stretch of
  `least` characters around a window is shared if the same stretch stands around an equal window of another document.

No two documents are ever paired: equal surroundings are one row, and a row takes from all others of its window only
how far a shared stretch reaches to the left and to the right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

_U = np.uint64
#: Odd multipliers of the rolling hash, modulo 2**64.
_BASE, _MIX = 0x9E3779B97F4A7C15, (0xD6E8FEB86659FD93, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9)
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_CELLS = 1 << 16  # cells of a sketch that are merged together


def _power(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        made = np.full(max(n, 1 << 20), base, _U)
        made[0] = 1
        held = _powers[base] = np.multiply.accumulate(made)
    return held[:n]


def _scatter(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(_MIX[0])
    x = (x ^ (x >> _U(29))) * _U(_MIX[1])
    return x ^ (x >> _U(32))


class Hashes:
    """Hashes of any run of characters of a text, from sums over its characters."""

    def __init__(self, codes: np.ndarray) -> None:
        v = (codes.astype(_U) + _U(1)) * _U(_MIX[2])
        v ^= v >> _U(31)
        v *= _power(_BASE, len(v))
        self.sums = np.zeros(len(v) + 1, _U)
        np.cumsum(v, out=self.sums[1:])
        self.back = _power(_INVERSE, len(v) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _scatter((self.sums[end] - self.sums[start]) * self.back[start])

    def windows(self, size: int) -> np.ndarray:
        """Of each run of `size` characters."""
        if len(self.sums) <= size:
            return np.zeros(0, _U)
        return _scatter((self.sums[size:] - self.sums[:-size]) * self.back[: len(self.sums) - size])


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` values the place of the smallest, by the leading 40 bits; of equal ones the first."""
    out, block = [], 1 << 20
    for a in range(0, len(values) - width + 1, block):
        part = values[a : a + block + width - 1]
        key = (part & ~_U((1 << 24) - 1)) | np.arange(len(part), dtype=_U)
        n = len(part) - width + 1
        full = np.full(-(-len(part) // width) * width, ~_U(0))
        full[: len(part)] = key
        rows = full.reshape(-1, width)
        ahead = np.minimum.accumulate(rows, axis=1).ravel()
        behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        out.append((np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & _U((1 << 24) - 1)).astype(np.int64) + a)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Chosen:
    """The chosen windows of some texts: text number, place in the joined texts, hash, and where texts begin and end."""

    def __init__(self, texts: list[str], least: int, size: int) -> None:
        codes = [_codes(t) for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
        self.hashes = Hashes(np.concatenate(codes) if codes else np.zeros(0, np.uint32))
        values = self.hashes.windows(size)
        best = _smallest(values, least - size + 1)  # by start of the stretch
        inside = np.zeros(len(best) + 1, np.int8)
        long = np.flatnonzero(np.diff(bounds) >= least)
        np.add.at(inside, bounds[long], 1)
        np.add.at(inside, bounds[long + 1] - least + 1, -1)
        best = best[np.cumsum(inside[:-1]) > 0]
        keep = np.ones(len(best), bool)
        keep[1:] = best[1:] != best[:-1]
        self.at = np.unique(best[keep])
        self.value = values[self.at]
        self.text = np.searchsorted(bounds, self.at, "right") - 1
        self.begin, self.end = bounds[self.text], bounds[self.text + 1]


def _groups(batches: Iterator[pa.RecordBatch], column: int, least: int, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows whose text is long enough, about `most` characters at a time."""
    for batch in batches:
        texts = batch.column(column).to_pylist()
        rows, total = [], 0
        for i, t in enumerate(texts):
            if t is not None and len(t) >= least:
                if total + len(t) > most and rows:
                    yield batch.take(pa.array(rows)), [texts[j] for j in rows]
                    rows, total = [], 0
                rows.append(i)
                total += len(t)
        if rows:
            yield batch.take(pa.array(rows)), [texts[j] for j in rows]


def _cells(value: np.ndarray, bits: int) -> list[np.ndarray]:
    """The cell of each hash in both rows of the sketch."""
    return [(value >> _U(64 - bits)).astype(np.int64), ((value * _U(_MIX[0])) >> _U(64 - bits)).astype(np.int64)]


def sketch(docs: DataFrame, least: int, size: int, bits: int) -> list[np.ndarray]:
    """For each row of the merged count-min sketch, packed bits: which cells have a count of two or more. A window
    counts once per text. The result has 2**bits bits a row, however large the documents are."""

    def packed_counts(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for row in (0, 1):
            cells, n = np.unique(np.concatenate(held[row]), return_counts=True)
            n = np.minimum(n, 255).astype(np.uint8)
            starts = np.flatnonzero(np.diff(cells // _CELLS, prepend=-1))
            parts = list(zip(starts, np.append(starts[1:], len(cells)), strict=True))
            for k in range(0, len(parts), 64):
                some = parts[k : k + 64]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(row << 32 | cells[a] // _CELLS) for a, _ in some], pa.int64()),
                        pa.array([(cells[a:b] % _CELLS).astype(np.uint16).tobytes() for a, b in some], pa.binary()),
                        pa.array([n[a:b].tobytes() for a, b in some], pa.binary()),
                    ],
                    names=["block", "cells", "n"],
                )

    def count(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        windows = 0
        for _, texts in _groups(batches, 1, least):
            c = Chosen(texts, least, size)
            once = np.unique(np.stack([c.text.astype(_U), c.value]), axis=1)[1] if len(c.at) else c.value
            for row, cells in enumerate(_cells(once, bits)):
                held[row].append(cells)
            windows += len(once)
            if windows >= most:  # a partition's sketch may come in parts
                yield from packed_counts(held)
                held, windows = [[], []], 0
        if windows:
            yield from packed_counts(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total = None, np.zeros(_CELLS, np.int64)

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([np.packbits(total >= 2).tobytes()], pa.binary())], names=["block", "bits"])

        for batch in batches:
            for b, cells, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if b != block:
                    if block is not None:
                        yield packed()
                    block, total = b, np.zeros(_CELLS, np.int64)
                total[np.frombuffer(cells, np.uint16)] += np.frombuffer(n, np.uint8)
        if block is not None:
            yield packed()

    parts = docs.mapInArrow(count, "block bigint, cells binary, n binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "block bigint, bits binary")
    rows = [np.zeros(max(1, (1 << bits) // _CELLS) * (_CELLS // 8), np.uint8) for _ in (0, 1)]
    for r in merged.collect():  # at most 2 * 2**bits bits
        at = (r["block"] & 0xFFFFFFFF) * (_CELLS // 8)
        rows[r["block"] >> 32][at : at + _CELLS // 8] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return rows


def _repeated(rows: list[np.ndarray], value: np.ndarray, bits: int) -> np.ndarray:
    hit = np.ones(len(value), bool)
    for row, cells in zip(rows, _cells(value, bits), strict=True):
        hit &= (row[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1).astype(bool)
    return hit


def _stretches(batch: pa.RecordBatch, least: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (w, around, left, ...): row, offset and hash of each stretch of `least` characters that holds the
    window; the offset counts the characters before the window."""
    codes = [_codes(t) for t in batch.column("around").to_pylist()]
    length = np.array([len(c) for c in codes], np.int64)
    bounds = np.concatenate([[0], np.cumsum(length)])
    hashes = Hashes(np.concatenate(codes) if codes else np.zeros(0, np.uint32))
    left = batch.column("left").to_numpy().astype(np.int64)
    right = length - left - size
    low, high = np.maximum(0, least - size - right), np.minimum(left, least - size)
    count = np.maximum(high - low + 1, 0)
    row = np.repeat(np.arange(len(codes)), count)
    offset = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = bounds[row] + left[row] - offset
    return row, offset, hashes.of(start, start + least)


def _shared_offsets(rows: pa.RecordBatch, row: np.ndarray, offset: np.ndarray, group: np.ndarray) -> dict[str, np.ndarray]:
    """Of stretches (row, offset) in groups of equal ones: for each row that shares any with another document the least
    and the largest offset it shares, and the groups of these two."""
    names = pa.chunked_array([rows.column(x).dictionary_encode().dictionary for x in "ab"]).unique()
    a, b = (pc.index_in(rows.column(x), value_set=names).to_numpy() for x in "ab")
    n = int(group.max(initial=-1)) + 1
    least_id, most_id = np.full(n, len(names)), np.full(n, -1)
    np.minimum.at(least_id, group, np.minimum(a, b)[row])
    np.maximum.at(most_id, group, np.maximum(a, b)[row])
    hit = np.flatnonzero((least_id < most_id)[group])
    hit = hit[np.lexsort((offset[hit], row[hit]))]
    first = np.flatnonzero(np.diff(row[hit], prepend=-1))
    last = np.append(first[1:], len(hit))[: len(first)] - 1
    return {"row": row[hit[first]], "low": offset[hit[first]], "high": offset[hit[last]], "groups": np.unique(np.concatenate([group[hit[first]], group[hit[last]]]))}


def _same_texts(rows: pa.RecordBatch, row: np.ndarray, offset: np.ndarray, group: np.ndarray, found: dict[str, np.ndarray], least: int) -> bool:
    """Whether the stretches of each group that decides an outcome are really equal, character by character."""
    codes = [_codes(t) for t in rows.column("around").to_pylist()]
    bounds = np.concatenate([[0], np.cumsum([len(c) for c in codes])]).astype(np.int64)
    text = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
    inside = np.zeros(int(group.max(initial=-1)) + 1, bool)
    inside[found["groups"]] = True
    at = np.flatnonzero(inside[group])
    start = bounds[row[at]] + rows.column("left").to_numpy()[row[at]] - offset[at]
    model = np.zeros(len(inside), np.int64)
    model[group[at]] = start  # any one of the group
    for k in range(0, len(at), 20_000):
        mine, other = start[k : k + 20_000, None] + np.arange(least), model[group[at[k : k + 20_000]], None] + np.arange(least)
        if (text[mine] != text[other]).any():
            return False
    return True


def _slices(rows: DataFrame, counted: DataFrame, keys: list[str], slice_rows: int, by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by keys, with a slice number: of counted(keys..., n) n is how many rows each key has. Keys with
    more than `slice_rows` rows, and more than a ten thousandth of all, hence ten thousand keys at most, are parted into
    slices by another column; the other side has a row for each slice."""
    limit = max(slice_rows, (counted.agg(F.sum("n")).head()[0] or 0) // 10_000)
    slices = F.ceil(F.col("n") / limit).cast("int")
    wide = counted.where(F.col("n") > limit).select(*keys, slices.alias("slices")).distinct()
    left = rows.join(F.broadcast(wide), keys, "left").withColumn("slice", F.pmod(F.xxhash64(by), F.coalesce("slices", F.lit(1))).cast("int")).drop("slices")
    return left, counted.withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1))).drop("n")


def _sliced_join(rows: DataFrame, counted: DataFrame, keys: list[str], slice_rows: int, by: str = "id") -> DataFrame:
    left, right = _slices(rows, counted, keys, slice_rows, by)
    return left.join(right, [*keys, "slice"])


def _sliced_semi_join(rows: DataFrame, counted: DataFrame, keys: list[str], slice_rows: int, by: str = "id") -> DataFrame:
    left, right = _slices(rows, counted, keys, slice_rows, by)
    return left.join(right, [*keys, "slice"], "left_semi").drop("slice")


def shared_spans(docs: DataFrame, least: int = 200, size: int = 100, id_col: str = "doc_id", text_col: str = "text", bits: int = 26, group_rows: int = 20_000, slice_rows: int = 200_000) -> DataFrame:
    """(id, text_key, start, length): the maximal stretches of each text in which every character lies in a run of
    `least` characters (code points, exactly as they are) that also stands in a text of another id.

    Texts that are null or shorter than `least`, and rows without an id, have none. Rows with one id are one
    document; `text_key`, a hash of the text, tells its different texts apart, and repeated rows count once.
    `size` is the window's length. The sketch has 2**bits cells a row: 8 MB as bits, whatever there is to read. A fuller
    sketch lets more windows through to the grouping by hash, and loses none.

    `group_rows`: windows with more different surroundings than a batch should hold have their stretches grouped one by
    one over all tasks. `slice_rows`: windows, or surroundings, with more rows than that, and more than a ten
    thousandth of all, are joined in slices. Neither changes the result.
    """
    spark = docs.sparkSession
    reach = least - size
    plain = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id is not null and text is not null")
    id_type = dict(plain.dtypes)["id"]
    shared = spark.sparkContext.broadcast(sketch(plain, least, size, bits))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts with windows estimated repeated, and the hashes of these, 8 bytes each."""
        for batch, texts in _groups(batches, 1, least):
            c = Chosen(texts, least, size)
            keep = _repeated(shared.value, c.value, bits)
            text, value = c.text[keep], c.value[keep]
            rows, starts = np.unique(text, return_index=True)
            packed = [np.unique(x).tobytes() for x in np.split(value, starts[1:])] if len(rows) else []
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(rows)).columns, pa.array(packed, pa.binary())], names=["id", "text", "k1", "k2", "windows"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = [np.frombuffer(x, np.int64) for x in batch.column(3).to_pylist()]
            if windows:
                row = pa.array(np.repeat(np.arange(len(windows)), [len(x) for x in windows]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(windows)), *(batch.column(k).take(row) for k in range(3))], names=["w", "id", "k1", "k2"])

    # two hashes name a text: what stands in several documents word for word is looked at once, with their least and
    # largest id
    keyed = plain.select("id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    marked = cut(keyed.mapInArrow(mark, f"id {id_type}, text string, k1 bigint, k2 bigint, windows binary"))
    lean = marked.select("id", "k1", "k2", "windows").mapInArrow(unpack, f"w bigint, id {id_type}, k1 bigint, k2 bigint")
    twice = cut(lean.groupBy("w").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).where("a <> b").select("w", "n"))
    hits = _sliced_semi_join(lean, twice, ["w"], slice_rows)
    # a text comes with its own windows: as many as its length allows
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    both = marked.select("k1", "k2", "id", "text", nothing("bigint", "w")).unionByName(hits.select("k1", "k2", nothing(id_type, "id"), nothing("string", "text"), "w"))
    whole_texts = both.groupBy("k1", "k2").agg(F.first("text", True).alias("text"), F.min("id").alias("a"), F.max("id").alias("b"), F.collect_set("w").alias("ws"))
    whole_texts = whole_texts.where("size(ws) > 0").select("k1", "k2", "text", "a", "b", "ws")

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _groups(batches, 2, least):
            c = Chosen(texts, least, size)
            wanted = batch.column(5)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(wanted.offsets.to_numpy()))
            # a window of a text is wanted if (text, hash) is among the pairs asked for
            pair = lambda t, v: _scatter(v.view(_U) ^ (t.astype(_U) * _U(_MIX[1])))
            keep = np.flatnonzero(np.isin(pair(c.text, c.value), pair(owner, wanted.flatten().to_numpy())))
            at, text, begin, end = c.at[keep], c.text[keep], c.begin[keep], c.end[keep]
            left, right = np.minimum(at - begin, reach), np.minimum(end - at - size, reach)
            around = c.hashes.of(at - left, at + size + right) ^ _scatter((left * 4096 + right).astype(_U))
            for a in range(0, len(keep), 20_000):
                k = slice(a, a + 20_000)
                low, high = at[k] - begin[k] - left[k], at[k] - begin[k] + size + right[k]
                cutout = [texts[t][x:y] for t, x, y in zip(text[k].tolist(), low.tolist(), high.tolist(), strict=True)]
                own = batch.take(pa.array(text[k]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.value[keep[k]].view(np.int64)), pa.array(around[k].view(np.int64)), *(own.column(x) for x in ("k1", "k2", "a", "b")), pa.array(at[k] - begin[k]), pa.array(left[k].astype(np.int32)), pa.array(right[k].astype(np.int32)), pa.array(cutout, pa.string())],
                    names=["w", "c", "k1", "k2", "a", "b", "at", "left", "right", "around"],
                )

    cutouts = whole_texts.mapInArrow(surroundings, f"w bigint, c bigint, k1 bigint, k2 bigint, a {id_type}, b {id_type}, at bigint, left int, right int, around string")
    found = cut(cutouts.withColumn("d", F.xxhash64("around")), twice)
    members = cut(marked.select("k1", "k2", "id").distinct(), marked)

    # one row for each window with its surroundings, told apart by their text, and which windows are in two documents
    group = ["w", "c", "d"]  # names a group of equal surroundings by 192 bits of three hashes
    same = cut(found.groupBy(*group, "left", "around").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count("*").alias("n"), F.max("right").alias("right")))
    windows = same.groupBy("w").agg(F.min("a").alias("wa"), F.max("b").alias("wb"), F.count("*").alias("rows"), F.count_if(F.expr("a = b")).alias("open"))
    # windows of two documents with surroundings that only one document has
    unsure = cut(windows.where("wa <> wb and open > 0").select("w", "rows"))

    def reaches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by window; about group_rows at a time, never parting those of one window."""
        held: list[pa.RecordBatch] = []

        def solve(rows: pa.RecordBatch) -> pa.RecordBatch:
            row, offset, value = _stretches(rows, least, size)
            w = rows.column("w").to_numpy().view(_U)
            key = _scatter(value ^ (w[row] * _U(_MIX[1])) ^ offset.astype(_U))
            group = np.unique(key, return_inverse=True)[1]
            found = _shared_offsets(rows, row, offset, group)
            if not _same_texts(rows, row, offset, group, found, least):  # equal hashes of different texts
                texts, left = rows.column("around").to_pylist(), rows.column("left").to_pylist()
                names: dict = {}
                group = np.array([names.setdefault((w[r], o, texts[r][left[r] - o : left[r] - o + least]), len(names)) for r, o in zip(row.tolist(), offset.tolist(), strict=True)], np.int64)
                found = _shared_offsets(rows, row, offset, group)
            out, low, high = (found[k] for k in ("row", "low", "high"))
            take = pa.array(out)
            return pa.RecordBatch.from_arrays([*(rows.column(x).take(take) for x in ("w", "c", "d")), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))], names=["w", "c", "d", "low", "high"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= group_rows:
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                w = rows.column("w").to_numpy()
                edge = int(np.searchsorted(w, w[-1]))
                if edge:
                    yield solve(rows.slice(0, edge))
                held = [rows.slice(edge)]
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks().to_batches()[0]) if sum(x.num_rows for x in held) else pa.RecordBatch.from_pylist([], pa.schema([(x, pa.int64()) for x in ("w", "c", "d")] + [(x, pa.int32()) for x in ("low", "high")]))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                some = batch.slice(k, 1000)
                row, offset, _ = _stretches(some, least, size)
                texts, left = some.column("around").to_pylist(), some.column("left").to_pylist()
                stretch = [texts[r][left[r] - o : left[r] - o + least] for r, o in zip(row.tolist(), offset.tolist(), strict=True)]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(some.column(x).take(take) for x in ("w", "c", "d", "a", "b")), pa.array(offset.astype(np.int32)), pa.array(stretch, pa.string())], names=["w", "c", "d", "a", "b", "o", "stretch"])

    schema = "w bigint, c bigint, d bigint, low int, high int"
    columns = [*group, "a", "b", "left", "around"]
    usual = same.join(unsure.where(F.col("rows") <= group_rows), "w", "left_semi").select(*columns)
    partly = usual.repartition("w").sortWithinPartitions("w").mapInArrow(reaches, schema)
    # a window with very many different surroundings: its stretches are grouped one by one, over all tasks
    crowded = same.join(unsure.where(F.col("rows") > group_rows), "w", "left_semi").select(*columns)
    crowded = crowded.mapInArrow(explode, f"w bigint, c bigint, d bigint, a {id_type}, b {id_type}, o int, stretch string")
    common = crowded.groupBy("w", "o", "stretch").agg(F.min("a").alias("a"), F.max("b").alias("b")).where("a <> b").select("w", "o", "stretch")
    spread = crowded.join(common, ["w", "o", "stretch"], "left_semi").groupBy(*group).agg(F.min("o").alias("low"), F.max("o").alias("high"))
    # surroundings that two documents have are shared as a whole
    whole = same.where("a <> b").select(*group, F.greatest(F.lit(0), F.lit(reach) - F.col("right")).alias("low"), F.least("left", F.lit(reach)).alias("high"))
    result = whole.unionByName(partly).unionByName(spread).groupBy(*group).agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <= high")
    result = cut(result.join(same.select(*group, "n"), group), same, unsure)

    occurring = found.select(*group, "k1", "k2", "at")
    spans = _sliced_join(occurring, result, group, slice_rows, by="k1").select("k1", "k2", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + least).alias("end")).distinct()
    earlier = "partition by k1, k2 order by start, end rows between unbounded preceding and"
    joined = spans.withColumn("reached", F.expr(f"max(end) over ({earlier} 1 preceding)"))
    joined = joined.withColumn("piece", F.expr(f"sum(int(reached is null or start > reached)) over ({earlier} current row)"))
    pieces = joined.groupBy("k1", "k2", "piece").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("piece")
    held_by = members.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    pieces = cut(pieces.join(held_by, ["k1", "k2"]), found, result)
    out = _sliced_join(members, pieces, ["k1", "k2"], slice_rows)
    return out.select(F.col("id").alias(id_col), F.col("k1").alias("text_key"), "start", (F.col("end") - F.col("start")).alias("length"))


def shared_chars(docs: DataFrame, least: int = 200, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, shared_chars): how many characters of each document also stand in another one; documents without any
    have no row."""
    spans = shared_spans(docs, least, id_col=id_col, text_col=text_col, **how)
    return spans.groupBy(id_col).agg(F.sum("length").cast("bigint").alias("shared_chars"))
