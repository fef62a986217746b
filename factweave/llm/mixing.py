"""Sources mixed to target shares of the total tokens, in fixed-length blocks.

The tokens of a source stand in one row, document after document, and are cut into blocks of fixed length. Output
shards draw how many blocks each source gives them; a source's slots run through pseudorandom permutations of its
blocks, one permutation after another, so that no block comes back before all have been used and none is used more
often than allowed. Slots and blocks meet in a join by (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import BLANKS
from ..session import cut
from .tokens import VOCABULARY, with_token_counts


def quotas(blocks: np.ndarray, shares: np.ndarray, repeats: np.ndarray, total: int) -> np.ndarray:
    """How many blocks each source gives to a mix of `total` blocks: its share, or all it may give where that is
    less; what such a source can't give goes to the others by their shares. Less than `total` only if all give all."""
    most = blocks * repeats
    given = np.zeros(len(blocks), np.int64)
    free = (shares > 0) & (most > 0)
    want = float(min(total, most[free].sum()))
    exact = np.zeros(len(blocks))
    while free.any():
        part = (want - exact[~free].sum()) * shares / shares[free].sum()
        over = free & (part >= most)
        exact = np.where(free, part, exact)
        if not over.any():
            break
        exact[over] = most[over]
        free &= ~over
    given = np.minimum(np.floor(exact + 1e-9).astype(np.int64), most)
    rest = exact - given
    for k in np.argsort(-rest, kind="stable")[: int(round(want)) - int(given.sum())]:
        given[k] += given[k] < most[k]
    return given


def draw(left: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """`size` blocks drawn from what is left of each source: multinomial draws with the shares of what is left, drawn
    again where a source would give more than it has."""
    left, row = left.copy(), np.zeros(len(left), np.int64)
    while size:
        now = np.minimum(rng.multinomial(size, left / left.sum()), left)
        row, left, size = row + now, left - now, size - int(now.sum())
    return row


def shard_counts(given: np.ndarray, shard: int, seed: int, first: int = 0, last: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard number, blocks of each source in it, blocks of each source in all shards before it) of the output shards
    first..last-1 of `shard` blocks each. All shards together hold exactly what was given.

    Halves are drawn from the whole, quarters from the halves and so on, each draw seeded by its place: any range of
    shards can be told on its own, without a table of all."""
    total = int(given.sum())
    shards = -(-total // shard)

    def halves(lo: int, hi: int, own: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if hi <= first or lo >= (shards if last is None else last):
            return
        if hi - lo == 1:
            yield lo, own, before
            return
        mid = (lo + hi) // 2
        row = draw(own, (mid - lo) * shard, np.random.default_rng([seed, lo, hi]))
        yield from halves(lo, mid, row, before)
        yield from halves(mid, hi, own - row, before + row)

    if shards:
        yield from halves(0, shards, given.astype(np.int64), np.zeros(len(given), np.int64))


def permuted(index: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Where each index of 0..size-1 goes in a pseudorandom permutation: a four-round Feistel network over the next
    power of four, walked until the result lies within the range."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    while todo.any():
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(4):
            key = np.uint64((seed * 0x9E3779B97F4A7C15 + (r + 1) * 0xBF58476D1CE4E5B9) % (1 << 64))
            h = (right + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93) ^ key
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h ^ (h >> np.uint64(29))) & mask)
        out[todo] = left << np.uint64(half) | right
        todo = out >= np.uint64(size)
    return out.astype(np.int64)


def source_name(c: str):
    """A source's name as targets have it: without surrounding white space, in lower case."""
    return F.lower(F.btrim(F.col(f"`{c}`"), F.lit(BLANKS)))


def mix(docs: DataFrame, targets: DataFrame, block: int = 512, total_blocks: int | None = None, shard: int = 1024, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(shard, slot, source, block, use, doc_id, start, tokens): what each slot of the mix holds, one row for each
    stretch of a document's tokens in the slot's block; `use` counts a block's uses from 1.

    `total_blocks` defaults to as many as the documents fill. Of targets with the same name the one that sorts last
    holds; null, negative and missing shares are 0 and null repeats 1. Documents of a source without target, and
    empty or null texts, add nothing. Empty tables give no rows. The last block of a source may be shorter.

    Executors get a few numbers for each source with a target and each range partition. Slots and stretches meet in a
    sort-merge join: a block has at most `block` stretches and `max_repeats` slots, so its keys are even.
    """
    spark = docs.sparkSession
    named = targets.select(source_name("source").alias("source"), F.col("target_share").alias("share"), F.col("max_repeats").alias("repeats")).where("source is not null")
    # a row per named source: the mix's own specification
    goal = sorted(((r[0], max(r[1][0] or 0.0, 0.0), max(1 if r[1][1] is None else r[1][1], 0)) for r in named.groupBy("source").agg(F.max(F.struct("share", "repeats"))).collect()))
    names = [g[0] for g in goal]
    code = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)]) if names else F.create_map().cast("map<string,int>")
    sized = with_token_counts(docs, [id_col, source_col], text_col, vocabulary)
    # the ranges are sampled: count tokens once
    sized = cut(sized.select(F.col(id_col).alias("doc_id"), F.element_at(code, source_name(source_col)).alias("src"), "n_tokens").where("src is not null and n_tokens > 0"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.zeros(len(names), np.int64)
        for batch in batches:
            src, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            start = np.zeros(len(n), np.int64)
            for s in np.unique(src):  # the batch is sorted by source
                at = np.flatnonzero(src == s)
                total = np.cumsum(n[at])
                start[at] = ends[s] + total - n[at]
                ends[s] += total[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start)], names=["doc_id", "src", "n", "part", "start"])

    id_type = dict(docs.dtypes)[id_col]
    ranged = sized.repartitionByRange(parts, "src", "doc_id").sortWithinPartitions("src", "doc_id").withColumn("part", F.spark_partition_id())
    laid = cut(ranged.mapInArrow(lay_out, f"doc_id {id_type}, src int, n bigint, part int, start bigint"))
    # tokens of each source in each part: ranges of (source, id) make at most sources + parts rows
    offsets, totals = {}, np.zeros(len(names), np.int64)
    for r in laid.groupBy("src", "part").agg(F.sum("n").alias("n")).orderBy("src", "part").collect():
        offsets[(r["part"], r["src"])] = int(totals[r["src"]])
        totals[r["src"]] += r["n"]
    blocks = -(-totals // block)
    given = quotas(blocks, np.array([g[1] for g in goal]), np.array([g[2] for g in goal], np.int64), int(blocks.sum()) if total_blocks is None else total_blocks)
    shared = spark.sparkContext.broadcast((offsets, blocks, given))  # a number per source and range partition

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offsets = shared.value[0]
        for batch in batches:
            src, n, part, start = (batch.column(i).to_numpy() for i in range(1, 5))
            pairs, back = np.unique(np.stack([part, src]), axis=1, return_inverse=True)
            start = start + np.array([offsets[(int(p), int(s))] for p, s in pairs.T], np.int64)[back.ravel()]
            first, last = start // block, (start + n - 1) // block
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            number = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            lo, hi = np.maximum(number * block, start[row]), np.minimum((number + 1) * block, start[row] + n[row])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(src[row]), pa.array(number), pa.array(lo - start[row]), pa.array(hi - lo)], names=["doc_id", "src", "block", "start", "tokens"])

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, blocks, given = shared.value
        for batch in batches:  # shard numbers one after another
            if not batch.num_rows:
                continue
            first = batch.column(0)[0].as_py()
            for k, row, before in shard_counts(given, shard, seed, first, first + batch.num_rows):
                src = np.random.default_rng([seed, k]).permutation(np.repeat(np.arange(len(blocks)), row))
                order = np.argsort(src, kind="stable")
                nth = np.empty(len(src), np.int64)
                nth[order] = np.arange(len(src)) - np.repeat(np.cumsum(row) - row, row)
                nth += before[src]
                use, number = nth // blocks[src], nth % blocks[src]
                for s, u in np.unique(np.stack([src, use]), axis=1).T.tolist():
                    at = np.flatnonzero((src == s) & (use == u))
                    number[at] = permuted(number[at], int(blocks[s]), seed * 1_000_003 + s * 1009 + u)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(src), k)), pa.array(np.arange(len(src)) + k * shard), pa.array(src.astype(np.int32)), pa.array(number), pa.array((use + 1).astype(np.int32))], names=["shard", "slot", "src", "block", "use"])

    held = laid.mapInArrow(segments, f"doc_id {id_type}, src int, block bigint, start bigint, tokens bigint")
    shards = -(-int(given.sum()) // shard)
    drawn = spark.range(0, shards, 1, max(1, min(shards, parts))).mapInArrow(slots, "shard bigint, slot bigint, src int, block bigint, use int")
    source = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("src") + 1) if names else F.lit(None).cast("string")
    # drawn rows look few to the optimiser, but there is one for every block of the mix: never broadcast
    return drawn.hint("merge").join(held, ["src", "block"]).select("shard", "slot", source.alias("source"), "block", "use", F.col("doc_id").alias(id_col), "start", "tokens")


def mix_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, share, most_uses): what each source of the targets contributes."""
    got = cut(mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.max("use").alias("most_uses")))  # a row per source
    goal = targets.groupBy(source_name("source").alias("source")).agg(F.max(F.struct("target_share", "max_repeats")).alias("g")).where("source is not null")
    both = goal.select("source", "g.target_share", "g.max_repeats").join(got, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"))
    total = got.agg(F.sum("tokens")).head()[0] or 0
    return both.withColumn("share", F.col("tokens") / F.lit(total) if total else F.lit(0.0))
