"""Hierarchical residual packing of token sequences into bins of fixed capacity.

Every partition packs its own pieces best-fit, longest first. Bins that are
nearly full are done. The others become items themselves: they meet those of
other partitions, are packed best-fit again, and so on up a tree, each of
whose tasks gets a bounded number of items. A bin keeps its place inside the
bin it went into, so a piece's final offset is the sum along its way.

Null texts count as empty ones (one piece of one token, the end id). A
document longer than the capacity is cut into pieces of exactly the capacity,
but for its first, which takes the remainder. Repeated rows are packed like
any others; other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.bpe import codec, slices
from thicket.llm.common import cut, small_batches

#: A bin that lacks at most so many tokens is done.
NEARLY = 8
#: About so many pieces are packed together at first.
LOCAL = 20_000
#: At most so many bins meet in one task of a later round.
MEET = 200_000
ROUNDS = 6


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter than the capacity, if there are several."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and with ``keep_ids`` token_ids) of every document's pieces."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        own = codec(path)
        for batch in batches:
            for part, texts in slices(batch, text_col):
                rows: tuple[list, ...] = ([], [], [], [], [], [])
                for row, ids in enumerate(own.packed(texts)):
                    ids += end
                    for k, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                        own_ids = ids[4 * start : 4 * (start + length)]
                        for to, value in zip(rows, (row, k, start, length, zlib.crc32(own_ids), own_ids), strict=True):
                            to.append(value)
                arrays = [part[id_col].take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:5])]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array([np.frombuffer(b, "<u4").astype(np.int32) for b in rows[5]], pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, piece int, start long, length long, ids_crc32 long" + (", token_ids array<int>" if keep_ids else ""))


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best fit, longest first: each item's bin and offset, and each bin's fill.

    Open bins lie in stacks by what they have left; a bit mask of the stacks
    that aren't empty gives the tightest that fits at once.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    mask = 0
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        above = mask >> size
        if above:
            left = size + (above & -above).bit_length() - 1
            at = stacks[left].pop()
            if not stacks[left]:
                mask &= ~(1 << left)
        else:
            left, at = capacity, len(fills)
            fills.append(0)
        bins[item], offsets[item] = at, fills[at]
        fills[at] += size
        left -= size
        if left:
            stacks[left].append(at)
            mask |= 1 << left
    return bins, offsets, fills


def _pack_partition(batches: Iterable[pa.RecordBatch], capacity: int, level: int) -> Iterator[pa.RecordBatch]:
    """Packs all rows (item, size) of a partition; adds bin, bin_offset and fill."""
    whole = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if whole is None or not whole.num_rows:
        return
    bins, offsets, fills = best_fit(whole["size"].to_numpy(), capacity)
    ids = bins + (level << 56) + (TaskContext.get().partitionId() << 32)
    out = pa.table([whole["item"], pa.array(ids), pa.array(offsets), pa.array(np.array(fills, np.int64)[bins])], ["item", "bin", "bin_offset", "fill"])
    yield from out.to_batches(max_chunksize=100_000)


def _pack(items: DataFrame, capacity: int, level: int) -> DataFrame:
    kind = items.schema["item"].dataType.simpleString()
    return items.mapInArrow(lambda b: _pack_partition(b, capacity, level), f"item {kind}, bin long, bin_offset long, fill long")


def pack(items: DataFrame, capacity: int, size_col: str = "length") -> DataFrame:
    """Adds sequence_id and offset to every row of ``items``; no size may exceed the capacity.

    Items are split over partitions at random places, so an equal share of
    long and short ones meets in each.
    """
    spark = items.sparkSession
    columns = items.columns
    n = items.count()
    if not n:
        return items.select("*", F.lit(None).cast("long").alias("sequence_id"), F.lit(None).cast("long").alias("offset"))
    parts = max(1, -(-n // LOCAL))
    spread = items.repartition(parts)
    first = cut(_pack(spread.select(F.struct(*columns).alias("item"), F.col(size_col).cast("long").alias("size")), capacity, 0))
    placed = first.select("item.*", "bin", "bin_offset")
    short = first.filter(F.col("fill") < capacity - NEARLY).select("bin", "fill").distinct()
    open_bins = cut(short)
    left = open_bins.count()
    for level in range(1, ROUNDS + 1):
        fewer = max(1, -(-left // MEET), parts // 16)
        if left < 2 or (fewer >= parts and level > 1) or (parts == 1 and level == 1):
            break
        merged = cut(_pack(open_bins.select(F.col("bin").alias("item"), F.col("fill").alias("size")).repartition(fewer), capacity, level))
        step = merged.select(F.col("item").alias("bin"), F.col("bin").alias("to"), F.col("bin_offset").alias("more"))
        placed = placed.join(step, "bin", "left").select(*columns, F.coalesce("to", "bin").alias("bin"), (F.col("bin_offset") + F.coalesce("more", F.lit(0))).alias("bin_offset"))
        open_bins = merged.filter(F.col("fill") < capacity - NEARLY).select("bin", "fill").distinct()
        parts, left = fewer, open_bins.count()
    return placed.select(*columns, F.col("bin").alias("sequence_id"), F.col("bin_offset").alias("offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Tokenises every document, cuts those over the capacity, and packs all pieces."""
    return pack(cut(pieces(docs, path, capacity, end_id, keep_ids=keep_ids)), capacity)
