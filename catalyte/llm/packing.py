"""Best-fit-decreasing packing of token documents into fixed-length sequences.

Lengths are whole numbers up to the capacity, so the decisions of best-fit
decreasing depend on the histogram of lengths alone. The driver runs the
algorithm on that histogram (at most ``capacity`` rows, whatever the input):
a segment tree over remaining capacities finds the tightest open bin in
logarithmic time, and bins or documents that are alike are moved together. What
it returns is a list of segments "pieces of this size with ranks from .. go to
bins from .. at this offset"; pieces learn their rank from per-bucket counts,
so no sort or single task ever sees all rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import durable, encoder, slices, texts_of, tidy

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Runs of open bins by remaining capacity; a segment tree over capacities
    finds the smallest one that still holds a given size."""

    def __init__(self, capacity: int):
        self.width = 1 << (capacity + 1).bit_length()
        self.tree = [0] * (2 * self.width)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        at = room + self.width
        while at:
            self.tree[at] += by
            at >>= 1

    def push(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.runs[room].append((first, count))
            self._add(room, 1)

    def tightest(self, size: int) -> tuple[int, int, int] | None:
        """Takes a run (room, first bin, count) of the smallest room >= size."""
        at = size + self.width
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.width:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.width
        first, count = self.runs[room].pop()
        self._add(room, -1)
        return room, first, count


def best_fit_plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over ``histogram`` (length -> pieces).

    Rows (size, rank0, items, per_bin, bin0, offset0): the pieces of this size
    with ranks rank0 .. rank0+items-1 go per_bin by per_bin into the bins from
    bin0, the first of each bin at offset0.
    """
    bins, segments, fresh = OpenBins(capacity), [], 0
    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            taken = bins.tightest(size)
            if taken is None:
                room, first, count = capacity, fresh, -(-left // (capacity // size))
                fresh += count
            else:
                room, first, count = taken
            # A bin that takes a piece and could hold another is then the tightest.
            per = room // size
            whole = min(count, left // per)
            for used, each in ((whole, per), (1, left - whole * per)):
                if used and each and count and left:
                    if each > per:
                        continue
                    items = used * each
                    segments.append((size, rank, items, each, first, capacity - room))
                    bins.push(room - each * size, first, used)
                    first, count, left, rank = first + used, count - used, left - items, rank + items
            bins.push(room, first, count)
    return np.array(segments, np.int64).reshape(-1, 6)


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """The pieces of every document: its ids and ``end_id``, cut only if longer
    than ``capacity``; then every piece but the first is full."""

    def work(batches):
        tail = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text"):
                rows: list[tuple] = []
                ids = encoder(tokenizer_path).encode(texts_of(batch.column("text")))
                for doc, raw in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                    raw += tail
                    n, start, piece = len(raw) // 4, 0, 0
                    while start < n:
                        length = (n - start) % capacity or capacity
                        rows.append((doc, piece, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)])))
                        start, piece = start + length, piece + 1
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(work, encodes=True), PIECES)


def place(pieces: DataFrame, capacity: int = 2048, per_bucket: int = 100_000) -> DataFrame:
    """``pieces`` (with a column length of 1 to ``capacity``) with sequence_id
    and offset. ``pieces`` must be a checkpointed or written table. Rows without
    a doc_id are placed like others; equal rows get places of their own; which of
    equally long pieces goes where is decided by a hash of their columns, then by
    doc_id and piece; without rows nothing is placed."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError("a piece is longer than the capacity")
    plan = best_fit_plan(histogram, capacity)
    if len(plan) > 4 * capacity * capacity:
        raise ValueError("the plan exceeds its bound")
    shared = spark.sparkContext.broadcast((plan[:, 0] << 44 | plan[:, 1], plan))
    buckets = max(1, -(-sum(histogram.values()) // per_bucket))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("bucket", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # New names: both sides of the cogroup come from one table.
    bases = counts.select(F.col("bucket").alias("b"), F.col("length").alias("size"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def work(rows: pa.Table, base: pa.Table) -> pa.Table:
        starts, segments = shared.value
        first = np.zeros(capacity + 1, np.int64)
        first[base["size"].to_numpy()] = base["base"].to_numpy()
        rows = rows.sort_by([("length", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        size = rows["length"].to_numpy()
        begin = np.flatnonzero(np.diff(size, prepend=-1))
        rank = np.arange(len(size)) - np.repeat(begin, np.diff(np.append(begin, len(size)))) + first[size]
        s = _segment(starts, segments, size, rank)
        local = rank - s[:, 1]
        kept = rows.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", pa.array(s[:, 4] + local // s[:, 3])).append_column("offset", pa.array(s[:, 5] + local % s[:, 3] * size))

    return keyed.groupBy("bucket").cogroup(bases.groupBy("b")).applyInArrow(work, PIECES + ", sequence_id long, offset long")


def _segment(starts: np.ndarray, segments: np.ndarray, size: np.ndarray, rank: np.ndarray) -> np.ndarray:
    order = np.argsort(starts, kind="stable")
    return segments[order[np.searchsorted(starts[order], size << 44 | rank, side="right") - 1]]


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Packs ``docs`` into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset. Null and empty texts are documents of one token; repeated rows are
    packed each; an empty table gives no rows; other columns are ignored.
    """
    return place(durable(token_pieces(docs, tokenizer_path, capacity, end_id)), capacity)
