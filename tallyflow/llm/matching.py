"""Best-fit packing with large items matched first.

The lengths of all pieces, not the documents, decide the packing: of each length there
are so many, and how many sequences hold which lengths depends on these counts alone, one
for each length up to the capacity. Pieces above a third of the capacity go at
most two to a sequence; a greedy matching, longest first, each with the longest partner
that fits, makes as many pairs as there can be. Shorter pieces then fill the tightest gap
they fit, longest first, and what no gap takes opens new sequences. Documents get their
places by their number among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import token_bytes
from tallyflow.session import settle

#: ``length, first, count, sequence, offset``: pieces ``first`` to ``first + count`` of a length lie at ``offset`` of sequences from ``sequence`` on.
Run = tuple[int, int, int, int, int]


def partners(left: list[int], capacity: int) -> Iterator[tuple[int, int, int]]:
    """``longer, shorter, pairs`` of large pieces, longest first; ``shorter`` is 0 for those that stay alone. Uses ``left`` up."""
    third = capacity // 3
    partner = capacity
    for length in range(capacity, third, -1):
        while left[length]:
            partner = min(length, capacity - length)
            while partner > third and left[partner] < 1 + (partner == length):
                partner -= 1
            if partner <= third:
                yield length, 0, left[length]
                left[length] = 0
            else:
                pairs = left[length] // 2 if partner == length else min(left[length], left[partner])
                left[length] -= pairs
                left[partner] -= pairs
                yield length, partner, pairs


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Where the pieces of every length go. The number of runs follows the capacity, not the number of pieces."""
    left = [counts.get(n, 0) for n in range(capacity + 1)]
    placed, runs, sequences = [0] * (capacity + 1), [], 0
    shelves: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # sequences by gap: the first and how many
    gaps = 0  # bit g: a shelf of gap g holds sequences

    def put(length: int, count: int, sequence: int, offset: int) -> None:
        runs.append((length, placed[length], count, sequence, offset))
        placed[length] += count

    def shelve(gap: int, sequence: int, count: int) -> None:
        nonlocal gaps
        if gap:
            shelves[gap].append((sequence, count))
            gaps |= 1 << gap

    for longer, shorter, pairs in partners(left, capacity):
        put(longer, pairs, sequences, 0)
        if shorter:
            put(shorter, pairs, sequences, longer)
        shelve(capacity - longer - shorter, sequences, pairs)
        sequences += pairs
    for length in range(capacity // 3, 0, -1):
        while left[length]:
            fitting = gaps >> length
            if fitting:
                gap = length + (fitting & -fitting).bit_length() - 1
                sequence, count = shelves[gap].pop()
                n = min(count, left[length])
                if n < count:
                    shelves[gap].append((sequence + n, count - n))
                elif not shelves[gap]:
                    gaps &= ~(1 << gap)
                put(length, n, sequence, capacity - gap)
                shelve(gap - length, sequence, n)
            else:
                each = min(capacity // length, left[length])
                n = left[length] // each
                for k in range(each):
                    put(length, n, sequences, k * length)
                shelve(capacity - each * length, sequences, n)
                sequences += n
                left[length] -= each * n
                continue
            left[length] -= n
    return runs


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def _cutter(tokenizer: str, end_id: int, capacity: int, with_ids: bool) -> Callable:
    end = np.array([end_id], "<u4").tobytes()
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for name, tokens in zip(batch.column(0).to_pylist(), token_bytes(tokenizer, batch.column(1)), strict=True):
                tokens += end
                for piece, at in enumerate(range(0, len(tokens), 4 * capacity)):
                    ids = tokens[at : at + 4 * capacity]
                    length = len(ids) // 4
                    rows.append((name, piece, at // 4, length, zlib.crc32(ids), part, seen[length], ids)[: len(names)])
                    seen[length] += 1
            del batch  # else it stays while the next one is read
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * len(kinds), kinds, strict=True)], names)

    return cut


def _placer(runs: list[Run], capacity: int) -> Callable:
    table = np.array(sorted(runs), np.int64).reshape(-1, 5)
    # Pieces of a length are numbered from 0, so runs of a length are told apart by where they begin.
    lengths = np.searchsorted(table[:, 0], np.arange(capacity + 2))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            run = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                mine = length == n
                run[mine] = lengths[n] + np.searchsorted(table[lengths[n] : lengths[n + 1], 1], number[mine], "right") - 1
            sequence = table[run, 3] + number - table[run, 1]
            kept = [c for c in batch.schema.names if c != "number"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(table[run, 4])], [*kept, "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all pieces, and ``ids`` (little-endian unsigned 32-bit).

    A document is the tokens of its whole text (null: none) and the end id; only one
    above ``capacity`` is cut, into pieces of that length and a rest. Documents of the
    same length are told apart by scan task and their order there, so neither equal rows,
    null or repeated ids nor a third of all rows of one length matter. No rows give none.

    Tokens are made where the texts lie and only the pieces are written. What the driver
    holds is a count for each length and the runs of ``plan``, both bounded by the
    capacity. Sequences are numbered from 0; how many there are doesn't depend on the order of rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    pieces = settle(rows.mapInArrow(_cutter(tokenizer, end_id, capacity, with_ids), PIECES + ", ids binary" * with_ids), "pieces")
    parts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = settle(parts.select("part", "length", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "lengths")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    numbered = pieces.join(parts.drop("n"), ["part", "length"]).withColumn("number", F.col("before") + F.col("nth"))
    out = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids + ", sequence_id bigint, offset bigint"
    return numbered.select(*out, "number").mapInArrow(_placer(plan(counts, capacity), capacity), schema)
