"""Hierarchical packing of documents into sequences of several lengths.

Within a cell of documents, whole windows of the longest tier are cut off first.
What is left of a document is routed to the shortest tier it fits, every tier is
packed from the longest down, and the gap of a window is filled with the largest
rests of shorter tiers that fit, at last with a cut of one. The windows that the
cell's end leaves open are split into lengths that are powers of two, which need
no padding. Sequences are dealt to step groups of nearly equal token counts.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import token_bytes


@dataclass(frozen=True)
class Tiers:
    """``lengths`` are powers of two, longest first; ``cell_tokens`` is what a task packs at a time, ``step_tokens`` a step group."""

    lengths: tuple[int, ...] = (1024, 512, 256, 128, 64)
    cell_tokens: int = 1 << 21
    step_tokens: int = 1 << 16


class Shelf:
    """Rests of documents by length, to take the longest up to a limit."""

    def __init__(self, longest: int):
        self.by_length: list[list[tuple[int, int]]] = [[] for _ in range(longest + 1)]
        self.longest = longest

    def put(self, length: int, doc: int, start: int) -> None:
        self.by_length[length].append((doc, start))
        self.longest = max(self.longest, length)

    def take(self, limit: int) -> tuple[int, int, int] | None:
        """``(length, doc, start)`` of a longest rest of at most ``limit`` tokens."""
        for length in range(min(limit, self.longest), 0, -1):
            if self.by_length[length]:
                return length, *self.by_length[length].pop()
        return None

    def take_longest(self) -> tuple[int, int, int] | None:
        while self.longest and not self.by_length[self.longest]:
            self.longest -= 1
        return self.take(self.longest)


def packed(lengths: list[int], tiers: Tiers) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces ``(document, start, length)`` that hold every token of the documents once.

    Each sequence is full at one of the tiers, but for the last few: their lengths
    are powers of two.
    """
    top = tiers.lengths[0]
    shelf, sequences = Shelf(top), []
    for doc, n in enumerate(lengths):
        whole = n // top * top
        sequences += [[(doc, at, top)] for at in range(0, whole, top)]
        if n > whole:
            shelf.put(n - whole, doc, whole)
    while first := shelf.take_longest():
        length, doc, start = first
        window = min(t for t in tiers.lengths if t >= length)
        pieces, gap = [(doc, start, length)], window - length
        while gap and (more := shelf.take(gap)):
            pieces.append((more[1], more[2], more[0]))
            gap -= more[0]
        if gap and (longer := shelf.take_longest()):  # nothing fits whole: cut
            length, doc, start = longer
            pieces.append((doc, start, gap))
            shelf.put(length - gap, doc, start + gap)
            gap = 0
        sequences += [pieces] if not gap else _binary(pieces)
    return sequences


def _binary(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """The pieces in their order as sequences whose lengths are the powers of two of their sum."""
    left, out, queue = sum(p[2] for p in pieces), [], list(pieces)
    while left:
        room, sequence = 1 << (left.bit_length() - 1), []
        left -= room
        while room:
            doc, start, length = queue.pop(0)
            n = min(room, length)
            sequence.append((doc, start, n))
            room -= n
            if n < length:
                queue.insert(0, (doc, start + n, length - n))
        out.append(sequence)
    return out


def step_groups(sizes: list[int], step_tokens: int) -> list[int]:
    """A group for each sequence: longest first, each to the group with the fewest tokens so far."""
    import heapq

    groups = max(1, -(-sum(sizes) // step_tokens))
    heap = [(0, g) for g in range(groups)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        tokens, g = heapq.heappop(heap)
        out[i] = g
        heapq.heappush(heap, (tokens + sizes[i], g))
    return out


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"


def _cells(tokenizer: str, end_id: int, tiers: Tiers, with_ids: bool) -> Callable:
    end = np.array([end_id], "<u4").tobytes()

    def rows(first: int, group: int, names: list, docs: list[bytes]) -> tuple[pa.RecordBatch, int, int]:
        sequences = packed([len(d) // 4 for d in docs], tiers)
        sizes = [sum(p[2] for p in s) for s in sequences]
        groups = step_groups(sizes, tiers.step_tokens)
        out = {k.split()[0]: [] for k in PIECES.split(", ")} | ({"ids": []} if with_ids else {})
        for i, sequence in enumerate(sequences):
            offset = 0
            for doc, start, length in sequence:
                ids = docs[doc][4 * start : 4 * (start + length)]
                for k, v in zip(out, (names[doc], start, length, zlib.crc32(ids), len(docs[doc]) // 4, first + i, offset, sizes[i], group + groups[i], ids)):
                    out[k].append(v)
                offset += length
        kinds = {k: pa.int64() for k in out} | {"tier": pa.int32()} | ({"ids": pa.binary()} if with_ids else {})
        return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for k, v in out.items()], list(out)), first + len(sequences), group + max(groups) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = group = TaskContext.get().partitionId() << 40
        names, docs, n = [], [], 0
        for batch in batches:
            texts = batch.column(1)
            tokens = token_bytes(tokenizer, texts)
            for name, t in zip(batch.column(0).to_pylist(), tokens, strict=True):
                names.append(name)
                docs.append(t + end)
                n += len(docs[-1]) // 4
                if n >= tiers.cell_tokens:
                    found, first, group = rows(first, group, names, docs)
                    yield found
                    names, docs, n = [], [], 0
            del batch, texts, tokens  # else it stays while the next one is read
        if docs:
            yield rows(first, group, names, docs)[0]

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, tiers: Tiers = Tiers(), with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group`` and ``ids``.

    A document is the tokens of its whole text (null: none) and the end id; each
    token lies in one piece. ``tier`` is the sequence's length, a power of two, so
    nothing is padded. A row that repeats is packed as often. Runs where the
    documents lie, without a shuffle: a cell is up to ``cell_tokens`` tokens of a
    partition and the document that crosses that; step groups are balanced within it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(_cells(tokenizer, end_id, tiers, with_ids), PIECES + ", ids binary" * with_ids)
