"""Token ids as files of bit or byte planes.

A file holds whole documents: a header, an index of its chunks, an index of its
documents, and the chunks. A chunk is a block of ``chunk_ids`` ids (the last of a
file may be shorter) turned into planes, bits or bytes of the same weight
together, each compressed on its own with zstandard; planes of zeros alone are
not stored. Files are rows of a Parquet table, so any store Spark reaches will do.

Layout, little-endian: ``TFBP``, u8 version 1, u8 kind (1 bit, 2 byte planes), u16
planes per chunk at most, u32 chunk_ids, u64 ids, u32 chunks, u32 documents; per
chunk u64 offset in the body, u32 ids, u32 per plane its compressed bytes (0: all
zero); per document u64 first id; then the body.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import token_bytes
from tallyflow.session import settle

HEAD = "<4sBBHIQII"
PLANES = {"bit": (1, 32), "byte": (2, 4)}


def to_planes(ids: np.ndarray, kind: str) -> np.ndarray:
    """Planes of unsigned 32-bit ids, the lightest first: ``(32, ceil(n / 8))`` for bits, ``(4, n)`` for bytes."""
    as_bytes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return np.ascontiguousarray(as_bytes.T)
    return np.packbits(np.unpackbits(as_bytes, axis=1, bitorder="little").T, axis=1)


def from_planes(planes: np.ndarray, n: int, kind: str) -> np.ndarray:
    if kind == "byte":
        return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)
    bits = np.unpackbits(planes, axis=1, count=n)
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u4").reshape(-1)


def write_file(documents: list[bytes], kind: str = "byte", chunk_ids: int = 1 << 16, level: int = 3) -> bytes:
    """The file of some documents' ids, each given as little-endian unsigned 32-bit bytes."""
    number, most = PLANES[kind]
    firsts = np.cumsum([0] + [len(d) // 4 for d in documents])
    ids = np.frombuffer(b"".join(documents), "<u4")
    pack = zstandard.ZstdCompressor(level=level)
    index, body, at = [], [], 0
    for start in range(0, len(ids), chunk_ids):
        block = ids[start : start + chunk_ids]
        planes = [pack.compress(p.tobytes()) if p.any() else b"" for p in to_planes(block, kind)]
        index.append(struct.pack(f"<QI{most}I", at, len(block), *map(len, planes)))
        body += planes
        at += sum(map(len, planes))
    head = struct.pack(HEAD, b"TFBP", 1, number, most, chunk_ids, len(ids), len(index), len(documents))
    return b"".join([head, *index, firsts[:-1].astype("<u8").tobytes(), *body])


def read_file(data: bytes) -> Iterator[bytes]:
    """The documents of a file in order."""
    magic, version, number, most, chunk_ids, total, chunks, documents = struct.unpack_from(HEAD, data)
    if magic != b"TFBP" or version != 1:
        raise ValueError("not a file of token planes")
    kind = next(k for k, v in PLANES.items() if v[0] == number)
    entry = struct.Struct(f"<QI{most}I")
    firsts_at = struct.calcsize(HEAD) + chunks * entry.size
    body_at = firsts_at + 8 * documents
    unpack = zstandard.ZstdDecompressor()
    ids = np.empty(total, "<u4")
    for k in range(chunks):
        at, n, *sizes = entry.unpack_from(data, struct.calcsize(HEAD) + k * entry.size)
        width = n if kind == "byte" else (n + 7) // 8
        planes = np.zeros((most, width), np.uint8)
        at += body_at
        for p, size in enumerate(sizes):
            if size:
                planes[p] = np.frombuffer(unpack.decompress(data[at : at + size], max_output_size=width), np.uint8)
            at += size
        ids[k * chunk_ids : k * chunk_ids + n] = from_planes(planes, n, kind)
    firsts = np.append(np.frombuffer(data, "<u8", documents, firsts_at), total).astype(np.int64)
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        yield ids[a:b].tobytes()


FILES = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("data", pa.binary())])
FILES_DDL = "part int, file int, n_ids bigint, doc_ids array<bigint>, data binary"


def _writer(path: str, end_id: int, kind: str, chunk_ids: int, file_ids: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, ids, docs, n = TaskContext.get().partitionId(), 0, [], [], 0
        end = struct.pack("<I", end_id)

        def flush():
            row = {"part": part, "file": file, "n_ids": n, "doc_ids": ids, "data": write_file(docs, kind, chunk_ids)}
            return pa.RecordBatch.from_pylist([row], schema=FILES)

        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            tokens = token_bytes(path, texts)
            for name, t in zip(names.to_pylist(), tokens, strict=True):
                ids.append(name)
                docs.append(t + end)
                n += len(docs[-1]) // 4
                if n >= file_ids:
                    yield flush()
                    file, ids, docs, n = file + 1, [], [], 0
            del batch, names, texts, tokens  # else it stays while the next one is read
        if docs:
            yield flush()

    return write


def write(docs: DataFrame, tokenizer: str, end_id: int = 2, kind: str = "byte", chunk_ids: int = 1 << 16, file_ids: int = 1 << 21) -> DataFrame:
    """Token files of whole texts in ascending ``doc_id`` order: ``part, file, n_ids, doc_ids, data``, stored in the shared folder.

    Documents are range-partitioned and sorted by ``doc_id`` (null first), rows that
    repeat one by the text's hash; a scan number splits rows that are equal. Null
    texts count as empty and have the end id alone. A task holds one file's ids:
    ``file_ids`` and the last document's.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("uid"))
    rows = rows.repartitionByRange("doc_id", "tie", "uid").sortWithinPartitions("doc_id", "tie", "uid").select("doc_id", "text")
    return settle(rows.mapInArrow(_writer(tokenizer, end_id, kind, chunk_ids, file_ids), FILES_DDL), "planes")


def _reader(with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                docs = list(read_file(r["data"]))
                n = np.array([len(d) // 4 for d in docs], np.int64)
                columns = {
                    "part": pa.array([r["part"]] * len(docs), pa.int32()), "file": pa.array([r["file"]] * len(docs), pa.int32()), "doc_id": pa.array(r["doc_ids"], pa.int64()),
                    "within": pa.array(np.cumsum(n) - n), "n_tokens": pa.array(n), "ids_crc32": pa.array([zlib.crc32(d) for d in docs], pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(docs, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return run


def read(files: DataFrame, with_ids: bool = True) -> DataFrame:
    """Documents of token files: ``doc_id, start, n_tokens, ids_crc32`` and ``ids`` (little-endian unsigned 32-bit).

    ``start`` counts the ids of all documents before it, over all files in order:
    those of the parts before (a row per part) and of the files before in its part.
    """
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("part_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = settle(parts.select("part", F.coalesce(F.sum("part_ids").over(earlier), F.lit(0)).alias("before")), "parts")
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("part", "file", "n_ids").withColumn("first", F.coalesce(F.sum("n_ids").over(within), F.lit(0))).join(parts, "part")
    starts = settle(starts.select("part", "file", (F.col("first") + F.col("before")).alias("first")), "starts")
    ids = ["ids"] if with_ids else []
    found = "part int, file int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    rows = files.select("part", "file", "doc_ids", "data").mapInArrow(_reader(with_ids), found).join(starts, ["part", "file"])
    return rows.select("doc_id", (F.col("first") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *ids)
