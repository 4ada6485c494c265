"""Exact top-k search by inner product: tiles of queries and shards, a partial selection per tile, lists merged in a tree."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.session import settle

#: Sums of products below this are exact in doubles.
EXACT = 2.0**53


BLOCK = pa.schema([
    ("width", pa.int32()), ("n", pa.int32()), ("uids", pa.binary()), ("ids", pa.binary()), ("kind", pa.string()), ("matrix", pa.binary()), ("asks", pa.binary()), ("n_asks", pa.int64()),
])
BLOCK_DDL = "width int, n int, uids binary, ids binary, kind string, matrix binary, asks binary, n_asks bigint"


def _block(width: int, uids: np.ndarray, ids: np.ndarray, matrix: np.ndarray, asks: np.ndarray) -> pa.RecordBatch:
    small = not matrix.size or np.abs(matrix).max() < 2**31
    row = {
        "width": width, "n": len(ids), "uids": uids.astype("<i8").tobytes(), "ids": ids.astype("<i8").tobytes(), "kind": "<i4" if small else "<f8",
        "matrix": matrix.astype("<i4" if small else "<f8").tobytes(), "asks": asks.astype(bool).tobytes(), "n_asks": int(asks.sum()),
    }
    return pa.RecordBatch.from_pylist([row], schema=BLOCK)


def _unpacked(kind: str, matrix: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(matrix, kind).reshape(n, width).astype(np.float64)


def _packer(rows: int, scale: float):
    """Rows ``uid, id, vector, asks`` as blocks of at most ``rows`` vectors of one length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, ids, vectors, asks = (batch.column(i) for i in range(4))
            lengths = np.diff(vectors.offsets.to_numpy())
            uid, ids, asks = uid.to_numpy(), ids.to_numpy(), asks.to_numpy(zero_copy_only=False)
            for width in np.unique(lengths):
                of = np.flatnonzero(lengths == width)
                for at in range(0, len(of), rows):
                    part = of[at : at + rows]
                    flat = vectors.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                    matrix = np.floor(scale * flat).reshape(len(part), width)
                    yield _block(int(width), uid[part], ids[part], matrix, asks[part])

    return pack


def _askers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The query rows of blocks, as blocks of queries only."""
    for batch in batches:
        for r in batch.to_pylist():
            asks = np.frombuffer(r["asks"], bool)
            uids, ids = np.frombuffer(r["uids"], "<i8"), np.frombuffer(r["ids"], "<i8")
            matrix = _unpacked(r["kind"], r["matrix"], r["n"], r["width"])
            yield _block(r["width"], uids[asks], ids[asks], matrix[asks], asks[asks])


def _joined(rows: int):
    """Small blocks of one task as blocks of up to ``rows`` vectors."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def flush(width):
            uids, ids, matrix = (np.concatenate(x) for x in zip(*held.pop(width), strict=True))
            for at in range(0, len(ids), rows):
                to = slice(at, at + rows)
                yield _block(width, uids[to], ids[to], matrix[to], np.ones(len(ids[to]), bool))

        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(r["width"], []).append(
                    (np.frombuffer(r["uids"], "<i8"), np.frombuffer(r["ids"], "<i8"), _unpacked(r["kind"], r["matrix"], r["n"], r["width"]))
                )
                if sum(len(x[1]) for x in held[r["width"]]) >= rows:
                    yield from flush(r["width"])
        for width in list(held):
            yield from flush(width)

    return join


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole-number matrices as 64-bit integers; beyond their range the nearest one."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < EXACT:
        return (q @ c.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    found = exact(q) @ exact(c).T if q.size and c.size else np.zeros((len(q), len(c)), object)
    return np.clip(found, -(2**63), 2**63 - 1).astype(np.int64)


def _tiles(k: int):
    """For each pair of a query block and a shard the k best of the shard for each query."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q = _unpacked(r["q_kind"], r["q_matrix"], r["q_n"], r["width"])
                c = _unpacked(r["kind"], r["matrix"], r["n"], r["width"])
                q_uid, q_id = np.frombuffer(r["q_uids"], "<i8"), np.frombuffer(r["q_ids"], "<i8")
                uid, ids = np.frombuffer(r["uids"], "<i8"), np.frombuffer(r["ids"], "<i8")
                found = [(x[:0], x[:0], x[:0], x[:0], x[:0]) for x in (q_id,)]
                for i, s in enumerate(products(q, c)):
                    able = np.flatnonzero(uid != q_uid[i])
                    if len(able) > k:  # all at or above the k-th score; ids decide among them
                        cut = np.partition(s[able], len(able) - k)[len(able) - k]
                        able = able[s[able] >= cut]
                    best = able[np.lexsort((uid[able], ids[able], ~s[able]))][:k]
                    found.append((np.full(len(best), q_uid[i]), np.full(len(best), q_id[i]), uid[best], ids[best], s[best]))
                columns = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)]
                columns.append(pa.array(np.full(len(columns[0]), r["cell"], np.int64)))
                yield pa.RecordBatch.from_arrays(columns, ["q_uid", "query_id", "uid", "vec_id", "score", "cell"])

    return score


def search(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, scale: float = 1024.0,
    query_block: int = 4096, shard: int = 4096, fan_in: int = 64,
) -> DataFrame:
    """The ``k`` highest inner products of each query row with every other row: ``query_id, rank, vec_id, score``.

    Components become ``floor(scale * x)``, so scores are exact integers (beyond 64
    bits the nearest one). Ties go to the smaller id. Rows whose id or vector is
    null, or whose vector holds null or non-finite components, take no part; a
    vector meets only vectors of its length, the empty one with score 0. Rows that
    repeat an id are rows of their own: each is a query and a candidate, and only
    the very row is left out.

    Both sides are packed into blocks and dealt to a grid whose cells are joined by
    number: a set of queries against a partition of candidates. A task works on one
    block of each at a time. ``k`` rows leave a tile per query; lists are merged
    ``fan_in`` cells at a time until one is left, so no group holds more than
    ``fan_in`` lists per block of a cell.
    """
    x = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
    rows = vectors.filter(usable).select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    blocks = settle(rows.mapInArrow(_packer(shard, scale), BLOCK_DDL).withColumn("cell", F.spark_partition_id()), "shards")
    known = blocks.agg(F.coalesce(F.max("cell") + 1, F.lit(1)), F.coalesce(F.sum("n_asks"), F.lit(0))).first()
    cells, sets = known[0], max(1, math.ceil(known[1] / query_block))
    queries = blocks.filter("n_asks > 0").drop("cell").mapInArrow(_askers, BLOCK_DDL).repartition(sets).mapInArrow(_joined(query_block), BLOCK_DDL)
    queries = queries.withColumn("set", F.spark_partition_id()).select(
        "set", "width", *(F.col(c).alias(f"q_{c}") for c in ("n", "uids", "ids", "kind", "matrix")), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell")
    )
    shards = blocks.select("cell", "width", "n", "uids", "ids", "kind", "matrix", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set"))
    lists = shards.join(queries, ["set", "cell", "width"]).mapInArrow(_tiles(k), "q_uid bigint, query_id bigint, uid bigint, vec_id bigint, score bigint, cell bigint")
    while True:
        lists = lists.withColumn("cell", F.floor(F.col("cell") / fan_in))
        order = Window.partitionBy("q_uid", "cell").orderBy(F.desc("score"), "vec_id", "uid")
        lists = lists.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        cells = math.ceil(cells / fan_in)
        if cells <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")
