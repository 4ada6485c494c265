"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A bounded sample of the labelled rows is dealt into splits. In each round every
split continues from the same state (z and n per coordinate) over its own rows,
and the states are merged per coordinate. L1 leaves few weights; their number is
bounded by the hash space, so they travel to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import MARKS, hashed_words, mixed, slices, text_bytes
from tallyflow.session import settle


@dataclass(frozen=True)
class Ftrl:
    """``sample_rows`` bounds the labelled rows that are learned from; ``bits`` the hash space and so the weights."""

    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 0.0
    sample_rows: int = 20_000
    splits: int = 4
    rounds: int = 4


@dataclass(frozen=True)
class Model:
    """The coordinates whose weight is not zero, ascending, and their weights."""

    bits: int
    at: np.ndarray
    weight: np.ndarray


def features(column: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """For each text the distinct coordinates of its words, neighbouring pairs and pairs with one word between.

    Words are runs of letters, digits and non-ASCII bytes, A-Z as a-z. Coordinate
    0 is the bias, which every text has, an empty one too.
    """
    shift = np.uint64(64 - bits)
    bias = np.zeros(1, np.int32)
    for piece in slices(column):
        words, before = hashed_words(*text_bytes(piece), MARKS)
        right = mixed(words * np.uint64(0xD6E8FEB86659FD93))
        gap = mixed(words * np.uint64(0xC2B2AE3D27D4EB4F))
        one = (mixed(words) >> shift).astype(np.int32)
        two = (mixed(words[:-1] + right[1:]) >> shift).astype(np.int32)
        skip = (mixed(words[:-2] + gap[2:]) >> shift).astype(np.int32)
        for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
            yield np.unique(np.concatenate([bias, one[a:b], two[a : max(a, b - 1)], skip[a : max(a, b - 2)]]))


def weights(z: np.ndarray, n: np.ndarray, p: Ftrl) -> np.ndarray:
    shrunk = np.sign(z) * np.maximum(np.abs(z) - p.l1, 0)
    return -shrunk / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)


def logistic(x: np.ndarray | float) -> np.ndarray | float:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def learn(z: np.ndarray, n: np.ndarray, rows: list[tuple[np.ndarray, int]], p: Ftrl) -> None:
    """One pass over the rows in their order; changes z and n in place."""
    for at, label in rows:
        w = weights(z[at], n[at], p)
        g = logistic(w.sum()) - label
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha
        z[at] += g - sigma * w
        n[at] += g * g


# --- fitting -----------------------------------------------------------------


def sampled_labels(labels: DataFrame, label: str, p: Ftrl, learnable: Column) -> DataFrame:
    """At most ``sample_rows`` labelled ids in the order of their hash; of several labels of an id the largest counts."""
    known = labels.filter(learnable & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
    known = settle(known.withColumn("turn", F.xxhash64("doc_id")), "labels")
    share = 1.1 * p.sample_rows / max(1, known.count())
    near = known.filter(F.pmod("turn", F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000))
    return near.orderBy("turn", "doc_id").limit(p.sample_rows)


def fit(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), label: str = "toxic", learnable: Column | None = None) -> Model:
    """Learns ``label`` (0 or 1 per ``doc_id``) from the texts of ``docs``; without labelled rows all scores are 0.5.

    The broadcast sample has at most ``sample_rows`` rows of three numbers. Every
    split is read by one task: its rows are ``sample_rows / splits`` at most, and
    the state has ``2 ** bits`` coordinates at most, whatever the corpus holds.
    """
    spark = docs.sparkSession
    sample = sampled_labels(labels, label, p, F.lit(True) if learnable is None else learnable)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    of_row = F.arrow_udf(_feature_rows(p.bits), "array<int>")
    rows = rows.select("turn", "doc_id", "label", of_row(F.coalesce("text", F.lit(""))).alias("at"), F.pmod("turn", F.lit(p.splits)).cast("int").alias("split"))
    rows = settle(rows, "features")
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
    for _ in range(p.rounds):
        state = spark.sparkContext.broadcast(_moved(z, n))
        parts = [
            rows.filter(F.col("split") == k).coalesce(1).sortWithinPartitions("turn", "doc_id", "at").select("at", "label")
            .mapInArrow(_learner(state, p), "coordinate int, dz double, dn double")
            for k in range(p.splits)
        ]
        merged = reduce(DataFrame.unionAll, parts).groupBy("coordinate").agg(F.avg("dz").alias("dz"), F.avg("dn").alias("dn")).toArrow()
        at = merged["coordinate"].to_numpy()
        z[at] += merged["dz"].to_numpy()
        n[at] += merged["dn"].to_numpy()
        del merged
        pa.default_memory_pool().release_unused()  # else the driver keeps it
        state.destroy()
    at, z, n = _moved(z, n)
    w = weights(z, n, p)
    return Model(p.bits, at[w != 0], w[w != 0])


def _moved(z: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coordinates that any row has moved, and their state; the others are zero."""
    at = np.flatnonzero((z != 0) | (n != 0)).astype(np.int32)
    return at, z[at], n[at]


def _feature_rows(bits: int):
    def rows(text: pa.Array) -> pa.Array:
        pieces = [pa.array(list(features(piece, bits)), pa.list_(pa.int32())) for piece in slices(text)]
        return pa.concat_arrays(pieces) if pieces else pa.array([], pa.list_(pa.int32()))

    return rows


def _learner(state, p: Ftrl):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z0, n0 = np.zeros(1 << p.bits), np.zeros(1 << p.bits)
        z0[state.value[0]], n0[state.value[0]] = state.value[1:]
        z, n = z0.copy(), n0.copy()
        for batch in batches:
            at, label = batch.column(0), batch.column(1).to_pylist()
            learn(z, n, [(at[i].values.to_numpy(), label[i]) for i in range(len(label))], p)
        moved = np.flatnonzero(n != n0).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(moved), pa.array(z[moved] - z0[moved]), pa.array(n[moved] - n0[moved])], ["coordinate", "dz", "dn"]
        )

    return run


# --- scoring -----------------------------------------------------------------


def score(text: Column, model: Model) -> Column:
    """Probability of label 1 for each whole text; null counts as empty, an empty text has the bias alone."""
    bits, at, weight = model.bits, model.at, model.weight

    def scores(texts: pa.Array) -> pa.Array:
        dense = np.zeros(1 << bits)
        dense[at] = weight
        return pa.array(np.array([logistic(dense[f].sum()) for f in features(texts, bits)], float))

    return F.arrow_udf(scores, "double")(F.coalesce(text, F.lit("")))
