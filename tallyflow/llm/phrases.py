"""Phrase collocations by vertically partitioned suffix trees over words.

The text of a language is a string over its words; a phrase's count is that of the
suffixes that begin with it. As in ERA, the suffixes are partitioned by their first words:
prefixes are grouped up to a budget of suffixes, one above it is extended by the next
word. Each group's subtree is built alone, truncated at the longest phrase, and a node's count is the
total of the leaves below it.

Two counts over cells of a hash come first: of words, and of pairs of neighbours whose
words' cells are frequent. A suffix is cut where a word's or a pair's cell holds fewer than ``least``, as
no frequent phrase goes on there. Cells only ever hold more than a word or pair has, so no phrase is lost to them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import byte_table, mixed, slices, text_bytes, word_spans
from tallyflow.session import settle

#: What ends a piece of text, and what is between the words of a piece.
ENDS = byte_table(".,;:!?\n\v\f\r")
BETWEEN = byte_table(" \t")
NEXT = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Mining:
    """Phrases of 2 to ``longest`` words with at least ``least`` occurrences; the first ``top`` of a language.

    ``cells`` and ``chunks`` are powers of two: a filter is ``2 ** cells`` bits, whatever the input, and its counts are
    summed in ``2 ** chunks`` parts. ``budget`` is how many suffixes a group is meant to have, ``spread`` the groups of a pair above it.
    """

    longest: int = 5
    least: int = 100
    top: int = 2000
    cells: int = 24
    chunks: int = 7
    budget: int = 1 << 20
    spread: int = 64
    at_once: int = 1 << 20


def cell(keys: np.ndarray, p: Mining) -> np.ndarray:
    return (keys >> np.uint64(64 - p.cells)).astype(np.int64)


# --- words -------------------------------------------------------------------


@dataclass
class Words:
    """The words of some texts in order: a key each (language and word), where they are, and whether the next one goes on in the same piece."""

    keys: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    goes_on: np.ndarray
    text: np.ndarray
    raw: np.ndarray


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], Words]]:
    """Languages and words of ``lang, text`` batches, some megabytes of text at a time."""
    for batch in batches:
        at, langs = 0, batch.column(0).to_pylist()
        for piece in slices(batch.column(1), 4 << 20):
            mine = langs[at : at + len(piece)]
            at += len(piece)
            raw, bounds = text_bytes(piece)
            hashes, starts, stops = word_spans(raw, bounds, ENDS | BETWEEN)
            if not len(hashes):
                continue
            text = np.searchsorted(bounds, starts, "right") - 1
            salt = {lang: _salt(lang) for lang in set(mine)}
            keys = mixed(hashes + np.array([salt[lang] for lang in mine], np.uint64)[text])
            ended = np.cumsum(ENDS[raw], dtype=np.int32)[starts]
            goes_on = np.zeros(len(keys), bool)
            goes_on[:-1] = (text[1:] == text[:-1]) & (ended[1:] == ended[:-1])
            yield mine, Words(np.maximum(keys, np.uint64(1)), starts, stops, goes_on, text, raw)


def pair_keys(keys: np.ndarray, after: np.ndarray) -> np.ndarray:
    return mixed(keys * NEXT + after)


# --- cells that are frequent -------------------------------------------------

COUNTS = "chunk int, data binary, names binary, lang string, n bigint"
COUNTS_SCHEMA = pa.schema([("chunk", pa.int32()), ("data", pa.binary()), ("names", pa.binary()), ("lang", pa.string()), ("n", pa.int64())])
NAMES = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("other", pa.string())])


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [None] * n), f.type) for f in COUNTS_SCHEMA], schema=COUNTS_SCHEMA)


def _packed(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays))


class CellCounts:
    """Counts of cells within a task, given out as a compressed list for each chunk."""

    def __init__(self, p: Mining):
        self.p, self.counts, self.seen = p, np.zeros(1 << p.cells, np.uint32), 0

    def add(self, cells: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.seen + len(cells) >= 1 << 32:
            yield from self.flush()
        np.add.at(self.counts, cells, np.uint32(1))
        self.seen += len(cells)

    def flush(self) -> Iterator[pa.RecordBatch]:
        width = 1 << (self.p.cells - self.p.chunks)
        for chunk in range(1 << self.p.chunks if self.seen else 0):
            part = self.counts[chunk * width : (chunk + 1) * width]
            at = np.flatnonzero(part)
            if len(at):
                yield _rows(chunk=[chunk], data=[_packed(at.astype("<u4"), part[at].astype("<u4"))])
        self.counts[:] = 0
        self.seen = 0


def _word_counter(p: Mining) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, by_lang = CellCounts(p), {}
        for langs, words in words_of(batches):
            yield from counts.add(cell(words.keys, p))
            for lang, n in zip(langs, np.bincount(words.text, minlength=len(langs)).tolist(), strict=True):
                by_lang[lang] = by_lang.get(lang, 0) + n
        yield from counts.flush()
        if by_lang:
            yield _rows(lang=list(by_lang), n=list(by_lang.values()))

    return run


def _pair_counter(p: Mining, frequent: Callable) -> Callable:
    """Counts pairs of frequent words, and names each such word once a task, in a list for each chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word, counts, named, names = frequent(), CellCounts(p), np.zeros(0, np.uint64), []
        for langs, w in words_of(batches):
            kept = is_word[cell(w.keys, p)]
            first = np.flatnonzero(w.goes_on & kept & np.append(kept[1:], False))
            yield from counts.add(cell(pair_keys(w.keys[first], w.keys[first + 1]), p))
            at = np.flatnonzero(kept)
            keys, where = np.unique(w.keys[at], return_index=True)
            new = np.isin(keys, named, invert=True, assume_unique=True)
            named = np.concatenate([named, keys[new]])
            at, data = at[where[new]], w.raw.tobytes()
            spelled = [data[a:b].lower().decode() for a, b in zip(w.starts[at].tolist(), w.stops[at].tolist(), strict=True)]
            names.append(pa.table([keys[new].astype(np.int64), [langs[i] for i in w.text[at].tolist()], spelled, spelled], schema=NAMES))
        yield from counts.flush()
        if len(named):
            chunk = (named >> np.uint64(64 - p.chunks)).astype(np.int64)
            order, all_names = np.argsort(chunk, kind="stable"), pa.concat_tables(names)
            for at in np.split(order, np.flatnonzero(np.diff(chunk[order])) + 1):
                yield _rows(chunk=[int(chunk[at[0]])], names=[_written(all_names.take(pa.array(at)))])

    return run


def _written(names: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, NAMES, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(names)
    return sink.getvalue().to_pybytes()


def _once(names: list[pa.Table]) -> pa.Table:
    """A row for each key, with its first and last word: two where two words have one key."""
    found = pa.concat_tables(names).group_by("key").aggregate([("lang", "min"), ("word", "min"), ("other", "max")])
    return found.select(["key", "lang_min", "word_min", "other_max"]).rename_columns(NAMES.names).cast(NAMES)


def _namer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names of each chunk, those that many tasks give as one."""
    now, names, least = None, [], 0
    for batch in batches:
        for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if chunk != now and names:
                yield from _once(names).to_batches()
                names, least = [], 0
            now = chunk
            names.append(pa.ipc.open_stream(data).read_all())
            if sum(map(len, names)) > 2 * least + (1 << 16):
                names = [_once(names)]
                least = len(names[0])
    if names:
        yield from _once(names).to_batches()


CELLS = "chunk int, frequent binary, begins binary, heavy binary"


def _summer(p: Mining) -> Callable:
    """A row for each chunk: which cells are frequent, the cells that begin a group of at most about the budget, and those above it."""

    def done(chunk: int, sums: np.ndarray) -> pa.RecordBatch:
        frequent = sums >= p.least
        load = np.where(frequent, sums, 0)
        turn = (np.cumsum(load) - load) // p.budget
        begins = np.flatnonzero(np.diff(turn, prepend=-1))
        first = chunk << (p.cells - p.chunks)
        values = [[chunk], [np.packbits(frequent).tobytes()], [(begins + first).astype("<i8").tobytes()], [(np.flatnonzero(load > p.budget) + first).astype("<i8").tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(values[0], pa.int32()), *(pa.array(v, pa.binary()) for v in values[1:])], ["chunk", "frequent", "begins", "heavy"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if chunk != now:
                    if now is not None:
                        yield done(now, sums)
                    now, sums = chunk, np.zeros(1 << (p.cells - p.chunks), np.int64)
                at, n = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4").reshape(2, -1)
                sums[at] += n
        if now is not None:
            yield done(now, sums)

    return run


class Cells:
    """What the sums say, on the driver and in every task: ``2 ** cells`` bits, and a few cells for each budget of suffixes."""

    def __init__(self, counts: DataFrame, p: Mining):
        spread = counts.filter("data is not null").select("chunk", "data").repartition("chunk").sortWithinPartitions("chunk")
        rows = spread.mapInArrow(_summer(p), CELLS).collect()
        bits = np.zeros((1 << p.chunks, 1 << (p.cells - p.chunks)), bool)
        for r in rows:
            bits[r["chunk"]] = np.unpackbits(np.frombuffer(r["frequent"], np.uint8), count=bits.shape[1])
        joined = lambda name: np.sort(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r[name], "<i8") for r in rows)]))
        self.begins, self.heavy = joined("begins"), joined("heavy")
        self.packed = np.packbits(bits.ravel()).tobytes()

    def frequent(self) -> np.ndarray:
        return np.unpackbits(np.frombuffer(self.packed, np.uint8)).view(bool)

    def group(self, cells: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, cells, "right")


# --- suffixes and their trees ------------------------------------------------


def suffixes(w: Words, is_word: np.ndarray, is_pair: np.ndarray, p: Mining) -> tuple[np.ndarray, np.ndarray]:
    """The different suffixes of some words and how often each is there: rows of ``longest`` keys, 0 where they are cut."""
    kept = is_word[cell(w.keys, p)]
    link = w.goes_on & kept & np.append(kept[1:], False)
    at = np.flatnonzero(link)
    link[at] = is_pair[cell(pair_keys(w.keys[at], w.keys[at + 1]), p)]
    first = np.flatnonzero(kept)
    rows = np.zeros((len(first), p.longest), np.uint64)
    rows[:, 0] = w.keys[first]
    on = np.arange(len(first))
    for k in range(1, p.longest):
        on = on[link[first[on] + k - 1]]
        rows[on, k] = w.keys[first[on] + k]
    return distinct(rows, np.ones(len(rows), np.int64))


def distinct(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal rows as one, in order, their counts added."""
    order = np.lexsort(rows.T[::-1])
    rows, counts = rows[order], counts[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    starts = np.flatnonzero(new)
    return rows[starts], np.add.reduceat(counts, starts) if len(starts) else counts[:0]


def grouped(rows: np.ndarray, words: Cells, pairs: Cells, p: Mining) -> np.ndarray:
    """The group of each suffix: that of its first word's cell; where that is above the budget, of the first two words'; where these are, by the third."""
    first = cell(rows[:, 0], p)
    group = 3 * words.group(first)
    more = np.flatnonzero(np.isin(first, words.heavy) & (rows[:, 1] != 0))
    key = pair_keys(rows[more, 0], rows[more, 1])
    group[more] = 3 * pairs.group(cell(key, p)) + 1
    last = np.isin(cell(key, p), pairs.heavy) & (rows[more, 2] != 0)
    more, key = more[last], key[last]
    group[more] = 3 * (pairs.group(cell(key, p)) * p.spread + (pair_keys(key, rows[more, 2]) % np.uint64(p.spread)).astype(np.int64)) + 2
    return group


def _suffixer(words: Cells, pairs: Cells, p: Mining) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_word, is_pair = words.frequent(), pairs.frequent()
        held, size = [], 0

        def flush():
            rows, counts = distinct(*map(np.concatenate, zip(*held)))
            group = grouped(rows, words, pairs, p)
            order = np.argsort(group, kind="stable")
            starts = np.flatnonzero(np.diff(group[order], prepend=-1))
            for at in np.split(order, starts[1:]):
                yield pa.RecordBatch.from_arrays([pa.array(group[at[:1]]), pa.array([_packed(rows[at].T, counts[at])], pa.binary())], ["group", "data"])

        for _, w in words_of(batches):
            found = suffixes(w, is_word, is_pair, p)
            if len(found[0]):
                held.append(found)
                size += len(found[0])
            if size > p.at_once:
                held = [distinct(*map(np.concatenate, zip(*held)))]
                size = len(held[0][0])
                if size > p.at_once // 2:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def subtree(rows: np.ndarray, counts: np.ndarray, p: Mining) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each depth the nodes and the totals of the leaves below them. ``rows`` are in order and differ."""
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for k in range(p.longest):
        new[1:] |= rows[1:, k] != rows[:-1, k]
        starts = np.flatnonzero(new)
        there = rows[starts, k] != 0
        if not there.any():
            return
        yield rows[starts[there], : k + 1], np.add.reduceat(counts, starts)[there]


def _grower(words: Cells, pairs: Cells, p: Mining) -> Callable:
    """The nodes of each group's subtree that are frequent, or that have leaves in other groups too."""

    def nodes(group: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for found, totals in subtree(*distinct(*map(np.concatenate, zip(*parts))), p):
            depth = found.shape[1]
            kept = totals >= p.least
            if depth <= group % 3:
                kept[:] = True
            elif depth == 1:
                kept |= np.isin(cell(found[:, 0], p), words.heavy)
            elif depth == 2 and group % 3 == 1:
                kept |= np.isin(cell(pair_keys(found[:, 0], found[:, 1]), p), pairs.heavy)
            found = found[kept].astype(np.int64)
            path = pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, depth), pa.int32()), pa.array(found.ravel()))
            yield pa.RecordBatch.from_arrays([path, pa.array(totals[kept])], ["path", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size = None, [], 0
        for batch in batches:
            for group, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if group != now:
                    if parts:
                        yield from nodes(now, parts)
                    now, parts, size = group, [], 0
                flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint64).reshape(p.longest + 1, -1)
                parts.append((flat[: p.longest].T, flat[p.longest].astype(np.int64)))
                size += flat.shape[1]
                if size > 2 * p.budget:  # equal suffixes of many tasks become one
                    parts = [distinct(*map(np.concatenate, zip(*parts)))]
                    size = len(parts[0][0])
        if parts:
            yield from nodes(now, parts)

    return run


# --- phrases -----------------------------------------------------------------


def frequent_phrases(docs: DataFrame, p: Mining = Mining()) -> tuple[DataFrame, DataFrame]:
    """``lang, path, phrase, n``: all phrases of up to ``longest`` words with at least ``least`` occurrences; and ``lang, words``.

    A-Z count as a-z. Pieces end at ``. , ; : ! ?`` and line ends, words at spaces and
    tabs; phrases lie within a piece. A null text is empty, a null language ``und``. A row that
    repeats counts again. ``path`` has the words' keys, 64-bit hashes of language and word; two
    frequent words of one key are an error, as their counts would be one.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").alias("text"))
    counted = settle(rows.mapInArrow(_word_counter(p), COUNTS), "words")
    words = Cells(counted, p)
    totals = settle(counted.filter("chunk is null").groupBy("lang").agg(F.sum("n").alias("words")), "totals")
    counted = settle(rows.mapInArrow(_pair_counter(p, words.frequent), COUNTS), "pairs")
    pairs = Cells(counted, p)
    leaves = rows.mapInArrow(_suffixer(words, pairs, p), "group bigint, data binary")
    leaves = leaves.repartition("group").sortWithinPartitions("group")
    nodes = leaves.mapInArrow(_grower(words, pairs, p), "path array<bigint>, n bigint")
    nodes = settle(nodes.groupBy("path").agg(F.sum("n").alias("n")).filter(F.col("n") >= p.least), "nodes")
    named = counted.filter("names is not null").select("chunk", "names").repartition("chunk").sortWithinPartitions("chunk")
    named = named.mapInArrow(_namer, "key bigint, lang string, word string, other string")
    named = named.join(nodes.filter("size(path) = 1").select(F.col("path")[0].alias("key")), "key", "left_semi")
    same = F.when(F.col("word") == F.col("other"), F.col("word")).otherwise(F.raise_error(F.lit("two frequent words have one key")))
    named = settle(named.select("key", "lang", same.alias("word")), "named")
    spelled = nodes.select("path", "n", F.posexplode("path").alias("pos", "key")).join(named, "key")
    spelled = spelled.groupBy("path", "n").agg(F.min("lang").alias("lang"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("words"))
    phrase = F.array_join(F.transform("words", lambda w: w["word"]), " ")
    return settle(spelled.select("lang", "path", phrase.alias("phrase"), "n"), "phrases"), totals


def collocations(docs: DataFrame, p: Mining = Mining()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    A phrase's score is the least over its cuts in two of ``1000 * a * n / (l * r)``, whole
    numbers rounded down: its count and the language's words against the counts of the two parts; of equal cuts the first. Phrases that
    only occur within a longer one, candidates of ``longest`` words at most, are left out. Ties go by count, then by
    the phrase's bytes. Tables without words give no rows.
    """
    phrases, totals = frequent_phrases(docs, p)
    found = phrases.filter("size(path) > 1").withColumnRenamed("n", "a")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size("path") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.size("path") - n + 1), lambda at: F.slice("path", at, n))))
    inside = found.filter("size(path) > 2").select(F.explode(inner).alias("path"), "a").groupBy("path").agg(F.max("a").alias("longer"))
    found = found.join(inside, "path", "left").filter("longer is null or longer < a").drop("longer")
    cuts = found.select("*", F.explode(F.sequence(F.lit(1), F.size("path") - 1)).alias("cut"))
    cuts = cuts.withColumns({"left": F.slice("path", 1, F.col("cut")), "right": F.slice("path", F.col("cut") + 1, F.size("path"))})
    side = lambda path, n: phrases.select(F.col("path").alias(path), F.col("n").alias(n))
    cuts = cuts.join(side("left", "l"), "left").join(side("right", "r"), "right").join(totals.withColumnRenamed("words", "n"), "lang")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"(1000 * {wide('a')} * {wide('n')}) div ({wide('l')} * {wide('r')})"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    best = best.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= p.top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
