"""Document fingerprints by a randomised edit embedding.

A walker goes through a text; at every step it notes the character it stands on
and moves on or stays, by a random bit that step and character share in all
texts. After an insertion or deletion two walks soon meet again, so few edits
change few notes: edit distance becomes Hamming distance. A fingerprint keeps one
note per window of ``2**level`` steps, at a place all texts share, and the places
of a level are among those of the level below, so texts of any lengths compare.
Bands of sampled notes find candidates; the likeness of the whole fingerprints
verifies them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import mixed, per_process
from tallyflow.session import settle

PERIOD, CLASSES = 4096, 64
#: Windows of a text: at most this many on average.
NOTES = 256
ROWS = 1024
STRIDE = 256
LETTERS = "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_~"
CODES = {c: i for i, c in enumerate(LETTERS)}


def _moves() -> np.ndarray:
    """Steps that the walker stays on a character of a class when it comes there at a step."""

    def make():
        bits = np.random.default_rng(7).integers(0, 2, (CLASSES, PERIOD)).astype(bool)
        bits[:, 0] = True
        twice = np.concatenate([bits, bits], axis=1)
        at = np.where(twice, np.arange(2 * PERIOD), 4 * PERIOD)
        following = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :PERIOD]
        return (following - np.arange(PERIOD) + 1).astype(np.int32).ravel()

    return per_process("moves", make)


def level_of(n_chars: np.ndarray) -> np.ndarray:
    bits = np.ceil(np.log2(np.maximum(2 * n_chars, 1))).astype(np.int64)
    return np.maximum(0, bits - int(np.log2(NOTES)))


def _child(level: int, window: np.ndarray) -> np.ndarray:
    """Of the two windows below, the one whose place a window takes over."""
    return 2 * window + (mixed(window.astype(np.uint64) * np.uint64(64) + np.uint64(level)) >> np.uint64(40)).astype(np.int64) % 2


def place(level: np.ndarray, window: np.ndarray) -> np.ndarray:
    """The step that a window notes."""
    out = window.copy()
    for t in range(int(level.max(initial=0)), 0, -1):
        out = np.where(level >= t, _child(t, out), out)
    return out


def fingerprints(texts: list[str]) -> list[str]:
    """``level:notes``; a note is a letter for the three characters from the walker on, ``-`` behind the text's end."""
    n = len(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    long_first = lengths[order]
    points = np.frombuffer("".join(texts[i] for i in order).encode("utf-32-le", "surrogatepass"), "<u4")
    begins = np.cumsum(long_first) - long_first
    level = level_of(long_first)
    moves, notes = _moves(), np.zeros((n, ROWS), np.uint8)
    kinds = (mixed(points.astype(np.uint32).astype(np.uint64) + np.uint64(1)) >> np.uint64(50)).astype(np.uint8) % CLASSES if len(points) < 1 << 20 else _kinds(points)
    step = np.zeros(n, np.int32 if len(points) < 1 << 27 else np.int64)
    listed = moves.tolist()
    for k0 in range(0, int(long_first.max(initial=0)), STRIDE):
        here = int(np.searchsorted(-long_first, -k0, "left"))
        until = np.minimum(long_first[:here] - k0, STRIDE)
        columns = int(until.max())
        index = np.minimum(begins[:here, None] + (k0 + np.arange(columns)), len(points) - 1)
        kind = np.ascontiguousarray(kinds[index].T).astype(np.int32) * PERIOD
        seen = np.empty((columns + 1, here), step.dtype)
        seen[0] = step[:here]
        if here > 24:
            counts = np.searchsorted(-until, -np.arange(columns), "left")
            for k in range(columns):
                a = counts[k]
                now = step[:a]
                now += moves.take((now & (PERIOD - 1)) | kind[k, :a])
                seen[k + 1] = step[:here]
        else:  # few long texts are left: a plain loop for each is faster
            for d in range(here):
                at, path = int(step[d]), []
                for c in kind[: until[d], d].tolist():
                    at += listed[(at & (PERIOD - 1)) | c]
                    path.append(at)
                step[d] = at
                seen[1 : 1 + len(path), d] = path
                seen[1 + len(path) :, d] = at
        _note(notes, points, begins[:here] + k0, begins[:here] + long_first[:here], level[:here], seen)
    windows = -(-step.astype(np.int64) // (1 << level))
    out = [""] * n
    letters = np.frombuffer(LETTERS.encode(), np.uint8)
    for i, where in enumerate(order):
        out[where] = f"{level[i]}:{letters[notes[i, : min(int(windows[i]), ROWS)]].tobytes().decode()}"
    return out


def _kinds(points: np.ndarray) -> np.ndarray:
    out = np.empty(len(points), np.uint8)
    for at in range(0, len(points), 1 << 20):
        part = points[at : at + (1 << 20)].astype(np.uint64)
        out[at : at + len(part)] = (mixed(part + np.uint64(1)) >> np.uint64(50)).astype(np.uint8) % CLASSES
    return out


def _note(notes, points, begins, ends, level, seen) -> None:
    """Notes the windows whose step lies in the stretch of the walk that ``seen`` has, a column per text."""
    here = seen.shape[1]
    first, last = seen[0].astype(np.int64), seen[-1].astype(np.int64)
    low = first >> level
    count = np.where(last > first, ((last - 1) >> level) - low + 1, 0)
    text = np.repeat(np.arange(here), count)
    window = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(len(text))
    at = place(level[text], window)
    good = (at >= first[text]) & (at < last[text]) & (window < ROWS)
    text, window, at = text[good], window[good], at[good]
    if not len(text):
        return
    wide = int(last.max()) + 1
    keys = (seen.T.astype(np.int64) + np.arange(here)[:, None] * wide).ravel()
    nth = np.searchsorted(keys, text * wide + at, "right") - 1 - text * seen.shape[0]
    i = begins[text] + nth
    gram = np.zeros(len(i), np.uint64)
    for k in range(3):
        inside = i + k < ends[text]
        point = np.where(inside, points[np.minimum(i + k, len(points) - 1)], 0).astype(np.uint64)
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + point + np.uint64(1)
    notes[text, window] = 1 + (mixed(gram) >> np.uint64(40)) % np.uint64(64)


# --- comparing ---------------------------------------------------------------


def _parsed(print_: str) -> tuple[int, np.ndarray]:
    level, _, notes = print_.partition(":")
    table = per_process("codes", lambda: np.array([CODES.get(chr(b), 0) for b in range(128)], np.uint8))
    return int(level), table[np.frombuffer(notes.encode(), np.uint8)]


def _coarser(level: int, notes: np.ndarray, to: int) -> np.ndarray:
    if to == level:
        return notes
    windows = np.arange(-(-len(notes) // (1 << (to - level))))
    at = windows
    for t in range(to, level, -1):
        at = _child(t, at)
    return np.where(at < len(notes), notes[np.minimum(at, max(0, len(notes) - 1))], 0) if len(notes) else notes


def likeness(a: str, b: str) -> float:
    """Share of equal notes among the windows that either text reaches, 0 to 1; two empty texts are alike."""
    if a == b:
        return 1.0
    (la, na), (lb, nb) = _parsed(a), _parsed(b)
    top = max(la, lb)
    na, nb = _coarser(la, na, top), _coarser(lb, nb, top)
    n = min(len(na), len(nb))
    both = np.count_nonzero((na[:n] == nb[:n]) & (na[:n] > 0))
    either = np.count_nonzero(na) + np.count_nonzero(nb) - np.count_nonzero((na[:n] > 0) & (nb[:n] > 0))
    return float(both / either) if either else float(len(na) == len(nb))


def _orders(number: int) -> np.ndarray:
    """For each band an order of all windows, the same for every level."""
    return per_process(f"orders {number}", lambda: np.array([np.random.default_rng(11 + i).permutation(ROWS) for i in range(number)]))


def bands(print_: str, number: int = 8, width: int = 6) -> list[int]:
    """Keys of bit-sampled bands on the text's level and the next: texts near each other share one.

    A band has an order of all windows and samples the first ``width`` that the text
    has notes in, so two texts of a likeness s share it with a probability of about
    ``s ** width`` wherever they differ. A text without notes has none.
    """
    orders = _orders(number)
    level, notes = _parsed(print_)
    out = []
    for to in (level, level + 1):
        seen = np.zeros(ROWS, np.uint64)
        at = _coarser(level, notes, to)[:ROWS]
        seen[: len(at)] = at
        few = min(width, np.count_nonzero(seen))
        for columns in (64, ROWS):  # the first windows of an order are enough for most texts
            noted = seen[orders[:, :columns]] > 0
            nth = np.cumsum(noted, axis=1)
            if (nth[:, -1] >= few).all():
                break
        if not few:
            continue
        pick = np.take_along_axis(orders[:, :columns], np.nonzero(noted & (nth <= few))[1].reshape(number, few), axis=1)
        key = np.arange(number).astype(np.uint64) * np.uint64(64) + np.uint64(to)
        for k in range(few):
            key = (key + pick[:, k].astype(np.uint64) * np.uint64(128) + seen[pick[:, k]]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out += key.astype(np.int64).tolist()
    return out


# --- over documents ----------------------------------------------------------

PRINTED = pa.schema([
    ("edge", pa.string()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("bands_met", pa.int32()), ("text", pa.string()),
])
PRINTED_DDL = (
    "edge string, part int, doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double,"
    " near_next double, bands_met int, text string"
)


def edited(text: str, following: str) -> str:
    """The last quarter of the text replaced by as much of the beginning of the following one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _finished(doc_id: int, text: str, of: str, changed: str, of_changed: str, of_next: str) -> dict:
    met = len(set(bands(of)) & set(bands(of_changed)))
    return {
        "doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(), "fingerprint": of,
        "edited_fingerprint": of_changed, "near_edited": likeness(of, of_changed), "near_next": likeness(of, of_next), "bands_met": met,
    }


def _runs(at_once: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held, chars = TaskContext.get().partitionId(), True, [], 0

        def out(rows):
            return pa.RecordBatch.from_pylist(rows, schema=PRINTED)

        def flush(rows):
            """All but the last row, whose next one is not known yet."""
            texts = [t for _, t in rows]
            changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
            prints = fingerprints(texts + changed)
            own, other = prints[: len(texts)], prints[len(texts) :]
            done = [_finished(d, t, own[i], changed[i], other[i], own[i + 1]) for i, (d, t) in enumerate(rows[:-1])]
            if first:
                done.append({"edge": "first", "part": part, "doc_id": rows[0][0], "fingerprint": own[0], "text": texts[0]})
            return done

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for i in range(len(ids)):
                held.append((ids[i].as_py(), texts[i].as_py()))
                chars += len(held[-1][1])
                if chars >= at_once and len(held) > 1:
                    yield out(flush(held))
                    first, held = False, held[-1:]
                    chars = len(held[0][1])
        if held:
            done = flush(held)
            yield out(done + [{"edge": "last", "part": part, "doc_id": held[-1][0], "text": held[-1][1]}])

    return run


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            changed = edited(r["text"], r["next_text"])
            own, other = fingerprints([r["text"], changed])
            yield pa.RecordBatch.from_pylist([_finished(r["doc_id"], r["text"], own, changed, other, r["next_print"])], schema=PRINTED)


def fingerprinted(docs: DataFrame, at_once: int = 8_000_000) -> DataFrame:
    """Fingerprints of every text and of its edited text, with the likeness to the edited and to the next document's text.

    Columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, bands_met`` (shared bands of text and edited text). The
    next document is the next by ``doc_id`` (null first), rows that repeat one by
    their text's hash and scan number; the first follows the last. Null texts count as empty.

    Texts are shuffled once, into ranges of ``doc_id``. A task reads its range in
    order, up to ``at_once`` characters and the text that crosses that at a time.
    Only the last document of a range waits for the first of the next one: one row
    of each per range.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("uid"))
    rows = rows.repartitionByRange("doc_id", "tie", "uid").sortWithinPartitions("doc_id", "tie", "uid").select("doc_id", "text")
    rows = rows.mapInArrow(_runs(at_once), PRINTED_DDL)
    path_rows = settle(rows, "prints")
    whole = Window.partitionBy()
    parts = path_rows.filter("edge = 'first'").select("part")
    follows = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(whole)).alias("next_part"))
    heads = path_rows.filter("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    last = path_rows.filter("edge = 'last'").select("part", "doc_id", "text").join(follows, "part").join(heads, "next_part")
    last = last.select("doc_id", "text", "next_text", "next_print").mapInArrow(_edges, PRINTED_DDL)
    return path_rows.filter("edge is null").unionAll(last).drop("edge", "part", "text")


# --- near documents ----------------------------------------------------------

NODES = "node bigint, docs bigint, fingerprint string, keys array<bigint>"


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = pa.array([bands(p) for p in batch.column(2).to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*batch.columns, keys], ["node", "docs", "fingerprint", "keys"])


def _matrix(prints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The levels, and the notes on that level and the next."""
    parsed = [_parsed(p) for p in prints]
    notes = np.zeros((2, len(prints), max((len(n) for _, n in parsed), default=0)), np.uint8)
    for i, (level, own) in enumerate(parsed):
        for k in range(2):
            at = _coarser(level, own, level + k)
            notes[k, i, : len(at)] = at
    return np.array([level for level, _ in parsed], np.int64), notes


def _shared_first(keys: np.ndarray, level: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first key that each pair of rows shares, those of the lower level first; 0 where there is none."""
    half = keys.shape[1] // 2
    out = np.zeros(len(a), np.int64)
    for up_a, up_b, few in ((0, 0, 2 * half), (0, half, half), (half, 0, half)):
        of = level[a] + (up_a > 0) == level[b] + (up_b > 0)
        same = keys[a[of], up_a : up_a + few] == keys[b[of], up_b : up_b + few]
        out[of] = np.where(same.any(axis=1), keys[a[of], up_a + same.argmax(axis=1)], 0)
    return out


def _like(level: np.ndarray, notes: np.ndarray, a: np.ndarray, b: np.ndarray, alike: float) -> np.ndarray:
    """:func:`likeness` of pairs whose levels differ by one at most, against ``alike``."""
    x, y = notes[(level[a] < level[b]).astype(int), a], notes[(level[b] < level[a]).astype(int), b]
    both = np.count_nonzero((x == y) & (x > 0), axis=1)
    either = np.count_nonzero((x > 0) | (y > 0), axis=1)
    return both >= alike * np.maximum(either, 1)


def _meeter(alike: float) -> Callable:
    """Of each row of a block how many documents are near it. A block's left rows come first; of a cell's block with itself there are only left ones."""

    def met(rows: pa.Table) -> pa.RecordBatch:
        key, lb, rb, role, node, docs = (rows.column(i).to_numpy().astype(np.int64) for i in range(6))
        keys = np.array(rows.column("keys").to_pylist(), np.int64)
        level, notes = _matrix(rows.column("fingerprint").to_pylist())
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (lb[1:] != lb[:-1]) | (rb[1:] != rb[:-1])
        starts, group = np.flatnonzero(new), np.cumsum(new) - 1
        lefts = np.add.reduceat((role == 0).astype(np.int64), starts)
        places = np.arange(len(key))
        partners = np.where(role == 1, lefts[group], np.where(lb == rb, places - starts[group], 0))
        after, near, at = np.cumsum(partners), np.zeros(len(key), np.int64), 0
        while at < len(key):  # some ten thousand pairs at a time
            stop = max(at + 1, int(np.searchsorted(after, (after[at - 1] if at else 0) + (1 << 14), "right")))
            times = partners[at:stop]
            b = np.repeat(places[at:stop], times)
            a = np.arange(len(b)) - np.repeat(np.cumsum(times) - times, times) + starts[group[b]]
            at = stop
            for may in (lambda a, b: _shared_first(keys, level, a, b) == key[a], lambda a, b: _like(level, notes, a, b, alike)):
                chosen = may(a, b)
                a, b = a[chosen], b[chosen]
            np.add.at(near, a, docs[b])
            np.add.at(near, b, docs[a])
        found = near > 0
        return pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(near[found])], ["node", "near"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, rows]) if held is not None else rows
            last = np.array([held.column(i).to_numpy() for i in range(3)])
            open_ = int((last != last[:, -1:]).any(axis=0).sum())  # rows come by block, so those of the last one are at the end
            if open_:
                yield met(held.slice(0, open_))
                held = held.slice(open_)
        if held is not None:
            yield met(held)

    return meet


def near_counts(prints: DataFrame, alike: float = 0.9, block: int = 1024) -> DataFrame:
    """``node, docs, near``: of each fingerprint (its xxhash64) the documents that have it and those of other fingerprints with a likeness of ``alike`` at least.

    ``prints`` has a ``fingerprint`` per document. Equal ones are one node. Nodes that
    share a band are candidates, and the likeness of whole fingerprints decides; at a
    likeness of 0.9 the 8 bands of a level miss one pair in 400, above that fewer. Of the
    bands two nodes share, only the first counts their pair. A band's nodes are cut
    into blocks of ``block`` on average and block is held against block, so none is
    left out, no task gets a band alone, and no pairs are written.
    """
    nodes = prints.select(F.xxhash64("fingerprint").alias("node"), "fingerprint").groupBy("node", "fingerprint").agg(F.count("*").alias("docs"))
    nodes = settle(nodes.select("node", "docs", "fingerprint").mapInArrow(_banded, NODES), "banded")
    members = nodes.select("node", F.explode("keys").alias("key"))
    cells = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    members = settle(members.join(cells, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "members")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = members.join(nodes, "node").select("key", "own", other.alias("other"), "node", "docs", "fingerprint", "keys")
    rows = rows.select(
        "key", F.least("own", "other").alias("lb"), F.greatest("own", "other").alias("rb"), (F.col("own") > F.col("other")).cast("int").alias("role"),
        "node", "docs", "fingerprint", "keys",
    )
    rows = rows.repartition("key", "lb", "rb").sortWithinPartitions("key", "lb", "rb", "role")
    near = rows.mapInArrow(_meeter(alike), "node bigint, near bigint").groupBy("node").agg(F.sum("near").alias("near"))
    return nodes.select("node", "docs").join(near, "node", "left").select("node", "docs", F.coalesce("near", F.lit(0)).alias("near"))


def with_near(rows: DataFrame, alike: float = 0.9, block: int = 1024) -> DataFrame:
    """Adds ``near_docs``: how many other documents have an equal fingerprint or one with a likeness of ``alike`` at least."""
    counts = settle(near_counts(rows, alike, block).filter("near > 0 or docs > 1"), "near")
    joined = rows.withColumn("node", F.xxhash64("fingerprint")).join(counts, "node", "left")
    return joined.withColumn("near_docs", F.coalesce(F.col("docs") - 1 + F.col("near"), F.lit(0))).drop("node", "docs", "near")
