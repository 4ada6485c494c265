"""MinHash near-duplicates with tensored banding.

Two collections of ``per_side`` band values are made from ``2 * per_side * rows``
minhashes. A table is a pair of a value from each, so ``per_side ** 2`` tables come
from hashes whose number is their square root times a constant. Two sets of
similarity s meet in a table with probability ``(1 - (1 - s**rows)**per_side)**2``:
at 0.75 one link in 10,000 is missed with the defaults, above that far fewer.
Links are confirmed on the full sets of shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.common import mixed, shingle_sets
from tallyflow.session import settle

#: Stands for a null id in joins.
NO_ID = -(2**63)


@dataclass(frozen=True)
class Banding:
    """``percent`` of the union must be shared; ``star`` leaves are confirmed against one copy of their hub.

    A sketch has for each of 256 parts of the hash space whether the set is there and
    one bit of its smallest member. Of the parts where either of two sets is, an
    eighth differ at a similarity of 0.75; pairs beyond that by more than
    ``deviations`` standard deviations, or of sizes too far apart, are not confirmed.

    An odd sketch has 1024 bits, each the parity of the members that fall on it, so two
    of them differ in no more bits than their sets differ in members. Sets above 512
    members are thinned by powers of two first. Members of a cell that are apart after
    the first round meet only if their odd sketches allow a link as well.

    Blocks of a cell hold ``block`` members on average.
    """

    per_side: int = 12
    rows: int = 2
    width: int = 5
    percent: int = 75
    deviations: float = 5.0
    star: int = 64
    block: int = 1024


SIGNED = "doc_id bigint, th bigint, n_shingles bigint, node bigint, halves array<bigint>, sketch array<bigint>, odd array<bigint>"
#: Members an odd sketch takes unthinned.
ODD_MEMBERS = 512


def _sketch(s: np.ndarray) -> list[int]:
    """The bits of the smallest member in each part, then the parts; members are sorted, so the first is the smallest."""
    part, at = np.unique(s & np.uint64(255), return_index=True)
    bits = np.zeros(512, np.uint8)
    bits[part.astype(np.int64)] = (s[at] >> np.uint64(20)).astype(np.uint8) & 1
    bits[256 + part.astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64).tolist()


def _odd_sketch(s: np.ndarray) -> list[int]:
    """The parities; the higher bits of a member say whether it stays in a thinned set."""
    thin = max(0, (len(s) - 1) // ODD_MEMBERS).bit_length()
    s = s[(s >> np.uint64(40)) & np.uint64((1 << thin) - 1) == 0]
    return np.packbits(np.bincount(((s >> np.uint64(24)) & np.uint64(1023)).astype(np.int64), minlength=1024).astype(np.uint8) & 1).view(np.int64).tolist()


def _signer(p: Banding) -> Callable:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(75)
        number = 2 * p.per_side * p.rows
        flip, times = (rng.integers(0, 2**64, (number, 1), dtype=np.uint64, endpoint=False) for _ in range(2))
        times |= np.uint64(1)
        salt = np.arange(2 * p.per_side).astype(np.uint64)
        for batch in batches:
            n, node, halves, sketch, odd = [], [], [], [], []
            for s in shingle_sets(batch.column(2), p.width):
                n.append(len(s))
                if not len(s):
                    node.append(None), halves.append(None), sketch.append(None), odd.append(None)
                    continue
                least = np.full(number, 2**64 - 1, np.uint64)
                for at in range(0, len(s), 1 << 12):  # 1.5 MB at a time
                    np.minimum(least, ((s[at : at + (1 << 12)] ^ flip) * times).min(axis=1), out=least)
                value = salt.copy()
                for r in range(p.rows):
                    value = mixed(value + least[r :: p.rows] * np.uint64(0xD6E8FEB86659FD93))
                node.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True))
                halves.append(value.astype(np.int64))
                sketch.append(_sketch(s))
                odd.append(_odd_sketch(s))
            numbers = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(halves, numbers), pa.array(sketch, numbers), pa.array(odd, numbers)],
                ["doc_id", "th", "n_shingles", "node", "halves", "sketch", "odd"],
            )
            del batch  # else it stays while the next one is read

    return sign


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _id_key(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id), F.lit(NO_ID))


# --- candidates --------------------------------------------------------------


def buckets(nodes: DataFrame, p: Banding) -> DataFrame:
    """``key, place, node, hub``: the members of every table cell that holds two or more, the table's number, and the cell's smallest member.

    A band value that only one node has leads nowhere, so those are left out before
    values are paired into table keys.
    """
    halves = nodes.select("node", F.posexplode("halves").alias("pos", "value"))
    shared = halves.groupBy("pos", "value").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    kept = halves.join(shared, ["pos", "value"], "left_semi").groupBy("node").agg(F.collect_list(F.struct("pos", "value")).alias("halves"))
    kept = settle(kept, "halves")  # at most 2 * per_side values a node
    keys = kept.select("node", "halves", F.explode(F.filter("halves", lambda h: h["pos"] < p.per_side)).alias("a"))
    keys = keys.select("node", "a", F.explode(F.filter("halves", lambda h: h["pos"] >= p.per_side)).alias("b"))
    place = (F.col("a.pos") * p.per_side + F.col("b.pos") - p.per_side).cast("smallint")
    keys = keys.select("node", place.alias("place"), F.xxhash64("a.pos", "a.value", "b.pos", "b.value").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return settle(keys.join(hubs, "key"), "buckets")


def _sketched(nodes: DataFrame, node: str, sketch: str) -> DataFrame:
    return nodes.select(F.col("node").alias(node), F.struct("sketch", "n_shingles", "rep_key", "rep_th").alias(sketch))


def _may_link(a: str, b: str, p: Banding) -> Column:
    word = lambda c, i: F.get(F.col(c)["sketch"], F.lit(i))
    differ = sum(F.bit_count(word(a, i).bitwiseXOR(word(b, i))) for i in range(4))
    parts = sum(F.bit_count(word(a, i).bitwiseOR(word(b, i))) for i in range(4, 8))
    share = (1 - p.percent / 100) / 2
    small, large = (f(F.col(a)["n_shingles"], F.col(b)["n_shingles"]) for f in (F.least, F.greatest))
    return (100 * small >= p.percent * large) & (differ <= share * parts + p.deviations * F.sqrt(share * (1 - share) * parts))


def star_edges(members: DataFrame, nodes: DataFrame, p: Banding) -> DataFrame:
    """``PAIR`` of all cells, once each, whose sketches allow a link."""
    edges = members.filter("node != hub").select("hub", F.col("node").alias("leaf")).distinct()
    edges = edges.join(_sketched(nodes, "hub", "s"), "hub").join(_sketched(nodes, "leaf", "t"), "leaf")
    reps = [F.col(f"{sketch}.rep_{x}").alias(f"{node}_{x}") for node, sketch in (("hub", "s"), ("leaf", "t")) for x in ("key", "th")]
    return edges.filter(_may_link("s", "t", p)).select("hub", "leaf", *reps)


def _bits(words: np.ndarray) -> np.ndarray:
    return np.bitwise_count(words.view(np.uint64)).sum(axis=1)


def _thinned(n: np.ndarray) -> np.ndarray:
    """How often a set of ``n`` was halved for its odd sketch."""
    return np.frexp(np.maximum(0, n - 1) // ODD_MEMBERS)[1]


def _oddly_may_link(odd: np.ndarray, other: np.ndarray, n: np.ndarray, m: np.ndarray, p: Banding) -> np.ndarray:
    """Whether the odd sketches of sets of ``n`` and ``m`` leave room for a link; sets thinned unequally are let through."""
    thin = _thinned(n)
    most = (n + m) * (100 - p.percent) / (100 + p.percent) / 2.0**thin
    slack = np.where(thin > 0, p.deviations * np.sqrt(most), 1e-6)
    return (thin != _thinned(m)) | (_bits(odd ^ other) <= most + slack)


def _sketches_may_link(sketch: np.ndarray, other: np.ndarray, n: np.ndarray, m: np.ndarray, p: Banding) -> np.ndarray:
    """``_may_link`` for arrays."""
    parts = _bits(sketch[:, 4:] | other[:, 4:])
    share = (1 - p.percent / 100) / 2
    sized = 100 * np.minimum(n, m) >= p.percent * np.maximum(n, m)
    return sized & (_bits(sketch[:, :4] ^ other[:, :4]) <= share * parts + p.deviations * np.sqrt(share * (1 - share) * parts))


#: Two nodes, and the rows whose texts stand for them.
PAIR = "hub bigint, leaf bigint, hub_key bigint, hub_th bigint, leaf_key bigint, leaf_th bigint"
#: What ``_meeter`` reads.
OPEN = ("key", "lb", "rb", "role", "place", "node", "label", "top", "about")


def _meeter(p: Banding) -> Callable:
    """Pairs of the left and right rows of each block that may link; a block's left rows, at most a few ``p.block``, come first."""

    def first_table(halves, other):
        same = halves == other
        return same[:, : p.per_side].argmax(axis=1) * p.per_side + same[:, p.per_side :].argmax(axis=1)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = np.column_stack([batch.column(i).cast(pa.int64()).to_numpy(zero_copy_only=False) for i in range(8)])
            rows = np.hstack([flat, batch.column(8).flatten().to_numpy().reshape(len(flat), -1)])
            if kept is not None:
                rows = np.vstack([kept, rows])
            role, place, node, label, top = (rows[:, i] for i in range(3, 8))
            sketch, odd, n, rep, halves = rows[:, 8:16], rows[:, 16:32], rows[:, 32], rows[:, 33:35], rows[:, 35:]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
            group, starts = np.cumsum(new) - 1, np.flatnonzero(new)
            lefts = np.add.reduceat((role == 0).astype(np.int64), starts)
            right = np.flatnonzero(role == 1)
            after = np.cumsum(lefts[group[right]])
            found, at = [], 0
            while at < len(right):  # about 16,000 pairs at a time, of 200 bytes each side
                stop = max(at + 1, int(np.searchsorted(after, (after[at - 1] if at else 0) + (1 << 14), "right")))
                times = lefts[group[right[at:stop]]]
                b = np.repeat(right[at:stop], times)
                a = np.arange(len(b)) - np.repeat(np.cumsum(times) - times, times) + starts[group[b]]
                at = stop
                for may in (
                    lambda a, b: (label[a] != label[b]) & ((label[b] == top[b]) | (node[a] < node[b])),
                    lambda a, b: _sketches_may_link(sketch[a], sketch[b], n[a], n[b], p),
                    lambda a, b: _oddly_may_link(odd[a], odd[b], n[a], n[b], p),
                    lambda a, b: first_table(halves[a], halves[b]) == place[a],
                ):
                    chosen = may(a, b)
                    a, b = a[chosen], b[chosen]
                found.append(np.column_stack([node[a], node[b], rep[a], rep[b]]))
            pairs = np.concatenate(found) if found else np.zeros((0, 6), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(6)], [column.split()[0] for column in PAIR.split(", ")])
            kept = rows[(group == group[-1]) & (role == 0)]

    return meet


def open_edges(members: DataFrame, nodes: DataFrame, labels: DataFrame, tried: DataFrame, p: Banding) -> DataFrame:
    """``PAIR``: pairs of a cell that are in different components so far and weren't tried.

    In a cell, members of its largest component meet only members of others, so a
    large group of near copies, one component by now, makes no pairs within itself.
    Of the cells two nodes share, only that of the first table gives their pair. Cells
    are cut into blocks, and block is held against block, so no task gets a cell alone.
    """
    named = members.select("key", "place", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = named.groupBy("key", "label").agg(F.count("*").alias("n"))
    cells = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("labels"), F.sum("n").alias("n")).filter("labels > 1")
    cells = cells.select("key", F.col("top.label").alias("top"), F.ceil(F.col("n") / p.block).cast("int").alias("blocks"))
    about = nodes.select("node", F.concat("sketch", "odd", F.array("n_shingles", "rep_key", "rep_th"), "halves").alias("about"))
    named = settle(named.join(cells, "key").join(about, "node"), "open")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rest = [F.col("place").cast("int").alias("place"), "node", "label", "top", "about"]
    left = named.filter("label != top").select("key", own.alias("lb"), every.alias("rb"), F.lit(0).alias("role"), *rest)
    right = named.select("key", every.alias("lb"), own.alias("rb"), F.lit(1).alias("role"), *rest)
    rows = left.unionAll(right).select(*OPEN)
    rows = rows.repartition("key", "lb", "rb").sortWithinPartitions("key", "lb", "rb", "role")
    pairs = rows.mapInArrow(_meeter(p), PAIR).distinct()
    done = tried.select("hub", "leaf").unionAll(tried.select(F.col("leaf").alias("hub"), F.col("hub").alias("leaf")))
    return pairs.join(done, ["hub", "leaf"], "left_anti")


# --- confirming --------------------------------------------------------------


def _confirmer(p: Banding) -> Callable:
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, hub = None, None
        for batch in batches:
            hubs, salts, leaves = (batch.column(i).to_pylist() for i in range(3))
            found = []
            for i, s in enumerate(shingle_sets(batch.column(3), p.width)):
                if leaves[i] is None:
                    group, hub = (hubs[i], salts[i]), s
                elif group == (hubs[i], salts[i]):
                    both = np.count_nonzero(hub[np.minimum(np.searchsorted(hub, s), len(hub) - 1)] == s)
                    if 100 * both >= p.percent * (len(hub) + len(s) - both):
                        found.append((hubs[i], leaves[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], ["hub", "leaf"])
            del batch  # else it stays while the next one is read

    return confirm


def confirmed(edges: DataFrame, docs: DataFrame, p: Banding) -> DataFrame:
    """The edges (``PAIR``) whose full sets share enough. A hub is repeated for every ``star`` leaves, so no task gets a hub's leaves alone."""
    hub = ["hub", "hub_key", "hub_th"]  # one row's for each hub; all are grouped by, so both uses of the counts are one shuffle
    shares = edges.groupBy(*hub).agg(F.ceil(F.count("*") / p.star).cast("int").alias("shares"))
    salt = F.pmod(F.xxhash64("leaf"), F.col("shares")).cast("int").alias("salt")
    leaves = edges.join(shares, hub).select("hub", salt, "leaf", F.col("leaf_key").alias("rep_key"), F.col("leaf_th").alias("rep_th"))
    hubs = shares.select("hub", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"), F.lit(None).cast("long").alias("leaf"), "hub_key", "hub_th")
    roles = leaves.unionAll(hubs)
    rows = _identified(docs).select(_id_key().alias("rep_key"), F.col("th").alias("rep_th"), "text")
    rows = roles.join(rows, ["rep_key", "rep_th"]).select("hub", "salt", "leaf", "text")
    rows = rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.asc_nulls_first("leaf"))
    return settle(rows.mapInArrow(_confirmer(p), "hub bigint, leaf bigint").distinct(), "links")


# --- components --------------------------------------------------------------


def stars(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``a, b``: the edges ``a, b`` of stars around the smallest node reachable.

    Alternates large and small stars until every node that points to another points
    to one that points nowhere; each round is written,
    and its edges are no more than before. Minima are combined before the shuffle. A
    round reads the edges twice and shuffles them to their smaller end, to their larger
    end and to tell them apart: what it holds of the driver's memory follows the
    number of scans and stages. After a number of ``rounds`` given, nodes may still point to several, but the edges connect what they connected.
    """
    now = settle(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    done, near = 0, Window.partitionBy("a")
    while done != rounds and (rounds or not _are_stars(now)):
        least = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))  # neighbours above a node don't matter to it
        large = now.join(least, "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        small = large.withColumn("m", F.min("b").over(near))
        moved = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = settle(moved.distinct(), "stars")
        done += 1
    return now


def _are_stars(edges: DataFrame) -> bool:
    ends = [F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down")) for c, up in (("a", 1), ("b", 0))]
    ends = edges.select(F.inline(F.array(*ends)))
    ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return ends.filter("up + down > 1 and up > 0").agg(F.count("*")).first()[0] == 0


def labelled(now: DataFrame) -> DataFrame:
    """``node, label``: the smallest node reachable, for every node of ``stars``. If they ended early, labels may
    still differ within a component, but nodes of one label are connected."""
    labels = now.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("label")), F.struct(F.col("b").alias("node"), F.col("b").alias("label")))))
    return settle(labels.groupBy("node").agg(F.min("label").alias("label")), "labels")


def components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """``node, label``: the smallest node reachable, for every node of the edges ``a, b``; see ``stars`` for ``rounds``."""
    return labelled(stars(edges, rounds))


def near_duplicates(docs: DataFrame, p: Banding = Banding()) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, th`` (the text's hash), ``n_shingles, node, label, component_id, kept``.

    Words are runs without space and controls 9 to 13, A-Z as a-z; a text's set is
    its distinct five-word shingles, or its whole word sequence if shorter. Equal
    sets are one node (64 bits of a hash), ``label`` is the component's smallest node (null without words), and a component's id is its smallest
    ``doc_id``. Texts without words (null, empty) are linked with nothing and kept.
    Null ids take part; their component has null only if no member has an id, and
    they are kept then. Rows that repeat an id stay rows of their own.
    """
    rows = settle(_identified(docs).mapInArrow(_signer(p), SIGNED), "signed")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    nodes = rows.filter("node is not null").groupBy("node").agg(F.min(rank).alias("rep"), F.first("halves").alias("halves"), F.first("sketch").alias("sketch"), F.first("odd").alias("odd"), F.first("n_shingles").alias("n_shingles"))
    nodes = settle(nodes.select("node", "n_shingles", F.col("rep.doc_id").alias("rep_id"), _id_key("rep.doc_id").alias("rep_key"), F.col("rep.th").alias("rep_th"), "halves", "sketch", "odd"), "nodes")
    members = buckets(nodes, p)
    tried = settle(star_edges(members, nodes, p), "tried")
    links = confirmed(tried, docs, p).select(F.col("hub").alias("a"), F.col("leaf").alias("b"))
    # The first labels only say which pairs need no look, so two rounds of them do; the others go on from there.
    begun = stars(links, rounds=2)
    rest = settle(open_edges(members, nodes, labelled(begun), tried, p), "rest")
    labels = components(begun.unionAll(confirmed(rest, docs, p)))
    linked = labels.join(nodes.select("node", "rep_id"), "node")
    smallest = linked.groupBy("label").agg(F.min("rep_id").alias("component_id"))
    linked = settle(linked.join(smallest, "label").select("node", "label", "component_id"), "components")
    alone = rows.drop("halves", "sketch", "odd").join(nodes.select("node", "rep_id"), "node", "left").join(linked, "node", "left")
    own = F.when(F.col("node").isNull(), F.col("doc_id")).when(F.col("label").isNull(), F.col("rep_id")).otherwise(F.col("component_id"))
    alone = alone.withColumns({"component_id": own, "label": F.coalesce("label", "node")})
    return alone.select("doc_id", "th", "n_shingles", "node", "label", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, p: Banding = Banding()) -> DataFrame:
    """The rows of ``docs``, one of each component: that with the smallest id (null last), of rows that repeat it that of the smallest text hash.

    Rows that repeat an id with texts that are not alike are of different components,
    so each has its own. Documents without words all stay.
    """
    words = settle(near_duplicates(docs, p), "found").filter("n_shingles > 0")
    first = words.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th")).alias("first"))
    chosen = first.select(_id_key("first.doc_id").alias("id_key"), F.col("first.th").alias("th"))
    counted = words.groupBy(_id_key().alias("id_key"), "th").agg(F.count("*").alias("n"))
    chosen = settle(counted.join(chosen, ["id_key", "th"], "left_semi"), "chosen")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), _id_key().alias("id_key"), F.xxhash64(text).alias("th"), F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")).alias("worded"))
    once = rows.join(chosen.filter("n = 1"), ["id_key", "th"], "left_semi")
    repeated = rows.join(settle(chosen.filter("n > 1"), "repeated"), ["id_key", "th"], "left_semi").dropDuplicates(["id_key", "th"])
    return once.select("row").unionAll(repeated.select("row")).unionAll(rows.filter("not worded").select("row")).select("row.*")
