"""Toxicity, mixing, edit fingerprints, near duplicates."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyflow.llm import editprints, mixing, neardup, queries, toxicity
from tests.llm.conftest import ODD

SMALL = toxicity.Ftrl(bits=16, sample_rows=300, splits=2, rounds=3)


def labelled(corpus, spark):
    rnd = random.Random(9)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = [rnd.choice(words) for _ in range(rnd.randrange(5, 200))]
        for w in rnd.sample(["vile", "grim", "foul"], 2) * bad:
            text.insert(rnd.randrange(len(text)), w)
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    labels += [(0, 0), (None, 1), (1, None), (99_999, 1)]
    return corpus(rows), spark.createDataFrame(labels, "doc_id long, toxic int"), {i for i in range(600) if i % 4 == 0}


def plain_ftrl(rows, p):
    """One coordinate at a time, as the method is written down."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= p.l1:
            return 0.0
        return -(z[i] - math.copysign(p.l1, z[i])) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)

    for at, label in rows:
        w = {i: weight(i) for i in at}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in at:
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / p.alpha
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
    return z, n, {i: weight(i) for i in z}


def test_learning_equals_plain_ftrl():
    rnd, p = random.Random(4), toxicity.Ftrl(bits=8, l1=0.3, l2=0.1, alpha=0.7)
    rows = [(np.array(sorted(rnd.sample(range(256), rnd.randint(1, 20))), np.int32), rnd.randint(0, 1)) for _ in range(300)]
    z, n = np.zeros(256), np.zeros(256)
    toxicity.learn(z, n, rows, p)
    want_z, want_n, want_w = plain_ftrl([(at.tolist(), label) for at, label in rows], p)
    assert z.tolist() == pytest.approx([want_z.get(i, 0.0) for i in range(256)]) and n.tolist() == pytest.approx([want_n.get(i, 0.0) for i in range(256)])
    found = toxicity.weights(z, n, p)
    assert found.tolist() == pytest.approx([want_w.get(i, 0.0) for i in range(256)]) and 0 < np.count_nonzero(found) < 256


def test_toxicity_on_held_out_documents(corpus, spark):
    docs, labels, bad = labelled(corpus, spark)
    learnable = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0
    model = toxicity.fit(docs, labels, SMALL, learnable=learnable)
    assert 0 < len(model.at) < 2000
    rows = docs.select("doc_id", toxicity.score(F.col("text"), model).alias("score")).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.5) == (r.doc_id in bad) for r in held) / len(held) >= 0.95
    again = toxicity.fit(docs, labels, SMALL, learnable=learnable)
    assert (again.at == model.at).all() and again.weight == pytest.approx(model.weight)


def test_toxicity_of_odd_texts_and_without_labels(corpus, spark, odd, nothing):
    docs, labels, _ = labelled(corpus, spark)
    model = toxicity.fit(docs, labels, SMALL)
    got = odd.select("doc_id", toxicity.score(F.col("text"), model).alias("score")).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    blank = toxicity.fit(nothing, labels.limit(0), SMALL)
    assert {r[0] for r in odd.select(toxicity.score(F.col("text"), blank)).collect()} == {0.5}
    assert nothing.select(toxicity.score(F.col("text"), model)).count() == 0


# --- mixing ------------------------------------------------------------------


def brute_targets(sizes):
    """Shares again what a source's limit frees, until no target is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    fixed, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        now = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s: 3.0 * sizes[s] for s in free if now[s] > 3 * sizes[s]}
        if not above:
            return {**fixed, **now}
        fixed |= above


def many(corpus):
    rnd = random.Random(12)
    rows = [(i, "w " * rnd.randrange(0, 400), rnd.choice(["b", "a", "hot", "hot", "hot", "hot", "é", None])) for i in range(900)]
    return rows + [(5000 + i, "w", "tiny") for i in range(3)] + [(6000, None, "void"), (1, rows[1][1], rows[1][2])]


def test_mixing_meets_targets(corpus):
    rows = many(corpus)
    docs = corpus(rows)
    plan, _ = mixing.plan(docs)
    got = plan.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r.size) for r in got) == sorted((i, size(t)) for i, t, _ in rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken == r.copies * r.size <= 3 * r.size and len(r.times) == r.copies
        assert all(0 <= t <= 1 for t in r.times)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(3, 0.01 * t), s
    again, _ = mixing.plan(docs.repartition(7))
    assert {(r.doc_id, r.size, r.taken) for r in again.collect()} == {(r.doc_id, r.size, r.taken) for r in got}


def half_in_one(corpus):
    """Source a's share of the mix has room for its long document only if that comes early; some that follow it are short."""
    rnd = random.Random(3)
    rows = [(1, "w " * 20_000, "a")] + [(10 + i, "w " * rnd.choice([0, 1, 7, 200, 200, 200, 200]), "a") for i in range(200)]
    return corpus(rows + [(1000 + i, "w " * rnd.randrange(100, 1000), "b") for i in range(40)])


@pytest.mark.parametrize("at_once", [1, 256])
def test_mixing_leaves_out_only_what_does_not_fit(corpus, at_once):
    got = mixing.plan(half_in_one(corpus), at_once=at_once)[0].collect()
    for source in "ab":
        rows = [r for r in got if r.source == source]
        gap = rows[0].target - sum(r.taken for r in rows)
        fewest = min(r.copies for r in rows)
        assert 0 <= gap < min([r.size for r in rows if r.copies == fewest]), source
    flat = [r for r in got if r.source == "a" and r.size and r.copies]
    assert all(r.copies == 1 for r in flat) and rows[0].target > rows[0].source_size
    begin = 0  # with the same weight at all times a document begins where the one before ends
    for r in sorted(flat, key=lambda r: r.times):
        assert r.times[0] * r.target == pytest.approx(begin, abs=1e-6)
        begin += r.size


def test_mixing_is_the_same_in_any_number_of_slices(corpus):
    docs = half_in_one(corpus)
    few, many_ = ({(r.doc_id, r.copies, *r.times) for r in mixing.plan(docs, slices=n)[0].collect()} for n in (1, 5))
    assert few == many_


def test_training_order_repeats_rows_by_time(corpus, odd, nothing):
    rows = many(corpus)
    docs = corpus(rows)
    plan, _ = mixing.plan(docs)
    copies = {}
    for r in plan.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    ordered = mixing.training_order(docs)
    assert ordered.columns == docs.columns
    seen = {}
    for r in ordered.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {i: n for i, n in copies.items() if n}
    assert mixing.plan(odd)[0].count() == len(ODD) and mixing.plan(nothing)[0].count() == 0 and mixing.training_order(nothing).count() == 0


def test_schedules_are_inverted(spark):
    knots = ((0.0, 0.5), (0.4, 1.0), (1.0, 1.5))
    steps = 4000
    weight = lambda t: 0.5 + t / 0.4 * 0.5 if t <= 0.4 else 1 + (t - 0.4) / 0.6 * 0.5
    sums = [0.0]
    for i in range(steps):
        sums.append(sums[-1] + weight((i + 0.5) / steps) / steps)
    frame = spark.createDataFrame([(s / sums[-1], i / steps) for i, s in enumerate(sums)][::97], "share double, t double")
    got = frame.select("t", mixing.time_of(F.col("share"), F.lit(0), mixing.Schedule((knots,))).alias("found")).collect()
    assert [r.found for r in got] == pytest.approx([r.t for r in got], abs=1e-3)


# --- edit fingerprints -------------------------------------------------------


def test_fingerprints_of_documents_and_edited_texts(odd, nothing):
    rows = {}
    for r in editprints.fingerprinted(odd, at_once=3000).collect():
        rows.setdefault(r.doc_id, []).append(r)
    texts = {i: t or "" for i, t, *_ in ODD}
    ids = sorted((i for i in texts if i is not None))
    assert len(rows[2]) == 2 and sum(map(len, rows.values())) == len(ODD)
    for i in ids:
        if i in (1, 2):  # the next is one of two equal rows, or the other one
            continue
        text, following = texts[i], texts[ids[ids.index(i) + 1]] if i != ids[-1] else texts[None]
        n = len(text) // 4
        changed = text[: len(text) - n] + following[:n]
        (r,) = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        own, other, ahead = editprints.fingerprints([text, changed, following])
        assert (r.fingerprint, r.edited_fingerprint) == (own, other)
        assert r.near_edited == editprints.likeness(own, other) and r.near_next == editprints.likeness(own, ahead)
    assert rows[10][0].fingerprint == rows[1][0].fingerprint == rows[11][0].fingerprint
    assert editprints.fingerprinted(nothing).count() == 0
    (alone,) = editprints.fingerprinted(odd.filter("doc_id = 1")).collect()
    assert alone.near_next == 1.0


def test_likeness_follows_edits():
    rnd = random.Random(6)
    text = "".join(rnd.choice("etaoin shrdlu") for _ in range(4000))
    other = "".join(rnd.choice("etaoin shrdlu") for _ in range(4000))
    own, far, less = editprints.fingerprints([text, other, text[:3000] + other[:1000]])
    moved = editprints.fingerprints([text[:500] + "x" + text[500:2000] + text[2003:]])[0]
    assert editprints.likeness(own, own) == 1 and editprints.likeness(own, far) < 0.1
    assert 0.65 < editprints.likeness(own, less) < 0.85 and editprints.likeness(own, moved) > 0.8
    assert set(editprints.bands(own)) & set(editprints.bands(moved)) and not set(editprints.bands(own)) & set(editprints.bands(far))
    longer = editprints.fingerprints([text + text[:200]])[0]  # one more level
    assert longer.split(":")[0] != own.split(":")[0] and editprints.likeness(own, longer) > 0.85
    assert editprints.likeness("0:", "0:") == 1 and editprints.likeness("0:", own) == 0


@pytest.mark.parametrize("quarter", range(4))
def test_bands_see_all_windows_of_a_text(quarter):
    rnd = random.Random(8)
    for n in (60, 130, 1000, 4000):
        met = 0
        for own in editprints.fingerprints(["".join(rnd.choice("etaoin shrdlu") for _ in range(n)) for _ in range(20)]):
            level, notes = own.split(":")
            few = len(notes) // 4
            other = "".join(rnd.choice(editprints.LETTERS[1:]) for _ in range(few))
            changed = notes[: quarter * few] + other + notes[(quarter + 1) * few :]
            met += bool(set(editprints.bands(own)) & set(editprints.bands(f"{level}:{changed}")))
        assert 13 <= met <= 20, n
    assert editprints.bands("0:") == []


@pytest.mark.parametrize("block", [2, 1024])
def test_near_documents_equal_brute_force(corpus, block):
    rnd = random.Random(21)
    draw = lambda n: "".join(rnd.choice("etaoin shrdlu") for _ in range(n))
    texts = [None, "", "a", "ab"]
    for n in (5, 30, 127, 300, 2000):
        for _ in range(4):
            text = draw(n)
            texts += [text, text, draw(n), text + draw(1 + n // 40)]
            for at in (n // 9, n // 2):
                texts.append(text[:at] + "x" + text[at + 1 :])
    rnd.shuffle(texts)
    rows = editprints.with_near(editprints.fingerprinted(corpus(enumerate(texts))), block=block).collect()
    prints = {r.doc_id: r.fingerprint for r in rows}
    want = {i: sum(j != i and editprints.likeness(p, q) >= 0.9 for j, q in prints.items()) for i, p in prints.items()}
    assert {r.doc_id: r.near_docs for r in rows} == want and len(rows) == len(texts)
    assert sum(n > 1 for n in want.values()) > 30 and 0 in want.values()
    levels = {p.split(":")[0] for p in prints.values()}
    assert len(levels) > 2


# --- near duplicates ---------------------------------------------------------


def near_rows():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows = []
    for g in range(12):
        base = [word() for _ in range(rnd.choice([12, 40, 150]))]
        for k in range(rnd.choice([1, 2, 9, 30])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 3])):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    shared = [word() for _ in range(30)]
    rows += [(len(rows) + i, " ".join(shared + [word() for _ in range(20)])) for i in range(60)]  # a common passage links nothing
    return rows + [(900 + i, t) for i, (_, t, *_) in enumerate(ODD)] + [(None, rows[0][1]), (3, rows[3][1]), (3, rows[3][1])]


def brute_components(rows):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                label[root(a)] = root(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, len(sets[i]), least.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)]


def test_near_duplicates_equal_brute_force(corpus, nothing):
    rows = near_rows()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    got = neardup.near_duplicates(corpus(rows)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute_components(rows), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.near_duplicates(nothing).count() == 0


def test_one_document_of_each_group_stays(corpus, nothing):
    rows = near_rows()
    docs = corpus(rows)
    left = neardup.deduplicated(docs)
    assert left.columns == docs.columns
    want = sorted({c for _, n, c in brute_components(rows) if n}) + sorted(d for d, n, _ in brute_components(rows) if not n)
    assert sorted(r.doc_id for r in left.collect()) == sorted(want)
    assert neardup.deduplicated(nothing).count() == 0


def test_odd_sketches_drop_no_link():
    rnd = random.Random(2)
    numbers = lambda n: [rnd.getrandbits(64) for _ in range(n)]
    rows, linked = [], []
    for n in (1, 8, 150, 500, 512, 513, 600, 1024, 1030, 5000):
        for share in (1.0, 0.9, 0.8, 0.76, 0.75, 0.7, 0.5, 0.0):
            both = round(2 * n * share / (1 + share))
            a = numbers(n)
            b = a[:both] + numbers(n - both)
            linked.append(100 * both >= 75 * (2 * n - both))
            rows.append([neardup._odd_sketch(np.array(sorted(x), np.uint64)) for x in (a, b)] + [n])
    odd, other, n = (np.array([r[k] for r in rows]) for k in range(3))
    kept = set(np.flatnonzero(neardup._oddly_may_link(odd, other, n, n, neardup.Banding())))
    assert {i for i, x in enumerate(linked) if x} <= kept
    assert not any(i in kept for i in range(8, len(rows)) if i % 8 >= 6)  # half or less shared; a single member is all or nothing


def test_many_texts_of_a_cell_that_stay_apart(corpus):
    """Variants of one text around the threshold; small blocks, so that cells are split."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    base, rows = [word() for _ in range(120)], []
    for i in range(150):
        copy = list(base)
        for _ in range(rnd.choice([1, 2, 3, 4, 5, 6])):
            copy[rnd.randrange(len(copy))] = word()
        rows.append((i, " ".join(copy)))
    got = neardup.near_duplicates(corpus(rows), neardup.Banding(block=16)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))


def test_texts_that_share_an_id_but_nothing_else_all_stay(corpus):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(5, a), (5, b), (6, b), (7, c), (None, "n1 " + a), (None, "z z z z z z z"), (None, "z z z z z z z"), (8, ""), (8, None)]
    left = sorted(((r.doc_id, r.text) for r in neardup.deduplicated(corpus(rows)).collect()), key=repr)
    assert left == sorted([(5, a), (5, b), (7, c), (None, "z z z z z z z"), (8, ""), (8, None)], key=repr)


def test_labels_of_a_few_rounds_join_only_what_is_connected(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(30)]
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long"), rounds=2).collect()}
    assert set(got) == {*range(51), 100, *range(200, 230)}
    assert all((node <= 50) == (label <= 50) for node, label in got.items()) and len(set(got.values())) < len(got)


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(1)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, 101 + i) for i in range(50)] + [(130, 500)]
    edges = chain + star + [(700, 700), (801, 800), (800, 801)]
    rnd.shuffle(edges)
    got = {r.node: r.label for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 151)}, 500: 100, 800: 800, 801: 800}


def test_a_state_travels_by_what_moved(corpus, spark, monkeypatch):
    sent, put = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: (isinstance(value, tuple) and sent.append(value), put(value))[1])
    rows = [(i, f"good day {i}" if i % 2 else f"vile day {i}") for i in range(40)]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(corpus(rows), labels, toxicity.Ftrl(rounds=2, l1=0.1))
    assert len(sent) == 2 and len(sent[0][0]) == 0 and all(len(x) < 1000 for state in sent for x in state)
    assert len(sent[1][0]) >= len(model.at) > 0 and set(model.at) <= set(sent[1][0].tolist())


def test_components_go_on_from_the_first_stars(corpus, monkeypatch):
    written, settle = [], neardup.settle
    monkeypatch.setattr(neardup, "settle", lambda df, name: (written.append(name), settle(df, name))[1])
    rows = [(i, f"a b c d e f g h i j k l m n o p q r s t {'u' if i % 2 else 'v'}") for i in range(20)] + [(50, "alone")]
    got = neardup.near_duplicates(corpus(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))
    assert written.count("stars") == 4  # two rounds, and nothing left to do then


def test_stars_with_repeated_and_crossing_edges(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(260)] * 2 + [(1000, i) for i in range(0, 300, 7)]
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(len(least)):
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    frame = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in neardup.components(frame).collect()} == least
    begun = neardup.stars(frame.limit(400), rounds=1).unionAll(frame)
    assert {r.node: r.label for r in neardup.components(begun).collect()} == least


def test_near_duplicates_get_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    queries.op7_minhash_neardup(spark, "/root/testdata/sf0.001").count()
    assert spark.conf.get(key) == "4m"


def test_the_driver_gives_back_what_a_fit_collected(corpus, spark, monkeypatch):
    freed, pool = [], toxicity.pa.default_memory_pool()

    class Pool:
        def release_unused(self):
            freed.append(pool.release_unused())

    monkeypatch.setattr(toxicity.pa, "default_memory_pool", Pool)
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    toxicity.fit(corpus([(i, f"day {i % 2}") for i in range(10)]), labels, toxicity.Ftrl(rounds=2))
    assert len(freed) == 2


def test_near_duplicates_take_few_scans_and_shuffles(corpus, monkeypatch):
    plans, settle = {}, neardup.settle

    def planned(df, name):
        text = df._jdf.queryExecution().executedPlan().toString()
        plans.setdefault(name, []).append((text.count("FileScan"), text.count("Exchange hashpartitioning")))
        return settle(df, name)

    monkeypatch.setattr(neardup, "settle", planned)
    rows = [(i, f"a b c d e f g h i j k l m n o p q r s t {'u' if i % 2 else 'v'}") for i in range(20)] + [(50, "alone")]
    got = neardup.near_duplicates(corpus(rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows))
    most = {"stars": (2, 4), "labels": (1, 1), "links": (4, 8)}  # the driver's memory follows them
    assert all(scans <= most[name][0] and shuffles <= most[name][1] for name in most for scans, shuffles in plans[name]), plans
