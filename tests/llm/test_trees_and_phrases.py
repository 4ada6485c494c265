"""Matched packing, phrase collocations and Merkle manifests against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyflow.llm import matching, merkle, phrases
from tallyflow.llm.common import token_bytes
from tallyflow.llm.queries import lower_ascii, vocabulary
from tests.llm.conftest import ODD

WORDS = vocabulary("word_bpe_49k.json")

# --- matched packing ---------------------------------------------------------


def sequences_of(counts, capacity):
    """The lengths in each sequence; checks that every piece is placed once and without gaps."""
    held, seen = defaultdict(list), Counter()
    for length, first, count, sequence, offset in matching.plan(counts, capacity):
        assert first == seen[length]
        seen[length] += count
        for i in range(count):
            held[sequence + i].append((offset, length))
    assert seen == +Counter(counts)
    assert sorted(held) == list(range(len(held)))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return [[n for _, n in sorted(p)] for p in held.values()]


def fewest(lengths, capacity):
    best = len(lengths)

    def put(at, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if at == len(lengths):
            best = len(gaps)
            return
        for gap in set(gaps):
            if gap >= lengths[at]:
                rest = list(gaps)
                rest.remove(gap)
                put(at + 1, [*rest, gap - lengths[at]])
        put(at + 1, [*gaps, capacity - lengths[at]])

    put(0, [])
    return best


def test_a_plan_places_every_piece_and_needs_hardly_more_than_the_fewest_sequences():
    rnd = random.Random(2)
    for _ in range(60):
        lengths = sorted((rnd.randint(1, 30) for _ in range(rnd.randint(0, 9))), reverse=True)
        assert len(sequences_of(Counter(lengths), 30)) <= fewest(lengths, 30) + 1
    counts = Counter(min(4096, max(1, int(rnd.lognormvariate(6, 1)))) for _ in range(20_000))
    assert len(sequences_of(counts, 4096)) <= 1.001 * sum(n * k for n, k in counts.items()) / 4096 + 1
    assert matching.plan({}, 4096) == []


def test_large_pieces_get_as_many_pairs_as_there_can_be():
    rnd = random.Random(5)
    for _ in range(200):
        lengths = [rnd.randint(11, 30) for _ in range(rnd.randint(0, 10))]
        held = sequences_of(Counter(lengths), 30)
        assert all(sum(3 * n > 30 for n in s) <= 2 for s in held)

        def most(rest):
            if len(rest) < 2:
                return 0
            a, *others = rest
            return max([most(others)] + [1 + most(others[:i] + others[i + 1 :]) for i, b in enumerate(others) if a + b <= 30])

        assert sum(len(s) == 2 for s in held) == most(lengths)


def test_the_number_of_runs_follows_the_capacity():
    few, many = ({n: k for n in range(1, 513)} for k in (3, 3_000_000))
    assert len(matching.plan(many, 512)) <= 4 * len(matching.plan(few, 512))


def test_pieces_hold_the_tokens_of_every_document(odd, nothing):
    texts = [t for _, t, *_ in ODD]
    want = sorted((i is not None, i or 0, np.append(np.frombuffer(b, "<u4"), 1).astype("<u4").tobytes()) for (i, *_), b in zip(ODD, token_bytes(WORDS, pa.array(texts)), strict=True))
    rows = matching.pack(odd, WORDS, capacity=256, with_ids=True).collect()
    assert all(len(r["ids"]) == 4 * r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["start"] == 256 * r["piece"] for r in rows)
    held, whole = defaultdict(list), defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        whole[r["doc_id"]].append((r["piece"], r["ids"]))
    for pieces in held.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 256
    tokens = sum(len(b) for *_, b in want) // 4
    assert len(held) <= -(-tokens // 256) + 1
    single = Counter(i for i, *_ in ODD)
    for i, pieces in whole.items():
        if single[i] == 1:
            assert (i is not None, i or 0, b"".join(b for _, b in sorted(pieces))) in want
    assert sum(len(r["ids"]) for r in rows) == 4 * tokens
    assert matching.pack(nothing, WORDS).collect() == []


def test_the_number_of_sequences_does_not_depend_on_partitions(odd):
    numbers = {matching.pack(odd.repartition(n), WORDS, capacity=128).select("sequence_id").distinct().count() for n in (1, 4, 11)}
    assert len(numbers) == 1


# --- phrases -----------------------------------------------------------------


def brute_phrases(rows, p):
    up = {c: c + 32 for c in range(65, 91)}
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(up)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + k]) for k in range(1, p.longest + 1) for i in range(len(words) - k + 1))
    often = {g: n for g, n in counts.items() if n >= p.least}
    longer = Counter()
    for (lang, *ws), n in often.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                inner = (lang, *ws[i : i + k])
                longer[inner] = max(longer[inner], n)
    found = defaultdict(list)
    for (lang, *ws), a in often.items():
        if len(ws) > 1 and longer[(lang, *ws)] < a:
            n = totals[lang]
            cuts = [(1000 * a * n // (counts[(lang, *ws[:k])] * counts[(lang, *ws[k:])]), k) for k in range(1, len(ws))]
            score, k = min(cuts)
            found[lang].append((-score, -a, " ".join(ws).encode(), counts[(lang, *ws[:k])], counts[(lang, *ws[k:])], n))
    return sorted((lang, r, w.decode(), -a, left, right, n, -s) for lang, xs in found.items() for r, (s, a, w, left, right, n) in enumerate(sorted(xs)[: p.top], 1))


def phrase_rows():
    rnd = random.Random(8)
    vocabulary = [w for i in range(40) for w in [f"w{i}"] * (1 + 200 // (i + 1))]
    rows = []
    for i in range(150):
        words = [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 120))]
        if i % 3 == 0:
            words[2:2] = ["The", "QUICK", "brown", "fÖx", "Ünder"]
        rows.append((rnd.choice(["en", "de", None, "und"]), "".join(w + rnd.choice([" ", " ", "  ", "\t", ", ", ".", "\n", "!?", "\x00 "]) for w in words)))
    rows += [("en", None), (None, ""), ("en", " . ,, "), ("xx", "the the the the the the the the"), ("de", "hot pair " * 3000), ("de", "hot pair word " * 400), ("", "no language " * 9)]
    return rows


@pytest.mark.parametrize("more", [{}, {"cells": 9, "chunks": 2, "budget": 20, "spread": 3, "at_once": 50}, {"cells": 4, "chunks": 1, "budget": 5}, {"top": 7, "longest": 3}])
def test_collocations_equal_brute_force(spark, more):
    p = replace(phrases.Mining(least=8, cells=16), **more)
    frame = spark.createDataFrame([(lang, text, 1, 2, "x") for lang, text in phrase_rows()], "lang string, text string, n int, path int, word string").repartition(5)
    got = phrases.collocations(frame, p)
    assert got.dtypes == [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute_phrases(phrase_rows(), p)


def test_counts_are_exact_for_one_phrase_that_holds_a_third_of_all_rows(spark):
    rows = [("en", "one two three four five six")] * 300 + [("en", f"one two x{i} four five") for i in range(600)]
    p = phrases.Mining(least=50, cells=12, chunks=2, budget=10)
    found, totals = phrases.frequent_phrases(spark.createDataFrame(rows, "lang string, text string").repartition(7), p)
    counts = {r["phrase"]: r["n"] for r in found.collect()}
    assert counts["one two"] == 900 and counts["four five"] == 900 and counts["two three four five six"] == 300 and "x1" not in counts
    assert totals.collect()[0]["words"] == 300 * 6 + 600 * 5


def test_tables_without_phrases_give_no_rows(spark, nothing):
    assert phrases.collocations(nothing).collect() == []
    assert phrases.collocations(spark.createDataFrame([(None, None), ("en", "a b")], "lang string, text string")).collect() == []


# --- manifests ---------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(nodes, fan):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = a // fan * fan
            paths[i].append(("".join(nodes[run:a]), "".join(nodes[a + 1 : run + fan])))
            at[i] = a // fan
        nodes = [sha(*nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], paths


def brute_manifest(rows, fan):
    groups = defaultdict(list)
    for doc_id, source, leaf, found in rows:
        groups[source].append((doc_id, leaf, found or leaf))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[s] = brute_tree([r[1] for r in groups[s]], fan)
    root, tops = brute_tree([trees[s][0] for s in order], fan) if order else (None, [])
    out = []
    for s, top in zip(order, tops):
        for (doc_id, leaf, found), own in zip(groups[s], trees[s][1]):
            acc = found
            for before, after in own + top:
                acc = sha(before, acc, after)
            out.append((doc_id, leaf, trees[s][0], root, sha(*(b + a for b, a in own + top)), acc, acc == root))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("tree", [merkle.Tree(), merkle.Tree(2, 1), merkle.Tree(3, 2), merkle.Tree(16, 1)])
def test_manifests_equal_plain_python(spark, tree):
    sizes = {None: 1, "": 2, "a": 1, "b": 15, "c": 16, "d": 17, "e": 33, "é": 289, "hot": 300, "z": 4}
    rows = [(i if i else None, s, sha(str(s), str(i)), sha("other") if i % 5 == 3 else None) for s, n in sizes.items() for i in range(n)]
    rows += [(7, "z", sha("again"), None), (7, "z", sha("again"), None), (None, "z", sha("none"), sha("tampered")), (None, None, sha("none"), None)]
    rows += [(1, f"s{k}", sha(str(k)), None) for k in range(20)]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, source string, leaf string, found string").withColumn("total", F.lit(1)).repartition(4)
    got = [tuple(r) for r in merkle.manifest(frame, tree).collect()]
    assert in_order(got) == in_order(brute_manifest(rows, tree.fan))
    assert {r[6] for r in got} == {True, False}


def test_manifests_of_one_leaf_one_source_and_nothing(spark):
    for rows in ([(1, "a", sha("x"), None)], [(i, "a", sha(str(i)), None) for i in range(20)], [(1, s, sha(s), None) for s in "ab"], []):
        frame = spark.createDataFrame(rows, "doc_id long, source string, leaf string, found string")
        assert in_order(map(tuple, merkle.manifest(frame).collect())) == in_order(brute_manifest(rows, 16))


def test_leaves_tell_nulls_empty_and_shifted_fields_apart(odd):
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]

    def one(values):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    got = [r["leaf"] for r in odd.select(*(c.alias(f"f{i}") for i, c in enumerate(row)), merkle.leaf(*row).alias("leaf")).collect()]
    want = [one(r) for r in odd.select(*row).collect()]
    assert got == want


def test_only_ascii_letters_are_lowered(spark):
    texts = ["ABC xyz", "ÀÉ Straße İ ABC", "", None, "ΣΑΣ Z"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(lower_ascii(F.col("text"))).collect()]
    assert got == [None if t is None else t.translate({c: c + 32 for c in range(65, 91)}) for t in texts]
