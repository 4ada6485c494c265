"""Exact top-k, bit planes, packing: against brute force and exact round trips."""

import random
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyflow.llm import bitplanes, packing, topk
from tallyflow.llm.common import Chunked, text_bytes, token_bytes
from tallyflow.llm.queries import vocabulary
from tests.llm.conftest import ODD

WORDS, BYTES = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")


def brute_top(rows, k):
    usable = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (q, u) in enumerate(usable):
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(u, v)), i) for b, (i, v) in enumerate(usable) if b != a and len(v) == len(u))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def vectors():
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(6)]) for i in range(260)]
    rows += [(i, rows[5][1]) for i in range(300, 340)]  # ties
    rows += [(400, rows[5][1]), (400, rows[5][1]), (500, []), (501, []), (600, [0.5, 0.25]), (None, [1.0] * 6), (700, None), (701, [None] * 6)]
    return rows + [(702, [float("nan")] * 6), (703, [float("inf")] * 6), (800, [0.1] * 6)]


@pytest.mark.parametrize("sizes", [{}, {"query_block": 2, "shard": 16, "fan_in": 2}])
def test_topk_equals_brute_force(spark, sizes):
    frame = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(5)
    got = topk.search(frame, F.col("vec_id") % 100 == 0, **sizes)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == brute_top(vectors(), 10)
    assert topk.search(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_products_beyond_doubles_are_exact():
    q, c = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**20 + 1, 5.0], [2.0**30, 7.0]])
    assert topk.products(q, c).tolist() == [[(2**40 + 1) * (2**20 + 1) + 15, min(2**63 - 1, (2**40 + 1) * 2**30 + 21)]]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_chunked_ids_are_those_of_whole_texts(path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    rnd = random.Random(3)
    marks = [chr(rnd.choice([32, 9, 10, 0x2003, 0x85, 0xA0, 65, 97, 0xE9, 0x4E2D, 0x1F600, 39, 115, 0x301, 0x1C, 0x200D])) for _ in range(3000)]
    texts = ["", " a  b\t\nc ", "it's  we'll 's　　q  ", "é Σας ΟΔΟΣ ́x", "don't''s 12 ½ ٣ <|endoftext|> z", "".join(marks), "y" * 300 + " y"]
    texts += [t for _, t, *_ in ODD if t]
    got = [np.frombuffer(b, "<u4").tolist() for b in token_bytes(path, pa.array(texts))]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_every_letter_before_a_mark_and_random_texts_equal_the_library(path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    rnd = random.Random(9)
    marks = [chr(b) for b in range(33, 127) if not chr(b).isalnum()]
    texts = ["ab" + c + rnd.choice(marks) + "x" for c in map(chr, range(0x110000)) if unicodedata.category(c)[0] in "LM"]
    texts += ["".join(p) for m in marks for p in (("a", m), ("\u00e9", m), ("\u0130", m), ("\u0958", m), ("\u017f", m, m))]
    pool = [*" \t\n\r'st.,!Aa", *"\x85\xa0\u1680\u2003\u2028\u3000\xe9\xd7\xf7\u0130\u0149\u017f\u0301\u0338\u0958\u4e2d\U0001f600\x1c\u200d\xbd\u0663\u03a3\u212b\xdf"]
    texts += ["".join(rnd.choices(pool, k=rnd.randint(0, 30))) for _ in range(20_000)]
    got = list(token_bytes(path, pa.array(texts)))
    want = [np.array(e.ids, "<u4").tobytes() for at in range(0, len(texts), 5_000) for e in whole.encode_batch_fast(texts[at : at + 5_000], add_special_tokens=False)]
    assert [t for t, a, b in zip(texts, got, want, strict=True) if a != b] == []


def test_a_full_memory_of_chunks_changes_no_ids():
    texts = pa.array([f"w{i} w{i % 7} {'z' * 70}{i}, end" for i in range(300)])
    small, large = Chunked(WORDS, most=50), Chunked(WORDS)
    for at in range(0, 300, 20):
        part = texts.slice(at, 20)
        assert [a.tolist() for a in small.encode(*text_bytes(part))] == [a.tolist() for a in large.encode(*text_bytes(part))]


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_planes_and_files_round_trip(kind):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        assert (bitplanes.from_planes(bitplanes.to_planes(ids, kind), n, kind) == ids).all()
    docs = [rng.integers(0, 50_000, n).astype("<u4").tobytes() for n in (3, 0, 500, 64, 1)]
    assert list(bitplanes.read_file(bitplanes.write_file(docs, kind, chunk_ids=64))) == docs
    assert list(bitplanes.read_file(bitplanes.write_file([], kind))) == []
    with pytest.raises(ValueError):
        list(bitplanes.read_file(b"\0" * 64))


def tokens_of(path, end):
    texts = [t for _, t, *_ in ODD]
    return [(i, np.append(np.frombuffer(b, "<u4"), end).astype("<u4")) for (i, *_), b in zip(ODD, token_bytes(path, pa.array(texts)))]


@pytest.mark.parametrize("kind", ["bit", "byte"])
def test_token_files_hold_every_document_in_order(odd, kind):
    files = bitplanes.write(odd, WORDS, kind=kind, chunk_ids=100, file_ids=300)
    assert files.count() >= 3
    rows = bitplanes.read(files).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted((i for i, *_ in ODD), key=lambda i: (i is not None, i))
    at, want = 0, sorted((-1 if i is None else i, t.tobytes()) for i, t in tokens_of(WORDS, 2))
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in rows) == want


def test_empty_tables_give_empty_results(nothing):
    assert bitplanes.read(bitplanes.write(nothing, WORDS)).count() == 0
    assert packing.pack(nothing, BYTES).count() == 0


@pytest.mark.parametrize("cell", [200, 1 << 21])
def test_packing_holds_every_token_once_without_padding(odd, cell):
    rows = packing.pack(odd, BYTES, tiers=packing.Tiers(cell_tokens=cell, step_tokens=4096), with_ids=True).collect()
    sequences, documents = {}, {}
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length > 0
        sequences.setdefault(r.sequence_id, []).append(r)
        documents.setdefault((r.doc_id, r.doc_tokens, r.start), []).append(bytes(r.ids))
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        ends = [r.offset + r.length for r in pieces]
        assert [r.offset for r in pieces] == [0, *ends[:-1]]
        assert ends[-1] == pieces[0].tier <= 1024 and ends[-1] & (ends[-1] - 1) == 0
    want = sorted(t.tobytes() for _, t in tokens_of(BYTES, 0))
    assert sum(map(len, want)) == 4 * sum(r.length for r in rows)
    by_doc = {}
    for (doc, n, start), ids in sorted(documents.items(), key=lambda x: (str(x[0][0]), x[0][1], x[0][2])):
        by_doc.setdefault((doc, n), []).append(ids)
    for (doc, n), parts in by_doc.items():  # rows that repeat a document are packed as often
        copies = sum(len(t) == n for i, t in tokens_of(BYTES, 0) if i == doc)
        assert sum(len(x) for p in parts for x in p) == 4 * n * copies
    cells = {}
    for pieces in sequences.values():
        groups = cells.setdefault(pieces[0].step_group >> 32, {})
        groups[pieces[0].step_group] = groups.get(pieces[0].step_group, 0) + pieces[0].tier
    assert all(max(g.values()) - min(g.values()) <= 1024 for g in cells.values())


def test_long_windows_are_filled_from_shorter_tiers():
    sequences = packing.packed([700, 300, 24, 2000, 5], packing.Tiers())
    assert [(3, 1024, 976), (2, 0, 24), (4, 0, 5), (0, 0, 19)] in sequences
    assert all(sum(p[2] for p in s) & (sum(p[2] for p in s) - 1) == 0 for s in sequences)
    assert sum(p[2] for s in sequences for p in s) == 3029
