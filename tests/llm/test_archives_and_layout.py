"""WARC archives, Hilbert shards, token rollups, the pipeline and the contract queries."""

import base64
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyflow.llm import hilbert, mixing, queries, rollup, toxicity, warc
from tallyflow.session import scratch_path, settle
from tests.llm.conftest import ODD

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="benchmark tables are not here")


def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>") for i in range(60)]
    rows += [(100, "u", None), (101, None, ""), (102, "line\r\nbreak", ""), (5, "http://h/5", "<p>5</p>"), (None, "n", "<p>3</p>"), (None, "n", "only"), (103, "é", "ü\r\n\r\n" * 30_000)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"sha1": F.lit("x"), "first": F.lit("y")}).repartition(4)


def brute_pages(rows, least=0):
    out, seen = [], {}
    for page, url, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        data = (html or "").encode()
        of = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = of not in seen
        seen.setdefault(of, page)
        known = first or len(data) < least
        out.append((page, len(data), of, "response" if known else "revisit", None if known else seen[of]))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    rows, frame = pages(spark)
    archives = warc.deduplicated(frame, min_bytes=least, archive_bytes=500)
    found = warc.resolved(archives, with_payload=True).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == brute_pages(rows, least)
    assert {bytes(r.payload).decode() for r in found if r.record_type == "response"} == {h or "" for _, _, h in rows}
    assert {r.url for r in found if r.page_id == 102} == {"line%0D%0Abreak"}
    assert warc.resolved(warc.deduplicated(frame.limit(0))).count() == 0


def test_a_damaged_payload_is_an_error():
    r = {"page_id": 1, "url": "u", "sha1": hashlib.sha1(b"abc").hexdigest(), "payload_bytes": 3, "html": "abc", "record_type": "response", "copy": 0}
    text = warc.record(r, "2024-01-01T00:00:00Z")
    import gzip

    ((fields, block),) = warc.records(gzip.compress(text))
    assert fields["WARC-Payload-Digest"] == "sha1:" + warc.digest(b"abc") and block.endswith(b"\r\n\r\nabc")


def test_the_curve_visits_neighbours(spark):
    for dims, bits in ((2, 3), (3, 2)):
        cells = list(product(range(1 << bits), repeat=dims))
        frame = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(dims)))
        rows = frame.select("*", hilbert.index([F.col(c) for c in frame.columns], bits).alias("h")).orderBy("h").collect()
        assert [r.h for r in rows] == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(x[:dims], y[:dims])) == 1 for x, y in zip(rows, rows[1:]))


@pytest.mark.parametrize("copies", [1, 40])
def test_shards_cut_the_rows_evenly(corpus, nothing, copies):
    rows = ODD + [(77, "same", "s", "en")] * copies
    got = hilbert.shards(corpus(rows)).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    sizes = [len(slots.get(i, [])) for i in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert hilbert.shards(nothing).count() == 0
    docs = corpus(rows)
    assert hilbert.along_curve(docs).columns == docs.columns and hilbert.along_curve(docs).count() == len(rows)


def test_a_batch_committed_while_others_are_folded_counts_once(spark):
    path = scratch_path(spark, "rollup-race")
    totals, other = rollup.TokenRollup(spark, path), rollup.TokenRollup(spark, path)
    row = lambda n: spark.createDataFrame([("insert", "a", "en", "v1", n)], "op string, source string, lang string, tokenizer string, tokens long")
    totals.commit("one", row(1))
    listing, late = totals.runs.committed, []

    def committed(*args):
        found = listing(*args)
        if not late:
            late.append(other.commit("two", row(10)))
        return found

    totals.runs.committed = committed
    totals.compact()
    for now in (totals, other, rollup.TokenRollup(spark, path)):
        assert [tuple(r) for r in now.totals().collect()] == [("a", "en", "v1", 2, 11)] and now.committed() == ["one", "two"]
    other.compact()
    assert [tuple(r) for r in totals.totals().collect()] == [("a", "en", "v1", 2, 11)] and not totals.commit("two", row(10))


def test_rollup_batches_count_once(spark):
    totals = rollup.TokenRollup(spark, scratch_path(spark, "rollup-test"))
    schema = "op string, source string, lang string, tokenizer string, tokens long, old_tokens long"
    batch = lambda *rows: spark.createDataFrame(rows, schema)
    load = batch(("insert", "a", "en", "v1", 5, None), ("insert", "a", "en", "v1", 7, None), ("insert", None, None, "v1", None, None))
    assert totals.totals().count() == 0
    assert totals.commit("load/1", load) and not totals.commit("load/1", load)
    totals.commit("two", batch(("delete", "a", "en", "v1", 7, None), ("revise", "a", "en", "v1", 9, 5), ("insert", "b", "fr", "v2", 3, None)))
    want = {("a", "en", "v1", 1, 9), (None, None, "v1", 1, 0), ("b", "fr", "v2", 1, 3)}
    assert {tuple(r) for r in totals.totals().collect()} == want
    totals.compact()
    assert not totals.commit("two", load) and {tuple(r) for r in totals.totals().collect()} == want
    totals.commit("three", batch(("delete", "b", "fr", "v2", 3, None)))
    totals.commit("nothing", load.limit(0))
    totals.compact()
    assert {tuple(r) for r in totals.totals().collect()} == want - {("b", "fr", "v2", 1, 3)}
    with pytest.raises(Exception, match="unknown op"):
        totals.commit("bad", batch(("replace", "a", "en", "v1", 1, None)))
    # A batch that failed half-way has no marker and is written again.
    load.limit(0).write.parquet(totals.runs.fresh())
    assert "half" not in totals.committed() and totals.commit("half", load)


@pytest.fixture(scope="module")
def written(corpus, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    corpus(ODD).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_rollup_query_equals_brute_force(spark, written):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want, seen = {}, set()
    place = lambda r: (r[0] is None, r[0] or 0, len(r) > 2 and r[2] is None)
    for doc, text, *more in sorted(ODD, key=place):
        if (text or "") in seen:
            continue
        seen.add(text or "")
        source, lang = (*more, *(["s", "en"][len(more) :]))
        n, tokens = want.get((source, lang), (0, 0))
        want[source, lang] = n + 1, tokens + len(encode.encode(text or "", add_special_tokens=False).ids) + 1
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in queries.REGISTERED["op10_token_rollup"](spark, written).collect()}
    assert got == want


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_contract_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df, rel = queries.REGISTERED[name](spark, FOLDER), con.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


@tables
def test_pipeline_stages_keep_what_they_should(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, left = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        before, left = left, stage(spark, left, FOLDER)
        left.write.parquet(path := scratch_path(spark, name))
        left = spark.read.parquet(path)
        if name != "packing":
            assert left.columns == columns
        if name in ("toxicity", "near_duplicates"):
            assert left.exceptAll(before).count() == 0 and 0 < left.count() < before.count()
        if name == "mixing":
            plan, _ = mixing.plan(before)
            assert left.count() == plan.agg(F.sum("copies")).first()[0]
    pieces = left.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    whole = left.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.first("tier").alias("tier"))
    assert pieces[0] > 0 and whole.filter("n != tier").count() == 0


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0d]+", text or "")


def plain_set(text):
    words = plain_words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def planted(spark, folder, rows, labels):
    columns = "doc_id long, text string, lang string, source string, n_chars long, score string, label string, time string"
    full = [(i, t, "en", s, len(t or ""), "x", "y", "z") for i, t, s in rows]
    spark.createDataFrame(full, columns).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def planted_rows():
    """Clean and toxic documents, near and exact copies, odd texts, null and repeated ids."""
    rnd = random.Random(11)
    rows, labels = [], []
    for i in range(400):
        words = [f"word{rnd.randint(0, 900)}" for _ in range(rnd.randint(12, 60))]
        toxic = i % 5 == 1
        for k in range(0, len(words), 4) if toxic else ():
            words[k] = rnd.choice(["scum", "filth", "vermin"])
        rows.append((i, " ".join(words), ["a", "b", None, "hot", "hot"][i % 5 if not toxic else 3]))
        labels.append((i, 1, int(toxic)))
    for i in range(40):  # copies, every other one with a word more
        text = rows[5 * i][1]
        rows.append((1000 + i, text + " tail" * (i % 2), "b"))
    rows += [(2000, None, "a"), (2001, "", None), (2002, " \n ", "a"), (None, "no id but these words are here now", "b"), (2003, "long " * 3000 + "end", "hot")]
    rows += [(2004, "same id one two three four five", "a"), (2004, "another text under this id six seven", "a"), (2005, "repeated row all of it here", "b"), (2005, "repeated row all of it here", "b")]
    return rows, labels


def test_the_pipeline_equals_plain_python_on_planted_documents(spark, tmp_path):
    rows, labels = planted_rows()
    planted(spark, tmp_path, rows, labels)
    docs = queries.table(spark, str(tmp_path), "documents")
    model = toxicity.fit(docs, queries.table(spark, str(tmp_path), "labels"), learnable=queries.in_five() != 0)
    weight = dict(zip(model.at.tolist(), model.weight.tolist(), strict=True))
    scores = [1 / (1 + math.exp(-sum(weight.get(int(k), 0.0) for k in f))) for f in toxicity.features(pa.array([t for _, t, _ in rows]), model.bits)]
    clean = [r for r, s in zip(rows, scores, strict=True) if s < 0.5]
    toxic = {i for i, _, t in labels if t}
    assert {i for i, _, _ in rows[:400]} - {i for i, _, _ in clean} == toxic

    sets, group = [plain_set(t) for _, t, _ in clean], list(range(len(clean)))
    for a in range(len(clean)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                group = [group[b] if g == group[a] else g for g in group]
    of = {}
    for (i, text, _), s, g in zip(clean, sets, group, strict=True):
        if s:
            of.setdefault(g, []).append((i is None, i or 0, text))
    unique = Counter((None if unnamed else i, text) for unnamed, i, text in (min(x) for x in of.values()))
    unique += Counter((i, text) for (i, text, _), s in zip(clean, sets, strict=True) if not s)

    left = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, left = left, settle(stage(spark, left, str(tmp_path)), name)
        assert left.columns == docs.columns
        if name == "toxicity":
            assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter((i, t) for i, t, _ in clean)
        if name == "near_duplicates":
            assert Counter((r.doc_id, r.text if plain_words(r.text) else None) for r in left.collect()) == Counter({(i, t if plain_words(t) else None): n for (i, t), n in unique.items()})
    mixed, sizes, source = Counter((r.doc_id, r.text, r.source) for r in left.collect()), Counter(), {}
    for r in before.collect():
        sizes[r.source] += len(plain_words(r.text))
        source[r.doc_id, r.text] = r.source
    assert all((i, t) in unique and s == source[i, t] and n <= 3 for (i, t, s), n in mixed.items())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    share, total, weighs = {}, sum(sizes.values()), {s: k % 3 + 1 for k, s in enumerate(order)}
    open_ = set(order)
    while True:  # the excess of sources at their limit goes to the others by weight
        rest = total - sum(3 * sizes[s] for s in order if s not in open_)
        share = {s: rest * weighs[s] / sum(weighs[o] for o in open_) if s in open_ else 3 * sizes[s] for s in order}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        open_ -= over
    for s in order:
        taken = sum(n * len(plain_words(t)) for (_, t, of_), n in mixed.items() if of_ == s)
        untaken = [len(plain_words(t)) for (i, t), of_ in source.items() if of_ == s and plain_words(t)]
        assert taken <= share[s] + 1e-6 and share[s] - taken < max(untaken)

    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    whole = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    want = Counter()
    for (i, t, _), n in mixed.items():
        want[i, np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes()] += n
    tokens = Counter()
    for (i, ids), n in want.items():
        tokens[i] += n * len(ids) // 4
    assert Counter({i: sum(r.length for r in pieces if r.doc_id == i) for i in {r.doc_id for r in pieces}}) == tokens
    once = {i: ids for (i, ids), n in want.items() if n == 1 and sum(j == i for j, _ in want) == 1}
    for i, ids in once.items():
        assert b"".join(bytes(r.ids) for r in sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)) == ids


def test_the_pipeline_of_no_documents_gives_no_rows(spark, tmp_path):
    planted(spark, tmp_path, [(1, None, None)], [(1, 0, 0)])
    docs = queries.table(spark, str(tmp_path), "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, str(tmp_path)), "empty")
    assert docs.count() == 0


def test_pipeline_hands_texts_to_workers_in_small_batches(spark, monkeypatch):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.range(40, numPartitions=1).select(F.repeat(F.lit("word "), 100_000).alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"bytes": [b.nbytes]}) for b in batches)
    monkeypatch.setattr(corpus_pipeline.neardup, "deduplicated", lambda docs: docs.mapInArrow(sizes, "bytes long"))
    got = [r.bytes for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sum(got) >= 40 * 500_000 and max(got) < 8_000_000
    rows = F.arrow_udf(lambda t: pa.array([t.nbytes] * len(t), pa.int64()), "long")
    assert max(r[0] for r in docs.select(rows("text")).collect()) < 8_000_000
