"""The contract query of each operator over the benchmark tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm import bitplanes, editprints, hilbert, matching, merkle, mixing, neardup, packing, phrases, rollup, topk, toxicity, warc
from tallyflow.session import scratch_path, settle, small_batches

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTERED[fn.__name__] = fn
    return fn


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary; the folder is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def in_five():
    """crc32 of the id as text, modulo 5; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(5))


@query
def op1_exact_topk(spark, folder):
    return topk.search(table(spark, folder, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


@query
def op2_toxicity(spark, folder):
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"), learnable=in_five() != 0)
    scored = docs.select("doc_id", (in_five() == 0).alias("held_out"), toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


@query
def op3_curriculum_mix(spark, folder):
    rows, _ = mixing.plan(table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "times")


@query
def op4_bitplane_tokens(spark, folder):
    files = bitplanes.write(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))
    return bitplanes.read(files, with_ids=False)


@query
def op5_edit_fingerprints(spark, folder):
    return editprints.with_near(editprints.fingerprinted(table(spark, folder, "documents")))


@query
def op6_tiered_packing(spark, folder):
    return packing.pack(table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


@query
def op7_minhash_neardup(spark, folder):
    small_batches(spark)
    return neardup.near_duplicates(table(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op8_warc_revisit(spark, folder):
    found = warc.resolved(warc.deduplicated(table(spark, folder, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_hilbert_shards(spark, folder):
    rows = hilbert.shards(table(spark, folder, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_token_rollup(spark, folder):
    """All documents are loaded with word counts, moved to token counts, rid of repeated texts, and recounted with an end token."""
    docs = table(spark, folder, "documents")
    tokens = rollup.token_count(vocabulary("byte_bpe_50k.json"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "source", "lang", F.xxhash64(text).alias("th"), mixing.words(F.col("text")).alias("words"), tokens(F.col("text")).alias("ids"))
    rows = rows.groupBy("source", "lang", "th", "words", "ids").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first"))
    rows = settle(rows, "counts")
    where = F.struct(F.col("first").isNull().alias("unnamed"), "first", F.col("source").isNull().alias("no_source"), "source", F.col("lang").isNull().alias("no_lang"), "lang")
    stays = rows.withColumn("place", where).groupBy("th").agg(F.min("place").alias("kept"))
    kept = rows.join(settle(stays, "kept"), "th").withColumn("stays", F.when(where.eqNullSafe(F.col("kept")), 1).otherwise(0))

    def changes(op, version, tokens, source=rows, **more):
        return source.select(F.lit(op).alias("op"), "source", "lang", F.lit(version).alias("tokenizer"), F.col(tokens).alias("tokens"), *(v.alias(k) for k, v in more.items()))

    docs_ = {"docs": F.col("docs")}
    totals = rollup.TokenRollup(spark, scratch_path(spark, "rollup"))
    load = changes("insert", "words", "words", **docs_)
    totals.commit("load", load)
    totals.commit("retokenise", changes("delete", "words", "words", **docs_).unionAll(changes("insert", "byte_bpe_50k", "ids", **docs_)))
    totals.commit("copies", changes("delete", "byte_bpe_50k", "ids", kept.filter("docs > stays"), docs=F.col("docs") - F.col("stays")))
    totals.commit("load", load)  # a retry of a committed batch adds nothing
    totals.compact()
    recount = kept.filter("stays = 1").withColumn("with_end", F.col("ids") + 1)
    totals.commit("end-token", changes("revise", "byte_bpe_50k", "with_end", recount, old_tokens=F.col("ids")))
    return totals.totals()


@query
def op11_matched_packing(spark, folder):
    return matching.pack(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


@query
def op12_phrase_collocations(spark, folder):
    return phrases.collocations(table(spark, folder, "documents"))


def lower_ascii(text):
    """A-Z as a-z, other letters as they are."""
    upper = "".join(map(chr, range(65, 91)))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


@query
def op13_merkle_manifest(spark, folder):
    """Documents against their manifest, where texts of one in five may have been tampered with."""
    docs = table(spark, folder, "documents")
    row = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    found = F.when(tampered, merkle.leaf(*row, lower_ascii(F.col("text"))))
    return merkle.manifest(docs.select("doc_id", "source", merkle.leaf(*row, F.col("text")).alias("leaf"), found.alias("found")))


ORACLES: dict[str, str] = {
    "op1_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM pairs
        )
        SELECT * FROM ranked WHERE rank <= 10""",
    "op7_minhash_neardup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
            FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_transform(range(1, CAST(len(ws) - 3 AS BIGINT)), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh
            FROM w
        ), e AS (SELECT doc_id, unnest(sh) AS x FROM s),
        shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
            FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), links AS (
            SELECT a, b FROM shared JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
            WHERE 100 * n >= 75 * (len(x.sh) + len(y.sh) - n)
        ), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM s
            UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
        ), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
        SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)""",
    "op8_warc_revisit": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, url FROM pages),
        d AS (
            SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS hex,
                row_number() OVER w AS nth, first_value(page_id) OVER w AS first_id
            FROM p WINDOW w AS (PARTITION BY sha1(html) ORDER BY page_id NULLS LAST, url NULLS LAST)
        )
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                1 + CAST((CAST('0x' || substr(hex, CAST(1 + 5 * (k // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '') AS payload_digest,
            CASE WHEN nth = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN nth > 1 THEN first_id END AS refers_to
        FROM d""",
    "op12_phrase_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
        grams AS (
            SELECT lang, k, unnest(list_transform(range(1, CAST(len(ws) - k + 2 AS BIGINT)), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
            FROM w CROSS JOIN (SELECT unnest(range(1, 6)) AS k) WHERE len(ws) >= k
        ), f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
        inner_phrases AS (
            SELECT lang, f, array_to_string(ws[pos:pos + size - 1], ' ') AS phrase
            FROM f, (SELECT unnest(range(2, 5)) AS size) s, (SELECT unnest(range(1, 5)) AS pos) t
            WHERE size < k AND pos + size - 1 <= k
        ), longer AS (SELECT lang, phrase, max(f) AS longest FROM inner_phrases GROUP BY lang, phrase),
        kept AS (SELECT f.* FROM f LEFT JOIN longer USING (lang, phrase) WHERE k > 1 AND (longest IS NULL OR longest < f)),
        cuts AS (
            SELECT lang, phrase, kept.f AS a, cut, array_to_string(ws[1:cut], ' ') AS lp, array_to_string(ws[cut + 1:], ' ') AS rp
            FROM kept CROSS JOIN (SELECT unnest(range(1, 5)) AS cut) WHERE cut < k
        ), scored AS (
            SELECT c.lang, c.phrase, a, cut, x.f AS l, y.f AS r, n, CAST((1000 * a::HUGEINT * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
            FROM cuts c JOIN totals USING (lang) JOIN f x ON x.lang = c.lang AND x.phrase = lp JOIN f y ON y.lang = c.lang AND y.phrase = rp
        ), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank FROM best)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
    "op13_merkle_manifest": """
        WITH RECURSIVE polynomial AS (
            SELECT list(list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS crc FROM range(256) t(i)
        ), texts AS (
            SELECT doc_id, source, lang, n_chars, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small,
                xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
                    lambda a, c: xor(a >> 8, crc[1 + xor(a & 255, c)]), 4294967295), 4294967295) % 5 = 0 AS tampered
            FROM documents, polynomial
        ), fields AS (
            SELECT doc_id, source, tampered, list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text], lambda v: CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END) AS here,
                CASE WHEN small IS NULL THEN '-' ELSE strlen(small) || ':' || small END AS small
            FROM texts
        ), leaves AS (
            SELECT doc_id, source, sha256(array_to_string(here, '')) AS leaf,
                CASE WHEN tampered THEN sha256(array_to_string(here[1:4], '') || small) ELSE sha256(array_to_string(here, '')) END AS found
            FROM fields
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS total FROM leaves
        ), trees AS (
            SELECT source, 0 AS level, idx, total, leaf AS h FROM numbered
            UNION ALL
            SELECT source, level + 1, idx // 16, (total + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM trees WHERE total > 1 GROUP BY source, level, idx // 16, total
        ), subroots AS (
            SELECT source, level, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS idx, count(*) OVER () AS total FROM trees WHERE total = 1
        ), top AS (
            SELECT 0 AS level, idx, total, h FROM subroots
            UNION ALL
            SELECT level + 1, idx // 16, (total + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE total > 1 GROUP BY level, idx // 16, total
        ), runs AS (SELECT source, level, idx // 16 AS run, list(h ORDER BY idx) AS hs FROM trees WHERE total > 1 GROUP BY ALL),
        top_runs AS (SELECT level, idx // 16 AS run, list(h ORDER BY idx) AS hs FROM top WHERE total > 1 GROUP BY ALL),
        steps AS (
            SELECT n.source, n.idx, r.level, r.hs[1:(n.idx // (16 ** r.level)::BIGINT) % 16] AS before, r.hs[(n.idx // (16 ** r.level)::BIGINT) % 16 + 2:] AS after
            FROM numbered n JOIN runs r ON r.source IS NOT DISTINCT FROM n.source AND r.run = n.idx // (16 ** (r.level + 1))::BIGINT
            UNION ALL
            SELECT n.source, n.idx, s.level + r.level, r.hs[1:(s.idx // (16 ** r.level)::BIGINT) % 16], r.hs[(s.idx // (16 ** r.level)::BIGINT) % 16 + 2:]
            FROM numbered n JOIN subroots s ON s.source IS NOT DISTINCT FROM n.source JOIN top_runs r ON r.run = s.idx // (16 ** (r.level + 1))::BIGINT
        ), paths AS (
            SELECT source, idx, list(array_to_string(before, '') ORDER BY level) AS b, list(array_to_string(after, '') ORDER BY level) AS a FROM steps GROUP BY ALL
        ), folds AS (
            SELECT n.source, n.idx, found AS h, coalesce(b, []) AS b, coalesce(a, []) AS a, 1 AS step
            FROM numbered n LEFT JOIN paths p ON p.source IS NOT DISTINCT FROM n.source AND p.idx = n.idx
            UNION ALL
            SELECT source, idx, sha256(b[step] || h || a[step]), b, a, step + 1 FROM folds WHERE step <= len(b)
        ), folded AS (SELECT * FROM folds WHERE step = len(b) + 1)
        SELECT n.doc_id, n.leaf, s.h AS subroot, t.h AS root,
            sha256(array_to_string(list_transform(list_zip(f.b, f.a), lambda x: x[1] || x[2]), '')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
        FROM numbered n JOIN subroots s ON s.source IS NOT DISTINCT FROM n.source JOIN top t ON t.total = 1
        JOIN folded f ON f.source IS NOT DISTINCT FROM n.source AND f.idx = n.idx""",
}
