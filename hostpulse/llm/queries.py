"""Registered queries over the corpus operators, with their checking SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostpulse.llm import bpe, dartminhash, decontaminate, filter_audit, langid, lexical, postings, quality, secrets, sharding, simple8b, substrings, warc
from hostpulse.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}

#: Where the public tokenizer's file is.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SHARDS = 16


def _register(run):
    QUERIES[run.__name__] = run
    return run


@_register
def op2_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 16 shards of near-equal bytes; equal texts stay together."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int"),
        F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"),
    )


@_register
def op3_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    read = simple8b.token_files(spark, table(spark, sf_dir, "documents"), TOKENIZER, end_id=2)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@_register
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode_bpe(bpe.encode_bpe(docs, TOKENIZER).drop("text"), TOKENIZER)
    return coded.select(
        "doc_id",
        F.expr("CAST(length(ids) DIV 4 AS BIGINT)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@_register
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC archives, read back."""
    read = warc.archive_pages(spark, table(spark, sf_dir, "pages"))
    full = F.col("payload").isNotNull()
    return read.select(
        "page_id",
        F.when(full, F.length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        "refers_to",
    )


CHECKS["op6_warc"] = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest FROM pages
), o AS (
    SELECT digest, min(page_id) AS owner FROM p WHERE strlen(html) >= 100 GROUP BY digest
)
SELECT p.page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN o.owner IS NULL OR o.owner = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN o.owner <> p.page_id THEN o.owner END AS refers_to
FROM p LEFT JOIN o ON p.digest = o.digest AND strlen(p.html) >= 100
"""


@_register
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that overlap benchmark items, one row per document and item."""
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched", "at")


@_register
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, base spans and owner-specific additions."""
    scanned = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", of("assign"), of("access"), of("hex"),
        F.sha2(secrets.spelled(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        secrets.spelled(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("live").alias("n_live"),
    )


@_register
def op9_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return dartminhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def training_row() -> Column:
    """Rows whose labels may be learned: the checksum of the id is not 2 modulo 4.  A null id has none, and isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) != 2, F.lit(True))


@_register
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the classifier fitted on the training rows."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"), usable=training_row())
    scored = quality.score_quality(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (~training_row()).alias("held_out"), "score",
        F.when(F.col("score") >= quality.THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


@_register
def op8_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return postings.nearest_vectors(table(spark, sf_dir, "embeddings"), k=20, is_query=F.col("vec_id") % 20 == 0)


@_register
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their 50-byte strings that also start in an earlier document."""
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.expr("CAST(size(spans) DIV 2 AS BIGINT)").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@_register
def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents, in all 120 orders, per source."""
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


CHECKS["op13_filter_audit"] = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws
    FROM documents
), l AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), f AS (
    SELECT d.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
           concat(CASE WHEN len(ws) < 50 THEN 'A' ELSE '' END,
                  CASE WHEN 100 * len(list_distinct(ws)) < 65 * len(ws) THEN 'B' ELSE '' END,
                  CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) THEN 'C' ELSE '' END,
                  CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
                  CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails
    FROM d LEFT JOIN l ON d.doc_id = l.doc_id
), m AS (
    SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails
), x(c) AS (
    VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), o AS (
    SELECT concat(a.c, b.c, e.c, g.c, h.c) AS filter_order
    FROM x a, x b, x e, x g, x h
    WHERE a.c <> b.c AND a.c <> e.c AND a.c <> g.c AND a.c <> h.c AND b.c <> e.c AND b.c <> g.c AND b.c <> h.c
      AND e.c <> g.c AND e.c <> h.c AND g.c <> h.c
), w AS (
    SELECT m.*, filter_order, coalesce(list_min(list_transform(string_split(fails, ''), lambda c: CASE WHEN c = '' THEN 9 ELSE strpos(filter_order, c) END)), 9) AS goes
    FROM m, o
), s AS (
    SELECT part, filter_order, CAST(step AS INT) AS step, substr(filter_order, CAST(step AS INT), 1) AS c,
           sum(CASE WHEN goes > step THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN goes = step THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN goes < step AND contains(fails, substr(filter_order, CAST(step AS INT), 1)) THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN fails = substr(filter_order, CAST(step AS INT), 1) THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN goes = step THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN goes = step THEN toxic ELSE 0 END) AS toxic_lost
    FROM w, range(1, 6) r(step) GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley
FROM s
"""


@_register
def op11_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by the spans that its words are labelled with."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_languages(docs, usable=training_row())
    labelled = langid.label_languages(docs.select("doc_id", "text"), model)
    return labelled.select(
        "doc_id", (~training_row()).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("n_spans")
    )


@_register
def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


CHECKS["op12_lexical"] = r"""
WITH t AS (
    SELECT doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents WHERE text IS NOT NULL
), q AS (
    SELECT DISTINCT item_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL
), f AS (
    SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term
), d AS (
    SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id
), c AS (
    SELECT count(*)::BIGINT AS N, sum(n)::BIGINT AS L FROM d
), w AS (
    SELECT term, CAST(floor(1000 * ln((2 * c.N + 2)::DOUBLE / (2 * x.df + 1)::DOUBLE)) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM f GROUP BY term) x, c
), m AS (
    SELECT doc_id, 100 - 90 + ((90 * d.n * c.N) // c.L) AS m FROM d, c
), s AS (
    SELECT item_id, f.doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * m.m)))::BIGINT AS score
    FROM q JOIN f USING (term) JOIN w USING (term) JOIN m ON f.doc_id = m.doc_id GROUP BY item_id, f.doc_id
), r AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
    FROM s WHERE score > 0
)
SELECT * FROM r WHERE rank <= 10
"""
