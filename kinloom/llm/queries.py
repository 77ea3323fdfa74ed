"""The queries of the corpus operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm import decontamination, fingerprints, html_text, ngram_join, ngram_lm, packing, quality, toxicity, url_filters, warc
from kinloom.llm.common import fresh_path, held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


@query("""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
    d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
    f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM d)
    SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
      CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN first_id <> page_id THEN first_id END AS refers_to
    FROM f""")
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.record_digests(warc.read_warc(spark, path, payloads=False))


#: The rules of the contract: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query("""
    WITH r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    s AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s)
    SELECT page_id, host, path, b.rule AS rule, coalesce(b.rv, 'allow') AS verdict
    FROM p LEFT JOIN LATERAL (
      SELECT rh || rp AS rule, rv FROM r WHERE (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)
      ORDER BY length(rh) + length(rp) DESC, length(rh) DESC, rv DESC LIMIT 1) b ON true""")
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_verdicts(table(spark, sf_dir, "pages"), url_filters.rule_table(spark, URL_RULES))


@query()
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"), 10, 0)
    return ngram_lm.score(docs, ngram_lm.train(docs.where(~fold)), ["doc_id"]).withColumn("held_out", fold)


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *vocabulary())


def vocabulary() -> tuple[str, str, str]:
    """The byte-level BPE of the contract for tokenizers, the same as ranks for tiktoken, and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = held_out(F.col("doc_id"), 3, 1)
    labels = table(spark, sf_dir, "labels").where(~fold)
    return toxicity.scores(table(spark, sf_dir, "documents"), labels, ["doc_id"]).withColumn("held_out", fold)


@query()
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_pairs(table(spark, sf_dir, "documents"))


@query()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = held_out(F.col("doc_id"), 5, 0)
    labels = table(spark, sf_dir, "labels").where(~fold)
    return quality.scores(table(spark, sf_dir, "documents"), labels, ["doc_id"]).withColumn("held_out", fold)


@query()
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


@query()
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_components(table(spark, sf_dir, "documents"), ngram_join.Likeness(width=3, num=90, den=100))


@query()
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlaps of documents with benchmark items; a document without any is clean and has no row."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")
