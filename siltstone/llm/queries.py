"""One query for each operator, over its whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import bpe, durable, html, packing, pii, quality, rollup, rules, simhash, vectors, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return durable.bounded(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every document, and back."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, path, decoded="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


@query
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents by 64-bit SimHash within 4 bits."""
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html.extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata and conversion records of the responses that the pages were."""
    made = warc.derivatives(warc.responses(read(spark, sf_dir, "pages"), key="page_id"))
    return made.select(
        F.col("key").alias("page_id"), "warc_type", "record_id", "refers_to", "target_uri", "payload_digest", "block_digest", "source_headers",
        F.octet_length("block").cast("long").alias("content_length"), F.sha2(warc.serialised(made), 256).alias("record_sha256"),
    )


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and limits, and robust outliers, of every document."""
    stats = rules.statistics(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).drop("text")
    judged = rules.judge(durable.written(stats, "counts"))
    return judged.select("doc_id", *rules.COUNTS, "base_failed", "kept", "distance")


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by the votes of its labelled neighbours."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.scores(docs, quality.fit(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces in as few sequences of 4096 tokens as best fit finds, with as few documents in each as that allows."""
    cut = packing.pieces(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), tighten=True)


@query
def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate embeddings of one label by cosine 0.93."""
    return vectors.near_duplicates(read(spark, sf_dir, "embeddings"))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = pii.find(read(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.written_form("base"), 256).alias("base_sha256"), pii.written_form("spans").alias("spans"))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals by source, language and tokenizer version, after a load, the copies' deletion and a revision."""
    versions = {"word_bpe_49k": (bpe.WordLevel, public_tokenizers.path("word_bpe_49k.json")), "words": None}
    return rollup.maintained(read(spark, sf_dir, "documents"), durable.scratch(spark, "token-ledger"), versions).totals()


ORACLES["op9_vectors"] = """WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_sum(list_transform(embedding, lambda x: x * x)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.a),
m AS (SELECT a AS vec_id, min(c) AS component_id FROM r GROUP BY a), n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT m.vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n ON n.a = m.vec_id"""

#: The test pages have one article element and few kinds of references.
ORACLES["op3_html"] = r"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') AS t FROM a),
c AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c"""

#: Digests and lengths of the same records; the test pages have few kinds of references and of inline elements.
ORACLES["op7_warc"] = r"""WITH a AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html,
  regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<!--.*?-->', '', 'g'), '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g') AS t FROM pages),
b AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(t, '<![^>]*>', '', 'g'), '</?[ab](\s[^>]*)?>', '', 'g'), '<[^>]*>', chr(1), 'g') AS t FROM a),
c AS (SELECT page_id, url, html, replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '&copy;', '©'), '&middot;', '·') AS t FROM b),
d AS (SELECT page_id, url, html, coalesce(array_to_string(list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)), '') AS plain FROM c),
e AS (SELECT *, 'sha256:' || sha256(html) AS payload_digest, 'HTTP/1.1 200 OK' || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) AS source_headers FROM d),
f AS (SELECT *, sha256(concat_ws(chr(10), 'response', CAST(page_id AS VARCHAR), url, payload_digest)) AS h FROM e),
g AS (SELECT *, '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) || '>' AS refers_to FROM f),
m AS (SELECT page_id, url, payload_digest, source_headers, refers_to, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
    'source-record-id: ' || refers_to || chr(13) || chr(10) || 'source-payload-digest: ' || payload_digest || chr(13) || chr(10) || 'source-uri: ' || url || chr(13) || chr(10) || source_headers AS block FROM g
  UNION ALL SELECT page_id, url, payload_digest, source_headers, refers_to, 'conversion', 'text/plain; charset=utf-8', plain FROM g),
n AS (SELECT *, sha256(warc_type || chr(10) || refers_to) AS h, 'sha256:' || sha256(block) AS block_digest FROM m),
o AS (SELECT *, '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-8' || substr(h, 14, 3) || '-a' || substr(h, 18, 3) || '-' || substr(h, 21, 12) || '>' AS record_id FROM n)
SELECT page_id, warc_type, record_id, refers_to, url AS target_uri, payload_digest, block_digest, source_headers, CAST(strlen(block) AS BIGINT) AS content_length,
  sha256(concat('WARC/1.1', x, 'WARC-Type: ', warc_type, x, 'WARC-Record-ID: ', record_id, x, 'WARC-Refers-To: ', refers_to, x, 'WARC-Target-URI: ', url, x, 'WARC-Date: 1970-01-01T00:00:00Z', x, 'WARC-Payload-Digest: ', payload_digest, x,
    'WARC-Block-Digest: ', block_digest, x, 'Content-Type: ', content_type, x, 'Content-Length: ', strlen(block), x, x, block, x, x)) AS record_sha256
FROM o, (SELECT chr(13) || chr(10) AS x)"""
