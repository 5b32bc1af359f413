"""WARC derivatives: a metadata and a plain-text conversion record for every response record.

Both name the response in WARC-Refers-To, keep its target, date and payload digest, and carry their own block
digests; the metadata block keeps the response's HTTP headers.  Record ids are UUIDs made from the response's id
and the kind, so that a run that is repeated gives the same records.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.bpe import slices
from siltstone.llm.html import blocks

VERSION = "WARC/1.1"
FIELDS = "record_id string, warc_type string, refers_to string, target_uri string, date string, content_type string, payload_digest string, block_digest string, source_headers string, block binary"


def urn(*parts: Column | str) -> Column:
    """A UUID URN from the SHA-256 of the parts (version 8: own layout)."""
    h = F.sha2(F.concat_ws("\n", *parts), 256)
    return F.concat(F.lit("<urn:uuid:"), h.substr(1, 8), F.lit("-"), h.substr(9, 4), F.lit("-8"), h.substr(14, 3), F.lit("-a"), h.substr(18, 3), F.lit("-"), h.substr(21, 12), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def one_line(value: Column) -> Column:
    """A header's value: line ends in it are written as in URIs, so that it stays one header."""
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def responses(pages: DataFrame, url: str = "url", html: str = "html", date: str | Column = "1970-01-01T00:00:00Z", key: str | None = None) -> DataFrame:
    """Response records of pages: all columns of FIELDS, plus `payload` and the key column if one is named.

    date: one for all (the test pages have none), or a column of texts.  Null html is an empty payload and a null url an
    empty target; pages that agree in key, url and html get one id; other columns are dropped; no pages give no records.
    """
    target, body = F.coalesce(F.col(url), F.lit("")), F.coalesce(F.col(html), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n"))
    own = [F.col(key).alias("key")] if key else [F.lit(None).cast("long").alias("key")]
    when = F.lit(date) if isinstance(date, str) else date.cast("string")
    made = pages.select(*own, target.alias("target_uri"), when.alias("date"), body.alias("payload"), head.alias("source_headers")).withColumn("payload_digest", digest(F.col("payload")))
    return made.select(
        "key", urn(F.lit("response"), F.coalesce(F.col("key").cast("string"), F.lit("")), "target_uri", "payload_digest").alias("record_id"),
        F.lit("response").alias("warc_type"), F.lit(None).cast("string").alias("refers_to"), "target_uri", "date",
        F.lit("application/http; msgtype=response").alias("content_type"), "payload_digest",
        digest(F.concat(F.col("source_headers").cast("binary"), F.lit("\r\n").cast("binary"), F.col("payload"))).alias("block_digest"),
        "source_headers", F.concat(F.col("source_headers").cast("binary"), F.lit("\r\n").cast("binary"), F.col("payload")).alias("block"), "payload",
    )


def plain_text(html: str | None) -> str:
    """All visible text of a page, a line for each block."""
    return "\n".join(b.text for b in blocks(html)) if html else ""


def _with_text(records: DataFrame) -> DataFrame:
    """Takes the payload's text; bytes that are no UTF-8 become replacement characters."""
    kept = [f for f in records.schema.fields if f.name not in ("payload", "block")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "payload"):
            texts = [plain_text(p.decode("utf-8", "replace")) if p else "" for p in b.column("payload").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string())], [*names, "plain"])

    return records.select(*names, "payload").mapInArrow(run, T.StructType([*kept, T.StructField("plain", T.StringType(), False)]))


def derivatives(records: DataFrame, carry: tuple[str, ...] = ("key",)) -> DataFrame:
    """The metadata and conversion records of all response records, with the columns of FIELDS and the carried ones.

    Records of other kinds give none.  Rows that repeat a response repeat its derivatives.  A null payload converts
    to an empty block, and null headers, targets or digests are left out of the metadata block.
    """
    wanted = ["record_id", "target_uri", "date", "payload_digest", "source_headers"]
    source = _with_text(records.where("warc_type = 'response'").select(*carry, *wanted, "payload"))
    fact = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), one_line(F.col(c)), F.lit("\r\n"))).otherwise("")
    meta = F.concat(fact("source-record-id", "record_id"), fact("source-payload-digest", "payload_digest"), fact("source-uri", "target_uri"), F.coalesce("source_headers", F.lit("")))
    both = source.withColumn("made", F.explode(F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("type"), meta.cast("binary").alias("block")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("type"), F.col("plain").cast("binary").alias("block")),
    )))
    return both.select(
        *carry, urn("made.kind", F.coalesce("record_id", F.lit(""))).alias("record_id"), F.col("made.kind").alias("warc_type"), F.col("record_id").alias("refers_to"), "target_uri", "date",
        F.col("made.type").alias("content_type"), "payload_digest", digest(F.col("made.block")).alias("block_digest"), "source_headers", F.col("made.block").alias("block"),
    )


def serialised(records: DataFrame) -> Column:
    """The bytes of a record as they stand in a WARC file."""
    line = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), one_line(F.col(c).cast("string")), F.lit("\r\n"))).otherwise("")
    head = F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"), line("WARC-Refers-To", "refers_to"), line("WARC-Target-URI", "target_uri"),
        line("WARC-Date", "date"), line("WARC-Payload-Digest", "payload_digest"), line("WARC-Block-Digest", "block_digest"), line("Content-Type", "content_type"),
        F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), F.col("block"), F.lit("\r\n\r\n").cast("binary"))


def inflated(content: bytes) -> bytes:
    """The bytes of a file, members of which may be compressed by gzip one by one; raises where one is cut off."""
    out = []
    while content[:2] == b"\x1f\x8b":
        coder = zlib.decompressobj(31)
        out.append(coder.decompress(content))
        if not coder.eof:
            raise ValueError("a compressed record is cut off")
        content = coder.unused_data
    return b"".join([*out, content])


def parse(content: bytes) -> Iterator[dict]:
    """The records of one WARC file's bytes, compressed or not: headers (lower-case names) and block; raises on a broken record."""
    content, at = inflated(content), 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError(f"the record at byte {at} is cut off")
        first, *rest = content[at:end].decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
        size = int(headers.get("content-length", "-1"))
        block = content[end + 4 : end + 4 + size]
        if size < 0 or len(block) != size or content[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut off")
        yield {"headers": headers, "block": block}
        at = end + 8 + size


def read_records(files: DataFrame, content: str = "content") -> DataFrame:
    """Records of WARC files held in a binary column (such as Spark's binaryFile source gives), with the payload of responses.

    Files may be compressed record by record.  Null and empty files have no records, a broken one is an error; other
    columns are dropped; a file has to fit a cell.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        for b in batches:
            for one in b.column(content):
                rows: list[dict] = []
                for r in parse(one.as_py() or b""):
                    h, block = r["headers"], r["block"]
                    head, found, payload = block.partition(b"\r\n\r\n") if h.get("warc-type") == "response" else (b"", b"", None)
                    rows.append({
                        "record_id": h.get("warc-record-id"), "warc_type": h.get("warc-type"), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri"),
                        "date": h.get("warc-date"), "content_type": h.get("content-type"), "payload_digest": h.get("warc-payload-digest"), "block_digest": h.get("warc-block-digest"),
                        "source_headers": head.decode("utf-8", "replace") + "\r\n" if found else None, "block": block, "payload": payload,
                    })
                types = [pa.binary() if n in ("block", "payload") else pa.string() for n in [*names, "payload"]]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip([*names, "payload"], types, strict=True))))

    return files.select(content).mapInArrow(run, f"{FIELDS}, payload binary")
