import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from siltstone.llm import html, queries, warc


def test_query_against_plain_python(spark, sf):
    got = {(r.page_id, r.warc_type): r for r in queries.QUERIES["op7_warc"](spark, sf).collect()}
    pages = queries.read(spark, sf, "pages").collect()
    assert len(got) == 2 * len(pages)
    for p in pages:
        meta, text = got[p.page_id, "metadata"], got[p.page_id, "conversion"]
        payload = "sha256:" + hashlib.sha256(p.html.encode()).hexdigest()
        assert meta.refers_to == text.refers_to and meta.record_id != text.record_id and meta.refers_to.startswith("<urn:uuid:")
        assert {meta.payload_digest, text.payload_digest} == {payload} and meta.target_uri == text.target_uri == p.url
        plain = "\n".join(b.text for b in html.blocks(p.html)).encode()
        assert text.block_digest == "sha256:" + hashlib.sha256(plain).hexdigest() and text.content_length == len(plain)
        own = f"source-record-id: {meta.refers_to}\r\nsource-payload-digest: {payload}\r\nsource-uri: {p.url}\r\n{meta.source_headers}".encode()
        assert meta.block_digest == "sha256:" + hashlib.sha256(own).hexdigest()
        assert f"Content-Length: {len(p.html.encode())}\r\n" in meta.source_headers


def test_round_trip_through_files(spark, sf):
    """Serialised responses, read back from a file's bytes, give the same derivatives."""
    source = warc.responses(queries.read(spark, sf, "pages"), key="page_id")
    parts = [r.x for r in source.select(warc.serialised(source).alias("x")).collect()]
    files = spark.createDataFrame([(bytearray(b"".join(map(bytes, parts[:20]))),), (bytearray(b"".join(map(bytes, parts[20:]))),), (None,), (bytearray(b""),)], "content binary")
    back = warc.read_records(files)
    assert back.count() == len(parts) == len({r.record_id for r in back.select("record_id").collect()})
    both = [warc.derivatives(x, carry=()).select("record_id", "warc_type", "refers_to", "date", F.sha2("block", 256).alias("b"), "block_digest") for x in (source.drop("key"), back)]
    assert sorted(map(tuple, both[0].collect())) == sorted(map(tuple, both[1].collect()))
    made = warc.derivatives(source)
    again = [d for r in made.select(warc.serialised(made).alias("x")).collect() for d in warc.parse(bytes(r.x))]
    assert len(again) == 2 * len(parts) and {d["headers"]["warc-type"] for d in again} == {"metadata", "conversion"}
    assert all(d["headers"]["warc-block-digest"] == "sha256:" + hashlib.sha256(d["block"]).hexdigest() for d in again)


def test_broken_files_are_refused():
    for bad in (b"nonsense\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"):
        try:
            list(warc.parse(bad))
        except ValueError:
            continue
        raise AssertionError(bad)


def test_line_ends_in_targets_make_no_headers(spark):
    """A URL that brings its own line ends stays one header, of the record and in the metadata block."""
    df = spark.createDataFrame([(1, "http://x/\r\nWARC-Type: evil\r\n\r\nx", "<p>a", "2024-01-02T03:04:05Z")], "page_id long, url string, html string, day string")
    source = warc.responses(df, key="page_id", date=F.col("day"))
    made = source.drop("payload").unionByName(warc.derivatives(source))
    for r in made.select("warc_type", warc.serialised(made).alias("x")).collect():
        (found,) = warc.parse(bytes(r.x))
        assert found["headers"]["warc-type"] == r.warc_type and found["headers"]["warc-target-uri"] == "http://x/%0D%0AWARC-Type: evil%0D%0A%0D%0Ax" and found["headers"]["warc-date"] == "2024-01-02T03:04:05Z"
        assert r.warc_type != "metadata" or found["block"].count(b"\r\n") == 6


def test_compressed_files(spark, sf):
    source = warc.responses(queries.read(spark, sf, "pages").limit(9), key="page_id")
    parts = [bytes(r.x) for r in source.select(warc.serialised(source).alias("x")).collect()]
    packed = b"".join(gzip.compress(x) for x in parts)
    assert list(warc.parse(packed)) == list(warc.parse(b"".join(parts))) and len(list(warc.parse(packed))) == 9
    for bad in (packed[:-5], b"".join(parts)[:-3], b"WARC/1.1\r\n\r\n"):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


def test_odd_rows(spark):
    """Nulls, empty pages, copies, clashing columns, other kinds, bytes that are no text, no rows."""
    df = spark.createDataFrame([(1, None, None, "x"), (2, "", "u", "x"), (3, "<p>é &lt;b&gt;", None, "x"), (3, "<p>é &lt;b&gt;", None, "x")], "page_id long, html string, url string, record_id string")
    made = warc.derivatives(warc.responses(df, key="page_id")).collect()
    assert sorted((r.key, r.warc_type, bytes(r.block).decode() if r.warc_type == "conversion" else "") for r in made) == sorted(
        [(k, t, x if t == "conversion" else "") for k, x in ((1, ""), (2, ""), (3, "é <b>"), (3, "é <b>")) for t in ("metadata", "conversion")]
    )
    assert warc.derivatives(warc.responses(df.where("false"), key="page_id")).count() == 0
    rows = [(9, None, "response", None, None, None, None, bytearray(b"\xff<p>x")), (9, "r", "request", "u", "d", "p", "h", bytearray(b"x"))]
    odd = spark.createDataFrame(rows, "key long, record_id string, warc_type string, target_uri string, date string, payload_digest string, source_headers string, payload binary")
    assert [(r.warc_type, r.refers_to) for r in warc.derivatives(odd).collect()] == [("metadata", None), ("conversion", None)]
