"""Streams of objects and of bytes into a repository's tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.durable import exists, written
from siltstone.model import MIN_CHUNK, WINDOW
from siltstone.operators import chunking, store
from siltstone.session import importable


def ingest(stream: DataFrame, key: str, data: str, bits: int, folder: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Chunks whole objects as they come; keeps each new chunk once, forever, and a recipe for every object.

    The set of known hashes is the chunk table itself, so that nothing is forgotten with time.  A batch that is run
    again after a failure writes over its own folder, and its chunks are compared with those of other batches only.
    """
    spark = importable(stream.sparkSession)

    def land(batch: DataFrame, number: int) -> None:
        cut = written(chunking.hashed(chunking.chunk(batch, key, data, bits)), "batch")
        known = read(spark, folder, "chunks").where(F.col("batch") != number)
        new = store.new_chunks(cut.select("hash", "length", "data"), known)
        new.write.mode("overwrite").parquet(f"{folder}/chunks/batch={number}")
        cut.select(F.col(key).cast("string").alias("object_id"), "seq", "hash", "offset", "length").write.mode("overwrite").parquet(f"{folder}/recipes/batch={number}")

    writer = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


SCHEMAS = {"chunks": "hash binary, length long, data binary, batch long", "recipes": "object_id string, seq long, hash binary, offset long, length long, batch long"}


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """What has landed so far; an empty table before the first batch."""
    if not exists(spark, f"{folder}/{table}"):
        return spark.createDataFrame([], SCHEMAS[table])
    return spark.read.schema(SCHEMAS[table]).parquet(f"{folder}/{table}")


STATE = "number long, start long, base long, high int, left int, tail binary"


def chunk_streams(stream: DataFrame, bits: int, stream_id: str = "stream_id", seq: str = "seq", data: str = "data") -> DataFrame:
    """(stream_id, seq, start, offset, data, closes): the chunks of endless byte streams that come in pieces, as parts.

    A part is what one batch has of a chunk (number `seq`, which begins at `start`); `closes` says that it is the chunk's
    last; `parts_of` puts chunks together.  A row with null data ends its stream, and with it the open chunk.  What is
    kept between batches is the last 63 bytes and a few numbers, and every byte is looked at once: a stream without any
    cut costs no more than others.
    """
    importable(stream.sparkSession)
    chunking.check_bits(bits)
    kind = stream.schema[stream_id].dataType.simpleString()

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        number, start, base, high, left, tail = state.get if state.exists else (0, 0, 0, 0, 0, b"")
        pieces = pd.concat(list(frames)).sort_values(seq)[data].tolist()
        ended, new, tail = any(x is None for x in pieces), b"".join(bytes(x or b"") for x in pieces), bytes(tail)
        whole = np.frombuffer(tail + new, np.uint8)
        # places are counted from where the tail begins
        origin = base - len(tail)
        before = high - int((whole[: len(tail)] >= 225).sum())
        found = chunking.candidates(whole, bits, before)
        upto = np.concatenate([[0], np.cumsum(whole >= 225)]) + before
        out, at, end = [], base, base + len(new)
        while True:
            places = found[left if bits > 14 else 0]
            k = int(np.searchsorted(places, max(start + MIN_CHUNK, base + 1) - origin))
            if k == len(places):
                break
            to = int(places[k]) + origin
            out.append((key[0], number, start, at, new[at - base : to - base], True))
            number, start, at, left = number + 1, to, to, int(upto[to - origin]) % 4
        if at < end or (ended and start < end):
            out.append((key[0], number, start, at, new[at - base :], ended))
        if ended:
            state.remove()
        else:
            state.update((number, start, end, int(upto[-1]) % 4, left, (tail + new)[-(WINDOW - 1) :]))
        yield pd.DataFrame(out, columns=[stream_id, "seq", "start", "offset", "data", "closes"])

    out = f"{stream_id} {kind}, seq long, start long, offset long, data binary, closes boolean"
    return stream.select(stream_id, seq, data).groupBy(stream_id).applyInPandasWithState(step, out, STATE, "append", GroupStateTimeout.NoTimeout)


def parts_of(parts: DataFrame, stream_id: str = "stream_id") -> DataFrame:
    """(stream_id, seq, offset, length, data) of the chunks that are closed, from what `chunk_streams` gave so far."""
    held = parts.groupBy(stream_id, "seq", "start").agg(F.sort_array(F.collect_list(F.struct("offset", F.col("data").alias("piece")))).alias("parts"), F.bool_or("closes").alias("closed"))
    whole = held.where("closed").select(stream_id, "seq", F.col("start").alias("offset"), store.join_pieces("parts").alias("data"))
    return whole.select(stream_id, "seq", "offset", F.octet_length("data").cast("long").alias("length"), "data")


def progress(query: StreamingQuery) -> dict[str, float]:
    """Rows so far and rows a second, from the query's own progress reports."""
    reports = query.recentProgress
    return {"rows": float(sum(p["numInputRows"] for p in reports)), "rows_per_second": float(reports[-1].get("processedRowsPerSecond") or 0) if reports else 0.0}


def limited(reader, files: int):  # noqa: ANN001, ANN201
    """At most so many files a batch: what Spark has for a bandwidth limit."""
    return reader.option("maxFilesPerTrigger", files)
