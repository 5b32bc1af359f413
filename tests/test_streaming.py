import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import chunking, store
from siltstone.streaming import ingest


def test_objects_land_once(spark, tmp_path):
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 256, 20_000, np.uint8).tobytes()
    for k in range(3):
        rows = [(k * 10 + j, bytearray(shared if j == 0 else rng.integers(0, 256, 5000, np.uint8).tobytes())) for j in range(4)]
        spark.createDataFrame(rows, "id long, data binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    whole = spark.read.parquet(str(tmp_path / "in"))
    stream = ingest.limited(spark.readStream.schema("id long, data binary"), 1).parquet(str(tmp_path / "in"))
    query = ingest.ingest(stream, "id", "data", 10, str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination()
    assert len(query.recentProgress) >= 3 and ingest.progress(query)["rows"] == 12
    chunks, recipes = (ingest.read(spark, str(tmp_path / "out"), t) for t in ("chunks", "recipes"))
    batch = chunking.hashed(chunking.chunk(whole, "id", "data", 10))
    assert chunks.count() == chunks.select("hash").distinct().count() == batch.select("hash").distinct().count()
    assert recipes.count() == batch.count()
    back = store.reassemble(recipes, chunks)
    assert back.join(whole, F.col("object_id") == F.col("id").cast("string")).where(back["data"] == whole["data"]).count() == 12
    # nothing new: nothing is read or written again
    ingest.ingest(stream, "id", "data", 10, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert ingest.read(spark, str(tmp_path / "out"), "recipes").count() == recipes.count()


def test_a_byte_stream_in_pieces(spark, tmp_path):
    """Pieces over several batches give the chunks of the whole; only a stream that has ended gives its last one."""
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 60_000, np.uint8).tobytes()
    for k in range(4):
        rows = [("s", k * 100 + j, bytearray(data[(k * 5 + j) * 3000 : (k * 5 + j + 1) * 3000])) for j in range(5)]
        rows += [("s", 999, None)] * (k == 3) + [("open", k, bytearray(data[k * 4000 : (k + 1) * 4000]))]
        spark.createDataFrame(rows, "stream_id string, seq long, data binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = ingest.limited(spark.readStream.schema("stream_id string, seq long, data binary"), 1).parquet(str(tmp_path / "in"))
    query = ingest.chunk_streams(stream, 10).writeStream.format("memory").queryName("pieces").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    chunks = ingest.parts_of(spark.table("pieces"))
    got = sorted((r.seq, r.offset, r.length, bytes(r.data)) for r in chunks.where("stream_id = 's'").collect())
    ends = chunking.cuts(data, 10).tolist()
    assert [g[1] + g[2] for g in got] == ends and b"".join(g[3] for g in got) == data
    left = sorted((r.offset + r.length) for r in chunks.where("stream_id = 'open'").collect())
    assert left == chunking.cuts(data[:16_000], 10).tolist()[:-1]


class State:
    """What Spark keeps of a group, for steps outside of a query."""

    def __init__(self):
        self.value = None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None


def stepped(spark, monkeypatch, bits, batches):
    """Runs the step of `chunk_streams` over batches of pieces; the parts, and the largest state."""
    import pandas as pd
    from pyspark.sql import DataFrame

    kept = {}
    grouped = type(spark.createDataFrame([], "s string").groupBy("s"))
    monkeypatch.setattr(grouped, "applyInPandasWithState", lambda self, f, *a: kept.setdefault("f", f) and None)
    ingest.chunk_streams(spark.createDataFrame([], "stream_id string, seq long, data binary"), bits)
    state, out, most = State(), [], 0
    for k, pieces in enumerate(batches):
        frame = pd.DataFrame({"stream_id": "s", "seq": range(len(pieces)), "data": pieces})
        for got in kept["f"](("s",), iter([frame]), state):
            out += got.itertuples(index=False)
        most = max(most, len(state.value[-1]) if state.value else 0)
    assert DataFrame
    return out, most


def joined_parts(parts):
    whole = {}
    for p in parts:
        assert p.offset == p.start + len(whole.get(p.seq, b""))
        whole[p.seq] = whole.get(p.seq, b"") + p.data
    return [whole[k] for k in sorted(whole)]


def test_any_pieces_give_the_same_chunks(spark, monkeypatch):
    rng = np.random.default_rng(9)
    for bits, data in ((8, rng.integers(0, 256, 40_000, np.uint8).tobytes()), (15, rng.integers(190, 256, 60_000, np.uint8).tobytes()), (16, rng.integers(200, 256, 90_000, np.uint8).tobytes())):
        places = np.sort(rng.integers(0, len(data), 60))
        batches = [[data[a:b]] for a, b in zip([0, *places], [*places, len(data)], strict=True)] + [[b"", None]]
        parts, most = stepped(spark, monkeypatch, bits, batches)
        ends = chunking.cuts(data, bits).tolist()
        assert [len(x) for x in joined_parts(parts)] == np.diff([0, *ends]).tolist() and b"".join(joined_parts(parts)) == data and most <= 63
        assert sum(p.closes for p in parts) == len(ends)


def test_a_stream_without_cuts_is_linear(spark, monkeypatch):
    """300 batches of one value: the state stays small, and what is looked at is each batch with the 63 bytes before it."""
    seen, plain = [], chunking.candidates
    monkeypatch.setattr(chunking, "candidates", lambda x, *a: seen.append(len(x)) or plain(x, *a))
    parts, most = stepped(spark, monkeypatch, 14, [[bytes(2000)]] * 300 + [[None]])
    assert most <= 63 and sum(seen) <= 300 * 2063 + 63
    assert [len(x) for x in joined_parts(parts)] == [600_000] and [p.closes for p in parts].count(True) == 1
