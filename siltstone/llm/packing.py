"""Best-fit packing of documents into sequences under several capacities.

What a document takes (tokens, one document, attention cost) follows from its length, so documents of one length are
alike: the plan is made from how many there are of each length, which is a table of as many rows as a sequence has
tokens, whatever the size of the corpus.  The plan fills bins longest first; each time the open bins with the
best score take documents, bins that are alike together.  Documents then find their places by their rank among the
documents of their length, and ranks come from counts by partition: no group is ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.bpe import CACHE_WORDS, WordLevel, loaded, slices
from siltstone.llm.durable import written


def pieces(df: DataFrame, path: str, text: str = "text", size: int = 4096, end: int = 1, kind: type = WordLevel, words: int = CACHE_WORDS, step: int = 2 << 20) -> DataFrame:
    """A row per piece of every text, with the columns of the input but the text, and piece, start, length, ids.

    A text's ids are followed by the end id; only longer ones are cut, into pieces of `size`, of which the last may
    be shorter.  ids are unsigned little-endian 32-bit numbers.  Null and empty texts are the end id alone.
    Columns of the added names are replaced.  words, step: how many words a task remembers, and how many bytes of texts it
    codes at once: what memory it takes, not what comes out.
    """
    added = [T.StructField("piece", T.IntegerType(), False), T.StructField("start", T.LongType(), False), T.StructField("length", T.LongType(), False), T.StructField("ids", T.BinaryType(), False)]
    kept = [f for f in df.schema.fields if f.name != text and f.name not in {a.name for a in added}]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with loaded(kind, path, words) as bpe:
            for b in slices(batches, text, step):
                flat, sizes = bpe.encode(b.column(text).to_pylist())
                n = np.asarray(sizes) + 1
                ends = np.cumsum(n)
                whole = np.insert(flat.astype("<u4"), np.cumsum(sizes), end)
                cuts = -(-n // size)
                row = np.repeat(np.arange(len(n)), cuts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * size
                length = np.minimum(size, n[row] - start)
                first = ((ends - n)[row] + start) * 4
                offsets = np.append(first, ends[-1] * 4 if len(ends) else 0).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(whole.tobytes())])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in names), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), ids], schema.names)

    return df.select(*names, text).mapInArrow(run, schema)


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds at most, and how much each counts in the score of a bin."""

    tokens: int = 4096
    documents: int = 4096
    cost: int = 4096**2  #: sum of the squared lengths, what attention within documents takes
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    by: str = "norm"  #: "norm": least residual left over; "dot": largest product of what is left and what is needed


@dataclass
class _Bins:
    """Bins that are alike: how many, what they hold as (length, how many of it), and what is left."""

    many: int
    holds: list[tuple[int, int]]
    left: np.ndarray


def plan(counts: dict[int, int], capacity: Capacity = Capacity()) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how many, [(length, documents of it in each)]), for how many documents there are of each length."""
    whole = np.array([capacity.tokens, capacity.documents, capacity.cost], np.float64)
    weights = np.array(capacity.weights)
    bins: list[_Bins] = []
    left = np.zeros((0, 3))

    def put(k: int | None, need: np.ndarray, length: int, n: int) -> int:
        """Puts up to n documents into the bins of a class, each bin as full as it gets; how many found a place."""
        nonlocal left
        room = whole if k is None else left[k]
        each = int(np.min(room // need))
        many = n // each if k is None else min(bins[k].many, n // each)
        rest = n - many * each if k is None or many < bins[k].many else 0
        held = [] if k is None else bins[k].holds
        new = [_Bins(many, [*held, (length, each)], room - each * need)] if many else []
        if rest:
            new.append(_Bins(1, [*held, (length, rest)], room - rest * need))
        if k is not None:
            bins[k].many -= sum(b.many for b in new)
            if not bins[k].many:
                bins[k] = new.pop()
                left[k] = bins[k].left
        bins.extend(new)
        if new:
            left = np.vstack([left, *(b.left for b in new)])
        return many * each + rest

    for length in sorted(counts, reverse=True):
        n = counts[length]
        need = np.array([length, 1, length**2], np.float64)
        if (need > whole).any():
            raise ValueError(f"a document of {length} tokens fits no sequence")
        while n:
            fit = np.flatnonzero((left >= need).all(axis=1))
            best = None
            if len(fit):
                after = (left[fit] - need) / whole
                score = -((after**2) @ weights) if capacity.by == "norm" else (left[fit] / whole * (need / whole)) @ weights
                best = int(fit[np.argmax(score)])
            n -= put(best, need, length, n)
    return [(b.many, b.holds) for b in bins]


def tightened(counts: dict[int, int], capacity: Capacity = Capacity()) -> Capacity:
    """The capacity with its documents and cost no larger than the fullest sequence takes, and then halved for as long as
    no sequence more is needed and every length still fits: sequences hold documents of like number and cost."""
    if not counts:
        return capacity
    bins = plan(counts, capacity)
    need = sum(m for m, _ in bins)
    taken = {"documents": max(sum(k for _, k in h) for _, h in bins), "cost": max(sum(n * n * k for n, k in h) for _, h in bins)}
    for name, least in (("documents", 1), ("cost", max(counts) ** 2)):
        capacity = replace(capacity, **{name: min(getattr(capacity, name), taken[name])})
        while (half := getattr(capacity, name) // 2) >= least:
            closer = replace(capacity, **{name: half})
            if sum(m for m, _ in plan(counts, closer)) > need:
                break
            capacity = closer
    return capacity


@dataclass(frozen=True)
class Places:
    """Where the documents of each length go by rank; sorted by length and first rank."""

    length: np.ndarray
    first: np.ndarray
    many: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    @staticmethod
    def of(bins: list[tuple[int, list[tuple[int, int]]]]) -> Places:
        rows, taken, sequence = [], {}, 0
        for many, holds in bins:
            offset = 0
            for length, each in holds:
                first = taken.get(length, 0)
                rows.append((length, first, many, sequence, offset))
                taken[length] = first + many * each
                offset += length * each
            sequence += many
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        return Places(*np.ascontiguousarray(table.T))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of documents."""
        steps = 1 << 40
        at = np.searchsorted(self.length * steps + self.first, length * steps + rank, "right") - 1
        q = rank - self.first[at]
        return self.sequence[at] + q % self.many[at], self.offset[at] + q // self.many[at] * length


def pack(df: DataFrame, capacity: Capacity = Capacity(), length: str = "length", tighten: bool = False) -> DataFrame:
    """Adds sequence_id and offset to every row; rows of no, null or negative length get nulls and take no place.

    tighten: documents and cost of a sequence are held as low as they can be without a sequence more (`tightened`).

    Within a sequence documents follow one another without gaps.  Repeated rows are documents of their own, an empty
    table gives an empty one, and a row longer than a sequence is an error.  Columns of the added names are replaced.
    """
    own = "siltstone_pack_"
    kept = [f for f in df.schema.fields if f.name not in ("sequence_id", "offset")]
    names = [f.name for f in kept]
    held = F.greatest(F.coalesce(F.col(length).cast("long"), F.lit(0)), F.lit(0)).cast("long")
    table = written(df.select(*names, F.spark_partition_id().alias(f"{own}part"), held.alias(f"{own}length"), F.monotonically_increasing_id().alias(f"{own}row")), "pieces")
    by_part = written(table.groupBy(f"{own}part", f"{own}length").count(), "lengths")
    if by_part.where(F.col(f"{own}length") > capacity.tokens).limit(1).count():
        raise ValueError(f"a document has more than {capacity.tokens} tokens: cut it first")
    found = by_part.groupBy(f"{own}length").agg(F.sum("count").alias("n")).collect()  # a row for each length: bounded by the capacity
    counts = {r[0]: r.n for r in found if r[0] > 0}
    places = Places.of(plan(counts, tightened(counts, capacity) if tighten else capacity))
    # the rank of a row among those of its length: those of earlier partitions, and the earlier ones of its own
    inside = F.row_number().over(Window.partitionBy(f"{own}part", f"{own}length").orderBy(f"{own}row")) - 1
    table = table.withColumn(f"{own}rank", inside.cast("long"))
    before = F.sum("count").over(Window.partitionBy(f"{own}length").orderBy(f"{own}part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = by_part.select(f"{own}part", f"{own}length", F.coalesce(before, F.lit(0)).alias(f"{own}before"))
    shared = df.sparkSession.sparkContext.broadcast(places)
    schema = T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = shared.value
        for b in batches:
            n, r, first = (b.column(f"{own}{c}").to_numpy() for c in ("length", "rank", "before"))
            out = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            some = n > 0
            if some.any():
                for o, x in zip(out, where.find(n[some], (r + first)[some]), strict=True):
                    o[some] = x
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *(pa.array(o, mask=~some) for o in out)], schema.names)

    # `firsts` grows with the partitions: it meets the rows where the window has them already, and isn't broadcast
    return table.join(firsts.hint("merge"), [f"{own}part", f"{own}length"]).mapInArrow(place, schema)
