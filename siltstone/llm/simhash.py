"""SimHash near-duplicates by anchor-point covering.

A fingerprint is cut into segments, so that two fingerprints within the threshold differ in at most
`threshold // segments` bits of some segment.  The anchors of a segment are the words of a covering code: some
bits as they are, and a Hamming code (perfect, covering radius 1) over the rest.  A fingerprint is at home at the
code word nearest to it and is copied to every code word within covering radius plus the segment's threshold; so
two near fingerprints meet at the home of either.  Homes are compared with all fingerprints at their anchor.

`near_duplicates` links fingerprints of 64 bits that differ in a few bits.  `similar` finds texts by the similarity of
their shingles: its fingerprints have as many segments as pairs of that similarity need to meet at an anchor of some
segment, where a fingerprint goes to the one anchor within the covering radius (the segment's threshold is zero); what
meets and is near in 128 bits is a candidate, and the shingles of the candidates that hang together are compared
exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.bpe import slices, tidy
from siltstone.llm.components import connected_components, forest
from siltstone.llm.durable import written

#: Pairs that one numpy step compares at most; of fingerprints of 128 bits.
PAIRS, WIDE_PAIRS = 2_000_000, 250_000


def shingle_hashes(text: str | None, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of the text's shingles, repeats included: `width` words, or all there are; A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, seed)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    first, last = starts[: len(words) - width + 1].tolist(), (starts + sizes)[width - 1 :].tolist()
    return np.array([digest(joined[s:e], seed) for s, e in zip(first, last, strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits; bit k is set if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 14):
        part = hashes[k : k + (1 << 14)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64 bits; bit k is set if it is set in over half of the shingles' hashes; 0 for a text without words."""
    return majority(shingle_hashes(text, width, seed))


def fingerprints(df: DataFrame, text: str = "text", out: str = "fp", width: int = 4, seed: int = 42) -> DataFrame:
    """Adds the fingerprint of the whole text as a long of the same 64 bits.

    Null, empty and blank texts have fingerprint 0; a column of the name `out` is replaced, all others are carried.
    """
    df = df.drop(out)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            bits = np.array([fingerprint(t, width, seed) for t in b.column(text).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bits.view(np.int64))], [*b.schema.names, out])
        tidy()

    return df.mapInArrow(run, schema)


@dataclass(frozen=True)
class Covering:
    """The anchors of one segment: bits [low, low + plain + 2**m - 1), of which `plain` are kept and a Hamming code covers the rest."""

    number: int
    low: int
    plain: int
    m: int
    threshold: int

    @property
    def n(self) -> int:
        return 2**self.m - 1

    def syndrome(self, x: np.ndarray) -> np.ndarray:
        """Of words of n bits: the place (from 1) of the bit to flip for the nearest code word, 0 for a code word."""
        out = np.zeros(len(x), np.uint64)
        for k in range(self.n):
            out ^= ((x >> np.uint64(k)) & np.uint64(1)) * np.uint64(k + 1)
        return out

    def parts(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = fp >> np.uint64(self.low)
        return x & np.uint64(2**self.plain - 1), (x >> np.uint64(self.plain)) & np.uint64(2**self.n - 1)

    def key(self, plain: np.ndarray, code: np.ndarray) -> np.ndarray:
        return (np.uint64(self.number) << np.uint64(56)) | (code << np.uint64(self.plain)) | plain

    def home(self, fp: np.ndarray) -> np.ndarray:
        plain, code = self.parts(fp)
        s = self.syndrome(code)
        return self.key(plain, np.where(s > 0, code ^ (np.uint64(1) << (np.maximum(s, np.uint64(1)) - np.uint64(1))), code))

    def patterns(self) -> dict[int, list[tuple[int, int]]]:
        """For each syndrome: the flips (of plain bits, of covered bits) that lead to the anchors in reach."""
        out: dict[int, list[tuple[int, int]]] = {s: [] for s in range(self.n + 1)}
        for j in range(self.threshold + 1):
            flips = [sum(1 << k for k in c) for c in combinations(range(self.plain), j)]
            for w in range(1 + self.threshold - j + 1):
                for c in combinations(range(self.n), w):
                    s = 0
                    for k in c:
                        s ^= k + 1
                    out[s] += [(p, sum(1 << k for k in c)) for p in flips]
        return out

    def reach(self, fp: np.ndarray, patterns: dict[int, list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all anchors within covering radius plus threshold, and the number of the fingerprint of each."""
        plain, code = self.parts(fp)
        s = self.syndrome(code)
        keys, of = [], []
        for k, flips in patterns.items():
            rows = np.flatnonzero(s == k)
            if len(rows):
                p, c = (np.array(x, np.uint64) for x in zip(*flips, strict=True))
                keys.append(self.key(plain[rows, None] ^ p[None, :], code[rows, None] ^ c[None, :]).ravel())
                of.append(np.repeat(rows, len(flips)))
        return np.concatenate(keys), np.concatenate(of)


def coverings(threshold: int = 4, segments: int = 3, m: int = 4) -> list[Covering]:
    """Equal segments of the 64 bits, each with as many plain bits as the Hamming code of 2**m - 1 bits leaves."""
    bounds = [64 * k // segments for k in range(segments + 1)]
    return [Covering(k, a, b - a - 2**m + 1, m, threshold // segments) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]


def _spread(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is near within one large set, walking outwards from unvisited fingerprints."""
    left = np.unique(fp)
    child, parent = [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, PAIRS // len(left))
            part, front = front[:step], front[step:]
            near = np.bitwise_count(part[:, None] ^ left[None, :]) <= threshold
            hit = near.any(axis=0)
            if hit.any():
                child.append(left[hit])
                parent.append(part[near[:, hit].argmax(axis=0)])
                front = np.concatenate([front, left[hit]])
                left = left[~hit]
    none = np.zeros(0, np.uint64)
    return (np.concatenate(child), np.concatenate(parent)) if child else (none, none)


def _links(key: np.ndarray, fp: np.ndarray, codes: list[Covering], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among whole groups of rows, sorted by key: every home with every fingerprint at its anchor."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    of = np.repeat(np.arange(len(starts)), sizes)
    home = np.zeros(len(key), bool)
    number = (key >> np.uint64(56)).astype(np.int64)
    for c in codes:
        rows = np.flatnonzero(number == c.number)
        home[rows] = c.home(fp[rows]) == key[rows]
    homes = np.bincount(of[home], minlength=len(starts))
    large = homes * sizes > PAIRS
    a, b = [], []
    for g in np.flatnonzero(large).tolist():
        x, y = _spread(fp[starts[g] : starts[g] + sizes[g]], threshold)
        a.append(x)
        b.append(y)
    rows = np.flatnonzero(home & ~large[of] & (sizes[of] > 1))
    upto, at = np.cumsum(sizes[of[rows]]), 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        part = rows[at:end]
        n = sizes[of[part]]
        i = np.repeat(part, n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[of[part]], n)
        near = (fp[i] != fp[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= threshold)
        a.append(fp[i[near]])
        b.append(fp[j[near]])
        at = end
    none = np.zeros(0, np.uint64)
    return forest(np.concatenate([*a, none]), np.concatenate([*b, none]))


def near_links(distinct: DataFrame, threshold: int = 4, segments: int = 3, m: int = 4, fp: str = "fp", group_rows: int = 60_000) -> DataFrame:
    """Links (a, b) of fingerprints that differ in `threshold` bits or fewer: enough of them to join what any links join.

    distinct: one row per fingerprint (repeats and nulls change nothing).  Groups at an anchor of over `group_rows`
    rows are dealt out by pairs of sub-groups, so that no task holds more than so many rows of one anchor at a time,
    and every pair still meets.
    """
    codes = coverings(threshold, segments, m)
    whole = distinct.select(F.col(fp).alias("fp")).where("fp is not null")

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = [c.patterns() for c in codes]
        for batch in batches:
            x = batch.column("fp").to_numpy().view(np.uint64)
            for k in range(0, len(x), 4096):
                for c, p in zip(codes, flips, strict=True):
                    keys, of = c.reach(x[k : k + 4096], p)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(x[k : k + 4096][of].view(np.int64))], ["key", "fp"])

    copies = whole.mapInArrow(replicate, "key long, fp long")
    # only who is dealt out depends on these counts, no result: an eighth of the fingerprints tells them
    some = whole.where(F.pmod(F.xxhash64("fp", F.lit(1)), F.lit(8)) == 0).mapInArrow(replicate, "key long, fp long").groupBy("key").agg((F.count("*") * 8).alias("n"))
    hot = written(some.where(F.col("n") > group_rows).select("key", F.ceil(F.col("n") * 2 / group_rows).cast("int").alias("cuts")), "hot-anchors")
    n_hot = hot.count()
    if n_hot:
        dealt = copies.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "key", "left").withColumn("own", F.pmod(F.xxhash64("fp"), F.coalesce("cuts", F.lit(1))))
        dealt = dealt.select(
            "key", "fp",
            F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.least(o, "own") * F.lit(1 << 20).cast("long") + F.greatest(o, "own")))).alias("cell"),
        )
    else:
        dealt = copies.select("key", "fp", F.lit(0).cast("long").alias("cell"))
    dealt = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            new = [batch.column(c).to_numpy() for c in ("key", "cell", "fp")]
            key, cell, fps = (np.concatenate([k, n]) for k, n in zip(kept, new, strict=True))
            last = np.flatnonzero((key != key[-1]) | (cell != cell[-1])) if len(key) else key
            cutoff = last[-1] + 1 if len(last) else 0
            if cutoff:
                yield out(key[:cutoff], cell[:cutoff], fps[:cutoff])
            kept = [key[cutoff:], cell[cutoff:], fps[cutoff:]]
        if len(kept[0]):
            yield out(*kept)

    def out(key: np.ndarray, cell: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        plain = cell == 0
        x, y = _links(key[plain].view(np.uint64), fps[plain].view(np.uint64), codes, threshold)
        a.append(x)
        b.append(y)
        for c in np.unique(cell[~plain]).tolist():
            for k in np.unique(key[cell == c]).tolist():
                x, y = _spread(fps[(cell == c) & (key == k)].view(np.uint64), threshold)
                a.append(x)
                b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(z).view(np.int64)) for z in (a, b)], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", threshold: int = 4, width: int = 4) -> DataFrame:
    """(id, fp, component_id) of every row with an id: component_id is the smallest id that near fingerprints lead to.

    Null, empty and blank texts have fingerprint 0, which links like any other.  Rows without an id are left out;
    rows that repeat an id stay, each with its own component.  An empty table gives no rows; other columns are dropped.
    """
    marked = written(fingerprints(df.select(F.col(id).alias("id"), F.col(text).alias("text")).where("id is not null"), width=width).select("id", "fp"), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("id").alias("first")), "distinct-fingerprints")
    joined = connected_components(near_links(distinct, threshold))
    roots = distinct.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = written(roots.join(least, "root").select("fp", "component_id"), "classes")
    return marked.join(by_print, "fp").select(F.col("id").alias(id), "fp", "component_id")


# similarity of shingles


@dataclass(frozen=True)
class Wide:
    """How many lanes of 64 bits a fingerprint has, which segments of which lane have anchors, and how many of the first
    128 bits candidates differ in at most."""

    lanes: int
    codes: tuple[tuple[int, Covering], ...]
    limit: int

    @staticmethod
    def of(rows: int, similarity: float = 0.8, miss: float = 0.02, anchor_rows: int = 512, m: int = 4) -> Wide:
        """Segments so long that about `anchor_rows` of so many rows meet at an anchor, and so many of them that a pair of just that
        similarity meets at none with a chance of `miss`."""
        n = 2**m - 1
        p = math.acos(2 * similarity / (1 + similarity)) / math.pi  # a bit differs, for sets of like size
        plain = max(0, math.ceil(math.log2(max(1, rows) / (anchor_rows * 2 ** (n - m)))))
        # words of a perfect code of radius one have the same nearest code word: if equal; if they differ in one bit and that or none is
        # the wrong one of the first; if they differ in two bits and one of these is
        meet = (1 - p) ** n + (n * p * (1 - p) ** (n - 1) + math.comb(n, 2) * p**2 * (1 - p) ** (n - 2)) * 2 / (n + 1)
        segments = math.ceil(math.log(miss) / math.log(1 - meet * (1 - p) ** plain))
        each = 64 // (plain + n)
        codes = tuple((k // each, Covering(k, k % each * (plain + n), plain, m, 0)) for k in range(segments))
        return Wide(max(2, -(-segments // each)), codes, int(128 * p + 3 * math.sqrt(128 * p * (1 - p))))


def wide_fingerprint(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """Lanes of 64 bits, each of the distinct shingles' hashes mixed anew; zeros for a text without words."""
    steps = (np.arange(lanes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    counts = np.zeros(64 * lanes, np.int64)
    for k in range(0, len(hashes), 1 << 12):
        x = hashes[k : k + (1 << 12), None] + steps
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def _wide_spread(node: np.ndarray, x: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """As `_spread`, of rows of two lanes: links between nodes."""
    left, child, parent = np.arange(len(node)), [], []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            step = max(1, WIDE_PAIRS // len(left))
            part, front = front[:step], front[step:]
            near = np.bitwise_count(x[part, None] ^ x[None, left]).sum(axis=2, dtype=np.uint8) <= limit
            hit = near.any(axis=0)
            if hit.any():
                child.append(node[left[hit]])
                parent.append(node[part[near[:, hit].argmax(axis=0)]])
                front = np.concatenate([front, left[hit]])
                left = left[~hit]
    none = np.zeros(0, np.int64)
    return np.concatenate([*child, none]), np.concatenate([*parent, none])


def _wide_links(key: np.ndarray, node: np.ndarray, x: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among whole groups of rows of two lanes, sorted by key: every row with those that follow it in its group."""
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    of = np.repeat(np.arange(len(starts)), sizes)
    large = sizes * sizes > 2 * WIDE_PAIRS
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for g in np.flatnonzero(large).tolist():
        rows = slice(starts[g], starts[g] + sizes[g])
        i, j = _wide_spread(node[rows], x[rows], limit)
        a.append(i)
        b.append(j)
    rows = np.flatnonzero(~large[of])
    after = starts[of[rows]] + sizes[of[rows]] - rows - 1
    rows, after = rows[after > 0], after[after > 0]
    upto, at = np.cumsum(after), 0
    while at < len(rows):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + WIDE_PAIRS, "right")))
        part, n = rows[at:end], after[at:end]
        i = np.repeat(part, n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        near = np.bitwise_count(x[i, 0] ^ x[j, 0]) <= limit
        i, j = i[near], j[near]
        near = np.bitwise_count(x[i] ^ x[j]).sum(axis=1) <= limit
        a.append(node[i[near]])
        b.append(node[j[near]])
        at = end
    return forest(np.concatenate(a), np.concatenate(b))


def wide_links(nodes: DataFrame, wide: Wide, group_rows: int = 60_000) -> DataFrame:
    """Links (a, b) of nodes that meet at an anchor and are near in 128 bits: enough of them to join what any join.

    nodes: (node, lanes), one row for each fingerprint.  Which anchors have over `group_rows` rows is estimated from an eighth
    of the nodes; these are dealt out by pairs of sub-groups, as in `near_links`.
    """

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("lanes").to_pylist(), np.int64).reshape(-1, wide.lanes).view(np.uint64)
            keys = np.stack([c.home(np.ascontiguousarray(x[:, lane])) for lane, c in wide.codes], 1)
            of = np.repeat(np.arange(len(x)), len(wide.codes))
            node = batch.column("node").to_numpy()[of]
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(node), *(pa.array(x[of, k].view(np.int64)) for k in (0, 1))], ["key", "node", "x", "y"])

    schema = "key long, node long, x long, y long"
    copies = nodes.select("node", "lanes").mapInArrow(replicate, schema)
    counted = nodes.where(F.pmod(F.xxhash64("node"), F.lit(8)) == 0).select("node", "lanes").mapInArrow(replicate, schema).groupBy("key").agg((F.count("*") * 8).alias("n"))
    hot = written(counted.where(F.col("n") > group_rows).select("key", F.ceil(F.col("n") * 2 / group_rows).cast("int").alias("cuts")), "hot-anchors")
    n_hot, dealt = hot.count(), copies.withColumn("cell", F.lit(0).cast("long"))
    if n_hot:
        own = F.pmod(F.xxhash64("node"), F.coalesce("cuts", F.lit(1)))
        pairs = F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.least(o, own) * F.lit(1 << 20).cast("long") + F.greatest(o, own) + 1)
        met = copies.join(F.broadcast(hot) if n_hot <= 100_000 else hot, "key", "left")
        dealt = met.select("key", "node", "x", "y", F.explode(F.when(F.col("cuts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(pairs)).alias("cell"))
    dealt = dealt.repartition("key", "cell").sortWithinPartitions("key", "cell")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, n = ["key", "cell", "node", "x", "y"], [], 0
        for batch in batches:
            held.append([batch.column(c).to_numpy() for c in names])
            n += batch.num_rows
            if n < 1 << 15:
                continue
            rows = [np.concatenate(c) for c in zip(*held, strict=True)]
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cutoff = last[-1] + 1 if len(last) else 0
            if cutoff:
                yield out(*(r[:cutoff] for r in rows))
            held, n = [[r[cutoff:] for r in rows]], 0
        if held:
            yield out(*(np.concatenate(c) for c in zip(*held, strict=True)))
        tidy()

    def out(key: np.ndarray, cell: np.ndarray, node: np.ndarray, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        lanes = np.stack([x, y], 1).view(np.uint64)
        plain = cell == 0
        found = [_wide_links(key[plain].view(np.uint64), node[plain], lanes[plain], wide.limit)]
        for k, c in sorted(set(zip(key[~plain].tolist(), cell[~plain].tolist(), strict=True))):
            rows = (key == k) & (cell == c)
            found.append(_wide_spread(node[rows], lanes[rows], wide.limit))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1)], ["a", "b"])

    return dealt.select("key", "cell", "node", "x", "y").mapInArrow(compare, "a long, b long")


def jaccard_forest(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between numbers of sets (arrays of distinct values): enough to join all whose Jaccard similarity is so much or more.

    Two such sets have one of their rarest values in common: of all but that share of the smaller one's values, and one more.
    Where many sets share these, bitmaps of all values tell most of the others apart: no more of their bits differ than values do.
    """
    none = np.zeros(0, np.int64)
    sizes = np.array([len(x) for x in sets], np.int64)
    if len(sets) < 2 or not sizes.any():
        return none, none
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int32)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often), dtype=np.int32)
    owner, value = np.repeat(np.arange(len(sets), dtype=np.int32), sizes), rank[code]
    del code, rank
    starts = np.cumsum(sizes) - sizes
    for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        value[a : a + n].sort()
    prefix = np.minimum(sizes, sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1)
    inside = np.arange(len(value)) - starts[owner] < prefix[owner]
    by_value = np.argsort(value[inside], kind="stable")
    holder, first = owner[inside][by_value], np.searchsorted(value[inside][by_value], np.arange(len(often) + 1))
    del by_value, inside
    # about eight bits for each value, 1,024 at most
    words = 1 << min(4, max(0, int(sizes.mean() / 8).bit_length() - 1))
    bits = np.zeros(len(sets) * words, np.uint64)
    for k in range(0, len(value), 1 << 18):
        v = value[k : k + (1 << 18)].astype(np.uint64)
        at = owner[k : k + (1 << 18)].astype(np.int64) * words + ((v >> np.uint64(6)) & np.uint64(words - 1)).astype(np.int64)
        np.bitwise_or.at(bits, at, np.uint64(1) << (v & np.uint64(63)))
    bits = bits.reshape(-1, words)
    del owner

    def ragged(start: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())

    left, mark = sizes > 0, np.zeros(len(often), bool)
    rest, apart = int(left.sum()), (1 - similarity) / (1 + similarity)
    child, parent = [], []
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root], front, rest = False, [root], rest - 1
        while front and rest:
            f = front.pop()
            rare = value[starts[f] : starts[f] + prefix[f]]
            often_met = first[rare + 1] - first[rare]
            if often_met.sum() < rest:
                met = holder[ragged(first[rare], often_met)]
                met = np.unique(met[left[met]])
            else:
                met = np.flatnonzero(left)
            met = met[np.minimum(sizes[met], sizes[f]) >= similarity * np.maximum(sizes[met], sizes[f]) - 1e-9]
            differ = np.bitwise_count(bits[met] ^ bits[f]).sum(axis=1, dtype=np.int64)
            met = met[differ <= apart * (sizes[met] + sizes[f]) + 1e-6]
            if not len(met):
                continue
            own = value[starts[f] : starts[f] + sizes[f]]
            mark[own] = True
            n = sizes[met]
            common = np.add.reduceat(mark[value[ragged(starts[met], n)]], np.cumsum(n) - n, dtype=np.int64)
            mark[own] = False
            hit = met[common >= similarity * (sizes[f] + n - common) - 1e-9]
            left[hit], rest = False, rest - len(hit)
            child.append(hit)
            parent.append(np.full(len(hit), f))
            front += hit.tolist()
    return np.concatenate([*child, none]), np.concatenate([*parent, none])


def verified_links(members: DataFrame, similarity: float = 0.8, width: int = 5, text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """Links (a, b, whole) of nodes of one group whose texts' sets of shingles are similar: enough of them to join what any join.
    whole: the group was in one block, and b is the smallest node that a reaches.

    members: (group, node, size, text), one row for each node; size: the bytes that its group's sets take in all.  A group
    whose sets don't fit a block is cut into blocks, which meet in pairs; so no group has to fit a task.  A text without
    words is similar to none; rows that repeat a node change nothing.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, 1 << 19):
            found = [np.unique(shingle_hashes(t, width)).tobytes() for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("group", "node", "size")), pa.array(found, pa.binary())], ["group", "node", "size", "shingles"])
        tidy()

    table = written(members.select("group", "node", "size", text).mapInArrow(sets, "group long, node long, size long, shingles binary"), "shingles")
    own = table.withColumn("cuts", F.expr(f"cast(1 + size div {block_bytes} as int)")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.select("group", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "cuts", "node", "shingles")
    dealt = dealt.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, whole, ids, held = None, True, [], []
        for b in batches:
            out: list[tuple[np.ndarray, np.ndarray, bool]] = []
            rows = zip(*(b.column(c).to_pylist() for c in ("group", "low", "high", "cuts", "node", "shingles")), strict=True)
            for group, low, high, cuts, node, raw in rows:
                if (group, low, high) != at:
                    join(ids, held, whole, out)
                    at, whole, ids, held = (group, low, high), cuts == 1, [], []
                ids.append(node)
                held.append(np.frombuffer(raw, np.uint64))
            yield said(out)
        out = []
        join(ids, held, whole, out)
        yield said(out)
        tidy()

    def join(ids: list[int], held: list[np.ndarray], whole: bool, out: list[tuple[np.ndarray, np.ndarray, bool]]) -> None:
        numbers = np.array(ids, np.int64)
        i, j = jaccard_forest(held, similarity)
        out.append((*forest(numbers[i], numbers[j]), whole))

    def said(out: list[tuple[np.ndarray, np.ndarray, bool]]) -> pa.RecordBatch:
        pairs = [pa.array(np.concatenate([*(o[k] for o in out), np.zeros(0, np.int64)])) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*pairs, pa.array(np.repeat([o[2] for o in out], [len(o[0]) for o in out]).astype(bool))], ["a", "b", "whole"])

    return dealt.mapInArrow(compare, "a long, b long, whole boolean")


#: Rows of numbers that are broadcast at most: some 40 MB.
BROADCAST_ROWS = 500_000


def _checked(table: DataFrame) -> DataFrame:
    """A written, narrow table to be broadcast if its rows are few, and to be merged otherwise."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table.hint("merge")


def similar(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = 0.8, width: int = 5, miss: float = 0.02) -> DataFrame:
    """(id, component_id) of every row with an id: component_id is the smallest id that similar texts lead to.

    Texts are similar if the Jaccard similarity of their sets of shingles of `width` words (A-Z lower-cased) is `similarity`
    or more.  None of the links is wrong; of pairs just that similar about `miss` don't meet, of others fewer.  Texts
    without words are alike.  Rows without an id are left out; rows that repeat an id stay, each with its own component.
    An empty table gives no rows; other columns are dropped.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where("id is not null")
    rows = rows.withColumn("key", F.xxhash64("id", F.coalesce("text", F.lit(""))))
    wide = Wide.of(rows.count(), similarity, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 1 << 19):
            hashes = [np.unique(shingle_hashes(t, width)) for t in b.column("text").to_pylist()]
            lanes = [wide_fingerprint(h, wide.lanes).view(np.int64) for h in hashes]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array([len(h) for h in hashes], pa.int64()), pa.array(lanes, pa.list_(pa.int64()))], ["id", "key", "n", "lanes"])
        tidy()

    kind = rows.schema["id"].dataType.simpleString()
    marked = written(rows.mapInArrow(run, f"id {kind}, key long, n long, lanes array<long>"), "wide-fingerprints")
    distinct = marked.groupBy("lanes").agg(F.min(F.struct("id", "key", "n")).alias("first"))
    nodes = written(distinct.select("lanes", "first", F.monotonically_increasing_id().alias("node")), "nodes")
    groups = connected_components(wide_links(nodes, wide)).withColumnRenamed("component", "group")
    members = nodes.join(groups, "node").select("group", "node", F.col("first.key").alias("key"), F.col("first.n").alias("n"))
    members = written(members, "candidates")
    sizes = members.groupBy("group").agg((F.sum("n") * 8).alias("size"))
    told = written(members.join(sizes, "group").select("group", "node", "key", "size"), "candidates")
    # texts stay where they are as long as the candidates are few enough to go to them
    texts = rows.select("key", "text").join(_checked(told), "key")
    found = written(verified_links(texts, similarity, width), "verified-links")
    # classes of groups in one block are settled; those of groups in several are put together
    done = found.where("whole").select(F.col("a").alias("node"), F.col("b").alias("component"))
    joined = done.unionByName(connected_components(found.where("not whole").select("a", "b")))
    roots = nodes.join(joined, "node", "left").select("lanes", F.col("first.id").alias("first"), F.coalesce("component", "node").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = written(roots.join(least, "root").select("lanes", "component_id"), "classes")
    return marked.join(by_print, "lanes").select(F.col("id").alias(id), "component_id")


def survivors(docs: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One document of each class of similar texts, the one with the smallest id, with all its columns.

    Rows that repeat an id are one document.  Rows without an id stay, as nothing can be said against them.  Texts
    without words are one class; an empty table gives no rows.
    """
    found = written(similar(docs, id, text, similarity, width), "classes-of-rows")
    lost = written(found.where(F.col(id) != F.col("component_id")).select(F.col(id).alias("siltstone_lost")).distinct(), "near-duplicates")
    kept = docs.join(_checked(lost), F.col(id) == F.col("siltstone_lost"), "left_anti")
    if found.groupBy(id).count().where("count > 1").limit(1).count():
        kept = kept.where(F.col(id).isNotNull()).dropDuplicates([id]).unionByName(kept.where(F.col(id).isNull()))
    return kept
