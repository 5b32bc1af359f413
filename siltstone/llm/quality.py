"""Quality classifier by nearest-neighbour voting in a latent-semantic space.

Texts become counts of hashed words, word shapes, pairs of neighbouring shapes and repetition; these are weighted by
inverse document frequency and projected on the leading singular vectors of the labelled texts.  The labelled
vectors, at most `per_class` for each label, go to all executors; every document is compared with all of them by
exact cosine in blocks, and its nearest neighbours vote with weights that grow with similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.bpe import slices, tidy

WORDS, SHAPES, PAIRS, REPEATS = 1024, 512, 1024, 16
WIDTH = WORDS + SHAPES + PAIRS + REPEATS
#: Weights of the four kinds of features.
BLOCKS = np.repeat([0.5, 1.0, 1.0, 1.0], [WORDS, SHAPES, PAIRS, REPEATS])
CACHE_WORDS = 100_000


def shape(word: str) -> str:
    """Upper-case runs become A, lower-case ones a, digits 0, repeated marks one."""
    out, last = [], ""
    for c in word:
        kind = "a" if c.islower() else "A" if c.isalpha() else "0" if c.isdigit() else c
        if kind != last:
            out.append(kind)
            last = kind
    return "".join(out)


class Features:
    """Counts of a text's features; keeps the buckets of words that it has seen."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.word = np.zeros(0, np.int64)
        self.shape = np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        if len(self.known) > CACHE_WORDS:
            self.__init__()
        new = [w for w in set(words) if w not in self.known]
        if new:
            texts = [w.decode("utf-8", "replace") for w in new]
            first = len(self.known)
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
            bare = [t.lower().strip(".,;:!?\"'()[]{}") for t in texts]
            self.word = np.concatenate([self.word, np.fromiter((zlib.crc32(b.encode()) % WORDS for b in bare), np.int64, len(new))])
            self.shape = np.concatenate([self.shape, np.fromiter((zlib.crc32(shape(t).encode()) % SHAPES for t in texts), np.int64, len(new))])

    def rows(self, texts: list[str | None]) -> np.ndarray:
        """One row of log-scaled shares for each text; zeros for one without words."""
        split = [(t or "").encode().split() for t in texts]
        flat = list(chain.from_iterable(split))
        self.learn(flat)
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        ends = np.cumsum([0, *map(len, split)])
        out = np.zeros((len(texts), WIDTH), np.float32)
        for k in range(len(texts)):
            w = at[ends[k] : ends[k + 1]]
            n = len(w)
            if not n:
                continue
            s = self.shape[w]
            row = out[k]
            row[:WORDS] = np.bincount(self.word[w], minlength=WORDS)
            row[WORDS : WORDS + SHAPES] = np.bincount(s, minlength=SHAPES)
            if n > 1:
                row[WORDS + SHAPES : WORDS + SHAPES + PAIRS] = np.bincount((s[:-1] * 31 + s[1:]) % PAIRS, minlength=PAIRS)
            row[: WORDS + SHAPES + PAIRS] /= n
            # how much of the text its distinct words make up, and whether words follow themselves
            fresh = len(np.unique(w)) / n
            row[WORDS + SHAPES + PAIRS + min(7, int(fresh * 8))] = 0.1
            row[WORDS + SHAPES + PAIRS + 8 + min(7, int(8 * np.mean(w[1:] == w[:-1])) if n > 1 else 0)] = 0.1
        return np.sqrt(out) * BLOCKS.astype(np.float32)


class Model:
    """What voting needs; its size is bounded by the number of labelled rows, features and dimensions."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, dimensions: int, neighbours: int, power: float):
        self.neighbours, self.power = neighbours, power
        self.labels = labels.astype(np.float32)
        self.base = float(labels.mean()) if len(labels) else 0.5
        self.idf = (np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))) + 0.3).astype(np.float32)
        weighted = rows * self.idf
        values, vectors = _leading(weighted, dimensions)
        keep = values > 1e-6 * max(values.max(initial=0), 1e-30)
        self.axes = np.ascontiguousarray(vectors[keep][:dimensions].T.astype(np.float32))
        self.vectors = self.project(rows)

    def project(self, rows: np.ndarray) -> np.ndarray:
        x = (rows * self.idf) @ self.axes
        size = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, size, out=np.zeros_like(x), where=size > 0)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Share of label 1 among the nearest neighbours, weighted; a row near none gets the labels' mean."""
        if not len(self.labels) or not self.axes.shape[1]:
            return np.full(len(rows), self.base)
        near = self.project(rows) @ self.vectors.T
        k = min(self.neighbours, len(self.labels))
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, at, 1), 0).astype(np.float64) ** self.power
        total = weight.sum(1)
        vote = (weight * self.labels[at]).sum(1)
        return np.clip(np.divide(vote, total, out=np.full(len(rows), self.base), where=total > 1e-9), 0, 1)


def _leading(x: np.ndarray, n: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Leading singular values and right vectors, by a randomised range and two power steps; all of them where there are no more than n + 16."""
    rng = np.random.default_rng(seed)
    y = x @ rng.standard_normal((x.shape[1], min(n + 16, *x.shape))).astype(np.float32)
    for _ in range(2):
        q, _ = np.linalg.qr(y)
        y = x @ (x.T @ q)
    q, _ = np.linalg.qr(y)
    _, s, vt = np.linalg.svd(q.T @ x, full_matrices=False)
    return s, vt


def held_out(id: str = "doc_id", of: int = 4, part: int = 2):
    """Whether crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % of == part, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = 1500, dimensions: int = 48, neighbours: int = 15, power: float = 8.0) -> Model:
    """Learns from at most `per_class` labelled rows of each label, those whose ids hash lowest, never held-out ones.

    Rows of `labels` with a null id or label count for nothing; of an id that is labelled differently the mean
    counts, a tie as label 1.  Without labelled rows every score is 0.5.
    """
    marks = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull() & ~held_out(id)).groupBy(F.col(id).alias("id")).agg((F.avg(label) >= 0.5).cast("int").alias("mark"))
    order = F.xxhash64("id")
    chosen = None
    for m in (0, 1):
        part = marks.where(F.col("mark") == m).orderBy(order, "id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    picked = {r.id: r.mark for r in chosen.collect()}  # at most 2 * per_class
    ids = docs.sparkSession.createDataFrame([(i,) for i in picked], "id long")
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(ids), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in slices(batches, "text", 1 << 19):
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                x = features.rows(part.column("text").to_pylist())
                hit = [np.flatnonzero(r) for r in x]
                ends = np.cumsum([0, *map(len, hit)])
                where = np.concatenate([*hit, np.zeros(0, np.int64)])
                values = np.concatenate([*(r[h] for r, h in zip(x, hit, strict=True)), np.zeros(0, np.float32)])
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), v) for v in (pa.array(where.astype(np.int32)), pa.array(values))]
                yield pa.RecordBatch.from_arrays([part.column("id"), *lists], ["id", "at", "value"])

    # of an id that several documents have, each is one labelled row, up to the bound
    seen = rows.mapInArrow(run, "id long, at array<int>, value array<float>").orderBy(F.xxhash64("id"), "id", F.xxhash64("at")).limit(2 * per_class).collect()
    x = np.zeros((len(seen), WIDTH), np.float32)
    for k, r in enumerate(seen):
        x[k, r["at"]] = r["value"]
    return Model(x, np.array([picked[r["id"]] for r in seen], np.float32), dimensions, neighbours, power)


def scores(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Adds the score of the whole text, from 0 to 1; null, empty and blank texts get the labels' mean.

    A column of the name `out` is replaced, all others are carried.
    """
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType(), False)])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, voters = Features(), shared.value
        for b in slices(batches, text, 1 << 19):
            texts = b.column(text).to_pylist()
            found = [voters.score(features.rows(texts[k : k + 128])) for k in range(0, len(texts), 128)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([*found, np.zeros(0)]), pa.float64())], schema.names)
        del features
        tidy()

    return docs.mapInArrow(run, schema)
