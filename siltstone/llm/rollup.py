"""Token counts kept up by deltas: every batch adds signed totals by source, language and tokenizer version.

A batch is one folder, written whole and then marked as done by the committer; a batch that is committed again, or
again after a crash, counts once.  Totals are sums over the batches that are done.  Compaction folds finished
batches into a snapshot that names them, so that reading stays cheap; its own mark makes it valid.
"""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.bpe import Bpe, loaded, slices
from siltstone.llm.durable import written

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def count_tokens(df: DataFrame, versions: dict[str, tuple[type[Bpe], str] | None], columns: dict[str, str] | None = None) -> DataFrame:
    """Adds, for each text column, a map from tokenizer version to the number of tokens of the whole text.

    versions: for each name the kind and file of a vocabulary, or None for words that ASCII's white space parts.
    columns: names of the maps by text column, {"text": "tokens"} if not given.  Null and empty texts have no tokens.
    Columns of the maps' names are replaced, all others are carried.
    """
    columns = columns or {"text": "tokens"}
    df = df.drop(*columns.values())
    schema = T.StructType([*df.schema.fields, *(T.StructField(c, T.MapType(T.StringType(), T.LongType(), False), False) for c in columns.values())])
    names, first = list(versions), next(iter(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with contextlib.ExitStack() as stack:
            coders = {n: v and stack.enter_context(loaded(*v)) for n, v in versions.items()}
            for b in slices(batches, first):
                maps = []
                for c in columns:
                    texts = b.column(c).to_pylist()
                    counts = np.array([coders[n].encode(texts)[1] if coders[n] else [len((t or "").encode().split()) for t in texts] for n in names], np.int64)
                    ends = pa.array(np.arange(len(texts) + 1) * len(names), pa.int32())
                    maps.append(pa.MapArray.from_arrays(ends, pa.array(names * len(texts), pa.string()), pa.array(counts.T.ravel())))
                yield pa.RecordBatch.from_arrays([*b.columns, *maps], schema.names)

    return df.mapInArrow(run, schema)


def signed(counted: DataFrame, sign: int, tokens: str = "tokens") -> DataFrame:
    """Deltas of documents that come (1) or go (-1): a row for each document and tokenizer version."""
    return counted.select("source", "lang", F.explode(tokens).alias("tokenizer", "n")).select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.col("n") * sign).alias("n_tokens"))


def revised(counted: DataFrame, before: str, after: str) -> DataFrame:
    """Deltas of documents whose counts change: the old count goes and the new one comes."""
    return signed(counted, -1, before).unionByName(signed(counted, 1, after))


class Ledger:
    """Batches of deltas in one folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _done(self, kind: str) -> list[str]:
        """Names of the finished folders of a kind."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(n for n in found if n.startswith(kind) and self._fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS")))

    def batches(self) -> list[str]:
        """Ids of the committed batches, folded ones included."""
        return sorted({n.removeprefix("batch-") for n in self._done("batch-")} | set(self._folded()))

    def _snapshot(self) -> str | None:
        done = [n for n in self._done("snapshot-") if self._fs.exists(self._path(f"{self.folder}/{n}.batches/_SUCCESS"))]
        return done[-1] if done else None

    def _folded(self) -> list[str]:
        last = self._snapshot()
        return [r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.folder}/{last}.batches").collect()] if last else []

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Adds a batch; False, and nothing read or written, if one of this id is there already."""
        if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
            raise ValueError(f"no batch id: {batch!r}")
        if batch in self.batches():
            return False
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.where("n_docs <> 0 or n_tokens <> 0").write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        return True

    def totals(self) -> DataFrame:
        """n_docs and n_tokens by source, language and tokenizer version; what has come to nothing is left out."""
        last, folded = self._snapshot(), set(self._folded())
        paths = [f"{self.folder}/{n}" for n in self._done("batch-") if n.removeprefix("batch-") not in folded] + [f"{self.folder}/{last}"] * bool(last)
        rows = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        sums = rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Folds all finished batches into a snapshot; batch folders that it holds are deleted after it is valid."""
        done = self.batches()
        last = self._snapshot()
        name = f"snapshot-{int(last.removeprefix('snapshot-')) + 1 if last else 0:09d}"
        self.totals().write.mode("overwrite").parquet(f"{self.folder}/{name}")
        self.spark.createDataFrame([(b,) for b in done], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{name}.batches")
        for b in done:
            self._fs.delete(self._path(f"{self.folder}/batch-{b}"), True)


def without_repeated_lines(text: str) -> Column:
    """SQL of the text with each line once, where it first stands."""
    return F.array_join(F.array_distinct(F.split(F.col(text), "\n", -1)), "\n")


def maintained(docs: DataFrame, folder: str, versions: dict[str, tuple[type[Bpe], str] | None]) -> Ledger:
    """A ledger of documents (doc_id, text, lang, source) after three batches, each delivered twice.

    load: all documents come.  copies: documents whose whole text a smaller doc_id has go.  lines: of the documents
    left, those with repeated lines are counted anew without these.  Documents without an id come and stay; null
    texts are copies of one another, and null sources and languages are groups of their own.
    """
    spark = docs.sparkSession
    clean = docs.select("doc_id", "source", "lang", "text", F.sha2(F.col("text"), 256).alias("digest"), without_repeated_lines("text").alias("once"))
    twice = clean.withColumn("once", F.when(F.col("text") != F.col("once"), F.col("once")))
    counted = count_tokens(twice, versions, {"text": "tokens", "once": "after"})
    counted = written(counted.select("doc_id", "source", "lang", "digest", "tokens", F.when(F.col("once").isNotNull(), F.col("after")).alias("after")), "token-counts")
    least = counted.groupBy("digest").agg(F.min("doc_id").alias("first"))
    marked = written(counted.join(least, counted.digest.eqNullSafe(least.digest)).select("source", "lang", "tokens", "after", (F.col("doc_id") > F.col("first")).alias("copy")), "token-marks")
    ledger = Ledger(spark, folder)
    for _ in range(2):
        ledger.commit("load", signed(counted, 1))
        ledger.commit("copies", signed(marked.where("copy"), -1))
        ledger.commit("lines", revised(marked.where("not coalesce(copy, false) and after is not null"), "tokens", "after"))
    return ledger
