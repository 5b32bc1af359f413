"""Near-duplicate vectors by a robust-pruned flat graph.

Vectors that are equal in all components are one node.  The nodes of each label are dealt to overlapping clusters
around centroids of a bounded sample; clusters that are still too large are divided again, until none is.  Each shard
gives its nodes pruned adjacency lists; a node's lists from all its shards are united.  Every node is then searched
for in its home shard's part of the graph: greedily from the medoids (and from itself), and outwards from everything
in range.  Found pairs are verified in double precision and counted as they are found, each pair in one shard and for
both of its ends; pairs aren't kept.  A bounded sample is compared with all vectors to audit the recall, and the
search is widened if that is too low.  Cells that are so dense that a node has more links than a shard has room for,
and cells that division doesn't make smaller, are not divided: all their pairs are compared, by pairs of blocks.  So
are all cells if the last audit fails.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm.components import connected_components, forest
from siltstone.llm.durable import written


@dataclass(frozen=True)
class Search:
    """Sizes of the graph and of the search; all bounds are on what one task or the driver holds."""

    shard_rows: int = 512  #: nodes that a shard is meant to have, before overlap; it has 8 times as many at most
    overlap: int = 3  #: shards that a node is a member of after a division
    fanout: int = 1024  #: centroids of one division, at most
    centroid_bytes: int = 64 << 20  #: of all centroids of one round of division, what is broadcast
    sample: int = 32  #: rows for each centroid that these are fitted on
    pool: int = 48  #: candidates of the pruning
    degree: int = 24  #: neighbours kept by it
    alpha: float = 1.2
    beam: int = 32
    medoids: int = 4
    audit_rows: int = 200
    least_recall: float = 0.95
    block_rows: int = 2048  #: of a dense cell; a task holds two blocks and the table of their links


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision, without overflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: str) -> Column:
    """Not null or empty, all components finite, one of them not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def adjacency(x: np.ndarray, s: Search) -> list[np.ndarray]:
    """Robust-pruned neighbours of each row of unit vectors, nearest first."""
    n, out = len(x), []
    pool = min(s.pool, n - 1)
    if pool < 1:
        return [np.zeros(0, np.int64)] * n
    for a in range(0, n, 128):
        rows = np.arange(a, min(n, a + 128))
        near = x[rows] @ x.T
        near[np.arange(len(rows)), rows] = -2
        c = np.argpartition(-near, pool - 1, axis=1)[:, :pool]
        d = np.take_along_axis(near, c, 1)
        order = np.argsort(-d, axis=1, kind="stable")
        c, d = np.take_along_axis(c, order, 1), 1 - np.take_along_axis(d, order, 1)
        y = x[c]
        between = 1 - y @ y.transpose(0, 2, 1)
        open_, kept = np.ones_like(d, bool), np.zeros_like(d, bool)
        at = np.arange(len(rows))
        for _ in range(s.degree):
            k = open_.argmax(axis=1)
            some = open_[at, k]
            if not some.any():
                break
            kept[at[some], k[some]] = True
            open_ &= ~(some[:, None] & (s.alpha * between[at, k] <= d))
            open_[at, k] = False
        out += [c[r, kept[r]] for r in range(len(rows))]
    return out


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def search(x: np.ndarray, first: np.ndarray, to: np.ndarray, queries: np.ndarray, threshold: float, s: Search) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) with a cosine in reach of the threshold, found on the graph, by blocks of queries.

    first: bounds of each node's part of `to`.
    """
    n, limit = len(x), threshold - 1e-4
    middle = [int(np.argmax(x @ x.mean(0)))]
    for _ in range(min(s.medoids, n) - 1):
        middle.append(int(np.argmin((x @ x[middle].T).max(1))))
    step = max(1, min(256, (16 << 20) // max(1, n)))
    for a in range(0, len(queries), step):
        q = queries[a : a + step]
        m, width = len(q), s.beam
        found_q, found_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        seen, done = np.zeros((m, n), bool), np.zeros((m, n), bool)
        beam, score = np.zeros((m, width), np.int64), np.full((m, width), -2.0, np.float32)
        new_q, new_v = np.repeat(np.arange(m), len(middle) + 1), np.column_stack([np.tile(middle, (m, 1)), q]).ravel()
        while True:
            if len(new_q):
                flat = np.unique(new_q * n + new_v)
                flat = flat[~seen.ravel()[flat]]
                seen.ravel()[flat] = True
                new_q, new_v = flat // n, flat % n
            sims = np.einsum("ij,ij->i", x[q[new_q]], x[new_v])
            hit = sims >= limit
            found_q.append(q[new_q[hit]])
            found_v.append(new_v[hit])
            counts = np.bincount(new_q, minlength=m)
            if len(new_q):
                room = int(counts.max())
                more, more_score = np.zeros((m, room), np.int64), np.full((m, room), -2.0, np.float32)
                place = np.arange(len(new_q)) - np.repeat(np.cumsum(counts) - counts, counts)
                more[new_q, place], more_score[new_q, place] = new_v, sims
                beam, score = np.hstack([beam, more]), np.hstack([score, more_score])
                best = np.argsort(-score, axis=1, kind="stable")[:, :width]
                beam, score = np.take_along_axis(beam, best, 1), np.take_along_axis(score, best, 1)
            waiting = (score > -2) & ~np.take_along_axis(done, beam, 1)
            rank = np.cumsum(waiting, axis=1)
            qi, bi = np.nonzero(waiting & (rank <= 4))
            go = np.unique(np.concatenate([qi * n + beam[qi, bi], new_q[hit] * n + new_v[hit]]))
            go = go[~done.ravel()[go]]
            if not len(go):
                break
            done.ravel()[go] = True
            nodes = go % n
            sizes = first[nodes + 1] - first[nodes]
            new_q, new_v = np.repeat(go // n, sizes), to[_ragged(first[nodes], sizes)]
        yield np.concatenate(found_q), np.concatenate(found_v)


def centroids_of(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means from spread-out first centres."""
    centres = [x[0]]
    near = x @ centres[0]
    for _ in range(min(k, len(x)) - 1):
        centres.append(x[int(np.argmin(near))])
        near = np.maximum(near, x @ centres[-1])
    c = np.array(centres)
    for _ in range(rounds):
        home = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(size > 0, sums / np.maximum(size, 1e-30), c)
    return c


def _vectors(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    """Rows of one length, held as little-endian numbers of a kind, in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def dense(x: np.ndarray, count: int, threshold: float, s: Search) -> bool:
    """Whether a cell of so many rows, of which x are drawn, gives its rows more links than its shards would hold.

    The share of linked pairs also bounds the cost of comparing all: cells that are both large and thin are divided first.
    """
    x = x[:2048]
    share = (np.count_nonzero(x @ x.T >= threshold) - len(x)) / max(1, len(x) * (len(x) - 1))
    return share * count > s.shard_rows / 2 and (share >= 1 / 64 or count <= 512 * s.shard_rows)


def shards(nodes: DataFrame, threshold: float, s: Search) -> tuple[DataFrame, list[str]]:
    """(cell, home, node, weight, vector, coarse): every node once at home, and as a member of the shards next to it;
    and the cells of which all pairs are to be compared.

    nodes: (cell, node, weight, vector, coarse). Cells of up to 8 times the wanted rows stay whole, and so do dense cells and
    those of which a division left nearly all rows in one part.
    """
    spark = nodes.sparkSession
    names = ["cell", "node", "weight", "vector", "coarse", "home"]
    schema = "cell string, node long, weight long, vector binary, coarse binary, home boolean"
    table = nodes.withColumn("home", F.lit(True)).select(*names)
    row = table.select(F.max(F.octet_length("coarse"))).first()[0] or 1
    room = max(16, s.centroid_bytes // (4 * row))
    done, whole, parents = [], [], {}

    def fit(group: pa.Table) -> pa.Table:
        x = unit(_vectors(group.sort_by("node").column("coarse").combine_chunks(), "<f2"))
        count, wanted = group.column("count")[0].as_py(), group.column("wanted")[0].as_py()
        full = dense(x, count, threshold, s)
        c = np.zeros((0, 1)) if full else centroids_of(x, wanted)
        return pa.table({"cell": group.column("cell").slice(0, 1), "k": pa.array([len(c)], pa.int32()), "centroids": pa.array([c.tobytes()], pa.binary())})

    while True:
        large = table.groupBy("cell").count().where(F.col("count") > 8 * s.shard_rows)
        # the largest first, as many as there is room for: those that are left wait for the next round
        sizes = {r.cell: r["count"] for r in large.orderBy(F.desc("count"), "cell").limit(room // 8).collect()}
        stuck = [c for c, n in sizes.items() if n > 0.9 * parents.get(c.rpartition("/")[0], n * 2)]
        whole += stuck
        wanted, left = {}, room
        for c, n in sizes.items():
            k = min(s.fanout, -(-n // s.shard_rows))
            if c not in stuck and (k <= left or not wanted):
                wanted[c], left = k, left - k
        if not sizes:
            break
        if wanted:
            parents |= {c: sizes[c] for c in wanted}
            rate = spark.createDataFrame([(c, sizes[c], k, min(1.0, s.sample * k / sizes[c])) for c, k in wanted.items()], "cell string, count long, wanted int, rate double")
            drawn = table.where("home").join(F.broadcast(rate), "cell").where((F.xxhash64(F.lit(len(parents)), "node").bitwiseAND(2**52 - 1) / 2.0**52) < F.col("rate"))
            fitted = drawn.select("cell", "node", "coarse", "count", "wanted").groupBy("cell").applyInArrow(fit, "cell string, k int, centroids binary").collect()  # at most `room` centroids
            centres = {r.cell: np.frombuffer(bytes(r.centroids)).reshape(r.k, -1) for r in fitted if r.k > 1}
            whole += [c for c in wanted if c not in centres]
            shared = spark.sparkContext.broadcast(centres)

            def deal(batches: Iterator[pa.RecordBatch], shared=shared, overlap=s.overlap) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    cells = np.array(b.column("cell").to_pylist(), object)
                    at, names_, nearest = [], [], []
                    for cell in dict.fromkeys(cells):
                        rows = np.flatnonzero(cells == cell)
                        c = shared.value.get(cell)
                        if c is None:
                            at.append(rows)
                            names_ += [cell] * len(rows)
                            nearest.append(np.ones(len(rows), bool))
                            continue
                        near = unit(_vectors(b.column("coarse").take(pa.array(rows)), "<f2")) @ c.T
                        k = min(overlap, len(c))
                        best = np.argsort(-near, axis=1, kind="stable")[:, :k]
                        at.append(np.repeat(rows, k))
                        names_ += [f"{cell}/{j}" for j in best.ravel().tolist()]
                        nearest.append(np.tile(np.arange(k) == 0, len(rows)))
                    out = b.take(pa.array(np.concatenate([*at, np.zeros(0, np.int64)])))
                    home = np.concatenate([*nearest, np.zeros(0, bool)]) & out.column("home").to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([pa.array(names_, pa.string()), *(out.column(c) for c in names[1:-1]), pa.array(home)], names)

        # what needs no division leaves the table: a round reads and writes what is still too large
        open_ = large.select("cell").join(_named(spark, [*whole]), "cell", "left_anti")
        done.append(written(table.join(open_, "cell", "left_anti"), "shards"))
        rest = table.join(open_, "cell", "left_semi")
        if wanted:
            rest = rest.mapInArrow(deal, schema)
        table = written(rest, "to-divide")
    members = table
    for part in done:
        members = members.unionByName(part)
    return members, whole


def _named(spark: SparkSession, cells: list[str]) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(c,) for c in cells], "cell string"))


class _Owner:
    """Which pairs of a shard count here: those of two nodes at home, and those of one at home with one that isn't, unless the other's
    home has both as well and comes first. So every pair that any shard can see counts in exactly one."""

    def __init__(self, cell: str, homes: list[str], cells: list[list[str]]):
        codes = {h: k for k, h in enumerate(dict.fromkeys(homes))}
        self.of = np.array([codes[h] for h in homes], np.int64)
        self.home = self.of == codes.get(cell, -1)
        self.elsewhere = np.zeros((len(codes), len(homes)), bool)
        for k, own in enumerate(cells):
            for c in own:
                if c < cell and c in codes:
                    self.elsewhere[codes[c], k] = True

    def counts(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether pairs (i at home, j) count here."""
        return self.home[j] | ~self.elsewhere[self.of[j], i]

    def table(self, rows: slice, columns: slice) -> np.ndarray:
        """Whether pairs count here, for all of some rows with all of some others."""
        one = self.home[rows][:, None] & (self.home[columns][None, :] | ~self.elsewhere[self.of[columns]][:, rows].T)
        two = self.home[columns][None, :] & (self.home[rows][:, None] | ~self.elsewhere[self.of[rows]][:, columns])
        return one | two


def _said(ids: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Counts of links, and links that hold components together."""
    some = np.flatnonzero(n)
    return pa.table({
        "a": pa.chunked_array([pa.array(ids[some]), pa.array(a, pa.int64())]), "n": pa.chunked_array([pa.array(n[some]), pa.nulls(len(a), pa.int64())]),
        "b": pa.chunked_array([pa.nulls(len(some), pa.int64()), pa.array(b, pa.int64())]),
    })


def exact_links(members: DataFrame, threshold: float, block_rows: int, kind: str) -> DataFrame:
    """As `links`, from all pairs of each cell's members; blocks of a cell meet in pairs, so no cell has to fit a task."""
    cuts = members.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("cuts"))
    own = members.join(cuts, "cell").withColumn("own", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt = dealt.select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "weight", "vector", "homes", "cells")

    def compare(group: pa.Table) -> pa.Table:
        group = group.sort_by("own")
        block, ids, weight = (group.column(c).to_numpy() for c in ("own", "node", "weight"))
        owner = _Owner(group.column("cell")[0].as_py(), group.column("homes").to_pylist(), group.column("cells").to_pylist())
        x = unit(_vectors(group.column("vector").combine_chunks(), kind))
        cut = int(np.searchsorted(block, block[-1]))  # 0 if a block meets itself, else where the second one begins
        near = np.zeros((len(x), len(x)), bool)
        if cut:
            first, second = slice(0, cut), slice(cut, len(x))
            near[first, second] = (x[first] @ x[second].T >= threshold) & owner.table(first, second)
            near[second, first] = near[first, second].T
        else:
            near = (x @ x.T >= threshold) & owner.table(slice(0, len(x)), slice(0, len(x)))
            np.fill_diagonal(near, False)
        n = np.array([weight[row].sum() for row in near], np.int64)
        child, parent, left = [], [], np.ones(len(x), bool)
        for root in np.flatnonzero(near.any(axis=1)).tolist():
            if not left[root]:
                continue
            left[root], front = False, np.array([root])
            while len(front):
                reached = near[front[:256]].any(axis=0) & left
                left &= ~reached
                new = np.flatnonzero(reached)
                child.append(ids[new])
                parent.append(np.full(len(new), ids[root]))
                front = np.concatenate([front[256:], new])
        none = np.zeros(0, np.int64)
        return _said(ids, n, np.concatenate([*child, none]), np.concatenate([*parent, none]))

    return dealt.groupBy("cell", "low", "high").applyInArrow(compare, "a long, n long, b long")


def links(nodes: DataFrame, threshold: float, s: Search, kind: str) -> DataFrame:
    """(a, n, b): with b null, links n that node a was found to have in one shard, by weight; else a pair (a, b) that
    holds a component together."""
    members, whole = shards(nodes, threshold, s)
    thin = members.join(_named(nodes.sparkSession, whole), "cell", "left_anti") if whole else members

    def build(group: pa.Table) -> pa.Table:
        ids = group.column("node").to_numpy()
        lists = adjacency(unit(_vectors(group.column("coarse").combine_chunks(), "<f2")).astype(np.float32), s)
        src, to = np.repeat(ids, [len(x) for x in lists]), ids[np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64)]
        return pa.table({"node": np.concatenate([src, to]), "to": np.concatenate([to, src])})

    edges = thin.select("cell", "node", "coarse").groupBy("cell").applyInArrow(build, "node long, to long")
    united = edges.groupBy("node").agg(F.collect_set("to").alias("near"))
    held = members.groupBy("node").agg(F.collect_set("cell").alias("cells"), F.max(F.when(F.col("home"), F.col("cell"))).alias("homes"))
    places = written(members.select("cell", "node").join(held, "node"), "places")
    # vectors go to their shards once: lists and places, which are narrow, come to them there
    told = places.join(_named(nodes.sparkSession, whole), "cell", "left_anti") if whole else places
    told = told.join(united, "node", "left")

    def find(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = left.sort_by("node"), right.sort_by("node")
        ids, weight = left.column("node").to_numpy(), left.column("weight").to_numpy()
        if not len(ids):
            return _said(ids, ids, ids, ids)
        exact = unit(_vectors(left.column("vector").combine_chunks(), kind))
        owner = _Owner(left.column("cell")[0].as_py(), right.column("homes").to_pylist(), right.column("cells").to_pylist())
        near = right.column("near").combine_chunks()
        counts = np.array([len(v) if v is not None else 0 for v in near.to_pylist()], np.int64)
        src, to = np.repeat(np.arange(len(ids)), counts), near.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.minimum(np.searchsorted(ids, to), len(ids) - 1)
        here = ids[at] == to  # neighbours that are members of this shard
        src, to = src[here], at[here]
        first = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=len(ids)))])
        n, a, b = np.zeros(len(ids), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        home = np.flatnonzero(owner.home)
        number = np.cumsum(owner.home) - 1
        # of two nodes at home either may find the other; a shard has at most 8 * shard_rows nodes
        linked = np.zeros((len(home), len(home)), bool)
        for q, v in search(exact.astype(np.float32), first, to, home, threshold, s):
            keep = [np.zeros(0, bool)]
            for k in range(0, len(q), 1 << 16):
                keep.append(np.einsum("ij,ij->i", exact[q[k : k + (1 << 16)]], exact[v[k : k + (1 << 16)]]) >= threshold)
            good = np.concatenate(keep) & (q != v)
            q, v = q[good], v[good]
            good = owner.counts(q, v)
            q, v = q[good], v[good]
            a, b = forest(np.concatenate([a, q]), np.concatenate([b, v]))
            inner = owner.home[v]
            linked[number[q[inner]], number[v[inner]]] = linked[number[v[inner]], number[q[inner]]] = True
            n += np.bincount(q[~inner], weights=weight[v[~inner]], minlength=len(ids)).astype(np.int64)
            n += np.bincount(v[~inner], weights=weight[q[~inner]], minlength=len(ids)).astype(np.int64)
        n[home] += np.array([weight[home[row]].sum() for row in linked], np.int64)
        return _said(ids, n, ids[a], ids[b])

    searched = thin.select("cell", "node", "weight", "vector").groupBy("cell").cogroup(told.groupBy("cell")).applyInArrow(find, "a long, n long, b long")
    if not whole:
        return searched
    crowded = members.join(_named(nodes.sparkSession, whole), "cell", "left_semi").join(places, ["cell", "node"])
    return searched.unionByName(exact_links(crowded, threshold, s.block_rows, kind))


def audit(nodes: DataFrame, found: DataFrame, threshold: float, rows: int, kind: str) -> tuple[float, int]:
    """Recall of the links of so many nodes (those whose hash is lowest), compared with all; and how many links these have."""
    drawn = nodes.orderBy(F.xxhash64("node"), "node").limit(rows).collect()
    if not drawn:
        return 1.0, 0
    by_cell: dict[str, list] = {}
    for r in drawn:
        by_cell.setdefault(r.cell, []).append((r.node, unit(np.frombuffer(bytes(r.vector), kind)[None, :].astype(np.float64))[0]))
    shared = nodes.sparkSession.sparkContext.broadcast(by_cell)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, ids, weight = np.array(b.column("cell").to_pylist(), object), b.column("node").to_numpy(), b.column("weight").to_numpy()
            out = []
            for cell in set(cells) & shared.value.keys():
                at = np.flatnonzero(cells == cell)
                x = unit(_vectors(b.column("vector").take(pa.array(at)), kind))
                for node, v in shared.value[cell]:
                    out.append((node, int(weight[at][(x @ v >= threshold) & (ids[at] != node)].sum())))
            yield pa.RecordBatch.from_pylist([{"a": a, "n": n} for a, n in out], pa.schema([("a", pa.int64()), ("n", pa.int64())]))

    true = {r.a: r.n for r in nodes.mapInArrow(compare, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).collect()}
    ids = nodes.sparkSession.createDataFrame([(r.node,) for r in drawn], "a long")
    got = {r.a: r.n for r in found.where("b is null").join(F.broadcast(ids), "a", "left_semi").groupBy("a").agg(F.sum("n").alias("n")).collect()}
    total = sum(true.values())
    return (sum(min(got.get(a, 0), n) for a, n in true.items()) / total if total else 1.0), total


def near_duplicates(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, s: Search = Search()) -> DataFrame:
    """(id, n_links, component_id, kept) of every row with an id; other columns are dropped, whatever their names.

    Only vectors of one label and length are compared.  A null label, and a vector that is null, empty, zero or holds
    null or non-finite components, links with nothing.  Equal vectors of a label link with one another; rows that
    repeat an id are vectors of their own and link by their vectors; rows without an id are left out; an empty table
    gives no rows.  Every pair that is found counts for both of its vectors.
    """
    single = df.schema[vector].dataType.elementType == T.FloatType()
    kind = "<f4" if single else "<f8"
    values = F.col(vector) if single else F.col(vector).cast("array<double>")
    base = df.select(F.col(id).cast("long").alias("id"), F.col(label).alias("label"), values.alias("v")).where("id is not null")
    good = F.col("label").isNotNull() & usable("v")

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            numbers, ends = v.values.to_numpy() + 0.0, v.offsets.to_numpy()  # no negative zeros
            raw = [numbers[ends[k] : ends[k + 1]].astype(kind).tobytes() for k in range(len(v))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("cell"), pa.array(raw, pa.binary())], ["id", "cell", "vector"])

    cell = F.concat_ws("|", F.col("label").cast("string"), F.size("v").cast("string"))
    rows = base.where(good).select("id", cell.alias("cell"), "v").mapInArrow(flat, "id long, cell string, vector binary")
    rows = written(rows.withColumn("digest", F.sha2(F.concat(F.encode("cell", "utf-8"), F.lit(b"|"), F.col("vector")), 256)), "vectors")

    def coarse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [unit(np.frombuffer(v, kind)[None, :].astype(np.float64))[0].astype("<f2").tobytes() for v in b.column("vector").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(raw, pa.binary())], [*b.schema.names, "coarse"])

    # nodes are told apart by a number of their own: ids may repeat
    classes = rows.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("weight"), F.first("cell").alias("cell"), F.first("vector").alias("vector"))
    classes = classes.select("digest", "least", "weight", "cell", "vector", F.monotonically_increasing_id().alias("node"))
    nodes = written(classes.mapInArrow(coarse, "digest string, least long, weight long, cell string, vector binary, node long, coarse binary"), "graph")
    bare = nodes.select("cell", "node", "weight", "vector", "coarse")
    for _ in range(3):
        found = written(links(bare, threshold, s, kind), "links")
        recall, total = audit(bare, found, threshold, s.audit_rows, kind)
        if recall >= s.least_recall:
            break
        s = replace(s, overlap=s.overlap + 2, beam=s.beam * 2, degree=s.degree + 8, pool=s.pool + 16)
    else:
        every = bare.select("cell", "node", "weight", "vector", F.col("cell").alias("homes"), F.array("cell").alias("cells"))
        found = written(exact_links(every, threshold, s.block_rows, kind), "links")
    joined = connected_components(found.where("b is not null").select("a", "b"))
    roots = written(nodes.select("digest", "node", "weight", "least").join(joined, "node", "left").withColumn("root", F.coalesce("component", "node")), "roots")
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    counted = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    result = roots.join(least, "root").join(counted, "node", "left").select("digest", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = rows.select("id", "digest").join(result, "digest").select("id", "n_links", "component_id")
    alone = base.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
