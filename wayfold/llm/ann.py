"""Approximate nearest neighbours with a forest of random-projection trees.

Trees are fitted on a bounded sample and sent to the workers; every row goes to
its leaf in each tree.  A query searches all trees through one priority queue of
margins and takes the leaves that come first.  Blocks of queries go to the workers
with the leaves that each searches; rows stream past them, ordered by leaf, and a
task keeps each query's nearest by exact cosines in double precision.  A vector is
written once for all trees, and a task returns at most k rows for a query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm._base import dropped, in_arrow, written

#: Rows that fit the trees, those of the smallest hashes; trees; rows aimed at in a leaf, a hundredth of all at most; least sampled rows in a leaf.
SAMPLE_ROWS, TREES, LEAF_ROWS, LEAF_SAMPLE = 60_000, 12, 160, 8
#: Leaves searched for a query over all trees: so many at least, and this share of all leaves.
PROBES, PROBE_SHARE = 80, 1 / 14
#: Queries that meet the rows in one pass at most, fewer where their vectors and leaf bits pass these bytes; rows compared at once.
QUERY_ROWS, QUERY_BYTES, MEET_ROWS = 4096, 64 << 20, 512
#: Tasks of a pass over the rows at most, where the cluster has no more cores: each returns its own nearest.
PARTS = 16
#: Found pairs that a task holds before it keeps the best; bytes of vectors that exact cosines take at once.
HELD_PAIRS, EXACT_BYTES = 200_000, 16 << 20


@dataclass
class Forest:
    """Inner nodes of all trees; a child below 0 is leaf ~child, leaves numbered over all trees."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    leaves: int

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree: array [row, tree]."""
        out = np.empty((len(x), len(self.roots)), np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root, np.int64)
            while (live := np.flatnonzero(node >= 0)).size:
                at = node[live]
                side = np.einsum("ij,ij->i", x[live], self.normals[at]) > self.offsets[at]
                node[live] = self.children[at, side.astype(int)]
            out[:, t] = ~node
        return out

    def search(self, x: np.ndarray, probes: int) -> list[list[int]]:
        """The first leaves of each query from a priority queue shared by all trees."""
        margins = x @ self.normals.T - self.offsets if len(self.normals) else np.zeros((len(x), 0))
        out = []
        for row in margins:
            row, queue, found = row.tolist(), [(-np.inf, int(r)) for r in self.roots], []
            heapq.heapify(queue)
            while queue and len(found) < probes:
                bound, node = heapq.heappop(queue)
                if node < 0:
                    found.append(~node)
                    continue
                m = row[node]
                left, right = self.children[node]
                heapq.heappush(queue, (max(bound, m), int(left)))
                heapq.heappush(queue, (max(bound, -m), int(right)))
            out.append(found)
        return out


def grow(sample: np.ndarray, trees: int, leaf_rows: int, seed: int = 1) -> Forest:
    """Splits by the middle of the projections on the difference of two random rows."""
    rng = np.random.default_rng(seed)
    normals, offsets, children, roots, leaves = [], [], [], [], 0

    def split(rows: np.ndarray, depth: int) -> int:
        nonlocal leaves
        if len(rows) > leaf_rows and depth < 40:
            for _ in range(5):
                a, b = sample[rng.choice(rows, 2, replace=False)]
                normal = (a - b) if np.abs(a - b).max() > 1e-12 else rng.normal(size=sample.shape[1])
                normal = normal / np.linalg.norm(normal)
                along = sample[rows] @ normal
                middle = float(np.median(along))
                side = along > middle
                if 0 < side.sum() < len(rows):
                    at = len(normals)
                    normals.append(normal)
                    offsets.append(middle)
                    children.append([0, 0])
                    children[at] = [split(rows[~side], depth + 1), split(rows[side], depth + 1)]
                    return at
        leaves += 1
        return ~(leaves - 1)

    for _ in range(trees):
        roots.append(split(np.arange(len(sample)), 0))
    width = sample.shape[1]
    return Forest(np.array(normals).reshape(-1, width), np.array(offsets, float), np.array(children, np.int64).reshape(-1, 2), np.array(roots), leaves)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest component to between 0.5 and 1: no product over- or underflows, no cosine changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def matrix(column: pa.Array) -> np.ndarray:
    """Binary rows of doubles as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def flat(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def binary(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    return pa.array([r.tobytes() for r in x], pa.binary())


def fit(rows: DataFrame) -> tuple[Forest | None, int]:
    """A forest from at most about SAMPLE_ROWS rows of (id, v), and how many rows there are."""
    n = rows.count()
    if not n:
        return None, 0

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([binary(flat(batch.column(0)))], names=["v"])

    share = min(1.0, SAMPLE_ROWS / n)
    picked = rows.where(F.crc32(F.concat(F.lit("sample"), F.col("id").cast("string"))) <= int(share * 0xFFFFFFFF))
    sample = in_arrow(picked.select("v"), packed, "v binary").limit(SAMPLE_ROWS + SAMPLE_ROWS // 4).collect()  # a repeated id may be drawn with all its rows
    sample = sample or in_arrow(rows.select("v").limit(1), packed, "v binary").collect()
    x = unit(np.frombuffer(b"".join(bytes(r.v) for r in sample), np.float64).reshape(len(sample), -1))
    return grow(x, TREES, max(LEAF_SAMPLE, round(min(LEAF_ROWS, n / 100) * len(x) / n))), n


def best_of(q: np.ndarray, near: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each q its k best pairs (q, near, score), ordered; of pairs with the same ids the best, ties to the smaller near."""
    order = np.lexsort((-score, near, q))
    q, near, score = q[order], near[order], score[order]
    first = np.r_[True, (q[1:] != q[:-1]) | (near[1:] != near[:-1])][: len(q)]
    q, near, score = q[first], near[first], score[first]
    order = np.lexsort((near, -score, q))
    q, near, score = q[order], near[order], score[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], near[place < k], score[place < k]


class Block:
    """Queries with the leaves that each searches, and what was found for them so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaves: np.ndarray, k: int):
        """leaves: for each leaf the bits of the queries that search it."""
        self.ids, self.leaves, self.k = ids, leaves, k
        self.x, self.unit = scaled(vectors), unit(vectors)
        self.length = np.sqrt((self.x * self.x).sum(axis=1))
        self.floor = np.full(len(ids), -np.inf)
        self.held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.pairs = self.compared = 0

    def meet(self, ids: np.ndarray, leaf: np.ndarray, vectors: np.ndarray) -> None:
        """Compares rows with the queries that search one of their leaves in any tree."""
        bits = np.bitwise_or.reduce(self.leaves[leaf], axis=1)
        asked = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(bits, axis=0), count=len(self.ids)))
        rows = np.flatnonzero(bits.any(axis=1))
        if not len(rows):
            return
        rows = rows[np.argsort(ids[rows], kind="stable")]
        ids, x = ids[rows], scaled(vectors[rows])
        length = np.sqrt((x * x).sum(axis=1))
        candidate = np.unpackbits(bits[rows], axis=1, count=len(self.ids)).T[asked].astype(bool)
        self.compared += int(candidate.sum())
        near = np.where(candidate, self.unit[asked] @ (x / length[:, None]).T, -np.inf)
        for c in np.flatnonzero(np.isin(ids, self.ids)):
            near[self.ids[asked] == ids[c], c] = -np.inf
        floor = self.floor[asked]
        many = np.flatnonzero(((near >= floor[:, None]) & (near > -np.inf)).sum(axis=1) > self.k)
        if len(many):  # the k-th nearest id of these rows bounds what can be among the nearest; rows of one id stand together
            top = np.maximum.reduceat(near[many], np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]), axis=1)
            if top.shape[1] > self.k:
                floor[many] = np.maximum(floor[many], np.partition(top, -self.k, axis=1)[:, -self.k] - 1e-9)
        r, c = np.nonzero((near >= floor[:, None]) & (near > -np.inf))
        step = max(1, EXACT_BYTES // (8 * x.shape[1]))
        for at in range(0, len(r), step):
            q, y = asked[r[at : at + step]], c[at : at + step]
            score = (self.x[q] * x[y]).sum(axis=1) / (self.length[q] * length[y])  # one sum for each pair: equal rows get equal scores
            self.held.append((q, ids[y], score))
            self.pairs += len(q)
            if self.pairs > HELD_PAIRS:
                self.settle()
        if not np.isfinite(self.floor).any():
            self.settle()

    def settle(self) -> None:
        """Keeps the k best of each query; the last of them is its floor."""
        q, near, score = best_of(*(np.concatenate(x) for x in zip(*self.held, strict=True)), self.k)
        self.held, self.pairs = [(q, near, score)], 0
        full = np.flatnonzero(np.bincount(q, minlength=len(self.ids)) == self.k)
        self.floor[full] = score[np.searchsorted(q, full, side="right") - 1] - 1e-9


def nearest(table: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, probes: int = PROBES, probe_share: float = PROBE_SHARE) -> DataFrame:
    """query_id, rank (from 1), id_col, score: the k nearest found for every row that is_query holds for.

    Ties go to the smaller id.  Vectors that are null, empty, zero or hold null
    or non-finite components and rows without an id take no part.  Vectors of each
    length are searched among their own kind, one forest for each.  Rows that share a
    query's id are the query's own; of other rows that share an id the nearest counts.
    An empty table gives no rows; other columns aren't read.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>")
    sound = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size(v) > 0) & sound)
    lengths = sorted(r.n for r in rows.select(F.size("v").alias("n")).distinct().collect())
    found = [x for n in lengths for x in _of_length(rows.where(F.size("v") == n), is_query, k, probes, probe_share)]
    if not found:
        return table.sparkSession.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    once = reduce(DataFrame.union, found).groupBy("query_id", "near").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "near"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("near").alias(id_col), "score")


def by_leaf(searched: list[bytes], leaves: int) -> np.ndarray:
    """For each leaf the bits of the queries that search it, from the bits of the leaves that each query searches."""
    parts = []
    for some in batched(searched, 512):
        bits = np.frombuffer(b"".join(some), np.uint8).reshape(len(some), -1)
        parts.append(np.packbits(np.unpackbits(bits, axis=1, count=leaves), axis=0))
    return np.ascontiguousarray(np.concatenate(parts).T)


def _of_length(rows: DataFrame, is_query, k: int, probes: int, probe_share: float) -> Iterator[DataFrame]:
    """(query_id, near, score) found among the sound rows (id, v) of one length, a table for each block of queries."""
    forest, n = fit(rows)
    if forest is None:
        return
    probes = max(probes, round(probe_share * forest.leaves))
    context = rows.sparkSession.sparkContext
    shared = context.broadcast(forest)  # bounded by SAMPLE_ROWS and TREES

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = flat(part.column(1))
                leaf = shared.value.leaf_of(unit(x)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.FixedSizeListArray.from_arrays(leaf.ravel(), leaf.shape[1]).cast(pa.list_(pa.int32())), binary(x)], names=["id", "leaf", "v"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, (32 << 20) // (8 * len(shared.value.normals) + 8))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                bits = np.zeros((part.num_rows, shared.value.leaves), np.uint8)
                for r, found in enumerate(shared.value.search(unit(matrix(part.column(1))), probes)):
                    bits[r, found] = 1
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), binary(np.packbits(bits, axis=1))], names=["id", "v", "leaves"])

    leafed = written(in_arrow(rows, placed, "id long, leaf array<int>, v binary").sortWithinPartitions(F.col("leaf")[0]), "leaves")
    alone = leafed.where(is_query(F.col("id"))).select("id", "v").dropDuplicates()
    asked = written(in_arrow(alone, searched, "id long, v binary, leaves binary"), "queries")
    first = asked.first()
    size = min(QUERY_ROWS, max(64, QUERY_BYTES // (len(first.v) + len(first.leaves)))) if first else 1
    parts = leafed.coalesce(max(PARTS, context.defaultParallelism))

    def met(block) -> DataFrame:
        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = Block(*block.value, k)
            for batch in batches:
                for at in range(0, batch.num_rows, MEET_ROWS):
                    part = batch.slice(at, MEET_ROWS)
                    mine.meet(part.column(0).to_numpy(), flat(part.column(1)), matrix(part.column(2)))
            mine.settle()
            q, near, score = mine.held[0]
            yield pa.RecordBatch.from_arrays([pa.array(mine.ids[q]), pa.array(near), pa.array(score)], names=["query_id", "near", "score"])

        return written(in_arrow(parts, meet, "query_id long, near long, score double"), "near")

    for some in batched(asked.toLocalIterator(), size):  # at most QUERY_BYTES on the driver and in each worker
        vectors = np.frombuffer(b"".join(bytes(r.v) for r in some), np.float64).reshape(len(some), -1)
        block = context.broadcast((np.array([r.id for r in some], np.int64), vectors, by_leaf([bytes(r.leaves) for r in some], forest.leaves)))
        yield met(block)
        block.unpersist()
    dropped(leafed, asked)
