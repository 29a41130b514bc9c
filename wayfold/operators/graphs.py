"""Graphs as edge tables: canonical form, distances, structure.

edges has (graph_id, src, dst) with nodes 0 .. n-1; every join and aggregation
has graph_id among its keys, so many graphs spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold._tables import written
from wayfold.shipping import ship


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Undirected simple edges, the smaller end first."""
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    return edges.where("src <> dst").select("graph_id", low.alias("src"), high.alias("dst")).distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """(graph_id, node, neighbour), each edge both ways."""
    return edges.select("graph_id", F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("neighbour")), F.struct(F.col("dst").alias("node"), F.col("src").alias("neighbour")))).alias("e")).select("graph_id", "e.*")


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("graph_id", "node").agg(F.count("*").alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles at each node: wedges of the smallest node, closed by an edge."""
    a, b, c = edges.alias("a"), edges.alias("b"), edges.alias("c")
    same = lambda x, y: F.col(f"{x}.graph_id") == F.col(f"{y}.graph_id")
    closed = (
        a.join(b, same("a", "b") & (F.col("a.src") == F.col("b.src")) & (F.col("a.dst") < F.col("b.dst")))
        .join(c, same("a", "c") & (F.col("a.dst") == F.col("c.src")) & (F.col("b.dst") == F.col("c.dst")))
        .select("a.graph_id", F.explode(F.array("a.src", "a.dst", "b.dst")).alias("node"))
    )
    return closed.groupBy("graph_id", "node").agg(F.count("*").alias("triangles"))


def clustering(edges: DataFrame) -> DataFrame:
    """Local clustering coefficient of every node; 0 under degree two."""
    d = F.col("degree")
    local = F.when(d >= 2, 2.0 * F.coalesce("triangles", F.lit(0)) / (d * (d - 1))).otherwise(0.0)
    return degrees(edges).join(triangles(edges), ["graph_id", "node"], "left").select("graph_id", "node", "degree", local.alias("clustering"))


def bfs(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(graph_id, source, node, d) from the sources by joined frontiers; each level is written, so lineage stays short."""
    near = written(adjacency(edges), "adjacency")
    frontier = written(sources.select("graph_id", "source", F.col("source").alias("node"), F.lit(0).alias("d")).distinct(), "frontier")
    seen = frontier
    level = 0
    while (most is None or level < most) and frontier.limit(1).count():
        level += 1
        reached = frontier.join(near, ["graph_id", "node"]).select("graph_id", "source", F.col("neighbour").alias("node")).distinct()
        frontier = written(reached.join(seen, ["graph_id", "source", "node"], "left_anti").withColumn("d", F.lit(level)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def distances_of(n: int, src: np.ndarray, dst: np.ndarray) -> np.ndarray:
    """All-pairs hop counts by frontier products; -1 where there is no path."""
    near = np.zeros((n, n), np.float32)
    near[src, dst] = near[dst, src] = 1
    out = np.full((n, n), -1, np.int32)
    frontier = np.eye(n, dtype=bool)
    level = 0
    while frontier.any():
        out[frontier] = level
        frontier = ((frontier.astype(np.float32) @ near) > 0) & (out < 0)
        level += 1
    return out


def all_pairs(edges: DataFrame) -> DataFrame:
    """(graph_id, u, v, d) of every ordered pair with a path, a task for each graph of up to some thousand nodes."""
    ship(edges.sparkSession)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        n = int(max(group.src.max(), group.dst.max())) + 1
        d = distances_of(n, group.src.to_numpy(), group.dst.to_numpy())
        u, v = np.nonzero(d >= 0)
        return pd.DataFrame({"graph_id": group.graph_id.iloc[0], "u": u.astype(np.int64), "v": v.astype(np.int64), "d": d[u, v]})

    return edges.groupBy("graph_id").applyInPandas(run, "graph_id string, u long, v long, d int")


def neighbour_lists(n: int, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's neighbours begin (with the end), and all neighbours one after the other."""
    a, b = np.concatenate([src, dst]), np.concatenate([dst, src])
    order = np.argsort(a, kind="stable")
    return np.searchsorted(a[order], np.arange(n + 1)), b[order]


def bits_reached(first: np.ndarray, near: np.ndarray, sources: np.ndarray, wanted: list[tuple[int, int]]) -> list[int]:
    """Hops of (source's place, destination) pairs, -1 without a path: 64 sources are the bits of one number for each node of neighbour_lists."""
    n, words = len(first) - 1, -(-len(sources) // 64)
    seen = np.zeros((n, words), np.uint64)
    k = np.arange(len(sources))
    np.bitwise_or.at(seen, (sources, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
    at, to = (np.array(w, np.int64) for w in zip(*wanted, strict=True))
    word, bit = at // 64, np.uint64(1) << (at % 64).astype(np.uint64)
    out = np.where(sources[at] == to, 0, -1)
    held, new, level = np.flatnonzero(np.diff(first)), seen.copy(), 0
    while held.size and (open_ := np.flatnonzero(out < 0)).size:
        level += 1
        reached = np.zeros_like(seen)
        reached[held] = np.bitwise_or.reduceat(new[near], first[held], axis=0)
        new = reached & ~seen
        if not new.any():
            break
        seen |= new
        out[open_[(new[to[open_], word[open_]] & bit[open_]) != 0]] = level
    return out.tolist()


class Search:
    """Bit-parallel searches over the lists of neighbour_lists.

    Nodes are held in order of falling degree, so that every node's k-th neighbour is
    one gather and the nodes that have one are a slice.  Hop counts are kept as bits in
    planes and become numbers at the end.
    """

    #: Neighbours of a node that are gathered by column; a hub's others follow by themselves.
    HUB = 64

    def __init__(self, first: np.ndarray, near: np.ndarray) -> None:
        many = np.diff(first)
        self.n = len(many)
        self.order = np.argsort(-many, kind="stable")
        self.place = np.empty(self.n, np.int64)
        self.place[self.order] = np.arange(self.n)
        many, at, to = many[self.order], first[:-1][self.order], self.place[near]
        have = [int((many > k).sum()) for k in range(min(self.HUB, int(many.max(initial=0))))]
        self.columns = [to[at[:c] + k] for k, c in enumerate(have)]
        self.rest = [to[a + self.HUB : a + m] for a, m in zip(at, many) if m > self.HUB]

    def planes(self, sources: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(seen, bits of the hop counts from the lowest) by node in self.order, a source for each bit of a row."""
        k = np.arange(len(sources))
        seen = np.zeros((self.n, -(-len(sources) // 64)), np.uint64)
        np.bitwise_or.at(seen, (self.place[sources], k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
        new, level, planes = seen, 0, [np.zeros_like(seen)]
        while True:
            level += 1
            reached = np.zeros_like(seen)
            for c in self.columns:
                reached[: len(c)] |= new.take(c, axis=0)
            for j, c in enumerate(self.rest):
                reached[j] |= np.bitwise_or.reduce(new.take(c, axis=0), axis=0)
            reached &= ~seen
            if not reached.any():
                return seen, planes
            new = reached
            seen = seen | new
            planes += [np.zeros_like(seen) for _ in range(level.bit_length() - len(planes))]
            for b, p in enumerate(planes):
                if level >> b & 1:
                    p |= new

    def columns_of(self, sources: np.ndarray) -> np.ndarray:
        """Hops from each source (a column) to every node (a row), -1 without a path, in the smallest signed type that holds them."""
        seen, planes = self.planes(sources)
        kind = np.dtype(np.int8 if len(planes) < 8 else np.int16 if len(planes) < 16 else np.int32)
        out, whole = np.empty((self.n, 64 * seen.shape[1]), kind), bool((seen == ~np.uint64(0)).all())
        bits = lambda p: np.unpackbits(p.view(np.uint8), axis=1, bitorder="little").view(np.int8).astype(kind, copy=False)
        step = max(1, (1 << 16) // out.shape[1])
        for low in range(0, self.n, step):
            some = slice(low, low + step)
            d = bits(planes[0][some])
            for k, p in enumerate(planes[1:], 1):
                d |= bits(p[some]) << kind.type(k)
            if not whole:
                d[bits(seen[some]) == 0] = -1
            out[self.order[some]] = d
        return out[:, : len(sources)]


def hop_rows(first: np.ndarray, near: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Hops from each source (a row) to every node of neighbour_lists, -1 without a path."""
    return np.ascontiguousarray(Search(first, near).columns_of(sources).T, np.int16 if len(first) - 1 < 1 << 15 else np.int32)


def level_counts(first: np.ndarray, near: np.ndarray, sources: np.ndarray) -> list[int]:
    """How many nodes the sources reach in one hop, two, ..., each source counted for itself."""
    n, k = len(first) - 1, np.arange(len(sources))
    seen = np.zeros((n, -(-len(sources) // 64)), np.uint64)
    np.bitwise_or.at(seen, (sources, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
    held, new, out = np.flatnonzero(np.diff(first)), seen.copy(), []
    while held.size:
        reached = np.zeros_like(seen)
        reached[held] = np.bitwise_or.reduceat(new[near], first[held], axis=0)
        new = reached & ~seen
        if not new.any():
            break
        seen |= new
        out.append(int(np.bitwise_count(new).sum()))
    return out


def distance_counts(edges: DataFrame, together: int = 512) -> DataFrame:
    """(graph_id, d, pairs): unordered pairs at each distance, by bit-parallel searches from all nodes, so many at once in each task."""
    ship(edges.sparkSession)
    ends = edges.groupBy("graph_id").agg(F.collect_list("src").alias("src"), F.collect_list("dst").alias("dst"), F.greatest(F.max("src"), F.max("dst")).alias("last"))
    parts = ends.withColumn("part", F.explode(F.expr(f"sequence(0L, last div {together})"))).repartition("graph_id", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch.itertuples():
                n = int(g.last) + 1
                lists = neighbour_lists(n, np.asarray(g.src, np.int64), np.asarray(g.dst, np.int64))
                counts = level_counts(*lists, np.arange(g.part * together, min(n, (g.part + 1) * together)))
                yield pd.DataFrame({"graph_id": g.graph_id, "d": range(1, len(counts) + 1), "reached": counts})

    found = parts.mapInPandas(run, "graph_id string, d int, reached long")
    return found.groupBy("graph_id", "d").agg((F.sum("reached") / 2).cast("long").alias("pairs"))


def pair_lengths(edges: DataFrame, pairs: DataFrame, together: int = 1024) -> DataFrame:
    """(graph_id, pair_index, source, destination, shortest): hops of each pair, null without a path or where a node has no edge.

    A bit-parallel search from up to that many sources of a graph at once in each
    task, which ends when all its pairs are reached; no table of n^2 rows.
    """
    spark = pairs.sparkSession
    ship(spark)
    ends = edges.groupBy("graph_id").agg(F.collect_list("src").alias("src"), F.collect_list("dst").alias("dst"))
    rank = F.dense_rank().over(Window.partitionBy("graph_id").orderBy("source"))
    parts = pairs.withColumn("part", F.floor((rank - 1) / together)).groupBy("graph_id", "part").agg(F.sort_array(F.collect_list(F.struct("pair_index", "source", "destination"))).alias("p"))
    some = parts.select("graph_id", "part", F.col("p.pair_index").alias("pair_index"), F.col("p.source").alias("source"), F.col("p.destination").alias("destination"))
    schema = f"graph_id string, pair_index {pairs.schema['pair_index'].dataType.simpleString()}, source long, destination long, shortest int"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch.itertuples():
                source, destination = np.array(g.source, np.int64), np.array(g.destination, np.int64)
                src, dst = (np.array([] if e is None else e, np.int64) for e in (g.src, g.dst))
                n = int(max(source.max(), destination.max(), src.max(initial=0), dst.max(initial=0))) + 1
                sources, place = np.unique(source, return_inverse=True)
                hops = bits_reached(*neighbour_lists(n, src, dst), sources, list(zip(place.tolist(), destination.tolist(), strict=True)))
                yield pd.DataFrame({"graph_id": g.graph_id, "pair_index": g.pair_index, "source": source, "destination": destination, "shortest": pd.array([h if h >= 0 else None for h in hops], "Int32")})

    return some.join(ends, "graph_id", "left").repartition("graph_id", "part").drop("part").mapInPandas(run, schema)


def single_searches(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(graph_id, u, v, d) of the wanted pairs that have a path: one plain search for each source, so nothing is shared with pair_lengths' words of sources.

    pairs: graph_id, source, destination.  A task holds a graph's neighbours and some sources with their destinations.
    """
    spark = pairs.sparkSession
    ship(spark)
    ends = edges.groupBy("graph_id").agg(F.collect_list("src").alias("src"), F.collect_list("dst").alias("dst"))
    wanted = pairs.select("graph_id", "source", "destination").distinct().withColumn("part", F.pmod("source", F.lit(64)))
    some = wanted.groupBy("graph_id", "part").agg(F.sort_array(F.collect_list(F.struct("source", "destination"))).alias("p")).select("graph_id", "part", F.col("p.source").alias("source"), F.col("p.destination").alias("destination"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch.itertuples():
                out: list[tuple] = []
                src, dst = np.asarray(g.src, np.int64), np.asarray(g.dst, np.int64)
                n = int(max(src.max(), dst.max())) + 1
                first, near = neighbour_lists(n, src, dst)
                source, destination = np.asarray(g.source, np.int64), np.asarray(g.destination, np.int64)
                for s in np.unique(source[source < n]):  # the distance table has the nodes of edges alone
                    goals = destination[(source == s) & (destination < n)]
                    d = np.full(n, -1, np.int32)
                    d[s], frontier, level = 0, np.array([s]), 0
                    while frontier.size and (d[goals] < 0).any():
                        level += 1
                        many = first[frontier + 1] - first[frontier]
                        reached = near[np.repeat(first[frontier] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                        d[reached[d[reached] < 0]] = level
                        frontier = np.flatnonzero(d == level)
                    goals = goals[d[goals] >= 0]
                    out += zip([g.graph_id] * len(goals), [int(s)] * len(goals), goals.tolist(), d[goals].tolist())
                yield pd.DataFrame(out, columns=["graph_id", "u", "v", "d"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return some.join(ends, "graph_id").repartition(parts, "graph_id", "part").drop("part").mapInPandas(run, "graph_id string, u long, v long, d int")


def network_metrics(edges: DataFrame) -> DataFrame:
    """n, m, mean and largest degree, population variance, clustering, diameter, mean distance."""
    nodes = clustering(edges).groupBy("graph_id").agg(
        F.count("*").alias("n"), (F.sum("degree") / 2).cast("long").alias("m"), F.avg("degree").alias("average_degree"), F.max("degree").alias("maximum_degree"),
        F.var_pop("degree").alias("population_degree_variance"), F.avg("clustering").alias("average_clustering_coefficient"))
    paths = distance_counts(edges).groupBy("graph_id").agg(F.max("d").alias("diameter"), (F.sum(F.col("d") * F.col("pairs")) / F.sum("pairs")).alias("average_shortest_path_length"))
    return nodes.join(paths, "graph_id")


def is_connected(edges: DataFrame) -> DataFrame:
    """(graph_id, connected): whether all nodes are reached from node 0."""
    all_nodes = degrees(edges).groupBy("graph_id").agg(F.count("*").alias("n"))
    reached = bfs(edges, edges.select("graph_id", F.lit(0).cast("long").alias("source")).distinct()).groupBy("graph_id").agg(F.countDistinct("node").alias("reached"))
    return all_nodes.join(reached, "graph_id").select("graph_id", (F.col("n") == F.col("reached")).alias("connected"))


def coincidences(coords: DataFrame) -> DataFrame:
    """Groups of nodes with exactly equal coordinates."""
    return coords.groupBy("graph_id", "condition_id", "x", "y").agg(F.sort_array(F.collect_list("node")).alias("nodes")).where(F.size("nodes") > 1)


def erdos_renyi(n: int, p: float, seed: int, most: int = 50) -> tuple[np.ndarray, int]:
    """Edges of a connected G(n, p), and the attempt that was connected; never a part of a graph."""
    for attempt in range(most):
        rng = np.random.default_rng([seed, attempt])
        ends = [np.flatnonzero(rng.random(n - u - 1) < p) + u + 1 for u in range(n - 1)]
        edges = np.column_stack([np.repeat(np.arange(n - 1), [len(v) for v in ends]), np.concatenate([np.zeros(0, np.int64), *ends])])
        if len(edges) and min(bits_reached(*neighbour_lists(n, edges[:, 0], edges[:, 1]), np.zeros(1, np.int64), [(0, k) for k in range(n)])) >= 0:
            return edges, attempt
    raise ValueError("no connected graph within the attempts")


def barabasi_albert(n: int, m: int, seed: int) -> np.ndarray:
    """A star of m + 1 nodes, then m edges from each new node, by preference: m (n - m) edges."""
    rng = np.random.default_rng(seed)
    edges = [(0, k) for k in range(1, m + 1)]
    ends = [e for pair in edges for e in pair]
    for node in range(m + 1, n):
        chosen: set[int] = set()
        while len(chosen) < m:
            chosen.add(int(ends[rng.integers(len(ends))]))
        for t in sorted(chosen):
            edges.append((t, node))
            ends += [t, node]
    return np.array(edges)


def generate(graphs: DataFrame) -> DataFrame:
    """(graph_id, src, dst, attempt) from (graph_id, model, n, m, seed); 'erdos_renyi' takes the p that matches the other model's degree."""
    ship(graphs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch.itertuples():
                attempt = 0
                if g.model == "erdos_renyi":
                    edges, attempt = erdos_renyi(g.n, 2 * g.m * (g.n - g.m) / (g.n * (g.n - 1)), g.seed)
                else:
                    edges = barabasi_albert(g.n, g.m, g.seed)
                yield pd.DataFrame({"graph_id": g.graph_id, "src": edges.min(axis=1).astype(np.int64), "dst": edges.max(axis=1).astype(np.int64), "attempt": attempt})

    # a given number, as small rows that grow into graphs would be coalesced into one task
    parts = int(graphs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return graphs.repartition(parts, "graph_id").mapInPandas(run, "graph_id string, src long, dst long, attempt int")


def midrank(value: str, *by: str):
    """Mean rank of equal values within a partition."""
    same = Window.partitionBy(*by, value)
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(same) - 1) / 2.0
