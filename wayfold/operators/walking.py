"""Routes walked one by one, for whole jobs: distances only where a walk comes, ties of the second protocol by keyed digest.

A graph's adjacency and one condition's coordinates go to a task with some of
the graph's pairs, so work grows with the walks and not with nodes times
destinations.  Every move makes strict progress, so a walk ends without a limit.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from hashlib import blake2s

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.sampling import canonical, digest_number
from wayfold.shipping import ship

VERSION, MASTER = "iteration2_keyed_blake2s_priority_v1", 15_000_017
PLAIN = "graph_id string, pair_index int, source long, destination long, condition_id string, metric string, walk array<long>, hops int, decisions int, success boolean, failure string"
REPAIR = "r_walk array<long>, r_decisions int, backtrackable boolean, attempted boolean, alternative_existed boolean, final_failure string"
Rank = Callable[[int, int], bytes]


def priority_key(graph_id: str, data_hash: str) -> bytes:
    """Key of a graph's ties; data_hash is the frozen identity of the data."""
    seed = digest_number({"identity_hash": data_hash, "seed_identity_version": 2, "domain": "routing_priority", "master": MASTER, "identity": graph_id}, b"GRP2seed")
    return blake2s(canonical({"version": VERSION, "data_generation_hash": data_hash, "graph_id": graph_id, "routing_priority_seed": seed}), digest_size=32, person=b"I2keyV1").digest()


def priority(key: bytes, graph_id: str, pair_index: int, source: int, destination: int) -> Rank:
    """The digest of (current, candidate) for one pair; the smallest wins a tie."""
    own = {"version": VERSION, "graph_id": graph_id, "pair_index": pair_index, "source": source, "destination": destination}
    return lambda current, candidate: blake2s(canonical({**own, "current": current, "candidate": candidate}), key=key, digest_size=32, person=b"I2tieV1").digest()


def distance_of(metric: str, a: tuple[float, float], b: tuple[float, float]) -> float:
    """As geometry.distance."""
    e = math.hypot(a[0] - b[0], a[1] - b[1])
    if metric == "euclidean":
        return e
    ra, rb = math.hypot(*a), math.hypot(*b)
    if ra >= 1 or rb >= 1:
        raise ValueError("a point outside the open disk")
    z = e / (math.sqrt((1 - ra) * (1 + ra)) * math.sqrt((1 - rb) * (1 + rb)))
    return 2 * math.log1p(z + z * z / (1 + math.sqrt(1 + z * z)))


def walk_on(walk: list[int], target: int, near: dict, d: Callable[[int], float], tolerance: float, protocol: str, rank: Rank) -> tuple[str | None, int]:
    """Extends walk; its failure and the decisions taken."""
    seen, count = set(walk), 0
    while walk[-1] != target:
        at = walk[-1]
        if protocol == "i2" and target in near[at]:
            best = target
        else:
            here, options = d(at), [(d(k), k) for k in near[at]]
            low = min(options)[0]
            if protocol == "i1":
                count += 1
                best, d_best = min((k, x) for x, k in options if x <= low + tolerance)
                if best in seen:
                    return "attempted_revisit", count
                if not d_best < here - tolerance:
                    return "local_minimum", count
            else:
                if not low < here - tolerance:
                    return "local_minimum", count
                tied = [k for x, k in options if x < here - tolerance and x <= low + tolerance]
                best = tied[0] if len(tied) == 1 else min(tied, key=lambda k: rank(at, k))
                if best in seen:
                    return "attempted_revisit", count
        count += protocol == "i2"
        walk.append(best)
        seen.add(best)
    return None, count


def repair(walk: list[int], failure: str | None, decisions: int, target: int, near: dict, d: Callable[[int], float], tolerance: float, protocol: str, rank: Rank) -> tuple:
    """The REPAIR columns: back one edge, the best unexplored alternative without a progress test, then on as before."""
    if failure is None:
        return walk, decisions, None, False, None, None
    if len(walk) < 2:
        return walk, decisions, False, False, False, "repair_unavailable_at_source"
    before = walk[-2]
    free = [(d(k), k) for k in near[before] if k not in walk]
    decisions += protocol == "i2"
    if not free:
        return [*walk, before], decisions, True, True, False, "no_alternative_after_backtracking"
    low = min(free)[0]
    tied = [k for x, k in free if x <= low + tolerance]
    if protocol == "i1":
        pick = min(tied)
    elif any(k == target for _, k in free):
        pick = target
    else:
        pick = tied[0] if len(tied) == 1 else min(tied, key=lambda k: rank(before, k))
    on = [*walk, before, pick]
    final, more = walk_on(on, target, near, d, tolerance, protocol, rank)
    return on, decisions + 1 + more, True, True, True, final and f"post_repair_{final}"


def walks(pairs: DataFrame, adjacent: DataFrame, coords: DataFrame, protocol: str = "i1", tolerance: float = 1e-12, data_hash: str = "", together: int = 100, smallest: bool = False) -> DataFrame:
    """Ordinary and repaired routes of pairs under every condition and both metrics: PLAIN and REPAIR, for ordinary() and repaired().

    coords may have a tolerance of their own for each condition and metric
    (euclidean_tolerance, poincare_tolerance); a metric whose tolerance is null isn't
    walked there.  With smallest, ties of the second protocol go to the smallest node in
    place of the keyed choice.
    """
    spark = pairs.sparkSession
    ship(spark)
    lists = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    near = adjacent.groupBy("graph_id").agg(lists("node", "neighbour").alias("e")).select("graph_id", F.col("e.node").alias("src"), F.col("e.neighbour").alias("dst"))
    limit = lambda m: F.first(f"{m}_tolerance") if f"{m}_tolerance" in coords.columns else F.lit(float(tolerance))
    place = coords.groupBy("graph_id", "condition_id").agg(lists("node", "x", "y").alias("c"), *[limit(m).alias(m) for m in ("euclidean", "poincare")])
    place = place.select("graph_id", "condition_id", F.col("c.node").alias("node"), F.col("c.x").alias("x"), F.col("c.y").alias("y"), "euclidean", "poincare")
    some = pairs.groupBy("graph_id", F.floor(F.col("pair_index") / together).alias("part")).agg(lists("pair_index", "source", "destination").alias("p"))
    some = some.select("graph_id", "part", F.col("p.pair_index").alias("pair_index"), F.col("p.source").alias("source"), F.col("p.destination").alias("destination"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch.itertuples():
                at = {int(k): (float(x), float(y)) for k, x, y in zip(g.node, g.x, g.y)}
                by: dict[int, list[int]] = {}
                for a, b in zip(g.src, g.dst):
                    by.setdefault(int(a), []).append(int(b))
                key, out = priority_key(g.graph_id, data_hash), []
                for k, s, t in zip(g.pair_index, g.source, g.destination):
                    k, s, t = int(k), int(s), int(t)
                    rank = (lambda at, k: k) if smallest else priority(key, g.graph_id, k, s, t)
                    for metric, tolerance in (("euclidean", g.euclidean), ("poincare", g.poincare)):
                        if tolerance is None or tolerance != tolerance:
                            continue
                        d, walk = (lambda v: distance_of(metric, at[v], at[t])), [s]
                        failure, count = walk_on(walk, t, by, d, tolerance, protocol, rank)
                        out.append((g.graph_id, k, s, t, g.condition_id, metric, walk, len(walk) - 1, count, failure is None, failure, *repair(walk, failure, count, t, by, d, tolerance, protocol, rank)))
                yield pd.DataFrame(out, columns=[f.split()[0] for f in f"{PLAIN}, {REPAIR}".split(", ")])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return some.join(near, "graph_id").join(place, "graph_id").repartition(parts, "graph_id", "condition_id", "part").drop("part").mapInPandas(run, f"{PLAIN}, {REPAIR}")


def ordinary(walked: DataFrame) -> DataFrame:
    return walked.select(*[f.split()[0] for f in PLAIN.split(", ")])


def repaired(walked: DataFrame) -> DataFrame:
    return walked.select(
        "graph_id", "pair_index", "source", "destination", "condition_id", "metric", F.col("r_walk").alias("walk"), (F.size("r_walk") - 1).alias("hops"), F.col("r_decisions").alias("decisions"),
        F.col("final_failure").isNull().alias("success"), "backtrackable", "attempted", "alternative_existed", F.col("failure").alias("initial_failure"), "final_failure")
