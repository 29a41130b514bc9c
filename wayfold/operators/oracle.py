"""Independent routes with certified comparisons, and the audit of walked routes by them.

A second state machine walks chosen pairs twice: in double precision by other
formulas of the distances, and certified.  Certified, a distance is a double with a
bound on its error; a comparison that the bounds don't decide is made again between
decimals of eighty digits, and one that these don't decide counts as open.  So
nearly all comparisons cost two doubles, and every decision is that of exact
arithmetic on the given coordinates and tolerance.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import Decimal, localcontext

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geometry import EPSILON
from wayfold.operators.identities import audit_indices, sentinel_indices
from wayfold.operators.walking import priority, priority_key
from wayfold.shipping import ship

#: Digits of the decimals, and the difference that they don't decide.
DIGITS, OPEN = 80, Decimal("1e-60")
#: Rounding errors that a distance's bound allows for.
ROUNDINGS = 16

Point = tuple[float, float]


class Plain:
    """Distances to a target in double precision, by formulas that the walks don't use."""

    def __init__(self, metric: str, at: dict[int, Point], target: int) -> None:
        self.metric, self.at, self.target, self.refined, self.open = metric, at, target, 0, 0

    def distance(self, node: int) -> float:
        u, v = complex(*self.at[node]), complex(*self.at[self.target])
        if self.metric == "euclidean":
            return abs(u - v)
        t = abs(u - v) / abs(1 - u.conjugate() * v)
        return math.log1p(2 * t / (1 - t))

    def below(self, a: int, b: int, shift: float = 0.0) -> bool:
        """Whether a is nearer than b's distance plus shift."""
        return self.distance(a) < self.distance(b) + shift


class Certified(Plain):
    def __init__(self, metric: str, at: dict[int, Point], target: int) -> None:
        super().__init__(metric, at, target)
        self.bounded: dict[int, tuple[float, float]] = {}
        self.precise: dict[int, Decimal] = {}

    def bound(self, node: int) -> tuple[float, float]:
        """A distance and the most by which it is wrong."""
        if node not in self.bounded:
            (ux, uy), (vx, vy) = self.at[node], self.at[self.target]
            e, lost = math.hypot(ux - vx, uy - vy), 1.0
            if self.metric == "poincare":
                ra, rb = math.hypot(ux, uy), math.hypot(vx, vy)
                if max(ra, rb) >= 1:
                    raise ValueError("a point outside the open disk")
                # the gaps to the circle lose what their points' norms round
                lost = 1 + 1 / (1 - ra) + 1 / (1 - rb)
                z = e / (math.sqrt((1 - ra) * (1 + ra)) * math.sqrt((1 - rb) * (1 + rb)))
                e = 2 * math.asinh(z)
            self.bounded[node] = e, ROUNDINGS * EPSILON * (lost * e + 1e-300)
        return self.bounded[node]

    def exact(self, node: int) -> Decimal:
        if node not in self.precise:
            with localcontext() as context:
                context.prec = DIGITS
                u, v = ([Decimal(c) for c in self.at[k]] for k in (node, self.target))
                square = (u[0] - v[0]) ** 2 + (u[1] - v[1]) ** 2
                if self.metric == "euclidean":
                    self.precise[node] = square.sqrt()
                else:
                    inside = [1 - p[0] ** 2 - p[1] ** 2 for p in (u, v)]
                    if min(inside) <= 0:
                        raise ValueError("a point outside the open disk")
                    z = (square / (inside[0] * inside[1])).sqrt()
                    self.precise[node] = 2 * (z + (1 + z * z).sqrt()).ln()
        return self.precise[node]

    def below(self, a: int, b: int, shift: float = 0.0) -> bool:
        (x, ex), (y, ey) = self.bound(a), self.bound(b)
        gap = x - y - shift
        if abs(gap) > ex + ey + 4 * EPSILON * (x + y + abs(shift)):
            return gap < 0
        if a == b and shift == 0:
            return False
        self.refined += 1
        with localcontext() as context:
            context.prec = DIGITS
            exact = self.exact(a) - self.exact(b) - Decimal(shift)
        if abs(exact) < OPEN and not (self.at[a] == self.at[b] and shift == 0):
            self.open += 1
        return exact < -OPEN


def least(measure: Plain, nodes: list[int]) -> int:
    best = nodes[0]
    for k in nodes[1:]:
        best = k if measure.below(k, best) else best
    return best


def tied(measure: Plain, nodes: list[int], best: int, tolerance: float) -> list[int]:
    """Nodes no further than the best and the tolerance."""
    return [k for k in nodes if not measure.below(best, k, -tolerance)]


def extended(walk: list[int], target: int, near: dict[int, list[int]], measure: Plain, tolerance: float, protocol: str, choose: Callable[[int, list[int]], int]) -> str | None:
    """Walks on until the target or a failure, which it returns."""
    while walk[-1] != target:
        at = walk[-1]
        nodes = sorted(near.get(at, []))
        if not nodes:
            return "local_minimum"
        if protocol == "i2" and target in nodes:
            walk.append(target)
            continue
        best = least(measure, nodes)
        if protocol == "i1":
            picked = min(tied(measure, nodes, best, tolerance))
            if picked in walk:
                return "attempted_revisit"
            if not measure.below(picked, at, -tolerance):
                return "local_minimum"
        else:
            if not measure.below(best, at, -tolerance):
                return "local_minimum"
            picked = choose(at, [k for k in tied(measure, nodes, best, tolerance) if measure.below(k, at, -tolerance)])
            if picked in walk:
                return "attempted_revisit"
        walk.append(picked)
    return None


def routed(source: int, target: int, near: dict[int, list[int]], measure: Plain, tolerance: float, protocol: str, choose: Callable[[int, list[int]], int]) -> tuple[list[int], str | None, list[int], str | None]:
    """Ordinary walk and failure, repaired walk and final failure."""
    first = [source]
    failure = extended(first, target, near, measure, tolerance, protocol, choose)
    if failure is None:
        return first, None, first, None
    if len(first) == 1:
        return first, failure, first, "repair_unavailable_at_source"
    before, walk = first[-2], [*first, first[-2]]
    free = sorted(k for k in near[before] if k not in first)
    if not free:
        return first, failure, walk, "no_alternative_after_backtracking"
    if protocol == "i2" and target in free:
        picked = target
    else:
        same = tied(measure, free, least(measure, free), tolerance)
        picked = min(same) if protocol == "i1" else choose(before, same)
    # what was walked before the repair stays explored
    walk.append(picked)
    final = extended(walk, target, near, measure, tolerance, protocol, choose)
    return first, failure, walk, final and f"post_repair_{final}"


def chosen_pairs(pairs: DataFrame, sample: str = "sentinel", frozen_hash: str = "") -> DataFrame:
    """The pairs that a sample by digest draws in each graph, numbered by pair_index: 'sentinel' of the second protocol, 'audit' of the first, or 'all'."""
    if sample == "all":
        return pairs
    of = {"sentinel": sentinel_indices, "audit": audit_indices}[sample]
    ship(pairs.sparkSession)
    counts = pairs.groupBy("graph_id").agg(F.count("*").alias("n"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch.itertuples():
                index = of(g.graph_id, int(g.n), frozen_hash)
                yield pd.DataFrame({"graph_id": g.graph_id, "pair_index": index})

    drawn = counts.mapInPandas(run, "graph_id string, pair_index int")
    return pairs.join(drawn, ["graph_id", "pair_index"], "left_semi")


def independent_routes(pairs: DataFrame, adjacent: DataFrame, coords: DataFrame, protocol: str = "i2", tolerance: float = 1e-12, data_hash: str = "") -> DataFrame:
    """Both independent routes of pairs under every condition and metric.

    (graph_id, pair_index, condition_id, metric, precision, walk, failure, repaired_walk,
    final_failure, refined, open): precision 'double' or 'certified', refined counts the
    comparisons that needed decimals, open those that these left undecided.  coords may
    have tolerances of their own, as walking.walks has.
    """
    spark = pairs.sparkSession
    ship(spark)
    lists = lambda *c: F.sort_array(F.collect_list(F.struct(*c)))
    edges = adjacent.groupBy("graph_id").agg(lists("node", "neighbour").alias("e")).select("graph_id", F.col("e.node").alias("src"), F.col("e.neighbour").alias("dst"))
    limit = lambda m: F.first(f"{m}_tolerance") if f"{m}_tolerance" in coords.columns else F.lit(float(tolerance))
    place = coords.groupBy("graph_id", "condition_id").agg(lists("node", "x", "y").alias("c"), *[limit(m).alias(m) for m in ("euclidean", "poincare")])
    place = place.select("graph_id", "condition_id", F.col("c.node").alias("node"), F.col("c.x").alias("x"), F.col("c.y").alias("y"), "euclidean", "poincare")
    some = pairs.groupBy("graph_id").agg(lists("pair_index", "source", "destination").alias("p"))
    some = some.select("graph_id", F.col("p.pair_index").alias("pair_index"), F.col("p.source").alias("source"), F.col("p.destination").alias("destination"))
    schema = "graph_id string, pair_index int, condition_id string, metric string, precision string, walk array<long>, failure string, repaired_walk array<long>, final_failure string, refined long, open long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch.itertuples():
                at = {int(k): (float(x), float(y)) for k, x, y in zip(g.node, g.x, g.y, strict=True)}
                near: dict[int, list[int]] = {}
                for a, b in zip(g.src, g.dst, strict=True):
                    near.setdefault(int(a), []).append(int(b))
                key, out = priority_key(g.graph_id, data_hash), []
                for k, s, t in zip(map(int, g.pair_index), map(int, g.source), map(int, g.destination), strict=True):
                    rank = priority(key, g.graph_id, k, s, t)
                    choose = lambda here, nodes, rank=rank: nodes[0] if len(nodes) == 1 else min(nodes, key=lambda v: rank(here, v))
                    for metric, own in (("euclidean", g.euclidean), ("poincare", g.poincare)):
                        if own is None or own != own:
                            continue
                        for precision, kind in (("double", Plain), ("certified", Certified)):
                            measure = kind(metric, at, t)
                            out.append((g.graph_id, k, g.condition_id, metric, precision, *routed(s, t, near, measure, own, protocol, choose), measure.refined, measure.open))
                yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return some.join(edges, "graph_id").join(place, "graph_id").repartition(parts, "graph_id", "condition_id").mapInPandas(run, schema)


def audit(walked: DataFrame, independent: DataFrame) -> DataFrame:
    """(graph_id, condition_id, metric, pairs, agreeing, disagreeing, undecided, double_disagreeing, refined): walked routes against the independent ones.

    A pair agrees where ordinary and repaired walk and both failures are those of the
    certified route; it is undecided where that left a comparison open; a pair
    without a walked route disagrees.  double_disagreeing counts pairs whose route in
    double precision isn't the certified one.
    """
    own = walked.select("graph_id", "pair_index", "condition_id", "metric", F.col("walk").alias("w"), F.col("failure").alias("f"), F.col("r_walk").alias("rw"), F.col("final_failure").alias("rf"))
    of = lambda p: independent.where(F.col("precision") == p).drop("precision")
    keys = ["graph_id", "pair_index", "condition_id", "metric"]
    double = of("double").select(*keys, F.struct("walk", "failure", "repaired_walk", "final_failure").alias("in_double"))
    both = of("certified").join(own, keys, "left").join(double, keys)
    same = F.struct("walk", "failure", "repaired_walk", "final_failure").eqNullSafe(F.struct(F.col("w"), F.col("f"), F.col("rw"), F.col("rf")))
    count = lambda c: F.count(F.when(c, 1))
    shown = both.select(*keys, "refined", (F.col("open") > 0).alias("undecided"), same.alias("same"), F.struct("walk", "failure", "repaired_walk", "final_failure").eqNullSafe(F.col("in_double")).alias("double"))
    return shown.groupBy("graph_id", "condition_id", "metric").agg(
        F.count("*").alias("pairs"), count(F.col("same") & ~F.col("undecided")).alias("agreeing"), count(~F.col("same") & ~F.col("undecided")).alias("disagreeing"), count(F.col("undecided")).alias("undecided"),
        count(~F.col("double")).alias("double_disagreeing"), F.sum("refined").alias("refined"),
    )
