"""Greedy routing as a decision table and a walk over it, for both protocols.

Given coordinates and a tolerance, the next hop depends on the current node and
the destination alone.  One join makes every (node, destination) decision, one
aggregation turns a destination's decisions into an array by node, and a fold
over that array walks each route inside the JVM: no join for each hop, no
driver loop.

Protocol 'i1' takes the smallest id among the neighbours within the tolerance of
the best, then tests revisits, then strict progress.  Protocol 'i2' moves to an
adjacent destination at once, tests the best neighbour's progress first, and
breaks ties among progressing neighbours by a priority (the smallest by default).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geometry import distance

KEYS = ["graph_id", "condition_id", "metric", "destination"]


def decisions(adjacent: DataFrame, coords: DataFrame, destinations: DataFrame, protocol: str = "i1", priority: Column | None = None) -> DataFrame:
    """(graph_id, condition_id, metric, destination, node, d_node, options, best, moves).

    coords: graph_id, condition_id, node, x, y; destinations: graph_id, condition_id,
    metric, tolerance, destination.  options are (d, node) of all neighbours by
    node; best is the chosen one and moves whether going there makes progress.
    """
    place = coords.select("graph_id", "condition_id", F.col("node").alias("destination"), F.col("x").alias("dx"), F.col("y").alias("dy"))
    goal = destinations.distinct().join(place, ["graph_id", "condition_id", "destination"])
    own = coords.select("graph_id", "condition_id", "node", F.col("x").alias("nx"), F.col("y").alias("ny"))
    far = goal.join(own, ["graph_id", "condition_id"]).withColumn("d", distance(F.col("metric"), F.col("nx"), F.col("ny"), F.col("dx"), F.col("dy"))).select(*KEYS, "tolerance", "node", "d")
    to = far.select(*KEYS, F.col("node").alias("neighbour"), F.col("d").alias("d_next"))
    rank = priority if priority is not None else F.col("neighbour")
    grouped = (
        far.join(adjacent, ["graph_id", "node"]).join(to, [*KEYS, "neighbour"])
        .groupBy(*KEYS, "node")
        .agg(F.first("d").alias("d_node"), F.first("tolerance").alias("tolerance"), F.sort_array(F.collect_list(F.struct(F.col("neighbour").alias("node"), F.col("d_next").alias("d"), rank.alias("rank")))).alias("options"))
    )
    return grouped.select(*KEYS, "node", "d_node", "tolerance", "options", choose(F.col("options"), F.col("d_node"), F.col("tolerance"), F.col("destination"), protocol).alias("choice")).select(
        *KEYS, "node", "d_node", "tolerance", "options", F.col("choice.best").alias("best"), F.col("choice.moves").alias("moves"))


def choose(options: Column, d_node: Column, tolerance: Column, destination: Column, protocol: str, progress: bool = True) -> Column:
    """(best, moves) among options under a protocol; best is null when there is none."""
    least = F.array_min(F.transform(options, lambda o: o["d"]))
    if protocol == "i1":
        tied = F.filter(options, lambda o: o["d"] <= least + tolerance)
        best = F.array_min(F.transform(tied, lambda o: o["node"]))
        d_best = F.filter(tied, lambda o: o["node"] == best)
        moves = F.get(d_best, F.lit(0))["d"] < d_node - tolerance
    else:
        tied = F.filter(options, lambda o: (o["d"] <= least + tolerance) & ((o["d"] < d_node - tolerance) if progress else F.lit(True)))
        best = F.array_min(F.transform(tied, lambda o: F.struct(o["rank"].alias("rank"), o["node"].alias("node"))))["node"]
        best = F.when(F.exists(options, lambda o: o["node"] == destination), destination).otherwise(best)
        moves = (best == destination) | (least < d_node - tolerance)
    return F.struct(best.alias("best"), F.coalesce(moves, F.lit(False)).alias("moves"))


def tables(decided: DataFrame) -> DataFrame:
    """A row for each destination: by_node, its decisions in order of the nodes 0, 1, ..."""
    return decided.groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.struct("node", "best", "moves", "d_node", "options"))).alias("by_node"), F.first("tolerance").alias("tolerance"))


#: Steps of a fold that are taken before it is asked whether the walk has ended.
STEPS = 16


def follow(by_node: Column, destination: Column, start: Column, limit: Column) -> Column:
    """From the walk start: (walk, failure, decisions).  The walk goes on until the destination, a revisit or a local minimum, for limit decisions at most."""
    none = F.lit(None).cast("string")
    begin = F.struct(start.alias("walk"), none.alias("failure"), F.lit(0).alias("decisions"))

    def ended(state: Column) -> Column:
        return (F.element_at(state["walk"], -1) == destination) | state["failure"].isNotNull() | (state["decisions"] >= limit)

    def step(state: Column, _: Column) -> Column:
        walk = state["walk"]
        at = F.element_at(walk, -1)
        here = F.get(by_node, at.cast("int"))
        revisit = F.array_contains(walk, here["best"])
        failure = F.when(revisit, "attempted_revisit").when(~here["moves"], "local_minimum")
        moved = F.struct(
            F.when(failure.isNull(), F.concat(walk, F.array(here["best"]))).otherwise(walk).alias("walk"), failure.alias("failure"), (state["decisions"] + 1).alias("decisions"))
        return F.when(ended(state), state).otherwise(moved)

    def steps(state: Column, _: Column) -> Column:
        return F.when(ended(state), state).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), state, step))

    return F.aggregate(F.sequence(F.lit(1), F.ceil(limit / STEPS).cast("int")), begin, steps)


def routes(pairs: DataFrame, decided: DataFrame, limit: int | Column, protocol: str = "i1") -> DataFrame:
    """Ordinary routes of pairs (graph_id, pair_index, source, destination) under every condition and metric.

    Returns the pair with condition_id, metric, walk, hops, decisions, success
    and failure, and the table for repairs.
    """
    tabled = tables(decided)
    joined = pairs.join(tabled, ["graph_id", "destination"])
    run = follow(F.col("by_node"), F.col("destination"), F.array("source"), F.lit(limit))
    out = joined.withColumn("r", run)
    order = F.when(F.col("r.failure").isNull(), F.lit(None)).otherwise(F.when(F.lit(protocol == "i2"), F.lit("local_minimum")).otherwise(F.col("r.failure")))
    # strict progress allows a revisit only where there is no progress either; the second protocol tests progress first
    return out.select("graph_id", "pair_index", "source", "destination", "condition_id", "metric", F.col("r.walk").alias("walk"), (F.size("r.walk") - 1).alias("hops"),
                      F.col("r.decisions").alias("decisions"), (F.element_at("r.walk", -1) == F.col("destination")).alias("success"), order.alias("failure"), "by_node", "tolerance")


def repaired(ordinary: DataFrame, limit: int | Column, protocol: str = "i1") -> DataFrame:
    """One repair of each failed route: back one edge, the best unexplored alternative without a progress test, then on as before.

    Adds backtrackable, attempted, alternative_existed, initial_failure and
    final_failure; successes stay as they are.
    """
    walk = F.col("walk")
    failed = ~F.col("success")
    back = F.size(walk) >= 2
    before = F.get(walk, F.size(walk) - 2)
    there = F.get(F.col("by_node"), before.cast("int"))
    free = F.filter(there["options"], lambda o: ~F.array_contains(walk, o["node"]))
    picked = choose(F.col("free"), F.lit(float("inf")), F.col("tolerance"), F.col("destination"), protocol, progress=False)["best"]
    begun = ordinary.withColumn("back", failed & back).withColumn("free", F.when(F.col("back"), free)).withColumn("exists", F.coalesce(F.size("free") > 0, F.lit(False))).withColumn("alternative", F.when(F.col("exists"), picked))
    start = F.concat(walk, F.array(before, F.col("alternative")))
    done = begun.withColumn("r", F.when(F.col("exists"), follow(F.col("by_node"), F.col("destination"), start, F.lit(limit))))
    final = (
        F.when(~failed, None).when(~back, "repair_unavailable_at_source").when(~F.col("exists"), "no_alternative_after_backtracking")
        .when(F.element_at("r.walk", -1) == F.col("destination"), None)
        .when(F.col("r.failure") == "attempted_revisit", "post_repair_attempted_revisit").otherwise("post_repair_local_minimum")
    )
    if protocol == "i2":  # progress is tested before a revisit
        stuck = F.get(F.col("by_node"), F.element_at("r.walk", -1).cast("int"))["moves"]
        final = F.when((final == "post_repair_attempted_revisit") & ~stuck, "post_repair_local_minimum").otherwise(final)
    new_walk = F.when(F.col("exists"), F.col("r.walk")).when(F.col("back"), F.concat(walk, F.array(before))).otherwise(walk)
    used = F.when(F.col("exists"), F.col("r.decisions") + 1).otherwise(F.lit(0)) + F.when(F.col("back") & F.lit(protocol == "i2"), 1).otherwise(0)
    return done.select(
        "graph_id", "pair_index", "source", "destination", "condition_id", "metric", new_walk.alias("walk"), (F.size(new_walk) - 1).alias("hops"), (F.col("decisions") + used).alias("decisions"),
        final.isNull().alias("success"), F.when(failed, back).alias("backtrackable"), F.col("back").alias("attempted"), F.when(failed, F.col("exists")).alias("alternative_existed"),
        F.col("failure").alias("initial_failure"), final.alias("final_failure"),
    )


def with_benchmark(routed: DataFrame, apsp: DataFrame) -> DataFrame:
    """Adds the shortest length and, for successes, hops over it."""
    short = apsp.select("graph_id", F.col("u").alias("source"), F.col("v").alias("destination"), F.col("d").alias("shortest"))
    return routed.join(short, ["graph_id", "source", "destination"]).withColumn("stretch", F.when(F.col("success"), F.col("hops") / F.col("shortest")))
