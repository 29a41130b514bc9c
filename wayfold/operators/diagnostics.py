"""Diagnostics beside the estimands: why walks end, what a radius changes, resampled pairs, checks of tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions import geometry
from wayfold.operators import allpairs
from wayfold.operators.estimands import METHODS
from wayfold.operators.sampling import digest_number
from wayfold.shipping import ship

#: Metrics of a graph row with the fields of their numerators (the second is taken off) and denominators.
METRICS = {
    "euclidean_success": ("euclidean", None, "pair_count"),
    "poincare_success": ("poincare", None, "pair_count"),
    "repaired_poincare_success": ("repaired", None, "pair_count"),
    "poincare_minus_euclidean": ("poincare", "euclidean", "pair_count"),
    "repaired_minus_unrepaired_poincare": ("repaired", "poincare", "pair_count"),
    "conditional_repair_recovery": ("repaired", "poincare", "failures"),
}


def failure_diagnostics(routes: DataFrame, adjacent: DataFrame, coords: DataFrame, tolerance: float) -> DataFrame:
    """One row for each failed route: where it stopped, after how many hops, the node's degree, its distance to the
    destination, that of its best neighbour, and the gap between the two (negative where no neighbour is nearer).

    Routes that succeeded give no row; a stopping node without neighbours has degree 0 and no best distance.
    """
    failed = routes.where(~F.col("success")).select("graph_id", "pair_index", "condition_id", "metric", "destination", "failure", F.element_at("walk", -1).alias("stopped"), (F.size("walk") - 1).alias("failure_hop"))
    at = lambda name: coords.select("graph_id", "condition_id", F.col("node").alias(name), F.col("x").alias(f"{name}_x"), F.col("y").alias(f"{name}_y"))
    there = failed.join(at("destination"), ["graph_id", "condition_id", "destination"]).join(at("stopped"), ["graph_id", "condition_id", "stopped"])
    near = adjacent.select("graph_id", F.col("node").alias("stopped"), "neighbour")
    options = there.join(near, ["graph_id", "stopped"], "left").join(at("neighbour"), ["graph_id", "condition_id", "neighbour"], "left")
    far = lambda name: geometry.distance(F.col("metric"), F.col(f"{name}_x"), F.col(f"{name}_y"), F.col("destination_x"), F.col("destination_y"))
    keys = ["graph_id", "pair_index", "condition_id", "metric", "failure", "stopped", "failure_hop"]
    own = options.groupBy(*keys).agg(F.count("neighbour").alias("terminal_degree"), F.first(far("stopped")).alias("current_distance"), F.min(far("neighbour")).alias("best_neighbour_distance"))
    return own.withColumn("progress_gap", F.col("current_distance") - F.col("best_neighbour_distance")).withColumn("tolerance", F.lit(tolerance))


def repair_diagnostics(repaired: DataFrame, adjacent: DataFrame, coords: DataFrame, tolerance: float) -> DataFrame:
    """failure_diagnostics of walks that fail after all, with the stage: no edge to go back, no alternative there, or later on.

    repaired: as walking.repaired or routing.repaired.  After a step back without an alternative the walk stands on the node before.
    """
    stage = F.when(F.col("failure") == "repair_unavailable_at_source", "repair_unavailable").when(F.col("failure") == "no_alternative_after_backtracking", "repair_selection").otherwise("post_repair")
    return failure_diagnostics(repaired.withColumn("failure", F.col("final_failure")), adjacent, coords, tolerance).withColumn("stage", stage)


def distance_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """What a change of radius does to the distances of all unordered pairs, for each graph and condition of after.

    before: graph_id, family, node, x, y; after also condition_id and scale.  Distances in the disk are null
    for a graph and family with a point of before outside it.
    """
    a = before.select("graph_id", "family", "node", F.col("x").alias("bx"), F.col("y").alias("by"))
    both = after.join(a, ["graph_id", "family", "node"])
    return allpairs.distance_change(both)


def coordinate_summary(coords: DataFrame) -> DataFrame:
    """Radii with interpolated quartiles, spread, centre and coincident nodes of every graph and condition."""
    r = F.hypot("x", "y")
    own = coords.groupBy("graph_id", "condition_id").agg(
        F.count("*").alias("nodes"), F.min(r).alias("r_least"), F.percentile(r, F.lit(0.25)).alias("r_q1"), F.percentile(r, F.lit(0.5)).alias("r_median"), F.percentile(r, F.lit(0.75)).alias("r_q3"),
        F.max(r).alias("r_most"), F.avg(r).alias("r_mean"), F.stddev_pop(r).alias("r_spread"), F.hypot(F.avg("x"), F.avg("y")).alias("centre_offset"), F.count(F.when(r >= 1, 1)).alias("outside"))
    shared = coords.groupBy("graph_id", "condition_id", "x", "y").agg(F.count("*").alias("n")).where("n > 1").groupBy("graph_id", "condition_id").agg(F.sum("n").alias("coincident"))
    return own.join(shared, ["graph_id", "condition_id"], "left").withColumn("coincident", F.coalesce("coincident", F.lit(0).cast("long")))


def matrix_violations(distances: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """For each graph, entries (u, v, d) of its distance matrix that break a rule; a row for each graph, zeros for a sound one.

    missing: pairs of nodes without an entry; repeated: entries beyond a pair's first; uneven: pairs whose
    two entries differ by more than the tolerance.  Null distances count as not finite.
    """
    d = F.col("d").cast("double")
    plain = distances.groupBy("graph_id").agg(
        F.count_distinct("u").alias("nodes"), F.count("*").alias("entries"), F.count(F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), 1)).alias("not_finite"),
        F.count(F.when(d < 0, 1)).alias("negative"), F.count(F.when((F.col("u") == F.col("v")) & (F.abs(d) > tolerance), 1)).alias("diagonal"))
    pair = distances.where("u <> v").groupBy("graph_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min(F.when(F.col("u") < F.col("v"), d)).alias("up"), F.min(F.when(F.col("u") > F.col("v"), d)).alias("down"))
    odd = pair.groupBy("graph_id").agg(F.count(F.when(F.abs(F.col("up") - F.col("down")) > tolerance, 1)).alias("uneven"))
    known = distances.groupBy("graph_id", "u", "v").agg(F.lit(1).alias("one")).groupBy("graph_id").agg(F.count("*").alias("known"))
    return plain.join(odd, "graph_id", "left").join(known, "graph_id").select(
        "graph_id", "nodes", (F.col("nodes") * F.col("nodes") - F.col("known")).alias("missing"), (F.col("entries") - F.col("known")).alias("repeated"), "not_finite", "negative", "diagonal", F.coalesce("uneven", F.lit(0).cast("long")).alias("uneven"))


def metric_counts(rows: DataFrame) -> DataFrame:
    """graph_id, condition_id, metric, numerator, denominator: the counts behind each metric of the graph rows."""
    own = rows.withColumn("failures", F.col("pair_count") - F.col("poincare"))

    def count(a: str, b: str | None, n: str) -> list[Column]:
        return [(F.col(a) - F.col(b) if b else F.col(a)).alias("numerator"), F.col(n).alias("denominator")]

    each = F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), *count(*of)) for name, of in METRICS.items()]))
    return own.select("graph_id", "condition_id", each.alias("m")).select("graph_id", "condition_id", "m.*")


def graph_row_violations(rows: DataFrame, conditions: int, identity: list[str]) -> DataFrame:
    """For each graph its rows that break a rule: conditions missing or repeated, identities beyond the first, pair counts that differ, counts out of order."""
    impossible = F.greatest(*[F.col(m) for m in METHODS]) > F.col("pair_count")
    return rows.groupBy("graph_id").agg(
        (F.lit(conditions) - F.count_distinct("condition_id")).cast("long").alias("missing"), (F.count("*") - F.count_distinct("condition_id")).alias("repeated"),
        (F.count_distinct(F.struct(*identity)) - 1).alias("identities"), (F.count_distinct("pair_count") - 1).alias("pair_counts"),
        F.count(F.when(impossible, 1)).alias("impossible"), F.count(F.when(F.col("repaired") < F.col("poincare"), 1)).alias("worse_by_repair"))


def recovered_stretch(routes: DataFrame) -> DataFrame:
    """Stretch of the routes that only the repair brought to their destination, by graph and condition; null means without such routes."""
    own = routes.where("method = 'repaired'")
    hit = F.col("initial_failure").isNotNull() & F.col("success")
    stretch = F.when(hit, F.col("hops") / F.col("shortest"))
    return own.groupBy("graph_id", "condition_id").agg(F.count(stretch).alias("recovered"), F.sum(F.when(hit, F.col("hops"))).alias("hops"), F.sum(F.when(hit, F.col("shortest"))).alias("shortest"), F.avg(stretch).alias("stretch"), F.max(stretch).alias("largest"))


def capacity_cells(repetitions: DataFrame) -> DataFrame:
    """Runtimes of each cell over its measured repetitions, the first (0) being a warm-up: (cell_id, repetition, runtime).

    A cell without both repetitions 1 and 2 has complete false and null figures; others are left out of them.
    """
    measured = F.when(F.col("repetition").isin(1, 2), F.col("runtime"))
    own = repetitions.groupBy("cell_id").agg(F.count_distinct(F.when(F.col("repetition").isin(0, 1, 2), F.col("repetition"))).alias("n"), F.count("*").alias("rows"), F.median(measured).alias("median"), F.max(measured).alias("largest"), F.min(measured).alias("smallest"))
    complete = (F.col("n") == 3) & (F.col("rows") == 3)
    spread = F.col("largest") - F.col("smallest")
    return own.select("cell_id", complete.alias("complete"), *[F.when(complete, x).alias(name) for name, x in [("median", F.col("median")), ("largest", F.col("largest")), ("smallest", F.col("smallest")), ("spread", spread), ("relative_spread", F.when(F.col("median") != 0, spread / F.col("median")).otherwise(0.0))]])


def pair_sensitivity(pair_values: DataFrame, pair_counts: tuple[int, ...] = (250, 500, 1000), replicates: int = 2000, seed: int = 0, block: int = 250) -> DataFrame:
    """Standard error (percentage points) of the mean of graph means when each graph's pairs are drawn anew, for several numbers of pairs.

    pair_values: graph_id, value, one row for each pair.  Graphs stay fixed, their pairs are drawn with replacement; draws
    depend on the seed, the graph, the number of pairs and the replicate alone.  Nulls take no part.  Under two graphs: no rows.
    """
    ship(pair_values.sparkSession)
    graph = pair_values.where("value is not null").groupBy("graph_id").agg(F.sort_array(F.collect_list(F.col("value").cast("double"))).alias("values"))
    starts = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(block)))
    tasks = graph.select("graph_id", "values", F.explode(F.array(*[F.lit(p) for p in pair_counts])).alias("pairs")).select("*", starts.alias("start"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples():
                rng = np.random.default_rng(digest_number({"seed": seed, "graph_id": t.graph_id, "pairs": int(t.pairs), "start": int(t.start)}, b"nested-1"))
                kinds, n = np.unique(np.asarray(t.values, float), return_counts=True)
                size = min(block, replicates - int(t.start))
                drawn = rng.multinomial(int(t.pairs), n / n.sum(), size=size)  # how often each value comes, as when pairs are drawn one by one
                yield pd.DataFrame({"pairs": int(t.pairs), "replicate": np.arange(t.start, t.start + size), "mean": drawn @ kinds / int(t.pairs)})

    parts = int(pair_values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    means = tasks.repartition(parts, "graph_id", "pairs", "start").mapInPandas(run, "pairs int, replicate int, mean double")
    per = means.groupBy("pairs", "replicate").agg(F.avg("mean").alias("estimate"), F.count("*").alias("graphs")).where("graphs >= 2")
    return per.groupBy("pairs").agg((100 * F.stddev_samp("estimate")).alias("standard_error"), F.count("*").alias("replicates"), F.max("graphs").alias("graphs"))


def walk_resources(routes: DataFrame, adjacent: DataFrame) -> DataFrame:
    """Routes of the second protocol with evaluations (distances that their decisions asked for) and history (distinct nodes remembered).

    routes: graph_id, pair_index, condition_id, metric, destination, walk; where a repair took place also initial_hops, the hops
    before it (null without one).  A node next to the destination needs no distance; every other node that decides measures
    itself and its neighbours; the repair measures the unexplored neighbours of the node that it went back to.
    """
    keys = ["graph_id", "pair_index", "condition_id", "metric"]
    if "initial_hops" not in routes.columns:
        routes = routes.withColumn("initial_hops", F.lit(None).cast("int"))
    steps = routes.select(*keys, "destination", "initial_hops", F.slice("walk", F.lit(1), F.coalesce("initial_hops", F.size("walk") - 1) + 1).alias("before"), F.posexplode("walk").alias("at", "node"))
    steps = steps.where("node <> destination").withColumn("back", F.coalesce(F.col("at") == F.col("initial_hops") + 1, F.lit(False)))
    near = adjacent.groupBy("graph_id", "node").agg(F.collect_set("neighbour").alias("near"))
    free = F.array_except("near", "before")
    known = F.coalesce("near", F.array().cast("array<long>"))
    cost = F.when(F.col("back"), F.when(F.array_contains(free, F.col("destination")), 0).otherwise(F.size(free))).when(F.array_contains(known, F.col("destination")), 0).otherwise(1 + F.size(known))
    spent = steps.join(near, ["graph_id", "node"], "left").groupBy(*keys).agg(F.sum(cost).cast("long").alias("evaluations"))
    return routes.join(spent, keys, "left").withColumn("evaluations", F.coalesce("evaluations", F.lit(0).cast("long"))).withColumn("history", F.size(F.array_distinct("walk"))).drop("initial_hops")
