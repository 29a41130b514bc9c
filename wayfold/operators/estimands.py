"""Estimands: routes to graphs, graphs to strata.  Routes are never treated as independent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfold.functions.geometry import distance_band, ratio

FAILURES = ("attempted_revisit", "local_minimum", "no_alternative_after_backtracking", "post_repair_attempted_revisit", "post_repair_local_minimum", "repair_unavailable_at_source")
METHODS = ("euclidean", "poincare", "repaired")


def methods(ordinary: DataFrame, repaired: DataFrame) -> DataFrame:
    """Routes of all three methods: graph_id, pair_index, condition_id, method, success, hops, decisions, initial_failure, final_failure, source, destination."""
    keep = ["graph_id", "pair_index", "condition_id", "method", "success", "hops", "decisions", "initial_failure", "final_failure", "source", "destination"]
    plain = ordinary.withColumn("method", F.col("metric")).withColumn("initial_failure", F.col("failure")).withColumn("final_failure", F.col("failure"))
    return plain.select(*keep).unionByName(repaired.where("metric = 'poincare'").withColumn("method", F.lit("repaired")).select(*keep))


def count_of(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def graph_rows(routes: DataFrame) -> DataFrame:
    """Successes of each method for each graph and condition."""
    hit = lambda m: count_of((F.col("method") == m) & F.col("success")).alias(m)
    return routes.groupBy("graph_id", "condition_id").agg(*[hit(m) for m in METHODS], count_of(F.col("method") == "repaired").alias("pair_count"))


def contrasts(rows: DataFrame) -> DataFrame:
    """Rates, advantage, improvement and the repair's recovery with its status."""
    rate = lambda c: F.col(c) / F.col("pair_count")
    recovery = ratio(F.col("repaired") - F.col("poincare"), F.col("pair_count") - F.col("poincare"))
    return rows.select("*", (rate("poincare") - rate("euclidean")).alias("advantage"), (rate("repaired") - rate("poincare")).alias("improvement"), recovery.alias("r")).select(
        *rows.columns, "advantage", "improvement", F.col("r.estimate").alias("recovery"), F.col("r.status").alias("recovery_status"))


def repair_ratios(routes: DataFrame, repaired: DataFrame) -> DataFrame:
    """Nested repair ratios for each graph and condition: failures, backtrackable, with an alternative, recovered."""
    own = repaired.where("metric = 'poincare'").groupBy("graph_id", "condition_id").agg(
        count_of(F.col("initial_failure").isNotNull()).alias("failures"), count_of(F.col("backtrackable")).alias("backtrackable"),
        count_of(F.col("alternative_existed")).alias("alternatives"), count_of(F.col("initial_failure").isNotNull() & F.col("success")).alias("recovered"))
    parts = [("recovered", "failures", "of_failures"), ("recovered", "backtrackable", "of_backtrackable"), ("recovered", "alternatives", "of_alternatives"), ("backtrackable", "failures", "can_backtrack"), ("alternatives", "backtrackable", "has_alternative")]
    return own.select("graph_id", "condition_id", "failures", "backtrackable", "alternatives", "recovered", *[ratio(F.col(a), F.col(b))["estimate"].alias(name) for a, b, name in parts])


def failure_summary(routes: DataFrame) -> DataFrame:
    """Routes by condition, method, stage and category, categories without routes as zeros, with both rates."""
    spark = routes.sparkSession
    stages = F.explode(F.array(F.struct(F.lit("initial").alias("stage"), F.col("initial_failure").alias("failure")), F.struct(F.lit("final").alias("stage"), F.col("final_failure").alias("failure"))))
    flat = routes.select("condition_id", "method", stages.alias("s")).select("condition_id", "method", "s.*")
    counted = flat.groupBy("condition_id", "method", "stage", "failure").agg(F.count("*").alias("routes"))
    totals = counted.groupBy("condition_id", "method", "stage").agg(F.sum("routes").alias("all_routes"), F.sum(F.when(F.col("failure").isNotNull(), F.col("routes")).otherwise(0)).alias("failed"))
    design = totals.select("condition_id", "method", "stage", "all_routes", "failed", F.explode(F.array(*[F.lit(f) for f in FAILURES])).alias("failure"))
    n = F.coalesce("routes", F.lit(0))
    return design.join(counted, ["condition_id", "method", "stage", "failure"], "left").select("condition_id", "method", "stage", "failure", n.alias("routes"), (n / F.col("all_routes")).alias("unconditional"), F.try_divide(n.cast("double"), F.col("failed").cast("double")).alias("conditional"))


def stretch_summary(routes: DataFrame) -> DataFrame:
    """Mean of graph means of stretch by condition and method, of successes and of pairs where both plain methods succeed."""
    stretch = F.when(F.col("success"), F.col("hops") / F.col("shortest"))
    both = routes.where("method in ('euclidean', 'poincare') and success").groupBy("graph_id", "condition_id", "pair_index").agg(F.count("*").alias("both")).where("both = 2")
    marked = routes.join(both, ["graph_id", "condition_id", "pair_index"], "left")
    per = marked.groupBy("graph_id", "condition_id", "method").agg(F.avg(stretch).alias("all"), F.avg(F.when(F.col("both") == 2, stretch)).alias("common"))
    return per.groupBy("condition_id", "method").agg(F.avg("all").alias("stretch"), F.count("all").alias("graphs"), F.avg("common").alias("common_stretch"), F.count("common").alias("common_graphs"))


def common_stretch(routes: DataFrame) -> DataFrame:
    """(graph_id, condition_id, stretch_contrast): mean difference in stretch over the pairs on which both metrics succeed; no row without one."""
    of = lambda m: F.max(F.when((F.col("method") == m) & F.col("success"), F.col("hops") / F.col("shortest")))
    pairs = routes.groupBy("graph_id", "condition_id", "pair_index").agg(of("euclidean").alias("e"), of("poincare").alias("p")).where("e is not null and p is not null")
    return pairs.groupBy("graph_id", "condition_id").agg((F.avg("p") - F.avg("e")).alias("stretch_contrast"))


def band_summary(routes: DataFrame) -> DataFrame:
    """Success and stretch by condition, method and band of the shortest length, every band present."""
    own = routes.withColumn("band", distance_band(F.col("shortest"))).groupBy("condition_id", "method", "band").agg(F.count("*").alias("routes"), count_of(F.col("success")).alias("successes"), F.avg(F.when(F.col("success"), F.col("hops") / F.col("shortest"))).alias("stretch"))
    design = routes.select("condition_id", "method").distinct().withColumn("band", F.explode(F.array(*[F.lit(b) for b in ("1", "2", "3", "4", ">=5")])))
    return design.join(own, ["condition_id", "method", "band"], "left").select("condition_id", "method", "band", F.coalesce("routes", F.lit(0)).alias("routes"), F.coalesce("successes", F.lit(0)).alias("successes"), "stretch")


def resource_summary(routes: DataFrame, of: tuple[str, ...] = ("hops", "decisions")) -> DataFrame:
    """Sum, mean and largest of each resource; null where any route lacks it."""
    whole = lambda c, x: F.when(F.count(c) == F.count("*"), x)
    aggs = [a for c in of for a in (whole(c, F.sum(c)).alias(f"{c}_sum"), whole(c, F.avg(c)).alias(f"{c}_mean"), whole(c, F.max(c)).alias(f"{c}_max"))]
    return routes.groupBy("condition_id", "method").agg(*aggs)


def interactions(rows: DataFrame) -> DataFrame:
    """Difference between two families' contrasts at the same radius, for each graph, in percentage points."""
    own = contrasts(rows).select("graph_id", F.split("condition_id", "_")[0].alias("family"), F.split("condition_id", "_")[1].alias("radius"), "advantage")
    return own.groupBy("graph_id", "radius").agg((100 * (F.max(F.when(F.col("family") == "hydra", F.col("advantage"))) - F.max(F.when(F.col("family") == "mds", F.col("advantage"))))).alias("interaction"))


def complete_system(rows: DataFrame) -> DataFrame:
    """Poincare on one family against Euclid on the other."""
    own = rows.select("graph_id", F.split("condition_id", "_")[0].alias("family"), F.split("condition_id", "_")[1].alias("radius"), "euclidean", "poincare", "pair_count")
    a, b = own.where("family = 'hydra'").alias("a"), own.where("family = 'mds'").alias("b")
    return a.join(b, ["graph_id", "radius"]).select("graph_id", "radius", (F.col("a.poincare") / F.col("a.pair_count") - F.col("b.euclidean") / F.col("b.pair_count")).alias("difference"))


def marginals(cells: DataFrame, sets: list[list[str]], value: str) -> DataFrame:
    """Grouping sets over cell means, each stratum of equal weight; a missing stratum makes the mean null."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    parts = []
    for own in sets:
        agg = [F.avg(value).alias("mean"), F.count("*").alias("strata"), F.count(value).alias("defined")]
        part = cells.groupBy(*own).agg(*agg) if own else cells.agg(*agg)
        parts.append(part.select(*[F.col(k) if k in own else F.lit(None).cast(cells.schema[k].dataType).alias(k) for k in keys], F.when(F.col("strata") == F.col("defined"), F.col("mean")).alias("mean"), "strata"))
    return reduce(DataFrame.unionByName, parts)
