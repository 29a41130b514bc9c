"""Violation queries: each returns the rows that break a rule, none when all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["graph_id", "condition_id", "pair_index", "metric"]


def walk_edges_missing(routes: DataFrame, adjacent: DataFrame) -> DataFrame:
    """Steps of walks that are no edge."""
    steps = routes.select(*KEY, F.posexplode("walk").alias("at", "node"), "walk").select(*KEY, "node", F.get("walk", F.col("at") + 1).alias("neighbour")).where("neighbour is not null")
    return steps.join(adjacent, ["graph_id", "node", "neighbour"], "left_anti").select(*KEY)


def rules(routes: DataFrame, adjacent: DataFrame) -> dict[str, DataFrame]:
    end = F.element_at("walk", -1)
    return {
        "walk_edge_missing": walk_edges_missing(routes, adjacent),
        "length_mismatch": routes.where(F.col("hops") != F.size("walk") - 1).select(*KEY),
        "wrong_start": routes.where(F.get("walk", F.lit(0)) != F.col("source")).select(*KEY),
        "success_elsewhere": routes.where(F.col("success") & (end != F.col("destination"))).select(*KEY),
        "failed_at_destination": routes.where(~F.col("success") & (end == F.col("destination"))).select(*KEY),
        "failure_unlabelled": routes.where(F.col("success") == F.col("failure").isNotNull()).select(*KEY),
        "ordinary_revisit": routes.where(F.size(F.array_distinct("walk")) != F.size("walk")).select(*KEY),
        "duplicate_key": routes.groupBy(*KEY).count().where("count > 1").select(*KEY),
    }


def violations(routes: DataFrame, adjacent: DataFrame) -> DataFrame:
    """(rule, violations), a row for each rule."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in rules(routes, adjacent).items()]
    return reduce(DataFrame.unionByName, parts)


def inventory(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are missing or not expected."""
    missing, extra = expected.select(key).distinct(), found.select(key).distinct()
    return missing.join(extra, key, "left_anti").withColumn("state", F.lit("missing")).unionByName(extra.join(missing, key, "left_anti").withColumn("state", F.lit("unexpected")))


def design_gaps(routes: DataFrame, pairs: DataFrame, conditions: DataFrame) -> DataFrame:
    """Crossed design against the routes that exist, both ways."""
    design = pairs.select("graph_id", "pair_index").join(conditions, "graph_id").select("graph_id", "condition_id", "pair_index").distinct()
    have = routes.select("graph_id", "condition_id", "pair_index").distinct()
    return design.exceptAll(have).withColumn("state", F.lit("missing")).unionByName(have.exceptAll(design).withColumn("state", F.lit("unexpected")))


def not_finite(table: DataFrame, columns: list[str]) -> DataFrame:
    bad = reduce(lambda a, b: a | b, [F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in columns])
    return table.where(bad)


def length_mismatches(lengths: DataFrame, apsp: DataFrame) -> DataFrame:
    """(graph_id, pairs, mismatches): pairs whose length isn't that of the distance table, in either direction; both absent agree."""
    there = apsp.select("graph_id", F.col("u").alias("source"), F.col("v").alias("destination"), F.col("d").alias("there"))
    back = apsp.select("graph_id", F.col("v").alias("source"), F.col("u").alias("destination"), F.col("d").alias("back"))
    both = lengths.join(there, ["graph_id", "source", "destination"], "left").join(back, ["graph_id", "source", "destination"], "left")
    same = F.col("shortest").eqNullSafe(F.col("there")) & F.col("shortest").eqNullSafe(F.col("back"))
    return both.groupBy("graph_id").agg(F.count("*").alias("pairs"), F.count(F.when(~same, 1)).alias("mismatches"))
