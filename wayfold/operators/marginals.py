"""Estimates by model and setting: cells, marginals of equal-weight cells, contrasts of models, evidence by radius.

A setting has two factors of two levels, so a model has four cells.  A marginal is the
mean of its cells, not of its graphs, and is null where a cell is missing or has no
value.  Intervals come from whole graphs drawn anew within each cell; a replicate counts
for a marginal only where all of its cells have a value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold.functions import geometry
from wayfold.operators import inference
from wayfold.shipping import ship

LEVELS = ("lower", "upper")
CELL = ["model", "size", "density"]
WHAT = ["condition_id", "metric"]
#: Replicates of a cell in one task.
BLOCK = 500
#: Scopes with the factors that they keep; each other factor is averaged over its levels.
SCOPES = {"cell": ("size", "density"), "size": ("size",), "density": ("density",), "all": ()}
#: Fixed values of the status column.
NO_STRATUM, NO_INTERVAL, DEFINED = "not_estimable_missing_stratum", "estimate_defined_interval_unavailable", "defined"
STRETCH, REPAIR = "common_success_poincare_minus_euclidean_stretch", "repaired_minus_unrepaired_poincare"


def settings(graphs: DataFrame) -> DataFrame:
    """(graph_id, model, size, density, place) from graph_id, model, replicate, nodes, edges.

    size halves a model's graphs by nodes, density each half by edges, ties by
    replicate; the lower half has the odd graph.  place numbers a cell's graphs from 0.
    """
    half = lambda keys, by: F.when(F.ntile(2).over(Window.partitionBy(*keys).orderBy(by, "replicate")) == 1, LEVELS[0]).otherwise(LEVELS[1])
    split = graphs.withColumn("size", half(["model"], "nodes")).withColumn("density", half(["model", "size"], "edges"))
    place = (F.row_number().over(Window.partitionBy(*CELL).orderBy("replicate")) - 1).cast("int")
    return split.select("graph_id", *CELL, place.alias("place"))


def scoped(cells: DataFrame, value: str, by: list[str], *sums: str) -> DataFrame:
    """Cells averaged in every scope: scope, CELL (a factor averaged over is null), by, value, strata; sums are added, null where a cell has none."""
    level = lambda c, kept: (F.col(c) if c in kept else F.lit(None).cast("string")).alias(c)
    scope = F.explode(F.array(*[F.struct(F.lit(s).alias("scope"), level("size", kept), level("density", kept), F.lit(len(LEVELS) ** (2 - len(kept))).alias("wanted")) for s, kept in SCOPES.items()]))
    flat = cells.select(scope.alias("s"), "model", *by, value, *sums).select("s.*", "model", *by, value, *sums)
    total = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c)
    return flat.groupBy("scope", *CELL, *by).agg(F.when(F.count(value) == F.first("wanted"), F.avg(value)).alias(value), F.count("*").alias("strata"), *[total(c) for c in sums])


def replicated(values: DataFrame, drawn: DataFrame) -> DataFrame:
    """(scope, CELL, WHAT, boot): estimates of all replicates in replicate order, null where a cell lacks one.

    values: CELL, place, WHAT, value; drawn: CELL, replicate, drawn.  A task holds one cell's
    values and a block of its replicates: how often each graph is drawn, times the values.
    Only the replicates' means leave it, as arrays.
    """
    ship(values.sparkSession)
    each = values.groupBy(*CELL, *WHAT).agg(F.collect_list("place").alias("at"), F.collect_list(F.coalesce("value", F.lit(float("nan")))).alias("v"))
    known = each.groupBy(*CELL).agg(*[F.collect_list(c).alias(c) for c in (*WHAT, "at", "v")])
    blocks = drawn.groupBy(*CELL, F.floor(F.col("replicate") / BLOCK).cast("int").alias("block")).agg(F.collect_list("replicate").alias("replicate"), F.collect_list("drawn").alias("drawn"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch.to_dict("records"):
                place = np.asarray(g["drawn"], dtype=int)
                row = np.asarray(g["replicate"], dtype=int) - g["block"] * BLOCK
                graphs = 1 + max(int(place.max()), max(int(np.max(at)) for at in g["at"]))
                times, v = np.zeros((row.max() + 1, graphs)), np.full((graphs, len(g["v"])), np.nan)
                np.add.at(times, (row, place), 1)
                for k, (at, x) in enumerate(zip(g["at"], g["v"])):
                    v[np.asarray(at, dtype=int), k] = x
                with np.errstate(invalid="ignore"):
                    mean = (times @ np.nan_to_num(v)) / (times @ np.isfinite(v))
                yield pd.DataFrame([(*[g[c] for c in CELL], c, m, g["block"], mean[:, k]) for k, (c, m) in enumerate(zip(g["condition_id"], g["metric"]))], columns=[*CELL, *WHAT, "block", "boot"])

    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    means = blocks.join(known, CELL).repartition(parts, *CELL, "block").mapInPandas(run, f"{', '.join(f'{c} string' for c in (*CELL, *WHAT))}, block int, boot array<double>")
    whole = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "boot"))), lambda b: b["boot"]))
    cells = means.groupBy(*CELL, *WHAT).agg(F.transform(whole, lambda x: F.when(~F.isnan(x), x)).alias("boot"))
    level = lambda c, f, kept: (c[f] if f in kept else F.lit(None).cast("string")).alias(f)
    scopes = lambda c: F.array(*[F.struct(F.lit(s).alias("scope"), level(c, "size", kept), level(c, "density", kept), F.lit(len(LEVELS) ** (2 - len(kept))).alias("wanted")) for s, kept in SCOPES.items()])
    together = cells.groupBy("model", *WHAT).agg(F.collect_list(F.struct("size", "density", "boot")).alias("cells"))
    named = together.select("model", *WHAT, "cells", F.explode(F.array_distinct(F.flatten(F.transform("cells", scopes)))).alias("s")).select("model", *WHAT, "cells", "s.*")
    own = F.filter("cells", lambda c: (F.col("size").isNull() | (c["size"] == F.col("size"))) & (F.col("density").isNull() | (c["density"] == F.col("density"))))
    some = named.select("scope", *CELL, *WHAT, "wanted", F.transform(own, lambda c: c["boot"]).alias("of"))
    mean = lambda i: F.aggregate("of", F.lit(0.0), lambda t, x: t + F.get(x, i)) / F.col("wanted")
    longest = F.array_max(F.transform("of", lambda x: F.size(x)))
    every = F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.when(F.size("of") == F.col("wanted"), mean(i)))
    return some.select("scope", *CELL, *WHAT, every.alias("boot"))


def points(values: DataFrame) -> DataFrame:
    """Estimates in every scope, with graphs, applicable graphs and the sums of numerators and denominators."""
    whole = lambda c: F.when(F.count(c) == F.count("*"), F.sum(c)).alias(c)
    cells = values.groupBy(*CELL, *WHAT).agg(F.avg("value").alias("estimate"), F.count("*").alias("graphs"), F.count("value").alias("applicable"), whole("numerator"), whole("denominator"))
    return scoped(cells, "estimate", WHAT, "graphs", "applicable", "numerator", "denominator")


def with_interval(point: DataFrame, boot: DataFrame, keys: list[str], level: float = 0.95, least_defined: float = 0.95) -> DataFrame:
    """Adds nearest-rank low, high and status; keys may be null; no interval where fewer than the least share of replicates is defined."""
    known = F.array_sort(F.filter("boot", lambda x: x.isNotNull()))
    tail = round((1 - level) / 2, 12)
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.round(p * F.size("known"), 9)).cast("int"))
    limit = lambda p: F.when((F.size("known") >= least_defined * F.size("boot")) & (F.size("known") > 0), F.get("known", rank(p) - 1))
    interval = boot.withColumn("known", known).select(*keys, limit(tail).alias("low"), limit(1 - tail).alias("high"))
    a, b = point.alias("a"), interval.alias("b")
    both = a.join(b, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "left").select("a.*", F.when(F.col("estimate").isNotNull(), F.col("low")).alias("low"), F.when(F.col("estimate").isNotNull(), F.col("high")).alias("high"))
    return both.withColumn("status", F.when(F.col("estimate").isNull(), NO_STRATUM).when(F.col("low").isNull(), NO_INTERVAL).otherwise(DEFINED))


def estimates(values: DataFrame, drawn: DataFrame) -> DataFrame:
    """(scope, CELL, WHAT, estimate, strata, graphs, applicable, numerator, denominator, low, high, status) from values: CELL, place, WHAT, value, numerator, denominator."""
    return with_interval(points(values), replicated(values, drawn), ["scope", *CELL, *WHAT])


def model_contrasts(values: DataFrame, drawn: DataFrame, first: str = "barabasi_albert", second: str = "erdos_renyi") -> DataFrame:
    """(scope, size, density, WHAT, estimate, low, high, status): first less second, whose graphs are drawn apart; null where either has no estimate."""
    keys = ["scope", "size", "density", *WHAT]
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("estimate")))
    boot = replicated(values, drawn)
    side = lambda m: F.max(F.when(F.col("model") == m, F.col("boot")))
    apart = boot.groupBy(*keys).agg(F.zip_with(side(first), side(second), lambda x, y: x - y).alias("boot")).withColumn("boot", F.coalesce("boot", F.array().cast("array<double>")))
    return with_interval(points(values).groupBy(*keys).agg((of(first) - of(second)).alias("estimate")), apart, keys)


def interaction_estimates(values: DataFrame, drawn: DataFrame, margin: float = 5.0) -> DataFrame:
    """estimates() of interactions in percentage points, with the interval's label against the margin."""
    low, high = F.round("low", 9), F.round("high", 9)
    return estimates(values, drawn).withColumn("label", F.when(F.col("low").isNotNull(), geometry.interval_label(low, high, margin)))


def hop_means(routes: DataFrame, of: DataFrame) -> DataFrame:
    """(model, condition_id, overhead): mean hops of repaired walks less those of plain ones in the disk, graphs of equal weight; of: graph_id, model."""
    per = routes.where("method in ('poincare', 'repaired')").groupBy("graph_id", "condition_id", "method").agg(F.avg("hops").alias("hops"))
    mean = lambda m: F.avg(F.when(F.col("method") == m, F.col("hops")))
    return per.join(of.select("graph_id", "model"), "graph_id").groupBy("model", "condition_id").agg((mean("repaired") - mean("poincare")).alias("overhead"))


def evidence(interactions: DataFrame, drawn: DataFrame, values: DataFrame, overheads: DataFrame) -> DataFrame:
    """One row for each model and radius with a marginal interaction: the effect with its band over all radii, whether all radii
    share its sign, and for each family the stretch contrast, the repair's gain and its hops; what is missing is null.

    interactions and values as for estimates(), the condition of an interaction being its radius; overheads as of hop_means().
    """
    whole = points(interactions).where("scope = 'all' and estimate is not null").select("model", F.col("condition_id").alias("radius"), F.col("estimate").alias("point"), "graphs")
    boot = replicated(interactions, drawn).where("scope = 'all'").select("model", F.col("condition_id").alias("radius"), F.posexplode("boot").alias("replicate", "estimate")).where("estimate is not null")
    bands = inference.simultaneous_bands(whole.drop("graphs"), boot, ["model"], "radius")
    sign = F.signum(F.round("point", 9))
    signs = whole.groupBy("model").agg((F.min(sign) == F.max(sign)).alias("consistent"))
    rows = bands.join(whole.select("model", "radius", "graphs"), ["model", "radius"]).join(signs, "model")

    def families(of: DataFrame, value: Column, name: str) -> DataFrame:
        family = F.split("condition_id", "_")
        each = of.select("model", family[0].alias("family"), family[1].alias("radius"), value.alias("v"))
        return each.groupBy("model", "radius").agg(*[F.max(F.when(F.col("family") == f, F.col("v"))).alias(f"{name}_{f}") for f in ("hydra", "mds")])

    marginal = points(values).where("scope = 'all'")
    parts = [(marginal.where(F.col("metric") == STRETCH), F.col("estimate"), "stretch"), (marginal.where(F.col("metric") == REPAIR), F.col("estimate"), "repair"), (overheads, F.col("overhead"), "overhead")]
    for of, value, name in parts:
        rows = rows.join(families(of, value, name), ["model", "radius"], "left")
    return rows.withColumnRenamed("point", "effect").drop("critical")
