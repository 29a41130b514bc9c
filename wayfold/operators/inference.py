"""Whole-graph bootstrap, simultaneous bands, rank association and precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfold._tables import written
from wayfold.operators.graphs import midrank


def draws(strata: DataFrame, replicates: int, index: Column) -> DataFrame:
    """(stratum keys, replicate, position, drawn): index is a column of replicate, position and graphs."""
    return strata.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("position", F.explode(F.sequence(F.lit(0), (F.col("graphs") - 1).cast("int")))).withColumn("drawn", index)


def bootstrap(values: DataFrame, by: list[str], value: str, drawn: DataFrame, rank: str = "place") -> DataFrame:
    """Mean of each replicate: values have a rank in their stratum that draws refer to."""
    picked = drawn.join(values.withColumnRenamed(rank, "drawn"), [*by, "drawn"])
    return picked.groupBy(*[c for c in values.columns if c not in (rank, value)], "replicate").agg(F.avg(value).alias("estimate"), F.count(value).alias("defined"))


def nearest_rank(p: float, column: str) -> Column:
    """Order statistic ceil(p N)."""
    return F.expr(f"percentile_disc({p}) within group (order by {column})")


def percentile_interval(replicated: DataFrame, by: list[str], level: float = 0.95, least_defined: float = 0.95) -> DataFrame:
    """Nearest-rank interval of the defined replicates; null when fewer than the least share is defined."""
    tail = round((1 - level) / 2, 12)
    enough = F.count("estimate") >= least_defined * F.count("*")
    return replicated.groupBy(*by).agg(F.when(enough, nearest_rank(tail, "estimate")).alias("low"), F.when(enough, nearest_rank(1 - tail, "estimate")).alias("high"))


def simultaneous_bands(point: DataFrame, replicated: DataFrame, by: list[str], over: str, level: float = 0.95) -> DataFrame:
    """Bands that hold over all values of one key at once: the level's order statistic of the largest deviation."""
    deviation = replicated.join(point, [*by, over]).groupBy(*by, "replicate").agg(F.max(F.abs(F.col("estimate") - F.col("point"))).alias("deviation"))
    critical = deviation.groupBy(*by).agg(nearest_rank(level, "deviation").alias("critical"))
    return point.join(critical, by).select(*by, over, "point", "critical", (F.col("point") - F.col("critical")).alias("low"), (F.col("point") + F.col("critical")).alias("high"))


def rank_association(values: DataFrame, x: str, y: str, by: list[str], stratum: list[str], within: bool) -> DataFrame:
    """Correlation of midranks less their stratum means; ranks within the stratum or over all, null where either is constant."""
    scope = [*by, *stratum] if within else by
    ranked = values.withColumn("rx", midrank(x, *scope)).withColumn("ry", midrank(y, *scope))
    own = Window.partitionBy(*by, *stratum)
    rest = ranked.select(*by, *stratum, (F.col("rx") - F.avg("rx").over(own)).alias("rx"), (F.col("ry") - F.avg("ry").over(own)).alias("ry"))
    sxy, sxx, syy = F.sum(F.col("rx") * F.col("ry")), F.sum(F.col("rx") * F.col("rx")), F.sum(F.col("ry") * F.col("ry"))
    return rest.groupBy(*by).agg(F.try_divide(sxy, F.sqrt(sxx * syy)).alias("association"), F.when(F.sqrt(sxx) <= 1e-12, "zero_within_stratum_residual_variance_predictor").when(F.sqrt(syy) <= 1e-12, "zero_within_stratum_residual_variance_outcome").alias("na_reason"))


def projected_precision(values: DataFrame, by: list[str], value: str, candidates: tuple[int, ...] = (20, 30, 40, 50)) -> DataFrame:
    """Normal full width of the mean for candidate numbers of graphs, from the sample variance."""
    spread = values.groupBy(*by).agg(F.var_samp(value).alias("variance"))
    width = 2 * 1.959963984540054 * F.sqrt(F.col("variance") / F.col("graphs"))
    return spread.withColumn("graphs", F.explode(F.array(*[F.lit(c) for c in candidates]))).select(*by, "graphs", "variance", width.alias("full_width"))


def grouped_quartiles(values: DataFrame, group: str, value: str, width: float = 64.0) -> DataFrame:
    """(group, total, middle, q1, q3, orders) rounded to two digits: sum, median, nearest-rank quartiles and rows, of each group and over all (a null group).

    No task holds a group's values: equal ones are counted together, counts are
    added up by bins of that width, and only bins that hold a wanted rank are ranked.
    """
    flag = F.explode(F.array(F.lit(False), F.lit(True))).alias("every")
    counted = values.groupBy(group, value).agg(F.count("*").alias("n"))
    both = counted.select(group, value, "n", flag).select("every", F.when(~F.col("every"), F.col(group)).alias(group), value, "n")
    counts = written(both.groupBy("every", group, value).agg(F.sum("n").alias("n")).withColumn("bin", F.floor(F.col(value) / width)), "value-counts")
    keys = F.struct("every", group).alias("key")
    known = counts.where(F.col(value).isNotNull()).select(keys, "bin", value, "n")
    before = lambda order, *by: F.coalesce(F.sum("n").over(Window.partitionBy("key", *by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = known.groupBy("key", "bin").agg(F.sum("n").alias("n")).withColumn("start", before("bin")).withColumn("size", F.sum("n").over(Window.partitionBy("key")))
    at = lambda share: F.greatest(F.ceil(F.col("size") * share), F.lit(1))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("what"), rank.cast("long").alias("rank")) for name, rank in (("q1", at(0.25)), ("q3", at(0.75)), ("low", F.floor((F.col("size") + 1) / 2)), ("high", F.floor(F.col("size") / 2) + 1))])).alias("r")
    wanted = bins.select("key", "bin", "start", "n", ranks).where((F.col("r.rank") > F.col("start")) & (F.col("r.rank") <= F.col("start") + F.col("n")))
    held = known.join(wanted.select("key", "bin").distinct(), ["key", "bin"], "left_semi").withColumn("inside", before(value, "bin"))
    found = held.withColumnRenamed("n", "times").join(wanted, ["key", "bin"]).withColumn("from", F.col("start") + F.col("inside"))
    found = found.where((F.col("r.rank") > F.col("from")) & (F.col("r.rank") <= F.col("from") + F.col("times")))
    of = lambda what: F.max(F.when(F.col("r.what") == what, F.col(value)))
    ranked = found.groupBy("key").agg(of("q1").alias("q1"), of("q3").alias("q3"), ((of("low") + of("high")) / 2).alias("middle"))
    total = values.groupBy(group).agg(F.sum(value).alias("total"), F.count("*").alias("orders")).withColumn("every", F.lit(False))
    total = total.unionByName(values.agg(F.sum(value).alias("total"), F.count("*").alias("orders")).withColumn("every", F.lit(True)).withColumn(group, F.lit(None).cast(values.schema[group].dataType)))
    own = total.withColumn("key", keys).join(ranked.withColumnRenamed("key", "ranked_key"), F.col("key").eqNullSafe(F.col("ranked_key")), "left")
    return own.select(group, F.round("total", 2).alias("total"), F.round("middle", 2).alias("middle"), F.round("q1", 2).alias("q1"), F.round("q3", 2).alias("q3"), "orders")
