"""Finished runs: compressed route records in folders by condition and graph, read back with their checks.

A run's folders are partition columns, so a filter on condition or graph opens only
its folders; whatever else is asked of a record is pushed into the scan by column.
Nothing is trusted: broken lines, records outside the design, cells of the crossed
design without a record or with several, and records whose walk contradicts their
other fields are rows of the report.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["graph_id", "pair_index", "condition_id", "metric"]
#: A stored record; condition_id and graph_id are its folders.
RECORD = "pair_index int, metric string, source long, destination long, walk array<long>, hops int, decisions int, success boolean, failure string, broken string"
FIELDS = ["condition_id", "graph_id", *[f.split()[0] for f in RECORD.split(", ")][:-1]]
PROBLEMS = ("broken_record", "no_such_cell", "missing_cell", "repeated_cell", "other_ends", "wrong_length", "wrong_ending")


def write_run(routes: DataFrame, path: str) -> str:
    """Writes route records as compressed JSON lines under path/condition_id=C/graph_id=G; the folder must be new.

    Null fields are written, so each line has all fields.  Graphs are dealt over
    tasks; a graph and condition is one file, as large as its pairs.
    """
    named = routes.select(*FIELDS).repartition("condition_id", "graph_id").sortWithinPartitions("condition_id", "graph_id", "metric", "pair_index")
    named.write.partitionBy("condition_id", "graph_id").option("compression", "gzip").option("ignoreNullFields", "false").json(path)
    return path


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """The records of a run with its folders' columns and broken, the text of a line that isn't a record (its other fields are null)."""
    own = spark.read.schema(f"{RECORD}, condition_id string, graph_id string").option("columnNameOfCorruptRecord", "broken").option("mode", "PERMISSIVE").json(path)
    empty = F.col("broken").isNull() & F.col("pair_index").isNull()
    return own.withColumn("broken", F.when(empty, F.lit("{}")).otherwise(F.col("broken"))).select(*FIELDS, "broken")


def run_problems(records: DataFrame, pairs: DataFrame, conditions: DataFrame) -> DataFrame:
    """(graph_id, condition_id, problem, records) of every problem that occurs.

    The design is each pair under each of its graph's conditions (graph_id,
    condition_id, metric).  A walk must begin at the source, have hops + 1 nodes, and
    end at the destination just where it succeeds, without a failure.
    """
    design = pairs.select("graph_id", "pair_index", F.col("source").alias("s"), F.col("destination").alias("t")).join(conditions.select("graph_id", "condition_id", "metric"), "graph_id")
    whole = records.where("broken is null")
    counted = whole.groupBy(*KEYS).agg(F.count("*").alias("times"))
    cells = design.select(*KEYS).join(counted, KEYS, "left")
    of = lambda df, problem: df.groupBy("graph_id", "condition_id").agg(F.count("*").alias("records")).select("graph_id", "condition_id", F.lit(problem).alias("problem"), "records")
    placed = whole.join(design, KEYS)
    ended = F.coalesce(F.element_at("walk", -1) == F.col("destination"), F.lit(False))
    reports = [
        of(records.where("broken is not null"), "broken_record"), of(whole.join(design, KEYS, "left_anti"), "no_such_cell"), of(cells.where("times is null"), "missing_cell"), of(cells.where("times > 1"), "repeated_cell"),
        of(placed.where(~(F.col("source").eqNullSafe(F.col("s")) & F.col("destination").eqNullSafe(F.col("t")) & F.element_at("walk", 1).eqNullSafe(F.col("s")))), "other_ends"),
        of(placed.where(~(F.size("walk") - 1).eqNullSafe(F.col("hops"))), "wrong_length"),
        of(placed.where(~(F.col("success").eqNullSafe(ended) & F.col("failure").isNull().eqNullSafe(F.col("success")))), "wrong_ending"),
    ]
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


def payload_hashes(table: DataFrame, by: list[str], without: tuple[str, ...] = ()) -> DataFrame:
    """(by, rows, payload_sha256): a hash of each group's rows that doesn't depend on their order or partitions.

    Each row is its canonical JSON (columns in order of their names, nulls written, and
    none of the columns without, such as times); the four 56-bit lanes of its digest
    are added up over the group, so a repeated row counts as often as it is there.
    """
    columns = sorted(c for c in table.columns if c not in without)
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    lanes = [F.sum(F.conv(F.substring("digest", 14 * k + 1, 14), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"lane{k}") for k in range(4)]
    sums = table.select(*by, digest.alias("digest")).groupBy(*by).agg(F.count("*").alias("rows"), *lanes)
    return sums.select(*by, "rows", F.sha2(F.concat_ws(",", F.col("rows").cast("string"), *[F.col(f"lane{k}").cast("string") for k in range(4)]), 256).alias("payload_sha256"))


def compare_payloads(published: DataFrame, again: DataFrame, by: list[str], without: tuple[str, ...] = ()) -> DataFrame:
    """(by, published_rows, rows, state): 'same', 'changed', 'missing' (not made again) or 'unexpected' for each group."""
    a = payload_hashes(published, by, without).withColumnsRenamed({"rows": "published_rows", "payload_sha256": "published_sha256"})
    both = a.join(payload_hashes(again, by, without), by, "full")
    state = F.when(F.col("rows").isNull(), "missing").when(F.col("published_rows").isNull(), "unexpected").when(F.col("published_sha256") == F.col("payload_sha256"), "same").otherwise("changed")
    return both.select(*by, "published_rows", "rows", state.alias("state"))
