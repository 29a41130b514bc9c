"""Deterministic samplers from keyed digests, and the frozen design as tables."""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import blake2s

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.shipping import ship

#: Fixed values of the design.
MODELS, SIZES, ATTACHMENTS, REPLICATES = ("erdos_renyi", "barabasi_albert"), (100, 300, 1000), (4, 8, 16), 20
SPACE = 1 << 64


def canonical(value: object) -> bytes:
    """JSON with sorted keys and no spaces, in ASCII."""
    return json.dumps(value, ensure_ascii=True, allow_nan=False, sort_keys=True, separators=(",", ":")).encode("ascii")


def digest_number(payload: object, person: bytes, size: int = 8) -> int:
    return int.from_bytes(blake2s(canonical(payload), digest_size=size, person=person).digest(), "big")


def unbiased(count: int, population: int, person: bytes, payload: dict, counter: str = "counter", distinct: bool = True) -> list[int]:
    """The first count accepted numbers below population, without replacement when distinct."""
    limit, out, seen, k = SPACE - SPACE % population, [], set(), 0
    while len(out) < count:
        word = digest_number({**payload, counter: k}, person)
        k += 1
        if word < limit and not (distinct and word % population in seen):
            out.append(word % population)
            seen.add(word % population)
    return out


def pair_of_index(n: Column, index: Column) -> list[Column]:
    """Source and destination of an ordered pair's number; a bijection with 0 .. n (n - 1) - 1."""
    source, rest = F.floor(index / (n - 1)).cast("long"), index % (n - 1)
    return [source.alias("source"), F.when(rest < source, rest).otherwise(rest + 1).alias("destination")]


def sample_pairs(graphs: DataFrame, count: int, person: bytes = b"pairs-v1") -> DataFrame:
    """(graph_id, pair_index, source, destination) from (graph_id, n, seed): distinct ordered pairs by digest."""
    ship(graphs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for g in batch.itertuples():
                index = unbiased(min(count, g.n * (g.n - 1)), g.n * (g.n - 1), person, {"graph_id": g.graph_id, "seed": int(g.seed)})
                yield pd.DataFrame({"graph_id": g.graph_id, "n": g.n, "pair_index": range(len(index)), "number": index})

    numbered = graphs.select("graph_id", "n", "seed").mapInPandas(run, "graph_id string, n long, pair_index int, number long")
    return numbered.select("graph_id", "pair_index", *pair_of_index(F.col("n"), F.col("number")))


def bootstrap_draws(strata: DataFrame, replicates: int, person: bytes = b"boot-v1") -> DataFrame:
    """(stratum columns, replicate, position, drawn) by digest, from strata with a column graphs."""
    keys = [c for c in strata.columns if c != "graphs"]
    ship(strata.sparkSession)
    parts = int(strata.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = strata.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).repartition(parts, *keys, "replicate")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spread.schema if f.name != "graphs")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                own = {k: (int(v) if hasattr(v, "item") else v) for k, v in r.items() if k != "graphs"}
                rows += [{**own, "position": p, "drawn": unbiased(1, int(r["graphs"]), person, {**own, "position": p})[0]} for p in range(int(r["graphs"]))]
            yield pd.DataFrame(rows, columns=[*keys, "replicate", "position", "drawn"])

    return spread.mapInPandas(run, f"{fields}, position int, drawn int")


def schedule(spark: SparkSession) -> DataFrame:
    """The full design in order: schedule_index, model, n, m, replicate_index, graph_id."""
    values = lambda xs: F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("v")) for k, x in enumerate(xs)]))
    grid = spark.range(1).select(values(MODELS).alias("a")).select("a", values(SIZES).alias("b")).select("a", "b", values(ATTACHMENTS).alias("c")).select("a", "b", "c", F.explode(F.sequence(F.lit(0), F.lit(REPLICATES - 1))).alias("r"))
    index = ((F.col("a.k") * len(SIZES) + F.col("b.k")) * len(ATTACHMENTS) + F.col("c.k")) * REPLICATES + F.col("r")
    prefix = F.when(F.col("a.k") == 0, "er").otherwise("ba")
    return grid.select(index.alias("schedule_index"), F.col("a.v").alias("model"), F.col("b.v").alias("n"), F.col("c.v").alias("m"), F.col("r").alias("replicate_index"), F.format_string("%s_n%04d_m%02d_rep%03d", prefix, "b.v", "c.v", "r").alias("graph_id"))


def matched_p(n: Column, m: Column) -> Column:
    """Edge probability whose expected degree equals that of attachment with m edges."""
    return 2 * m * (n - m) / (n * (n - 1))


def seed_collisions(seeds: DataFrame, column: str = "seed") -> DataFrame:
    return seeds.groupBy(column).agg(F.count("*").alias("uses")).where("uses > 1")


def workload(design: DataFrame, pairs: int = 1000) -> DataFrame:
    """Counts that follow from the design alone."""
    return design.agg(F.count("*").alias("graphs"), (F.count("*") * pairs).alias("shortest_paths"), (F.count("*") * pairs * 15).alias("i1_routes"), (F.count("*") * pairs * 28).alias("i2_routes"), F.sum(F.col("n") * (F.col("n") - 1) / 2 * 7).cast("long").alias("distortion_pairs"))
