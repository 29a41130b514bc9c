"""Associations of graph properties with routing outcomes, over whole families of hypotheses.

A family is one outcome of one model; its hypotheses are all pairs of a property
and a coordinate condition.  Each replicate has one permutation and one bootstrap
draw of graphs within strata, by digest, that all hypotheses of the family share,
so the largest statistic keeps their dependence.  Replicates are dealt in blocks
to tasks; within one, all hypotheses of all its replicates are matrix products.
A task holds one family's table, a row for each graph of a design.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.identities import property_seed
from wayfold.operators.inference import nearest_rank
from wayfold.operators.sampling import canonical
from wayfold.shipping import ship

#: A residual's size, relative to its values, under which it counts as constant.
CONSTANT = 1e-12
#: Permuted statistics that fall short of the observed by less than this reach it.
EQUAL = 1e-12
FEW, NO_X, NO_Y = "fewer_than_three_defined_graphs", "zero_within_stratum_residual_variance_predictor", "zero_within_stratum_residual_variance_outcome"
#: Numbers of one array that a task works on at once.
AT_ONCE = 2_000_000


def average_ranks(a: np.ndarray) -> np.ndarray:
    """Ranks from 1 along the second axis, ties sharing their mean."""
    a = np.moveaxis(a, 1, -1)
    order = np.argsort(a, axis=-1, kind="stable")
    held = np.take_along_axis(a, order, -1)
    place = np.broadcast_to(np.arange(a.shape[-1]), a.shape)
    new = np.concatenate([np.ones((*a.shape[:-1], 1), bool), held[..., 1:] != held[..., :-1]], -1)
    first = np.maximum.accumulate(np.where(new, place, 0), -1)
    last = np.concatenate([new[..., 1:], np.ones((*a.shape[:-1], 1), bool)], -1)
    end = np.flip(np.minimum.accumulate(np.flip(np.where(last, place, a.shape[-1]), -1), -1), -1)
    out = np.empty(a.shape)
    np.put_along_axis(out, order, (first + end) / 2 + 1, -1)
    return np.moveaxis(out, -1, 1)


class Strata:
    """Graphs in order of their strata."""

    def __init__(self, names: list[str]) -> None:
        cuts = [0, *(k for k in range(1, len(names)) if names[k] != names[k - 1]), len(names)]
        self.parts = [(names[a], slice(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]

    def residual_ranks(self, a: np.ndarray) -> np.ndarray:
        return np.concatenate([average_ranks(a[:, s]) for _, s in self.parts], 1)

    def correlations(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of x (replicates, graphs, properties) and y (replicates, graphs, conditions; NaN where undefined), each less its stratum's mean.

        Returns (replicates, properties, conditions), NaN where undefined, with the
        reason: 1 few graphs, 2 constant x, 3 constant y.  A graph counts for a
        condition where that is defined.
        """
        known = np.isfinite(y)
        shape = (max(len(x), len(y)), x.shape[2], y.shape[2])
        xy, xx, yy = np.zeros(shape), np.zeros(shape), np.zeros((len(y), 1, y.shape[2]))
        n = known.sum(1)[:, None, :]
        for _, s in self.parts:
            m = known[:, s].astype(float)
            size = np.maximum(m.sum(1), 1)[:, None, :]
            own = x[:, s] - x[:, s].mean(1, keepdims=True)
            rest = np.where(known[:, s], y[:, s], 0.0)
            rest = (rest - m * (rest.sum(1)[:, None, :] / size)) * m
            rest -= m * (rest.sum(1)[:, None, :] / size)
            turned = own.transpose(0, 2, 1)
            xy += turned @ rest
            xx += (turned**2) @ m - (turned @ m) ** 2 / size
            yy += (rest**2).sum(1)[:, None, :]
        width = lambda a: CONSTANT * np.sqrt(a.shape[1]) * np.nanmax(np.abs(np.where(np.isfinite(a), a, 0)), axis=1)
        flat_x, flat_y = np.sqrt(np.maximum(xx, 0)) <= width(x)[:, :, None], np.sqrt(yy) <= width(y)[:, None, :]
        why = np.where(n < 3, 1, np.where(flat_x, 2, np.where(flat_y, 3, 0)))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(why == 0, xy / np.sqrt(xx * yy), np.nan), why

    def rank_correlations(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The same of ranks within strata among a condition's defined graphs."""
        shape = (max(len(x), len(y)), x.shape[2], y.shape[2])
        out, whole = np.empty(shape), None
        for c in range(y.shape[2]):
            own = y[:, :, c : c + 1]
            known = np.isfinite(own)
            if known.all():
                whole = self.residual_ranks(x) if whole is None else whole
                ranked = whole
            else:
                ranked = self.residual_ranks(np.where(known, x, np.inf))
                ranked = np.where(known, ranked, 1.0)
            ry = np.where(known, self.residual_ranks(np.where(known, own, np.inf)), np.nan)
            out[:, :, c : c + 1] = self.correlations(ranked, ry)[0]
        return out

    def maps(self, first: int, count: int, seed_of) -> np.ndarray:
        """(replicates, graphs): which graph stands in each place, within strata; seed_of gives a stratum's generator for a replicate."""
        out = np.empty((count, self.parts[-1][1].stop), np.int64)
        for r in range(count):
            for name, s in self.parts:
                out[r, s] = s.start + seed_of(name, first + r, s.stop - s.start)
        return out


def generator(*identity: object) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(property_seed(*identity)))


def fingerprint(family: dict, properties: list[str], conditions: list[str], replicates: int, plan_hash: str) -> str:
    """SHA-256 of a family's hypotheses and of how they are tested."""
    own = {
        "plan": plan_hash, "family": family, "hypotheses": [{"property": p, "condition": c} for p in properties for c in conditions], "replicates": replicates, "alpha": 0.05,
        "permutation": "shared_within_stratum_maximum_absolute_correlation", "bootstrap": "shared_whole_graph_within_stratum", "missing": "preserved",
    }
    return hashlib.sha256(canonical(own)).hexdigest()


def property_associations(values: DataFrame, properties: list[str], family: list[str], *, replicates: int = 10_000, block: int = 250, plan_hash: str = "", draw_by: list[str] | None = None, least_defined: float = 0.95) -> DataFrame:
    """One row for each family, property and condition, from values (family columns, stratum, graph_id, condition_id, outcome, properties).

    association is the correlation of both less their stratum means, with a nearest-rank
    bootstrap interval (null where under least_defined of the draws are defined),
    rank_association the same of ranks within strata; p is the plus-one permutation
    p-value, family_p that of the largest statistic of all hypotheses.  Permutations
    follow from the family, bootstrap draws from the columns draw_by (the family's
    first by default), stratum and replicate.  A graph without an outcome doesn't count
    for its condition; an undefined association has na_reason and no p.  A
    (graph, condition) that is missing or twice in a family raises an error.  An empty
    table gives no rows.
    """
    spark = values.sparkSession
    ship(spark)
    keys, draw = list(family), draw_by or family[:1]
    listed = F.sort_array(F.collect_list(F.struct(F.col("stratum").cast("string").alias("stratum"), "graph_id", "condition_id", F.col("outcome").cast("double").alias("outcome"), F.array(*[F.col(p).cast("double") for p in properties]).alias("x"))))
    tables = values.groupBy(*keys).agg(listed.alias("rows"))
    blocks = tables.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // block) - 1))))
    fields = ", ".join(f"`{k}` {values.schema[k].dataType.simpleString()}" for k in keys)
    schema = f"{fields}, property string, condition_id string, graphs int, defined int, association double, rank_association double, na_reason string, fingerprint string, reached long, permuted long, family_reached long, family_permuted long, drawn array<double>, rank_drawn array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                yield block_of(row)

    def block_of(row: dict) -> pd.DataFrame:
        rows = list(row["rows"])
        places = list(dict.fromkeys((r["stratum"], r["graph_id"]) for r in rows))
        conditions = sorted({r["condition_id"] for r in rows})
        if len(rows) != len(places) * len(conditions) or len({g for _, g in places}) != len(places):
            raise ValueError("a family needs each graph once under each condition, in one stratum")
        at, spot = {p: k for k, p in enumerate(places)}, {c: k for k, c in enumerate(conditions)}
        x, y = np.zeros((1, len(places), len(properties))), np.full((1, len(places), len(conditions)), np.nan)
        for r in rows:
            k = at[r["stratum"], r["graph_id"]]
            x[0, k] = r["x"]
            if r["outcome"] is not None:
                y[0, k, spot[r["condition_id"]]] = r["outcome"]
        if not np.isfinite(x).all():
            raise ValueError("properties must be finite")
        strata = Strata([s for s, _ in places])
        observed, why = (a[0] for a in strata.correlations(x, y))
        ranked = strata.rank_correlations(x, y)[0]
        own = {k: row[k].item() if hasattr(row[k], "item") else row[k] for k in keys}
        first = int(row["block"]) * block
        count = min(block, replicates - first)
        reached, permuted, largest = np.zeros(observed.shape, np.int64), np.zeros(observed.shape, np.int64), []
        drawn, rank_drawn = [], []
        step = max(1, AT_ONCE // (len(places) * (len(properties) + len(conditions))))
        for r in range(first, first + count, step):
            some = min(step, first + count - r)
            moved = strata.maps(r, some, lambda s, k, n: generator(plan_hash, "permutation", own, s, k).permutation(n))
            stat = np.abs(strata.correlations(x, y[0][moved])[0])
            permuted += np.isfinite(stat).sum(0)
            reached += (stat >= np.abs(observed) - EQUAL).sum(0)
            largest.append(np.where(np.isfinite(stat), stat, -1).reshape(some, -1).max(1))
            again = strata.maps(r, some, lambda s, k, n: generator(plan_hash, "bootstrap", {c: own[c] for c in draw}, s, k).integers(0, n, n))
            drawn.append(strata.correlations(x[0][again], y[0][again])[0])
            rank_drawn.append(strata.rank_correlations(x[0][again], y[0][again]))
        top = np.concatenate(largest)
        top = top[top >= 0]
        drawn, rank_drawn = np.concatenate(drawn), np.concatenate(rank_drawn)
        value = lambda v: float(v) if np.isfinite(v) else None
        values_of = lambda a: [value(v) for v in a]
        mark = fingerprint(own, properties, conditions, replicates, plan_hash)
        out = []
        for p, name in enumerate(properties):
            for c, condition in enumerate(conditions):
                beyond = int((top >= abs(observed[p, c]) - EQUAL).sum()) if why[p, c] == 0 else 0
                out.append((*own.values(), name, condition, len(places), int(np.isfinite(y[0, :, c]).sum()), value(observed[p, c]), value(ranked[p, c]), (None, FEW, NO_X, NO_Y)[why[p, c]], mark,
                            int(reached[p, c]), int(permuted[p, c]), beyond, len(top), values_of(drawn[:, p, c]), values_of(rank_drawn[:, p, c])))
        return pd.DataFrame(out, columns=[f.split()[0].strip("`") for f in schema.split(", ")])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = blocks.repartition(max(parts, spark.sparkContext.defaultParallelism), *keys, "block").mapInPandas(run, schema)
    of = [*keys, "property", "condition_id"]
    each = found.select(*of, *[F.col(c) for c in ("graphs", "defined", "association", "rank_association", "na_reason", "fingerprint")], F.posexplode(F.arrays_zip("drawn", "rank_drawn")).alias("k", "d"), "reached", "permuted", "family_reached", "family_permuted")
    counted = lambda c: F.sum(F.when(F.col("k") == 0, F.col(c)))
    enough = lambda c: F.count(c) >= F.greatest(F.lit(2), F.ceil(F.lit(least_defined * replicates)))
    each = each.withColumn("value", F.col("d.drawn")).withColumn("rank_value", F.col("d.rank_drawn"))
    p = lambda hit, of_all: F.when(F.first("association").isNotNull(), (1 + counted(hit)) / (1 + counted(of_all)))
    return each.groupBy(*of).agg(
        F.first("graphs").alias("graphs"), F.first("defined").alias("defined"), F.first("association").alias("association"), F.first("rank_association").alias("rank_association"), F.first("na_reason").alias("na_reason"),
        *[F.when(enough(c), nearest_rank(q, c)).alias(f"{name}{side}") for c, name in (("value", ""), ("rank_value", "rank_")) for q, side in ((0.025, "low"), (0.975, "high"))],
        p("reached", "permuted").alias("p"), p("family_reached", "family_permuted").alias("family_p"), F.count("value").cast("long").alias("defined_draws"), F.first("fingerprint").alias("fingerprint"),
    )
