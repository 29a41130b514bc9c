"""Seeds, identities and small samples that follow from a design alone, by keyed digests of canonical JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2s

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.operators.sampling import SPACE, canonical, digest_number, unbiased
from wayfold.shipping import ship

#: Master seeds by domain, personal tags of the digests, versions, sizes of the samples.
MASTERS = {"graph": 11_000_003, "embedding": 12_000_003, "pairs": 13_000_003, "bootstrap": 14_000_003, "routing_priority": 15_000_017, "validation_sentinel": 16_000_019}
SEED_PERSON, SENTINEL_PERSON, PROPERTY_PERSON, AUDIT_PERSON, IDENTITY_PERSON, DOMAIN_PERSON = b"GRP2seed", b"GRP2sent", b"GRP2prop", b"GRP17aud", b"i2idv1", b"GRPseed1"
SEED_VERSION, GRAPH_VERSION, DOMAIN_ALGORITHM = 2, 3, "blake2s-32-domain-separated-v1"
PAIR_SCHEMA, PROPERTY_FAMILY, AUDIT_DOMAIN = "iteration2_pair_sampling_identity_v1", "iteration2_property_associations_v2", "step17_route_audit_v1"
ATTEMPTS, SENTINEL_PAIRS, AUDIT_PAIRS, CENSUS_ATTACHMENTS = 50, 5, 10, (4, 16)


def domain_seed(master: int, domain: str, *identity: str | int) -> int:
    """A 32-bit seed of the first protocol."""
    return digest_number({"algorithm": DOMAIN_ALGORITHM, "domain": domain, "identity": list(identity), "master_seed": master}, DOMAIN_PERSON, 4)


def seed(domain: str, identity: object, data_hash: str, master: int | None = None, size: int = 4) -> int:
    """A seed of the second protocol; data_hash is the frozen identity of the data."""
    own = MASTERS[domain] if master is None else master
    return digest_number({"identity_hash": data_hash, "seed_identity_version": SEED_VERSION, "domain": domain, "master": own, "identity": identity}, SEED_PERSON, size)


def property_seed(plan_hash: str, *identity: object) -> int:
    """Seed of the property associations' permutations."""
    return digest_number({"analysis_plan_hash": plan_hash, "seed_identity_version": SEED_VERSION, "master": MASTERS["bootstrap"], "family": PROPERTY_FAMILY, "identity": list(identity)}, PROPERTY_PERSON)


def sentinel_indices(graph_id: str, pair_count: int, data_hash: str) -> list[int]:
    """Pairs that the high-precision oracle walks again, drawn without a look at any outcome."""
    own = [graph_id, seed("validation_sentinel", graph_id, data_hash, size=8), "high_precision_routing_sentinel"]
    return unbiased(min(SENTINEL_PAIRS, pair_count), pair_count, SENTINEL_PERSON, {"identity_hash": data_hash, "seed_identity_version": SEED_VERSION, "identity": own})


def audit_indices(graph_id: str, pair_count: int, freeze_hash: str) -> list[int]:
    """Distinct pairs of the first protocol's audit; each number has a counter of its own for rejected words."""
    if pair_count < 1:
        return []
    limit, found, k = SPACE - SPACE % pair_count, {}, 0
    while len(found) < min(AUDIT_PAIRS, pair_count):
        own = {"combined_freeze_hash": freeze_hash, "counter": k, "domain": AUDIT_DOMAIN, "graph_id": graph_id}
        words = (digest_number({**own, "rejection_counter": r}, AUDIT_PERSON) for r in range(1 << 30))
        found.setdefault(next(w for w in words if w < limit) % pair_count)
        k += 1
    return list(found)


def identity_digest(domain: str, **fields: object) -> str:
    return blake2s(canonical({"domain": domain, **fields}), digest_size=16, person=IDENTITY_PERSON).hexdigest()


def _by_row(table: DataFrame, columns: list[str], fields: str, of: Callable[..., list[tuple]]) -> DataFrame:
    """Rows that of() makes from each row's columns."""
    ship(table.sparkSession)
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([r for row in batch.itertuples(index=False) for r in of(*[x.item() if hasattr(x, "item") else x for x in row])], columns=names)

    return table.select(*columns).mapInPandas(run, fields)


def graph_seeds(schedule: DataFrame, data_hash: str = "") -> DataFrame:
    """(graph_id, purpose, attempt, seed) of a schedule: model, n, m, replicate_index, graph_id; random graphs have a seed for each attempt."""

    def of(model: str, n: int, m: int, replicate: int, graph_id: str) -> list[tuple]:
        own = [model, n, m, replicate, graph_id]
        rows = [(graph_id, d, None, seed(d, own, data_hash)) for d in ("graph", "embedding", "pairs")]
        rows += [(graph_id, d, None, seed(d, graph_id, data_hash, size=8)) for d in ("routing_priority", "validation_sentinel")]
        attempts = range(ATTEMPTS if model == "erdos_renyi" else 0)
        return rows + [(graph_id, "er_attempt", k, seed("er_attempt", [*own, k], data_hash, MASTERS["graph"])) for k in attempts]

    own = _by_row(schedule, ["model", "n", "m", "replicate_index", "graph_id"], "graph_id string, purpose string, attempt double, seed decimal(20,0)", lambda *x: [(g, p, a, _decimal(s)) for g, p, a, s in of(*x)])
    return own.withColumn("attempt", F.when(~F.isnan("attempt"), F.col("attempt")).cast("int"))


def _decimal(x: int):
    from decimal import Decimal

    return Decimal(x)


def sentinel_pairs(schedule: DataFrame, pair_count: int = 1000, data_hash: str = "") -> DataFrame:
    """(graph_id, place, pair_index, census): sampled pairs of every graph, all pairs of the census graphs (replicate 0 of the sparsest and densest)."""

    def of(graph_id: str, m: int, replicate: int) -> list[tuple]:
        census = replicate == 0 and m in CENSUS_ATTACHMENTS
        return [(graph_id, k, i, census) for k, i in enumerate(range(pair_count) if census else sentinel_indices(graph_id, pair_count, data_hash))]

    return _by_row(schedule, ["graph_id", "m", "replicate_index"], "graph_id string, place int, pair_index int, census boolean", of)


def audit_pairs(schedule: DataFrame, pair_count: int = 1000, freeze_hash: str = "") -> DataFrame:
    """(graph_id, place, pair_index) of the first protocol's audit."""
    return _by_row(schedule, ["graph_id"], "graph_id string, place int, pair_index int", lambda g: [(g, k, i) for k, i in enumerate(audit_indices(g, pair_count, freeze_hash))])


def pair_identities(pairs: DataFrame, data_hash: str = "") -> DataFrame:
    """(graph_id, pair_index, identity): the digest that names a sampled pair."""

    def of(graph_id: str, k: int, source: int, destination: int) -> list[tuple]:
        return [(graph_id, k, identity_digest("pair_sampling", schema=PAIR_SCHEMA, data_generation_hash=data_hash, graph_id=graph_id, pair_index=k, source=source, destination=destination))]

    return _by_row(pairs, ["graph_id", "pair_index", "source", "destination"], "graph_id string, pair_index int, identity string", of)


def graph_identity(configuration: str, setting_index: str, setting_label: str, model: str, replicate: str):
    """Canonical JSON naming a graph of the first protocol, from columns; keys stand in order, so Spark's JSON is canonical too."""
    return F.to_json(F.struct(F.col(configuration).alias("configuration_name"), F.col(model).alias("model"), F.col(replicate).alias("replicate_index"), F.lit(GRAPH_VERSION).alias("seed_identity_version"), F.col(setting_index).alias("setting_index"), F.col(setting_label).alias("setting_label")))


def family_label(model: str, outcome: str):
    """Test family of a model's outcome, from columns."""
    return F.concat(F.when(F.col(model) == "erdos_renyi", "er").otherwise("ba"), F.when(F.col(outcome) == "success_contrast", "_success_contrast").otherwise("_common_success_stretch_contrast"))
