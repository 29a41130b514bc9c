"""Every column that the queries of the operators promise, by brute force, on tables with nulls, empty and repeated texts."""

import hashlib
import re
import zlib
from collections import Counter
from math import log10

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

P = pytest.importorskip("public_tokenizers")

from test_operators import brute_components, leaks  # noqa: E402

import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from wayfold.llm import packing, queries, token_shards, toxicity  # noqa: E402

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
#: Added texts; documents get them from doc_id 900,001 on.
HARD = [
    None, "", " \t\n", "One", "one two  three", "\x1cfield é", "MIT License, cc by\nGNU General Public License; apache license", "cc by cc by-nc 4.0",
    "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "<|im_end|> \\ <|im_start|>", "w " * 5000, "twice said text of nine words in one row", "twice said text of nine words in one row",
]


@pytest.fixture(scope="module")
def hard(spark, small, tmp_path_factory):
    """The smallest tables with further rows, and a table with extra columns whose names operators use themselves."""
    at = tmp_path_factory.mktemp("hard")
    for name in TABLES:
        t = pq.read_table(f"{small}/{name}.parquet")
        if name == "documents":
            new = {"doc_id": [900_001 + k for k in range(len(HARD))], "text": HARD}
            t = pa.concat_tables([t, pa.table({f.name: pa.array(new.get(f.name, [None] * len(HARD)), f.type) for f in t.schema})])
        if name == "benchmark":
            t = pa.concat_tables([t, pa.table({"item_id": [77_001, 77_002, 77_003], "text": ["One", None, "text of NINE words"]}).cast(t.schema)])
        if name == "conversations":
            rows = [(5_000_001, 0, "user", None), (5_000_001, 1, "assistant", "a\\<|im_end|>\n"), (5_000_002, 0, None, "x"), (5_000_003, 0, "assistant", "")]
            t = pa.concat_tables([t, pa.table({f.name: pa.array([r[k] for r in rows], f.type) for k, f in enumerate(t.schema)})])
        pq.write_table(t, at / f"{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def docs(hard):
    return pq.read_table(f"{hard}/documents.parquet").to_pylist()


def remainder(doc_id, of):
    return zlib.crc32(str(doc_id).encode()) % of


def shown(v):
    return "null" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, hard, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{hard}/{t}.parquet'")
    df = queries.QUERIES[name](spark, hard)
    columns = sorted(df.columns)
    mine = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    assert mine == sorted(tuple(shown(v) for v in r) for r in con.sql(f"select {', '.join(columns)} from ({queries.ORACLE_SQL[name]})").fetchall())


def test_toxicity(spark, hard, docs):
    rows = {r.doc_id: r for r in queries.op1_toxicity(spark, hard).collect()}
    assert set(rows) == {d["doc_id"] for d in docs}
    for k, r in rows.items():
        assert r.held_out == (remainder(k, 4) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
    assert rows[900_001].score == rows[900_002].score == rows[900_003].score and rows[900_012].score == rows[900_013].score


def test_toxicity_never_reads_held_out_labels(spark, hard, tmp_path):
    """Other labels of held-out rows change nothing."""
    labels = queries.table(spark, hard, "labels")
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    table = queries.table(spark, hard, "documents")
    one, other = ({r.doc_id: r.score for r in toxicity.score_toxicity(table, queries.toxicity_model(table, of), keep=["doc_id"]).collect()} for of in (labels, flipped))
    assert one == other


def test_packing(spark, hard, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rows, sequences = {}, {}
    for r in queries.op2_packing(spark, hard).collect():
        rows.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(rows) == {d["doc_id"] for d in docs}
    for d in docs:
        ids = [*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(rows[d["doc_id"]], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_nearest(spark, hard):
    got = {}
    for r in queries.op5_nearest(spark, hard).collect():
        got.setdefault(r.query_id, []).append(r)
    table = pq.read_table(f"{hard}/embeddings.parquet")
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].to_pylist(), float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        near = u @ u[q]
        near[q] = -2
        own = sorted(got[ids[q]], key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, min(5, len(ids) - 1) + 1))
        assert all(abs(r.score - near[np.flatnonzero(ids == r.vec_id)[0]]) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        best = set(ids[np.lexsort((ids, -near))[:5]].tolist())
        hits, total = hits + len(best & {r.vec_id for r in own}), total + len(best)
    assert set(got) == set(ids[ids % 50 == 0].tolist()) and hits >= 0.9 * total


def test_lm_score(spark, hard, docs):
    cut = {d["doc_id"]: [*(d["text"] or "").encode().lower().split(), None] for d in docs}
    taught = Counter(w for k, own in cut.items() if remainder(k, 7) != 2 for w in own)
    n, v = sum(taught.values()), len(taught)
    rows = {r.doc_id: r for r in queries.op8_lm_score(spark, hard).collect()}
    assert set(rows) == set(cut)
    for k, own in cut.items():
        r = rows[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (remainder(k, 7) == 2, len(own), sum(w in taught for w in own), n)
        assert abs(r.base_score - sum(log10((taught[w] + 1) / (n + v + 1)) for w in own)) < 1e-6 and r.score < 0


def test_token_shards(spark, hard):
    """Slots, numbers and ids of the query: records of each input partition's documents, in a permuted order."""
    from tokenizers import Tokenizer

    tokenizer, parts = Tokenizer.from_file(P.path("word_bpe_49k.json")), {}
    for r in queries.table(spark, hard, "documents").select(F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"), "text").orderBy("at").collect():
        parts.setdefault(r.part, []).extend([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])
    expected = []
    for part in sorted(parts):
        ids = parts[part]
        for k in range(0, len(ids), 2047):
            record = np.zeros(2048, "<u2")
            record[: len(ids[k : k + 2047])] = ids[k : k + 2047]
            record[-1] = 1
            expected.append(zlib.crc32(record.tobytes()))
    rows = queries.op6_token_shards(spark, hard).collect()
    order = token_shards.Permutation(len(expected), 20_240_229)
    slots = order.walk(np.arange(len(expected))).tolist()
    assert sorted((r.number, r.slot, r.shard, r.ids_crc32) for r in rows) == [(k, s, s // 4096, crc) for k, (s, crc) in enumerate(zip(slots, expected))]


def test_license_scan(spark, hard, docs):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    rows = {r.doc_id: r for r in queries.op9_license_scan(spark, hard).collect()}
    assert set(rows) == {d["doc_id"] for d in docs}
    for d in docs:
        words = re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"] or ""))
        places = [(s, label) for p, label in phrases.items() for s in range(len(words)) if words[s : s + len(p.split())] == p.split()]
        base = {label for _, label in places}
        r = rows[d["doc_id"]]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted(base)))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert base <= set(r.labels.split(",")) | {""} and r.labels == ",".join(sorted(set(r.labels.split(",")))) and 0 <= r.score <= 1 and (r.score == 1) >= bool(base)
    assert rows[900_008].labels == "cc-by,cc-by-nc-4.0" and rows[900_009].labels == "isc-text"


def test_chat_of_control_strings(spark, hard):
    rows = {r.conv_id: r for r in queries.op10_chat(spark, hard).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    r = rows[-1]
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert rows[5_000_001].loss_chars == len("a\\<|im_end|>\n") and rows[5_000_003].loss_chars == 0 and rows[5_000_002].n_turns == 1


def test_pipeline_of_hard_rows(spark, hard):
    """Nulls, repeated ids and clashing columns: each stage keeps what brute force keeps, with the columns of its input."""
    table = queries.table(spark, hard, "documents")
    clashing = table.selectExpr("*", "'a' as gone", "'b' as component_id", "1 as score", "2 as id", "'c' as n_words", "3 as hits", "4 as tokens", "5 as label")
    clashing = clashing.unionByName(clashing.where("doc_id in (900001, 900005)"))
    kept = clashing
    texts = lambda df: sorted((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect())
    expected = texts(kept)
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{hard}/benchmark.parquet").to_pylist()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, hard)
        assert kept.columns == clashing.columns, name
        if name == "toxicity":
            scored = toxicity.score_toxicity(clashing, queries.toxicity_model(clashing, queries.table(spark, hard, "labels")), keep=["doc_id", "text"])
            expected = texts(scored.where("score < 0.3"))
        elif name == "ngram_jaccard":
            components, _ = brute_components([t for _, t in dict(expected).items()], list(dict(expected)))
            expected = [(i, t) for i, t in sorted(set(expected)) if components[i] == i]
            kept_ids = [i for i, _ in texts(kept)]
            assert set(kept_ids) == {i for i, _ in expected}
            expected = texts(kept)
        else:
            expected = [(i, t) for i, t in expected if not leaks(t, items)[1]]
        assert texts(kept) == expected, name
    assert set(packing.pack(kept, P.path("word_bpe_49k.json")).select("doc_id").distinct().toPandas()["doc_id"]) == {i for i, _ in expected}


@pytest.mark.parametrize("name", sorted([*queries.QUERIES, "pipeline"]))
def test_empty_tables(spark, hard, tmp_path, name):
    for t in TABLES:
        pq.write_table(pq.read_table(f"{hard}/{t}.parquet").slice(0, 0), tmp_path / f"{t}.parquet")
    rows = (queries.QUERIES | {"pipeline": corpus_pipeline.run})[name](spark, str(tmp_path)).collect()
    assert len(rows) == (1 if name == "op10_chat" else 0)
