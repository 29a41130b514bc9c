"""Operators against brute force and round trips, with nulls, empty and repeated rows, and clashing columns."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
TOKENIZER = P.path("word_bpe_49k.json")

from wayfold.llm import ann, chat, decontaminate, license_scan, lm_score, ngram_join, packing, token_shards, toxicity, url_filter  # noqa: E402

ROWS = "doc_id long, text string, n_words string, score string, id long"


def documents(spark, texts, ids=None):
    """Documents with extra columns that clash with what operators add."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y", 7) for i, t in zip(ids, texts)], ROWS)


def empty(spark):
    return spark.createDataFrame([], ROWS)


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


TEXTS = [None, "", "   ", "one", "Größe naïve <|endoftext|> x's 12 don't!", "a,b. c\nd\t\te  f?!", "Wörter, und. mehr\nZeilen;", "z" * 3000, " nbsp em é"]


def test_packing_round_trip(spark):
    rng = random.Random(1)
    texts = [*TEXTS, " ".join(words(rng, 5000)), " ".join(words(rng, 5000))]
    rows = packing.pack(documents(spark, texts), TOKENIZER).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.length & (r.length - 1) == 0 and r.length <= 2048 and r.offset == 0 and r.length == len(r.ids) // 4 == 1 << r.bucket
        assert r.start == len(by.setdefault(r.doc_id, []))
        by[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
        assert r.doc_tokens >= len(by[r.doc_id])
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, t in enumerate(texts):
        assert by[i] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    assert packing.pack(empty(spark), TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty(spark), TOKENIZER, longest=100)


def test_packing_null_and_repeated_ids(spark):
    rows = packing.pack(documents(spark, ["a", "a", None], [None, 3, 3]), TOKENIZER).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0) == [(False, 3, 1), (False, 3, 2), (True, 0, 2)]


def leaks(text, items):
    import re

    cut = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    own, hit, found = cut(text), set(), set()
    for i, t in items:
        w = cut(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            window = w[k : k + 10]
            for a in range(len(own) - len(window) + 1):
                if own[a : a + len(window)] == window:
                    hit |= set(range(a, a + len(window)))
                    found.add(str(i))
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("bound", [1 << 20, 60])
def test_decontamination(spark, bound):
    rng = random.Random(2)
    item = words(rng, 14)
    items = [(1, " ".join(item)), (10, "Short Item é"), (2, None), (3, "..."), (4, " ".join(item[2:13])), (None, "w1")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [None, "", "short, ITEM -- é!", "x " + ", ".join(item).upper() + " y short item", " ".join(item[:9]), "éshort item é short item é", " ".join(item[:12] + item[1:12])]
    rows = decontaminate.find_leaks(documents(spark, texts), benchmark, bound=bound).collect()
    for r in rows:
        n, hit, found = leaks(texts[r.doc_id], [i for i in items if i[0] is not None])
        assert (r.n_words, r.n_hit, r["items"]) == (n, hit, found), r.doc_id
        assert r.score == "y" and sum(len(leaks(texts[r.doc_id][h.start : h.end], items)[:1]) for h in r.hits) == len(r.hits)
    kept = decontaminate.without_leaks(documents(spark, texts), benchmark, bound=bound)
    assert kept.columns == documents(spark, texts).columns and sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in rows if r.n_hit == 0)
    assert decontaminate.find_leaks(empty(spark), benchmark).count() == 0
    assert all(r.n_hit == 0 for r in decontaminate.find_leaks(documents(spark, texts), benchmark.limit(0)).collect())
    spans = {r.doc_id: [texts[r.doc_id][h.start : h.end] for h in r.hits] for r in rows}
    assert spans[2] == ["short, ITEM -- é"]


def brute_components(texts, ids):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(ids[a]), find(ids[b])))
                parent[y] = x
    return {i: find(i) for i in ids}, [len(s) for s in sets]


def test_ngram_join(spark):
    rng = random.Random(3)
    texts = [None, "", "a b", "A  B", "a b c d e", "a b c d e", "\x1cx y", "x y"]
    for _ in range(6):
        base = words(rng, 120, 10**6)
        for _ in range(25):
            own = list(base)
            for _ in range(rng.randrange(9)):
                k = rng.randrange(len(own))
                own[k : k + rng.randrange(2)] = words(rng, 1, 10**6)
            texts.append(" ".join(own))
    line = " ".join(words(rng, 30))
    texts += [line + " " + " ".join(words(rng, rng.randrange(5, 60))) for _ in range(120)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    expected, sizes = brute_components(texts, ids)
    rows = ngram_join.join_ngrams(documents(spark, texts, ids).repartition(5)).collect()
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert {r.doc_id: r.n_shingles for r in rows} == dict(zip(ids, sizes))
    kept = ngram_join.without_copies(documents(spark, texts, ids))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in expected.items() if i == c)
    assert ngram_join.join_ngrams(empty(spark)).count() == 0 and ngram_join.without_copies(empty(spark)).count() == 0


def test_ngram_join_repeated_and_null_ids(spark):
    docs = documents(spark, ["a b c d e f", "a b c d e f", "p q r s t u", "p q r s t u", "m n o"], [5, 9, 9, 2, None])
    rows = ngram_join.join_ngrams(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in rows) == [(0, 0), (2, 2), (5, 2), (9, 2), (9, 2)]
    assert sorted(r.doc_id or 0 for r in ngram_join.without_copies(documents(spark, ["a b", "a b", "c d", None], [1, 1, 2, None])).collect()) == [0, 1, 2]


def test_maximal_segments():
    rng = np.random.default_rng(4)
    for _ in range(200):
        steps = rng.normal(-0.3, 1, rng.integers(1, 40))
        found = toxicity.segments(steps)
        sums = np.concatenate(([0], np.cumsum(steps)))
        best = max((sums[b] - sums[a] for a in range(len(steps)) for b in range(a + 1, len(steps) + 1)))
        assert (max((s for _, _, s in found), default=0.0) == pytest.approx(max(best, 0.0))) or best <= 0
        for a, b, s in found:
            assert s == pytest.approx(sums[b] - sums[a]) and s > 0 and all(sums[k] > sums[a] for k in range(a + 1, b + 1)) and all(sums[k] < sums[b] for k in range(a, b))
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def test_toxicity_held_out(spark):
    rng = random.Random(5)
    bad = ["blarg", "snork", "zibber"]
    texts, labels = [], []
    for k in range(600):
        own = words(rng, 60)
        if toxic := k % 6 == 0:
            for _ in range(4):
                own[rng.randrange(60)] = rng.choice(bad)
        texts.append(" ".join(own))
        labels.append((k, 1 if toxic else 0))
    texts += [None, "", "Blarg, snork BLARG zibber"]
    docs = documents(spark, texts)
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"), F.col("id") % 7 != 0)
    rows = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all((rows[k].score >= 0.3) == bool(t) for k, t in labels) and all(0 <= r.score <= 1 for r in rows.values())
    assert rows[600].score == rows[601].score < 0.3 and rows[602].score > 0.3 and rows[602].n_words == "x"
    assert [texts[602][p.start : p.end] for p in rows[602].passages] == ["Blarg, snork BLARG zibber"]
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.score < 0.3 for r in rows.values())
    none = toxicity.fit(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_toxicity(docs, none).where("score between 0 and 1").count() == len(texts)


def test_nearest_recall_and_order(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    x = (centres[rng.integers(12, size=3000)] + 0.7 * rng.normal(size=(3000, 16))).astype(np.float32)
    x[7] = x[4]
    x[9] = x[4]
    rows = [(i, v.tolist(), 1.0) for i, v in enumerate(x)] + [(5000, None, 1.0), (5050, [0.0] * 16, 1.0), (5001, [float("nan")] * 16, 1.0), (None, [1.0] * 16, 1.0), (5002, [], 1.0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")
    got = ann.nearest(table, lambda i: i % 50 == 0).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    for q in range(0, 3000, 50):
        s = u @ u[q]
        s[q] = -9
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        assert all(abs(r.score - s[r.vec_id]) < 1e-12 for r in own)
        hits += len({r.vec_id for r in own} & set(np.lexsort((np.arange(3000), -s))[:5].tolist()))
    assert {r.query_id for r in got} == set(range(0, 3000, 50)) and hits / 300 >= 0.9
    few = ann.nearest(table.where("vec_id in (0, 4, 7, 9)"), lambda i: i == 4).orderBy("rank").collect()
    assert [r.vec_id for r in few] == [7, 9, 0]
    assert ann.nearest(table.limit(0), lambda i: i == 4).count() == 0


def test_toxic_log_odds_by_brute_force(spark):
    """Every word keeps its log-odds, negative ones too; a beginning counts where several words share it."""
    rng = random.Random(15)
    ends = [f"hate{x}" for x in "abcdef"]
    rows = []
    for k in range(400):
        own = words(rng, 30, 80) + (["calm"] if k % 5 and k % 2 else [])
        rows.append((" ".join(own + ([rng.choice(ends)] if k % 5 == 0 else [])), k % 2, int(k % 5 == 0)))
    counts = toxicity.class_counts(spark.createDataFrame(rows, "text string, fold int, toxic int"))
    model, first, _ = toxicity.fit_models(counts)
    for m, folds in ((model, (0, 1)), (first, (1,))):
        taught = [(set(t.split()), y) for t, f, y in rows if f in folds]
        y0, y1 = (Counter(w for t, y in taught if y == label for w in t) for label in (0, 1))
        all0, all1 = sum(y0.values()), sum(y1.values())
        x = all1 / (all0 + all1)
        scores = toxicity.WordScores(m)
        for w in set(y0) | set(y1):
            if w in ends:
                continue
            weak = math.log((y1[w] + toxicity.NEUTRAL * x) / x) - math.log((y0[w] + toxicity.NEUTRAL * (1 - x)) / (1 - x))
            assert abs(scores[w.encode()] + toxicity.DRIFT - max(toxicity.WEAKEST, min(toxicity.STRONGEST, weak))) <= 0.5 / toxicity.GRAIN + 1e-9, w
    scores = toxicity.WordScores(model)
    assert scores[b"calm"] < -0.5 and scores[b"hateq"] == scores[b"hateqq"] >= toxicity.LEAST_ODDS and scores[b"unheard"] == -toxicity.DRIFT
    assert sum(p * math.exp(model.lam * s) for s, p in [(-1.0, 1.0)]) < 1 and 0 < model.k <= 1


def test_toxic_scores_share_few_slots(spark, monkeypatch):
    counts = spark.createDataFrame([(k * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63), 0, 0, 5 if k % 3 else 500, 1 if k % 3 else 0, 5, 0) for k in range(1, 3000)], "word long, p4 long, p5 long, y00 long, y01 long, y10 long, y11 long")
    monkeypatch.setattr(toxicity, "MOST_SLOTS", 1 << 13)
    model = toxicity.fit_models(counts)[0]
    common = [model.looked_up(r.word) for r in counts.where("y00 = 500").collect()]
    assert len(set(common)) == 1 and common[0] < toxicity.ZERO  # rarer words never hide commoner ones


def test_nearest_searches_part_of_the_rows():
    """Candidates of a query are fewer than all rows from some hundred rows on."""
    rng = np.random.default_rng(16)
    centres = rng.normal(size=(60, 24))
    x = ann.unit(centres[rng.integers(60, size=4000)] + 0.3 * rng.normal(size=(4000, 24)))
    forest = ann.grow(x, ann.TREES, max(ann.LEAF_SAMPLE, min(ann.LEAF_ROWS, len(x) // 100)))
    leaf = forest.leaf_of(x)
    found = forest.search(x[:40], 16)
    hits = rows = 0
    for k, leaves in enumerate(found):
        candidates = np.flatnonzero(np.isin(leaf, leaves).any(axis=1))
        s = x @ x[k]
        s[k] = -9
        hits += len(set(np.argsort(-s)[:5].tolist()) & set(candidates.tolist()))
        rows += len(candidates)
    assert hits / 200 >= 0.9 and rows / 40 < 0.1 * len(x)


def test_nearest_by_brute_force(spark):
    """With all leaves searched the nearest are those of brute force: repeated ids and rows, ties, several blocks of queries."""
    rng = np.random.default_rng(19)
    x = rng.integers(-2, 3, size=(900, 4)).astype(float)
    ids = np.r_[np.arange(600), rng.integers(600, 640, size=300)]
    rows = [(int(i), v.tolist(), "x", 1) for i, v in zip(ids, x)]
    rows += rows[:40] + [(700, [1.0, 2.0, 0.0, 0.0], "x", 1)] * 700
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, near string, leaf int")
    asked = lambda i: i % 3 == 0
    expected = {}
    sound = [(i, np.array(v)) for i, v, *_ in {(i, tuple(v)) for i, v, *_ in rows} if any(v)]
    for i, v in sound:
        for j, w in sound if i % 3 == 0 else ():
            if j != i:
                key = (i, j)
                expected[key] = max(expected.get(key, -2.0), (v * w).sum() / (np.linalg.norm(v) * np.linalg.norm(w)))
    by = {}
    for (i, j), s in expected.items():
        by.setdefault(i, []).append((-round(s, 9), j))
    got = {}
    for r in ann.nearest(table, asked, probes=10**6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-round(r.score, 9), r.vec_id))
    assert {q: [s for s, _ in v] for q, v in got.items()} == {q: [s for s, _ in sorted(v)[:5]] for q, v in by.items()}
    whole = {q: dict((j, s) for s, j in v) for q, v in by.items()}
    assert all(whole[q][j] == s and len({j for _, j in v}) == len(v) for q, v in got.items() for s, j in v)


def test_nearest_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(20)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 8)))], "vec_id long, embedding array<double>")
    one = ann.nearest(table, lambda i: i % 10 == 0).orderBy("query_id", "rank").collect()
    for name, value in [("QUERY_ROWS", 30), ("MEET_ROWS", 17), ("HELD_PAIRS", 50), ("EXACT_BYTES", 640)]:
        monkeypatch.setattr(ann, name, value)
    many = ann.nearest(table, lambda i: i % 10 == 0).orderBy("query_id", "rank").collect()
    assert len(one) == 350 and [r[:3] for r in one] == [r[:3] for r in many] and [r.score for r in one] == [r.score for r in many]


def test_nearest_of_very_large_and_small_vectors(spark):
    rows = [(0, [1e200, 0.0]), (1, [1e200, 1e199]), (2, [2.0**-700, 2.0**-703]), (3, [0.0, 1e-300]), (4, [-1e300, 1e300])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4]
    assert all(abs(r.score - e) < 1e-12 for r, e in zip(got, [1 / math.sqrt(1.01), 1 / math.sqrt(1 + 1 / 64), 0.0, -math.sqrt(0.5)]))


def test_nearest_of_each_length(spark):
    rows = [(k, [1.0, k / 10, 0.5]) for k in range(12)] + [(90, [1.0, 2.0]), (91, [1.0, 2.5])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(table, lambda i: (i == 4) | (i == 90), k=3)
    found = {q: [r.vec_id for r in got.orderBy("rank").collect() if r.query_id == q] for q in (4, 90)}
    assert sorted(found[4][:2]) == [3, 5] and len(found[4]) == 3 and found[90] == [91]


@pytest.mark.parametrize("n", [1, 2, 5, 1000, 4097])
def test_permutation(n):
    order = token_shards.Permutation(n, 99)
    slots = order.walk(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and order.walk(slots, back=True).tolist() == list(range(n))


def test_token_shards_round_trip(spark, tmp_path):
    rng = random.Random(7)
    texts = [*TEXTS, *[" ".join(words(rng, rng.randrange(400))) for _ in range(60)]]
    docs = documents(spark, texts).coalesce(1)
    path = token_shards.materialise(docs, TOKENIZER, f"file://{tmp_path}/out", length=64, shard_rows=16)
    facts = token_shards.manifest(spark, path)
    rows = token_shards.read_sequences(spark, path).collect()
    assert sorted(r.slot for r in rows) == list(range(facts["sequences"])) and all(len(r.ids) == 128 for r in rows)
    stream = np.concatenate([np.frombuffer(r.ids, "<u2")[:-1] for r in sorted(rows, key=lambda r: r.number)])
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(TOKENIZER)
    expected = [i for t in texts for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]]
    assert stream[: len(expected)].tolist() == expected and not stream[len(expected) :].any()
    part = token_shards.read_sequences(spark, path, 20, 37).collect()
    assert {r.slot: bytes(r.ids) for r in part} == {r.slot: bytes(r.ids) for r in rows if 20 <= r.slot < 37}
    assert {f.split("/shard=")[1].split("/")[0] for f in token_shards.read_sequences(spark, path, 20, 22).inputFiles()} == {"1"}
    for shard in {r.shard for r in rows}:  # a file is its records in slot order and nothing else
        (file,) = (tmp_path / "out" / f"shard={shard}").glob("part-*")
        assert file.read_bytes() == b"".join(bytes(r.ids) for r in sorted(rows, key=lambda r: r.slot) if r.shard == shard)
    gone = token_shards.materialise(empty(spark), TOKENIZER, f"file://{tmp_path}/none")
    assert token_shards.read_sequences(spark, gone).count() == 0


def test_token_shards_are_whole(spark, tmp_path):
    """A bound on records a file doesn't split a shard; cut, repeated and missing shards are told, each where it is read."""
    rng = random.Random(9)
    docs = documents(spark, [" ".join(words(rng, 200)) for _ in range(30)])
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "3")
    try:
        path = token_shards.materialise(docs, TOKENIZER, f"file://{tmp_path}/out", length=64, shard_rows=16)
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    n = token_shards.manifest(spark, path)["sequences"]
    slots = [r.slot for r in token_shards.read_sequences(spark, path).collect()]
    assert n > 48 and sorted(slots) == list(range(n))
    (file,) = (tmp_path / "out" / "shard=1").glob("part-*")
    data = file.read_bytes()
    for crc in (tmp_path / "out" / "shard=1").glob(".*.crc"):
        crc.unlink()
    for broken in (data[:-128], data[:-5], data + data[:128], b""):
        file.write_bytes(broken)
        with pytest.raises(ValueError, match="manifest"):
            token_shards.read_sequences(spark, path)
        assert token_shards.read_sequences(spark, path, 0, 16).count() == 16
    file.write_bytes(data)
    (tmp_path / "out" / "shard=1" / "part-again").write_bytes(data)
    with pytest.raises(ValueError, match="manifest"):
        token_shards.read_sequences(spark, path, 20, 30)
    (tmp_path / "out" / "shard=1" / "part-again").unlink()
    (tmp_path / "out" / "shard=2").rename(tmp_path / "out" / "gone")
    with pytest.raises(ValueError, match="manifest"):
        token_shards.read_sequences(spark, path)


def test_other_tokenizers(spark):
    """A tokenizer that keeps white space gives its own ids of whole texts."""
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own, texts = Tokenizer.from_file(path), [*TEXTS, "two  spaces \n and lines", " lead"]
    pieces = {}
    for r in sorted(packing.pack(documents(spark, texts), path).collect(), key=lambda r: (r.doc_id, r.start)):
        pieces.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert all(pieces[k] == [*own.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(texts))


def test_url_filter(spark):
    entries = [("bad.example.com", "block", "2024-01-10"), ("bad.example.com", "allow", "2024-02-10"), ("Example.com", "review", "2024-01-20"), ("x.com", "block", "2024-01-01"), ("x.com", "allow", "2024-01-01"), (None, "block", "2024-01-01"), ("y.com", "block", None)]
    captures = [(1, "http://www.bad.example.com/a", "2024-01-09"), (2, "https://u:p@WWW.bad.example.com:80/", "2024-01-10"), (3, "http://bad.example.com.?q", "2024-02-10"), (4, "http://notbad.example.com", "2024-01-20"), (5, "http://notexample.com", "2024-03-01"), (6, None, "2024-03-01"), (7, "http://x.com", None), (8, "http://x.com", "2024-01-01"), (8, "http://x.com", "2024-01-01"), (9, "nonsense", "2024-01-01"), (10, "http://y.com", "2024-05-01")]
    dated = lambda rows, names: spark.createDataFrame(rows, names).withColumn(names[-1], F.to_date(names[-1]))
    out = url_filter.filter_urls(dated(captures, ["page_id", "url", "fetched"]).withColumn("host", F.lit("old")).withColumn("at", F.lit(1)), dated(entries, ["domain", "action", "since"]))
    rows = out.collect()
    assert sorted((r.page_id, r.action) for r in rows) == [(1, "allow"), (2, "block"), (3, "allow"), (4, "review"), (5, "allow"), (6, "allow"), (7, "allow"), (8, "block"), (8, "block"), (9, "allow"), (10, "allow")]
    assert {r.page_id: r.host for r in rows}[2] == "www.bad.example.com" and out.columns == ["page_id", "url", "fetched", "at", "host", "action", "domain", "since"]
    assert {r.page_id: r.domain for r in rows}[3] == "bad.example.com"


def test_lm_score(spark, monkeypatch):
    rng = random.Random(8)
    texts = [None, "", "The  the x", *[" ".join(words(rng, 40, 60)) for _ in range(80)]]
    docs = documents(spark, texts)
    cut = [(t or "").encode().lower().split() + [b"\0end"] for t in texts]
    train = [k for k in range(len(texts)) if zlib.crc32(str(k).encode()) % 7 != 2]
    c = Counter(w for k in train for w in cut[k])
    n, v = sum(c.values()), len(c)
    base = [sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own) for own in cut]
    learn = F.crc32(F.col("id").cast("string")) % 7 != 2
    one = {r.doc_id: r for r in lm_score.score(docs, learn).collect()}
    for k, own in enumerate(cut):
        assert (one[k].n_tokens, one[k].n_known, one[k].train_tokens) == (len(own), sum(c[w] > 0 for w in own), n) and abs(one[k].base_score - base[k]) < 1e-9 and one[k].score < 0
    # brute force by the same levels; false mass lowers a token's probability by FALSE_SHARE at most, false pairs are rare
    pairs = Counter(x for k in train for x in zip([b"\0end", *cut[k][:-1]], cut[k]))
    level = lambda n: lm_score.levels(np.array([n]))
    low, high = lambda n: int(lm_score.low_count(level(n))[0]), lambda n: int(lm_score.high_count(level(n))[0])
    exact = []
    for own in cut:
        total = 0.0
        for h, w in zip([b"\0end", *own[:-1]], own):
            p = (low(c[w]) + 1) / (n + v + 1)
            total += math.log10((low(pairs[h, w]) + 300 * p) / (high(c[h]) + 300))
        exact.append(total)
    slack = math.log10(1 + 2 * lm_score.FALSE_SHARE)
    assert all(abs(one[k].score - exact[k]) <= len(cut[k]) * slack + 1e-9 for k in one)
    routed = {r.doc_id: r for r in lm_score.score(docs, learn, broadcast_bytes=0).collect()}
    assert all(abs(routed[k].score - one[k].score) < 1e-9 and routed[k][:3] == one[k][:3] for k in one)
    monkeypatch.setattr(lm_score, "HEAD_WORDS", 10)  # most words meet their counts in the join
    many = {r.doc_id: r for r in lm_score.score(docs, learn).collect()}
    for k in one:
        assert many[k].n_known == one[k].n_known and abs(many[k].base_score - base[k]) < 1e-9 and abs(many[k].score - one[k].score) < 1e-9
    nothing = lm_score.score(docs, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.base_score == 0 for r in nothing)
    assert lm_score.score(empty(spark), learn).count() == 0


def test_lm_probabilities_sum_to_one_at_most(spark):
    rng = random.Random(18)
    texts = spark.createDataFrame([(" ".join(f"w{int(rng.paretovariate(0.6)) % 20_000}" for _ in range(3000)),) for _ in range(40)], "text string")
    own = np.concatenate([lm_score.tokens(pa.array([r.text]))[0] for r in texts.collect()])
    vocabulary, n = np.unique(own, return_counts=True)
    bits, probes = 3, lm_score.probes_for(len(vocabulary))
    counts = lm_score.counted(texts, bits)
    segments = lm_score.built(counts, probes)
    lookup = lm_score.whole(segments, bits, probes)
    false = len(vocabulary) * np.mean([r.filled**probes for r in segments.collect() if r.part >> bits == lm_score.PAIR])
    assert false <= 2 * lm_score.FALSE_SHARE * lm_score.PAIR_PRIOR
    single = lookup.level(lm_score.word_keys(vocabulary), lm_score.WORD)
    assert (lm_score.low_count(single) > n).mean() < 0.03 and (lm_score.high_count(single) >= n).all()
    p = (lm_score.low_count(single) + 1) / (len(own) + len(vocabulary) + 1)
    order = np.argsort(n)
    for h in [*order[:20], *order[len(order) // 2 :][:20], *order[-20:]]:
        level = lookup.level(lm_score.pair_keys(np.full(len(vocabulary), vocabulary[h]), vocabulary), lm_score.PAIR)
        total = ((lm_score.low_count(level) + lm_score.PAIR_PRIOR * p) / (lm_score.high_count(single[h]) + lm_score.PAIR_PRIOR + false)).sum()
        assert 0.5 < total <= 1.01, total


def test_filter_levels():
    counts = np.array([1, 2, 3, 4, 5, 7, 100, 12345, 10**9])
    level = lm_score.levels(counts)
    assert (lm_score.low_count(level) <= counts).all() and (counts <= lm_score.high_count(level)).all() and lm_score.low_count(np.array([0]))[0] == 0


def test_license_scan(spark):
    texts = [None, "", "MIT License and the GNU  general, public license. mit license", "Licensed under CC BY-NC 4.0.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "permission is hereby granted"]
    rows = {r.doc_id: r for r in license_scan.scan_licenses(documents(spark, texts)).collect()}
    assert sorted((b.label, b.first_word) for b in rows[2].base) == [("gpl", 4), ("mit", 0), ("mit", 8)]
    assert [b.label for b in rows[3].base] == ["cc-by"] and [b.label for b in rows[3].notices] == ["cc-by-nc-4.0"]
    assert [b.label for b in rows[4].notices] == ["mit-text"] and rows[4].notices[0].score > 0.99 and not rows[5].notices and not rows[0].base and rows[0].n_words == 0
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def test_chat_trees(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "a", 0.1), (1, 3, 1, "assistant", "b<|im_end|>\\<|\n", 0.9), (1, 4, 3, "user", None, 0.5), (1, 5, 4, "assistant", "", 0.5), (1, 6, 2, "user", "dead end", 0.2),
            (2, 1, 99, "us\ner\\", "lost parent", None), (2, 1, 99, "us\ner\\", "lost parent", None), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (None, 1, None, "user", "nowhere", 1.0), (4, None, None, "user", "no id", 1.0)]
    table = spark.createDataFrame(rows, "conv_id long, id long, parent long, role string, text string, score double").withColumn("turn", F.lit(0))
    out = chat.format_conversations(table)
    out = out.select("*", chat.parsed_turns(F.col("formatted")).alias("parsed"), chat.trained_text(F.col("formatted"), F.col("loss_spans")).alias("trained"))
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == {1, 2, 3} and got[3].root == 1 and [t.text for t in got[3].parsed] == ["cycle", "cycle"] and [tuple(t) for t in got[1].parsed] == [("user", "q"), ("assistant", "b<|im_end|>\\<|\n"), ("user", ""), ("assistant", "")]
    assert got[1].trained == "b<|im_end|>\\<|\n" and len(got[1].loss_spans) == 2 and got[1].leaf == 5 and got[1].n_turns == 4
    assert [tuple(t) for t in got[2].parsed] == [("us\ner\\", "lost parent")]
    assert sorted(r.leaf for r in chat.format_conversations(table, branches=2).where("conv_id = 1").collect()) == [5, 6]
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_chat_cycles(spark):
    """Random parents: each cycle is cut at its smallest id, no conversation and no message without a path is lost."""
    rng = random.Random(12)
    rows = [(t, i, rng.choice([None, i, *range(12)]), "user", f"{i}", 1.0) for t in range(40) for i in rng.sample(range(12), rng.randrange(1, 12))]
    table = spark.createDataFrame(rows, "conv_id long, id long, parent long, role string, text string, score double")
    found = {}
    for r in chat.format_conversations(table, branches=99).select("conv_id", "root", chat.parsed_turns(F.col("formatted")).alias("t")).collect():
        found.setdefault(r.conv_id, []).append((r.root, [int(t.text) for t in r.t]))
    for t in range(40):
        parent = {i: p for tree, i, p, *_ in rows if tree == t}
        cut = set()
        for i in parent:
            seen, at = [], i
            while at in parent and at not in seen:
                seen.append(at)
                at = parent[at]
            if at == i and i == min(seen):
                cut.add(i)
        up = {i: None if i in cut or p not in parent else p for i, p in parent.items()}
        leaves = [i for i in up if i not in up.values()]
        paths = []
        for leaf in leaves:
            path = [leaf]
            while up[path[-1]] is not None:
                path.append(up[path[-1]])
            paths.append((path[-1], path[::-1]))
        assert sorted(found[t]) == sorted(paths)


def test_chat_long_chain(spark):
    rows = spark.range(300).select(F.lit(1).alias("conv_id"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(1.0).alias("score"))
    (row,) = chat.format_conversations(rows).select("n_turns", chat.parsed_turns(F.col("formatted")).alias("t")).collect()
    assert row.n_turns == 300 and [t.text for t in row.t] == [str(k) for k in range(300)]


def test_queries_digest(spark, small):
    from wayfold.llm import queries

    rows = queries.op10_chat(spark, small).collect()
    table = {}
    for r in spark.read.parquet(f"{small}/conversations.parquet").collect():
        table.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    for r in rows:
        if r.conv_id != -1:
            turns = sorted(table[r.conv_id])
            assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
            assert r.loss_sha256 == hashlib.sha256("".join(t for _, a, t in turns if a == "assistant").encode()).hexdigest()


def test_word_ids():
    """Ids of odd words are the tokenizer's own; case and stops make no new words; what comes up again stays known."""
    rng, ids = random.Random(5), packing.WordIds(TOKENIZER)
    parts = [*"AKwtJYhéÉßÿŸİıſΣς한ﬁ²½_-=<>.,#$%&*'1", "K", "̱", "̌", "̸", "́", "ᄀ", "ᅡ", "<|endoftext|>", "<|ENDOFTEXT|>", "'LL", "...", "?!", "the", "The", " ", "\n", "\t", "\r", "\x0b", "\x1c", "\x85", "\xa0", " ", "​", "\0"]
    odd = [None, "", " \n", *("".join(rng.choices(parts, k=rng.randrange(14))) for _ in range(5000))]
    got, edges = ids.of(pa.array(odd))
    assert ids.wordwise and [got[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == ids.encoded([t or "" for t in odd])
    learned, learn = [], ids.learn
    ids.learn = lambda words: learned.extend(words) or learn(words)
    ids.of(pa.array(["Onthe onTHE\nonthe### ONTHE.", "ätzthe&&&\tätzthe"]))
    assert sorted(w for w in learned if "the" in w) == ["onthe", "ätzthe"]


def test_word_ids_cache(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 50)
    ids, learned = packing.WordIds(TOKENIZER), []
    learn = ids.learn
    ids.learn = lambda words: learned.extend(words) or learn(words)
    for k in range(40):
        ids.of(pa.array([" ".join(["steady", *("q" + chr(97 + k % 26) * (j + k // 26 * 9 + 1) for j in range(9))])]))
    assert learned.count("steady") == 1 and len(ids.known) <= 50 and len(ids.before) <= 50


def test_toxicity_tables_on_the_driver(spark, monkeypatch):
    """The models share one table of commonness; what was sent out to fit the curve doesn't stay."""
    rng = random.Random(8)
    texts = [" ".join([*words(rng, 30), *["vile"] * (k % 5 == 0)]) for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(200)], "doc_id long, toxic int")
    sent, send = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append((send(self, value), value)) or sent[-1][0])
    model = toxicity.fit(documents(spark, texts), labels)
    [(shared, halves)] = sent
    assert not shared._jbroadcast.isValid()
    assert all(half.common[row] is model.common[row] for half in halves for row in (0, 1))
    word, _, _ = toxicity.features(b"vile")
    assert model.looked_up(word) >= toxicity.CLEAR
