"""Source divergence, periodic runs and byte-level BPE against brute force, with nulls, empty, long and repeated rows, and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
RANKS = P.path("byte_bpe_50k.tiktoken")

from wayfold.llm import byte_bpe, divergence, periodicity, queries  # noqa: E402


def divergences(rows, least=10, top=10):
    """The audit by its definition, over every term of a language."""
    cut = [(lang or "", source or "", Counter(re.findall("[a-z\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))) for lang, source, text in rows]
    out = set()
    for lang in {x[0] for x in cut}:
        own = [(s, c) for x, s, c in cut if x == lang]
        docs = Counter(t for _, c in own for t in c)
        kept = sorted(t for t, n in docs.items() if n >= least)
        groups = defaultdict(Counter)
        for s, c in own:
            groups[s].update({t: n for t, n in c.items() if t in set(kept)})
        counts = {None: sum(groups.values(), Counter())} | groups
        share = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept} for s, c in counts.items()}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in groups:
            pairs = [(sum(f(share[s][t], share[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(share[s][t], share[None][t]), t) for t in kept if groups[s][t] and share[s][t] > share[None][t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, k) for k, (value, item) in enumerate(found if part == "pair" else found[:top], 1)}
    return out


@pytest.mark.parametrize("shards", [1, 7, None])
def test_divergence(spark, shards):
    rng = random.Random(3)
    vocabulary = ["one", "Two", "drei", "été", "zoë", "four4five", "x"] + [f"w{'abcdefgh'[k % 8] * (k // 8 + 1)}" for k in range(40)]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s0", "s0", "s1", "s2", "S3", "é", None]), " ".join(rng.choices(vocabulary, k=rng.randrange(0, 30)))) for _ in range(400)]
    rows += [("en", "empty", None), ("en", "empty", ""), ("fr", "alone", "un deux"), ("it", "a", "12 34"), ("it", "b", None), ("en", "s0", "one " * 30_000)] + [("xx", "same", "alpha beta")] * 6 + [("xx", "twin", "alpha beta")] * 6
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, n int").repartition(5)
    got = divergence.audit_sources(docs, shards=shards).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == divergences(rows)
    assert [tuple(r) for r in got if r.lang == "xx" and r.part == "pair"] and all(r.value == 0 for r in got if r.lang in ("xx", "it"))
    assert divergence.audit_sources(docs.limit(0), shards=shards).collect() == []


def runs(word, least_length, exponent):
    """Runs by comparing every word with the one q before, for each q."""
    out = {}
    for q in range(1, len(word) // exponent + 1):
        i = 0
        while i + q < len(word):
            j = i
            while j + q < len(word) and word[j] == word[j + q]:
                j += 1
            if j + q - i >= max(least_length, exponent * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, t, q) for (s, t), q in out.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_sequences():
    """Small alphabets, planted periods, all thresholds."""
    rng = random.Random(4)
    for _ in range(4000):
        word = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randrange(70))]
        if word and rng.random() < 0.5:
            p, a = rng.randrange(1, len(word) // 3 + 2), rng.randrange(len(word))
            word[a:] = [word[a + k % p] if a + k % p < len(word) else 0 for k in range(len(word) - a)]
        least, exponent = rng.choice([(6, 4), (6, 4), (1, 2), (5, 3)])
        assert periodicity.periodic_runs(word, least, exponent) == runs(word, least, exponent)


@pytest.mark.parametrize(("least", "exponent"), [(6, 4), (2, 2), (9, 3)])
def test_find_runs(spark, least, exponent):
    rng = random.Random(5)
    texts = [None, "", "  \n", "a", "a a a a a", "a a a a a a", "A a " * 6, "x\x1cy " * 8, " b" * 20_000, "ü ß " * 5 + "ü ß ü q " * 7]
    for _ in range(150):
        own = [f"w{rng.randrange(rng.choice([2, 4, 300]))}" for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            a, p, n = rng.randrange(len(own) + 1), rng.randrange(1, 12), rng.randrange(60)
            own[a:a] = [own[(a + k % p) % len(own)] if own else "z" for k in range(n)]
        texts.append(rng.choice([" ", "\n", "\t \r"]).join(own))
    texts += texts[-3:]
    docs = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, collapsed string, start string")
    rows = sorted(periodicity.find_runs(docs, least_length=least, least_exponent=exponent).collect(), key=lambda r: r.doc_id)
    assert len(rows) == len(texts) and rows[0].start == "y"
    for r, t in zip(rows, texts):
        word = (t or "").encode().split()
        found = [(x.start, x.start + x.length, x.period) for x in r.periodic_runs]
        gone = {i for s, e, q in found for i in range(s + q, e)}
        if len(word) < 5000:
            assert found == runs(word, max(least, 1), exponent)
        assert r.run_words == len(word) and r.collapsed == b" ".join(w for i, w in enumerate(word) if i not in gone).decode()
    with pytest.raises(ValueError):
        periodicity.find_runs(docs, least_exponent=1)


def test_runs_query(spark, small):
    """The words of the query's own texts, by its definition."""
    docs = queries.table(spark, small, "documents").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in queries.op12_periodic_runs(spark, small).collect()}
    assert len(rows) == len(docs)
    for d in docs:
        word, h = (d.text or "").encode().split(), zlib.crc32(str(d.doc_id).encode())
        n, g = len(word), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            word = [w if i < a else word[a + (i - a) % p] for i, w in enumerate(word)]
        found = runs(word, 6, 4) if h % 10 == 0 or len(set(word)) < n else []
        r = rows[d.doc_id]
        best = max(found, key=lambda x: ((x[1] - x[0]) / x[2], -x[0], -x[2]), default=None)
        assert (r.n_runs, r.start, r.length, r.period) == (len(found), *((best[0], best[1] - best[0], best[2]) if best else (None,) * 3))
        assert r.exponent_milli == (best and 1000 * (best[1] - best[0]) // best[2])
        gone = {i for s, e, q in found for i in range(s + q, e)}
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{e - s},{q}\n" for s, e, q in found).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(word) if i not in gone)).hexdigest()


@pytest.fixture(scope="module")
def known():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_texts():
    rng = random.Random(6)
    some = ["\x1c", "\x85", "\xa0", " ", "  ", "   ", "\n", " \n", "\n  ", "\r\n", "\x00", "a", "é", "9", "'s", "'", "!", "中", "😀", "the"]
    texts = [None, "", " ", "It's  the\n\n end.", "<|endoftext|>", "z" * 3000, "aa" * 2001, " " * 700 + "x", "the" * 900, "acgt" + "".join(rng.choice("acgt") for _ in range(20_000)), "Wörter, und. mehr " * 9000]
    return texts + ["".join(rng.choices(some, k=rng.randrange(1, 40))) for _ in range(400)] + ["the", "the", "xyzzyq" * 5]


def test_byte_bpe_round_trip(spark, known):
    texts = byte_texts()
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int").repartition(3)
    rows = byte_bpe.decode(byte_bpe.encode(docs, RANKS, P.PATTERN), RANKS).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = known.encode_ordinary(texts[r.doc_id] or "")
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == (texts[r.doc_id] or "").encode() == known.decode_bytes(ids)
    assert byte_bpe.decode(byte_bpe.encode(docs.limit(0), RANKS, P.PATTERN), RANKS).collect() == []


def test_one_pair_at_a_time(known):
    """The same ids where pairs of one rank are never contracted together, and where all pieces are rows."""
    texts = [t for t in byte_texts() if t is None or len(t) < 3001]
    one, both = byte_bpe.Coder(RANKS, P.PATTERN, False), byte_bpe.Coder(RANKS, P.PATTERN, True)
    assert one.encoded(pa.array(texts)) == both.encoded(pa.array(texts))
    pieces = sorted({p.encode() for t in texts if t for p in both.split(t) if len(p) < 60})
    assert one.short(pieces) == one.long(pieces) == both.long(pieces)


def test_byte_bpe_of_another_vocabulary(spark, tmp_path):
    """Ranks under which a longer token comes before its parts."""
    import tiktoken

    tokens = [bytes([b]) for b in range(256)] + [b"aba", b"ab", b"ba", b"abab", b"bab", b" a", b"bb"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate(tokens)))
    assert not byte_bpe.contracts_at_once(str(path))
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    rng = random.Random(7)
    texts = ["".join(rng.choices("ab ", k=n)) for n in (3, 9, 20, 40, 300) for _ in range(40)] + ["ab" * 90]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in byte_bpe.encode(docs, str(path), P.PATTERN).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == known.encode_ordinary(texts[r.doc_id])


def test_decode_refuses_unknown_ids(spark):
    rows = spark.createDataFrame([(1, None), (2, b"")], "doc_id long, ids binary")
    assert {r.doc_id: r.decoded for r in byte_bpe.decode(rows, RANKS).collect()} == {1: None, 2: b""}
    for broken in (np.uint32(60_000).tobytes(), b"abc"):
        with pytest.raises(Exception, match="vocabulary|whole"):
            byte_bpe.decode(rows.withColumn("ids", F.lit(broken)), RANKS).collect()


def test_byte_bpe_query(spark, small, known):
    texts = {r.doc_id: r.text or "" for r in queries.table(spark, small, "documents").collect()}
    for r in queries.op13_byte_bpe(spark, small).collect():
        ids = known.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
