"""Queries of the operators over the whole synthetic tables."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.llm import ann, byte_bpe, chat, decontaminate, divergence, license_scan, lm_score, ngram_join, packing, periodicity, token_shards, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(of: int):
    """crc32 of the id as text, modulo."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Learned from rows that aren't held out."""
    return toxicity.fit(docs, labels, F.crc32(F.col("id").cast("string")) % 4 != 2)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity_model(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_ngrams(table(spark, sf_dir, "documents"))


#: DuckDB's expression for a text with A-Z in lower case; null is empty.
LOWER_SQL = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

OP3_SQL = f"""
with recursive cut as (
  select doc_id, [x for x in string_split_regex({LOWER_SQL}, '[\\x20\\x09-\\x0D]+') if x <> ''] as words from documents),
placed as (select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as k from cut where len(words) > 0),
shingles as (select distinct doc_id, array_to_string(words[k:k + 4], ' ') as shingle from placed),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
links as (select p.a, p.b from pairs p join sizes x on p.a = x.doc_id join sizes y on p.b = y.doc_id where 100 * p.n >= 80 * (x.n + y.n - p.n)),
reach as (select doc_id, doc_id as other from documents union select r.doc_id, l.b from reach r join links l on r.other = l.a),
least as (select doc_id, min(other) as component_id from reach group by doc_id)
select d.doc_id, coalesce(s.n, 0)::bigint as n_shingles, l.component_id from documents d join least l using (doc_id) left join sizes s using (doc_id)
"""


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    digest = F.sha2(F.concat_ws(",", "items"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP4_SQL = f"""
with cut as (select doc_id, regexp_extract_all({LOWER_SQL}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as words from documents),
items as (select item_id::varchar as item, regexp_extract_all({LOWER_SQL}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as words from benchmark where item_id is not null),
starts as (select item, words, least(len(words), 10) as size, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as k from items where len(words) > 0),
windows as (select distinct item, size, array_to_string(words[k:k + size - 1], ' ') as span from starts),
sizes as (select distinct size from windows),
places as (select doc_id, words, size, unnest(range(1, len(words) - size + 2)) as k from cut, sizes where len(words) >= size),
found as (select p.doc_id, p.k, p.size, w.item from places p join windows w on p.size = w.size and array_to_string(p.words[p.k:p.k + p.size - 1], ' ') = w.span),
hits as (select doc_id, count(distinct place) as n from (select doc_id, unnest(range(k, k + size)) as place from found) group by doc_id),
named as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from found) group by doc_id)
select c.doc_id, len(c.words)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(m.n, 0)::bigint as n_items, sha256(coalesce(m.items, '')) as items_sha256, h.n is not null as contaminated
from cut c left join hits h using (doc_id) left join named m using (doc_id)
"""


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_shards.materialise(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_shards.read_sequences(spark, path).select("slot", "shard", "number", F.crc32("ids").alias("ids_crc32"))


#: Listed names and their domains, and the days (from FIRST_DAY) on which entries for the k-th domain are dated.
LISTED = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
TOP_DOMAINS = ("example.com", "example.net", "example.org")
FIRST_DAY, DAYS = "2024-01-01", 366


def url_list(spark: SparkSession) -> DataFrame:
    """Dated entries: each domain is blocked, some are allowed again, some of those blocked anew; one whole domain is under review for a time."""
    rows = [f"('{name}.{top}', '{action}', {day})" for k, (name, top) in enumerate((n, t) for n in LISTED for t in TOP_DOMAINS)
            for action, day in [("block", 11 * k), *([("allow", 11 * k + 90)] if k % 2 == 0 else []), *([("block", 11 * k + 150)] if k % 4 == 0 else [])]]
    rows += ["('example.org', 'review', 200)", "('example.org', 'allow', 260)"]
    return spark.sql(f"select domain, action, date_add(date '{FIRST_DAY}', day) as since from values {', '.join(rows)} as t(domain, action, day)")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    fetched = F.expr(f"date_add(date '{FIRST_DAY}', cast(pmod(page_id, {DAYS}) as int))")
    captures = table(spark, sf_dir, "pages").select("page_id", "url", fetched.alias("fetched"))
    return url_filter.filter_urls(captures, url_list(spark)).select("page_id", "fetched", "host", "action", "domain", "since")


OP7_SQL = f"""
with listed as (
  select n.name || '.' || t.top as domain, (n.k * {len(TOP_DOMAINS)} + t.k)::int as k
  from (values {', '.join(f"('{n}', {k})" for k, n in enumerate(LISTED))}) n(name, k), (values {', '.join(f"('{t}', {k})" for k, t in enumerate(TOP_DOMAINS))}) t(top, k)),
entries as (
  select domain, 'block' as action, 11 * k as day from listed
  union all select domain, 'allow', 11 * k + 90 from listed where k % 2 = 0
  union all select domain, 'block', 11 * k + 150 from listed where k % 4 = 0
  union all select * from (values ('example.org', 'review', 200), ('example.org', 'allow', 260)) v(domain, action, day)),
valid as (select domain, action, day, coalesce(lead(day) over (partition by domain order by day), 1000000) as next_day from entries),
captures as (
  select page_id, (page_id % {DAYS})::int as day, nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '.'), '') as host from pages),
found as (
  select c.page_id, c.day, c.host, v.action, v.domain, v.day as since_day,
         row_number() over (partition by c.page_id order by length(v.domain) desc nulls last) as place
  from captures c left join valid v on (c.host = v.domain or ends_with(c.host, '.' || v.domain)) and v.day <= c.day and c.day < v.next_day)
select page_id, date '{FIRST_DAY}' + day as fetched, host, coalesce(action, 'allow') as action, domain, date '{FIRST_DAY}' + since_day as since from found where place = 1
"""


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(table(spark, sf_dir, "documents"), F.crc32(F.col("id").cast("string")) % 7 != 2)
    return scored.select("doc_id", F.coalesce(remainder(7) == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base, notices = F.col("base"), F.col("notices")
    labels = lambda *of: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(x, lambda p: p["label"]) for x in of]))), ",")
    starts = F.transform(base, lambda p: p["first_word"])
    best = F.array_max(F.transform(F.concat(base, notices), lambda p: p["score"]))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(base, notices).alias("labels"), F.least(F.coalesce(best, F.lit(0.0)), F.lit(1.0)).alias("score"),
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = f"{chat.END}{chat.START}assistant ok"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(control).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    place = F.row_number().over(order).cast("long")
    chain = rows.withColumn("id", place).withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)).withColumn("score", F.lit(1.0))
    out = chat.format_conversations(chain)
    turns = F.transform(chat.parsed_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.withColumn("trained", chat.trained_text(F.col("formatted"), F.col("loss_spans"))).select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP10_SQL = """
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
  union all select -1, 0, 'user', '{end}{start}assistant ok' union all select -1, 1, 'assistant', '{end}{start}assistant ok'),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as place from turns),
marked as (
  select *, length(replace(replace(text, '{esc}', '{esc}{esc}'), '<|', '<{esc}|')) + length(replace(replace(replace(role, '{esc}', '{esc}{esc}'), '<|', '<{esc}|'), chr(10), '{esc}n')) as escaped from placed)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by place) filter (role = 'assistant'), '')) as loss_sha256,
  (sum(escaped) + count(*) * ({marks} + 2))::bigint as formatted_chars
from marked group by conv_id
""".format(end=chat.END, start=chat.START, esc=chat.ESCAPE, marks=len(chat.START) + len(chat.END))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit_sources(table(spark, sf_dir, "documents"))


#: Every term of a language for every group and for the language itself, as the definition has it.
OP11_SQL = f"""
with docs as (select row_number() over () as d, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all({LOWER_SQL}, '[a-z\\x{{80}}-\\x{{10FFFF}}]+') as words from documents),
said as (select d, lang, source, unnest(words) as term from docs),
counts as (select lang, source, term, count(*) as n from said group by all),
kept as (select lang, term from said group by all having count(distinct d) >= {divergence.LEAST_DOCUMENTS}),
sizes as (select lang, count(*) as v from kept group by all),
groups as (select distinct lang, source from docs),
dense as (
  select g.lang, g.source, k.term, coalesce(c.n, 0)::hugeint as n from groups g join kept k using (lang) left join counts c using (lang, source, term)
  union all select k.lang, null, k.term, sum(c.n) from kept k join counts c using (lang, term) group by all),
totals as (select lang, source, sum(n) as total from dense group by all),
shares as (
  select x.lang, x.source, x.term, x.n, (1 + {divergence.SCALE}::hugeint * (x.n + 2) // (t.total + 2 * s.v))::bigint as p
  from dense x join totals t on t.lang = x.lang and t.source is not distinct from x.source join sizes s on s.lang = x.lang),
pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value from shares a join shares b using (lang, term) where a.source <> b.source group by all),
terms as (
  select a.lang, a.source, a.term as item, ((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value
  from shares a join shares b using (lang, term) where a.source is not null and b.source is null and a.n > 0 and a.p > b.p),
ranked as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0) as value from groups a join groups b using (lang) left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source where a.source <> b.source
  union all select lang, source, 'term', item, value from terms),
placed as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from ranked)
select lang, source, part, item, value, rank from placed where part = 'pair' or rank <= {divergence.TOP_TERMS}
"""

#: White space between words, as Java's pattern.
SPACE = r"[\\x20\\x09-\\x0D]+"


def with_period(docs: DataFrame) -> DataFrame:
    """doc_id and text; of each tenth document the words from the a-th on repeat the next p."""
    words = f"filter(split(text, '{SPACE}'), w -> w <> '')"
    h = "crc32(cast(doc_id as string))"
    n, g = "cardinality(words)", f"({h} div 10)"
    repeated = f"transform(words, (w, i) -> if(i < {g} % {n}, w, words[cast({g} % {n} + (i - {g} % {n}) % (1 + ({n} - {g} % {n}) div (3 + {g} % 8)) as int)]))"
    chosen = docs.select("doc_id", F.expr(f"if({h} % 10 = 0, {words}, null)").alias("words"), "text")
    return chosen.select("doc_id", F.expr(f"if({n} > 0, array_join({repeated}, ' '), text)").alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodicity.find_runs(with_period(table(spark, sf_dir, "documents")), keep=["doc_id"])
    # quotients of different lengths and periods differ by more than a double's last place
    best = F.expr("array_max(transform(periodic_runs, r -> struct(r.length / r.period as exponent, -r.start as start, -r.period as period, r.length as length)))")
    listed = F.expr("array_join(transform(periodic_runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("periodic_runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Stretches of triples that come again q words later, joined to runs; crc32 by a table of its 256 steps.
OP12_SQL = r"""
with crc_steps as (select list_transform(range(256), lambda x: list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) as steps),
hashed as (
  select doc_id, [x for x in string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] as words,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1])), 4294967295) as h
  from documents, crc_steps),
sized as (select *, len(words) as n, case when h % 10 = 0 and len(words) > 0 then (h // 10) % len(words) end as a from hashed),
changed as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from sized),
cut as (
  select row_number() over () as d, doc_id, n, case when a is null then words else list_transform(range(n), lambda i: words[1 + case when i < a then i else a + (i - a) % p end]) end as words from changed),
triples as (select d, n, k - 1 as spot, words[k] || ' ' || words[k + 1] || ' ' || words[k + 2] as triple from (select d, n, words, unnest(range(1, n - 1)) as k from cut where n >= 6)),
again as (select x.d, x.spot, y.spot - x.spot as q from triples x join triples y on x.d = y.d and x.triple = y.triple and y.spot > x.spot and 4 * (y.spot - x.spot) <= x.n),
chains as (select d, q, spot, spot - row_number() over (partition by d, q order by spot) as chain from again),
repeats as (select d, min(spot) as start, max(spot) - min(spot) + 3 + q as length, q from chains group by d, q, chain),
runs as (select d, start, length, min(q) as period from repeats where length >= greatest(6, 4 * q) group by all),
listed as (
  select d, count(*) as n_runs, max({'e': length / period, 's': -start, 'p': -period, 'l': length}) as best, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as runs
  from runs group by d),
gone as (select distinct d, unnest(range(start + period, start + length)) as spot from runs),
lists as (select d, list(spot) as gone from gone group by d)
select c.doc_id, coalesce(l.n_runs, 0)::bigint as n_runs, (-l.best.s)::bigint as start, l.best.l::bigint as length, (-l.best.p)::bigint as period, ((1000 * l.best.l) // (-l.best.p))::bigint as exponent_milli,
  sha256(coalesce(l.runs, '')) as runs_sha256,
  sha256(coalesce(array_to_string(case when g.gone is null then c.words else list_transform(list_filter(range(n), lambda i: not list_contains(g.gone, i)), lambda i: c.words[i + 1]) end, ' '), '')) as collapsed_sha256
from cut c left join listed l using (d) left join lists g using (d)
"""


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, keep=["doc_id"])
    return byte_bpe.decode(coded, ranks).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_ngram_join": op3_ngram_join,
    "op4_decontamination": op4_decontamination,
    "op5_nearest": op5_nearest,
    "op6_token_shards": op6_token_shards,
    "op7_url_filter": op7_url_filter,
    "op8_lm_score": op8_lm_score,
    "op9_license_scan": op9_license_scan,
    "op10_chat": op10_chat,
    "op11_divergence": op11_divergence,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_byte_bpe": op13_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {"op3_ngram_join": OP3_SQL, "op4_decontamination": OP4_SQL, "op7_url_filter": OP7_SQL, "op10_chat": OP10_SQL, "op11_divergence": OP11_SQL, "op12_periodic_runs": OP12_SQL}
