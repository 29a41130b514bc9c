"""Audit of how the sources of a language differ, by sharded SQL counts.

Tasks count the terms of their documents by language and source, already summed
in DuckDB before anything is shuffled.  The rows are dealt by a hash of language
and term to shards, in each of which DuckDB sums counts, keeps frequent terms,
and later makes partial sums for pairs of sources and the shard's leading terms;
Spark merges sums and rankings.

Shares are whole numbers: p = 1 + floor(SCALE * (count + 2) / (N + 2 V)).  The
distance of two shares is floor((p - q)^2 / (p + q)).  A pair's sum runs over all
V terms of its language, most of which one of both lacks.  With p0 for a count of
zero, f(p, q) = [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)] + [f(p, q0) - f(p0, q0)]
+ [f(p0, q) - f(p0, q0)] + f(p0, q0), so that shards add up the first bracket over
terms which both have; the others follow from how often each count occurs in a
source.  No table of terms times sources is made, and no total is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfold.llm._base import dropped, in_arrow, in_duck, in_groups, slices, texts, written

LEAST_DOCUMENTS, SCALE, TOP_TERMS = 10, 1_000_000_000, 10
#: Counted rows that a task holds before it sums them and sends them on.
HELD_ROWS = 200_000

#: Rows of kept terms in a shard that makes partial sums: their number follows the rows, so that sums for each pair of sources stay few.
SHARD_ROWS = 500_000

#: Maps A-Z to a-z and every other ASCII byte that is no letter to a space; bytes from 0x80 stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

COUNTS = """
select d.lang, d.source, decode(w.term) as term, sum(k)::bigint as n, count(*) as docs
from (select doc, word, count(*) as k from placed group by all) p join docs d on p.doc = d.doc join words w on p.word = w.word group by all
"""

SUMS = "select lang, source, term, sum(n)::bigint as n, sum(docs)::bigint as docs from counts group by all"

#: Without a term: a row for each group of the shard, so that groups without kept terms stay.
KEPT = f"""
with summed as ({SUMS}), frequent as (select lang, term, sum(n)::bigint as all_n from summed where term is not null group by all having sum(docs) >= {{least}})
select shard, lang, source, term, n, all_n, (row_number() over (partition by lang, term order by source) = 1)::bigint as leads
from summed join frequent using (lang, term), (select any_value(shard) as shard from counts)
union all select shard, lang, source, null, 0, 0, 0 from summed, (select any_value(shard) as shard from counts) where term is null
"""

SHARED = f"""
with shares as (
  select lang, source, term,
    (1 + {SCALE}::hugeint * (n + 2) // (total + 2 * v))::bigint as p, (1 + {SCALE}::hugeint * 2 // (total + 2 * v))::bigint as p0, (1 + {SCALE}::hugeint * (all_n + 2) // (lang_total + 2 * v))::bigint as q
  from counts),
pairs as (
  select a.lang, a.source, b.source as item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p) - ((a.p - b.p0) * (a.p - b.p0)) // (a.p + b.p0)
    - ((a.p0 - b.p) * (a.p0 - b.p)) // (a.p0 + b.p) + ((a.p0 - b.p0) * (a.p0 - b.p0)) // (a.p0 + b.p0))::bigint as value
  from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source < b.source group by all),
over as (select lang, source, term as item, ((p - q) * (p - q)) // (p + q) as value from shares where p > q)
select 'pair' as part, lang, source, item, value from pairs
union all select 'term', lang, source, item, value from over qualify row_number() over (partition by lang, source order by value desc, item) <= {{top}}
"""


def counted(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, summed within a task; a row without a term for each group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> list[pa.RecordBatch]:
            rows = in_duck(SUMS, counts=pa.concat_tables(held))
            held.clear()
            return rows.to_batches(max_chunksize=50_000)

        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                own = [t.translate(LETTERS).split() for t in texts(part.column(2))]
                sizes = [len(w) for w in own]
                word = pa.array([w for ws in own for w in ws], pa.binary()).dictionary_encode()
                doc = pa.array(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes))
                table = pa.table({"doc": pa.array(range(part.num_rows), pa.int32()), "lang": part.column(0), "source": part.column(1)})
                words = pa.table({"word": pa.array(range(len(word.dictionary)), pa.int32()), "term": word.dictionary})
                held.append(in_duck(COUNTS, placed=pa.table({"doc": doc, "word": word.indices}), docs=table, words=words))
                held.append(in_duck("select distinct lang, source, null::varchar as term, 0::bigint as n, 0::bigint as docs from docs", docs=table))
                if sum(t.num_rows for t in held) > HELD_ROWS:
                    yield from summed()
        if held:
            yield from summed()

    named = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    return in_arrow(docs.select(*named), run, "lang string, source string, term string, n long, docs long")


def share(count: str, total: str) -> F.Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 v)), exact; null where the language keeps no term."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({count} + 2 as decimal(20, 0))) div nullif(cast({total} + 2 * v as decimal(20, 0)), 0)")


def apart(p: str, q: str) -> F.Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def audit_sources(docs: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS, shards: int | None = None) -> DataFrame:
    """(lang, source, part, item, value, rank), rank from 1 within group and part, by value descending, then item.

    Part 'pair' holds every other source of the language with the distance of both
    over all terms in at least least_documents of its documents; part 'term' the
    group's top_terms terms by distance from the language, among those it uses
    more.  Null language, source and text are ''.  A group without terms counts
    zero everywhere; a language without kept terms has distances of 0.  Each row
    is a document, so repeated rows count anew; ties go to the smaller item by its
    UTF-8 bytes.  An empty table gives no rows.  There are as many shards as input
    partitions, or more, so that a shard is no larger than what a task sends; partial
sums are made in as many as the kept rows need.
    """
    shards = shards or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * docs.rdd.getNumPartitions())
    dealt = counted(docs, lang_col, source_col, text_col).withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)))
    kept_sql = KEPT.format(least=int(least_documents))
    kept = written(in_groups(dealt, ["shard"], lambda rows: in_duck(kept_sql, counts=rows), "shard long, lang string, source string, term string, n long, all_n long, leads long"), "kept-terms")
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("leads").alias("leads"))
    groups = written(sums.join(sums.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("leads").alias("v")), "lang").drop("leads"), "groups")

    shared_sql = SHARED.format(top=int(top_terms))
    fewer = 1 + kept.count() // SHARD_ROWS
    full = kept.where("term is not null").withColumn("shard", F.pmod("shard", F.lit(fewer))).join(groups, ["lang", "source"])
    parts = written(in_groups(full, ["shard"], lambda rows: in_duck(shared_sql, counts=rows), "part string, lang string, source string, item string, value long"), "partial-sums")

    zero = groups.select("lang", "source", "v", "total", share("0", "total").alias("p0"))
    other = zero.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    pairs = zero.join(other, "lang").where("source < item").select("lang", "source", "item", F.coalesce(F.col("v") * apart("p0", "q0"), F.lit(0)).alias("value"))
    often = kept.where("term is not null").groupBy("lang", "source", "n").count()
    alone = often.join(zero, ["lang", "source"]).withColumn("p", share("n", "total")).join(other, "lang").where("source <> item")
    alone = alone.select("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item"), (F.col("count") * (apart("p", "q0") - apart("p0", "q0"))).alias("value"))
    once = pairs.unionByName(alone).unionByName(parts.where("part = 'pair'").drop("part")).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("side")
    both = once.select("lang", sides, "value").select("lang", "side.source", F.lit("pair").alias("part"), "side.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    terms = parts.where("part = 'term'").select("lang", "source", "part", "item", "value").withColumn("rank", rank).where(F.col("rank") <= top_terms)
    out = written(both.withColumn("rank", rank).unionByName(terms), "divergence")
    dropped(kept, groups, parts)
    return out
