"""Graphs, coordinates and pairs derived from the embeddings table, alike in Spark and in SQL.

Each label is a graph of its vectors: a ring with arithmetic chords.  Two
coordinate families come from components one and two, and three and four,
recentred and scaled to four radii.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfold.functions.geometry import RADII
from wayfold.operators import graphs

PAIRS, TOLERANCE = 30, 1e-12


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("label")
    e = lambda k: F.get("embedding", F.lit(k)).cast("double")
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null and embedding is not null").select(
        F.concat(F.lit("g"), "label").alias("graph_id"), (F.row_number().over(own.orderBy("vec_id")) - 1).cast("long").alias("node"), F.count("*").over(own).alias("n"), e(0).alias("e1"), e(1).alias("e2"), e(2).alias("e3"), e(3).alias("e4"))


def edges(base: DataFrame) -> DataFrame:
    both = F.explode(F.array((F.col("node") + 1) % F.col("n"), (F.col("node") * F.col("node") * 7 + 13) % F.col("n")))
    return graphs.canonical_edges(base.select("graph_id", F.col("node").alias("src"), both.alias("dst")))


def coords(base: DataFrame) -> DataFrame:
    """(graph_id, condition_id, family, radius, node, x, y), rounded to nine digits."""
    own = Window.partitionBy("graph_id", "family")
    family = F.explode(F.array(F.struct(F.lit("hydra").alias("family"), F.col("e1").alias("a"), F.col("e2").alias("b")), F.struct(F.lit("mds").alias("family"), F.col("e3").alias("a"), F.col("e4").alias("b"))))
    centred = base.select("graph_id", "node", family.alias("f")).select("graph_id", "node", "f.*")
    centred = centred.select("graph_id", "node", "family", (F.col("a") - F.avg("a").over(own)).alias("a"), (F.col("b") - F.avg("b").over(own)).alias("b"))
    scaled = centred.withColumn("most", F.max(F.hypot("a", "b")).over(own)).withColumn("radius", F.explode(F.array(*[F.lit(r) for r in RADII])))
    place = lambda c: F.round(F.col(c) * F.col("radius") / F.col("most"), 9)
    name = F.concat("family", F.lit("_r"), F.lpad(F.round(F.col("radius") * 100).cast("int").cast("string"), 3, "0"))
    return scaled.select("graph_id", name.alias("condition_id"), "family", "radius", "node", place("a").alias("x"), place("b").alias("y"))


def pairs(base: DataFrame) -> DataFrame:
    size = base.groupBy("graph_id").agg(F.first("n").alias("n"))
    k = F.explode(F.expr(f"sequence(0L, {PAIRS - 1}L)"))
    s, t = (F.col("k") * 37 + 11) % F.col("n"), (F.col("k") * 101 + 29) % F.col("n")
    return size.where("n >= 2").select("graph_id", "n", k.alias("k")).select("graph_id", F.col("k").alias("pair_index"), s.alias("source"), F.when(s == t, (t + 1) % F.col("n")).otherwise(t).alias("destination"))


def placed(rows: DataFrame) -> DataFrame:
    """Adds model and replicate: five of ten labels for each model, replicates numbered by label within it."""
    number = F.substring("graph_id", 2, 20).cast("long")
    model = F.when(F.pmod(number, F.lit(10)) < 5, "erdos_renyi").otherwise("barabasi_albert")
    return rows.withColumn("model", model).withColumn("replicate", (F.dense_rank().over(Window.partitionBy("model").orderBy(number)) - 1).cast("int"))


def design(base: DataFrame) -> DataFrame:
    """(schedule_index, model, n, m, replicate_index, graph_id): a random graph for each graph of the table, as large, by turns with 8 and 16 edges a node."""
    each = placed(base.groupBy("graph_id").agg(F.first("n").alias("n")).where("n >= 2"))
    order = Window.orderBy(F.col("model").desc(), "replicate")  # a row for each graph
    m = F.least(F.when(F.col("replicate") % 2 == 0, 8).otherwise(16), F.col("n") - 1).cast("int")
    return each.select((F.row_number().over(order) - 1).cast("long").alias("schedule_index"), "model", F.col("n").cast("int").alias("n"), m.alias("m"), F.col("replicate").alias("replicate_index"), "graph_id")


def destinations(pair: DataFrame, coord: DataFrame) -> DataFrame:
    conditions = coord.select("graph_id", "condition_id").distinct()
    metric = F.explode(F.array(F.lit("euclidean"), F.lit("poincare")))
    return pair.select("graph_id", "destination").distinct().join(conditions, "graph_id").select("graph_id", "condition_id", metric.alias("metric"), F.lit(TOLERANCE).alias("tolerance"), "destination")


#: The same tables for DuckDB, as common table expressions.
SQL = f"""
with recursive base as (
  select 'g' || label as graph_id, (row_number() over (partition by label order by vec_id) - 1)::bigint as node, count(*) over (partition by label) as n,
         embedding[1]::double as e1, embedding[2]::double as e2, embedding[3]::double as e3, embedding[4]::double as e4 from embeddings where label is not null),
edges as (
  select distinct graph_id, least(node, other) as src, greatest(node, other) as dst from (
    select graph_id, node, (node + 1) % n as other from base union all select graph_id, node, (node * node * 7 + 13) % n from base) where node <> other),
adj as (select graph_id, src as node, dst as neighbour from edges union all select graph_id, dst, src from edges),
degree as (select graph_id, node, count(*) as degree from adj group by all),
centred as (
  select graph_id, node, family, a - avg(a) over w as a, b - avg(b) over w as b from (
    select graph_id, node, 'hydra' as family, e1 as a, e2 as b from base union all select graph_id, node, 'mds', e3, e4 from base)
  window w as (partition by graph_id, family)),
coords as (
  select graph_id, family || '_r' || lpad(round(radius * 100)::int::varchar, 3, '0') as condition_id, family, radius, node, round(a * radius / most, 9) as x, round(b * radius / most, 9) as y
  from (select *, max(sqrt(a * a + b * b)) over (partition by graph_id, family) as most from centred), (values {', '.join(f'({r}::double)' for r in RADII)}) r(radius)),
pairs as (
  select graph_id, k as pair_index, s as source, case when s = t then (t + 1) % n else t end as destination from (
    select graph_id, n, k, (k * 37 + 11) % n as s, (k * 101 + 29) % n as t from (select distinct graph_id, n from base where n >= 2), range({PAIRS}) r(k))),
bfs as (
  select graph_id, node as u, node as v, 0 as d from base
  union select b.graph_id, b.u, a.neighbour, b.d + 1 from bfs b join adj a on a.graph_id = b.graph_id and a.node = b.v where b.d < 20),
apsp as (select graph_id, u, v, min(d) as d from bfs group by all),
goal as (
  select p.graph_id, c.condition_id, m.metric, p.destination, c.x as dx, c.y as dy from (select distinct graph_id, destination from pairs) p
  join coords c on c.graph_id = p.graph_id and c.node = p.destination, (values ('euclidean'), ('poincare')) m(metric)),
far as (
  select g.graph_id, g.condition_id, g.metric, g.destination, c.node,
         case when g.metric = 'euclidean' then sqrt((c.x - dx) ** 2 + (c.y - dy) ** 2)
              else 2 * asinh(sqrt((c.x - dx) ** 2 + (c.y - dy) ** 2) / sqrt((1 - c.x * c.x - c.y * c.y) * (1 - dx * dx - dy * dy))) end as d
  from goal g join coords c on c.graph_id = g.graph_id and c.condition_id = g.condition_id),
near as (
  select f.graph_id, f.condition_id, f.metric, f.destination, f.node, f.d as d_node, a.neighbour, t.d as d_next, min(t.d) over w as least,
         max((a.neighbour = f.destination)::int) over w as adjacent
  from far f join adj a on a.graph_id = f.graph_id and a.node = f.node
  join far t on t.graph_id = f.graph_id and t.condition_id = f.condition_id and t.metric = f.metric and t.destination = f.destination and t.node = a.neighbour
  window w as (partition by f.graph_id, f.condition_id, f.metric, f.destination, f.node)),
best1 as (
  select graph_id, condition_id, metric, destination, node, min(neighbour) as best, arg_min(d_next, neighbour) < any_value(d_node) - {TOLERANCE} as moves
  from near where d_next <= least + {TOLERANCE} group by all),
best2 as (
  select graph_id, condition_id, metric, destination, node,
         case when max(adjacent) = 1 then any_value(destination) else min(neighbour) filter (d_next <= least + {TOLERANCE} and d_next < d_node - {TOLERANCE}) end as best,
         max(adjacent) = 1 or any_value(least) < any_value(d_node) - {TOLERANCE} as moves
  from near group by graph_id, condition_id, metric, destination, node),
begun as (select p.*, g.condition_id, g.metric from pairs p join goal g on g.graph_id = p.graph_id and g.destination = p.destination),
walk1 as (
  select graph_id, pair_index, source, destination, condition_id, metric, [source] as walk, null::varchar as failure, 0 as decisions, 0 as step from begun
  union all
  select w.graph_id, w.pair_index, w.source, w.destination, w.condition_id, w.metric,
         case when list_contains(w.walk, b.best) or not b.moves then w.walk else list_append(w.walk, b.best) end,
         case when list_contains(w.walk, b.best) then 'attempted_revisit' when not b.moves then 'local_minimum' end, w.decisions + 1, w.step + 1
  from walk1 w join best1 b on b.graph_id = w.graph_id and b.condition_id = w.condition_id and b.metric = w.metric and b.destination = w.destination and b.node = w.walk[-1]
  where w.failure is null and w.walk[-1] <> w.destination),
route1 as (select * exclude (step), walk[-1] = destination as success, len(walk) - 1 as hops from (select *, row_number() over (partition by graph_id, pair_index, condition_id, metric order by step desc) as last from walk1) where last = 1),
walk2 as (
  select graph_id, pair_index, source, destination, condition_id, metric, [source] as walk, null::varchar as failure, 0 as step from begun
  union all
  select w.graph_id, w.pair_index, w.source, w.destination, w.condition_id, w.metric, case when b.moves then list_append(w.walk, b.best) else w.walk end, case when not b.moves then 'local_minimum' end, w.step + 1
  from walk2 w join best2 b on b.graph_id = w.graph_id and b.condition_id = w.condition_id and b.metric = w.metric and b.destination = w.destination and b.node = w.walk[-1]
  where w.failure is null and w.walk[-1] <> w.destination),
route2 as (select * exclude (step), walk[-1] = destination as success, len(walk) - 1 as hops from (select *, row_number() over (partition by graph_id, pair_index, condition_id, metric order by step desc) as last from walk2) where last = 1),
free1 as (
  select r.graph_id, r.pair_index, r.condition_id, r.metric, n.neighbour, n.d_next, min(n.d_next) over (partition by r.graph_id, r.pair_index, r.condition_id, r.metric) as low
  from route1 r join near n on n.graph_id = r.graph_id and n.condition_id = r.condition_id and n.metric = r.metric and n.destination = r.destination and n.node = r.walk[-2]
  where not r.success and len(r.walk) >= 2 and not list_contains(r.walk, n.neighbour)),
option1 as (select graph_id, pair_index, condition_id, metric, min(neighbour) as alternative from free1 where d_next <= low + {TOLERANCE} group by all),
fixed1 as (
  select r.*, o.alternative, case when o.alternative is not null then r.walk || [r.walk[-2], o.alternative] when len(r.walk) >= 2 and not r.success then r.walk || [r.walk[-2]] else r.walk end as start
  from route1 r left join option1 o using (graph_id, pair_index, condition_id, metric)),
walk3 as (
  select graph_id, pair_index, source, destination, condition_id, metric, start as walk, null::varchar as failure, alternative is not null as alive, decisions + (alternative is not null)::int as decisions, 0 as step from fixed1
  union all
  select w.graph_id, w.pair_index, w.source, w.destination, w.condition_id, w.metric,
         case when list_contains(w.walk, b.best) or not b.moves then w.walk else list_append(w.walk, b.best) end,
         case when list_contains(w.walk, b.best) then 'attempted_revisit' when not b.moves then 'local_minimum' end, true, w.decisions + 1, w.step + 1
  from walk3 w join best1 b on b.graph_id = w.graph_id and b.condition_id = w.condition_id and b.metric = w.metric and b.destination = w.destination and b.node = w.walk[-1]
  where w.alive and w.failure is null and w.walk[-1] <> w.destination),
repair1 as (
  select w.graph_id, w.pair_index, w.source, w.destination, w.condition_id, w.metric, w.walk, len(w.walk) - 1 as hops, w.decisions, r.failure as initial_failure,
         case when r.success then null when len(r.walk) < 2 then 'repair_unavailable_at_source' when not w.alive then 'no_alternative_after_backtracking'
              when w.walk[-1] = w.destination then null when w.failure = 'attempted_revisit' then 'post_repair_attempted_revisit' else 'post_repair_local_minimum' end as final_failure,
         case when not r.success then len(r.walk) >= 2 end as backtrackable, not r.success and len(r.walk) >= 2 as attempted, case when not r.success then w.alive end as alternative_existed
  from (select *, row_number() over (partition by graph_id, pair_index, condition_id, metric order by step desc) as last from walk3) w
  join route1 r using (graph_id, pair_index, condition_id, metric) where w.last = 1),
method as (
  select r.graph_id, r.pair_index, r.condition_id, r.metric as method, r.success, r.hops, r.decisions, r.failure as initial_failure, r.failure as final_failure, r.source, r.destination, a.d as shortest
  from route1 r join apsp a on a.graph_id = r.graph_id and a.u = r.source and a.v = r.destination
  union all
  select r.graph_id, r.pair_index, r.condition_id, 'repaired', r.final_failure is null, r.hops, r.decisions, r.initial_failure, r.final_failure, r.source, r.destination, a.d
  from repair1 r join apsp a on a.graph_id = r.graph_id and a.u = r.source and a.v = r.destination where r.metric = 'poincare'),
graph_rows as (
  select * exclude (number), (dense_rank() over (partition by model order by number) - 1)::int as replicate from (
    select graph_id, condition_id, substr(graph_id, 2)::bigint as number, case when (substr(graph_id, 2)::bigint % 10 + 10) % 10 < 5 then 'erdos_renyi' else 'barabasi_albert' end as model,
           count(*) filter (method = 'euclidean' and success) as euclidean, count(*) filter (method = 'poincare' and success) as poincare, count(*) filter (method = 'repaired' and success) as repaired,
           count(*) filter (method = 'repaired') as pair_count
    from method group by all))
"""
