"""Queries over the index tables that keep it whole: hot keys, orphan references, incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.operators import hotkeys, incremental, orphans
from fathomline.plans.registry import Registry
from fathomline.tables import table

registry = Registry()

_FIELDS = (("graph_edges.dst_id", "graph_edges", "dst_id", "src_id"), ("graph_nodes.package_path", "graph_nodes", "package_path", "file_path"))
_SHARE = 0.04


def _union(parts):
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _sql_union(template: str) -> str:
    return " union all ".join(template.format(field=f, t=t, key=k, partner=p) for f, t, k, p in _FIELDS)


@registry.query(
    "p1_found",
    _sql_union("select '{field}' as field_name, {key} as key_value from {t} where {key} is not null and {key} <> '' group by {key} having count(*) > 0.04 * (select count(*) from {t})"),
)
def p1_found(spark, sf):
    return _union([hotkeys.heavy_keys(table(spark, sf, t), k, _SHARE).select(F.lit(f).alias("field_name"), "key_value") for f, t, k, _ in _FIELDS])


@registry.query(
    "p1_keys",
    _sql_union("select '{field}' as field_name, {key} as key_value, count(*) as rows, count(distinct {partner}) as distinct_partners from {t} where {key} is not null and {key} <> '' group by {key}"),
)
def p1_keys(spark, sf):
    return _union([hotkeys.key_profile(table(spark, sf, t), k, p).withColumn("field_name", F.lit(f)) for f, t, k, p in _FIELDS]).select("field_name", "key_value", "rows", "distinct_partners")


@registry.query(
    "p1_quantiles",
    "with r as ("
    + _sql_union("select '{field}' as field_name, {key} as key_value, start_line as v, row_number() over (partition by {key} order by start_line) as rn, count(*) over (partition by {key}) as n from {t} where {key} is not null and start_line is not null")
    + "), p as (select unnest([0.5::double, 0.9::double]) as prob) select field_name, key_value, prob, v::bigint as value, n as total from r, p where rn = greatest(1, ceil(prob * n))",
)
def p1_quantiles(spark, sf):
    parts = []
    for f, t, k, _ in _FIELDS:
        q = hotkeys.select_ranks(table(spark, sf, t), k, "start_line", probs=(0.5, 0.9))
        parts.append(q.select(F.lit(f).alias("field_name"), F.col(k).alias("key_value"), "prob", "value", "total"))
    return _union(parts)


_ALIVE = """
with live_nodes as (select n.id from (select id, max(last_seen_at) as seen from graph_nodes group by id) n
  left join (select record_key, max(pruned_at) as gone from pruned where table_name = 'graph_nodes' group by 1) p on p.record_key = n.id where gone is null or gone <= seen),
live_chunks as (select c.id from (select cast(id as varchar) as id, max(last_seen_at) as seen from chunks group by id) c
  left join (select record_key, max(pruned_at) as gone from pruned where table_name = 'chunks' group by 1) p on p.record_key = c.id where gone is null or gone <= seen),
edges as (select * from graph_edges qualify row_number() over (partition by id order by last_seen_at desc) = 1),
nodes as (select * from graph_nodes qualify row_number() over (partition by id order by last_seen_at desc) = 1),
refs as (select 'graph_edges' as table_name, 'src_id' as field_name, id as record_id, src_id as k, last_seen_at as s from edges
  union all select 'graph_edges', 'dst_id', id, dst_id, last_seen_at from edges
  union all select 'graph_nodes', 'chunk_id', id, cast(chunk_id as varchar), last_seen_at from nodes),
misses as (select table_name, field_name, record_id, strftime(make_timestamp(s // 1000), '%Y-%m') as period from refs r where k is not null and k <> ''
  and not exists (select 1 from live_nodes l where field_name <> 'chunk_id' and l.id = r.k) and not exists (select 1 from live_chunks l where field_name = 'chunk_id' and l.id = r.k))
"""


def _orphans(spark, sf):
    return orphans.find_orphans(*[table(spark, sf, t) for t in ("graph_edges", "graph_nodes", "chunks", "pruned")])


@registry.query("p2_found", _ALIVE + "select * from misses")
def p2_found(spark, sf):
    return _orphans(spark, sf)


@registry.query("p2_report", _ALIVE + "select table_name, field_name, period, count(*) as orphans from misses group by all")
def p2_report(spark, sf):
    return _orphans(spark, sf).groupBy("table_name", "field_name", "period").agg(F.count(F.lit(1)).alias("orphans"))


_CHANGES = """with ok as (select run_id from index_runs where status = 'ok'),
    done as (select l.table_name, record_key, lower(content_hash) as h, run_id, logged_at from index_log l join ok using (run_id)),
    now as (select id, last_seen_at, lower(content_hash) as h from graph_nodes qualify row_number() over (partition by id order by last_seen_at desc) = 1),
    was as (select record_key, h from done where table_name = 'graph_nodes' qualify row_number() over (partition by record_key order by run_id desc, logged_at desc, h desc) = 1),
    found as (select 'chunks' as table_name, cast(c.id as varchar) as record_id, max(last_seen_at) as stamp from chunks c
      where not exists (select 1 from done d where d.table_name = 'chunks' and d.record_key = c.path and d.h = lower(c.content_sha1)) group by c.id
    union all select 'graph_nodes', id, last_seen_at from now left join was on record_key = id where record_key is null or now.h is distinct from was.h),
    last as (select run_id, started_at as s from index_runs where status = 'ok' order by started_at desc nulls last, run_id desc limit 1),
    point as (select epoch_us(least(s, (select min(started_at) from index_runs r, last where r.started_at <= s and (r.finished_at is null or r.finished_at >= s)))) * 1000 as p from last)
"""


def _changes(spark, sf):
    return incremental.changes_since_last_run(*[table(spark, sf, t) for t in ("chunks", "graph_nodes", "index_log", "index_runs")])


@registry.query("p7_found", _CHANGES + "select table_name, record_id from found")
def p7_found(spark, sf):
    return _changes(spark, sf).select("table_name", "record_id")


@registry.query("p7_lanes", _CHANGES + "select table_name, case when stamp >= p then 'reread' else 'late' end as lane, count(*) as records from found, point group by all")
def p7_lanes(spark, sf):
    return _changes(spark, sf).groupBy("table_name", "lane").agg(F.count(F.lit(1)).alias("records"))


@registry.query(
    "p7_reread",
    """with last as (select run_id as last_ok_run, started_at as s from index_runs where status = 'ok' order by started_at desc nulls last, run_id desc limit 1)
    select last_ok_run, least(s, (select min(started_at) from index_runs r, last where r.started_at <= s and (r.finished_at is null or r.finished_at >= s))) as reread_from from last""",
)
def p7_reread(spark, sf):
    return incremental.reread_from(table(spark, sf, "index_runs"))
