"""Queries over the code graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.functions import paths
from fathomline.operators import graph
from fathomline.plans import stored
from fathomline.plans.registry import Registry
from fathomline.plans.views import CHUNKS, EDGES, NODES, now

registry = Registry()

_BASE = f"{NODES}, {EDGES}"
_CALLS = "calls as (select distinct src_id, dst_id from ed where kind = 'calls' and src_id in (select id from nd) and dst_id in (select id from nd))"
_METHODS = "methods as (select e.src_id as owner, n.name, arg_max(e.dst_id, e.id) as method from ed e join nd n on n.id = e.dst_id where e.kind = 'has_method' group by all)"
_FORWARD = f"{_METHODS}, fwd as (select distinct i.method as src_id, t.method as dst_id from ed e join methods i on i.owner = e.dst_id join methods t on t.owner = e.src_id and t.name = i.name where e.kind = 'implements' and i.method <> t.method)"
_FLOW = f"{_BASE}, {_CALLS}, {_FORWARD}, flow as (select * from calls union select * from fwd)"
_DEGREES = f"{_FLOW}, deg as (select id, sum(i)::bigint as in_degree, sum(o)::bigint as out_degree from (select dst_id as id, 1 as i, 0 as o from flow union all select src_id, 0, 1 from flow) group by id)"
_CROSS = f"cross_pkg as (select c.dst_id as id, count(distinct s.package_path) as cross_pkg_callers from calls c join nd s on s.id = c.src_id join nd d on d.id = c.dst_id where s.package_path <> '' and s.package_path is distinct from d.package_path group by c.dst_id)"
_RANKS = "sh as materialized (select src_id, dst_id, 1.0::double / count(*) over (partition by src_id) as share from flow), nn as (select count(*) as n from nd), r0 as materialized (select id, 1.0::double / n as rank, id in (select src_id from flow) as flows from nd, nn)" + "".join(
    f", r{i + 1} as materialized (select r.id, 0.15::double / n + 0.85::double / n * (select sum(case when flows then 0 else rank end) from r{i}) + 0.85::double * coalesce(g.given, 0) as rank, r.flows from r{i} r cross join nn left join (select dst_id, sum(rank * share) as given from sh join r{i} x on x.id = sh.src_id group by dst_id) g on g.dst_id = r.id)"
    for i in range(graph.ITERATIONS)
) + f", pr as (select id, rank as pagerank from r{graph.ITERATIONS})"


def _graph(spark, sf):
    return now(spark, sf, "graph_nodes"), now(spark, sf, "graph_edges")


def _ranked(spark, sf):
    """Nodes and their stored ranks."""
    return now(spark, sf, "graph_nodes"), stored.centrality(spark, sf).select("id", "pagerank")


@registry.query("degrees", f"with {_DEGREES} select * from deg")
def degrees(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.degrees(graph.flow_edges(edges, nodes))


@registry.query("cross_pkg", f"with {_BASE}, {_CALLS}, {_CROSS} select * from cross_pkg")
def cross_pkg(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.cross_package_callers(graph.known_calls(edges, nodes), nodes)


@registry.query("iface_forwarding", f"with {_BASE}, {_FORWARD} select * from fwd")
def iface_forwarding(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.forwarded_calls(edges, nodes)


@registry.query("pagerank20", f"with {_FLOW}, {_RANKS} select id, round(pagerank, 9) as pagerank from pr")
def pagerank20(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.pagerank(nodes, graph.flow_edges(edges, nodes)).select("id", F.round("pagerank", 9).alias("pagerank"))


@registry.query(
    "centrality",
    f"with {_DEGREES}, {_CROSS}, {_RANKS} select nd.id, coalesce(in_degree, 0)::bigint as in_degree, coalesce(out_degree, 0)::bigint as out_degree, coalesce(cross_pkg_callers, 0) as cross_pkg_callers, round(pagerank, 9) as pagerank from nd left join deg using (id) left join cross_pkg using (id) left join pr using (id)",
)
def centrality(spark, sf):
    return graph.centrality(*_graph(spark, sf)).withColumn("pagerank", F.round("pagerank", 9))


@registry.query(
    "role_tag",
    f"""with {_DEGREES}, {_CROSS}, c as (select nd.id, nd.name, coalesce(in_degree, 0)::bigint as i, coalesce(out_degree, 0)::bigint as o, coalesce(cross_pkg_callers, 0) as p from nd left join deg using (id) left join cross_pkg using (id))
    select id, case when i = 0 and o = 0 and p = 0 then '' when i >= 5 or p >= 2 then 'central:' || i || (case when p > 0 then '/' || p || 'pkg' else '' end) when i = 0 and regexp_matches(name, '^[A-Z]') then 'exported-unused' when o = 0 and i > 0 then 'leaf' else '' end as role from c""",
)
def role_tag(spark, sf):
    nodes, edges = _graph(spark, sf)
    calls = graph.known_calls(edges, nodes)
    flow = calls.unionByName(graph.forwarded_calls(edges, nodes)).distinct()
    joined = nodes.select("id", "name").join(graph.degrees(flow), "id", "left").join(graph.cross_package_callers(calls, nodes), "id", "left").na.fill(0)
    return joined.select("id", graph.role(F.col("name"), F.col("in_degree"), F.col("out_degree"), F.col("cross_pkg_callers")).alias("role"))


def _call_sql(near: str, far: str) -> str:
    return f"""with {_DEGREES}, {_RANKS}, s as (select distinct e.{near} as target, e.{far} as peer, e.file_path, e.start_line from ed e where e.kind = 'calls' and e.{near} in (select id from nd where kind in ('function', 'method')) and e.{far} in (select id from nd))
    select target, peer, file_path, start_line, row_number() over (partition by target order by coalesce(round(pr.pagerank, 9), 0) desc, coalesce(d.in_degree, 0) desc, file_path nulls first, start_line nulls first, peer) as place from s left join deg d on d.id = s.peer left join pr on pr.id = s.peer qualify place <= 12"""


@registry.query("callers", _call_sql("dst_id", "src_id"))
def callers(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.call_sites(edges, nodes, stored.centrality(spark, sf), True, 12)


@registry.query("callees", _call_sql("src_id", "dst_id"))
def callees(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.call_sites(edges, nodes, stored.centrality(spark, sf), False, 12)


@registry.query("graph_deps", f"with {_BASE} select distinct n.package_path, e.dst_id from ed e join nd n on n.id = e.src_id where e.kind = 'imports' and n.package_path <> '' and e.dst_id is not null")
def graph_deps(spark, sf):
    nodes, edges = _graph(spark, sf)
    return graph.package_dependencies(edges.where("dst_id is not null"), nodes)


_SYMBOL = "sy as (select id from nd where kind = 'method' and name = (select min(n.name) from nd n join ed e on e.dst_id = n.id where e.kind = 'has_method'))"


@registry.query(
    "two_hop",
    f"""with {_BASE}, {_SYMBOL}, par as (select distinct e.src_id as id from ed e join sy on sy.id = e.dst_id where e.kind in ('has_method', 'has_field') and e.src_id in (select id from nd))
    select distinct src_id as from_id, kind, dst_id as to_id from ed where kind in ('has_method', 'has_field', 'embeds') and src_id in (select id from par) order by from_id, kind, to_id nulls first limit 50""",
)
def two_hop(spark, sf):
    """The neighbourhood of the alphabetically first method that a type has."""
    nodes, edges = _graph(spark, sf)
    owned = edges.where("kind = 'has_method'").select(F.col("dst_id").alias("id")).distinct().join(nodes.select("id", "name"), "id")
    first = owned.agg(F.min("name").alias("first"))
    symbols = nodes.where("kind = 'method'").join(F.broadcast(first), F.col("name") == F.col("first")).select("id")
    return graph.neighbourhood(edges, nodes, symbols)


@registry.query("pkg_rollup", f"with {_BASE} select package_path, kind, count(*) as nodes, min(qualified_name) as first_name from nd where kind in ('package', 'type', 'struct', 'interface', 'function') and package_path <> '' group by all")
def pkg_rollup(spark, sf):
    nodes = now(spark, sf, "graph_nodes").where("kind in ('package', 'type', 'struct', 'interface', 'function') and package_path <> ''")
    return nodes.groupBy("package_path", "kind").agg(F.count(F.lit(1)).alias("nodes"), F.min("qualified_name").alias("first_name"))


@registry.query("pkg_topology", f"with {_BASE} select s.package_path as from_package, d.package_path as to_package, count(*) as edges from ed e join nd s on s.id = e.src_id join nd d on d.id = e.dst_id where e.kind = 'imports' and s.package_path <> '' and d.package_path <> '' and s.package_path <> d.package_path group by all")
def pkg_topology(spark, sf):
    nodes, edges = _graph(spark, sf)
    end = lambda e: nodes.where("package_path <> ''").select(F.col("id").alias(f"{e}_id"), F.col("package_path").alias(f"{e}_package"))
    joined = edges.where("kind = 'imports'").select("src_id", "dst_id").join(end("src"), "src_id").join(end("dst"), "dst_id").where("src_package <> dst_package")
    return joined.groupBy(F.col("src_package").alias("from_package"), F.col("dst_package").alias("to_package")).agg(F.count(F.lit(1)).alias("edges"))


@registry.query(
    "compact_id",
    f"""with {NODES}, t as (select id, kind, coalesce(name, '') as nm, coalesce(qualified_name, '') as qn, split_part(coalesce(package_path, ''), '/', -1) as tail from nd)
    select id, case when kind = 'package' then (case when tail <> '' then tail else qn end) when kind = 'import' then qn when qn <> '' and tail <> '' then tail || '.' || qn when qn <> '' then qn when tail <> '' and nm <> '' then tail || '.' || nm else nm end as short_id from t""",
)
def compact_id(spark, sf):
    c = F.col
    return now(spark, sf, "graph_nodes").select("id", graph.compact_id(c("kind"), c("package_path"), c("qualified_name"), c("name")).alias("short_id"))


_DIR = "case when contains(file_path, '/') then regexp_replace(file_path, '/[^/]*$', '') else '.' end"


def _dir():
    return paths.dirname(F.col("file_path"))


@registry.query("exported_by_dir", f"with {NODES} select {_DIR} as dir, name, kind, start_line from nd where file_path <> '' and kind in ('function', 'method', 'struct', 'interface', 'type') and regexp_matches(name, '^[A-Z]')")
def exported_by_dir(spark, sf):
    nodes = now(spark, sf, "graph_nodes").where("file_path <> '' and kind in ('function', 'method', 'struct', 'interface', 'type')").where(F.col("name").rlike("^[A-Z]"))
    return nodes.select(_dir().alias("dir"), "name", "kind", "start_line")


@registry.query("top_by_dir", f"with {_FLOW}, {_RANKS} select {_DIR} as dir, nd.id, round(pagerank, 9) as pagerank from nd join pr using (id) where file_path <> '' and kind in ('function', 'method') qualify row_number() over (partition by dir order by round(pagerank, 9) desc, name, nd.id) <= 5")
def top_by_dir(spark, sf):
    nodes, ranks = _ranked(spark, sf)
    rows = nodes.where("file_path <> '' and kind in ('function', 'method')").join(ranks, "id").select(_dir().alias("dir"), "id", "name", F.round("pagerank", 9).alias("pagerank"))
    place = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc("pagerank"), "name", "id"))
    return rows.withColumn("_n", place).where("_n <= 5").select("dir", "id", "pagerank")


@registry.query("dir_centrality", f"with {_FLOW}, {_RANKS} select {_DIR} as dir, round(sum(pagerank), 8) as weight from nd join pr using (id) where file_path <> '' group by dir")
def dir_centrality(spark, sf):
    nodes, ranks = _ranked(spark, sf)
    return nodes.where("file_path <> ''").join(ranks, "id").groupBy(_dir().alias("dir")).agg(F.round(F.sum("pagerank"), 8).alias("weight"))


@registry.query("top_packages", f"with {_FLOW}, {_RANKS} select package_path, round(sum(pagerank), 8) as weight from nd join pr using (id) where package_path <> '' group by package_path having sum(pagerank) > 0 order by weight desc, package_path limit 8")
def top_packages(spark, sf):
    nodes, ranks = _ranked(spark, sf)
    sums = nodes.where("package_path <> ''").join(ranks, "id").groupBy("package_path").agg(F.round(F.sum("pagerank"), 8).alias("weight")).where("weight > 0")
    return sums.orderBy(F.desc("weight"), "package_path").limit(8)


_OWN = f"own as (select distinct split_part(id, '::', 1) as module, {_DIR} as dir, package_path from nd where file_path <> '' and package_path <> '')"


@registry.query("imports_for_dir", f"with {NODES}, {_OWN} select distinct own.dir, n.name from own join nd n on n.package_path = own.package_path and split_part(n.id, '::', 1) = own.module where n.kind = 'import'")
def imports_for_dir(spark, sf):
    """What the packages with files in a directory import, for every directory."""
    nodes = now(spark, sf, "graph_nodes")
    module = F.substring_index("id", "::", 1).alias("module")  # packages of one name in several modules stay apart
    own = nodes.where("file_path <> '' and package_path <> ''").select(module, _dir().alias("dir"), "package_path").distinct()
    names = nodes.where("kind = 'import'").select(module, "package_path", "name").distinct()
    return own.join(names, ["module", "package_path"]).select("dir", "name").distinct()


@registry.query(
    "used_by",
    f"with {_BASE} select distinct d.package_path as package_path, s.package_path as used_by from ed e join nd s on s.id = e.src_id join nd d on d.id = e.dst_id where e.kind = 'imports' and d.kind = 'package' and s.package_path <> '' and d.package_path <> '' and s.package_path <> d.package_path",
)
def used_by(spark, sf):
    """The packages that import a package, other than itself."""
    nodes, edges = _graph(spark, sf)
    source = nodes.where("package_path <> ''").select(F.col("id").alias("src_id"), F.col("package_path").alias("used_by"))
    target = nodes.where("kind = 'package' and package_path <> ''").select(F.col("id").alias("dst_id"), "package_path")
    pairs = edges.where("kind = 'imports'").select("src_id", "dst_id").distinct().join(source, "src_id").select("used_by", "dst_id").distinct()
    return pairs.join(target, "dst_id").where("used_by <> package_path").select("package_path", "used_by").distinct()


@registry.query(
    "containment_join",
    f"""with {NODES}, {CHUNKS} select nd.id as node_id, arg_min(ch.id, (ch.end_line - ch.start_line) * 1000000000000::bigint + ch.id) as chunk_id from nd join ch on ch.path = nd.file_path and ch.start_line <= nd.start_line and nd.start_line <= ch.end_line
    where nd.file_path <> '' and nd.start_line > 0 and ch.start_line > 0 and not ends_with(ch.kind, '_summary') group by nd.id""",
)
def containment_join(spark, sf):
    return graph.tightest_chunk(now(spark, sf, "graph_nodes"), now(spark, sf, "chunks"))


_FIELDS = ("id", "kind", "src_id", "dst_id", "file_path", "start_line", "end_line", "content_hash")


@registry.query(
    "graph_export",
    f"with {EDGES} select id, json_merge_patch('{{}}', json_object({', '.join(f"'{c}', {c}" if c.endswith('_line') else f"'{c}', nullif({c}, '')" for c in _FIELDS)}))::varchar as line from ed",
)
def graph_export(spark, sf):
    """The JSON line of every edge, null and empty fields left out."""
    tidy = now(spark, sf, "graph_edges").select(*[F.col(c) if c.endswith("_line") else F.when(F.col(c) != "", F.col(c)).alias(c) for c in _FIELDS])
    return tidy.select("id", F.to_json(F.struct(*_FIELDS), {"ignoreNullFields": "true"}).alias("line"))
