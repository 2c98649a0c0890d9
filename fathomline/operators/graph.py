"""The code graph: degrees, centrality, call sites, neighbourhoods and package structure.

Nodes and edges are data frames with unique ids.  Edges whose ends are unknown take no part, as dangling references are
reported by :mod:`fathomline.operators.orphans`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.session import materialise

DAMPING = 0.85
ITERATIONS = 20
CALLABLE = ("function", "method")
_EDGE_CAP = 50


def known_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct ``src_id, dst_id`` of calls between known nodes.  Repeated call sites are merged before any join."""
    pairs = edges.where("kind = 'calls'").select("src_id", "dst_id").distinct()
    ids = nodes.select("id")
    return pairs.join(ids.withColumnRenamed("id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("id", "dst_id"), "dst_id", "left_semi")


def forwarded_calls(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src_id, dst_id`` from a method of an interface to the method of that name of each type that implements it.

    Of several methods of one name on one type the one with the last edge id counts.
    """
    methods = edges.where("kind = 'has_method'").select("id", "src_id", "dst_id").join(nodes.select(F.col("id").alias("dst_id"), "name"), "dst_id")
    methods = methods.groupBy(F.col("src_id").alias("owner"), "name").agg(F.max(F.struct("id", "dst_id")).alias("m")).select("owner", "name", F.col("m.dst_id").alias("method"))
    pairs = edges.where("kind = 'implements'").select(F.col("src_id").alias("type"), F.col("dst_id").alias("iface")).distinct()
    of_type = methods.select(F.col("owner").alias("type"), "name", F.col("method").alias("dst_id"))
    of_iface = methods.select(F.col("owner").alias("iface"), "name", F.col("method").alias("src_id"))
    return pairs.join(of_iface, "iface").join(of_type, ["type", "name"]).where("src_id <> dst_id").select("src_id", "dst_id").distinct()


def flow_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Calls and forwarded calls, each pair once."""
    return known_calls(edges, nodes).unionByName(forwarded_calls(edges, nodes)).distinct()


def degrees(flow: DataFrame) -> DataFrame:
    """``id, in_degree, out_degree`` over distinct pairs; a call of itself counts on both sides."""
    ends = flow.select(F.col("dst_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(flow.select(F.col("src_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def cross_package_callers(calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, cross_pkg_callers``: distinct packages other than its own, none of them empty, that call a node."""
    pkg = lambda end: nodes.select(F.col("id").alias(f"{end}_id"), F.col("package_path").alias(f"{end}_pkg"))
    # callers are reduced to packages before the callee is looked up: a hot callee leaves one row per package
    by_pkg = calls.join(pkg("src"), "src_id").where("src_pkg <> ''").select("dst_id", "src_pkg").distinct()
    return by_pkg.join(pkg("dst"), "dst_id").where("not (src_pkg <=> dst_pkg)").groupBy(F.col("dst_id").alias("id")).agg(F.count("src_pkg").alias("cross_pkg_callers"))


def pagerank(nodes: DataFrame, flow: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING, together: int = 5) -> DataFrame:
    """``id, pagerank`` over all nodes; the mass of nodes without calls is spread evenly, so ranks sum to 1.

    What is spread evenly stays a multiple of the uniform vector, so the walk is linear: with ``v[k]`` the uniform vector
    after k steps along the edges, the rank is ``v[T] + sum of b[T-1-k] * v[k]``, and the numbers ``b`` follow from the
    sums of the ``v[k]`` alone.  A step is one join on the source and one aggregate by target, in which only nodes that are
    called take part; the exchange of the shares is the same in all steps and is reused.  ``together`` steps are one job
    and one table in the scratch folder.  A hot target receives one row per task, a hot source is left to the handling of
    skewed joins.  Without edges the result is empty, as a uniform rank says nothing.
    """
    ids = materialise(nodes.select("id").distinct(), "nodes")
    n = ids.count()
    out = flow.groupBy("src_id").agg(F.count(F.lit(1)).alias("_out"))
    shares = materialise(flow.join(out, "src_id").select("src_id", "dst_id", (F.lit(damping) / F.col("_out")).alias("share")), "shares")
    if n == 0 or shares.isEmpty():
        return ids.select("id", F.lit(0.0).alias("pagerank")).limit(0)
    v = ids.select("id", F.lit(1.0 / n).alias("v"))
    tables: list[DataFrame] = []
    for first in range(1, iterations + 1, together):
        steps = []
        for k in range(first, min(first + together, iterations + 1)):
            v = v.join(shares, F.col("id") == F.col("src_id")).groupBy(F.col("dst_id").alias("id")).agg(F.sum(F.col("v") * F.col("share")).alias("v"))
            steps.append(v.withColumn("k", F.lit(k)))
        tables.append(materialise(_union(steps), "steps"))
        v = tables[-1].where(F.col("k") == k).select("id", "v")
    walked = _union(tables)
    mass = {0: 1.0} | {r.k: r.mass for r in walked.groupBy("k").agg(F.sum("v").alias("mass")).collect()}  # one row per step
    # what nodes without calls hold after k steps is what the next step does not carry on
    idle = [mass.get(k, 0.0) - mass.get(k + 1, 0.0) / damping for k in range(iterations)]
    given: list[float] = []
    for t in range(iterations):
        given.append((1 - damping) + damping * (idle[t] + sum(given[t - 1 - k] * idle[k] for k in range(t))))
    weight = F.element_at(F.array(*[F.lit(given[iterations - 1 - k]) for k in range(1, iterations)], F.lit(1.0)), F.col("k"))
    sums = walked.groupBy("id").agg(F.sum(F.col("v") * weight).alias("_sum"))
    return ids.join(sums, "id", "left").select("id", (F.lit(given[-1] / n) + F.coalesce("_sum", F.lit(0.0))).alias("pagerank"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def packages_of_paths(hits: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct ``package_path`` of the nodes in the files of ``hits(path)``; empty packages and null paths are left out."""
    files = hits.select(F.col("path").alias("file_path")).where("file_path is not null").distinct()
    return nodes.where("package_path <> ''").select("file_path", "package_path").join(files, "file_path", "left_semi").select("package_path").distinct()


def chunk_ranks(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``id, pagerank`` of chunks: the highest rank of the nodes that cover their first line, else of any node of the file, else 0.

    ``nodes(file_path, start_line, end_line, pagerank)``.  Nodes of a file are joined on (path, block of lines) as in
    ``tightest_chunk``; the fallback is one row per file.
    """
    block = 128
    spans = nodes.where("file_path <> '' and end_line >= start_line").select(F.col("file_path").alias("path"), "start_line", "end_line", "pagerank", F.explode(F.expr(f"sequence(start_line div {block}, end_line div {block})")).alias("_b"))
    spots = chunks.select("id", "path", F.col("start_line").alias("_line"), F.expr(f"start_line div {block}").alias("_b"))
    covering = spots.join(spans, ["path", "_b"]).where("start_line <= _line and _line <= end_line").groupBy("id").agg(F.max("pagerank").alias("_covering"))
    files = nodes.where("file_path <> ''").groupBy(F.col("file_path").alias("path")).agg(F.max("pagerank").alias("_any"))
    best = F.when(F.col("_covering") > 0, F.col("_covering")).otherwise(F.coalesce("_any", F.lit(0.0)))
    return chunks.select("id", "path").join(covering, "id", "left").join(files, "path", "left").select("id", best.alias("pagerank"))


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, in_degree, out_degree, cross_pkg_callers, pagerank`` of every node, zeros where it has none."""
    calls = materialise(known_calls(edges, nodes), "calls")
    flow = materialise(calls.unionByName(forwarded_calls(edges, nodes)).distinct(), "flow")
    ranks = pagerank(nodes, flow)
    joined = nodes.select("id").distinct().join(degrees(flow), "id", "left").join(cross_package_callers(calls, nodes), "id", "left").join(ranks, "id", "left")
    return joined.na.fill(0, ["in_degree", "out_degree", "cross_pkg_callers"]).na.fill(0.0, ["pagerank"])


def role(name: Column, in_degree: Column, out_degree: Column, packages: Column) -> Column:
    """How a symbol is used: central, exported-unused, leaf, or empty."""
    central = F.when(packages > 0, F.format_string("central:%d/%dpkg", in_degree, packages)).otherwise(F.format_string("central:%d", in_degree))
    return (
        F.when((in_degree == 0) & (out_degree == 0) & (packages == 0), "")
        .when((in_degree >= 5) | (packages >= 2), central)
        .when((in_degree == 0) & name.rlike("^[A-Z]"), "exported-unused")
        .when((out_degree == 0) & (in_degree > 0), "leaf")
        .otherwise("")
    )


def package_tail(package: Column) -> Column:
    return F.substring_index(package, "/", -1)


def compact_id(kind: Column, package: Column, qualified: Column, name: Column) -> Column:
    """The short id of a node: last segment of its package and its qualified name."""
    tail, qn, nm = package_tail(F.coalesce(package, F.lit(""))), F.coalesce(qualified, F.lit("")), F.coalesce(name, F.lit(""))
    rest = F.when((qn != "") & (tail != ""), F.concat(tail, F.lit("."), qn)).when(qn != "", qn).when((tail != "") & (nm != ""), F.concat(tail, F.lit("."), nm)).otherwise(nm)
    return F.when(kind == "package", F.when(tail != "", tail).otherwise(qn)).when(kind == "import", qn).otherwise(rest)


def resolve_targets(nodes: DataFrame, name: str, package: str = "") -> DataFrame:
    """Functions and methods that a name means: qualified or bare name, else ``package.name`` by the package's last segment."""
    able = nodes.where(F.col("kind").isin(*CALLABLE) & (F.lit(not package) | (F.col("package_path") == package)))
    direct = (F.col("qualified_name") == name) | (F.col("name") == name)
    tail, _, bare = name.rpartition(".")
    if tail and not any(c in name for c in "()*"):
        by_tail = (F.col("name") == bare) & (package_tail(F.col("package_path")) == tail)
        some = able.agg(F.max(direct.cast("int")).alias("_some"))
        return able.crossJoin(F.broadcast(some)).where(direct | ((F.coalesce("_some", F.lit(0)) == 0) & by_tail)).drop("_some")
    return able.where(direct)


def call_sites(edges: DataFrame, nodes: DataFrame, rank: DataFrame, callers: bool, k: int, targets: DataFrame | None = None) -> DataFrame:
    """Up to ``k`` callers (or callees) of every target: ``target, peer, file_path, start_line, place``.

    Distinct by peer and call site, ordered by the peer's rank and callers in ``rank(id, in_degree)``, which may have a
    ``pagerank`` (compared to 9 decimals), then by place.  The cut
    is made per task before the shuffle as well as after it, so a target that most edges point to sends few rows.
    """
    near, far = ("dst_id", "src_id") if callers else ("src_id", "dst_id")
    calls = edges.where("kind = 'calls'").select(F.col(near).alias("target"), F.col(far).alias("peer"), "file_path", "start_line").distinct()
    if targets is not None:
        calls = calls.join(targets.select(F.col("id").alias("target")), "target", "left_semi")
    else:
        calls = calls.join(nodes.where(F.col("kind").isin(*CALLABLE)).select(F.col("id").alias("target")), "target", "left_semi")
    score = F.round("pagerank", 9) if "pagerank" in rank.columns else F.lit(0.0)
    measured = rank.select("id", "in_degree", score.alias("_score"))
    peers = nodes.select("id").join(measured, "id", "left").select(F.col("id").alias("peer"), F.coalesce("_score", F.lit(0.0)).alias("_p"), F.coalesce("in_degree", F.lit(0)).alias("_d"))
    order = Window.partitionBy("target").orderBy(F.desc("_p"), F.desc("_d"), "file_path", "start_line", "peer")
    return calls.join(peers, "peer").withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= k).select("target", "peer", "file_path", "start_line", "place")


def package_dependencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct ``package_path, dst_id`` of what the nodes of a package import."""
    imports = edges.where("kind = 'imports'").select("src_id", "dst_id").distinct()
    return imports.join(nodes.select(F.col("id").alias("src_id"), "package_path"), "src_id").where("package_path <> ''").select("package_path", "dst_id").distinct()


def neighbourhood(edges: DataFrame, nodes: DataFrame, symbols: DataFrame, most: int = _EDGE_CAP) -> DataFrame:
    """Edges around given symbols: those from their containers, and from these to all members and embedded types.

    ``from_id, kind, to_id``, at most ``most`` in order.  ``symbols`` are the matches of one name, not the whole table.
    """
    parents = edges.where("kind in ('has_method', 'has_field')").join(symbols.select(F.col("id").alias("dst_id")), "dst_id", "left_semi").select(F.col("src_id").alias("id")).distinct()
    parents = parents.join(nodes.select("id"), "id", "left_semi")
    out = edges.where("kind in ('has_method', 'has_field', 'embeds')").join(parents.withColumnRenamed("id", "src_id"), "src_id", "left_semi")
    return out.select(F.col("src_id").alias("from_id"), "kind", F.col("dst_id").alias("to_id")).distinct().orderBy("from_id", "kind", "to_id").limit(most)


def tightest_chunk(nodes: DataFrame, chunks: DataFrame, block: int = 128) -> DataFrame:
    """``node_id, chunk_id``: the shortest chunk that covers the first line of a node, the smaller id on ties.

    Files are cut into blocks of lines, and a chunk is entered under every block it touches: the join is on (path, block),
    so a file with very many nodes and chunks is spread over its blocks.
    """
    spots = nodes.where("file_path <> '' and start_line > 0").select(F.col("id").alias("node_id"), F.col("file_path").alias("path"), F.col("start_line").alias("line"), F.expr(f"start_line div {block}").alias("block"))
    spans = chunks.where("start_line > 0 and end_line >= start_line and not endswith(kind, '_summary')").select(F.col("id").alias("chunk_id"), "path", "start_line", "end_line", F.explode(F.expr(f"sequence(start_line div {block}, end_line div {block})")).alias("block"))
    cover = spots.join(spans, ["path", "block"]).where("start_line <= line and line <= end_line")
    return cover.groupBy("node_id").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("span"), "chunk_id")).alias("b")).select("node_id", "b.chunk_id")
