"""A guide to a project in Markdown: packages by weight, their summaries, exported names and entry points.

A guide is one document: its driver holds one line per package and directory and puts the text together.  The lists of
names are cut to a few entries per package before they reach it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import paths
from fathomline.operators import rollup

EXPORTED, CENTRAL = 10, 5


def slug(title: str) -> str:
    return re.sub(r"[^\w\- ]", "", title.lower()).strip().replace(" ", "-")


def render(chunks: DataFrame, nodes: DataFrame, edges: DataFrame | None = None, most_packages: int | None = None, only: str = "") -> str:
    """The guide of one project with all its packages, or the ``most_packages`` heaviest, or the single directory ``only``.

    Packages of test data are left out, and a summary that looks cut off is marked.  With ``edges`` packages tell what they
    import and what imports them.
    """
    placed = nodes.where("file_path <> ''").withColumn("dir", paths.dirname(F.col("file_path"))).where(~F.col("dir").rlike(r"(^|/)testdata(/|$)"))
    weights = placed.groupBy("dir").agg(F.sum("pagerank").alias("weight")).orderBy(F.desc("weight"), "dir")
    weights = weights.where(F.col("dir") == only) if only else weights
    weights = weights.limit(most_packages) if most_packages else weights
    top = {r.dir: r.weight for r in weights.collect()}
    families: dict[str, list[str]] = {}
    for d in top:
        families.setdefault(d.split("/", 1)[0], []).append(d)
    few = lambda rows, order, n: rows.withColumn("_n", F.row_number().over(Window.partitionBy("dir").orderBy(*order))).where(F.col("_n") <= n).join(weights.select("dir"), "dir", "left_semi")
    public = placed.where("kind in ('function', 'method', 'struct', 'interface', 'type', 'class')").where(F.col("name").rlike("^[A-Z]"))
    by_rank = [F.desc("pagerank"), F.desc("in_degree"), F.col("name"), F.col("id")]
    exported = few(public, by_rank, EXPORTED).select("dir", "name", "kind").collect()
    able = placed.where("kind in ('function', 'method') and in_degree > 0").withColumn("_own", ~F.col("name").rlike("^[A-Z]"))
    # directories without a public entry point show their inner ones
    able = able.withColumn("_some", F.max((~F.col("_own")).cast("int")).over(Window.partitionBy("dir"))).where("not _own or _some = 0")
    central = few(able, by_rank, CENTRAL).select("dir", "qualified_name", "in_degree", "_own").collect()
    newest = rollup.newest_per(chunks.where("kind = 'package_summary'").select("path", "content", "last_seen_at", "id"), ["path"], [F.desc("last_seen_at"), F.col("id")])
    summaries = {r.path: (r.content, r.cut) for r in newest.join(weights.select(F.col("dir").alias("path")), "path", "left_semi").select("path", "content", rollup.looks_truncated(F.col("content")).alias("cut")).collect()}
    overview = rollup.newest_per(chunks.where("kind = 'repo_summary'").select(F.lit(0).alias("one"), "content", "last_seen_at", "id"), ["one"], [F.desc("last_seen_at"), F.col("id")]).first()
    depends, users = _dependencies(placed, nodes, edges) if edges is not None else ({}, {})
    lines = ["# Guide", ""] + (["## Overview", "", overview.content or "", ""] if overview and not only else []) + ["## Contents", ""]
    for family, dirs in families.items():
        lines += ([f"**{family}/**", ""] if len(families) > 1 else []) + [f"- [{d}](#{slug(d)})" for d in dirs] + [""]
    for d in (d for dirs in families.values() for d in dirs):
        lines += [f"## {d}", ""]
        if d in summaries:
            text, cut = summaries[d]
            lines += [text, ""] + (["*The summary looks cut off.*", ""] if cut else [])
        for title, rows in (("Exported", [f"- `{r.name}` ({r.kind})" for r in exported if r.dir == d]), ("Key entry points", [f"- `{r.qualified_name}`, called from {r.in_degree} places" for r in central if r.dir == d and not r._own]), ("Key internal hot spots", [f"- `{r.qualified_name}`, called from {r.in_degree} places" for r in central if r.dir == d and r._own]), ("Depends on", [f"- {n}" for n in depends.get(d, [])]), ("Used by", [f"- {n}" for n in users.get(d, [])])):
            lines += [f"### {title}", "", *rows, ""] if rows else []
    return "\n".join(lines)


def _dependencies(placed: DataFrame, nodes: DataFrame, edges: DataFrame) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Per directory the names that its packages import, and the packages that import them; sorted, each once."""
    own = placed.where("package_path <> ''").select("dir", "package_path").distinct()
    names = nodes.where("kind = 'import' and package_path <> ''").select("package_path", "name").distinct()
    imports = own.join(names, "package_path").select("dir", "name").distinct()
    end = lambda e: nodes.where("package_path <> ''").select(F.col("id").alias(f"{e}_id"), F.col("package_path").alias(e))
    pairs = edges.where("kind = 'imports'").select("src_id", "dst_id").distinct().join(end("src"), "src_id").join(end("dst"), "dst_id").where("src <> dst").select("src", F.col("dst").alias("package_path")).distinct()
    used = pairs.join(own, "package_path").select("dir", F.col("src").alias("name")).distinct()
    listed = lambda d: {r.dir: list(r.names) for r in d.groupBy("dir").agg(F.array_sort(F.collect_set("name")).alias("names")).collect()}
    return listed(imports), listed(used)
