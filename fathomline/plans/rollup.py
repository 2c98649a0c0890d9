"""Queries of roll-ups, the router and debounced events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.functions import paths
from fathomline.operators import rollup, router, search
from fathomline.plans.graph import _DIR as _FILE_DIR
from fathomline.plans.graph import _FLOW, _RANKS
from fathomline.plans.ingest import _ignored_sql
from fathomline.plans.registry import Registry
from fathomline.plans.search import _VEC, POOL, _best, _hits, _hybrid_sql, _question
from fathomline.plans.stored import centrality
from fathomline.plans.views import CHUNKS, NODES, now
from fathomline.streaming import watch
from fathomline.tables import table

registry = Registry()

_DIR = "case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '.' end"


@registry.query("latest_per_key", "select path, doc_id, updated_at from documents where path is not null qualify row_number() over (partition by path order by updated_at desc nulls last, doc_id desc) = 1")
def latest_per_key(spark, sf):
    docs = table(spark, sf, "documents").where("path is not null").select("path", "doc_id", "updated_at")
    return rollup.newest_per(docs, ["path"], [F.desc_nulls_last("updated_at"), F.desc("doc_id")])


@registry.query(
    "pkg_rollup_key",
    f"""with f as (select path, sha1(string_agg(content_sha1, ':' order by content_sha1)) as file_sha from (select distinct path, content_sha1 from chunks where not ends_with(kind, '_summary') and content_sha1 is not null and path is not null) group by path),
    m as (select {_DIR} as dir, file_sha, regexp_matches(path, '{paths.TEST_PATTERN}') as test from f), u as (select *, max(not test) over (partition by dir) as prod from m)
    select dir, count(*) as files, sha1('v1' || chr(0) || string_agg(file_sha, ':' order by file_sha)) as package_sha from u where not test or not prod group by dir""",
)
def pkg_rollup_key(spark, sf):
    return rollup.package_keys(table(spark, sf, "chunks"))


@registry.query("rollup_concat", f"with {CHUNKS} select split_part(path, '/', 1) as grp, count(*) as summaries, string_agg(content, chr(10) || chr(10) order by path, id) as text from ch where ends_with(kind, '_summary') and content is not null group by grp")
def rollup_concat(spark, sf):
    summaries = now(spark, sf, "chunks").where("endswith(kind, '_summary')").select("id", "path", "content")
    return rollup.joined_summaries(summaries, F.substring_index("path", "/", 1))


_WEIGHT = f"{_FLOW}, {_RANKS}, w as (select {_FILE_DIR} as dir, round(sum(pagerank), 8) as weight from nd join pr using (id) where file_path <> '' group by dir)"
_PACKAGES = f"pk as (select id, {_DIR} as dir from ch where kind = 'package_summary'), pw as (select pk.id, pk.dir, coalesce(weight, 0.0) as weight from pk left join w using (dir) where '/' || dir || '/' not like '%/testdata/%')"


def _packages(spark, sf):
    """Package summaries with the summed rank of the directory that they lie in."""
    weights = now(spark, sf, "graph_nodes").where("file_path <> ''").join(centrality(spark, sf), "id").groupBy(paths.dirname(F.col("file_path")).alias("dir")).agg(F.round(F.sum("pagerank"), 8).alias("weight"))
    return rollup.summarised_packages(now(spark, sf, "chunks").where("kind = 'package_summary'").select("id", paths.dirname(F.col("path")).alias("path")), weights)


@registry.query("repo_input", f"with {CHUNKS}, {_WEIGHT}, {_PACKAGES} select id, dir, weight from pw order by weight desc, dir, id limit 15")
def repo_input(spark, sf):
    """The 15 package summaries of the most central directories."""
    return _packages(spark, sf).orderBy(F.desc("weight"), "dir", "id").limit(15)


@registry.query(
    "toc_groups",
    f"with {CHUNKS}, {_WEIGHT}, {_PACKAGES}, d as (select dir, max(weight) as weight from pw group by dir) select split_part(dir, '/', 1) as family, dir, row_number() over x as place, first_value(weight) over x as family_weight, first_value(dir) over x as family_first from d window x as (partition by split_part(dir, '/', 1) order by weight desc, dir)",
)
def toc_groups(spark, sf):
    return rollup.contents_groups(_packages(spark, sf).groupBy("dir").agg(F.max("weight").alias("weight")))


@registry.query(
    "truncation_check",
    f"""with {CHUNKS}, b as (select id, trim(coalesce(content, ''), ' ' || chr(9) || chr(10) || chr(13)) as t from (select id, content from ch where ends_with(kind, '_summary') union all select -doc_id, text from documents))
    select id, ends_with(t, '- **') or ends_with(t, '- *') or (len(string_split(t, '`')) - 1) % 2 = 1 or (len(string_split(t, '**')) - 1) % 2 = 1 as truncated from b""",
)
def truncation_check(spark, sf):
    """Summaries, and all documents under negative ids, that look cut off."""
    summaries = now(spark, sf, "chunks").where("endswith(kind, '_summary')").select("id", "content")
    texts = table(spark, sf, "documents").select((-F.col("doc_id")).alias("id"), F.col("text").alias("content"))
    return summaries.unionByName(texts).select("id", rollup.looks_truncated(F.col("content")).alias("truncated"))


@registry.query("group_averages", "select lower(lang) as lang, count(*) as documents, round(avg(n_chars), 6) as mean, round(median(n_chars), 6) as median from documents where lang is not null group by 1")
def group_averages(spark, sf):
    docs = table(spark, sf, "documents").where("lang is not null").select(F.lower("lang").alias("lang"), "n_chars")
    return rollup.averages(docs, ["lang"], "n_chars").select("lang", F.col("rows").alias("documents"), F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


_RECEIVER, _QUALIFIED = router.RECEIVER, router.QUALIFIED
_IDENT = f"""base as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '{_RECEIVER}', ' ', 'g') as t1 from documents),
    parts as (select doc_id, t, list_concat(regexp_extract_all(t, '{_RECEIVER}', 1), regexp_extract_all(t1, '{_QUALIFIED}', 1)) as qualified, regexp_extract_all(regexp_replace(t1, '{_QUALIFIED}', ' ', 'g'), '{router.WORD}', 1) as words from base),
    found as (select doc_id, t, list_distinct(list_concat(qualified, list_filter(words, lambda x: regexp_matches(x, '{router.PASCAL}') or regexp_matches(x, '{router.CAMEL}') or regexp_matches(x, '{router.SNAKE}')))) as ids from parts),
    ident as (select doc_id, t, case when len(ids) > 0 then ids when regexp_extract(t, '{router.SINGLE}', 1) <> '' then [regexp_extract(t, '{router.SINGLE}', 1)] else [] end as ids from found)"""


@registry.query("identifiers", f"with {_IDENT} select doc_id, len(ids)::bigint as n, sha1(array_to_string(list_sort(ids), ',')) as ids_sha1 from ident")
def identifiers(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", router.identifiers(F.col("text")).alias("ids"))
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n"), F.sha1(F.array_join(F.array_sort("ids"), ",")).alias("ids_sha1"))


_CASES = " ".join(f"when regexp_matches(lower(t), '{router.intent_pattern(n)}') then '{n}'" for n, _ in router.INTENT_PHRASES)


@registry.query("intent_route", f"with {_IDENT} select doc_id, case {_CASES} when len(ids) > 0 and len(list_filter(regexp_split_to_array(lower(t), '[ \\t\\r\\n]+'), lambda x: x <> '')) between 1 and 3 then 'symbol_lookup' else 'behavior_search' end as intent from ident")
def intent_route(spark, sf):
    return table(spark, sf, "documents").select("doc_id", router.intent(F.col("text")).alias("intent"))


@registry.query(
    "suggested_reads",
    _hybrid_sql(POOL)
    + f""", n as (select *, ((case when regexp_matches(path, '{paths.TAG_DOC}') then 1 else 0 end) + (case when regexp_matches(path, '{paths.TAG_BUILD}') then 1 else 0 end) + (case when regexp_matches(path, '{paths.TAG_TEST}') then 1 else 0 end) + (case when regexp_matches(path, '{paths.TAG_FIXTURE}') then 1 else 0 end)) > 0 as side from full_hit where start_line > 0 and end_line >= start_line),
    f as (select * from n qualify row_number() over (partition by path order by side, rrf desc, id) = 1) select path, start_line, end_line, row_number() over (order by side, rrf desc, id) as place from f qualify place <= 5""",
)
def suggested_reads(spark, sf):
    return router.suggested_reads(_hits(spark, sf, POOL), "rrf", most=5)


@registry.query(
    "summary_penalty",
    f"""with {_VEC}, {NODES} select ch.id, sem.score, round(case when regexp_replace(lower(split_part(path, '/', -1)), '(.)\\.[^.]*$', '\\1') in ({", ".join(f"'{x}'" for x in router.ARCHITECTURE_DOCS)}) or path in (select file_path from nd where file_path <> '') then score else score - 0.2 end, 6) as adjusted from ch join sem using (id) where kind in ('file_summary', 'package_summary', 'repo_summary')""",
)
def summary_penalty(spark, sf):
    chunks = now(spark, sf, "chunks")
    scored = search.usable_vectors(chunks.where("kind in ('file_summary', 'package_summary', 'repo_summary')")).crossJoin(F.broadcast(_question(spark, sf))).select("id", "path", search.cosine(F.col("vec"), F.col("qvec")).alias("score"))
    return router.penalise_summaries(scored, now(spark, sf, "graph_nodes"), "score").select("id", "score", "adjusted")


_ITEMS = f"""it as (select row_number() over (order by lane, place, id) as n, lane, id, content, is_whole from (
      select 0 as lane, row_number() over (order by rrf desc, id) as place, id, coalesce(content, '') as content, false as is_whole from (select * from full_hit order by rrf desc, id limit 5)
      union all select 2, row_number() over (order by rrf desc, id), id, coalesce(content, ''), ends_with(kind, '_summary') from full_hit where not regexp_matches(path, '{paths.TEST_PATTERN}')))"""


@registry.query(
    "budget_cut",
    _hybrid_sql(POOL).replace("with ", "with recursive ", 1)
    + f""", {_ITEMS}, step as (select 0::bigint as n, -1 as lane, 0::bigint as id, '' as content, false as truncated, 12288::bigint as budget
      union all select c.n, c.lane, c.id, case when c.is_whole then c.raw else array_to_string(list_slice(c.ls, 1, c.keep), chr(10)) end, not c.is_whole and c.keep < c.wanted,
        c.budget - case when c.is_whole then octet_length(encode(c.raw)) when c.keep = 0 then 0 else list_sum(list_transform(list_slice(c.ls, 1, c.keep), lambda x: octet_length(encode(x)))) + c.keep - 1 end
      from (select b.*, len(list_filter(range(1, len(ls) + 1), lambda k: list_sum(list_transform(list_slice(ls, 1, k), lambda x: octet_length(encode(x)))) + k - 1 <= least(4096, budget))) as keep
        from (select it.n, it.lane, it.id, it.content as raw, it.is_whole, step.budget, list_slice(string_split(it.content, chr(10)), 1, 60) as ls, len(string_split(it.content, chr(10))) as wanted from step join it on it.n = step.n + 1 where step.budget > 0) b) c)
    select n as place, lane, id, content, truncated, budget as left_over from step where n > 0""",
)
def budget_cut(spark, sf):
    """Five reads and then the other hits, cut by lines and bytes until a budget of 12 KiB is used."""
    hits = _hits(spark, sf, POOL)
    reads = hits.orderBy(*_best()).limit(5).withColumn("lane", F.lit(0))
    others = hits.where(~paths.is_test(F.col("path"))).withColumn("lane", F.lit(2))
    place = F.row_number().over(Window.partitionBy("lane").orderBy(*_best()))
    items = reads.unionByName(others).select("lane", place.alias("place"), "id", "content", F.when(F.col("lane") == 2, F.col("kind").endswith("_summary")).otherwise(False).alias("is_whole"))
    return router.inline_content(items, 12 * 1024, 60, 4096)


@registry.query("low_signal", f"with {_VEC} select id, score from (select * from sem order by score desc, id limit {POOL}) qualify max(score) over () >= 0.45 or score >= 0.40")
def low_signal(spark, sf):
    return router.without_low_signal(search.knn(now(spark, sf, "chunks"), _question(spark, sf), POOL), "score")


# the tables have no documents of these names, so every directory whose path has an even length gets one or two
_DOCS = f"""f as (select distinct path from chunks where path is not null), dirs0 as (select distinct {_DIR} as dir from f where length(path) % 2 = 0),
    files as (select path from f union select case when dir = '.' then '' else dir || '/' end || 'README.md' from dirs0 union select dir || '/doc.go' from dirs0 where length(dir) % 3 = 0 and dir <> '.' union select dir || '/CLAUDE.md' from dirs0 where length(dir) % 5 = 0 and dir <> '.')"""


@registry.query(
    "nearest_doc",
    f"""with {_DOCS}, up as (select path, unnest(range(1, 11)) as far, string_split(path, '/') as p from files), above as (select path, far, case when far = len(p) then '' when far < len(p) then array_to_string(list_slice(p, 1, len(p) - far), '/') || '/' end as dir from up where far <= len(p)),
    tried as (select path, far, n as priority, dir || name as doc from above, (values (0, 'CLAUDE.md'), (1, 'doc.go'), (2, 'README.md')) v(n, name))
    select path, arg_min(doc, far * 10 + priority) as doc from tried where doc <> path and doc in (select path from files) group by path""",
)
def nearest_doc(spark, sf):
    files = _with_documents(table(spark, sf, "chunks").where("path is not null").select("path").distinct())
    return router.nearest_document(files, router.describing_documents(files))


def _with_documents(files):
    dirs = files.where("length(path) % 2 = 0").select(paths.dirname(F.col("path")).alias("dir")).distinct()
    named = lambda d, name: d.select(F.concat("dir", F.lit(f"/{name}")).alias("path"))
    below = dirs.where("dir <> '.'")
    readme = dirs.select(F.when(F.col("dir") == ".", "README.md").otherwise(F.concat("dir", F.lit("/README.md"))).alias("path"))
    return files.union(readme).union(named(below.where("length(dir) % 3 = 0"), "doc.go")).union(named(below.where("length(dir) % 5 = 0"), "CLAUDE.md")).distinct()


@registry.query(
    "test_pairs",
    """with f0 as (select distinct path from chunks where path is not null),
    f as (select path from f0 union select regexp_replace(path, '\\\\.(go|py)$', '_test.\\\\1') from f0 where length(path) % 2 = 0 and regexp_matches(path, '\\\\.(go|py)$') union select regexp_replace(path, '\\\\.(tsx?|jsx?)$', '.spec.\\\\1') from f0 where length(path) % 3 = 0 and regexp_matches(path, '\\\\.(tsx?|jsx?)$')),
    s as (select path, regexp_replace(path, '[^/]*$', '') as folder, lower(regexp_extract(path, '(\\.[^./]*)$', 1)) as ext, regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') as stem from f),
    c as (select path, unnest(case when ext = '.go' and not ends_with(stem, '_test') then [folder || stem || '_test.go'] when ext = '.py' and not starts_with(stem, 'test_') and not ends_with(stem, '_test') then [folder || 'test_' || stem || '.py', folder || stem || '_test.py']
    when ext in ('.ts', '.tsx', '.js', '.jsx') and not contains(stem, '.test') and not contains(stem, '.spec') then [folder || stem || '.test' || ext, folder || stem || '.spec' || ext] else [] end) as test from s) select path, test from c where test in (select path from f)""".replace("\\\\", "\\"),
)
def test_pairs(spark, sf):
    """The tables have no tests beside their files, so some files get one."""
    files = table(spark, sf, "chunks").where("path is not null").select("path").distinct()
    go_py, script = r"\.(go|py)$", r"\.(tsx?|jsx?)$"
    made = files.where(F.col("path").rlike(go_py) & (F.length("path") % 2 == 0)).select(F.regexp_replace("path", go_py, r"_test.$1").alias("path"))
    more = files.where(F.col("path").rlike(script) & (F.length("path") % 3 == 0)).select(F.regexp_replace("path", script, r".spec.$1").alias("path"))
    return router.test_pairs(files.union(made).union(more))


@registry.query(
    "debounce_sessions",
    """with e as (select user_id, ts, case when ts - lag(ts) over w <= interval 6 hours then 0 else 1 end as fresh from events where user_id is not null and ts is not null window w as (partition by user_id order by ts)),
    s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from e) select user_id, min(ts) as started, max(ts) as ended, count(*) as events from s group by user_id, n""",
)
def debounce_sessions(spark, sf):
    runs = watch.debounce(table(spark, sf, "events").where("user_id is not null and ts is not null"), "user_id", gap="6 hours")
    return runs.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")], "events")


_KINDS = ("create", "write", "chmod", "remove", "rename", "WRITE", "other")
_EXT_LIST, _NAME_LIST = (", ".join(f"'{x}'" for x in values) for values in (paths.EXTENSIONS, paths.BASENAMES))


@registry.query(
    "event_filter",
    f"""with e as (select path, list_extract([{", ".join(f"'{k}'" for k in _KINDS)}], (length(path) % {len(_KINDS)} + 1)::int) as event_type from (select path from chunks where path is not null union all select '.git/' || path from chunks where path is not null union all select path || '.bin' from chunks where path is not null))
    select event_type, path, count(*) as events from e where lower(event_type) in ('create', 'write', 'remove', 'rename') and not regexp_matches(path, '{_ignored_sql()}')
    and (lower(event_type) in ('remove', 'rename') or lower(regexp_extract(path, '(\\.[^./]*)$', 1)) in ({_EXT_LIST}) or split_part(path, '/', -1) in ({_NAME_LIST})) group by all""",
)
def event_filter(spark, sf):
    """Changes of all files, of copies of them in an ignored folder and under an unknown extension: those that matter, counted."""
    p = table(spark, sf, "chunks").where("path is not null").select("path")
    all_paths = p.unionAll(p.select(F.concat(F.lit(".git/"), "path").alias("path"))).unionAll(p.select(F.concat("path", F.lit(".bin")).alias("path")))
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), F.length("path") % len(_KINDS) + 1)
    return watch.relevant_events(all_paths.select("path", kind.alias("event_type"))).groupBy("event_type", "path").agg(F.count(F.lit(1)).alias("events"))


@registry.query(
    "capped_refs",
    r"""with l as (select path, start_line, unnest(string_split(coalesce(content, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(content, ''), chr(10)), 1) as n from chunks where not ends_with(kind, '_summary')),
    r as (select distinct s.symbol, path, greatest(coalesce(start_line, 1), 1) + n - 1 as line_no from l, (values ('ledger'), ('window'), ('cache')) s(symbol) where regexp_matches(line, '(^|[^A-Za-z0-9_])' || s.symbol || '([^A-Za-z0-9_]|$)')),
    c as (select *, row_number() over (partition by symbol order by path nulls first, line_no) as per from r) select symbol, path, line_no from c where per <= 20 order by symbol, per limit 30""",
)
def capped_refs(spark, sf):
    """Uses of three names, at most 20 of each and 30 in all."""
    chunks = table(spark, sf, "chunks").where(~F.col("kind").endswith("_summary"))
    return router.capped_references(router.word_references(chunks, ["ledger", "window", "cache"]), 20, 30)
