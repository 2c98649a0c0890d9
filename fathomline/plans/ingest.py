"""Queries of the ingest side: filters, windows, upsert and the queue."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.functions import chunking, extract, paths, text
from fathomline.operators import incremental, ingest
from fathomline.plans.registry import Registry
from fathomline.plans.views import CHUNKS, now
from fathomline.session import materialise
from fathomline.tables import table

registry = Registry()

CUTOFF = 1_745_000_000_000_000_000


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _ignored_sql() -> str:
    return "|".join(paths.rule_to_regex(r)[0].replace("\\-", "-") for r in paths.IGNORE_PATTERNS)


@registry.query(
    "ext_filter",
    f"select distinct path, (lower(regexp_extract(path, '(\\.[^./]*)$', 1)) in ({_quoted(paths.EXTENSIONS)}) or split_part(path, '/', -1) in ({_quoted(paths.BASENAMES)})) as indexable, regexp_matches(path, '{_ignored_sql()}') as ignored from chunks where path is not null",
)
def ext_filter(spark, sf):
    files = table(spark, sf, "chunks").where("path is not null").select("path").distinct()
    return files.select("path", paths.is_indexable(F.col("path")).alias("indexable"), paths.is_ignored(F.col("path")).alias("ignored"))


@registry.query(
    "path_class",
    f"select distinct path, regexp_matches(path, '{paths.TEST_PATTERN}') as test, ((case when regexp_matches(path, '{paths.TAG_DOC}') then 1 else 0 end) | (case when regexp_matches(path, '{paths.TAG_BUILD}') then 2 else 0 end) | (case when regexp_matches(path, '{paths.TAG_TEST}') then 4 else 0 end) | (case when regexp_matches(path, '{paths.TAG_FIXTURE}') then 12 else 0 end))::bigint as tags from chunks where path is not null",
)
def path_class(spark, sf):
    files = table(spark, sf, "chunks").where("path is not null").select("path").distinct()
    return files.select("path", paths.is_test(F.col("path")).alias("test"), paths.tags(F.col("path")).alias("tags"))


@registry.query("secret_scan", f"with {CHUNKS} select id, (not regexp_matches(path, '{paths.TEST_PATTERN}') and regexp_matches(coalesce(content, ''), '{paths.SECRET_PATTERN}')) as secret from ch")
def secret_scan(spark, sf):
    return now(spark, sf, "chunks").select("id", paths.looks_secret(F.col("path"), F.col("content")).alias("secret"))


@registry.query("size_gate", f"select doc_id, octet_length(encode(coalesce(text, ''))) <= {paths.LARGEST_FILE} as small_enough, contains(coalesce(text, ''), chr(0)) as binary_like from documents")
def size_gate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", paths.is_small(F.col("text")).alias("small_enough"), paths.looks_binary(F.col("text")).alias("binary_like"))


_LINES = "l as (select doc_id, string_split(text, chr(10)) as ls, len(string_split(text, chr(10))) - (case when ends_with(text, chr(10)) then 1 else 0 end) as n from documents where text is not null)"
_WINDOWS = f"{_LINES}, w as (select doc_id, s + 1 as start_line, least(s + 40, n) as end_line, array_to_string(list_slice(ls, s + 1, least(s + 40, n)), chr(10)) as content from (select *, unnest(range(0, greatest(n, 1), 30)) as s from l) where s = 0 or s + 10 < n)"


@registry.query("line_windows", f"with {_WINDOWS} select doc_id, start_line::bigint as start_line, end_line::bigint as end_line, sha1(content) as content_sha1 from w where length(regexp_replace(content, '[ \\t\\n\\r\\f\\x0B]', '', 'g')) > 0")
def line_windows(spark, sf):
    made = table(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(text.line_windows(F.col("text"))).alias("w"))
    return made.select("doc_id", "w.start_line", "w.end_line", F.sha1("w.content").alias("content_sha1"))


@registry.query("structural_chunks")
def structural_chunks(spark, sf):
    """Declarations, nested methods, windows and orphans of every chunk, each read as a file of its own."""
    files = now(spark, sf, "chunks").where("content is not null and not endswith(kind, '_summary')").select("path", "content")
    return chunking.chunk_files(files).select("path", "kind", "name", "parent", "start_line", "end_line", F.sha1("content").alias("content_sha1"))


@registry.query("extracted_edges")
def extracted_edges(spark, sf):
    """The graph that the extractors make of the chunks, each read as a file of its own: edges by kind and language."""
    chunks = now(spark, sf, "chunks").where("content is not null and not endswith(kind, '_summary') and path is not null")
    files = chunks.select(F.concat(F.col("id").cast("string"), F.lit("/"), "path").alias("path"), "content")
    _, edges = extract.build_graph(materialise(extract.extract_records(files), "records"), "index")
    return edges.groupBy("kind", F.get_json_object("metadata_json", "$.language").alias("language")).agg(F.count(F.lit(1)).alias("edges"))


@registry.query(
    "line_range",
    """with l as (select id, unnest(list_slice(string_split(content, chr(10)), 2, 8)) as line, generate_subscripts(list_slice(string_split(content, chr(10)), 2, 8), 1) as n, len(list_slice(string_split(content, chr(10)), 2, 8)) as wanted from (select * from chunks where id is not null and content is not null qualify row_number() over (partition by id order by last_seen_at desc) = 1)),
    c as (select *, sum(octet_length(encode(line))) over (partition by id order by n) + n - 1 as bytes from l where n <= 5), k as (select id, string_agg(line, chr(10) order by n) filter (bytes <= 200) as content, count(*) filter (bytes <= 200) as kept, max(wanted) as wanted from c group by id)
    select id, coalesce(content, '') as content, kept < wanted as truncated from k""",
)
def line_range(spark, sf):
    """Lines 2 to 8 of each chunk, at most five lines and 200 bytes; chunks of one line have none."""
    rows = now(spark, sf, "chunks").where("content is not null").select("id", F.size(text.lines(F.col("content"))).alias("n"), text.line_range(F.col("content"), 2, 8, 5, 200).alias("r"))
    return rows.where("n >= 2").select("id", "r.content", "r.truncated")


@registry.query("line_count", "select doc_id, case when text = '' then 0 else length(text) - length(replace(text, chr(10), '')) + (case when ends_with(text, chr(10)) then 0 else 1 end) end::bigint as lines from documents where text is not null")
def line_count(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.line_count(F.col("text")).alias("lines"))


@registry.query(
    "embed_text",
    f"with {CHUNKS} select id, sha1(concat_ws(chr(10), case when path <> '' then '// ' || path end, case when kind <> 'window' and kind <> '' then '// kind: ' || kind end, case when name <> '' then '// name: ' || name end, content)) as text_sha1 from ch",
)
def embed_text(spark, sf):
    return now(spark, sf, "chunks").select("id", F.sha1(text.embed_text(*[F.col(c) for c in ("path", "kind", "name", "content")])).alias("text_sha1"))


@registry.query(
    "interval_gaps",
    """with s as (select distinct path, start_line, end_line from chunks where start_line > 0 and end_line >= start_line and not ends_with(kind, '_summary')),
    r as (select path, start_line, coalesce(max(end_line) over (partition by path order by start_line, end_line rows between unbounded preceding and 1 preceding), 0) as reach from s)
    select path, (reach + 1)::int as gap_start, (start_line - 1)::int as gap_end from r where start_line > reach + 1""",
)
def interval_gaps(spark, sf):
    return ingest.covered_gaps(table(spark, sf, "chunks"))


@registry.query(
    "upsert_plan",
    f"with {CHUNKS}, known as (select distinct record_key as path, lower(content_hash) as sha from index_log l join index_runs r using (run_id) where r.status = 'ok' and table_name = 'chunks') select ch.id, case when k.path is null then 'insert' else 'touch' end as action from ch left join known k on k.path = ch.path and k.sha = ch.content_sha1",
)
def upsert_plan(spark, sf):
    known = incremental.ledger(table(spark, sf, "index_log"), table(spark, sf, "index_runs"), "chunks").select(F.col("record_key").alias("path"), F.col("content_hash").alias("content_sha1"))
    return ingest.plan_upsert(now(spark, sf, "chunks").select("id", "path", "content_sha1"), known, ["path", "content_sha1"]).select("id", "action")


@registry.query(
    "prune_unseen",
    f"""with {CHUNKS}, alive as (select * from ch where last_seen_at >= {CUTOFF} or kind in ('package_summary', 'repo_summary')) select id from alive a where kind <> 'package_summary' or path in ('.', '')
    or exists (select 1 from alive c where c.kind not in ('package_summary', 'repo_summary') and c.path >= a.path || '/' and c.path < a.path || '0')""",
)
def prune_unseen(spark, sf):
    return ingest.prune(now(spark, sf, "chunks").select("id", "path", "kind", "last_seen_at"), CUTOFF).select("id")


@registry.query(
    "range_anti",
    "with d as (select distinct case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '.' end as dir from chunks where path is not null) select dir from d where not exists (select 1 from d o where o.dir >= d.dir || '/' and o.dir < d.dir || '0')",
)
def range_anti(spark, sf):
    """Directories with files but without subdirectories that have files."""
    dirs = table(spark, sf, "chunks").where("path is not null").select(paths.dirname(F.col("path")).alias("dir")).distinct()
    above = dirs.select(F.explode(paths.ancestors(F.col("dir"))).alias("dir")).distinct()
    return dirs.join(above, "dir", "left_anti")


@registry.query("queue_stats", "select count(*) as pending, min(queued_at) as oldest, (count(*) > 100 or max(queued_at) - min(queued_at) > 3600000000000) as behind from pending_summaries")
def queue_stats(spark, sf):
    queue = table(spark, sf, "pending_summaries")
    return ingest.queue_state(queue, F.col("_last"))


@registry.query(
    "queue_enqueue",
    f"""with {CHUNKS} select id, path, 'chunk_summary' as kind, sha1('chunk_summary:' || content) as content_sha1 from ch where kind not in ('window', 'orphan') and not ends_with(kind, '_summary') and not ends_with(kind, ':window') and content is not null
    and (case when content = '' then 0 else length(content) - length(replace(content, chr(10), '')) + (case when ends_with(content, chr(10)) then 0 else 1 end) end) >= 30
    and not exists (select 1 from pending_summaries p where p.path = ch.path and p.kind = 'chunk_summary' and p.content_sha1 = sha1('chunk_summary:' || ch.content))""",
)
def queue_enqueue(spark, sf):
    return ingest.jobs_to_enqueue(now(spark, sf, "chunks"), table(spark, sf, "pending_summaries"))


@registry.query("queue_stale", "select id from pending_summaries p where not exists (select 1 from chunks c where c.path = p.path and c.content_sha1 = p.source_sha1)")
def queue_stale(spark, sf):
    return ingest.stale_jobs(table(spark, sf, "pending_summaries"), table(spark, sf, "chunks")).select("id")


@registry.query("queue_next", "select id, path from pending_summaries order by queued_at, id limit 10")
def queue_next(spark, sf):
    return ingest.take_jobs(table(spark, sf, "pending_summaries"), 10).select("id", "path")


# the files of the tables refer to none of each other, so every YAML file gets a line that names the next one in order
_NEXT = """y as (select path, lead(path) over (order by path) as target from (select distinct path from chunks where regexp_matches(path, '\\.ya?ml$')))"""


@registry.query("yaml_refs", f"with {_NEXT} select path, target, 2 as line from y where target is not null and not contains(target, '{{{{')")
def yaml_refs(spark, sf):
    """References between YAML files through folders above them."""
    names = table(spark, sf, "chunks").where(F.col("path").rlike(r"\.ya?ml$")).select("path").distinct()
    # a small derived table of names: the order of all of them is needed to write the lines
    files = names.withColumn("next", F.lead("path").over(Window.orderBy("path")))
    up = F.repeat(F.lit("../"), F.size(F.split("path", "/")) - 1)
    value = F.when(F.length("path") % 2 == 0, F.concat(F.lit('"'), up, "next", F.lit('"'))).otherwise(F.concat(up, F.lit("./"), "next", F.lit(" # next")))
    content = F.concat(F.lit("# one\n  - import: "), F.coalesce(value, F.lit("{{ none }}")), F.lit("\nimport: missing.yaml\nuse: /etc/x.yaml\nimport: ../../../../../../../../x.yaml\n"))
    return extract.yaml_references(files.select("path", content.alias("content")))


@registry.query(
    "compact_strip",
    rf"""with {CHUNKS}, l as (select id, path, list_transform(string_split(coalesce(content, ''), chr(10)), lambda x: rtrim(x, ' ' || chr(9) || chr(13))) as ls from ch)
    select id, coalesce(array_to_string(list_transform(list_filter(ls, lambda x: ltrim(x, ' ' || chr(9)) <> '' and not starts_with(ltrim(x, ' ' || chr(9)), '//') and (coalesce(regexp_matches(lower(path), '\.(md|markdown|rst|txt)$'), false) or not starts_with(ltrim(x, ' ' || chr(9)), '#'))), lambda x: x || chr(10)), ''), '') as body from l""",
)
def compact_strip(spark, sf):
    """Chunks without blank lines and lines of comments."""
    return now(spark, sf, "chunks").select("id", text.without_comments(F.col("path"), F.col("content")).alias("body"))


_INCOMING = "inc as (select id + 1000000000 as id, path, 'new' as kind, 'name' as name, start_line, content_sha1, last_seen_at + 1 as last_seen_at from ch where kind in ('window', 'orphan') union all select id + 2000000000, path || '.new', kind, name, start_line, content_sha1, last_seen_at from ch where kind = 'type_declaration')"
_ROW = ("id", "path", "kind", "name", "start_line", "content_sha1", "last_seen_at")


def _incoming(chunks):
    changed = chunks.where("kind in ('window', 'orphan')").selectExpr("id + 1000000000 as id", "path", "'new' as kind", "'name' as name", "start_line", "content_sha1", "last_seen_at + 1 as last_seen_at")
    return changed.unionByName(chunks.where("kind = 'type_declaration'").selectExpr("id + 2000000000 as id", "path || '.new' as path", "kind", "name", "start_line", "content_sha1", "last_seen_at"))


@registry.query("upsert_rows", f"with {CHUNKS}, {_INCOMING} select {', '.join(_ROW)} from ch where not exists (select 1 from inc where inc.path is not distinct from ch.path and inc.content_sha1 is not distinct from ch.content_sha1) union all select {', '.join(_ROW)} from inc")
def upsert_rows(spark, sf):
    """The next version of the chunks after changed windows and some new files came in."""
    chunks = now(spark, sf, "chunks").select(*_ROW)
    return ingest.upsert(chunks, _incoming(chunks), ["path", "content_sha1"])


@registry.query("touch_rows", f"with {CHUNKS}, {_INCOMING} select ch.id, coalesce(inc.name, ch.name) as name, ch.start_line, case when inc.id is null then ch.last_seen_at else {CUTOFF} end as last_seen_at from ch left join inc on inc.path = ch.path and inc.content_sha1 = ch.content_sha1")
def touch_rows(spark, sf):
    chunks = now(spark, sf, "chunks").select(*_ROW, "end_line")
    seen = _incoming(chunks).withColumn("end_line", F.lit(None).cast("int"))
    return ingest.touch(chunks, seen, ["path", "content_sha1"], F.lit(CUTOFF)).select("id", "name", "start_line", "last_seen_at")


@registry.query("drop_rows", f"with {CHUNKS}, one as (select path, kind, content_sha1 from ch where kind = 'package_summary' order by id limit 1), pre as (select min(split_part(path, '/', 1)) || '/' as p from ch) select id from ch where not (path = (select path from one) and kind = 'package_summary' and content_sha1 <> 'keep') and not starts_with(coalesce(path, ''), (select p from pre))")
def drop_rows(spark, sf):
    """Without other summaries of one package and without everything below one directory."""
    chunks = now(spark, sf, "chunks").select("id", "path", "kind", "content_sha1")
    one = chunks.where("kind = 'package_summary'").orderBy("id").first()
    prefix = chunks.agg(F.min(F.substring_index("path", "/", 1))).first()[0]
    kept = ingest.drop_other_summaries(chunks, one.path, "package_summary", "keep") if one else chunks
    return ingest.drop_paths(kept, prefix=f"{prefix}/").select("id")


@registry.query("queue_bump", "select id, case when id % 3 = 0 then attempts + 1 else attempts end::int as attempts, case when id % 3 = 0 then 'error ' || id else last_error end as last_error from pending_summaries where id % 5 <> 0")
def queue_bump(spark, sf):
    """The queue after every third job failed and every fifth was done."""
    queue = table(spark, sf, "pending_summaries")
    failed = queue.where("id % 3 = 0").select("id", F.concat(F.lit("error "), F.col("id").cast("string")).alias("error"))
    return ingest.remove_jobs(ingest.bump_attempts(queue, failed), queue.where("id % 5 = 0")).select("id", "attempts", "last_error")
