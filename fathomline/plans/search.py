"""Search queries over the chunk table."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import paths, text
from fathomline.functions.text import parse_query
from fathomline.operators import graph, postings, search
from fathomline.plans.graph import _DEGREES, _RANKS
from fathomline.plans.registry import Registry
from fathomline.plans.stored import centrality, term_index
from fathomline.plans.views import CHUNKS, now
from fathomline.tables import table

registry = Registry()

QUESTION = "merge ledger window cache"  # three terms or more: any of them
BOTH = "ledger window"  # two terms: all of them
PHRASE = '"return undefined"'
K = 10
POOL = 50

_VEC = f"{CHUNKS}, good as (select id, vec::double[] as v from ch where len(vec) = 64 and not list_contains(list_transform(vec, lambda x: coalesce(isfinite(x), false)), false) and list_contains(list_transform(vec, lambda x: x <> 0), true)), q as (select id as qid, v as qv from good order by id limit 1), sem as (select id, round(list_cosine_similarity(v, qv), 6) as score from good, q)"


def _sql_terms(question: str, mode: str = "auto", name: str = "lex", limit: int | None = K) -> str:
    parsed = parse_query(question, mode)
    cols, dfs, parts = [], [], []
    for i, t in enumerate(parsed.terms):
        if len(t) == 1:
            cols.append(f"len(list_filter(toks, lambda x: x = '{t[0]}')) as tf{i}")
        else:
            same = " and ".join(f"toks[i + {j}] = '{w}'" for j, w in enumerate(t))
            cols.append(f"len(list_filter(range(1, greatest(len(toks) - {len(t)} + 2, 2)), lambda i: coalesce({same}, false))) as tf{i}")
        dfs.append(f"sum((tf{i} > 0)::int) as df{i}")
        parts.append(f"(case when tf{i} > 0 then greatest(1e-6, ln((n - df{i} + 0.5) / (df{i} + 0.5))) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avgdl)) else 0 end)")
    joiner = " and " if parsed.conjunctive else " or "
    wanted = joiner.join(f"tf{i} > 0" for i in range(len(parsed.terms)))
    cut = f" order by score desc, id limit {limit}" if limit else ""
    return (
        f"tk as (select id, kind, regexp_extract_all(lower(concat_ws(chr(10), content, path, kind)), '[\\p{{L}}\\p{{N}}]+') as toks from ch), tf as (select id, kind, len(toks) as dl, {', '.join(cols)} from tk), "
        f"st as (select count(*) as n, avg(dl) as avgdl, {', '.join(dfs)} from tf), {name} as (select id, round(({' + '.join(parts)}) * case when kind = 'window' then 0.7 else 1 end, 6) as score from tf, st where {wanted}{cut})"
    )


def _question(spark, sf):
    """The vector of the chunk with the smallest id stands for an embedded question."""
    return search.usable_vectors(now(spark, sf, "chunks")).orderBy("id").limit(1).select(F.col("vec").alias("qvec"))


@registry.query("knn_cosine", f"with {_VEC} select id, score from sem order by score desc, id limit {K}")
def knn_cosine(spark, sf):
    return search.knn(now(spark, sf, "chunks"), _question(spark, sf), K)


@registry.query("related_chunks", f"with {_VEC} select id, score from (select * from sem order by score desc, id limit {K + 1}) where id <> (select qid from q) order by score desc, id limit {K}")
def related_chunks(spark, sf):
    chunks = now(spark, sf, "chunks")
    own = search.usable_vectors(chunks).orderBy("id").limit(1).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    near = search.knn(chunks, own.select("qvec"), K + 1)
    return near.crossJoin(F.broadcast(own.select("qid"))).where("id <> qid").select("id", "score").orderBy(F.desc("score"), "id").limit(K)


@registry.query(
    "knn_many",
    f"with {_VEC}, p as (select a.id as query_id, b.id, round(list_cosine_similarity(a.v, b.v), 6) as score from good a join good b on a.id <> b.id where a.id % 100 = 0) select query_id, id, score, row_number() over (partition by query_id order by score desc, id) as place from p qualify place <= {K}",
)
def knn_many(spark, sf):
    """Every chunk whose id is divisible by 100 as a query against all chunks."""
    chunks = now(spark, sf, "chunks").select("id", "vec")
    return search.knn_many(chunks, chunks.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), K)


def _bm25(question, mode="auto"):
    return lambda spark, sf: postings.bm25_stored(term_index(spark, sf), parse_query(question, mode), K)


registry.query("bm25_unindexed", f"with {CHUNKS}, {_sql_terms(QUESTION)} select * from lex")(lambda spark, sf: search.bm25(now(spark, sf, "chunks"), parse_query(QUESTION), K))
for _name, _q, _m in (("bm25_topk", QUESTION, "auto"), ("bm25_and", BOTH, "auto"), ("bm25_or", BOTH, "or"), ("phrase_match", PHRASE, "auto")):
    registry.query(_name, f"with {CHUNKS}, {_sql_terms(_q, _m)} select * from lex")(_bm25(_q, _m))

_HYBRID = (
    f"with {_VEC}, {_sql_terms(QUESTION, limit=None)}, s as (select id, row_number() over (order by score desc, id) as sem_rank from sem qualify sem_rank <= {{pool}}), "
    "l as (select id, row_number() over (order by score desc, id) as bm25_rank from lex qualify bm25_rank <= {pool}), "
    "fused as (select coalesce(s.id, l.id) as id, round(coalesce(1.0::double / (60 + sem_rank), 0) + coalesce(1.0::double / (60 + bm25_rank), 0), 6) as rrf, sem_rank, bm25_rank from s full join l on s.id = l.id), "
    "hit as (select * from fused order by rrf desc, id limit {k}), full_hit as (select hit.*, path, kind, name, start_line, end_line, content from hit join ch using (id)) "
)


def _hybrid_sql(k: int) -> str:
    return _HYBRID.replace("{pool}", str(max(5 * k, 30))).replace("{k}", str(k))


def _hits(spark, sf, k):
    chunks = now(spark, sf, "chunks")
    return search.attach(_fused(spark, sf, chunks, k), chunks)


def _fused(spark, sf, chunks, k):
    index = term_index(spark, sf)
    return search.hybrid(chunks, _question(spark, sf), parse_query(QUESTION), k, ranked=lambda query, pool: postings.bm25_stored(index, query, pool))


@registry.query("hybrid_rrf", _hybrid_sql(K) + "select hit.id, rrf, sem_rank, bm25_rank, sem.score as score from hit left join sem on sem.id = hit.id")
def hybrid_rrf(spark, sf):
    """Every hit has its cosine, also those that only the lexical leg found."""
    chunks, vector = now(spark, sf, "chunks"), _question(spark, sf)
    return search.with_cosine(_fused(spark, sf, chunks, K), chunks, vector)


@registry.query("demoted_hits", _hybrid_sql(POOL) + f", sides as (select *, regexp_matches(path, '{paths.TAG_DOC}') or regexp_matches(path, '{paths.TAG_BUILD}') or regexp_matches(path, '{paths.TAG_TEST}') or regexp_matches(path, '{paths.TAG_FIXTURE}') as side from full_hit) select id, row_number() over (order by side, rrf desc, id) as place from sides")
def demoted_hits(spark, sf):
    """Hits with documentation, build files and tests behind the rest, each in its order."""
    return search.demoted(_hits(spark, sf, POOL), _best()).select("id", "place")


@registry.query("summaries_first", _hybrid_sql(POOL) + f"select id, row_number() over (order by ends_with(kind, '_summary')::int desc, rrf desc, id) as place from full_hit qualify place <= {K}")
def summaries_first(spark, sf):
    hits = _hits(spark, sf, POOL)
    is_summary = F.col("kind").endswith("_summary")
    return search.filled_up(hits.where(is_summary), hits.where(~is_summary), _best(), K).select("id", "place")


@registry.query("hit_packages", _hybrid_sql(POOL) + ", nd as (select * from graph_nodes where id is not null qualify row_number() over (partition by id order by last_seen_at desc) = 1) select distinct package_path from full_hit join nd on nd.file_path = full_hit.path where package_path <> ''")
def hit_packages(spark, sf):
    """The packages of the files that were hit."""
    return graph.packages_of_paths(_hits(spark, sf, POOL), now(spark, sf, "graph_nodes"))


@registry.query(
    "chunk_rank",
    f"with {CHUNKS}, {_DEGREES}, {_RANKS}, nr as (select nd.*, round(pagerank, 9) as pagerank from nd join pr using (id)), cov as (select ch.id, max(nr.pagerank) as best from ch join nr on nr.file_path = ch.path and ch.start_line between nr.start_line and nr.end_line where nr.file_path <> '' group by ch.id), anyone as (select file_path as path, max(pagerank) as best from nr where file_path <> '' group by 1)"
    " select ch.id, case when cov.best > 0 then cov.best else coalesce(anyone.best, 0.0) end as pagerank from ch left join cov on cov.id = ch.id left join anyone on anyone.path = ch.path",
)
def chunk_rank(spark, sf):
    """The rank of the symbol that covers a chunk, else of the best one in its file."""
    ranks = centrality(spark, sf).select("id", F.round("pagerank", 9).alias("pagerank"))
    return graph.chunk_ranks(now(spark, sf, "chunks").select("id", "path", "start_line"), now(spark, sf, "graph_nodes").select("id", "file_path", "start_line", "end_line").join(ranks, "id"))


@registry.query("symbol_paths", f"with {CHUNKS} select name, count(distinct path) as paths from ch where name <> '' group by name having count(distinct path) > 1")
def symbol_paths(spark, sf):
    """Names that are defined in several files."""
    return now(spark, sf, "chunks").where("name <> ''").groupBy("name").agg(F.countDistinct("path").alias("paths")).where("paths > 1")


def _best():
    return [F.desc("rrf"), F.col("id")]


@registry.query("diversify", _hybrid_sql(POOL) + "select id, path, rrf from full_hit qualify row_number() over (partition by path order by rrf desc, id) <= 2")
def diversify(spark, sf):
    return search.diversify(_hits(spark, sf, POOL), _best(), 2).select("id", "path", "rrf")


@registry.query("exclude_prefix", _hybrid_sql(POOL) + "select id, path, rrf from full_hit where not starts_with(path, (select min(split_part(path, '/', 1)) from full_hit) || '/')")
def exclude_prefix(spark, sf):
    hits = _hits(spark, sf, POOL)
    first = hits.agg(F.min(F.substring_index("path", "/", 1)).alias("prefix"))
    return hits.crossJoin(F.broadcast(first)).where("not startswith(path, concat(prefix, '/'))").select("id", "path", "rrf")


@registry.query("summary_dedup", f"with {CHUNKS} select id, path, kind, start_line from ch where not (kind = 'chunk_summary' and exists (select 1 from ch o where o.path = ch.path and o.start_line = ch.start_line and not ends_with(o.kind, '_summary')))")
def summary_dedup(spark, sf):
    return search.drop_covered_summaries(now(spark, sf, "chunks").select("id", "path", "kind", "start_line")).select("id", "path", "kind", "start_line")


@registry.query("summary_search", _hybrid_sql(200) + "select id, kind, rrf from full_hit where kind in ('file_summary', 'package_summary', 'repo_summary') order by rrf desc, id limit 10")
def summary_search(spark, sf):
    pool = _hits(spark, sf, 20 * K)
    return pool.where(F.col("kind").isin("file_summary", "package_summary", "repo_summary")).select("id", "kind", "rrf").orderBy(*_best()).limit(K)


@registry.query(
    "rerank_overlap",
    _hybrid_sql(POOL)
    + f"select id, rrf, len(list_filter(['merge', 'ledger', 'window', 'cache'], lambda t: list_contains(regexp_extract_all(lower(coalesce(content, '')), '[\\p{{L}}\\p{{N}}]+'), t)))::bigint as rerank from full_hit order by rerank desc, id limit {K}",
)
def rerank_overlap(spark, sf):
    words = F.array(*[F.lit(t[0]) for t in parse_query(QUESTION).terms])
    shared = F.size(F.array_intersect(words, text.tokens(F.col("content")))).cast("bigint")
    return search.rerank(_hits(spark, sf, POOL), shared, K).select("id", "rrf", "rerank")


@registry.query(
    "format_hits",
    _hybrid_sql(5)
    + "select string_agg('--- chunk ' || rn || ': ' || path || ':' || coalesce(start_line, 0) || '-' || coalesce(end_line, 0) || ' (' || kind || ', ' || printf('%.6f', rrf) || ') ---' || chr(10) || coalesce(content, '') || chr(10), chr(10) order by rn) as context from (select *, row_number() over (order by rrf desc, id) as rn from full_hit)",
)
def format_hits(spark, sf):
    return search.format_hits(_hits(spark, sf, 5), _best())


@registry.query(
    "symbol_lookup",
    f"""with {CHUNKS}, {_DEGREES}, {_RANKS}, nr as (select nd.chunk_id as id, round(pagerank, 9) as pagerank, coalesce(in_degree, 0)::bigint as in_degree from nd left join pr using (id) left join deg using (id) where chunk_id is not null),
    br as (select id, pagerank, in_degree from nr qualify row_number() over (partition by id order by pagerank desc nulls last, in_degree desc) = 1),
    c as (select ch.id, ch.name, ch.path, ch.start_line, coalesce(pagerank, 0.0) as pagerank, coalesce(in_degree, 0) as in_degree from ch left join br on br.id = ch.id where ch.name <> '')
    select * from c qualify row_number() over (partition by name order by pagerank desc, in_degree desc, path nulls first, start_line nulls first, id) <= 10""",
)
def symbol_lookup(spark, sf):
    """For every symbol name its ten best definitions: rank in the graph, callers, then path and line."""
    measured = now(spark, sf, "graph_nodes").select("id", "chunk_id").where("chunk_id is not null").join(centrality(spark, sf), "id")
    measured = measured.select(F.col("chunk_id").alias("id"), F.round("pagerank", 9).alias("pagerank"), "in_degree")
    return search.definitions(now(spark, sf, "chunks").select("id", "name", "path", "start_line"), measured, 10)


@registry.query(
    "symbol_fallback",
    f"with {CHUNKS}, nd as (select * from graph_nodes where id is not null qualify row_number() over (partition by id order by last_seen_at desc) = 1) select id, name, file_path, start_line from nd where file_path <> '' and start_line > 0 and name <> '' and not exists (select 1 from ch where ch.name = nd.name)",
)
def symbol_fallback(spark, sf):
    """Nodes with a place in a file whose name no chunk has: what lookup falls back to."""
    nodes = now(spark, sf, "graph_nodes").where("file_path <> '' and start_line > 0 and name <> ''").select("id", "name", "file_path", "start_line")
    return nodes.join(now(spark, sf, "chunks").select("name"), "name", "left_anti").select("id", "name", "file_path", "start_line")


@registry.query("name_candidates", "select distinct name from chunks where contains(lower(name), 'ledger') and lower(name) <> 'ledger' order by length(name), name limit 5")
def name_candidates(spark, sf):
    names = table(spark, sf, "chunks").where(F.lower("name").contains("ledger") & (F.lower("name") != "ledger")).select("name").distinct()
    return names.orderBy(F.length("name"), "name").limit(5)


@registry.query("word_refs", r"""with l as (select path, start_line, unnest(string_split(coalesce(content, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(content, ''), chr(10)), 1) as n from chunks where not ends_with(kind, '_summary')) select distinct path, greatest(coalesce(start_line, 1), 1) + n - 1 as line_no from l where regexp_matches(line, '(^|[^A-Za-z0-9_])ledger([^A-Za-z0-9_]|$)')""")
def word_refs(spark, sf):
    """Whole-word uses of a name by file and line."""
    rows = table(spark, sf, "chunks").where(~F.col("kind").endswith("_summary") & F.col("content").contains("ledger")).select("path", "start_line", F.posexplode(text.lines(F.col("content"))).alias("n", "line"))
    hit = rows.where(F.col("line").rlike(r"(^|[^A-Za-z0-9_])ledger([^A-Za-z0-9_]|$)"))
    return hit.select("path", (F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)).cast("bigint") + F.col("n")).alias("line_no")).distinct()


@registry.query(
    "index_stats",
    f"with {CHUNKS} select count(*) as chunks, count(distinct path) as files, max(last_seen_at) as last_seen from ch",
)
def index_stats(spark, sf):
    return now(spark, sf, "chunks").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("path").alias("files"), F.max("last_seen_at").alias("last_seen"))


