"""Search over chunks: cosine neighbours, BM25, fusion and the steps that follow a ranking.

Rankings have a total order (ties go to the smaller id) and scores are rounded to 6 decimals before they are compared,
so that results do not depend on the order in which partial sums were added.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import paths
from fathomline.functions.text import ParsedQuery, tokens
from fathomline.session import materialise

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
WINDOW_WEIGHT = 0.7
RRF_OFFSET = 60


def usable_vectors(chunks: DataFrame, dimensions: int = 64) -> DataFrame:
    """Rows whose ``vec`` has that many finite numbers, not all zero."""
    v = F.col("vec")
    good = (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return chunks.where(F.coalesce(good, F.lit(False)))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    return F.round(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), 6)


def knn(chunks: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """``id, score`` of the ``k`` chunks with the highest cosine to the single row ``query(qvec)``.

    The query is one row and is broadcast; only ``k`` rows of each task reach the final merge.  A zero query vector or one
    of another dimension finds nothing; an empty index gives an empty result.
    """
    scored = usable_vectors(chunks).select("id", "vec").crossJoin(F.broadcast(query.limit(1)))
    return scored.select("id", cosine(F.col("vec"), F.col("qvec")).alias("score")).where("score is not null").orderBy(F.desc("score"), "id").limit(k)


def knn_many(chunks: DataFrame, queries: DataFrame, k: int, block: int = 2048, dimensions: int = 64) -> DataFrame:
    """``query_id, id, score, place``: the ``k`` chunks nearest to every row of ``queries(query_id, qvec)``, itself left out.

    Exact: blocks of queries meet slices of the rows, each pair of them in one task, which passes on ``k`` rows per query.
    A row is sent once per block and a query once per slice.  Unusable vectors take no part; repeated ids in either table
    count once (with the largest vector); ties go to the smaller id; empty tables give no rows.
    """
    rows = usable_vectors(chunks, dimensions).where("id is not null").groupBy("id").agg(F.max("vec").alias("vec"))
    asked = usable_vectors(queries.select(F.col("query_id").alias("id"), F.col("qvec").alias("vec")), dimensions).where("id is not null").groupBy("id").agg(F.max("vec").alias("vec"))
    rows, asked = materialise(rows, "rows"), materialise(asked, "queries")
    blocks, slices = max(1, -(-asked.count() // block)), max(1, -(-rows.count() // (16 * block)))
    spread = lambda d, own, n, other, m: d.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), "id", "vec")
    left, right = spread(asked, "b", blocks, "s", slices), spread(rows, "s", slices, "b", blocks)

    def best(q: pa.Table, r: pa.Table) -> pa.Table:
        empty = pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not q.num_rows or not r.num_rows:
            return empty
        r = r.sort_by("id")  # positions are in the order of the ids
        matrix = lambda t: np.asarray(t["vec"].combine_chunks().flatten(), dtype=np.float64).reshape(-1, dimensions)
        unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        x, y = unit(matrix(q)), unit(matrix(r))
        qid, rid = np.asarray(q["id"]), np.asarray(r["id"])
        out: list[tuple] = []
        for a in range(0, len(qid), 256):
            s = np.round(x[a : a + 256] @ y.T, 6)
            s[qid[a : a + 256, None] == rid[None, :]] = -9
            take = min(k, s.shape[1])
            last = -np.partition(-s, take - 1, axis=1)[:, take - 1 : take]
            above, tied = s > last, s == last
            above |= tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= take - above.sum(axis=1, keepdims=True))
            i, j = np.nonzero(above & (s > -9))
            out.append((qid[a + i], rid[j], s[i, j]))
        return pa.table({n: np.concatenate([o[c] for o in out]) for c, n in enumerate(("query_id", "id", "score"))})

    found = left.groupBy("b", "s").cogroup(right.groupBy("b", "s")).applyInArrow(best, "query_id bigint, id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= k)


def tokenised(chunks: DataFrame) -> DataFrame:
    """``id, path, kind, toks``: the tokens of content, path and kind, which are all searched."""
    return chunks.select("id", "path", "kind", tokens(F.concat_ws("\n", "content", "path", "kind")).alias("toks"))


def _matches(term: list[str]) -> Column:
    """How often a term (one token, or a phrase of consecutive ones) occurs."""
    if len(term) == 1:
        return F.size(F.filter("toks", lambda t: t == F.lit(term[0]))).cast("long")
    every = F.array_contains("toks", term[0])
    for word in term[1:]:
        every = every & F.array_contains("toks", word)
    n = len(term)
    if any(term[i:] == term[: n - i] for i in range(1, n)):
        # occurrences may overlap, so each position is looked at
        spots = F.sequence(F.lit(0), F.greatest(F.size("toks") - n, F.lit(0)))
        found = lambda i: F.slice("toks", i + 1, n) == F.array(*map(F.lit, term))
        return F.when(every, F.size(F.filter(spots, found))).otherwise(0).cast("long")
    # tokens hold letters and digits only, so marks around each of them make a phrase a plain substring
    text = F.concat(F.lit("<"), F.array_join("toks", "><"), F.lit(">"))
    phrase = "<" + "><".join(term) + ">"
    return F.when(every, ((F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase))).otherwise(0).cast("long")


def bm25(chunks: DataFrame, query: ParsedQuery, k: int) -> DataFrame:
    """``id, score`` of the ``k`` best chunks by BM25; windows count 0.7 of other kinds.

    Only the terms of the query are counted, in one pass over the text; document frequencies and lengths are sums that
    tasks merge, and come back as a single row.  A query without terms finds nothing.
    """
    if not query.terms:
        return chunks.select("id", F.lit(0.0).alias("score")).limit(0)
    # a few numbers per chunk, written once: otherwise filters are pushed into the scan and tokenise the text again
    counted = materialise(tokenised(chunks).select("id", "kind", F.size("toks").cast("long").alias("dl"), *[_matches(t).alias(f"tf{i}") for i, t in enumerate(query.terms)]), "counts")
    every = range(len(query.terms))
    stats = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in every])
    hit = [F.col(f"tf{i}") > 0 for i in every]
    wanted = hit[0]
    for h in hit[1:]:
        wanted = wanted & h if query.conjunctive else wanted | h
    part = lambda i: F.greatest(F.lit(LEAST_IDF), F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    score = sum((F.when(hit[i], part(i)).otherwise(0.0) for i in every), F.lit(0.0)) * F.when(F.col("kind") == "window", WINDOW_WEIGHT).otherwise(1.0)
    return counted.where(wanted).crossJoin(F.broadcast(stats)).select("id", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def fuse(semantic: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (id, score): ``id, rrf, sem_rank, bm25_rank``, the ``k`` best.

    The lists are bounded by their pools, so a window over each is a window over at most that many rows.
    """
    ranked = lambda d, name: d.select("id", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long").alias(name))
    both = ranked(semantic, "sem_rank").join(ranked(lexical, "bm25_rank"), "id", "full")
    share = lambda c: F.when(F.col(c).isNotNull(), F.lit(1.0) / (RRF_OFFSET + F.col(c))).otherwise(0.0)
    return both.select("id", F.round(share("sem_rank") + share("bm25_rank"), 6).alias("rrf"), "sem_rank", "bm25_rank").orderBy(F.desc("rrf"), "id").limit(k)


def hybrid(chunks: DataFrame, query_vector: DataFrame, query: ParsedQuery, k: int, lexical: bool = True, ranked: Callable[[ParsedQuery, int], DataFrame] | None = None) -> DataFrame:
    """Hybrid search: both legs up to ``max(5k, 30)``, fused, the ``k`` best; the cosine leg alone without query terms.

    ``ranked(query, k)`` gives the lexical leg from a stored index; without it the text is searched.
    """
    pool = max(5 * k, 30)
    semantic = knn(chunks, query_vector, pool)
    asked = query if lexical else ParsedQuery([], False)
    legs = ranked(asked, pool) if ranked else bm25(chunks, asked, pool)
    return fuse(semantic, legs, k)


def with_cosine(hits: DataFrame, chunks: DataFrame, query_vector: DataFrame) -> DataFrame:
    """``hits`` with ``score``, their cosine to the single row ``query_vector(qvec)``: null where a hit has no usable vector.

    Hits are a top-k list and are broadcast, so only their vectors are looked at.
    """
    own = usable_vectors(chunks.select("id", "vec").join(F.broadcast(hits.select("id")), "id", "left_semi")).crossJoin(F.broadcast(query_vector.limit(1)))
    return hits.join(own.select("id", cosine(F.col("vec"), F.col("qvec")).alias("score")), "id", "left")


def definitions(chunks: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """``id, name, path, start_line, pagerank, in_degree`` of the ``k`` best chunks of every name.

    ``ranks(id, pagerank, in_degree)`` are those of the nodes behind a chunk, of which the best counts.  Order: rank,
    callers, path, line, id; chunks without nodes have zeros.  Null and empty names have no definitions.
    """
    best = ranks.where("id is not null").groupBy("id").agg(F.max(F.struct("pagerank", "in_degree")).alias("_r"))
    rows = chunks.where("name <> ''").join(best, "id", "left").select("id", "name", "path", "start_line", F.coalesce("_r.pagerank", F.lit(0.0)).alias("pagerank"), F.coalesce("_r.in_degree", F.lit(0)).alias("in_degree"))
    order = Window.partitionBy("name").orderBy(F.desc("pagerank"), F.desc("in_degree"), F.asc_nulls_first("path"), F.asc_nulls_first("start_line"), "id")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def demoted(hits: DataFrame, order: list[Column]) -> DataFrame:
    """A top-k list with ``place``: files that implement nothing (documents, builds, tests) behind all others."""
    side = (paths.tags(F.col("path")) != 0).cast("int")
    return hits.withColumn("place", F.row_number().over(Window.orderBy(F.coalesce(side, F.lit(0)), *order)).cast("bigint"))


def filled_up(first: DataFrame, rest: DataFrame, order: list[Column], k: int) -> DataFrame:
    """One list of ``k`` with ``place``: all of the first list in order, then the rest in order."""
    both = first.withColumn("_lane", F.lit(0)).unionByName(rest.withColumn("_lane", F.lit(1)))
    return both.withColumn("place", F.row_number().over(Window.orderBy("_lane", *order)).cast("bigint")).where(F.col("place") <= k).drop("_lane")


def attach(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with path, kind, name, lines and content; hits are few and are broadcast."""
    return chunks.select("id", "path", "kind", "name", "start_line", "end_line", "content").join(F.broadcast(hits), "id")


def diversify(ranked: DataFrame, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` hits per path, in rank order."""
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def drop_covered_summaries(hits: DataFrame) -> DataFrame:
    """Without the chunk summaries that share path and start line with a hit of another kind."""
    covered = F.max((~F.col("kind").endswith("_summary")).cast("int")).over(Window.partitionBy("path", "start_line"))
    return hits.withColumn("_c", covered).where("not (kind = 'chunk_summary' and _c = 1)").drop("_c")


def rerank(hits: DataFrame, score: Column | Callable[[DataFrame], DataFrame], k: int, most: int = 100) -> DataFrame:
    """The ``k`` best of a pool of at most ``most`` hits by another score: an expression, or a function adding 'rerank'."""
    pool = hits.limit(most)
    scored = score(pool) if callable(score) and not isinstance(score, Column) else pool.withColumn("rerank", score)
    return scored.orderBy(F.desc("rerank"), "id").limit(k)


def format_hits(hits: DataFrame, order: list[Column]) -> DataFrame:
    """One row ``context``: the hits as numbered blocks in rank order.  For a top-k list only."""
    numbered = hits.withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    block = F.format_string("--- chunk %d: %s:%d-%d (%s, %.6f) ---\n%s\n", "_n", "path", F.coalesce("start_line", F.lit(0)), F.coalesce("end_line", F.lit(0)), "kind", "rrf", F.coalesce("content", F.lit("")))
    return numbered.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", block.alias("b")))), lambda x: x["b"]), "\n").alias("context"))
