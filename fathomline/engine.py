"""One object for a project's index: build, search, ask, graph queries and upkeep.

Models are functions the caller passes in: ``embed(texts) -> vectors``, ``rerank(query, texts) -> scores`` and
``summarise(text) -> text``.  Tables live in a versioned store; everything between is a plan.
"""

from __future__ import annotations

import concurrent.futures
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fathomline.functions import chunking, enrich, extract, paths
from fathomline.functions.rerank import CircuitBreaker, RerankCache, Unreachable
from fathomline.functions.text import embed_text, parse_query
from fathomline.operators import graph, guide, ingest, postings, rollup, router, search
from fathomline.session import materialise, ship_package
from fathomline.sources import tree
from fathomline.sources.store import VersionedStore
from fathomline.streaming import watch as watching

Embed = Callable[[Sequence[str]], Sequence[Sequence[float]]]
EMBED_BATCH = 32
_FEW_PATHS = 10_000  # files that are read by their names; more are read with the tree
_IMPORT_BYTES = 1536
_QUEUE = "id bigint, path string, kind string, content_sha1 string, start_line int, end_line int, chunk_kind string, chunk_name string, source_sha1 string, queued_at bigint, attempts int, last_error string"


def embed_chunks(chunks: DataFrame, embed: Embed, batch: int = EMBED_BATCH) -> DataFrame:
    """``chunks`` with ``vec``: ``embed`` is called with the texts to embed in batches, in order, on the executors."""
    parent = F.col("parent") if "parent" in chunks.columns else None
    plain = chunks.drop("parent")
    texts = chunks.withColumn("_text", embed_text(*[F.col(c) for c in ("path", "kind", "name", "content")], parent)).select(*plain.columns, "_text")
    schema = T.StructType([*plain.schema.fields, T.StructField("vec", T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, vectors = b.column(b.num_columns - 1).to_pylist(), []
            for i in range(0, len(words), batch):
                got = list(embed(words[i : i + batch]))
                if len(got) != len(words[i : i + batch]):
                    raise ValueError("the embedding service returned another number of vectors")
                vectors += got
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], names=[*b.schema.names[:-1], "vec"])

    return texts.mapInArrow(run, schema)


class Engine:
    def __init__(self, spark: SparkSession, root: str, embed: Embed | None = None, rerank: Callable[[str, list[str]], list[float]] | None = None, max_per_path: int | None = None, lexical: bool = True, rerank_pool: int = 40, rerank_seconds: float = 1.5) -> None:
        ship_package(spark)
        self.spark, self.store = spark, VersionedStore(spark, root)
        self.embed, self.rerank, self.max_per_path, self.lexical = embed, rerank, max_per_path, lexical
        self.rerank_pool, self.rerank_seconds = min(rerank_pool, 100), rerank_seconds
        self._cache, self._breaker = RerankCache(), CircuitBreaker()

    # building

    def index(self, tree_root: str, rules: Sequence[str] = (), now: int | None = None, full: bool = False) -> None:
        """Bring chunks, terms and graph up to date with a tree: new chunks are embedded, known ones touched, vanished ones pruned.

        The rules of the project's own ignore files apply before ``rules``.  Files that are indexed and were not modified
        since the last run are not opened: their chunks are touched and their graph records kept.  ``full``, another root or
        other rules read everything.
        """
        now = now or time.time_ns()
        every_rule = [*tree.project_rules(self.spark, tree_root), *rules]
        state = {"root": tree_root, "rules": "\n".join(every_rule)}
        before = self.store.properties()
        again = not full and self.store.exists("chunks") and self.store.exists("records") and all(before.get(k) == v for k, v in state.items())
        files, unchanged = self._changed_files(tree_root, every_rule, int(before["last_indexed_at"])) if again else (materialise(tree.read_tree(self.spark, tree_root, every_rule), "files"), None)
        made = chunking.chunk_files(files).withColumn("content_sha1", F.sha1("content")).withColumn("last_seen_at", F.lit(now))
        made = made.withColumn("id", F.xxhash64("path", "kind", "content_sha1", "start_line")).dropDuplicates(["path", "kind", "content_sha1"])
        made = materialise(made.select("id", "path", "kind", "name", "parent", "start_line", "end_line", "content_sha1", "content", "last_seen_at"), "chunks")
        key = ["path", "kind", "content_sha1"]
        if self.store.exists("chunks"):
            current = self.store.read("chunks")
            new = made.join(current.select(*key), key, "left_anti").select(*made.columns)
            kept = ingest.touch(current, made, key, F.lit(now))
            if unchanged is not None:
                kept = ingest.touch_paths(kept, unchanged, F.lit(now))
            # chunks of this run carry its stamp, so what is older has vanished
            self.store.write("chunks", ingest.prune(kept.unionByName(self._embedded(new)), now))
        else:
            self.store.write("chunks", self._embedded(made))
        terms = postings.build_postings(self.chunks())
        self.store.write("postings", terms.postings, partition_by=["bucket"])
        self.store.write("lengths", terms.lengths)
        fresh = extract.extract_records(files)
        if unchanged is not None:
            fresh = fresh.unionByName(self.store.read("records").join(unchanged, "path", "left_semi"))
        self.store.write("records", fresh)
        records = self.store.read("records")
        nodes, edges = extract.build_graph(records, tree_root.rstrip("/").rsplit("/", 1)[-1])
        nodes, edges = materialise(nodes, "nodes"), materialise(edges, "edges")
        linked = nodes.join(graph.tightest_chunk(nodes, self.chunks()).withColumnRenamed("node_id", "id"), "id", "left")
        self.store.write("graph_nodes", linked.join(graph.centrality(nodes, edges), "id", "left"))
        self.store.write("graph_edges", edges)
        self.store.set_properties(last_indexed_at=str(now), **state)

    def _changed_files(self, tree_root: str, rules: Sequence[str], since: int) -> tuple[DataFrame, DataFrame]:
        """The files to read, and the paths of those that are as they were at ``since``."""
        moment = F.timestamp_micros(F.lit(since // 1000))
        listing = materialise(tree.list_tree(self.spark, tree_root, rules), "listing")
        unchanged = materialise(tree.unchanged_files(listing, self.chunks(), moment).select("path"), "unchanged")
        # files with an old stamp that are not indexed: moved here, or without content until now
        moved = listing.where(F.col("modified") <= moment).join(unchanged, "path", "left_anti")
        files = tree.read_tree(self.spark, tree_root, rules, since=moment)
        few = [r.path for r in moved.select("path").limit(_FEW_PATHS + 1).collect()]
        if len(few) > _FEW_PATHS:
            files = tree.read_tree(self.spark, tree_root, rules).join(unchanged, "path", "left_anti")
        elif few:
            files = files.unionByName(tree.read_tree(self.spark, tree_root, rules, only=few))
        return materialise(files, "files"), unchanged

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        return embed_chunks(chunks, self.embed) if self.embed else chunks.drop("parent").withColumn("vec", F.lit(None).cast("array<float>"))

    def terms(self) -> postings.PostingIndex:
        return postings.PostingIndex(self.store.read("postings"), self.store.read("lengths"))

    def chunks(self) -> DataFrame:
        return self.store.read("chunks")

    def nodes(self) -> DataFrame:
        return self.store.read("graph_nodes")

    def edges(self) -> DataFrame:
        return self.store.read("graph_edges")

    # searching

    def search(self, question: str, k: int = 8, exclude: str = "", summaries_only: bool = False) -> DataFrame:
        """Hybrid hits with their chunks; clamps ``k`` to 30.  Filters apply after the ranking, so fewer may come back."""
        k = max(1, min(k or 8, 30))
        chunks, parsed = self.chunks(), parse_query(question)
        want = max(20 * k, 50) if summaries_only else k
        pool = max(want, min(self.rerank_pool, 5 * want)) if self.rerank else want
        if self.embed:
            vector = self.spark.createDataFrame([(list(map(float, self.embed([question])[0])),)], "qvec array<float>")
            ranked = search.hybrid(chunks, vector, parsed, pool, self.lexical, lambda query, n: postings.bm25_stored(self.terms(), query, n))
            ranked = search.with_cosine(materialise(ranked, "ranked"), chunks, vector)
        else:
            ranked = postings.bm25_stored(self.terms(), parsed, pool).select("id", F.col("score").alias("rrf"), F.lit(None).cast("double").alias("score"))
        hits = search.attach(ranked, chunks)
        hits = self._reranked(question, hits, want) if self.rerank else hits
        order = [F.desc("rrf"), F.col("id")]
        hits = search.drop_covered_summaries(hits)
        if self.max_per_path:
            hits = search.diversify(hits, order, self.max_per_path)
        if summaries_only:
            hits = hits.where(F.col("kind").isin("file_summary", "package_summary", "repo_summary"))
        if exclude:
            hits = hits.where(~F.col("path").startswith(exclude))
        return hits.orderBy(*order).limit(k)

    def _reranked(self, question: str, hits: DataFrame, k: int) -> DataFrame:
        rows = hits.select("id", "content").collect()  # at most the rerank pool
        scores = self._cache.get(question, [r.id for r in rows])
        if scores is None:
            try:
                scores = dict(zip([r.id for r in rows], self._breaker.call(lambda: within(self.rerank_seconds, self.rerank, question, [r.content for r in rows]))))
            except (Unreachable, TimeoutError):
                return hits.orderBy(F.desc("rrf"), "id").limit(k)
            self._cache.put(question, scores)
        given = self.spark.createDataFrame([(int(i), float(s)) for i, s in scores.items()], "id bigint, rerank double")
        return hits.join(F.broadcast(given), "id").orderBy(F.desc("rerank"), "id").limit(k)

    def find_symbol(self, name: str, k: int = 10) -> DataFrame:
        """Definitions of a name by rank in the graph, else nodes of that name, with roles."""
        nodes = self.nodes()
        rows = nodes.where((F.col("name") == name) & (F.col("file_path") != "") & (F.col("start_line") > 0))
        tag = graph.role(F.col("name"), F.col("in_degree"), F.col("out_degree"), F.col("cross_pkg_callers"))
        return rows.select("id", "kind", "name", "qualified_name", "file_path", "start_line", "end_line", "chunk_id", "pagerank", "in_degree", tag.alias("role")).orderBy(F.desc("pagerank"), F.desc("in_degree"), "file_path", "start_line").limit(k)

    def did_you_mean(self, name: str, k: int = 5) -> list[str]:
        low = name.lower()
        rows = self.nodes().where(F.lower("name").contains(low) & (F.lower("name") != low)).select("name").distinct()
        return [r.name for r in rows.orderBy(F.length("name"), "name").limit(k).collect()]

    def callers(self, name: str, package: str = "", k: int = 12) -> DataFrame:
        return self._calls(name, package, k, True)

    def callees(self, name: str, package: str = "", k: int = 12) -> DataFrame:
        return self._calls(name, package, k, False)

    def _calls(self, name: str, package: str, k: int, incoming: bool) -> DataFrame:
        nodes = self.nodes()
        return graph.call_sites(self.edges(), nodes, nodes, incoming, max(1, min(k, 50)), graph.resolve_targets(nodes, name, package))

    def related(self, chunk_id: int, k: int = 8) -> DataFrame:
        """The nearest chunks of a chunk; clamps ``k`` to 30."""
        k, chunks = max(1, min(k or 8, 30)), self.chunks()
        own = chunks.where(F.col("id") == chunk_id).select(F.col("vec").alias("qvec"))
        return search.knn(chunks, own, k + 1).where(F.col("id") != chunk_id).limit(k)

    def package_dependencies(self, package: str) -> DataFrame:
        return graph.package_dependencies(self.edges(), self.nodes()).where(F.col("package_path") == package).orderBy("dst_id")

    # asking

    def ask(self, question: str, intent: str = "auto", k: int = 8, most_bytes: int | None = None) -> dict:
        """A bounded bundle: intent, symbols, hits, reads and neighbourhood.  Each part is a list of at most ``k`` dictionaries.

        Reads, bodies of symbols and hits carry their source within one budget of bytes, in that order.
        """
        k = max(1, min(k or 8, 30))
        one = self.spark.createDataFrame([(question, intent)], "q string, i string")
        row = one.select(router.intent(F.col("q"), F.col("i")).alias("intent"), router.identifiers(F.col("q")).alias("ids")).first()
        symbols = [s.asDict() for i in row.ids for s in self.find_symbol(i.rsplit(".", 1)[-1], k).collect()][:k]
        hits = materialise(self.search(question, k), "hits")
        if self.embed:
            hits = router.without_low_signal(hits, "score")
        deep = row.intent in ("architecture", "package_topology")
        found = self.spark.createDataFrame([(s["file_path"],) for s in symbols], "path string") if symbols else None
        ranks = graph.chunk_ranks(self.chunks().join(F.broadcast(hits.select("id")), "id", "left_semi"), self.nodes())
        ranked = hits.join(ranks.select("id", F.col("pagerank").alias("_pr")), "id", "left")
        by_path = ranked.groupBy("path").agg(F.max("_pr").alias("pagerank"))
        reads = [r.asDict() for r in router.suggested_reads(hits, "rrf", 5 if deep else 2, row.intent != "architecture", found, by_path).collect()]
        bundle: dict = {"status": "ok", "intent": row.intent, "symbols": symbols, "hits": [h.asDict() | {"content": ""} for h in hits.drop("vec").orderBy(F.desc("rrf"), "id").collect()], "suggested_reads": reads}
        self._inline(bundle, hits, most_bytes)
        self._annotate(bundle)
        if row.intent in ("callers", "callees") and row.ids:
            bundle["calls"] = [r.asDict() for r in self._calls(row.ids[0], "", k, row.intent == "callers").collect()]
            names = sorted({i.rsplit(".", 1)[-1] for i in row.ids})
            uses = router.word_references(self.chunks().where(~F.col("kind").endswith("_summary")), names)
            for s in symbols:  # at most k places of definition
                uses = uses.where(~((F.col("path") == s["file_path"]) & (F.col("line_no") == s["start_line"])))
            bundle["references"] = [r.asDict() for r in router.capped_references(uses).collect()]
        if row.intent == "symbol_lookup" and symbols:
            these = self.nodes().where(F.col("id").isin([s["id"] for s in symbols]))
            bundle["graph"] = [r.asDict() for r in graph.neighbourhood(self.edges(), self.nodes(), these).collect()]
        if deep:
            bundle["packages"] = sorted(r.package_path for r in graph.packages_of_paths(hits, self.nodes()).limit(30).collect())
        if not symbols and row.ids:
            bundle["did_you_mean"] = self.did_you_mean(row.ids[0])
        bundle["next_action"], bundle["avoid"] = router_next(row.intent, bundle), router_avoid(row.intent, bundle)
        return bundle

    def _inline(self, bundle: dict, hits: DataFrame, most_bytes: int | None) -> None:
        """Fill in the source of reads, symbols and hits; the lanes together are a few dozen rows."""
        limits = router.inline_limits(bundle["intent"])
        rows = [(0, i, r["path"], r["start_line"]) for i, r in enumerate(bundle["suggested_reads"])]
        spots = self.spark.createDataFrame(rows, "lane int, place int, path string, start_line int") if rows else None
        others = hits.where(F.lit(bundle["intent"] == "editing_context") | ~paths.is_test(F.col("path")))
        place = {h["id"]: i for i, h in enumerate(bundle["hits"])}
        order = self.spark.createDataFrame(list(place.items()), "id bigint, place int") if place else None
        items = others.limit(0).select(F.lit(0).alias("lane"), F.lit(0).alias("place"), "id", "content", F.lit(False).alias("is_whole"))
        if spots is not None:
            items = items.unionByName(hits.join(F.broadcast(spots), ["path", "start_line"]).select("lane", "place", "id", "content", F.lit(False).alias("is_whole")))
        if bundle["intent"] == "symbol_lookup" and bundle["symbols"]:
            wanted = self.spark.createDataFrame([(i, s["id"]) for i, s in enumerate(bundle["symbols"])], "place int, node string")
            bodies = self.nodes().select(F.col("id").alias("node"), "chunk_id").join(F.broadcast(wanted), "node").select("place", F.col("chunk_id").alias("id"))
            items = items.unionByName(self.chunks().join(F.broadcast(bodies), "id").select(F.lit(1).alias("lane"), "place", "id", "content", F.lit(False).alias("is_whole")))
        if order is not None:
            items = items.unionByName(others.join(F.broadcast(order), "id").select(F.lit(2).alias("lane"), "place", "id", "content", F.col("kind").endswith("_summary").alias("is_whole")))
        filled = {(r.lane, r.id): r for r in router.inline_content(items, most_bytes or limits.budget, limits.most_lines, limits.most_bytes).collect()}
        by_spot = {(h["path"], h["start_line"]): h["id"] for h in bundle["hits"]}
        for r in bundle["suggested_reads"]:
            got = filled.get((0, by_spot.get((r["path"], r["start_line"]))))
            r.update(content=got.content if got else "", truncated=bool(got and got.truncated))
        for s in bundle["symbols"]:
            got = filled.get((1, s.get("chunk_id")))
            s["body"] = got.content if got else ""
        for h in bundle["hits"]:
            got = filled.get((2, h["id"]))
            h["content"] = got.content if got else ""

    def _annotate(self, bundle: dict) -> None:
        """Per path of a read or symbol: nearest document, tests, imports, build conditions; per symbol its signature."""
        wanted = sorted({r["path"] for r in bundle["suggested_reads"]} | {s["file_path"] for s in bundle["symbols"]})
        if not wanted:
            return
        files = self.chunks().select("path").where("path is not null").distinct()
        notes: dict[str, dict] = {p: {} for p in wanted}
        mine = files.where(F.col("path").isin(wanted))
        for r in router.nearest_document(mine, router.describing_documents(files)).collect():
            notes[r.path]["nearest_doc"] = r.doc
        for r in router.test_pairs(files).where(F.col("path").isin(wanted)).collect():
            notes[r.path].setdefault("tests", []).append(r.test)
        heads = rollup.newest_per(self.chunks().where(F.col("path").isin(wanted) & ~F.col("kind").endswith("_summary")).select("path", "start_line", "end_line", "content", "id", enrich.build_tags(F.col("content")).alias("tags")), ["path"], [F.col("start_line"), F.desc("end_line"), F.col("id")])
        for r in heads.collect():
            block = chunking.import_block(r.path, r.content or "").encode()
            notes[r.path] |= {"build_tags": r.tags} if r.tags else {}
            notes[r.path] |= {"imports": block[:_IMPORT_BYTES].decode("utf-8", "ignore") + ("\n// imports cut" if len(block) > _IMPORT_BYTES else "")} if block else {}
        for s in bundle["symbols"]:
            made = enrich.signature_of(s["body"], 1, s["name"]) if s.get("body") else None
            if made:
                s |= {"signature": made.text, "doc": made.doc}
        bundle["annotations"] = {p: n for p, n in notes.items() if n}

    def generate(self, prompt: str, chat: Callable[[str, str], str], k: int = 8, system: str = "Answer from the context of this project.") -> str:
        """What ``chat(system, prompt)`` says with the hits of the prompt as context; ``k`` of 0 sends none."""
        if not prompt.strip():
            raise ValueError("the prompt is empty")
        if k <= 0:
            return chat(system, prompt)
        context = search.format_hits(self.search(prompt, k), [F.desc("rrf"), F.col("id")]).first().context
        return chat(system, f"{context}\n\n{prompt}")

    # watching

    def watch(self, events: DataFrame, tree_root: str, checkpoint: str, gap: str = "500 milliseconds", watermark: str = "10 seconds", initial: bool = True, idle: watching.IdleHook | None = None) -> StreamingQuery:
        """Refresh the index whenever a stream of changes (path, event_type, ts) falls quiet.

        ``initial`` indexes the tree first.  Each micro-batch of quiet runs is one refresh, after which ``idle`` (a drain of
        the summary queue, say) becomes due; new events put it off.  The caller polls the hook and stops the query.
        """
        if initial:
            self.index(tree_root)

        def refresh(batch: DataFrame, number: int) -> None:
            if idle:
                idle.event()
            self.index(tree_root)

        runs = watching.debounce(watching.relevant_events(events).withColumn("project", F.lit(tree_root)), "project", gap=gap, watermark=watermark)
        return watching.on_flush(runs, refresh, checkpoint, idle.flushed if idle else None)

    def drain_all(self, summarise: Callable[[str], str], batch: int = 10, rounds: int | None = None, sleep: Callable[[float], None] = time.sleep) -> int:
        """Drain the summary queue with pauses that grow while nothing succeeds; gives the number of summaries."""
        return watching.drain(lambda n: self.drain_summaries(summarise, n), batch, rounds, sleep)

    # summaries

    def queue(self) -> DataFrame:
        return self.store.read("pending_summaries") if self.store.exists("pending_summaries") else self.spark.createDataFrame([], _QUEUE)

    def enqueue_summaries(self, now: int | None = None) -> int:
        """Queue a summary for every structural chunk that has none and is not queued; gives the number of new jobs."""
        chunks = self.chunks()
        have = chunks.where("kind = 'chunk_summary'").select("path", F.col("content_sha1"))
        sources = chunks.select("id", "start_line", "end_line", F.col("kind").alias("chunk_kind"), F.col("name").alias("chunk_name"), F.col("content_sha1").alias("source_sha1"))
        jobs = ingest.jobs_to_enqueue(chunks, self.queue()).join(sources, "id")
        jobs = materialise(jobs.select("id", "path", "kind", "content_sha1", "start_line", "end_line", "chunk_kind", "chunk_name", "source_sha1", F.lit(now or time.time_ns()).alias("queued_at"), F.lit(0).alias("attempts"), F.lit("").alias("last_error")).join(have, ["path", "content_sha1"], "left_anti"), "jobs")
        self.store.write("pending_summaries", self.queue().unionByName(jobs.select(*self.queue().columns)))
        return jobs.count()

    def drain_summaries(self, summarise: Callable[[str], str], batch: int = 10, now: int | None = None) -> int:
        """Write the summaries of the jobs that wait longest; gives their number, or -1 where none is queued.

        A job whose source is gone or changed is dropped; one that fails stays with one more attempt and its error.
        """
        jobs = ingest.take_jobs(self.queue(), batch).join(self.chunks().select("path", F.col("content_sha1").alias("source_sha1"), "content").dropDuplicates(["path", "source_sha1"]), ["path", "source_sha1"], "left").collect()  # at most one batch
        if not jobs:
            return -1
        made, failed = [], []
        for j in jobs:
            if j.content is None:
                continue
            try:
                made.append((j.id, j.path, "chunk_summary", j.chunk_name, j.start_line, j.end_line, j.content_sha1, summarise(j.content), now or time.time_ns()))
            except Exception as error:  # noqa: BLE001 - whatever the model's client raises belongs to this job
                failed.append((j.id, str(error)))
        if made:
            rows = self.spark.createDataFrame(made, "id bigint, path string, kind string, name string, start_line int, end_line int, content_sha1 string, content string, last_seen_at bigint")
            rows = rows.withColumn("id", F.xxhash64("path", "kind", "content_sha1", "start_line"))
            self.store.change("chunks", lambda c: ingest.upsert(c, self._embedded(rows).select(*c.columns), ["path", "kind", "content_sha1"]))
        kept = {i for i, _ in failed}
        errors = self.spark.createDataFrame(failed, "id bigint, error string")
        gone = self.spark.createDataFrame([(j.id,) for j in jobs if j.id not in kept], "id bigint")
        self.store.change("pending_summaries", lambda q: ingest.remove_jobs(ingest.bump_attempts(q, errors), gone))
        return len(made)

    # upkeep

    def guide(self, module: str = "") -> str:
        """The guide, or the part of one directory; what it was made of is remembered for ``guide_is_stale``."""
        text = guide.render(self.chunks(), self.nodes(), self.edges(), only=module)
        if module:
            return text
        self.store.set_properties(guide_seen=str(self._newest_summary()))
        return text

    def guide_is_stale(self) -> bool:
        """Whether a summary is newer than those of the last guide, or there was none."""
        return self._newest_summary() > int(self.store.properties().get("guide_seen", -1))

    def _newest_summary(self) -> int:
        seen = self.chunks().where(F.col("kind").isin("package_summary", "repo_summary")).agg(F.max("last_seen_at")).first()[0]
        return seen or 0

    def export(self, path: str) -> None:
        tree.export_jsonl(self.nodes(), f"{path}/nodes.jsonl")
        tree.export_jsonl(self.edges(), f"{path}/edges.jsonl")

    def status(self) -> dict:
        stats = self.chunks().agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("path").alias("files")).first().asDict()
        seen = int(self.store.properties().get("last_indexed_at", 0))
        return stats | {"last_indexed_at": seen, "stale": time.time_ns() - seen > 86_400 * 10**9}

    def clone(self, root: str) -> "Engine":
        self.store.clone(root)
        return Engine(self.spark, root, self.embed, self.rerank, self.max_per_path, self.lexical, self.rerank_pool, self.rerank_seconds)

    def drop(self) -> None:
        self.store.drop()


def within(seconds: float, fn: Callable, *args: object) -> object:
    """The result of a call, or TimeoutError where it takes longer; the call itself is not stopped."""
    pool = concurrent.futures.ThreadPoolExecutor(1)
    try:
        return pool.submit(fn, *args).result(seconds)
    except concurrent.futures.TimeoutError as late:
        raise TimeoutError(f"no answer within {seconds} s") from late
    finally:
        pool.shutdown(wait=False)


def router_avoid(intent: str, bundle: dict) -> str:
    """One sentence on what needs no further search."""
    if intent in ("callers", "callees") and bundle.get("calls"):
        return "Do not search for the name as text: the calls are resolved."
    if bundle.get("suggested_reads") and all(r.get("content") and not r.get("truncated") for r in bundle["suggested_reads"]):
        return "Do not read the suggested files again: their lines are included."
    return ""


def router_next(intent: str, bundle: dict) -> str:
    """One sentence on what to read next."""
    reads = bundle.get("suggested_reads") or []
    if intent in ("symbol_lookup", "callers", "callees") and bundle["symbols"]:
        s = bundle["symbols"][0]
        return f"Read {s['file_path']} lines {s['start_line']}-{s['end_line']}, the definition of {s['qualified_name']}."
    if reads:
        return f"Read {reads[0]['path']} lines {reads[0]['start_line']}-{reads[0]['end_line']} first."
    return "Nothing matched; ask again with a name or a phrase from the code."


