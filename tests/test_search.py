import math
import random
import re

from pyspark.sql import functions as F

from fathomline.functions.text import embed_text, halve_oversized, line_count, line_range, line_windows, parse_query
from fathomline.operators import search

WORDS = "amber basin cedar delta ember fjord grove haven inlet jetty".split()


def _chunks(spark, n=40):
    rows = []
    for i in range(n):
        text = " ".join(WORDS[(i * k) % 10] for k in range(1, 6 + i % 4)) + ("\nparse_token value aa aa aa" if i % 5 == 0 else "")
        vec = [math.cos(i * (j + 1)) for j in range(64)]
        rows.append((i, f"src/f{i % 7}.go", "window" if i % 3 == 0 else "function_declaration", f"n{i}", i, i + 3, text, vec))
    rows += [(100, "x", None, None, None, None, None, None), (101, "x", "window", "", 0, 0, "", [0.0] * 64), (102, "y", "window", "", 1, 1, "q", [1.0] * 3), (103, "y", "k", "", 1, 1, "q", [float("nan")] + [1.0] * 63)]
    return spark.createDataFrame(rows, "id bigint, path string, kind string, name string, start_line int, end_line int, content string, vec array<double>"), rows


def test_query_parser():
    assert parse_query("a bc").terms == [["bc"]] and parse_query("a bc").conjunctive
    assert parse_query('one "two three" four') == ([["one"], ["two", "three"], ["four"]], False)
    assert parse_query("validate_token").terms == [["validate", "token"]]
    assert parse_query("x y", "or").conjunctive is False and parse_query("one two three", "and").conjunctive
    assert parse_query('"open ended phrase').terms == [["open", "ended", "phrase"]]
    assert parse_query("").terms == [] and parse_query("!!! -- ").terms == []
    assert parse_query("same same").terms == [["same"]]


def test_knn_equals_brute_force(spark):
    df, rows = _chunks(spark)
    q = rows[3][7]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = sorted(((round(cos(r[7], q), 6), -r[0]) for r in rows if r[7] and len(r[7]) == 64 and any(r[7]) and not math.isnan(r[7][0])), reverse=True)[:6]
    got = search.knn(df, spark.createDataFrame([(q,)], "qvec array<double>"), 6).collect()
    assert [(r.score, -r.id) for r in got] == want
    assert search.knn(df, spark.createDataFrame([([0.0] * 64,)], "qvec array<double>"), 6).count() == 0
    assert search.knn(df.limit(0), spark.createDataFrame([(q,)], "qvec array<double>"), 6).count() == 0


def _bm25(rows, terms, every):
    docs = {r[0]: (re.findall(r"[^\W_]+", "\n".join(x for x in (r[6], r[1], r[2]) if x is not None).lower()), r[2]) for r in rows}
    count = lambda toks, t: sum(toks[i : i + len(t)] == t for i in range(len(toks) - len(t) + 1))
    n, avg = len(docs), sum(len(t) for t, _ in docs.values()) / len(docs)
    df = [sum(count(toks, t) > 0 for toks, _ in docs.values()) for t in terms]
    out = []
    for i, (toks, kind) in docs.items():
        tfs = [count(toks, t) for t in terms]
        if all(tfs) if every else any(tfs):
            s = sum(max(1e-6, math.log((n - d + 0.5) / (d + 0.5))) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(toks) / avg)) for f, d in zip(tfs, df))
            out.append((round(s * (0.7 if kind == "window" else 1), 6), -i))
    return sorted(out, reverse=True)


def test_bm25_equals_brute_force(spark):
    df, rows = _chunks(spark)
    for text, mode in (("amber delta", "auto"), ("amber delta grove", "auto"), ("amber delta", "or"), ("parse_token", "auto"), ('"token value" amber', "and"), ('"aa aa"', "auto")):
        q = parse_query(text, mode)
        got = search.bm25(df, q, 100).collect()
        assert [(r.score, -r.id) for r in got] == _bm25(rows, q.terms, q.conjunctive), text
    assert search.bm25(df, parse_query(""), 5).count() == 0


def test_fusion_adds_reciprocal_ranks(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.8), (3, 0.7)], "id bigint, score double")
    b = spark.createDataFrame([(3, 5.0), (4, 4.0)], "id bigint, score double")
    got = [(r.id, r.rrf) for r in search.fuse(a, b, 10).collect()]
    assert got == [(3, round(1 / 63 + 1 / 61, 6)), (1, round(1 / 61, 6)), (2, round(1 / 62, 6)), (4, round(1 / 62, 6))]


def test_steps_after_ranking(spark):
    hits = spark.createDataFrame([(1, "a", "f", 1, 0.9), (2, "a", "chunk_summary", 1, 0.8), (3, "a", "f", 9, 0.7), (4, "b", "chunk_summary", 1, 0.6)], "id bigint, path string, kind string, start_line int, rrf double")
    assert {r.id for r in search.drop_covered_summaries(hits).collect()} == {1, 3, 4}
    assert {r.id for r in search.diversify(hits, [F.desc("rrf")], 1).collect()} == {1, 4}
    assert [r.id for r in search.rerank(hits, -F.col("rrf"), 2).collect()] == [4, 3]


def test_lines(spark):
    texts = ["", "a", "a\n", "a\nb", "\n\n", "\n".join(map(str, range(95))), "\n".join(map(str, range(40))) + "\n", "\n".join(map(str, range(41)))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", line_count(F.col("t")).alias("n"), line_windows(F.col("t")).alias("w")).collect()
    for r in got:
        lines = texts[r.i].split("\n")
        if lines[-1] == "":
            lines.pop()
        assert r.n == len(lines)
        want = []
        for s in range(0, max(len(lines), 1), 30):
            part = lines[s : s + 40]
            if "".join(part).strip():
                want.append((s + 1, s + len(part), "\n".join(part)))
            if s + 40 >= len(lines):
                break
        assert [(w.start_line, w.end_line, w.content) for w in r.w] == want, r.i
    cut = df.where("i = 5").select(line_range(F.col("t"), 3, 30, 5, 100).alias("r"), line_range(F.col("t"), 3, 30, 50, 5).alias("b"), line_range(F.col("t"), 3, 4, 50, 500).alias("w")).first()
    assert tuple(cut.r) == ("2\n3\n4\n5\n6", True) and tuple(cut.b) == ("2\n3\n4", True) and tuple(cut.w) == ("2\n3", False)


def test_embed_text(spark):
    row = spark.createDataFrame([("p", "window", "n", "c"), ("p", "f", None, "c")], "p string, k string, n string, c string").select(embed_text(*map(F.col, "pknc")).alias("t")).collect()
    assert [r.t for r in row] == ["// p\n// name: n\nc", "// p\n// kind: f\nc"]


def test_halving_covers_everything():
    text = "\n".join("x" * (i % 90) for i in range(300)) + "\n" + "é" * 9000
    parts = halve_oversized(text)
    assert all(len(p.encode()) <= 4097 for _, _, p in parts)
    assert "".join("".join(p for _, _, p in parts).split()) == "".join(text.split())


def test_stored_postings_equal_the_search_of_texts(spark, tmp_path):
    from fathomline.functions.text import parse_query
    from fathomline.operators import postings

    rnd = random.Random(5)
    rows = [(i, f"p/{i}.go", rnd.choice(["window", "function", None]), " ".join(rnd.choices(["na", "nana", "ledger", "merge", "x_y", "Ünï"], k=rnd.randint(0, 40)))) for i in range(200)]
    rows += [(500, None, None, None), (501, "a", "b", ""), (None, "a", "b", "ledger")]
    chunks = spark.createDataFrame(rows, "id bigint, path string, kind string, content string")
    postings.write_postings(chunks, str(tmp_path / "terms"))
    index = postings.read_postings(spark, str(tmp_path / "terms"))
    for question in ("ledger", "ledger merge", "ledger merge x_y nope", '"na na"', '"na nana na"', '"merge ledger" go', "ünï", "absent", "", '"na na na na"'):
        want = [tuple(r) for r in search.bm25(chunks.where("id is not null"), parse_query(question), 20).collect()]
        assert [tuple(r) for r in postings.bm25_stored(index, parse_query(question), 20).collect()] == want, question
    plan = postings.bm25_stored(index, parse_query("ledger merge"), 5)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "bucket" in plan.split("PartitionFilters")[1] and "In(term" in plan
    postings.write_postings(chunks.limit(0), str(tmp_path / "none"))
    assert postings.bm25_stored(postings.read_postings(spark, str(tmp_path / "none")), parse_query("ledger"), 5).count() == 0


def test_cosines_of_lexical_hits_and_orders_of_lists(spark):
    vec = lambda x: [float(x)] + [1.0] * 63
    chunks = spark.createDataFrame([(1, "a.go", vec(1)), (2, "b.md", vec(2)), (3, "c.go", None), (4, "d_test.go", [0.0] * 64), (5, "e.go", vec(5))], "id bigint, path string, vec array<float>")
    hits = chunks.select("id", "path", F.col("id").cast("double").alias("rrf"))
    got = {r.id: r.score for r in search.with_cosine(hits, chunks, spark.createDataFrame([(vec(1),)], "qvec array<float>")).collect()}
    assert got[1] == 1.0 and got[3] is None and got[4] is None and got[5] < got[2] < 1
    order = [F.desc("rrf"), F.col("id")]
    assert [r.id for r in search.demoted(hits, order).orderBy("place").collect()] == [5, 3, 1, 4, 2]
    assert [r.id for r in search.filled_up(hits.where("id = 2"), hits.where("id <> 2"), order, 3).orderBy("place").collect()] == [2, 5, 4]
    ranks = spark.createDataFrame([(1, 0.1, 5), (1, 0.2, 1), (5, 0.1, 9)], "id bigint, pagerank double, in_degree bigint")
    named = chunks.select("id", F.lit("f").alias("name"), "path", F.lit(1).alias("start_line"))
    assert [(r.id, r.pagerank) for r in search.definitions(named, ranks, 3).orderBy(F.desc("pagerank"), "path").collect()] == [(1, 0.2), (5, 0.1), (2, 0.0)]


def test_many_queries_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64)).astype(np.float32)
    x[50:60] = x[50]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist()), (900, None), (901, [0.0] * 64), (902, [1.0]), (None, x[1].tolist())]
    chunks = spark.createDataFrame(rows, "id bigint, vec array<float>")
    queries = chunks.where("id % 10 = 0 or id is null").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = np.round(unit @ unit.T, 6)
    want = {(q, int(j), p + 1) for q in range(0, 300, 10) for p, j in enumerate(sorted((j for j in range(300) if j != q), key=lambda j: (-s[q, j], j))[:4])}
    for block in (2048, 5):
        assert {(r.query_id, r.id, r.place) for r in search.knn_many(chunks, queries, 4, block=block).collect()} == want
    assert search.knn_many(chunks.limit(0), queries, 4).count() == 0 and search.knn_many(chunks, queries.limit(0), 4).count() == 0
