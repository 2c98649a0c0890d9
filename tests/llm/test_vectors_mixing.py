import math

import numpy as np
import pytest

from fathomline.llm import mixing, vectors

ROW = "id bigint, vec array<float>, last_seen_at bigint, similarity string, g int, bucket int"


def _world(seed, groups, per, noise, extra=()):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 64))
    x = np.repeat(centres, per, axis=0) + noise * rng.normal(size=(groups * per, 64))
    x = (x * rng.uniform(0.5, 2, size=(len(x), 1))).astype(np.float32)
    rows = [(int(i) + 1, v.tolist(), 1, None, None, None) for i, v in enumerate(x)]
    return rows + [(r[0], r[1], r[2], None, None, None) for r in extra]


def _truth(rows, k=5, least=0.85):
    newest = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and len(r[1]) == 64 and all(v is not None and math.isfinite(v) for v in r[1]) and any(r[1]):
            if r[0] not in newest or r[2] > newest[r[0]][2]:
                newest[r[0]] = r
    ids = np.array(sorted(newest))
    x = np.array([newest[i][1] for i in ids], dtype=np.float32).astype(np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        for j in np.argsort(-s[i], kind="stable")[:k]:
            if s[i, j] >= least:
                out.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return out


def _found(spark, rows, **more):
    df = spark.createDataFrame(rows, ROW)
    return {tuple(r) for r in vectors.similar_pairs(vectors.nearest_vectors(df, **more)).collect()}


def test_recall_and_exact_similarities(spark):
    bad = [(9001, None, 1), (9002, [], 1), (9003, [1.0] * 3, 1), (9004, [0.0] * 64, 1), (9005, [float("nan")] + [1.0] * 63, 1), (9006, [float("inf")] + [1.0] * 63, 1), (None, [1.0] * 64, 1), (9007, [None] + [1.0] * 63, 1)]
    rows = _world(1, 60, 12, 0.35, bad)
    want, got = _truth(rows), _found(spark, rows)
    assert len(want & got) >= 0.9 * len(want)
    assert len(got & want) >= 0.95 * len(got)
    assert all(a < b < 9000 for a, b in got)


def test_a_third_of_all_rows_are_one_vector(spark):
    rows = _world(2, 20, 10, 0.3)
    same = [(1000 + i, rows[0][1], 1, None, None, None) for i in range(100)]
    newer = [(rows[5][0], rows[0][1], 9, None, None, None), (rows[6][0], rows[6][1], 1, None, None, None)]
    everything = rows + same + newer
    want, got = _truth(everything), _found(spark, everything)
    hot = {p for p in want if p[1] >= 1000}
    assert hot <= got, "copies are found whole, each with the smallest ids"
    assert len(want & got) >= 0.9 * len(want)


def test_large_buckets_are_divided(spark):
    rng = np.random.default_rng(5)
    near = rng.normal(size=64) + 0.02 * rng.normal(size=(900, 64))  # one tight cluster: every code is the same
    rows = [(i + 1, v.astype(np.float32).tolist(), 1, None, None, None) for i, v in enumerate(near)]
    got = _found(spark, rows, largest=200)
    df = spark.createDataFrame(rows, ROW)
    each = vectors.nearest_vectors(df, largest=200).groupBy("id").count().collect()
    assert len(each) == 900 and len(got) > 1500


def test_neighbours_in_a_cluster_of_a_third_of_the_rows(spark):
    rng = np.random.default_rng(11)
    tight = rng.normal(size=64) + 0.23 * rng.normal(size=(500, 64))  # cosines of about 0.95
    rows = _world(12, 1000, 1, 0.0) + [(2000 + i, v.astype(np.float32).tolist(), 1, None, None, None) for i, v in enumerate(tight)]
    want, got = _truth(rows), _found(spark, rows, largest=60)
    assert len(want & got) >= 0.9 * len(want)


@pytest.mark.parametrize("largest", [8192, 60])
def test_copies_of_different_lengths_have_the_smallest_ids(spark, largest):
    rng = np.random.default_rng(13)
    one = rng.normal(size=64)
    ids = rng.permutation(np.arange(2000, 2150)).tolist()
    rows = _world(14, 100, 1, 0.0) + [(i, (one * f).astype(np.float32).tolist(), 1, None, None, None) for i, f in zip(ids, rng.uniform(0.5, 2, 150))]
    near = vectors.nearest_vectors(spark.createDataFrame(rows, ROW), largest=largest).where("id >= 2000").collect()
    got = {i: [r.neighbour for r in sorted(near, key=lambda r: r["rank"]) if r.id == i] for i in ids}
    assert got == {i: [j for j in range(2000, 2006) if j != i][:5] for i in ids}


def test_shape_of_the_index():
    for n in (2, 1_000, 100_000, 10**8):
        bits, indexes = vectors.index_shape(n, 0.85)
        meet = 1 - (1 - (1 - math.acos(0.85) / math.pi) ** bits) ** indexes
        assert meet >= 0.8 and bits >= 3


def test_nothing_to_compare(spark):
    empty = spark.createDataFrame([], ROW)
    assert vectors.nearest_vectors(empty).count() == 0
    one = spark.createDataFrame([(1, [1.0] * 64, 1, None, None, None)], ROW)
    assert vectors.nearest_vectors(one).count() == 0
    two = spark.createDataFrame([(i, [1.0] * 64, None, None, None, None) for i in (1, 2)], ROW)
    assert {tuple(r) for r in vectors.similar_pairs(vectors.nearest_vectors(two)).collect()} == {(1, 2)}


DOC = "doc_id bigint, source string, tokens bigint"
TARGET = "source string, weight double, max_repeats int"


def _plan(spark, docs, targets):
    hist = mixing.token_histogram(spark.createDataFrame(docs, DOC))
    return {r["source"]: r for r in mixing.balance(hist, spark.createDataFrame(targets, TARGET))}


def test_balance_meets_the_targets(spark):
    rng = np.random.default_rng(0)
    docs = [(i, [" A", "a", "B ", "c", None][i % 5], int(t)) for i, t in enumerate(rng.integers(1, 500, 4000))]
    targets = [("a", 0.5, 3), ("B", 0.3, 2), ("c", 0.05, 1), ("none", 0.05, 9), ("C2", 0.0, 1)]
    plan = _plan(spark, docs, targets)
    total = sum(t for _, _, t in docs)
    assert {s for s, r in plan.items() if r["falls_short"]} == {"none"}
    for s in ("a", "b", "c"):
        own = [t for _, x, t in docs if x is not None and x.strip().lower() == s]
        r = plan[s]
        assert r["own_tokens"] == sum(own)
        got = sum(t * min(r["max_repeats"], math.exp(r["tilt"] * t / r["mean"])) for t in own)
        assert abs(got - r["weight"] * total) < 1e-6 * total
    used = mixing.copies(spark.createDataFrame(docs, DOC), "doc_id", list(plan.values())).collect()
    for s in ("a", "b", "c"):
        mine = [u for u in used if u.source == s]
        assert max(u.copies for u in mine) <= plan[s]["max_repeats"]
        assert abs(sum(u.copies * u.tokens for u in mine) / total - plan[s]["weight"]) < 0.03
    shares = {r.source: r.share for r in mixing.mixture_report(spark.createDataFrame(docs, DOC), "doc_id", list(plan.values())).collect()}
    assert abs(sum(shares.values()) - 1) < 1e-9 and shares["none"] == 0


def test_short_sources_are_used_to_the_cap(spark):
    docs = [(i, "small", 10) for i in range(10)] + [(100 + i, "big", 100) for i in range(100)]
    plan = _plan(spark, docs, [("small", 0.5, 4), ("big", 0.5, 1)])
    assert plan["small"]["falls_short"] and not plan["big"]["falls_short"]
    used = mixing.copies(spark.createDataFrame(docs, DOC), "doc_id", list(plan.values())).collect()
    assert {u.copies for u in used if u.source == "small"} == {4}
    exact = _plan(spark, [(1, "s", 10), (2, "t", 10)], [("s", 0.5, 1), ("t", 0.51, 1)])
    assert not exact["s"]["falls_short"] and exact["t"]["falls_short"]


def test_missing_tokens_are_spread_by_weight(spark):
    rng = np.random.default_rng(4)
    docs = [(i, "abcd"[i % 4], int(t)) for i, t in enumerate(rng.integers(1, 300, 2000))]
    targets = [("a", 0.2, 5), ("b", 0.4, 5), ("c", 0.3, 1), ("none", 0.1, 3)]
    hist = mixing.token_histogram(spark.createDataFrame(docs, DOC))
    plan = {r["source"]: r for r in mixing.balance(hist, spark.createDataFrame(targets, TARGET), spread=True)}
    total = sum(t for _, _, t in docs)
    assert {s for s, r in plan.items() if r["falls_short"]} == {"c", "none"} and all(r["converged"] and r["steps"] < 60 for r in plan.values())
    assert abs(sum(r["planned_tokens"] for r in plan.values()) - total) < 1e-6 * total
    assert abs(plan["b"]["planned_tokens"] / plan["a"]["planned_tokens"] - 2) < 1e-9 and plan["c"]["planned_tokens"] == plan["c"]["own_tokens"]
    # a source that cannot give its larger share is filled as well
    chain = [("a", 0.26, 1), ("b", 0.3, 1), ("c", 0.24, 4), ("none", 0.2, 1)]
    plan = {r["source"]: r for r in mixing.balance(hist, spark.createDataFrame(chain, TARGET), spread=True)}
    assert plan["a"]["planned_tokens"] == plan["a"]["own_tokens"] and plan["c"]["planned_tokens"] > 0.24 * total


def test_bounds_agree_with_the_definition(spark):
    rng = np.random.default_rng(8)
    docs = [(i, f"s{i % 7}", int(t)) for i, t in enumerate(rng.integers(0, 300, 900))]
    targets = [(f"S{i}", float(w), int(c)) for i, (w, c) in enumerate(zip(rng.dirichlet(np.ones(8)), rng.integers(0, 4, 8)))]
    found = {r["source"] for r in mixing.bounds(mixing.token_histogram(spark.createDataFrame(docs, DOC)), spark.createDataFrame(targets, TARGET)) if r["falls_short"]}
    own = {s: sum(t for _, x, t in docs if x == s) for s in {x for _, x, _ in docs}}
    assert found == {s.lower() for s, w, c in targets if c * own.get(s.lower(), 0) < w * sum(own.values())}


def test_p9_found_comes_from_the_balancing(spark, tmp_path, monkeypatch):
    from fathomline.llm.queries import registry

    docs = [(1, "a" + " a" * 9, " Equal"), (2, "a" + " a" * 9, "short"), (3, "a" + " a" * 29, "open"), (4, "a" + " a" * 13, "OPEN "), (5, None, "open")]
    targets = [("equal", 20 / 64, 2), ("short", 21 / 64, 2), ("absent", 1 / 64, 9), ("open", 22 / 64, 3)]
    spark.createDataFrame(docs, "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(targets, TARGET).write.parquet(f"{tmp_path}/mix_targets.parquet")
    steps, gradient, bounds = [], mixing._gradient, mixing.bounds

    def watched(histogram, plan):
        found = gradient(histogram, plan)
        steps.extend((r["source"], found.get(r["source"], (0.0, 0.0))[0]) for r in plan)
        return found

    monkeypatch.setattr(mixing, "_gradient", watched)
    # the sums alone decide nothing
    monkeypatch.setattr(mixing, "bounds", lambda *a: [{**r, "falls_short": None} for r in bounds(*a)])
    found = registry.queries["p9_found"](spark, str(tmp_path))
    assert found.columns == ["source"] and sorted(r.source for r in found.collect()) == ["absent", "short"]
    last = dict(steps)
    assert last["short"] == 20 and last["equal"] == 20 and last["absent"] == 0 and abs(last["open"] - 22) < 1e-6


def test_solutions_that_hang_on_very_short_documents(spark):
    wanted = [(9_002_000_000, False), (1_000, False), (9_003_000_000, False), (9_003_000_001, True), (1_500_000_000, False)]
    size, total = {1: 1_000_000, 10_000_000: 300}, 2**34  # a power of two, so that weight times total is exact
    hist = [(f"s{i}", t, n) for i in range(5) for t, n in size.items()] + [("rest", 1, total - 5 * 3_001_000_000)]
    targets = [(f"s{i}", t / total, 3) for i, (t, _) in enumerate(wanted)]
    plan = {r["source"]: r for r in mixing.balance(spark.createDataFrame(hist, "source string, tokens bigint, docs bigint"), spark.createDataFrame(targets, TARGET))}
    for i, (target, short) in enumerate(wanted):
        r = plan[f"s{i}"]
        assert r["target_tokens"] == target and r["falls_short"] == short and r["converged"] and 0 < r["steps"] < 30
        got = sum(n * t * min(3.0, math.exp(min(700.0, r["tilt"] * t / r["mean"]))) for t, n in size.items())
        assert abs(got - min(target, 9_003_000_000)) <= 1e-8 * target


def test_the_search_agrees_with_the_definition(spark):
    rng = np.random.default_rng(102)
    docs = [(i, f"s{rng.integers(12)}", int(t)) for i, t in enumerate(np.exp(rng.normal(3, 2.5, 600)))]
    own = {f"s{i}": sum(t for _, x, t in docs if x == f"s{i}") for i in range(14)}
    total = sum(own.values())
    # around the most that a source can give: a token less, the same, a token more, and far from it
    most = {s: int(rng.integers(0, 5)) for s in own}
    targets = [(s, max(0.0, float((most[s] * own[s] + [-1, 0, 1][i % 3]) if i % 2 else most[s] * own[s] * rng.uniform(0, 2)) / total), most[s]) for i, s in enumerate(own)]
    hist = mixing.token_histogram(spark.createDataFrame(docs, DOC))
    plan = {r["source"]: r for r in mixing.balance(hist, spark.createDataFrame(targets, TARGET))}
    assert {s for s, r in plan.items() if r["falls_short"]} == {s for s, w, c in targets if c * own[s] < w * total}
    assert all(r["converged"] for r in plan.values())
    for s, r in plan.items():
        got = sum(min(most[s], math.exp(min(700.0, r["tilt"] * t / r["mean"]))) * t for _, x, t in docs if x == s and t > 0)
        assert abs(got - min(r["target_tokens"], r["most_tokens"])) <= 1e-6 * max(1.0, r["target_tokens"])


def test_empty_mixtures(spark):
    assert _plan(spark, [], []) == {}
    plan = _plan(spark, [(1, None, 0), (2, "a", 0)], [("a", 0.5, 2), (None, 0.5, 1), ("b", None, None)])
    assert not plan["a"]["falls_short"] and not plan["b"]["falls_short"]


@pytest.mark.parametrize("name", ["p3_found", "p4_found", "p5_pieces", "p6_redacted", "p8_ids", "p9_report", "p10_found"])
def test_queries_run(spark, name):
    import os

    from fathomline.llm.queries import registry

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the test tables are not here")
    assert registry.queries[name](spark, "/root/testdata/sf0.001").count() > 0
