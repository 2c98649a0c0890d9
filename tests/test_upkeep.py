import random
from collections import Counter, defaultdict

import pytest

from fathomline.operators import hotkeys, incremental, orphans
from fathomline.tables import newest_row

EDGE = "id string, kind string, src_id string, dst_id string, last_seen_at bigint, h string, rng int, salt int, ref_key string"
NODE = "id string, chunk_id bigint, package_path string, content_hash string, last_seen_at bigint, record_id string, period string"


def test_profile_counts_rows_and_partners_of_skewed_keys(spark):
    rows = [("hot", f"p{i % 7}") for i in range(500)] + [("a", "x"), ("a", None), ("", "x"), (None, "x"), ("a", "x")]
    df = spark.createDataFrame([(k, p, 1, "z") for k, p in rows], "k string, p string, rows int, _partner string")
    got = {r.key_value: (r.rows, r.distinct_partners) for r in hotkeys.key_profile(df, "k", "p").collect()}
    assert got == {"hot": (500, 7), "a": (3, 1)}


@pytest.mark.parametrize("bins", [4, 64, 4096])
def test_selected_ranks_equal_sorting(spark, bins):
    rnd = random.Random(bins)
    values = {"hot": [rnd.randint(-(10**12), 10**12) for _ in range(3000)] + [5] * 400, "ties": [7] * 50, "few": [3, 1, 2], "wide": [-(2**62), 2**62 - 1, 0]}
    df = spark.createDataFrame([(k, v, None) for k, vs in values.items() for v in vs] + [(None, 1, None), ("few", None, None)], "k string, v bigint, rank int")
    got = defaultdict(dict)
    for r in hotkeys.select_ranks(df, "k", "v", probs=(0.0, 0.5, 0.9, 1.0), bins=bins).collect():
        got[r.k][r.prob] = (r.value, r.total)
    for k, vs in values.items():
        ordered = sorted(vs)
        for p in (0.0, 0.5, 0.9, 1.0):
            rank = max(1, -int(-p * len(vs) // 1))
            assert got[k][p] == (ordered[rank - 1], len(vs)), (k, p)


def test_ranks_at_the_ends_of_the_range(spark):
    df = spark.createDataFrame([("a", -(2**63)), ("a", 2**63 - 1), ("a", 0)], "k string, v bigint")
    assert [r.value for r in hotkeys.select_ranks(df, "k", "v", probs=(0.5,)).collect()] == [0]


def test_heavy_keys(spark):
    rows = ["hot"] * 400 + ["warm"] * 41 + ["edge"] * 40 + [f"k{i}" for i in range(500)] + [None] * 10 + [""] * 9
    df = spark.createDataFrame([(r,) for r in rows], "k string")
    assert len(rows) == 1000
    assert {r.key_value: r.rows for r in hotkeys.heavy_keys(df, "k", 0.04).collect()} == {"hot": 400, "warm": 41}


def test_empty_tables_of_keys(spark):
    df = spark.createDataFrame([], "k string, v bigint, p string")
    assert hotkeys.heavy_keys(df, "k", 0.04).count() == 0
    assert hotkeys.select_ranks(df, "k", "v", probs=(0.5,)).count() == 0
    assert hotkeys.key_profile(df, "k", "p").count() == 0
    only_null = spark.createDataFrame([(None, None, None)], "k string, v bigint, p string")
    assert hotkeys.heavy_keys(only_null, "k", 0.04).count() == 0


def _orphans(spark, edges, nodes, chunks, pruned):
    return {tuple(r) for r in orphans.find_orphans(spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE), spark.createDataFrame(chunks, "id bigint, last_seen_at bigint"), spark.createDataFrame(pruned, "table_name string, record_key string, pruned_at bigint")).collect()}


DAY = 86_400 * 10**9


def test_orphans_of_each_kind(spark):
    more = (None, None, None, None)
    edges = [
        ("e1", "calls", "n1", "n2", 10 * DAY, *more),
        ("e2", "calls", "n1", "gone", 40 * DAY, *more),
        ("e2", "calls", "n1", "gone", 5 * DAY, *more),  # repeated id: the period is that of the newest row
        ("e3", "calls", "", None, 10 * DAY, *more),
        ("e4", "calls", "dead", "back", 10 * DAY, *more),
        ("e5", "calls", "N1", "n2", None, *more),  # compared exactly; no stamp, no period
        ("e6", "calls", "n1", "late", 1 * DAY, *more),
    ]
    nodes = [("n1", 7, "p", "h", 1, None, None), ("n2", 8, "p", "h", 1, None, None), ("dead", None, "p", "h", 5, None, None), ("back", 9, "p", "h", 50, None, None), ("back", 9, "p", "h", 3, None, None), ("late", None, "p", "h", 99 * DAY, None, None)]
    chunks = [(7, 1), (9, 1), (None, 1)]
    pruned = [("graph_nodes", "dead", 6), ("graph_nodes", "back", 49), ("graph_nodes", "n1", 1), ("chunks", "9", 2), ("chunks", "7", 1), ("chunks", "n2", 99)]
    got = _orphans(spark, edges, nodes, chunks, pruned)
    assert got == {
        ("graph_edges", "dst_id", "e2", "1970-02"),
        ("graph_edges", "src_id", "e4", "1970-01"),
        ("graph_edges", "src_id", "e5", None),
        ("graph_nodes", "chunk_id", "n2", "1970-01"),
        ("graph_nodes", "chunk_id", "back", "1970-01"),
    }


def test_orphans_of_empty_tables(spark):
    assert _orphans(spark, [], [], [], []) == set()
    got = _orphans(spark, [("e", "calls", "a", "b", DAY, None, None, None, None)], [], [], [])
    assert {g[1] for g in got} == {"src_id", "dst_id"}


def test_hot_references_are_split_and_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(orphans, "_REFERENCES_PER_TASK", 50)
    rnd = random.Random(3)
    refs = [(f"r{i}", "hot" if i % 3 == 0 else f"k{rnd.randint(0, 400)}") for i in range(1500)]
    parents = [f"k{i}" for i in range(0, 400, 2)]
    got = orphans.missing_references(spark.createDataFrame(refs, "record_id string, ref_key string"), spark.createDataFrame([(p,) for p in parents], "parent_key string"))
    assert {r.record_id for r in got.collect()} == {r for r, k in refs if k not in set(parents)}
    assert got.count() == sum(k not in set(parents) for _, k in refs)


def test_probe_confirms_keys_of_equal_digests():
    import pyarrow as pa

    refs = pa.table({"record_id": ["a", "b", "c"], "ref_key": ["x", "y", "z"], "h": pa.array([1, 1, 1], pa.int64()), "rng": [0, 0, 0], "salt": [0, 0, 0]})
    entries = pa.array([[{"h": 1, "k": "x"}, {"h": 1, "k": "z"}]], pa.list_(pa.struct([("h", pa.int64()), ("k", pa.string())])))
    parents = pa.table({"rng": [0], "entries": entries, "salt": [0]})
    assert orphans._probe((0, 0), refs, parents)["record_id"].to_pylist() == ["b"]


RUNS = "run_id int, started_at timestamp_ntz, finished_at timestamp_ntz, status string"
LOG = "run_id int, table_name string, record_key string, content_hash string, logged_at timestamp_ntz"


def _at(day):
    from datetime import datetime

    return datetime(2025, 1, day)


def test_changes_since_the_last_successful_run(spark):
    runs = spark.createDataFrame([(1, _at(1), _at(2), "ok"), (2, _at(3), _at(4), "failed"), (3, _at(5), _at(6), "ok"), (4, _at(7), None, "running")], RUNS)
    log = spark.createDataFrame(
        [
            (1, "chunks", "a.py", "AA", _at(1)),
            (1, "chunks", "a.py", "aa", _at(1)),
            (2, "chunks", "b.py", "bb", _at(3)),
            (1, "graph_nodes", "n1", "h1", _at(1)),
            (3, "graph_nodes", "n1", "H2", _at(5)),
            (1, "graph_nodes", "n2", "h1", _at(1)),
            (2, "graph_nodes", "n2", "h2", _at(3)),
            (4, "graph_nodes", "n3", "h3", _at(7)),
        ],
        LOG,
    )
    chunks = spark.createDataFrame([(1, "a.py", "aA", 1, "x"), (2, "b.py", "bb", 1, "x"), (2, "b.py", "bb", 2, "x"), (3, None, "cc", 4 * 10**18, "x"), (4, "a.py", None, None, "x"), (None, "z", "z", 1, "x")], "id bigint, path string, content_sha1 string, last_seen_at bigint, run_id string")
    nodes = spark.createDataFrame([("n1", "h2", 5), ("n1", "h1", 1), ("n2", "h2", 5), ("n3", "h3", 5), ("n4", None, 5)], "id string, content_hash string, last_seen_at bigint")
    got = {tuple(r) for r in incremental.changes_since_last_run(chunks, nodes, log, runs).collect()}
    assert got == {("chunks", "2", "late"), ("chunks", "3", "reread"), ("chunks", "4", "late"), ("graph_nodes", "n2", "late"), ("graph_nodes", "n3", "late"), ("graph_nodes", "n4", "late")}


def test_nothing_ran_yet(spark):
    runs, log = spark.createDataFrame([], RUNS), spark.createDataFrame([], LOG)
    chunks = spark.createDataFrame([(1, "a", "b", 1)], "id bigint, path string, content_sha1 string, last_seen_at bigint")
    nodes = spark.createDataFrame([], "id string, content_hash string, last_seen_at bigint")
    assert [tuple(r) for r in incremental.changes_since_last_run(chunks, nodes, log, runs).collect()] == [("chunks", "1", "reread")]
    assert [tuple(r) for r in incremental.reread_from(runs).collect()] == [(None, None)]


def test_reread_point_reaches_back_to_runs_still_open(spark):
    runs = spark.createDataFrame([(1, _at(1), _at(2), "ok"), (2, _at(3), None, "aborted"), (3, _at(4), _at(9), "failed"), (4, _at(6), _at(7), "ok"), (5, _at(8), None, "running")], RUNS)
    assert [tuple(r) for r in incremental.reread_from(runs).collect()] == [(4, _at(3))]


def test_a_failed_run_neither_skips_nor_repeats(spark):
    chunks = [(i, f"f{i}", f"s{i}", i) for i in range(20)]
    df = spark.createDataFrame(chunks, "id bigint, path string, content_sha1 string, last_seen_at bigint")
    nodes = spark.createDataFrame([], "id string, content_hash string, last_seen_at bigint")
    runs, log, seen = [], [], Counter()
    for n, (status, taken) in enumerate([("ok", 8), ("failed", 5), ("ok", 99)], 1):
        now = incremental.changes_since_last_run(df, nodes, spark.createDataFrame(log, LOG), spark.createDataFrame(runs, RUNS)).collect()
        batch = [chunks[int(r.record_id)] for r in now][:taken]
        runs.append((n, _at(n), _at(n), status))
        log += [(n, "chunks", p, s, _at(n)) for _, p, s, _ in batch]
        if status == "ok":
            seen.update(r[0] for r in batch)
    assert seen == Counter(range(20))


def test_newest_row_breaks_ties_by_value(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), ("b", None, "q"), (None, 1, "n")], "k string, s int, v string")
    assert {r.k: r.v for r in newest_row(df, "k", "s", "v").collect()} == {"a": "z", "b": "q", None: "n"}


def test_a_killed_run_is_as_if_it_had_not_been(spark, tmp_path):
    from fathomline.sources.ledger import RunLedger

    ledger = RunLedger(spark, str(tmp_path / "ledger"), buckets=4)
    rows = [(1, "a", "AA", 10), (2, "b", "bb", 20), (3, "c", None, 30), (4, "d", "dd", None)]
    df = lambda data: spark.createDataFrame(data, "id bigint, path string, sha string, seen bigint")
    ids = lambda d: sorted(r.id for r in d.collect())
    pending = lambda data, **more: ids(ledger.pending(df(data), "path", "sha", "seen", **more))
    assert pending(rows) == [1, 2, 3, 4] and ledger.reread_from() is None
    killed = ledger.open(now=5)
    ledger.append(killed, df(rows), "path", "sha")  # and here it dies, before its commit
    assert pending(rows) == [1, 2, 3, 4]
    run = ledger.open(now=15)
    todo = ledger.pending(df(rows), "path", "sha", "seen")
    ledger.append(run, todo, "path", "sha")
    ledger.append(run, todo, "path", "sha")  # a repeated write changes nothing
    assert pending(rows) == [1, 2, 3, 4], "not before the commit"
    ledger.commit(run, now=18)
    assert pending(rows) == [3], "records without a version always come out"
    assert ledger.reread_from() == 5, "the killed run is still open"
    ledger.abandon(killed, now=6)
    assert ledger.reread_from() == 15
    with pytest.raises(RuntimeError):
        ledger.commit(run)
    # touched, changed, late and new records
    later = [(1, "a", "aa", 99), (2, "b", "b2", 98), (5, "e", "ee", 1), (6, "f", "ff", 97)]
    assert pending(later) == [2, 5, 6] and pending(later, late=False) == [2, 6]  # not 5, which came with an old stamp
    third = ledger.open(now=50)
    ledger.append(third, ledger.pending(df(later), "path", "sha", "seen"), "path", "sha")
    ledger.commit(third, now=60)
    assert pending(later) == [] and pending([(2, "b", "bb", 100)]) == [], "an earlier version is processed"
    plan = ledger.pending(df(later), "path", "sha", "seen")._jdf.queryExecution().executedPlan().toString()
    assert "run_id" in plan.split("PartitionFilters")[1].split("PushedFilters")[0] and "NestedLoop" not in plan
    assert ids(ledger.pending(df([]), "path", "sha", "seen")) == []
