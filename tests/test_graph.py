import json
import random
from collections import defaultdict

from pyspark.sql import functions as F

from fathomline.functions import extract, paths
from fathomline.operators import graph
from fathomline.session import materialise

NODE = "id string, kind string, name string, qualified_name string, package_path string, file_path string, start_line int, end_line int"
EDGE = "id string, kind string, src_id string, dst_id string, file_path string, start_line int"


def _world(spark):
    nodes = [(f"n{i}", "function", f"F{i}", f"F{i}", f"p{i % 3}" if i else "", f"d/f{i % 4}.go", i + 1, i + 4) for i in range(12)]
    rnd = random.Random(1)
    edges = [(f"e{i}", "calls", f"n{rnd.randint(0, 11)}", f"n{rnd.randint(0, 6)}", "d/f.go", i) for i in range(40)]
    edges += [("x1", "calls", "n1", "nowhere", "d/f.go", 1), ("x2", "imports", "n1", "n2", "d/f.go", 1), ("x3", "calls", None, "n2", "d/f.go", 1), ("x4", "calls", "n3", "n3", "f", 2)]
    return spark.createDataFrame(nodes, NODE), spark.createDataFrame(edges, EDGE), nodes, edges


def _pagerank(ids, pairs):
    out = defaultdict(set)
    for s, d in pairs:
        out[s].add(d)
    n = len(ids)
    rank = dict.fromkeys(ids, 1 / n)
    for _ in range(20):
        idle = sum(r for i, r in rank.items() if i not in out)
        new = dict.fromkeys(ids, 0.15 / n + 0.85 * idle / n)
        for s, ds in out.items():
            for d in ds:
                new[d] += 0.85 * rank[s] / len(ds)
        rank = new
    return rank


def test_centrality_equals_brute_force(spark):
    nd, ed, nodes, edges = _world(spark)
    pkg = {n[0]: n[4] for n in nodes}
    pairs = {(e[2], e[3]) for e in edges if e[1] == "calls" and e[2] in pkg and e[3] in pkg}
    rank = _pagerank(list(pkg), pairs)
    got = {r.id: r for r in graph.centrality(nd, ed).collect()}
    assert abs(sum(r.pagerank for r in got.values()) - 1) < 1e-9
    for i in pkg:
        assert got[i].in_degree == sum(d == i for _, d in pairs) and got[i].out_degree == sum(s == i for s, _ in pairs)
        assert got[i].cross_pkg_callers == len({pkg[s] for s, d in pairs if d == i and pkg[s] and pkg[s] != pkg[i]})
        assert abs(got[i].pagerank - rank[i]) < 1e-9


def test_no_calls_no_ranks(spark):
    nd, ed, *_ = _world(spark)
    assert graph.pagerank(nd, ed.limit(0).select("src_id", "dst_id")).count() == 0
    assert {r.pagerank for r in graph.centrality(nd, ed.limit(0)).collect()} == {0.0}
    assert graph.centrality(nd.limit(0), ed).count() == 0


def test_interface_methods_forward_to_implementations(spark):
    nodes = [(i, k, n, n, "p", "f", 1, 1) for i, k, n in (("I", "interface", "I"), ("T", "struct", "T"), ("I.m", "method", "Run"), ("T.m", "method", "Run"), ("T.o", "method", "Other"))]
    edges = [("1", "has_method", "I", "I.m", "f", 1), ("2", "has_method", "T", "T.m", "f", 1), ("3", "has_method", "T", "T.o", "f", 1), ("4", "implements", "T", "I", "f", 1)]
    got = graph.forwarded_calls(spark.createDataFrame(edges, EDGE), spark.createDataFrame(nodes, NODE)).collect()
    assert [tuple(r) for r in got] == [("I.m", "T.m")]


def test_call_sites_sort_then_cut(spark):
    nd, ed, nodes, edges = _world(spark)
    deg = graph.degrees(graph.flow_edges(ed, nd))
    rows = graph.call_sites(ed, nd, deg, True, 3).collect()
    d = {r.id: r.in_degree for r in deg.collect()}
    ids = {n[0] for n in nodes}
    by = defaultdict(list)
    for r in rows:
        by[r.target].append((r.place, r.peer, r.start_line))
    for t, got in by.items():
        want = sorted({(-d.get(e[2], 0), e[4], e[5], e[2]) for e in edges if e[1] == "calls" and e[3] == t and e[2] in ids})[:3]
        assert [(p, line) for _, p, line in sorted(got)] == [(w[3], w[2]) for w in want]


def test_targets_by_name_and_package_tail(spark):
    rows = [("1", "method", "Foo", "(*T).Foo", "a/b", "f", 1, 1), ("2", "function", "Foo", "Foo", "a/c", "f", 1, 1), ("3", "struct", "Foo", "Foo", "a/c", "f", 1, 1), ("4", "function", "Bar", "Bar", "a/c", "f", 1, 1)]
    nd = spark.createDataFrame(rows, NODE)
    ids = lambda *a: {r.id for r in graph.resolve_targets(nd, *a).collect()}
    assert ids("Foo") == {"1", "2"} and ids("(*T).Foo") == {"1"} and ids("c.Bar") == {"4"} and ids("Foo", "a/c") == {"2"} and ids("zzz.Bar") == set()


def test_roles_and_short_ids(spark):
    cases = [("A", 0, 0, 0, ""), ("A", 5, 0, 0, "central:5"), ("A", 2, 1, 2, "central:2/2pkg"), ("A", 0, 1, 0, "exported-unused"), ("a", 0, 1, 0, ""), ("a", 1, 0, 0, "leaf"), ("a", 1, 1, 1, "")]
    df = spark.createDataFrame(cases, "n string, i int, o int, p int, want string")
    assert all(r.got == r.want for r in df.select("want", graph.role(*map(F.col, ("n", "i", "o", "p"))).alias("got")).collect())
    ids = [("package", "a/b", "a/b", "b", "b"), ("import", "x", "fmt", "fmt", "fmt"), ("method", "a/b", "T.m", "m", "b.T.m"), ("function", "", "f", "f", "f"), ("function", "a/b", "", "f", "b.f"), ("package", None, "q", None, "q")]
    df = spark.createDataFrame(ids, "k string, p string, q string, n string, want string")
    assert all(r.got == r.want for r in df.select("want", graph.compact_id(*map(F.col, ("k", "p", "q", "n"))).alias("got")).collect())


def test_tightest_chunk(spark):
    nodes = spark.createDataFrame([("a", "f", 10), ("b", "f", 300), ("c", "g", 5), ("d", "", 5), ("e", "f", 0)], "id string, file_path string, start_line int")
    chunks = spark.createDataFrame([(1, "f", "class", 1, 400), (2, "f", "m", 5, 20), (3, "f", "m", 5, 20), (4, "f", "file_summary", 10, 10), (5, "g", "m", 6, 9), (6, "f", "m", None, 3)], "id bigint, path string, kind string, start_line int, end_line int")
    assert {tuple(r) for r in graph.tightest_chunk(nodes, chunks).collect()} == {("a", 2), ("b", 1)}


def test_python_graph(spark):
    files = [
        ("pkg/__init__.py", "from .core import run\n"),
        ("pkg/core.py", "import pkg.util as u\nfrom pkg.util import helper\n\nclass Job:\n    def start(self):\n        self.stop()\n        helper()\n        u.other()\n    def stop(self):\n        pass\n\ndef run():\n    j = Job()\n    local()\n\ndef local():\n    unknown()\n"),
        ("pkg/util.py", "def helper():\n    return other()\n\ndef other():\n    return 1\n"),
        ("bad.py", "def broken(:\n"),
        ("none.py", None),
    ]
    records = materialise(extract.extract_records(spark.createDataFrame(files, "path string, content string")), "records")
    nodes, edges = extract.build_graph(records, "m")
    calls = {(r.src_id, r.dst_id) for r in edges.where("kind = 'calls'").collect()}
    assert calls == {
        ("m::pkg.core::method::Job.start", "m::pkg.core::method::Job.stop"),
        ("m::pkg.core::method::Job.start", "m::pkg.util::function::helper"),
        ("m::pkg.core::method::Job.start", "m::pkg.util::function::other"),
        ("m::pkg.core::function::run", "m::pkg.core::class::Job"),
        ("m::pkg.core::function::run", "m::pkg.core::function::local"),
        ("m::pkg.util::function::helper", "m::pkg.util::function::other"),
    }
    assert nodes.count() == nodes.select("id").distinct().count()
    kinds = {r.kind for r in edges.select("kind").distinct().collect()}
    assert kinds == {"contains", "imports", "has_method", "calls"}
    assert ("pkg", "pkg.core") in {(r.package_path, r.name) for r in nodes.where("kind = 'import'").collect()}


def test_other_languages(spark):
    files = [
        ("web/a.ts", "import { go as run } from './b';\nimport * as b from './b';\n\nexport class View {\n  show() {\n    this.hide();\n    run();\n    b.stop();\n  }\n  hide() {\n    return 1;\n  }\n}\n"),
        ("web/b.ts", "export function go() {\n  return stop();\n}\nexport function stop() {\n  return 2;\n}\n"),
        ("src/lib.rs", "use crate::deep::dive;\n\npub fn top() {\n    dive();\n}\n"),
        ("src/deep.rs", "pub fn dive() {\n    let x = 1;\n}\n"),
        ("java/A.java", "package a.b;\n\nimport a.c.Util;\n\npublic class A {\n    public void go() {\n        Util.help(1);\n        this.stop();\n    }\n    void stop() {\n    }\n}\n"),
        ("java/Util.java", "package a.c;\n\npublic class Util {\n    public static void help(int x) {\n    }\n}\n"),
    ]
    records = materialise(extract.extract_records(spark.createDataFrame(files, "path string, content string")), "records")
    _, edges = extract.build_graph(records, "m")
    calls = {(r.src_id.split("::", 1)[1], r.dst_id.split("::", 1)[1]) for r in edges.where("kind = 'calls'").collect()}
    assert ("web/a::method::View.show", "web/a::method::View.hide") in calls
    assert ("web/a::method::View.show", "web/b::function::go") in calls
    assert ("web/a::method::View.show", "web/b::function::stop") in calls
    assert ("::function::top", "deep::function::dive") in calls
    assert ("a.b::method::A.go", "a.c::method::Util.help") in calls and ("a.b::method::A.go", "a.b::method::A.stop") in calls


def test_relations_between_types_and_files(spark):
    files = [
        ("src/shape.rs", "pub trait Area {\n    fn area(&self) -> f64;\n}\n\npub struct Square {\n    side: f64,\n}\n\nimpl<T: Copy> Area for Square {\n    fn area(&self) -> f64 {\n        1.0\n    }\n}\n"),
        ("java/Run.java", "package a.b;\n\npublic interface Run {\n    void go();\n}\n"),
        ("java/Job.java", "package a.c;\n\nimport a.b.Run;\n\npublic class Job extends Base implements Run, Comparable<Job> {\n    public void go() {\n    }\n}\n"),
        ("web/a.ts", "export interface View {\n  show(): void;\n}\n\nexport class Page implements View {\n  show() {\n    return 1;\n  }\n}\n"),
        ("g/a.go", "package g\n\ntype Base struct {\n\tID int\n}\n\ntype Row struct {\n\t*Base\n\tName, Kind string `json:\"n\"`\n\tsub struct {\n\t\tx int\n\t}\n}\n"),
        ("ops/main.yaml", "# all\n- import: ./sub/../part.yml # one\n- use: '../top.yaml'\nimport: {{ name }}.yaml\nimport: missing.yaml\nvars.load: ../../out.yaml\n"), ("ops/part.yml", "x: 1\n"), ("top.yaml", "y: 1\n"),
    ]
    df = spark.createDataFrame(files, "path string, content string")
    nodes, edges = extract.build_graph(materialise(extract.extract_records(df), "records"), "m")
    found = {(r.kind, r.src_id.split("::", 1)[1], r.dst_id.split("::", 1)[1]) for r in edges.where("kind in ('implements', 'embeds', 'has_field')").collect()}
    assert found == {
        ("implements", "shape::class::Square", "shape::interface::Area"),
        ("implements", "a.c::class::Job", "a.b::interface::Run"),
        ("implements", "web/a::class::Page", "web/a::interface::View"),
        ("embeds", "g::type::Row", "g::type::Base"),
        ("has_field", "g::type::Base", "g::field::Base.ID"),
        ("has_field", "g::type::Row", "g::field::Row.Name"),
        ("has_field", "g::type::Row", "g::field::Row.Kind"),
    } | {e for e in found if e[2] == "g::field::Row.sub"}
    imports = {(r.file_path, r.dst_id.rsplit("::", 1)[1], r.start_line) for r in edges.where("kind = 'imports' and file_path like '%.yaml'").collect()}
    assert imports == {("ops/main.yaml", "ops/part.yml", 2), ("ops/main.yaml", "top.yaml", 3)}
    assert {tuple(r) for r in extract.yaml_references(df).collect()} == {("ops/main.yaml", "ops/part.yml", 2), ("ops/main.yaml", "top.yaml", 3)}
    marks = {r.file_path: json.loads(r.metadata_json) for r in edges.collect()}
    assert marks["web/a.ts"] == {"provenance": "parser", "language": "ts"}
    stamped = extract.with_provenance(spark.createDataFrame([("a.py", '{"provenance":"types"}'), ("b", None)], "file_path string, metadata_json string"))
    assert [json.loads(r.metadata_json) for r in stamped.orderBy("file_path").collect()] == [{"provenance": "types", "language": "py"}, {"provenance": "parser", "language": ""}]
    assert nodes.where("kind = 'field'").count() >= 3


def test_paths_are_cleaned(spark):
    rows = [("a/./b//c", "a/b/c"), ("a/../b", "b"), ("../a", "../a"), ("a/../../b", "../b"), (".", "."), ("", "."), ("a/..", ".")]
    df = spark.createDataFrame(rows, "p string, want string")
    assert df.where(paths.clean(F.col("p")) != F.col("want")).count() == 0


def test_pagerank_equals_the_power_method(spark):
    import numpy as np

    rnd = np.random.default_rng(3)
    pairs = {(int(a), int(b)) for a, b in rnd.integers(0, 40, (150, 2))} | {(i, 0) for i in range(1, 30)}
    nodes = spark.createDataFrame([(str(i),) for i in range(60)], "id string")
    flow = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "src_id string, dst_id string")
    for iterations, together in ((20, 5), (7, 3), (1, 5)):
        x = np.full(60, 1 / 60)
        out = np.bincount([a for a, _ in pairs], minlength=60)
        for _ in range(iterations):
            y = np.full(60, (0.15 + 0.85 * x[out == 0].sum()) / 60)
            for a, b in pairs:
                y[b] += 0.85 * x[a] / out[a]
            x = y
        got = {int(r.id): r.pagerank for r in graph.pagerank(nodes, flow, iterations, together=together).collect()}
        assert max(abs(got[i] - x[i]) for i in range(60)) < 1e-12
    chain = spark.createDataFrame([("0", "1"), ("1", "2")], "src_id string, dst_id string")  # nothing moves after two steps
    assert abs(sum(r.pagerank for r in graph.pagerank(nodes.limit(5), chain).collect()) - 1) < 1e-9
