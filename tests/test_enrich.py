from pyspark.sql import functions as F

from fathomline.functions import enrich
from fathomline.streaming.watch import IdleHook


def test_signatures():
    go = "package a\n\n// Foo does it.\n// Twice.\nfunc Foo(a int,\n\tb []string) (int, error) {\n\treturn 1, nil\n}\n"
    assert enrich.signature_of(go, 1, "Foo") == ("func Foo(a int, b []string) (int, error)", "Foo does it.\nTwice.", 5)
    py = 'def food():\n    pass\n\ndef foo(a, b=(1, 2)):\n    """Adds."""\n    return a\n'
    assert enrich.signature_of(py, 1, "foo") == ("def foo(a, b=(1, 2))", "Adds.", 4)
    assert enrich.signature_of(py, 1, "fo") is None and enrich.signature_of("", 1, "x") is None
    assert enrich.signature_of("\n" * 200 + "def late():\n", 1, "late") is None


def test_owners_tags_and_commits(spark):
    rules = ["# comment", "* @all", "docs/ @writers @all", "/src/*.go @go", "!x @never", "src/empty.go"]
    df = spark.createDataFrame([("a.txt", ["@all"]), ("docs/x.md", ["@writers", "@all"]), ("src/a.go", ["@go"]), ("src/b/c.go", ["@all"]), ("src/empty.go", [])], "p string, want array<string>")
    assert df.where(enrich.owners(F.col("p"), rules) != F.col("want")).count() == 0
    text = spark.createDataFrame([("//go:build linux\npackage a",), (None,), ("x\n" * 30 + "//go:build late",)], "t string")
    assert [r.b for r in text.select(enrich.build_tags(F.col("t")).alias("b")).collect()] == [["//go:build linux"], [], []]
    commits = spark.createDataFrame([("a", "c1", "x", 1), ("a", "c2", "y", 2), ("b", "c1", "x", 1)], "path string, commit string, author string, committed_at int")
    assert [tuple(r) for r in enrich.last_commits(spark.createDataFrame([("a",), ("a",), ("z",)], "path string"), commits).collect()] == [("a", "c2", "y", 2)]


def test_idle_hook():
    now, results, ran = [0.0], [False, True], []
    hook = IdleHook(lambda: ran.append(now[0]) or results.pop(0), 5.0, lambda: now[0])
    assert not hook.poll()
    hook.flushed()
    now[0] = 4
    hook.event()
    now[0] = 10
    assert not hook.poll()
    hook.flushed()
    now[0] = 15
    assert hook.poll() and not hook.poll()
    now[0] = 20
    assert hook.poll() and ran == [15, 20]
    now[0] = 99
    assert not hook.poll()
