import importlib.util
import os

import pytest

from fathomline.engine import Engine

FILES = {
    "shop/cart.py": "from shop.price import total\n\n\nclass Cart:\n    def add(self, item):\n        self.items.append(item)\n        return self.sum()\n\n    def sum(self):\n        return total(self.items)\n",
    "shop/price.py": "# prices of a cart\ndef total(items):\n    return sum(i.price for i in items)\n\n\ndef unused():\n    return total([])\n",
    "README.md": "# Shop\n\nA cart and its prices.\n",
}


def test_index_search_ask_and_reindex(spark, tmp_path):
    def _embed(texts):
        words = ["cart", "price", "total", "items"]
        return [[1.0 + t.lower().count(w) for w in words] + [0.01] * 60 for t in texts]

    root = tmp_path / "proj"
    for name, text in FILES.items():
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_text(text)
    engine = Engine(spark, str(tmp_path / "store"), embed=_embed)
    engine.index(str(root), now=100)
    first = {r.id for r in engine.chunks().collect()}
    assert engine.search("total price items", 3).first().path.startswith("shop/")
    assert [r.qualified_name for r in engine.find_symbol("total").collect()] == ["total"]
    callers = {r.peer.rsplit("::", 1)[1] for r in engine.callers("total").collect()}
    assert callers == {"Cart.sum", "unused"}
    assert {r.peer.rsplit("::", 1)[1] for r in engine.callees("Cart.add").collect()} == {"Cart.sum"}
    bundle = engine.ask("who calls total")
    assert bundle["intent"] == "callers" and bundle["hits"]
    looked = engine.ask("Cart")
    assert looked["intent"] == "symbol_lookup" and looked["symbols"][0]["name"] == "Cart" and "shop/cart.py" in looked["next_action"]
    assert engine.did_you_mean("otal") == ["total"]
    guide = engine.guide()
    assert "## shop" in guide and "### Key internal hot spots\n\n- `total`" in guide and "### Depends on\n\n- shop.price" in guide
    assert "## shop" in engine.guide("shop") and "## ." not in engine.guide("shop")
    engine.index(str(root), now=200)
    assert {r.id for r in engine.chunks().collect()} == first and {r.last_seen_at for r in engine.chunks().collect()} == {200}
    (root / "shop/price.py").unlink()
    engine.index(str(root), now=300)
    assert "shop/price.py" not in {r.path for r in engine.chunks().collect()}
    assert engine.status()["files"] == 2 and engine.status()["stale"]
    reranked = Engine(spark, str(tmp_path / "store"), embed=_embed, rerank=lambda q, texts: [float("README" in t or "Shop" in t) for t in texts])
    assert reranked.search("cart", 1).first().path == "README.md"
    copy = engine.clone(str(tmp_path / "copy"))
    engine.drop()
    assert copy.chunks().count() > 0


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_every_query_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    spec = importlib.util.spec_from_file_location("entry", os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert module.entry(spark).columns
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")

    def plain(v):
        if isinstance(v, float):
            return f"{v:.7g}"
        return repr(v)

    queries, sql = module.queries(), module.oracle_sql()
    assert set(sql) <= set(queries)
    for name, text in sql.items():
        df = queries[name](spark, DATA)
        columns = sorted(df.columns)
        result = con.execute(text)
        names = [c[0] for c in result.description]
        assert sorted(names) == columns, name
        order = [names.index(c) for c in columns]
        want = sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
        got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
        assert got == want, name


def test_queries_are_known_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_unchanged_files_are_not_opened_and_rules_of_the_project_hold(spark, tmp_path):
    import time

    root = tmp_path / "proj"
    big = "def big(a, b):\n" + "".join(f"    a = a + {i}\n" for i in range(40)) + "    return total([a, b])\n"
    for name, text in {**FILES, "shop/big.py": "import os\nfrom shop.price import total\n\n\n" + big, "shop/test_price.py": "from shop.price import total\n", "out/made.py": "x = 1\n", ".gitignore": "out/\n"}.items():
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_text(text)
    engine = Engine(spark, str(tmp_path / "store"))
    first = time.time_ns()
    engine.index(str(root), now=first)
    assert {r.path for r in engine.chunks().select("path").distinct().collect()} == {"shop/cart.py", "shop/price.py", "README.md", "shop/big.py", "shop/test_price.py"}
    edges = engine.edges().count()
    old = first // 10**9 - 1000
    for p in root.rglob("*.*"):
        os.utime(p, (old, old))
    # what is not opened is not noticed: the text changes under an old stamp, another file gets a new one
    (root / "shop/cart.py").write_text("x = 1\n")
    os.utime(root / "shop/cart.py", (old, old))
    (root / "shop/new.py").write_text("def fresh():\n    return 2\n")
    os.utime(root / "shop/new.py", (old, old))
    (root / "README.md").write_text("# Shop\n\nAnother text.\n")
    os.utime(root / "README.md", (first // 10**9 + 50, first // 10**9 + 50))
    (root / "shop/test_price.py").unlink()
    engine.index(str(root), now=first + 10**9)
    chunks = {(r.path, r.name): r.content for r in engine.chunks().collect()}
    assert ("shop/cart.py", "Cart") in chunks and ("shop/new.py", "fresh") in chunks and "Another text" in chunks["README.md", ""]
    assert not any(p == "shop/test_price.py" for p, _ in chunks)
    assert edges - 6 <= engine.edges().count() <= edges + 6 and engine.callers("total").count() > 0
    engine.index(str(root), now=first + 2 * 10**9, full=True)
    assert ("shop/cart.py", "Cart") not in {(r.path, r.name) for r in engine.chunks().collect()}
    # bundles carry source within a budget, and notes on their files
    bundle = engine.ask("big")
    assert bundle["intent"] == "symbol_lookup" and bundle["symbols"][0]["body"].startswith("def big(a, b):") and bundle["symbols"][0]["signature"] == "def big(a, b)"
    assert "import os" in bundle["annotations"]["shop/big.py"]["imports"] and bundle["annotations"]["shop/big.py"]["nearest_doc"] == "README.md"
    assert all(len(h["content"]) <= 64 for h in engine.ask("big", most_bytes=64)["hits"])
    assert {r["path"] for r in engine.ask("who calls Cart.sum")["references"]} == {"shop/price.py"}
    # summaries: queued once, drained, failures stay with their error
    assert engine.enqueue_summaries(now=1) == 1 and engine.enqueue_summaries(now=2) == 0

    def broken(text):
        raise ValueError("no model")

    assert engine.drain_summaries(broken) == 0
    assert [(r.attempts, r.last_error) for r in engine.queue().collect()] == [(1, "no model")]
    assert engine.drain_summaries(lambda t: f"{len(t.splitlines())} lines") == 1 and engine.drain_summaries(broken) == -1
    assert [r.content for r in engine.chunks().where("kind = 'chunk_summary'").collect()] == [f"{len(big.splitlines())} lines"]
    assert engine.enqueue_summaries(now=3) == 0


def test_command_line_watching_and_generation(spark, tmp_path, capsys):
    import json
    import time

    from fathomline import cli
    from fathomline.functions.rerank import judged_by_chat
    from fathomline.streaming.watch import IdleHook

    root, store = tmp_path / "proj", str(tmp_path / "store")
    for name, text in FILES.items():
        os.makedirs(root / os.path.dirname(name), exist_ok=True)
        (root / name).write_text(text)
    assert cli.main(["--store", store, "index", "/"]) == 2 and cli.main(["--store", store, "index", str(root)]) == 2
    with pytest.raises(cli.RefusedError):
        cli.check_root(os.path.expanduser("~"))
    cli.check_root("/", force=True)
    capsys.readouterr()
    assert cli.main(["--store", store, "index", str(root), "--allow", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out)["files"] == 3
    assert cli.main(["--store", store, "symbol", "total"]) == 0
    assert json.loads(capsys.readouterr().out)["file_path"] == "shop/price.py"
    assert cli.main(["--store", store, "bundle", str(root), "--strip"]) == 0
    assert "===== shop/price.py =====\ndef total(items):" in capsys.readouterr().out
    engine = Engine(spark, store)
    assert engine.guide_is_stale() and engine.guide() and not engine.guide_is_stale()
    assert "total" in engine.generate("total price", lambda system, prompt: prompt) and engine.generate("total", lambda s, p: p, k=0) == "total"
    with pytest.raises(ValueError):
        engine.generate(" ", lambda s, p: p)
    assert judged_by_chat(lambda q, t: (-1.0, -1.0) if t == "a" else (None, None))("q", ["a", "b"]) == [0.5, 0.5]
    # a quiet run of changes becomes one refresh
    (root / "shop/new.py").write_text("def fresh():\n    return 3\n")
    feed = tmp_path / "feed"
    feed.mkdir()
    hook = IdleHook(lambda: True, delay=0.0)
    events = spark.readStream.schema("path string, event_type string, ts timestamp").json(str(feed))
    query = engine.watch(events, str(root), str(tmp_path / "checkpoint"), watermark="1 second", initial=False, idle=hook)
    try:
        for n, second in enumerate(("00", "30", "59")):
            (feed / f"{n}.json").write_text(json.dumps({"path": "shop/new.py", "event_type": "create", "ts": f"2025-01-01T00:00:{second}Z"}))
            query.processAllAvailable()
        until = time.time() + 60
        while "shop/new.py" not in {r.path for r in engine.chunks().select("path").collect()} and time.time() < until:
            time.sleep(1)
    finally:
        query.stop()
    assert "shop/new.py" in {r.path for r in engine.chunks().select("path").collect()} and hook.poll()
