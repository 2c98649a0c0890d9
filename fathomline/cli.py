"""The command line: ``python -m fathomline.cli COMMAND ...``.

Every command works on one index directory (``--store``).  Answers are printed as JSON lines, texts as they are.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import DataFrame

from fathomline.engine import Engine
from fathomline.session import build_session
from fathomline.sources import tree

# Folders of the system that are no projects.
PROTECTED = frozenset("/ /home /Users /usr /var /etc /proc /sys /tmp /mnt /run /dev /boot /opt /srv /lost+found /System /Library /Applications /private /cores /Volumes /Network".split())


class RefusedError(Exception):
    """A folder that is not indexed unless the caller insists."""


def check_root(root: str, allowed: Sequence[str] = (), force: bool = False) -> None:
    """Raise ``RefusedError`` for folders of the system, the home folder, and what is neither below ``allowed`` nor in a work tree of git."""
    path = os.path.realpath(root)
    if force:
        return
    if path in PROTECTED or path == os.path.realpath(os.path.expanduser("~")):
        raise RefusedError(f"{path} is no project")
    if any(path == p or path.startswith(p.rstrip("/") + "/") for p in map(os.path.realpath, allowed)):
        return
    above = path
    while not os.path.exists(os.path.join(above, ".git")):
        if above == os.path.dirname(above):
            raise RefusedError(f"{path} is in no work tree")
        above = os.path.dirname(above)


def parser() -> argparse.ArgumentParser:
    made = argparse.ArgumentParser(prog="fathomline")
    made.add_argument("--store", required=True, help="directory of the index")
    made.add_argument("--master", default="local[*]")
    commands = made.add_subparsers(dest="command", required=True)

    for name in ("index", "reindex"):
        one = commands.add_parser(name)
        one.add_argument("root")
        one.add_argument("--allow", action="append", default=[], help="folder below which projects are indexed")
        one.add_argument("--force", action="store_true")
    for name in ("search", "ask"):
        one = commands.add_parser(name)
        one.add_argument("question")
        one.add_argument("-k", type=int, default=8)
        if name == "search":
            one.add_argument("--exclude", default="")
            one.add_argument("--summaries", action="store_true")
        else:
            one.add_argument("--intent", default="auto")
    for name in ("symbol", "callers", "callees"):
        one = commands.add_parser(name)
        one.add_argument("name")
        one.add_argument("-k", type=int, default=10 if name == "symbol" else 12)
        one.add_argument("--package", default="")
    for name in ("status", "guide", "nuke"):
        commands.add_parser(name)
    commands.add_parser("deps").add_argument("package")
    for name in ("clone", "export"):
        commands.add_parser(name).add_argument("target")
    one = commands.add_parser("bundle")
    one.add_argument("root")
    one.add_argument("--strip", action="store_true")
    return made


def _print(df: DataFrame) -> None:
    for row in df.drop("vec").toLocalIterator():
        print(json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command in ("index", "reindex"):
        try:
            check_root(args.root, args.allow, args.force)
        except RefusedError as refused:
            print(refused, file=sys.stderr)
            return 2
    spark = build_session("fathomline", args.master)
    engine = Engine(spark, args.store)
    match args.command:
        case "index" | "reindex":
            engine.index(args.root, full=args.command == "reindex")
            print(json.dumps(engine.status()))
        case "search":
            _print(engine.search(args.question, args.k, args.exclude, args.summaries))
        case "ask":
            print(json.dumps(engine.ask(args.question, args.intent, args.k), ensure_ascii=False, default=str))
        case "symbol":
            _print(engine.find_symbol(args.name, args.k))
        case "callers" | "callees":
            _print(getattr(engine, args.command)(args.name, args.package, args.k))
        case "deps":
            _print(engine.package_dependencies(args.package))
        case "status":
            print(json.dumps(engine.status()))
        case "guide":
            print(engine.guide())
        case "export":
            engine.export(args.target)
        case "clone":
            engine.clone(args.target)
        case "nuke":
            engine.drop()
        case "bundle":
            rows = tree.bundle_text(tree.read_tree(spark, args.root, tree.project_rules(spark, args.root)), args.strip).orderBy("path")
            for row in rows.toLocalIterator():
                print(row.block)
    return 0


if __name__ == "__main__":
    sys.exit(main())
