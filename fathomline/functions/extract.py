"""Graph extraction: symbols, imports and calls of source files, resolved to edges by joins.

A file is parsed by itself into flat records; which call means which symbol is decided by joins between these records,
in the order: own package, own class, imported name, imported module or class.  Python is parsed with its own grammar, the
other languages by their declaration heads.  Types give the interfaces they name (Rust, Java, TypeScript), and in Go what
they embed and their fields.  Calls through values, inheritance and types of receivers are not resolved.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.chunking import chunk_file

_FIELDS = ["rec", "path", "package", "kind", "name", "qualified", "owner", "lane", "base", "target", "symbol", "start_line", "end_line"]
SCHEMA = ", ".join(f"{f} {'int' if f.endswith('_line') else 'string'}" for f in _FIELDS)
_KINDS = {"class_definition": "class", "class_declaration": "class", "interface_declaration": "interface", "struct_item": "class", "enum_item": "class", "enum_declaration": "class", "trait_item": "interface", "type_declaration": "type"}
_KEYWORDS = frozenset("if for while switch catch return function new typeof await match loop super in of do else try let const var yield throw assert print fn impl use pub sizeof".split())
_CALL = re.compile(r"(?<![\w.$:])(?:(?P<new>new)\s+)?(?:(?P<base>[A-Za-z_$][\w$]*(?:::[A-Za-z_]\w*)*)(?:\.|::))?(?P<name>[A-Za-z_$][\w$]*)\s*(?:<[\w, ]+>)?\(")


_IMPL = re.compile(r"^\s*(?:unsafe\s+)?impl(?:<[^{]*?>)?\s+(?P<trait>[\w:]+)(?:<[^{]*?>)?\s+for\s+&?(?P<type>[\w:]+)", re.M)
_IMPLEMENTS = re.compile(r"\bclass\s+(?P<type>\w+)[^{]*?\bimplements\s+(?P<names>[^{]+)\{")
_GO_FIELD = re.compile(r"^\s+(?P<names>[A-Za-z_]\w*(?:\s*,\s*[A-Za-z_]\w*)*)\s+[^\s/`(].*$")
_GO_EMBED = re.compile(r"^\s+\*?(?P<name>(?:\w+\.)?[A-Za-z_]\w*)\s*(?:`[^`]*`)?\s*(?://.*)?$")
_YAML_REFERENCE = r"^\s*-?\s*(?:import|vars\.load|use)\s*:\s*(.+?)\s*$"
_YAML_EXTENSIONS = ("yaml", "yml")


def package_of(path: str, text: str) -> str:
    """The package path of a file by the rule of its language."""
    stem, _, ext = path.rpartition(".")
    if ext in _YAML_EXTENSIONS:
        return "yaml"
    if ext == "py":
        dotted = stem.replace("/", ".")
        return dotted.removesuffix(".__init__") if dotted != "__init__" else ""
    if ext == "rs":
        bare = re.sub(r"^src/", "", stem)
        return re.sub(r"(?:^|/)(?:mod|lib|main)$", "", bare).replace("/", "::")
    if ext == "java":
        declared = re.search(r"^\s*package\s+([\w.]+)\s*;", text, re.M)
        return declared[1] if declared else path.rpartition("/")[0].replace("/", ".")
    if ext == "go":
        return path.rpartition("/")[0]
    return stem  # TypeScript and JavaScript: the path without its extension


def _record(rec: str, path: str, package: str, **more: object) -> dict:
    return dict.fromkeys(_FIELDS) | {"rec": rec, "path": path, "package": package} | more


def _python_file(path: str, package: str, text: str) -> list[dict]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out: list[dict] = []
    folder = package.split(".") if path.endswith("__init__.py") else package.split(".")[:-1]

    def calls(node: ast.AST, qualified: str, owner: str) -> None:
        for sub in ast.walk(node):
            if isinstance(sub, ast.Call):
                f = sub.func
                if isinstance(f, ast.Name):
                    lane, base, name = "bare", "", f.id
                elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                    lane, base, name = ("self" if f.value.id in ("self", "cls") else "attr"), f.value.id, f.attr
                else:
                    continue
                out.append(_record("call", path, package, qualified=qualified, owner=owner, lane=lane, base=base, name=name, start_line=sub.lineno, end_line=sub.lineno))

    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append(_record("symbol", path, package, kind="function", name=node.name, qualified=node.name, owner="", start_line=node.lineno, end_line=node.end_lineno))
            calls(node, node.name, "")
        elif isinstance(node, ast.ClassDef):
            out.append(_record("symbol", path, package, kind="class", name=node.name, qualified=node.name, owner="", start_line=node.lineno, end_line=node.end_lineno))
            for m in node.body:
                if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    q = f"{node.name}.{m.name}"
                    out.append(_record("symbol", path, package, kind="method", name=m.name, qualified=q, owner=node.name, start_line=m.lineno, end_line=m.end_lineno))
                    calls(m, q, node.name)
        elif isinstance(node, ast.Import):
            for a in node.names:
                out.append(_record("import", path, package, name=a.asname or a.name, target=a.name, symbol="", start_line=node.lineno, end_line=node.lineno))
        elif isinstance(node, ast.ImportFrom):
            up = folder[: len(folder) - node.level + 1] if node.level else []
            target = ".".join([*up, *([node.module] if node.module else [])])
            for a in node.names:
                out.append(_record("import", path, package, name=a.asname or a.name, target=target, symbol=a.name, start_line=node.lineno, end_line=node.lineno))
    return out


def _imports(path: str, package: str, ext: str, text: str) -> Iterator[dict]:
    folder = path.rpartition("/")[0]

    def row(name: str, target: str, symbol: str, at: int) -> dict:
        line = text.count("\n", 0, at) + 1
        return _record("import", path, package, name=name, target=target, symbol=symbol, start_line=line, end_line=line)

    if ext in ("ts", "tsx", "js", "jsx", "mjs"):
        def module(spec: str) -> str:
            if not spec.startswith("."):
                return spec
            parts = [p for p in folder.split("/") if p]
            for p in spec.split("/"):
                parts = parts[:-1] if p == ".." else parts if p in (".", "") else [*parts, p]
            return re.sub(r"\.(?:tsx?|jsx?|mjs)$", "", "/".join(parts))

        for m in re.finditer(r"import\s+(?:type\s+)?(?:(\w+)\s*,?\s*)?(?:\*\s+as\s+(\w+)|\{([^}]*)\})?\s*from\s*['\"]([^'\"]+)['\"]", text):
            target = module(m[4])
            if m[1]:
                yield row(m[1], target, "default", m.start())
            if m[2]:
                yield row(m[2], target, "", m.start())
            for item in filter(None, (x.strip() for x in (m[3] or "").split(","))):
                name, _, alias = item.partition(" as ")
                yield row((alias or name).strip(), target, name.strip(), m.start())
        for m in re.finditer(r"(?:const|let|var)\s+(?:(\w+)|\{([^}]*)\})\s*=\s*require\(['\"]([^'\"]+)['\"]\)", text):
            for item in [m[1]] if m[1] else filter(None, (x.strip() for x in m[2].split(","))):
                yield row(item, module(m[3]), "" if m[1] else item, m.start())
    elif ext == "rs":
        for m in re.finditer(r"^\s*(?:pub\s+)?use\s+([\w:]+)(?:::\{([^}]*)\})?(?:\s+as\s+(\w+))?\s*;", text, re.M):
            base = re.sub(r"^(?:crate|self)::", "", m[1])
            for item in [x.strip() for x in m[2].split(",")] if m[2] else [""]:
                full = f"{base}::{item}" if item else base
                target, _, symbol = full.rpartition("::")
                yield row(m[3] or symbol, target, symbol, m.start())
    elif ext == "java":
        for m in re.finditer(r"^\s*import\s+(static\s+)?([\w.]+)(\.\*)?\s*;", text, re.M):
            target, _, symbol = m[2].rpartition(".")
            if m[1]:  # a static member: its class belongs to the symbol
                target, _, owner = target.rpartition(".")
                symbol = f"{owner}.{symbol}"
            yield row(symbol.rpartition(".")[2], target, symbol, m.start())
    elif ext == "go":
        for m in re.finditer(r"^\s*(?:import\s+)?(?:(\w+|_|\.)\s+)?\"([\w./-]+)\"\s*$", text, re.M):
            yield row(m[1] or m[2].rpartition("/")[2], m[2], "", m.start())


def _bracketed_file(path: str, package: str, ext: str, text: str) -> list[dict]:
    out = list(_imports(path, package, ext, text))
    lines = text.replace("\r\n", "\n").split("\n")
    for c in chunk_file(path, text):
        if c.kind in ("window", "orphan") or c.kind.endswith(":window") or not c.name:
            continue
        if c.kind == "impl_item":
            continue
        kind = "method" if c.parent else _KINDS.get(c.kind, "function")
        qualified = f"{c.parent}.{c.name}" if c.parent else c.name
        out.append(_record("symbol", path, package, kind=kind, name=c.name, qualified=qualified, owner=c.parent, start_line=c.start, end_line=c.end))
        if kind in ("function", "method"):
            for no, line in enumerate(lines[c.start - 1 : c.end], c.start):
                for m in _CALL.finditer(re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|//.*$", "", line)):
                    base, name = m["base"] or "", m["name"]
                    if name in _KEYWORDS or (name == c.name and not base and re.search(r"\b(?:func|function|fn)\b|^\s*(?:public|private|protected|static|async)\b", line)):
                        continue
                    lane = "new" if m["new"] else "self" if base in ("this", "self", "Self") else "attr" if base else "bare"
                    out.append(_record("call", path, package, qualified=qualified, owner=c.parent, lane=lane, base=base, name=name, start_line=no, end_line=no))
    return out


def _relations(path: str, package: str, ext: str, text: str) -> Iterator[dict]:
    """What types declare about each other: implemented interfaces, and for Go embedded types and fields."""
    at = lambda pos: text.count("\n", 0, pos) + 1
    row = lambda kind, owner, name, line: _record("relation", path, package, kind=kind, owner=owner, name=name, start_line=line, end_line=line)
    if ext == "rs":
        for m in _IMPL.finditer(text):
            yield row("implements", m["type"].rsplit("::", 1)[-1], m["trait"].rsplit("::", 1)[-1], at(m.start()))
    elif ext in ("java", "ts", "tsx"):
        for m in _IMPLEMENTS.finditer(text):
            for name in re.sub(r"<[^<>]*>", "", m["names"]).split(","):
                yield row("implements", m["type"], name.strip().rsplit(".", 1)[-1], at(m.start()))
    elif ext == "go":
        for m in re.finditer(r"^type\s+(?P<name>\w+)\s+(?P<kind>struct|interface)\s*\{[ \t]*\n(?P<body>.*?)^\}", text, re.M | re.S):
            first = at(m.start("body"))
            depth = 0
            for no, line in enumerate(m["body"].split("\n"), first):
                if depth == 0:
                    embedded = _GO_EMBED.match(line)
                    if embedded:
                        yield row("embeds", m["name"], embedded["name"].rsplit(".", 1)[-1], no)
                    elif m["kind"] == "struct" and (field := _GO_FIELD.match(line)):
                        for name in re.split(r"\s*,\s*", field["names"]):
                            yield _record("symbol", path, package, kind="field", name=name, qualified=f"{m['name']}.{name}", owner=m["name"], start_line=no, end_line=no)
                depth += line.count("{") - line.count("}")


def _yaml_file(path: str, text: str) -> Iterator[dict]:
    for no, line in enumerate(text.split("\n"), 1):
        m = re.match(_YAML_REFERENCE, line)
        if m:
            value = re.sub(r" #.*$", "", m[1]).strip()
            if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
                value = value[1:-1]
            if value and "{{" not in value and not value.startswith("/"):
                yield _record("reference", path, "yaml", target=value, start_line=no, end_line=no)


def extract_file(path: str, text: str | None) -> list[dict]:
    """Flat records of a file; none for null texts, unknown extensions and files that cannot be parsed."""
    ext = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if not text or ext not in EXTRACTORS:
        return []
    package = package_of(path, text)
    found = EXTRACTORS[ext](path, package, ext, text)
    return [_record("file", path, package, start_line=1, end_line=text.count("\n") + 1), *found]


#: What reads a file of an extension; another language is added by a function (path, package, extension, text) -> records.
EXTRACTORS: dict[str, Callable[[str, str, str, str], list[dict]]] = {
    "py": lambda path, package, ext, text: _python_file(path, package, text),
    **dict.fromkeys(("ts", "tsx", "js", "jsx", "mjs", "rs", "java", "go"), lambda path, package, ext, text: [*_bracketed_file(path, package, ext, text), *_relations(path, package, ext, text)]),
    **dict.fromkeys(_YAML_EXTENSIONS, lambda path, package, ext, text: list(_yaml_file(path, text))),
}


def extract_records(files: DataFrame) -> DataFrame:
    """The records of all files (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(f, pa.int32() if f.endswith("_line") else pa.string()) for f in _FIELDS])
        for batch in batches:
            rows = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for r in extract_file(p or "", t)]
            yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def node_id(module: str, package: Column, kind: Column, qualified: Column) -> Column:
    return F.concat_ws("::", F.lit(module), package, kind, qualified)


def edge_id(src: Column, kind: Column, dst: Column, path: Column, line: Column) -> Column:
    return F.sha1(F.concat_ws("\x00", src, kind, dst, path, line.cast("string")))


def build_graph(records: DataFrame, module: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the records of one module (project): each id once.

    Read ``records`` from a table rather than from the parser, since several joins use them.
    """
    c = F.col
    files = records.where("rec = 'file'").select("path", "package", "start_line", "end_line")
    symbols = records.where("rec = 'symbol'").withColumn("id", node_id(module, c("package"), c("kind"), c("qualified")))
    callable_ = symbols.where("kind <> 'field'")
    imports = records.where("rec = 'import'").withColumn("id", node_id(module, c("package"), F.lit("import"), c("target")))
    file_id, package_id = node_id(module, c("package"), F.lit("file"), c("path")), node_id(module, c("package"), F.lit("package"), c("package"))
    shape = lambda d, i, k, n, q, p, f, a, b: d.select(i.alias("id"), k.alias("kind"), n.alias("name"), q.alias("qualified_name"), p.alias("package_path"), f.alias("file_path"), a.alias("start_line"), b.alias("end_line"))
    zero = F.lit(0)
    nodes = (
        shape(symbols, c("id"), c("kind"), c("name"), c("qualified"), c("package"), c("path"), c("start_line"), c("end_line"))
        .unionByName(shape(files, file_id, F.lit("file"), F.substring_index("path", "/", -1), c("path"), c("package"), c("path"), c("start_line"), c("end_line")))
        .unionByName(shape(files, package_id, F.lit("package"), F.substring_index("package", "/", -1), c("package"), c("package"), F.lit(""), zero, zero))
        .unionByName(shape(imports, c("id"), F.lit("import"), c("target"), c("target"), c("package"), F.lit(""), zero, zero))
        .groupBy("id")
        .agg(F.min(F.struct("start_line", "kind", "name", "qualified_name", "package_path", "file_path", "end_line")).alias("r"))
        .select("id", *[f"r.{f}" for f in ("kind", "name", "qualified_name", "package_path", "file_path", "start_line", "end_line")])
    )
    edge = lambda d, k, s, t, a: d.select(F.lit(k).alias("kind"), s.alias("src_id"), t.alias("dst_id"), c("path").alias("file_path"), a.alias("start_line"))
    owner = symbols.where("owner <> ''").join(symbols.where("kind in ('class', 'interface', 'type')").select("package", c("qualified").alias("owner"), c("id").alias("owner_id")), ["package", "owner"])
    edges = (
        edge(files, "contains", package_id, file_id, zero)
        .unionByName(edge(callable_, "contains", file_id, c("id"), c("start_line")))
        .unionByName(edge(imports, "imports", file_id, c("id"), c("start_line")))
        .unionByName(edge(imports, "imports", package_id, c("id"), c("start_line")))
        .unionByName(edge(owner.where("kind <> 'field'"), "has_method", c("owner_id"), c("id"), c("start_line")))
        .unionByName(edge(owner.where("kind = 'field'"), "has_field", c("owner_id"), c("id"), c("start_line")))
        .unionByName(_relation_edges(records, symbols))
        .unionByName(_yaml_edges(records, module))
        .unionByName(_call_edges(records, callable_, module, edge))
        .distinct()
    )
    edges = with_provenance(edges.withColumn("id", edge_id(c("src_id"), c("kind"), c("dst_id"), c("file_path"), c("start_line"))))
    return nodes, edges.dropDuplicates(["id"])


def with_provenance(edges: DataFrame) -> DataFrame:
    """Edges with ``metadata_json``: where they come from and the language of their file, unless their metadata say so already."""
    language = F.lower(F.regexp_extract("file_path", r"\.(\w+)$", 1))
    own = F.coalesce(F.from_json("metadata_json", "map<string,string>"), F.create_map().cast("map<string,string>")) if "metadata_json" in edges.columns else F.create_map().cast("map<string,string>")
    defaults = F.map_filter(F.create_map(F.lit("provenance"), F.lit("parser"), F.lit("language"), language), lambda k, v: ~F.map_contains_key(own, k))
    return edges.withColumn("metadata_json", F.to_json(F.map_concat(defaults, own)))


def _relation_edges(records: DataFrame, symbols: DataFrame) -> DataFrame:
    """``implements`` and ``embeds`` edges between types of one package, or to an imported type."""
    c = F.col
    types = symbols.where("kind in ('class', 'interface', 'type')").select("package", c("qualified").alias("type"), "id").dropDuplicates(["package", "type"])
    said = records.where("rec = 'relation'").select("path", "package", "kind", "owner", "name", "start_line")
    known = records.where("rec = 'import'").select("path", c("name").alias("name"), "target", "symbol").dropDuplicates(["path", "name"])
    source = types.select("package", c("type").alias("owner"), c("id").alias("src_id"))
    placed = said.join(source, ["package", "owner"]).join(known, ["path", "name"], "left")
    own = types.select("package", c("type").alias("name"), c("id").alias("own_id"))
    far = types.select(c("package").alias("target"), c("type").alias("symbol"), c("id").alias("far_id"))
    joined = placed.join(own, ["package", "name"], "left").join(far, ["target", "symbol"], "left").withColumn("dst_id", F.coalesce("own_id", "far_id"))
    return joined.where("dst_id is not null and dst_id <> src_id").select("kind", "src_id", "dst_id", c("path").alias("file_path"), "start_line")


def _yaml_edges(records: DataFrame, module: str) -> DataFrame:
    """``imports`` edges between YAML files that exist."""
    from fathomline.functions import paths

    c = F.col
    at = lambda p: node_id(module, F.lit("yaml"), F.lit("file"), p)
    said = records.where("rec = 'reference'").select("path", paths.joined(paths.dirname(c("path")), c("target")).alias("to"), "start_line").where("not startswith(to, '..')")
    there = records.where("rec = 'file' and package = 'yaml'").select(c("path").alias("to")).distinct()
    return said.join(there, "to", "left_semi").select(F.lit("imports").alias("kind"), at(c("path")).alias("src_id"), at(c("to")).alias("dst_id"), c("path").alias("file_path"), "start_line")


def _call_edges(records: DataFrame, symbols: DataFrame, module: str, edge) -> DataFrame:
    c = F.col
    calls = records.where("rec = 'call'").withColumn("no", F.xxhash64("path", "qualified", "lane", "base", "name", "start_line"))
    table = symbols.select(c("package").alias("t_package"), c("qualified").alias("t_name"), "id").dropDuplicates(["t_package", "t_name"])
    known = records.where("rec = 'import'").select("path", c("name").alias("alias"), "target", "symbol").dropDuplicates(["path", "alias"])

    # up to three places where the callee may be, in order of preference: (package, qualified name)
    named = calls.join(known.select("path", c("alias").alias("name"), c("target").alias("n_target"), c("symbol").alias("n_symbol")), ["path", "name"], "left")
    named = named.join(known.select("path", c("alias").alias("base"), c("target").alias("b_target"), c("symbol").alias("b_symbol")), ["path", "base"], "left")
    at = lambda package, name: F.struct(package.alias("p"), name.alias("q"))
    dotted = F.concat_ws(".", "base", "name")
    inside = F.concat_ws(".", F.when(c("b_symbol").isin("", "default"), None).otherwise(c("b_symbol")), c("name"))
    places = (
        F.when(c("lane") == "self", F.array(at(c("package"), F.concat_ws(".", "owner", "name"))))
        .when(c("lane").isin("bare", "new"), F.array(at(c("package"), c("name")), at(c("package"), F.concat_ws(".", "owner", "name")), at(c("n_target"), c("n_symbol"))))
        .otherwise(F.array(at(c("package"), dotted), at(c("b_target"), inside), at(F.concat_ws("::", "b_target", "b_symbol"), c("name")), at(F.concat_ws(".", "b_target", "b_symbol"), c("name"))))
    )
    tried = named.select("no", "path", "package", "qualified", "start_line", F.posexplode(places).alias("pref", "at")).select("no", "path", "package", "qualified", "start_line", "pref", c("at.p").alias("t_package"), c("at.q").alias("t_name"))
    hit = tried.join(table, ["t_package", "t_name"]).groupBy("no", "path", "package", "qualified", "start_line").agg(F.min(F.struct("pref", "id")).alias("b"))
    caller = symbols.where("kind in ('function', 'method')").select("package", "qualified", c("id").alias("caller")).dropDuplicates(["package", "qualified"])
    return edge(hit.join(caller, ["package", "qualified"]), "calls", c("caller"), c("b.id"), c("start_line"))




def yaml_references(files: DataFrame) -> DataFrame:
    """``path, target, line`` of the references between YAML files (path, content) that exist.

    A reference is a line with one of three keys; comments and quotes are stripped, templated values, absolute paths and
    those that lead out of the project are none.  Targets are relative to the folder of the file.  Each (path, target,
    line) once; null contents have none.
    """
    from fathomline.functions import paths

    yaml = files.where(F.lower("path").rlike(r"\.ya?ml$"))
    lines = yaml.select("path", F.posexplode(F.split("content", "\n", -1)).alias("n", "line")).where(F.col("line").rlike(_YAML_REFERENCE))
    raw = F.trim(F.regexp_replace(F.regexp_extract("line", _YAML_REFERENCE, 1), r" #.*$", ""))
    value = F.regexp_replace(raw, r"^(?:\"(.*)\"|'(.*)')$", "$1$2")
    found = lines.select("path", value.alias("value"), (F.col("n") + 1).cast("int").alias("line")).where("value <> '' and not startswith(value, '/') and not contains(value, '{{')")
    resolved = found.select("path", paths.joined(paths.dirname(F.col("path")), F.col("value")).alias("target"), "line").where("not startswith(target, '..')").distinct()
    return resolved.join(yaml.select(F.col("path").alias("target")).distinct(), "target", "left_semi").select("path", "target", "line")
