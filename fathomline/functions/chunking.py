"""Structural chunks: declarations, their nested methods, comments before them, and windows over what is left.

Python is parsed with its own grammar.  For other languages a declaration begins at a line that matches the language's
heads at a nesting depth of zero (or one inside containers) and ends where its brackets close.  Files that cannot be
parsed, or are of another kind, are cut into line windows.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from fathomline.functions.text import MOST_BYTES, WINDOW_LINES, WINDOW_OVERLAP, halve_oversized

MOST_COMMENT_LINES = 50
SCHEMA = "path string, kind string, name string, parent string, start_line int, end_line int, content string"


class Chunk(NamedTuple):
    kind: str
    name: str
    parent: str
    start: int  # lines from 1, both ends included
    end: int
    content: str


_WORD = r"(?P<name>[A-Za-z_$][\w$]*)"
# Heads of declarations by language, with the kind of chunk that they begin and whether it has members.
HEADS: dict[str, list[tuple[str, str, bool]]] = {
    "go": [(r"func\s+\((?P<recv>[^)]*)\)\s*" + _WORD, "method_declaration", False), (r"func\s+" + _WORD, "function_declaration", False), (r"type\s+" + _WORD, "type_declaration", False)],
    "js": [
        (r"(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*" + _WORD, "function_declaration", False),
        (r"(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+" + _WORD, "class_declaration", True),
        (r"(?:export\s+)?interface\s+" + _WORD, "interface_declaration", False),
        (r"(?:export\s+)?(?:type|enum)\s+" + _WORD, "type_declaration", False),
        (r"(?:export\s+)?(?:const|let|var)\s+" + _WORD + r"\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*(?::[^=]+)?=>", "lexical_declaration", False),
    ],
    "rs": [
        (r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+" + _WORD, "function_item", False),
        (r"(?:pub(?:\([^)]*\))?\s+)?struct\s+" + _WORD, "struct_item", False),
        (r"(?:pub(?:\([^)]*\))?\s+)?enum\s+" + _WORD, "enum_item", False),
        (r"(?:pub(?:\([^)]*\))?\s+)?trait\s+" + _WORD, "trait_item", True),
        (r"impl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?" + _WORD, "impl_item", True),
    ],
    "java": [
        (r"(?:(?:public|protected|private|static|final|abstract|sealed)\s+)*class\s+" + _WORD, "class_declaration", True),
        (r"(?:(?:public|protected|private|static)\s+)*interface\s+" + _WORD, "interface_declaration", True),
        (r"(?:(?:public|protected|private|static)\s+)*(?:enum|record)\s+" + _WORD, "enum_declaration", True),
    ],
    "c": [
        (r"(?:typedef\s+)?struct\s+" + _WORD + r"\s*(?:\{|$)", "struct_specifier", False),
        (r"(?!\s*(?:if|for|while|switch|return|else|do|typedef|struct)\b)[A-Za-z_][\w\s*]*?[\s*]" + _WORD + r"\s*\([^;]*\)\s*\{?\s*$", "function_definition", False),
    ],
    "cpp": [
        (r"(?:template\s*<[^>]*>\s*)?class\s+" + _WORD + r"[^;]*$", "class_specifier", True),
        (r"(?:template\s*<[^>]*>\s*)?struct\s+" + _WORD + r"[^;]*$", "struct_specifier", True),
        (r"namespace\s+" + _WORD + r"[^;]*$", "namespace_definition", False),
        (r"(?!\s*(?:if|for|while|switch|return|else|do|using|class|struct)\b)[A-Za-z_~][\w\s*&:<>,~]*?[\s*&:]?(?P<name>[A-Za-z_~][\w~]*)\s*\([^;]*\)\s*(?:const|noexcept|override|\s)*(?::[^{;]*)?\{?\s*$", "function_definition", False),
    ],
    "sh": [(r"(?:function\s+)?(?P<name>[A-Za-z_][\w-]*)\s*\(\)\s*\{?", "function_definition", False), (r"function\s+(?P<name>[A-Za-z_][\w-]*)\s*\{?", "function_definition", False)],
}
#: languages whose blocks end with a keyword: heads with their kinds, and kinds of members inside containers
_KEYWORD_HEADS: dict[str, list[tuple[str, str, str, bool]]] = {
    "rb": [(r"class\s+(?P<name>[A-Z]\w*)", "class", "", False), (r"module\s+(?P<name>[A-Z]\w*)", "module", "", True), (r"def\s+self\.(?P<name>\w+[?!=]?)", "singleton_method", "singleton_method", False), (r"def\s+(?P<name>\w+[?!=]?)", "method", "method", False)],
    "lua": [(r"local\s+function\s+(?P<name>\w+)", "local_function_declaration_statement", "", False), (r"function\s+(?P<name>[\w.:]+)", "function_declaration_statement", "", False)],
}
_MEMBERS = {
    "cpp": (re.compile(r"(?:(?:virtual|static|inline|explicit|constexpr)\s+)*(?:[\w:<>,*&]+\s+)*[*&]?(?P<name>[A-Za-z_~][\w~]*)\s*\([^;]*\)\s*(?:const|noexcept|override|\s)*\{"), "function_definition"),
    "js": (re.compile(r"(?:(?:public|private|protected|static|async|get|set|readonly)\s+)*\*?" + _WORD + r"\s*\([^;]*\)\s*(?::[^{]+)?\{"), "method_definition"),
    "rs": (re.compile(r"(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|const\s+|unsafe\s+)*fn\s+" + _WORD), "function_item"),
    "java": (re.compile(r"(?:@\w+\s+)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)\s+)*(?:<[^>]+>\s+)?[\w<>\[\], .?]+\s+" + _WORD + r"\s*\([^;]*\)\s*(?:throws [\w., ]+)?\{"), "method_declaration"),
}
_LANGUAGE = {"c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "sh": "sh", "bash": "sh", "zsh": "sh", "go": "go", "js": "js", "jsx": "js", "ts": "js", "tsx": "js", "mjs": "js", "rs": "rs", "java": "java"}
_COMMENT_LINE = re.compile(r"^\s*(?://|#|/?\*|\"\"\"|--|@\w)")


def windows(lines: list[str], first: int = 1, kind: str = "window") -> list[Chunk]:
    """Windows of 40 lines with an overlap of 10; blank ones are left out."""
    out, at = [], 0
    while lines:
        part = lines[at : at + WINDOW_LINES]
        if "".join(part).strip():
            out.append(Chunk(kind, "", "", first + at, first + at + len(part) - 1, "\n".join(part)))
        if at + WINDOW_LINES >= len(lines):
            break
        at += WINDOW_LINES - WINDOW_OVERLAP
    return out


def _blank_strings(line: str) -> str:
    return re.sub(r"//.*$|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|'(?:\\.|[^'\\])*'|`[^`]*`", "", line)


def _braced(lines: list[str], language: str) -> list[Chunk] | None:
    """Declarations by bracket depth; None where brackets do not close."""
    heads = [(re.compile(r"^\s*" + p), kind, members) for p, kind, members in HEADS[language]]
    found: list[Chunk] = []
    depth, open_, container = 0, None, None
    for no, raw in enumerate(lines):
        line = _blank_strings(raw)
        at_depth = depth
        if open_ is None and at_depth == 0:
            for pattern, kind, members in heads:
                m = pattern.match(raw)
                if m:
                    parent = re.sub(r"[*\s]|^\w+\s+", "", m.groupdict().get("recv") or "") if "recv" in m.groupdict() else ""
                    open_ = (no, kind, m["name"], parent, 0)
                    container = m["name"] if members else None
                    break
        elif open_ is not None and container and at_depth == 1 and open_[4] == 0 and language in _MEMBERS:
            m = _MEMBERS[language][0].match(raw.strip())
            if m and m["name"] not in ("if", "for", "while", "switch", "catch", "return"):
                end = _close(lines, no)
                if end is not None:
                    body = "\n".join(lines[no : end + 1]).encode()[:MOST_BYTES].decode("utf-8", "ignore")
                    found.append(Chunk(_MEMBERS[language][1], m["name"], container, no + 1, end + 1, body))
        depth += line.count("{") - line.count("}")
        if depth < 0:
            return None
        if open_ is not None and depth == 0 and ("{" in line or "}" in line or ";" in line or (language == "go" and open_[1] == "type_declaration" and "{" not in line)):
            found.append(Chunk(open_[1], open_[2], open_[3], open_[0] + 1, no + 1, "\n".join(lines[open_[0] : no + 1])))
            open_, container = None, None
    return found if depth == 0 else None


def _close(lines: list[str], first: int) -> int | None:
    depth = 0
    for no in range(first, len(lines)):
        line = _blank_strings(lines[no])
        depth += line.count("{") - line.count("}")
        if depth == 0 and "}" in line:
            return no
    return None


def _keyworded(lines: list[str], language: str) -> list[Chunk] | None:
    """Declarations that end at the ``end`` in the column of their head; None where one is missing."""
    heads = [(re.compile(r"^(\s*)" + p), kind, member, container) for p, kind, member, container in _KEYWORD_HEADS[language]]

    def scan(first: int, last: int, indent: int | None, parent: str) -> list[Chunk] | None:
        found: list[Chunk] = []
        no = first
        while no < last:
            hit = next(((m, k, mem, c) for h, k, mem, c in heads if (m := h.match(lines[no]))), None)
            if hit and (indent is None and not hit[0][1] or indent is not None and hit[2] and len(hit[0][1]) > indent):
                m, kind, member, container = hit
                close = next((i for i in range(no, last) if re.match(rf"^{m[1]}end\b", lines[i]) or (i == no and re.search(r"\bend\s*$", lines[i]))), None)
                if close is None:
                    return None
                body = "\n".join(lines[no : close + 1])
                found.append(Chunk(member if parent else kind, m["name"], parent, no + 1, close + 1, body.encode()[:MOST_BYTES].decode("utf-8", "ignore") if parent else body))
                if container:
                    found += scan(no + 1, close, len(m[1]), m["name"]) or []
                no = close
            no += 1
        return found

    return scan(0, len(lines), None, "")


def _python(text: str, lines: list[str]) -> list[Chunk] | None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return None
    found = []

    def add(node: ast.AST, parent: str, depth: int) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            found.append(Chunk(kind, node.name, parent, first, node.end_lineno, "\n".join(lines[first - 1 : node.end_lineno])))
            if isinstance(node, ast.ClassDef) and depth < 2:
                for member in node.body:
                    add(member, node.name, depth + 1)

    for node in tree.body:
        add(node, "", 0)
    return found


def chunk_file(path: str, text: str | None) -> list[Chunk]:
    """The chunks of a file.  Every line that is not blank is in at least one; null and blank texts have none."""
    if not text or not text.strip():
        return []
    lines = text.replace("\r\n", "\n").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    extension = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if extension == "py":
        made = _python("\n".join(lines), lines)
    elif extension in _KEYWORD_HEADS:
        made = _keyworded(lines, extension)
    else:
        made = _braced(lines, _LANGUAGE[extension]) if extension in _LANGUAGE else None
    if not made:
        made = windows(lines)
    else:
        grown = []
        for c in made:  # comments directly before a declaration belong to it
            first = c.start
            while first > 1 and c.start - first < MOST_COMMENT_LINES and _COMMENT_LINE.match(lines[first - 2]):
                first -= 1
            grown.append(c._replace(start=first, content="\n".join(lines[first - 1 : c.start - 1] + [c.content])) if first < c.start and not c.parent else c)
        covered = sorted((c.start, c.end) for c in grown)
        reach, orphans = 0, []
        for a, b in [*covered, (len(lines) + 1, len(lines) + 1)]:
            if a > reach + 1:
                orphans += windows(lines[reach : a - 1], reach + 1, "orphan")
            reach = max(reach, b)
        made = sorted(grown + orphans, key=lambda c: (c.start, -c.end))
    out = []
    for c in made:
        if len(c.content.encode("utf-8", "surrogatepass")) <= MOST_BYTES:
            out.append(c)
        else:
            kind = c.kind if c.kind in ("window", "orphan") else f"{c.kind}:window"
            out += [Chunk(kind, c.name, c.parent, c.start + a, c.start + b, t) for a, b, t in halve_oversized(c.content)]
    return out


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks of all files (path, content): one pass over Arrow batches, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *c) for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for c in chunk_file(p or "", t)]
            kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string()]
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "kind", "name", "parent", "start_line", "end_line", "content"])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def import_block(path: str, text: str, most_lines: int = 200) -> str:
    """The first contiguous run of import lines of a file, by language; empty where there is none."""
    extension = path.rsplit(".", 1)[-1].lower()
    heads = {"go": r"import\b|\"|\)|\w+ \"|_ \"", "py": r"(?:import|from)\b", "rs": r"(?:pub )?use\b", "java": r"import\b"}
    pattern = re.compile(r"^\s*(?:" + heads.get(extension, r"import\b|export .* from\b|const .*require\(") + ")")
    block: list[str] = []
    inside = False
    for line in text.split("\n")[:most_lines]:
        if pattern.match(line) and (block or not line.startswith((" ", "\t"))) or inside:
            block.append(line)
            inside = (inside or "(" in line or ("{" in line and "}" not in line)) and ")" not in line and "}" not in line
        elif block and line.strip():
            break
    return "\n".join(block).rstrip()
