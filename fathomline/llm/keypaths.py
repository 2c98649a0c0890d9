"""Configuration text as values with their key paths and offsets.

One pass over the text per format: JSON by its brackets, YAML by its indentation, and formats of sections, blocks and
assignments (INI, TOML, properties, environment files, resource definitions) by lines.  Chunks are often pieces of files,
so nothing needs to be complete: brackets that close nothing are skipped, and what cannot be read gives no value.
Offsets count characters of the given text; values are the raw characters between them.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Entry(NamedTuple):
    path: tuple[str, ...]  # keys from the outermost; items of lists are called []
    start: int
    end: int
    value: str


ITEM = "[]"
_NAMES, _VALUES = ("name", "key"), ("value", "val")

_JSON_TOKEN = re.compile(r'"(?:[^"\\\n]|\\.)*+"|[{}\[\],:\n]|//[^\n]*+|[^\s"{}\[\],:]++')
_YAML_LINE = re.compile(r"""(?P<lead>[ \t]*(?:-[ \t]+)*)(?:(?P<key>"[^"\n]*"|'[^'\n]*'|[A-Za-z_][\w.\-/]*+(?: [\w.\-/]++)*)[ \t]*:(?:[ \t]+|$))?(?P<val>.*)""")
_YAML_VALUE = re.compile(r"""(?:[&!][^\s]*[ \t]+)*(?:"(?P<d>(?:[^"\\]|\\.)*)"|'(?P<s>(?:[^']|'')*)'|(?P<plain>[^\s#{\[|>&*!%@`"'](?:[^#\n]|(?<!\s)#)*))""")
_YAML_FLOW = re.compile(r"""(?<![\w.\-])(?P<k>[A-Za-z_][\w.\-]*+)"?\s*:\s*(?:"(?P<d>[^"\n]*)"|'(?P<s>[^'\n]*)'|(?P<plain>[^\s,{}\[\]"']+))""")
_SECTION = re.compile(r"\s*\[{1,2}(?P<key>[^\[\]\n]+)\]{1,2}\s*(?:[#;].*)?$")
_BLOCK = re.compile(r"""\s*(?P<head>[A-Za-z_][\w\-]*+(?:\s+(?:"[^"\n]*"|[\w\-]++))*)\s*(?:=\s*)?\{\s*$""")
_ASSIGNED = re.compile(r"""\s*(?:export\s+|set\s+|setx\s+|ENV\s+|ARG\s+)?(?P<key>"[^"\n]+"|[A-Za-z_][\w.\-/]*+)\s*[=:]\s*(?:"(?P<d>(?:[^"\\]|\\.)*)"|'(?P<s>[^']*)'|(?P<plain>[^\s"'\[{].*))""")


def _bare(key: str) -> str:
    return key[1:-1] if len(key) > 1 and key[0] in "\"'" and key[-1] == key[0] else key


def picked(m: re.Match, base: int) -> tuple[int, int, str] | None:
    """Span and text of a value that is quoted, or plain up to a comment."""
    for group in ("d", "s"):
        if m[group] is not None:
            return base + m.start(group), base + m.end(group), m[group]
    plain = m["plain"]
    if plain is None:
        return None
    plain = re.sub(r"(?<!\s)\s++[#;].*$", "", plain).rstrip()
    at = base + m.start("plain")
    return (at, at + len(plain), plain) if plain else None


def _json(text: str, lines: list[str]) -> tuple[list[Entry], list[tuple[str, ...]]]:
    out: list[Entry] = []
    parents: list[tuple[str, ...]] = [()]
    path: list[str] = []
    #: per open bracket: whether it is an object, and the name and the value of a pair that it may hold
    open_: list[list] = []
    key, waiting, value_next = None, None, False

    def close() -> None:
        if not open_:
            return
        is_object, name, value = open_.pop()
        if is_object and name and value:
            out.append(Entry((*path, name), *value))
        if path:
            path.pop()

    for m in _JSON_TOKEN.finditer(text):
        token = m.group()
        first = token[0]
        if first == "\n":
            parents.append(tuple(path))
        elif first in "{[":
            path.append(key if value_next and key is not None else ITEM)
            open_.append([first == "{", None, None])
            key, waiting, value_next = None, None, False
        elif first in "}]":
            close()
            key, waiting, value_next = None, None, False
        elif first == ":":
            if waiting is not None:
                key, waiting, value_next = waiting, None, True
        elif first == ",":
            key, waiting, value_next = None, None, False
        elif first == '"':
            inner = token[1:-1]
            if value_next or (open_ and not open_[-1][0]):
                span = (m.start() + 1, m.end() - 1, inner)
                out.append(Entry((*path, key if value_next and key is not None else ITEM), *span))
                if open_ and open_[-1][0] and key is not None:
                    if key.lower() in _NAMES:
                        open_[-1][1] = inner
                    elif key.lower() in _VALUES:
                        open_[-1][2] = span
                key, value_next = None, False
            else:
                waiting = inner
        elif not first == "/":
            key, waiting, value_next = None, None, False
    while len(parents) < len(lines):
        parents.append(tuple(path))
    return out, parents


def _yaml(text: str, lines: list[str], starts: list[int]) -> tuple[list[Entry], list[tuple[str, ...]]]:
    out: list[Entry] = []
    parents: list[tuple[str, ...]] = []
    stack: list[tuple[int, str]] = []  # column and key of the open mappings and list items
    pairs: list[list] = []  # column, name and value of the name/value pairs that are open
    block: tuple[int, tuple[str, ...]] | None = None  # column and path of an open block scalar
    held: list[Entry] = []

    def flush() -> None:
        # a block of several lines is a text of its own
        if len(held) == 1:
            out.extend(held)
        held.clear()

    for no, raw in enumerate(lines):
        line = raw.rstrip("\r")
        if not line.strip() or line.lstrip().startswith("#"):
            parents.append(tuple(k for _, k in stack))
            continue
        column = len(line) - len(line.lstrip())
        if block is not None:
            if column > block[0]:
                held.append(Entry(block[1], starts[no] + column, starts[no] + len(line.rstrip()), line.strip()))
                parents.append(block[1][:-1])
                continue
            flush()
            block = None
        m = _YAML_LINE.match(line)
        lead = m["lead"]
        dashes = lead.count("-")
        at = len(lead)
        first = column
        while stack and stack[-1][0] >= (first if not dashes or stack[-1][1] == ITEM else first + 1):
            stack.pop()
        while pairs and pairs[-1][0] > at or pairs and dashes and pairs[-1][0] >= first:
            pairs.pop()
        if dashes:
            stack.append((first, ITEM))
        path = tuple(k for _, k in stack)
        parents.append(path)
        value = m["val"].strip()
        begin = starts[no] + m.start("val")
        if m["key"] is None:
            if dashes and (v := _YAML_VALUE.match(m["val"])) and (span := picked(v, begin)):
                out.append(Entry(path, *span))
            continue
        key = _bare(m["key"])
        if not value or value.startswith("#") or re.fullmatch(r"[&!]\S+(?:\s+#.*)?", value):
            stack.append((at, key))
        elif value[0] in "|>" and re.fullmatch(r"[|>][-+0-9]*(?:\s+#.*)?", value):
            block = (at, (*path, key))
        elif value[0] in "{[":
            for f in _YAML_FLOW.finditer(m["val"]):
                if span := picked(f, begin):
                    out.append(Entry((*path, key, f["k"]), *span))
        elif (v := _YAML_VALUE.match(m["val"])) and (span := picked(v, begin)):
            out.append(Entry((*path, key), *span))
            if key.lower() in (*_NAMES, *_VALUES):
                if not pairs or pairs[-1][0] != at:
                    pairs.append([at, None, None])
                pairs[-1][1 if key.lower() in _NAMES else 2] = span
                if pairs[-1][1] and pairs[-1][2]:
                    out.append(Entry((*path, pairs[-1][1][2]), *pairs[-1][2]))
    flush()
    return out, parents


def _assignments(text: str, lines: list[str], starts: list[int]) -> tuple[list[Entry], list[tuple[str, ...]]]:
    out: list[Entry] = []
    parents: list[tuple[str, ...]] = []
    section: tuple[str, ...] = ()
    blocks: list[tuple[str, ...]] = []
    for no, raw in enumerate(lines):
        line = raw.rstrip("\r")
        here = (*section, *(k for b in blocks for k in b))
        parents.append(here)
        bare = line.strip()
        if not bare or bare[0] in "#;" or bare.startswith("//"):
            continue
        if head := _SECTION.match(line):
            section, blocks = tuple(_bare(k.strip()) for k in re.split(r"[./]", head["key"])), []
            parents[-1] = ()
        elif head := _BLOCK.match(line):
            blocks.append(tuple(_bare(k) for k in re.findall(r'"[^"]*"|[\w\-]+', head["head"])))
        elif bare[0] == "}":
            if blocks:
                blocks.pop()
        elif (m := _ASSIGNED.match(line)) and (span := picked(m, starts[no])):
            out.append(Entry((*here, _bare(m["key"])), *span))
    return out, parents


def parse(text: str, lines: list[str], starts: list[int], extension: str) -> tuple[list[Entry], list[tuple[str, ...]]]:
    """The values of a text by the format of its extension, and for each line the keys that enclose it.

    ``lines`` are the parts of the text between line ends, ``starts`` their offsets.  Unknown formats are read as
    assignments.  Empty texts have no values.
    """
    kind = extension.lower()
    if kind == "json":
        return _json(text, lines)
    if kind in ("yaml", "yml"):
        return _yaml(text, lines, starts)
    return _assignments(text, lines, starts)
