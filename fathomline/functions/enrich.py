"""What is shown beside a hit: signature and documentation, owners, build conditions and the last commit of a file."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions.paths import rule_to_regex

_LOOK_AHEAD, _CONTINUATIONS, _DOC_BYTES, _TAG_LINES = 120, 12, 600, 20
_DOC_LINE = re.compile(r"^\s*(?:///?!?|#|/?\*+/?|--|;+)\s?(.*?)\s*(?:\*/)?$")


class Signature(NamedTuple):
    text: str
    doc: str
    line: int  # from 1


def signature_of(text: str, start_line: int, name: str) -> Signature | None:
    """The declaration of ``name`` at or after a line, with the comment before it (or the string after it in Python).

    The name must stand as a whole token; the declaration goes on until its brackets close, for at most 12 lines.  Nothing
    within 120 lines, or an empty text, gives None.
    """
    lines = text.replace("\r\n", "\n").split("\n")
    whole = re.compile(r"(?<![A-Za-z0-9_])" + re.escape(name) + r"(?![A-Za-z0-9_])")
    begin = max(start_line, 1) - 1
    for no in range(begin, min(begin + _LOOK_AHEAD, len(lines))):
        if _DOC_LINE.match(lines[no]) or not whole.search(lines[no]):
            continue
        parts, depth = [], 0
        for line in lines[no : no + _CONTINUATIONS]:
            parts.append(line.strip())
            depth += line.count("(") + line.count("[") - line.count(")") - line.count("]")
            if depth <= 0:
                break
        head = re.sub(r"\s*[{:]\s*$", "", " ".join(parts)).strip()
        above = no
        doc: list[str] = []
        while above > 0 and (m := _DOC_LINE.match(lines[above - 1])):
            doc.insert(0, m[1])
            above -= 1
        if not doc and (m := re.match(r'\s*(?:"""|\'\'\')(.*?)(?:"""|\'\'\'|$)', lines[no + len(parts)] if no + len(parts) < len(lines) else "")):
            doc = [m[1]]
        return Signature(head, "\n".join(doc).strip().encode()[:_DOC_BYTES].decode("utf-8", "ignore"), no + 1)
    return None


def owners(path: Column, rules: Sequence[str]) -> Column:
    """Owners of a path by the lines of an owners file: the last rule that matches decides; none gives an empty list."""
    found = F.array().cast("array<string>")
    for rule in rules:
        pattern, *names = rule.split("#", 1)[0].split() or [""]
        made = rule_to_regex(pattern) if pattern else None
        if made:
            found = F.when(path.rlike(made[0]), F.array(*map(F.lit, names)).cast("array<string>")).otherwise(found)
    return found


def build_tags(content: Column) -> Column:
    """Build conditions in the first 20 lines of a file."""
    head = F.slice(F.split(F.coalesce(content, F.lit("")), "\n", -1), 1, _TAG_LINES)
    return F.transform(F.filter(head, lambda x: x.rlike(r"^\s*(?://go:build |// \+build |#!\[cfg|#\[cfg)")), F.trim)


def last_commits(files: DataFrame, commits: DataFrame) -> DataFrame:
    """``path, commit, author, committed_at`` of the newest commit of each file, from a table of (path, commit, author, committed_at)."""
    newest = commits.groupBy("path").agg(F.max(F.struct("committed_at", "commit", "author")).alias("c"))
    return files.select("path").distinct().join(newest, "path").select("path", "c.commit", "c.author", "c.committed_at")
