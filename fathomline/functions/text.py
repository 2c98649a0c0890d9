"""Text functions: tokens, query terms, lines and windows of lines.  All columns are built-in expressions."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

WINDOW_LINES = 40
WINDOW_OVERLAP = 10
MOST_BYTES = 4096


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


class ParsedQuery(NamedTuple):
    terms: list[list[str]]  # each term is a phrase of one or more tokens
    conjunctive: bool


def parse_query(text: str, mode: str = "auto") -> ParsedQuery:
    """Terms of a free-text query: quoted spans are phrases, other tokens need two characters.

    One or two terms must all match, three or more any; ``mode`` 'and' or 'or' overrides this.  Underscores separate words,
    as they do in the index, so ``a_b`` becomes a phrase.
    """
    terms: list[list[str]] = []
    for quoted, bare in re.findall(r'"([^"]*)"?|([^\s"]+)', text or ""):
        if quoted:
            words = re.findall(r"[^\W_]+", quoted.lower())
            if any(len(w) >= 2 for w in words):
                terms.append(words)
        for word in re.findall(r"\w+", bare.lower()):
            if len(word) >= 2 and (parts := re.findall(r"[^\W_]+", word)):
                terms.append(parts)
    unique = [t for i, t in enumerate(terms) if t not in terms[:i]]
    return ParsedQuery(unique, mode == "and" or (mode != "or" and len(unique) < 3))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    """Lines of a text; a line end at the very end does not begin another line, an empty text has none."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(F.length(text) == 0, 0).otherwise(ends + F.when(text.endswith("\n"), 0).otherwise(1)).cast("bigint")


def line_windows(text: Column) -> Column:
    """Windows of 40 lines that overlap by 10: array of (start_line, end_line, content); blank windows are left out.

    The last window is the first that reaches the end of the text.
    """
    body = F.when(text.endswith("\n"), F.expr("1")).otherwise(F.expr("0"))
    all_lines = lines(text)
    count = F.size(all_lines) - body
    starts = F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0)), F.lit(WINDOW_LINES - WINDOW_OVERLAP)), lambda s: (s == 0) | (s + WINDOW_OVERLAP < count))
    made = F.transform(
        starts,
        lambda s: F.struct(
            (s + 1).cast("bigint").alias("start_line"),
            F.least(s + WINDOW_LINES, count).cast("bigint").alias("end_line"),
            F.array_join(F.slice(all_lines, s + 1, F.least(F.lit(WINDOW_LINES), count - s)), "\n").alias("content"),
        ),
    )
    return F.filter(made, lambda w: F.length(F.regexp_replace(w["content"], r"[ \t\n\r\f\x0B]", "")) > 0)


def without_comments(path: Column, text: Column) -> Column:
    """The text without blank lines, white space at line ends, and lines of comments, each line ended.

    Lines that begin with // are comments everywhere, those with # only outside prose.  Null text gives an empty one.
    """
    prose = F.lower(path).rlike(r"\.(?:md|markdown|rst|txt)$")
    kept = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.regexp_replace(x, r"[ \t\r]+$", "")), lambda x: ~x.rlike(r"^[ \t]*(?://|$)") & (F.coalesce(prose, F.lit(False)) | ~x.rlike(r"^[ \t]*#")))
    return F.array_join(F.transform(kept, lambda x: F.concat(x, F.lit("\n"))), "")


def line_range(text: Column, first: int, last: int, most_lines: int, most_bytes: int | Column) -> Column:
    """Lines ``first``..``last`` as (content, truncated), cut after whole lines by number and by bytes."""
    wanted = F.slice(lines(text), first, last - first + 1)
    some = F.slice(wanted, 1, most_lines)
    kept = F.aggregate(
        some,
        F.struct(F.lit("").alias("t"), F.lit(0).alias("n"), F.lit(False).alias("stop")),
        lambda a, x: F.when(a["stop"] | (F.octet_length(a["t"]) + F.octet_length(x) + F.when(a["n"] > 0, 1).otherwise(0) > most_bytes), F.struct(a["t"].alias("t"), a["n"].alias("n"), F.lit(True).alias("stop"))).otherwise(
            F.struct(F.when(a["n"] == 0, x).otherwise(F.concat(a["t"], F.lit("\n"), x)).alias("t"), (a["n"] + 1).alias("n"), F.lit(False).alias("stop"))
        ),
    )
    return F.struct(kept["t"].alias("content"), (kept["stop"] | (F.size(wanted) > most_lines)).alias("truncated"))


def embed_text(path: Column, kind: Column, name: Column, content: Column, parent: Column | None = None) -> Column:
    """The text that is embedded: path, kind (not of windows), parent, name, then the content; null parts are left out."""
    some = lambda prefix, c, when: F.when(when & c.isNotNull() & (c != ""), F.concat(F.lit(prefix), c))
    inside = [] if parent is None else [some("// parent: ", parent, F.lit(True))]
    return F.concat_ws("\n", some("// ", path, F.lit(True)), some("// kind: ", kind, kind != "window"), *inside, some("// name: ", name, F.lit(True)), content)


def halve_oversized(text: str, most_bytes: int = MOST_BYTES) -> list[tuple[int, int, str]]:
    """Pieces (first line, last line, content) of at most ``most_bytes``: halves by lines, single lines by bytes.

    Byte cuts move forward to the next character, so a piece may exceed the limit by the rest of one character.
    """
    out: list[tuple[int, int, str]] = []
    todo = [(0, text.split("\n"))]
    while todo:
        at, part = todo.pop()
        content = "\n".join(part)
        raw = content.encode("utf-8", "surrogatepass")
        if len(raw) <= most_bytes:
            if content.strip():
                out.append((at, at + len(part) - 1, content))
        elif len(part) > 1:
            mid = len(part) // 2
            todo += [(at + mid, part[mid:]), (at, part[:mid])]
        else:
            begin = 0
            while begin < len(raw):
                end = min(begin + most_bytes, len(raw))
                while end < len(raw) and raw[end] & 0xC0 == 0x80:
                    end += 1
                out.append((at, at, raw[begin:end].decode("utf-8", "surrogatepass")))
                begin = end
    return out
