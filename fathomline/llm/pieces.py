"""Splitting oversized items at natural boundaries by lexical cohesion.

For every line end the words of the lines before it are compared with those after it (cosine of word counts in sliding
blocks).  Valleys of this similarity mark changes of topic, and their depth is measured against the peaks on both sides.
A piece ends at the deepest valley within the window of sizes it may have; blank lines and ends of declarations deepen a
valley.  The next piece begins with up to ``overlap`` lines of the last.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 4096  # UTF-8 bytes
OVERLAP = 10  # lines
_BLOCK = 8  # lines on each side of a boundary
_BATCH_CHARS = 4_000_000  # characters after which pieces are handed on
_FILL = 0.5  # a piece is at least this full where a boundary allows it
_WORD = re.compile(r"[^\W\d_]{2,}")
_DECLARATION = re.compile(r"^(?:export\s+|pub\s+|public\s+|private\s+|static\s+|async\s+|default\s+)*(?:def|class|func|fn|function|type|interface|struct|impl|enum|trait|const|module|resource|CREATE|create|@\w+|#{1,6}\s|\[)")

SCHEMA = "id bigint, piece_no int, start_line int, end_line int, shared_lines int, content string"


def _depths(lines: list[str]) -> list[float]:
    """For each line index i the depth of the valley at the boundary before line i."""
    bags = [Counter(w.lower() for w in _WORD.findall(line)) for line in lines]
    n = len(lines)
    left: Counter = Counter()
    right: Counter = Counter()
    for b in bags[:_BLOCK]:
        right.update(b)
    similarity = [1.0] * (n + 1)
    for i in range(1, n):
        left.update(bags[i - 1])
        if i - 1 - _BLOCK >= 0:
            left.subtract(bags[i - 1 - _BLOCK])
        right.subtract(bags[i - 1])
        if i - 1 + _BLOCK < n:
            right.update(bags[i - 1 + _BLOCK])
        dot = sum(c * right[w] for w, c in left.items() if c and right.get(w, 0))
        norm = math.sqrt(sum(c * c for c in left.values()) * sum(c * c for c in right.values()))
        similarity[i] = dot / norm if norm else 0.0
        if i % 256 == 0:  # words that are no longer counted
            left, right = +left, +right
    rise_left, rise_right = similarity[:], similarity[:]
    for i in range(1, n):
        rise_left[i] = max(similarity[i], rise_left[i - 1]) if similarity[i - 1] >= similarity[i] else similarity[i]
    for i in range(n - 1, 0, -1):
        rise_right[i] = max(similarity[i], rise_right[i + 1]) if similarity[i + 1] >= similarity[i] else similarity[i]
    return [(rise_left[i] - similarity[i]) + (rise_right[i] - similarity[i]) for i in range(n + 1)]


def _bonus(before: str, after: str) -> float:
    b, a = before.strip(), after.strip()
    if not b:
        return 0.6
    indented = after[:1] in (" ", "\t")
    if _DECLARATION.match(after):
        return 0.8
    if b in ("}", "};", "end", "});", "})", "]", "];") and not indented and before[:1] not in (" ", "\t"):
        return 0.8
    return 0.3 if not a else 0.0


def _cut_bytes(line: str, limit: int) -> list[str]:
    """A line longer than ``limit`` in parts of at most ``limit`` bytes, after a blank or separator where one is near."""
    parts, raw = [], line.encode("utf-8", "surrogatepass")
    at = 0
    while len(raw) - at > limit:
        end = at + limit
        while (raw[end] & 0xC0) == 0x80:
            end -= 1
        soft = max(raw.rfind(c, at + limit * 3 // 4, end) for c in (b" ", b",", b";", b"|", b"}"))
        if soft > 0:
            end = soft + 1
        if raw[end - 1 : end + 1] == b"\r\n":
            end -= 1
        parts.append(raw[at:end].decode("utf-8", "surrogatepass"))
        at = end
    return [*parts, raw[at:].decode("utf-8", "surrogatepass")]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, str]]:
    """Pieces as (first line, last line, lines shared with the piece before, content), lines counted from 0.

    Every piece has at most ``limit`` bytes; the pieces without their shared lines are the text again, byte by byte.
    """
    lines = re.findall(r"[^\n]*\n|[^\n]+$", text)
    units: list[tuple[int, str, int]] = []  # line number, text, bytes
    for no, line in enumerate(lines):
        size = len(line.encode("utf-8", "surrogatepass"))
        for part in _cut_bytes(line, limit) if size > limit else [line]:
            units.append((no, part, len(part.encode("utf-8", "surrogatepass"))))
    n = len(units)
    depths = _depths([u[1] for u in units])
    whole = [i == 0 or i == n or units[i - 1][1].endswith("\n") for i in range(n + 1)]
    pieces: list[tuple[int, int, int, str]] = []
    start = shared = 0  # the piece begins with `shared` units that the last one has too
    while start < n:
        size, stop = 0, start
        while stop < n and size + units[stop][2] <= limit:
            size += units[stop][2]
            stop += 1
        if stop < n:
            fresh = start + shared + 1
            window, filled = [], 0
            for i in range(start, stop):
                filled += units[i][2]
                if i + 1 >= fresh and filled >= _FILL * limit and whole[i + 1]:
                    window.append(i + 1)
            window = window or [i for i in range(fresh, stop + 1) if whole[i]] or [stop]
            stop = max(window, key=lambda i: (depths[i] + _bonus(units[i - 1][1], units[i][1]), i))
        pieces.append((units[start][0], units[stop - 1][0], shared, "".join(u[1] for u in units[start:stop])))
        if stop >= n:
            break
        # shared lines must be whole lines, and leave at least half of the next piece and its first line to new text
        back, used = 0, 0
        while back < overlap and stop - back - 1 > start and whole[stop - back] and whole[stop - back - 1]:
            more = units[stop - back - 1][2]
            if used + more > limit // 2 or used + more + units[stop][2] > limit:
                break
            used += more
            back += 1
        start, shared = stop - back, back
    return pieces


def split_oversized(df: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, stamp: str = "last_seen_at") -> DataFrame:
    """Pieces of the rows whose ``content`` has more than ``limit`` UTF-8 bytes.

    Columns ``id, piece_no, start_line, end_line, shared_lines, content``.  Lines count from the row's ``start_line``, or
    from 1 where that is null or not positive.  Null ids and contents give nothing; of rows that repeat an id the newest is
    taken (by ``stamp``, where there is such a column, then by content and start line), so each id is split once.  Only oversized rows are shuffled and reach Python.
    """
    big = df.where(F.col("id").isNotNull() & (F.octet_length("content") > limit))
    order = [c for c in (stamp, "content", "start_line") if c in df.columns]
    big = big.groupBy("id").agg(F.max(F.struct(*order)).alias("r")).select("id", "r.content", "r.start_line")
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    names = ["id", "piece_no", "start_line", "end_line", "shared_lines", "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for i, text, first in zip(*batch.columns):
                base = first.as_py() or 0
                base = base if base > 0 else 1
                key = i.as_py()
                for no, (begin, end, shared, content) in enumerate(split_text(text.as_py(), limit, overlap), 1):
                    rows.append((key, no, base + begin, base + end, shared, content))
                    held += len(content)
                if held > _BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return big.mapInArrow(run, SCHEMA)
