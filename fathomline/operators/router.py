"""The question router: intents, identifiers, suggested reads and budgets.

Patterns use explicit ASCII classes at word borders, so they mean the same in every regular expression dialect.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import paths
from fathomline.functions import text as text_functions

_EDGE = "(?:^|[^A-Za-z0-9_])"
_END = "(?:$|[^A-Za-z0-9_])"
# Phrases of questions, in the order in which they decide the intent.
INTENT_PHRASES = [
    ("callers", r"callers?|who calls|what calls|called by|usage of|usages of|references? to|where is .* used|where is .* called"),
    ("callees", r"callees?|what does .* call|calls from|outgoing calls|dependencies of"),
    ("package_topology", r"packages?|modules?|topology|dependency graph|import graph|package layout"),
    ("architecture", r"architecture|how does .* work|overview|big picture|design of|walk me through|how is .* organized"),
    ("editing_context", r"edit|modify|refactor|rename|extend|fix|patch|implement|add"),
]
INTENTS = ("behavior_search", "symbol_lookup", "callers", "callees", "architecture", "package_topology", "editing_context")
# The forms of identifiers in questions.
QUALIFIED = r"(?:^|[^A-Za-z0-9_])([A-Z][A-Za-z0-9_]*\.[A-Za-z_][A-Za-z0-9_]*)"
RECEIVER = r"(\(\*?[A-Z][A-Za-z0-9_]*\)\.[A-Za-z_][A-Za-z0-9_]*)"
WORD = r"([A-Za-z0-9_]+)"
PASCAL, CAMEL, SNAKE = r"^[A-Z][A-Za-z0-9_]{2,}$", r"^[a-z][a-z0-9]*[A-Z][A-Za-z0-9_]*$", r"^[a-z][a-z0-9_]*_[a-z0-9_]+$"
# whole words of one of the three forms, found in one pass
_SHAPED = r"(?<![A-Za-z0-9_])(" + "|".join(p[1:-1] for p in (PASCAL, CAMEL, SNAKE)) + r")(?![A-Za-z0-9_])"
SINGLE = r"^[ \t\r\n]*([A-Za-z0-9_]{3,32})[ \t\r\n]*$"
# Names of files that describe a structure.
ARCHITECTURE_DOCS = "readme architecture arch modules design agent agents claude contributing overview structure layout".split()
SUMMARY_PENALTY = 0.20
LOW_TOP, LOW_HIT = 0.45, 0.40


def intent_pattern(name: str) -> str:
    return _EDGE + "(?:" + dict(INTENT_PHRASES)[name] + ")" + _END


def identifiers(question: Column) -> Column:
    """Distinct identifiers of a question: qualified names first, then words in Pascal, camel or snake case that are not
    part of one; a single bare token where there is none.  Null has none."""
    text = F.coalesce(question, F.lit(""))
    qualified = F.concat(F.regexp_extract_all(text, F.lit(RECEIVER), F.lit(1)), F.regexp_extract_all(F.regexp_replace(text, RECEIVER, " "), F.lit(QUALIFIED), F.lit(1)))
    rest = F.regexp_replace(F.regexp_replace(text, RECEIVER, " "), QUALIFIED, " ")
    words = F.regexp_extract_all(rest, F.lit(_SHAPED), F.lit(1))
    found = F.array_distinct(F.concat(qualified, words))
    single = F.regexp_extract(text, SINGLE, 1)
    return F.when(F.size(found) > 0, found).when(single != "", F.array(single)).otherwise(F.array().cast("array<string>"))


def intent(question: Column, explicit: Column | None = None) -> Column:
    """The intent of a question: an explicit valid one, else by phrase, else symbol_lookup for up to three words with an
    identifier, else behavior_search."""
    low = F.lower(F.coalesce(question, F.lit("")))
    words = F.size(F.filter(F.split(low, r"[ \t\r\n]+"), lambda w: w != ""))
    chosen = F.when(words.between(1, 3) & (F.size(identifiers(question)) > 0), "symbol_lookup").otherwise("behavior_search")
    for name, _ in reversed(INTENT_PHRASES):
        chosen = F.when(low.rlike(intent_pattern(name)), name).otherwise(chosen)
    if explicit is not None:
        wish = F.lower(F.trim(explicit))
        chosen = F.when(wish.isin(*INTENTS), wish).otherwise(chosen)
    return chosen


def suggested_reads(hits: DataFrame, score: str, most: int = 2, prefer_code: bool = True, symbol_paths: DataFrame | None = None, ranks: DataFrame | None = None) -> DataFrame:
    """``path, start_line, end_line, place`` of the best hit of each of ``most`` files.

    Order: files that the symbol lane found too, code before documentation, with ``ranks(path, pagerank)`` score classes of
    0.05 and then rank, then score.  Hits without a range of lines cannot be read and are left out.
    """
    rows = hits.where("start_line > 0 and end_line >= start_line")
    rows = rows.join(symbol_paths.select("path").distinct().withColumn("_cross", F.lit(1)), "path", "left") if symbol_paths is not None else rows.withColumn("_cross", F.lit(0))
    rows = rows.join(ranks.select("path", F.col("pagerank").alias("_rank")), "path", "left") if ranks is not None else rows.withColumn("_rank", F.lit(0.0))
    side = F.when(F.lit(prefer_code), (paths.tags(F.col("path")) != 0).cast("int")).otherwise(0)
    order = [F.desc(F.coalesce("_cross", F.lit(0))), side]
    if ranks is not None:
        order += [F.desc(F.floor(F.col(score) * 20)), F.desc(F.coalesce("_rank", F.lit(0.0)))]
    order += [F.desc(score), F.col("id")]
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("path").orderBy(*order))).where("_n = 1")
    # a top-k list: the window runs over at most one hit per file of a bounded pool
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint")).where(F.col("place") <= most).select("path", "start_line", "end_line", "place")


def penalise_summaries(summaries: DataFrame, nodes: DataFrame, score: str) -> DataFrame:
    """Summaries with ``adjusted``: 0.20 less where neither the name is that of a structural document nor the file has nodes."""
    stem = F.lower(F.regexp_replace(paths.basename(F.col("path")), r"(.)\.[^.]*$", "$1"))
    known = nodes.select(F.col("file_path").alias("path")).where("path <> ''").distinct().withColumn("_known", F.lit(True))
    return summaries.join(known, "path", "left").withColumn("adjusted", F.round(F.when(stem.isin(*ARCHITECTURE_DOCS) | F.coalesce("_known", F.lit(False)), F.col(score)).otherwise(F.col(score) - SUMMARY_PENALTY), 6)).drop("_known")


class InlineLimits(NamedTuple):
    most_lines: int
    most_bytes: int
    budget: int


def inline_limits(intent: str) -> InlineLimits:
    """How much of the source a bundle carries: more for questions about structure."""
    return InlineLimits(120, 8 * 1024, 40 * 1024) if intent in ("architecture", "package_topology") else InlineLimits(60, 4 * 1024, 20 * 1024)


def inline_content(items: DataFrame, budget: int, most_lines: int, most_bytes: int) -> DataFrame:
    """``place, lane, id, content, truncated, left_over`` of items in order until the budget of bytes is used up.

    ``items(lane, place, id, content, is_whole)`` are the lanes of one bundle, a few dozen rows: reads first, then bodies
    of symbols, then hits.  An item is cut after whole lines by number and by bytes, and by what is left of the budget; whole
    items (summaries) are taken as they are and may exceed it.  Null contents count as empty.
    """
    # the budget of an item depends on how much its forerunners used, so the list is folded in one row
    ordered = F.array_sort(F.collect_list(F.struct("lane", "place", "id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("is_whole", F.lit(False)).alias("is_whole"))))
    kind = "struct<left:bigint,out:array<struct<lane:int,id:bigint,content:string,truncated:boolean,left_over:bigint>>>"
    start = F.struct(F.lit(budget).cast("bigint").alias("left"), F.expr("cast(array() as array<struct<lane:int,id:bigint,content:string,truncated:boolean,left_over:bigint>>)").alias("out")).cast(kind)

    def take(state: Column, item: Column) -> Column:
        all_lines = F.size(text_functions.lines(item["content"]))
        cut = text_functions.line_range(item["content"], 1, 1 << 30, most_lines, F.least(F.lit(most_bytes).cast("bigint"), state["left"]))
        content = F.when(item["is_whole"], item["content"]).otherwise(cut["content"])
        truncated = ~item["is_whole"] & cut["truncated"] & (all_lines > 0)
        left = state["left"] - F.octet_length(content)
        entry = F.struct(item["lane"].cast("int").alias("lane"), item["id"].alias("id"), content.alias("content"), truncated.alias("truncated"), left.alias("left_over"))
        return F.when(state["left"] > 0, F.struct(left.alias("left"), F.concat(state["out"], F.array(entry)).alias("out")).cast(kind)).otherwise(state)

    folded = items.agg(F.aggregate(ordered, start, take).alias("s"))
    return folded.select(F.posexplode("s.out").alias("place", "e")).select((F.col("place") + 1).cast("bigint").alias("place"), "e.lane", "e.id", "e.content", "e.truncated", "e.left_over")


def without_low_signal(hits: DataFrame, score: str) -> DataFrame:
    """Without hits below 0.40 where even the best is below 0.45."""
    best = F.max(score).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return hits.withColumn("_best", best).where((F.col("_best") >= LOW_TOP) | (F.col(score) >= LOW_HIT)).drop("_best")


# Documents that describe a directory, in order of priority.
DESCRIBING = "CLAUDE.md doc.go README.md".split()


def describing_documents(files: DataFrame) -> DataFrame:
    """``path, priority`` of the files that describe their directory."""
    at = F.array_position(F.array(*map(F.lit, DESCRIBING)), paths.basename(F.col("path")))
    return files.select("path", (at - 1).cast("int").alias("priority")).where("priority >= 0")


def word_references(chunks: DataFrame, names: list[str]) -> DataFrame:
    """``symbol, path, line_no`` of whole-word uses of some names, each line once; null contents have none."""
    rows = chunks.select("path", "start_line", F.posexplode(text_functions.lines(F.col("content"))).alias("n", "line"), F.array(*map(F.lit, names)).alias("names"))
    hit = F.filter("names", lambda s: F.col("line").contains(s) & F.regexp_like(F.col("line"), F.concat(F.lit("(^|[^A-Za-z0-9_])"), s, F.lit("([^A-Za-z0-9_]|$)"))))
    return rows.select(F.explode(hit).alias("symbol"), "path", (F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1)).cast("bigint") + F.col("n")).alias("line_no")).distinct()


def capped_references(references: DataFrame, per_symbol: int = 20, most: int = 30) -> DataFrame:
    """The first ``per_symbol`` references of each symbol by path and line, and of these the first ``most``."""
    order = Window.partitionBy("symbol").orderBy("path", "line_no")
    first = references.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_symbol)
    return first.orderBy("symbol", "_n").limit(most).drop("_n")


def nearest_document(files: DataFrame, documents: DataFrame, depth: int = 10) -> DataFrame:
    """``path, doc`` of the nearest document above each file: up to ``depth`` directories, by priority within one.

    ``documents(path, priority)``.  Each directory keeps its best document before files are joined to it.
    """
    # directories by the text up to their slash: './' is none above 'b.py', whose root is ''
    at = documents.select(F.regexp_replace("path", r"[^/]*$", "").alias("dir"), F.struct("priority", F.col("path").alias("doc")).alias("d"))
    two = at.groupBy("dir").agg(F.array_sort(F.collect_set("d")).alias("best")).select("dir", F.get("best.doc", F.lit(0)).alias("_best"), F.get("best.doc", F.lit(1)).alias("_next"))
    above = files.select("path").distinct().select("path", F.posexplode(F.slice(paths.ancestors(F.col("path")), 1, depth)).alias("far", "dir"))
    up = above.withColumn("dir", F.when(F.col("far") == F.size(F.split("path", "/")) - 1, "").otherwise(F.concat("dir", F.lit("/"))))
    # no lambda over both sides of the join: where path is attribute 1 of a session, its null check lands on the side without path
    found = up.join(two, "dir").withColumn("doc", F.coalesce(*[F.when(F.col(c) != F.col("path"), F.col(c)) for c in ("_best", "_next")])).where("doc is not null")
    return found.groupBy("path").agg(F.min(F.struct("far", "doc")).alias("b")).select("path", "b.doc")


def test_pairs(files: DataFrame) -> DataFrame:
    """``path, test`` of files and the test files beside them that exist."""
    known = files.select("path").distinct()
    ext, base = paths.extension(F.col("path")), paths.basename(F.col("path"))
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    folder = F.regexp_replace("path", r"[^/]*$", "")
    names = (
        F.when((ext == ".go") & ~stem.endswith("_test"), F.array(F.concat(stem, F.lit("_test.go"))))
        .when((ext == ".py") & ~stem.startswith("test_") & ~stem.endswith("_test"), F.array(F.concat(F.lit("test_"), stem, F.lit(".py")), F.concat(stem, F.lit("_test.py"))))
        .when(ext.isin(".ts", ".tsx", ".js", ".jsx") & ~stem.contains(".test") & ~stem.contains(".spec"), F.array(F.concat(stem, F.lit(".test"), ext), F.concat(stem, F.lit(".spec"), ext)))
    )
    wanted = known.select("path", F.explode(names).alias("name"), folder.alias("folder")).select("path", F.concat("folder", "name").alias("test"))
    return wanted.join(known.withColumnRenamed("path", "test"), "test", "left_semi").select("path", "test")
