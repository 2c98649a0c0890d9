"""Which files are hand-written source: tool output, minified code, third-party copies and data stored as code.

Layout statistics are taken per chunk with built-in expressions and merged per path by maxima, so a file with very many
chunks is reduced map-side like any other.  Each language has its own thresholds.  Paths and the comment at the head of a
declaration or file decide where the layout of copied or generated code looks like anybody's.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Directories and names that package managers, build tools and code generators use.
_VENDOR_DIRS = r"(?i)(?:^|/)(?:node_modules|bower_components|jspm_packages|vendor|third[_-]?party|Godeps|_vendor|site-packages|Pods|Carthage|\.yarn)/(?!$)"
# directories that also hold a project's own code: below them a library has a folder of its own
_VENDOR_FOLDERS = r"(?i)(?:^|/)(?:externals?|deps)/[^/]+/[^/]+/(?!$)"
_UPSTREAM_COPY = r"(?i)(?:^|/)contrib/(?:[^/]+/)*upstream/"
_GENERATED_DIRS = r"(?i)(?:^|/)(?:generated|autogen|auto_generated|__generated__|codegen_out|generated-sources)/"
_GENERATED_NAMES = r"(?i)(?:\.pb\.(?:go|cc|h|c)|_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|d\.ts)|_grpc_pb\.js|\.g\.(?:dart|cs)|\.gen\.\w+|\.generated\.\w+|_generated\.\w+|_gen\.\w+|/zz_generated[^/]*|\.designer\.cs|Grpc\.java|OuterClass\.java|\.freezed\.dart|_string\.go|\.snap|/gen/(?:[^/]+/)*[^/]+\.d\.ts)$"
_LOCK_NAMES = r"(?i)(?:^|/)(?:[^/]*\.lock(?:\.\w+)?|[^/]*-lock\.(?:json|yaml)|go\.sum|npm-shrinkwrap\.json|Pipfile\.lock|Cargo\.lock|poetry\.lock|composer\.lock|Gemfile\.lock)$"
_MINIFIED_NAMES = r"(?i)[.-]min\.(?:js|css|mjs)$|\.bundle\.js$|\.js\.map$|\.css\.map$"

_COMMENT = r"(?im)^[ \t]*(?:/\*+!?|//+!?|#+|\"\"\"|'''|--|;+|<!--|\*)[ \t]*"
# How the comments of tool output and of third-party copies begin.
_GENERATED_BANNER = (
    _COMMENT
    + r"(?:code generated\b|@generated\b|<auto-?generated>|<autogenerated|auto-?generated\b|automatically generated\b|(?:this (?:file|code) (?:is|was) )?(?:re)?generated (?:by|from|on|at|with|automatically|every)\b"
    + r"|this (?:file|code) (?:is|was|has been) (?:(?:auto-?|automatically )?generated|(?:produced|created|written|made|built) (?:automatically|by an? ?\w* ?(?:tool|generator|script|compiler)))\b|machine[- ](?:made|generated|written)\b|output of \S+ v?\d[\w.]* (?:on|from|for)\b"
    + r"|diese datei wurde automatisch\b|automatisch (?:erzeugt|generiert|erstellt)\b|(?:ce )?fichier (?:a été )?(?:produit|généré|créé) (?:par|automatiquement)\b|(?:este )?archivo (?:fue )?(?:generado|producido|creado) (?:automáticamente|por)\b|(?:questo )?file (?:è stato )?generato (?:automaticamente|da)\b|(?:このファイルは)?自動生成|[@#] sourcemappingurl="
    + r"|do not (?:edit|modify|change)\b[^\n\"]{0,40}(?:by hand|manually|directly|generated|this file)|generated file\b)"
)
_VENDORED_BANNER = (
    _COMMENT
    + r"(?:vendored from\b|taken (?:as is|verbatim|unmodified) from\b|(?:this (?:file )?is )?an? (?:verbatim|unmodified|exact) copy of\b|imported from the [^\n]{1,60}(?:archive|release|repository|distribution)|copied (?:verbatim )?from https?:"
    + r"|upstream: *https?://|@licen[sc]e\b[^\n]{1,80}\bcopyright\b|[\w.-]+\.js v\d[\w.]* *\| *\(c\)|@preserve\b)"
)
_PROSE = ("md", "rst", "txt", "adoc")

_LONG_LINE = 300


class Limits(NamedTuple):
    """Thresholds of a language; a chunk is judged by those of its file's extension."""

    mean_line: float  # minified: least mean line length of a chunk with a long line
    whitespace: float  # minified: most white space
    least_letters: float  # minified: least and most letters and digits
    most_letters: float
    punctuation: float  # minified: least marks of syntax
    data_lines: int  # data: least lines of data, and their share of all lines
    data_share: float
    dense: float  # data: least share of characters in encoded runs or in numeric literals, and their least number
    dense_chars: int


_OTHER = "other"
#: Minified code of languages whose blocks are indented keeps more white space; style sheets have less marks and more letters; markup has
#: long lines by nature; configuration holds tables and digests of its own, so more is needed before it is data.
LIMITS: dict[str, tuple[str, Limits]] = {
    "script": ("js mjs cjs jsx ts tsx", Limits(180, 0.08, 0.50, 0.76, 0.15, 14, 0.7, 0.6, 1000)),
    "style": ("css scss less", Limits(180, 0.05, 0.55, 0.80, 0.12, 14, 0.7, 0.6, 1000)),
    "python": ("py pyi", Limits(180, 0.10, 0.50, 0.78, 0.14, 14, 0.7, 0.6, 1000)),
    "shell": ("sh bash zsh", Limits(180, 0.12, 0.50, 0.78, 0.15, 14, 0.7, 0.6, 1000)),
    "markup": ("html htm xml svg vue svelte", Limits(240, 0.08, 0.50, 0.76, 0.15, 20, 0.7, 0.6, 1500)),
    "config": ("json yaml yml toml ini env tf sql md", Limits(1e9, 0.0, 0.0, 1.0, 1.0, 40, 0.7, 0.7, 1500)),
    _OTHER: ("", Limits(180, 0.08, 0.50, 0.76, 0.15, 14, 0.7, 0.6, 1000)),
}

_NUMBERS_LINE = r"^\s*[\[({]?\s*(?:[-+]?(?:0[xXbBoO][0-9a-fA-F_]+|\d[\d_]*\.?\d*(?:[eE][-+]?\d+)?)[fFuUlL]*\s*[,;]?\s*){4,}[\])}]*[,;]?\s*$"
# the same for lines of any length: a possessive repetition costs no stack
_LONG_NUMBERS_LINE = _NUMBERS_LINE.replace("{4,}", "{4,}+")
_ITEM = r"(?:\"[^\"]*\"|'[^']*'|[-+]?\d[\d_.]*|null|None|true|false)"
_RECORD_LINE = rf"^\s*[\[({{]\s*(?:(?:{_ITEM}\s*,\s*){{3,}}+(?:{_ITEM}\s*,?\s*)?|(?:{_ITEM}\s*,\s*){{2}}{_ITEM}\s*,?\s*)[\])}}][,;]?\s*$"
_INSERT_LINE = r"(?i)^\s*insert\s+into\s+\S++[^;]*?\bvalues\s*\(.*\)\s*[;,]?\s*$"
_ENCODED_LINE = r"^\s*[\"']?[A-Za-z0-9+/=_-]{40,}[\"']?\s*[+,;\\)]?\s*$"
# long base64 (with digits and capitals) and hexadecimal runs, and runs of escapes; possessive, so that length costs no stack
_ENCODED_RUN = r"(?<![A-Za-z0-9+/=_-])(?:(?=[A-Za-z0-9+/=_-]{40})(?=[A-Za-z+/=_-]*+[0-9])(?=[a-z0-9+/=_-]*+[A-Z])[A-Za-z0-9+/=_-]++|(?:0[xX])?[0-9a-fA-F]{40,}+)|(?:\\x[0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\[0-7]{3}){12,}+"
#: a numeric literal with the brackets and separators that follow it
_NUMBER = r"(?<![\w.])[-+]?(?:0[xXbBoO][0-9a-fA-F_]++|\d[\d_]*+(?:\.[\d_]*+)?(?:[eE][-+]?\d++)?|\.\d++)(?:[iuf](?:8|16|32|64|128|size)|[fFuUlLdDnN]{0,3}+)(?!\w)[\s,;()\[\]{}]*+"


def _limit(ext: Column) -> Callable[[str], Column]:
    """The thresholds of an extension, by name."""
    group = F.coalesce(*[F.when(ext.isin(*names.split()), g) for g, (names, _) in LIMITS.items() if names], F.lit(_OTHER))
    return lambda name: F.element_at(F.create_map(*[F.lit(x) for g, (_, row) in LIMITS.items() for x in (g, float(getattr(row, name)))]), group)


def _extension(path: str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def layout(chunks: DataFrame) -> DataFrame:
    """Per chunk: ``path`` and the layout statistics, all by built-in expressions.

    ``longest_line, mean_line, whitespace, alphanumeric, punctuation`` (shares of all characters), the numbers of lines and of
    lines of data, and the numbers of characters in long encoded runs and in numeric literals, however they are broken into
    lines.  Null contents count as empty.
    """
    text = F.coalesce("content", F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    count = lambda keep: F.lit(1.0) * F.length(F.regexp_replace("_t", keep, "")) / F.col("_n")
    without = lambda what: F.length("_t") - F.length(F.regexp_replace("_t", what, ""))
    lines = F.split("_t", r"\r?\n")
    sized = chunks.select("path", "kind", text.alias("_t"), size.alias("_n")).withColumn("_lines", F.filter(lines, lambda x: F.length(F.trim(x)) > 0))
    is_data = lambda x: F.when(F.length(x) <= _LONG_LINE, x.rlike(_NUMBERS_LINE)).otherwise(x.rlike(_LONG_NUMBERS_LINE)) | x.rlike(_RECORD_LINE) | x.rlike(_INSERT_LINE)
    is_run = lambda x: x.rlike(_ENCODED_LINE) & x.rlike("[0-9]") & x.rlike("[A-Z]")
    # only long lines can be minified, and only lines beginning like literals can be data: most chunks skip the costly part
    longest = F.coalesce(F.array_max(F.transform("_lines", F.length)), F.lit(0))
    return sized.select(
        "path",
        "kind",
        "_t",
        F.size("_lines").alias("lines"),
        longest.alias("longest_line"),
        (F.col("_n") / F.greatest(F.size("_lines"), F.lit(1))).alias("mean_line"),
        F.when(longest >= _LONG_LINE, count(r"[^\s]")).alias("whitespace"),
        F.when(longest >= _LONG_LINE, count(r"[^\p{L}\p{N}]")).alias("alphanumeric"),
        F.when(longest >= _LONG_LINE, count(r"[^;{}()=,:!&?<>+\[\]]")).alias("punctuation"),
        "_n",
        without(_ENCODED_RUN).alias("encoded"),
        F.when(F.col("_t").rlike(r"\d"), without(_NUMBER)).otherwise(0).alias("numeric"),
        F.size(F.filter("_lines", lambda x: is_data(x) | is_run(x))).alias("data_lines"),
    )


def classify_files(chunks: DataFrame) -> DataFrame:
    """One row per path: ``path, generated, vendored, minified, data`` (booleans, never null).

    A file is what any of its chunks shows.  Summaries are prose and count for nothing but their path; null paths are
    left out; a file without content is judged by its path.
    """
    ext = _extension("path")
    summary = F.coalesce(F.col("kind"), F.lit("")).endswith("_summary")
    code = ~summary & ~ext.isin(*_PROSE)
    limit = _limit(ext)
    stats = layout(chunks.where("path is not null"))
    minified = (
        code
        & (F.col("longest_line") >= _LONG_LINE)
        & (F.col("mean_line") >= limit("mean_line"))
        & (F.col("whitespace") <= limit("whitespace"))
        & F.col("alphanumeric").between(limit("least_letters"), limit("most_letters"))
        & (F.col("punctuation") >= limit("punctuation"))
    )
    solid = lambda chars: (F.col(chars) >= limit("dense_chars")) & (F.col(chars) >= limit("dense") * F.col("_n"))
    tabular = (F.col("data_lines") >= limit("data_lines")) & (F.col("data_lines") >= limit("data_share") * F.col("lines"))
    data = code & (tabular | solid("encoded") | solid("numeric"))
    flags = stats.select(
        "path",
        (code & F.col("_t").rlike(_GENERATED_BANNER)).alias("g"),
        (code & F.col("_t").rlike(_VENDORED_BANNER)).alias("v"),
        F.coalesce(minified, F.lit(False)).alias("m"),
        F.coalesce(data, F.lit(False)).alias("d"),
    )
    files = flags.groupBy("path").agg(*[F.max(c).alias(c) for c in "gvmd"])
    at = lambda pattern: F.col("path").rlike(pattern)
    return files.select(
        "path",
        (F.col("g") | at(_GENERATED_DIRS) | at(_GENERATED_NAMES) | at(_LOCK_NAMES)).alias("generated"),
        (F.col("v") | at(_VENDOR_DIRS) | at(_VENDOR_FOLDERS) | at(_UPSTREAM_COPY)).alias("vendored"),
        (F.col("m") | at(_MINIFIED_NAMES)).alias("minified"),
        F.col("d").alias("data"),
    )


def not_handwritten(chunks: DataFrame) -> DataFrame:
    """Paths of the files that are not hand-written source, each once."""
    return classify_files(chunks).where("generated or vendored or minified or data").select("path")
