"""Classification of paths, ignore rules and path arithmetic."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The extensions and names that are indexed.
EXTENSIONS = ".go .py .js .jsx .ts .tsx .rs .java .kt .c .h .cc .cpp .hpp .rb .lua .sh .bash .zsh .md .rst .txt .yml .yaml .toml .json .sql .clj .cljs .cljc .scala .cs .swift .dart .php .hs .ex .exs .erl .tf .proto .graphql .gql .r .jl .zig .fish .ps1 .html .css .scss .vue .svelte".split()
BASENAMES = "Makefile makefile GNUmakefile Dockerfile dockerfile Containerfile Justfile justfile CMakeLists.txt BUILD BUILD.bazel WORKSPACE Rakefile Gemfile Procfile go.mod go.work Brewfile Vagrantfile Tiltfile Caddyfile Pipfile .editorconfig CHANGELOG README".split()

# The default ignore patterns, in the order in which they apply.
IGNORE_PATTERNS = """.env .env.* *.pem *.key *.key.gpg *.kdbx id_rsa id_rsa.pub id_ed25519 id_ed25519.pub id_ecdsa id_ecdsa.pub authorized_keys known_hosts secrets.yml secrets.yaml *.tfvars
.terraform/ node_modules/ vendor/ .venv/ venv/ .tox/ __pycache__/ target/ dist/ build/ .next/ .cache/ .git/ .hg/ .svn/ *.log *.lock *.min.js *.min.css
*.d.ts llms.txt llms-full.txt package-lock.json npm-shrinkwrap.json pnpm-lock.yaml coverage/ .nyc_output/ htmlcov/ __snapshots__/
LICENSE LICENSE.* LICENCE LICENCE.* License License.* license license.* COPYING COPYING.* COPYRIGHT COPYRIGHT.* NOTICE NOTICE.* AUTHORS AUTHORS.* PATENTS PATENTS.* LEGAL LEGAL.*""".split()

# Directories and name endings of tests.
TEST_DIRS = "tests test __tests__ spec specs testdata fixtures".split()
TEST_NAMES = r"(?:_test\.go|/test_[^/]*\.py|^test_[^/]*\.py|_test\.py|\.(?:test|spec)\.(?:js|jsx|ts|tsx|mjs|cjs)|_test\.rs|_spec\.rb|_test\.rb)$"
TEST_PATTERN = r"(?:^|/)(?:" + "|".join(TEST_DIRS) + r")/|" + TEST_NAMES

# Shapes of secrets that keep a file out of the index.
SECRET_SHAPES = [
    r"AKIA[0-9A-Z]{16}",
    r"ASIA[0-9A-Z]{16}",
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    r"ghp_[A-Za-z0-9]{36}",
    r"github_pat_[A-Za-z0-9_]{82}",
    r"xox[abps]-[A-Za-z0-9-]{10,}",
    r"sk-(?:proj-)?[A-Za-z0-9_-]{20,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"sk_live_[0-9a-zA-Z]{24,}",
    r"rk_live_[0-9a-zA-Z]{24,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"SG\.[A-Za-z0-9_-]{22,}\.[A-Za-z0-9_-]+",
]
SECRET_PATTERN = "|".join(SECRET_SHAPES)
LARGEST_FILE = 1 << 20

# What makes a path documentation, build configuration, test or fixture.
TAG_DOC = r"\.(?:md|rst|txt|adoc|mdx)$"
TAG_BUILD = r"\.(?:yml|yaml|toml)$|(?:^|/)(?:Dockerfile|Makefile)$"
TAG_FIXTURE = r"(?:^|/)(?:testdata|__fixtures__)(?:/|$)"
TAG_TEST = r"(?:_test\.go|\.(?:test|spec)\.(?:ts|tsx|js|jsx)|_test\.py|(?:^|/)test_[^/]*\.py|_spec\.rb|_test\.rs)$"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """The parent directory, '.' for a name without one."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def is_indexable(path: Column) -> Column:
    return extension(path).isin(EXTENSIONS) | basename(path).isin(BASENAMES)


def is_test(path: Column) -> Column:
    return path.rlike(TEST_PATTERN)


SECRET_SNIFF, BINARY_SNIFF = 4096, 8192  # characters that the reference looks at


def _sniffed(content: Column, sniff: int | None) -> Column:
    text = F.coalesce(content, F.lit(""))
    return text if sniff is None else F.substring(text, 1, sniff)


def looks_secret(path: Column, content: Column, sniff: int | None = None) -> Column:
    """A secret shape in a file that is no test; ``sniff`` looks at that many characters only."""
    return ~is_test(path) & _sniffed(content, sniff).rlike(SECRET_PATTERN)


def looks_binary(content: Column, sniff: int | None = None) -> Column:
    """A NUL in the content; ``sniff`` looks at that many characters only."""
    return F.instr(_sniffed(content, sniff), "\x00") > 0


def is_small(content: Column) -> Column:
    """At most the size of a file that is indexed; null content is empty."""
    return F.octet_length(F.coalesce(content, F.lit(""))) <= LARGEST_FILE


def tags(path: Column) -> Column:
    """Bits: 1 documentation, 2 build, 4 test, 8 fixture; fixtures are tests as well."""
    bit = lambda pattern, value: F.when(path.rlike(pattern), value).otherwise(0)
    return bit(TAG_DOC, 1).bitwiseOR(bit(TAG_BUILD, 2)).bitwiseOR(bit(TAG_TEST, 4)).bitwiseOR(bit(TAG_FIXTURE, 12)).cast("bigint")


def rule_to_regex(rule: str) -> tuple[str, bool] | None:
    """A rule of an ignore file as (regular expression over whole paths, ignores); None for blanks and comments."""
    rule = rule.rstrip()
    if not rule or rule.startswith("#"):
        return None
    ignores = not rule.startswith("!")
    rule = rule.lstrip("!") if not ignores else rule
    directory = rule.endswith("/")
    body = rule.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    made, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            made, i = made + "(?:.*/)?", i + 3
        elif body.startswith("/**/", i):
            made, i = made + "/(?:.*/)?", i + 4
        elif body.startswith("/**", i):
            made, i = made + "/.*", i + 3
        elif body[i] == "*":
            made, i = made + "[^/]*", i + 1
        elif body[i] == "?":
            made, i = made + "[^/]", i + 1
        else:
            made, i = made + re.escape(body[i]), i + 1
    return ("^" if anchored else "(?:^|/)") + made + ("/" if directory else "(?:/|$)"), ignores


def is_ignored(path: Column, rules: Sequence[str] = IGNORE_PATTERNS) -> Column:
    """Whether the last rule that matches a path ignores it.  Rules that agree and follow each other become one pattern."""
    runs: list[tuple[list[str], bool]] = []
    for made in filter(None, map(rule_to_regex, rules)):
        if runs and runs[-1][1] == made[1]:
            runs[-1][0].append(made[0])
        else:
            runs.append(([made[0]], made[1]))
    verdict = F.lit(False)
    for patterns, ignores in runs:
        verdict = F.when(path.rlike("|".join(patterns)), F.lit(ignores)).otherwise(verdict)
    return verdict


def ancestors(path: Column) -> Column:
    """All directories above a path, nearest first, the root as '.': ``a/b/c.go`` gives ``[a/b, a, .]``."""
    parts = F.split(path, "/")
    depths = F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1))
    return F.transform(depths, lambda n: F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, n), "/")))


def clean(path: Column) -> Column:
    """A relative path without '.', empty and resolvable '..' parts; '.' for nothing left, and '..' stays where it leads out."""
    last = lambda a: F.element_at(a, -1)
    folded = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda a, x: F.when(x.isin("", "."), a).when((x == "..") & (F.size(a) > 0) & F.coalesce(last(a) != "..", F.lit(True)), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))),
    )
    return F.when(F.size(folded) == 0, ".").otherwise(F.array_join(folded, "/"))


def joined(folder: Column, target: Column) -> Column:
    """``target`` seen from ``folder``, cleaned."""
    return clean(F.concat(folder, F.lit("/"), target))
