"""Credentials embedded in source code and configuration.

Configuration is parsed by :mod:`fathomline.llm.keypaths` into values with their whole key paths and offsets: a value is
tested where its last key or, under a neutral key, one that encloses it is sensitive.  Program text gives assignments of
quoted literals, command options, headers and phrases in comments.  A value is a credential if its shape is that of a
literal secret, or if its shape alone says so (issuer prefixes, signed tokens, private key blocks, addresses with a
password).  Redactions are spliced into the original text at these spans; every other character stays where it was.

All scans are linear in the length of a text: key paths are computed in one pass, and patterns start at word borders only.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import keypaths


class Credential(NamedTuple):
    start: int  # offset of the value in characters
    end: int
    key_path: str
    kind: str


# Last words of key names that hold secrets, and words that turn a name into something about a secret.
_SECRET_NAMES = frozenset("password passwd pwd passphrase passcode pass pw secret token bearer cred creds credential credentials apikey pem cookie sid sessionid pgpassword accesskey secretkey privatekey signingkey authtoken jwt".split())
_SECRET_KEYS = frozenset("api access secret signing private encryption auth master account client service license deploy ssh hmac webhook shared storage subscription".split())
_ABOUT = frozenset("limit length min max type version name count ttl expiry expires path file dir field column header prefix policy pattern regex hint label prompt store provider algorithm alg format enabled required size env ref index url uri endpoint id tokens key_id scope scopes kind public".split())

#: endings of names written without separators, such as ADMINPASSWORD
_RUN_TOGETHER = re.compile(r"(?:password|passwd|passphrase|secret|token|apikey|accesskey|secretkey|privatekey|signingkey|credentials?)$")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

# How stand-ins for secrets present themselves.
_STAND_IN = re.compile(
    r"(?i:example|placeholder|change[-_ ]?me|change[-_ ]?this|replace[-_ ]?(?:me|this|with)|your[-_ ]|insert[-_ ]|paste[-_ ]|enter[-_ ]|not[-_ ]?a[-_ ]?real|redacted|goes[-_ ]here|secret[-_]?here|(?<![A-Za-z0-9])(?:todo|tbd|fake|dummy|sample|masked|for[-_ ]docs)(?![A-Za-z0-9]))|x{5,}|X{5,}|123456789012345|abcdefghijkl|\.\.\."
)
_REFERENCE = re.compile(r"\$\{|\$\(|\{\{|\}\}|^\$\w+$|^%\w+%$|^<[^>]*>$|^\([^)]*\)$|^\[[^\]]*\]$|^@\w+@?$|<%|#\{|^(?:vault|ssm|env|file|ref|secret|arn|kms|op|sops|keyring|gcp|aws)[:/]|(?i:environ|getenv|process\.env|env::var|secrets\.|var\.|config\.get)")
_PLAIN = frozenset("true false null none nil undefined yes no on off password passwd secret token pass pwd user admin root key value string bearer basic".split())
_CALL = re.compile(r"^[\w.:&*]+\(|^(?:new|await|self|this|await|lambda|func|fn)\b|=>|^\w+\[|::")


def _is_stand_in(value: str) -> bool:
    v = value.strip()
    if len(v) < 6 or v.lower() in _PLAIN or _REFERENCE.search(v) or _STAND_IN.search(v):
        return True
    bare = re.sub(r"^[A-Za-z]{1,8}[-_](?:[A-Za-z]{2,8}[-_])?", "", v)  # an issuer prefix before a mask
    return len(set(v)) <= 2 or (len(bare) >= 4 and len(set(bare)) <= 2)


def _is_literal_secret(value: str, password: bool) -> bool:
    """Whether a value under a sensitive name looks like a secret rather than a word, a path or an expression."""
    v = value.strip()
    if _is_stand_in(v) or " " in v or v.startswith(("/", "./", "~/")) or "://" in v or _CALL.search(v):
        return False
    digits = any(c.isdigit() for c in v)
    mixed = re.search(r"[a-z]", v) is not None and re.search(r"[A-Z]", v[1:]) is not None
    odd = re.search(r"[^\w.\-/]", v) is not None
    return (digits and not v.replace(".", "").isdigit()) or (mixed and (len(v) >= 16 or odd)) or (password and (odd or (mixed and not v.isalpha())))


# Words of sentences and of messages about passwords, none of which stands in a passphrase.
_SENTENCE = frozenset("the and for with you your are was not this that must should can cannot please enter confirm forgot forgotten reset invalid wrong required incorrect missing empty new old current password passwords passphrase passphrases secret token key least characters between match matches mismatch change strong weak login sign type repeat again hide show has have been will does from into what which when where here there is of in on at to or an as by be it if no".split())


def _is_passphrase(value: str) -> bool:
    """Four or more lower-case words of which none belongs to sentences."""
    words = value.strip().split(" ")
    return 4 <= len(words) <= 12 and all(re.fullmatch(r"[a-z]{3,12}\d{0,4}", w) and w not in _SENTENCE for w in words) and len(set(words)) >= 4


def _is_secret_value(value: str, password: bool) -> bool:
    return _is_literal_secret(value, password) or (password and " " in value and not _STAND_IN.search(value) and _is_passphrase(value))


def _is_spoken_secret(value: str) -> bool:
    """In running text only values of several character classes count, among them digits, capitals or odd characters."""
    return _is_literal_secret(value, True) and not re.fullmatch(r"[A-Z]?[a-z]+(?:[-/_.][a-z]+)*|[A-Z_]+|[\w-]*\w\.(?:js|py|go|rs|ts|java|md|yaml|json|toml|sql)", value) and sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", r"[^\w]")) >= 2


def name_words(key: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(key)]


def is_sensitive(key: str) -> bool:
    """Whether a key name (its last path segment) is that of a secret."""
    words = name_words(key.rsplit(".", 1)[-1])
    if not words or words[-1] in _ABOUT or "public" in words:
        return False
    joined = "".join(words[-2:])
    if _RUN_TOGETHER.search(words[-1]):
        return True
    return words[-1] in _SECRET_NAMES or joined in _SECRET_NAMES or (words[-1] == "key" and len(words) > 1 and words[-2] in _SECRET_KEYS) or "".join(words) in _SECRET_NAMES


# Keys beside a secret that do not hold it, and names of collections of secrets.
_BESIDE = frozenset("user username users login account email mail host hostname port region role arn provider mode method realm audience issuer subject name title description comment note namespace service cluster zone project engine driver database db schema mount created updated date server address bucket team owner key keys selector ref from digest sha sha1 sha256 checksum hash fingerprint salt color colour".split())
_COLLECTIONS = frozenset("secrets passwords credentials creds passphrases apikeys".split())


def path_is_sensitive(path: tuple[str, ...]) -> bool:
    """Whether a value under this key path is to be tested: by its last key, or by an enclosing one where the last is neutral.

    Keys that refer to a secret kept elsewhere (``secretKeyRef``, ``valueFrom``) end the search.
    """
    if is_sensitive(path[-1]):
        return True
    words = name_words(path[-1])
    if words and (words[-1] in _ABOUT or words[-1] in _BESIDE or "public" in words):
        return False
    for key in reversed(path[:-1]):
        words = name_words(key)
        if words and (words[-1] in ("ref", "from", "selector", "public") or words[-1] in _ABOUT):
            return False
        if is_sensitive(key) or (words and words[-1] in _COLLECTIONS):
            return True
    return False


def _is_password(key: str) -> bool:
    words = name_words(key.rsplit(".", 1)[-1])
    return bool(words) and (words[-1].startswith("pass") or words[-1] in ("pwd", "pw") or words[-1].endswith(("password", "passwd")))


# Pieces of text, lower case, one of which stands on every line where a secret is named or begins; and those
# that begin or stand inside issued tokens.
_FRAGMENTS = [*"pass pwd pw secret token key cred bearer auth cookie sid session signature pem jwt pin login logon log-in signs logs -u :// hooks.".split(), "sign in", "log in"]
_ISSUED_FRAGMENTS = "akia asia agpa aroa ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- xoxa xoxb xoxe xoxo xoxp xoxr xoxs sk_ rk_ pk_ sk- aiza eyj npm_ sg. hf_ _live_ _prod_ _pat_ _sec_ _secret_ _key_ _tok_ _token_ _api_".split()


@lru_cache(maxsize=1)
def _fragments() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for words, kind in ((_FRAGMENTS, 1), (_ISSUED_FRAGMENTS, 2)):
        for w in words:
            found.add_word(w, kind)
    found.make_automaton()
    return found


# a quoted literal after a name: key = "v", "key": "v", f("key", "v"), key := "v", KEY: &str = "v", key ??= "v"
_QUOTED = re.compile(
    r"""(?<![\w\-])[\d\-]*+(?P<key>[A-Za-z_][\w\-]*+(?:\.[A-Za-z_][\w\-]*+)*+)["'`]?\]?\s*(?:(?::\s*&?(?:'\w+\s+)?[A-Za-z_][\w<>?]*(?:\s*\|\s*\w+)*\s*)?=(?![=~])|\?\?=|\|\|=|:=|=>|:|,)\s*\(?\s*(?:[bru]|String::from\(|new\s+\w+\()?(?P<q>["'`])(?P<val>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)"""
)
_BARE = re.compile(r"""^(?P<lead>\s*(?:[-*]\s+|//+\s*|#+\s*|;+\s*|--\s+)*(?:export\s+|set\s+|setx\s+|ENV\s+|ARG\s+)?)(?P<key>[A-Za-z_][\w.\-]*)\s*(?P<op>[=:])[ \t]*(?P<val>[^\s"'`{\[(|>&*].*)?$""")
_NAME_ITEM = re.compile(r"""^\s*(?:-\s+)?(?:name|key)\s*:\s*["']?(?P<key>[\w.\-]+)["']?\s*(?:#.*)?$""")
_VALUE_ITEM = re.compile(r"""\s*(?:value|val)\s*:\s*(?:"(?P<d>[^"\n]*)"|'(?P<s>[^'\n]*)'|(?P<plain>[^\s"'].*))""")
_ELEMENT = re.compile(r"<(?P<key>[A-Za-z_][\w.\-:]*+)(?:\s[^<>]*+)?>[ \t]*(?P<val>[^<>\s][^<>\n]*)</(?P=key)>")
_ATTRIBUTES = re.compile(r"""(?<!\w)(?:name|key)\s*=\s*(?P<p>["'])(?P<key>[\w.\-]+)(?P=p)\s+value\s*=\s*(?P<q>["'])(?P<val>[^"'\n]+)(?P=q)""")
_OPTION = re.compile(r"""(?<![\w-])--?(?P<key>[A-Za-z][\w-]*)(?:=|\s+)(?P<q>["']?)(?P<val>[^\s"']+)(?P=q)""")
_HEADER = re.compile(r"""(?i)\b(?P<key>authorization|proxy-authorization)["']?\s*[:=,]\s*["']?(?P<scheme>basic|bearer|token|apikey|digest)\s+(?P<val>[A-Za-z0-9._~+/=$<{(%\-][^\s"'`,;)\\]*)""")
_OTHER_HEADER = re.compile(r"""(?i)(?<![a-z0-9-])(?P<key>x-[a-z0-9-]*+|private-token|api-key|apikey)["']?\s*[:,]\s*["']?(?P<val>[^\s"'`,;)]+)""")
_COOKIE = re.compile(r"""(?i)\b(?P<key>(?:set-)?cookie)["']?\s*[:=,]\s*["']?(?P<val>[^"'`\n(]+)""")
_HEADER_NAME = re.compile(r"(?i)token|key|secret|auth|password|signature|session")
_COOKIE_PAIR = re.compile(r"(?<![\w.-])(?P<key>[\w.-]++)=(?P<val>[^;\s\"']+)")
_SESSION_COOKIE = re.compile(r"(?i)sid$|sess|session|auth|token|jwt|remember|connect\.sid|csrf|xsrf")
_ADDRESS = re.compile(r"""(?<![A-Za-z0-9+.\-])[0-9+.\-]*+(?P<scheme>[A-Za-z][A-Za-z0-9+.\-]*+)://(?P<user>[^\s:/@"'`<>]*|<[^>\s]*>|\$\{[^}]*\}):(?P<val>[^\s/"'`@]+|<[^>\s]*>|\$\{[^}]*\})@(?=[A-Za-z0-9_\[$<{])""")
_CONNECTION = re.compile(r"""(?i)(?:^|[;"'`\s])(?P<key>password|pwd|accountkey|sharedaccesskey|secret)\s*=\s*(?P<val>[^;"'`\s]+)(?=\s*[;"'`]|\s*$)""")
_PHRASE = re.compile(r"""(?i)\b(?P<key>pass(?:word|phrase|wd|code)?|pwd|secret|api[ _-]?key|access[ _-]?key|(?:auth |access )?token|credentials?|pin)\b\s*(?:is|was|:|=|->)\s*(?P<q>["'`]?)(?P<val>[^\s"'`]+)(?P=q)""")
_SPOKEN = re.compile(r"""(?i)(?:\b(?P<key>signs? in|logs? in|login|logon|authenticates?)\s+(?:with|using|is|as|via)\s+(?:[\w.-]+\s*(?:/|:|,)\s*)?|\b(?P<key2>pw|pwd|pass|password|passphrase|secret|token)\s+)(?P<q>["'`]?)(?P<val>[^\s"'`,;()]{6,})(?P=q)""")
_LOGIN_OPTION = re.compile(r"""(?<![\w-])-(?P<key>p|pw|P)(?:\s+|=)?(?P<q>["'])(?P<val>[^"'\s]+)(?P=q)|(?<![\w-])-(?P<key2>p)\s+(?P<val2>[^\s"'-][^\s"']*)""")
_USER_OPTION = re.compile(r"""(?<![\w-])(?:-u|--user|--userpwd)[= ]\s*["']?(?P<user>[\w.@-]+):(?P<val>[^\s"']+)""")
_HOOK = re.compile(r"""https?://hooks\.[\w.-]+/(?:services|workflows|triggers)/[A-Z0-9]{6,}/[A-Z0-9]{6,}/(?P<val>[A-Za-z0-9]{16,})""")
_TICKED = re.compile(r"""`(?P<key>[A-Za-z_][\w.\-]*)`\s*(?:to|=|is|as|:|with|->)\s*`(?P<val>[^`\n]+)`""")
_PEM_BEGIN = re.compile(r"-----BEGIN (?P<what>[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----")
_MORE = re.compile(r"""[ \t]*(?:\+|\.\.|\\|&|\.)?[ \t]*\\?\r?\n[ \t]*(?://|#|--|\*|;)?[ \t]*(?:\+|\.\.|&|\.)?[ \t]*(?P<q>["'`])(?P<val>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)(?!\s*[:=])|[ \t]*(?:\+|\.\.|&|\.)[ \t]*(?P<q2>["'`])(?P<val2>(?:\\.|(?!(?P=q2))[^\\\n])*)(?P=q2)""")

# Shapes that issuers give to their tokens.
_ISSUED = re.compile(
    r"(?<![A-Za-z0-9_\-])(?:(?P<aws>(?:AKIA|ASIA|AGPA|AROA)[0-9A-Z]{16})(?![0-9A-Za-z])|(?P<github>gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,})|(?P<gitlab>glpat-[\w-]{16,})|(?P<slack>xox[abeoprs]-[A-Za-z0-9-]{16,})"
    r"|(?P<sk>(?:sk|rk|pk)_(?:live|prod)_[A-Za-z0-9]{10,}|sk-(?:ant-|proj-)?[A-Za-z0-9_-]{20,})|(?P<google>AIza[\w-]{30,})|(?P<jwt>eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{10,})"
    r"|(?P<npm>npm_[A-Za-z0-9]{30,})|(?P<sendgrid>SG\.[\w-]{16,}\.[\w-]{16,})|(?P<hf>hf_[A-Za-z0-9]{30,})|(?P<own>[a-z]{2,12}_(?:live|prod|pat|sec|secret|key|tok|token|api)_[A-Za-z0-9]{16,}))"
)
_CONFIG_FILES = frozenset("yaml yml ini env toml sh cfg conf properties tf tfvars json md bash".split())


def _basic_is_secret(value: str) -> bool:
    try:
        user, colon, password = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("utf-8").partition(":")
    except (binascii.Error, UnicodeDecodeError):
        return False
    return bool(colon) and bool(password) and not _is_stand_in(password if len(password) >= 6 else password + "#" * 6) and password.lower() not in _PLAIN


_KEY_HEADER = re.compile(r"\s*(?:Proc-Type|DEK-Info|Comment|Version|Hash|Subject|Key-[\w-]+):.*")
_KEY_WORD = re.compile(r"[A-Za-z0-9+/]+={0,2}")
_DECORATION = str.maketrans({c: " " for c in "\"'`,#*;|&\\)}]-><"})


def _key_words(line: str) -> list[str] | None:
    """The pieces of key text on a line, without quotes, joining and comment marks; None where something else stands on it."""
    words = re.sub(r"\\+[nrt]|\.?(?:append|concat)\(", " ", line).translate(_DECORATION).split()
    return words if all(_KEY_WORD.fullmatch(w) for w in words) else None


def _key_block(text: str, at: int, closing: str) -> tuple[int, str, bool]:
    """End, key text and whether it is closed of the private key whose first line ends at ``at``.

    Only lines that hold key text and nothing else belong to it, so code after a marker that stands by itself stays.
    """
    parts: list[str] = []
    end = at
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop]
        close = line.find(closing)
        own = line if close < 0 else line[:close]
        words = _key_words(own)
        if words is None and not parts and _KEY_HEADER.fullmatch(re.sub(r"^\W+", "", own) or " "):
            words = []
        if words is None and close >= 0 and "\\n" in own:
            # one line with escaped line ends: headers stand among the key text
            pieces = [_key_words(piece) for piece in re.split(r"\\+n", own) if not _KEY_HEADER.match(piece)]
            words = None if None in pieces else [w for piece in pieces for w in piece]
        if words is None:
            break
        joined = "".join(words)
        if close >= 0:
            return at + close + len(closing), "".join([*parts, joined]), True
        if joined:
            last = len(joined) < 20 and not (joined.endswith("=") or (re.search(r"\d", joined) and re.search(r"[a-z]", joined) and re.search(r"[A-Z]", joined)))
            if last and parts and not text[stop:].lstrip(" \t\r\n/#*;\"'+-").startswith(closing.strip("-")):
                break
            parts.append(joined)
            end = at + len(own.rstrip())
        at = stop + 1
    return end, "".join(parts), False


def _following(lines: list[str]) -> tuple[list[int], list[int]]:
    """For each line the number of the next one that is not blank, and of the next that is no comment either; -1 at the end."""
    filled, plain = [-1] * len(lines), [-1] * len(lines)
    f = p = -1
    for no in range(len(lines) - 1, -1, -1):
        filled[no], plain[no] = f, p
        line = lines[no].strip()
        if line:
            f = no
            if not line.startswith("#"):
                p = no
    return filled, plain


def find_credentials(text: str | None, extension: str = "") -> list[Credential]:
    """All credentials of a text in order of their offsets, spans never overlapping.  Null and empty texts hold none."""
    if not text:
        return []
    low_text = text.lower()
    if len(low_text) != len(text):  # a few letters change their length
        low_text = "".join(c.lower() if c.isascii() else c for c in text)
    places: list[int] = []
    issued = False
    for end, kind in _fragments().iter(low_text):
        if kind == 1:
            places.append(end)
        else:
            issued = True
    if not places and not issued:
        return []
    found: list[Credential] = []
    config = extension.lower() in _CONFIG_FILES

    # private key blocks, over lines or with escaped line ends
    blocks: list[tuple[int, int]] = []
    for m in _PEM_BEGIN.finditer(text) if "PRIVATE KEY" in text else ():
        if blocks and m.start() < blocks[-1][1]:
            continue
        end, body, closed = _key_block(text, m.end(), f"-----END {m['what']}-----")
        line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        if not closed and len(body) < 24 and "\n" not in text[m.end() :].strip() and re.fullmatch(r"[\s/#*;\-]*", line):
            # a chunk that ends inside a block, just after its first line
            end = len(text.rstrip())
        elif len(body) < 24 or len(set(body)) <= 8 or (len(body) < 64 and _STAND_IN.search(body)):
            continue
        found.append(Credential(m.start(), end, "", "private_key"))
        blocks.append((m.start(), end))

    def add(start: int, end: int, path: str, kind: str) -> None:
        if end > start:
            found.append(Credential(start, end, path, kind))

    if issued:
        for m in _ISSUED.finditer(text):
            if not _is_stand_in(m.group()):
                add(m.start(), m.end(), "", m.lastgroup or "issued")

    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    parents: list[tuple[str, ...]] = []
    if places and config:
        entries, parents = keypaths.parse(text, lines, starts, extension)
        for e in entries:
            if path_is_sensitive(e.path):
                password = any(map(_is_password, e.path[-2:]))
                own = is_sensitive(e.path[-1])
                # under a neutral key only values with digits and letters count
                plain = own or (len(e.value) >= 8 and re.search("[0-9]", e.value) and re.search("[A-Za-z]", e.value))
                if (_is_secret_value(e.value, password) and plain) or (not own and password and _is_passphrase(e.value)):
                    add(e.start, e.end, ".".join(e.path), "assignment")
    following = _following(lines)
    for no in sorted({bisect.bisect_right(starts, p) - 1 for p in places}):
        base, body = starts[no], lines[no].rstrip("\r")
        low = low_text[base : base + len(body)]

        def where(key: str, at: int = no) -> str:
            return ".".join([*parents[at], key]) if parents else key

        if "://" in low:
            for m in _ADDRESS.finditer(body):
                value = m["val"]
                if not (_REFERENCE.search(value) or _STAND_IN.search(value) or value.lower() in _PLAIN or len(set(value)) <= 2):
                    add(base + m.start("val"), base + m.end("val"), "", "address")
            for m in _HOOK.finditer(body) if "hooks." in low else ():
                if not _is_stand_in(m["val"]):
                    add(base + m.start("val"), base + m.end("val"), "", "address")
        for m in _QUOTED.finditer(body):
            if not is_sensitive(m["key"]):
                continue
            start, end, value = base + m.start("val"), base + m.end("val"), m["val"]
            at = base + m.end()
            pieces = [(start, end)]
            while more := _MORE.match(text, at):
                g = "val" if more["val"] is not None else "val2"
                pieces.append((more.start(g), more.end(g)))
                value += more[g]
                at = more.end()
            if _is_secret_value(value, _is_password(m["key"])):
                for s, e in pieces:
                    add(s, e, where(m["key"]), "assignment" if s == start else "continued")
        bare = _BARE.match(body)
        waiting = ""  # a sensitive key whose value stands on the next line
        if bare and is_sensitive(bare["key"]):
            key, value = bare["key"], re.sub(r"(?<!\s)\s++[#;].*$", "", (bare["val"] or "").rstrip())
            is_comment = bare["lead"].strip()[:1] in ("/", "#", ";") or bare["lead"].strip()[:2] == "--"
            if (config or is_comment) and value and _is_literal_secret(value, _is_password(key)):
                add(base + bare.start("val"), base + bare.start("val") + len(value), where(key), "assignment")
            if not value or value in ("\\", "("):
                waiting = key
        else:
            last = re.search(r"""(?<![\w\-])[\d\-]*+([A-Za-z_][\w\-]*+)["'`]?\]?\s*(?::\s*&?\w+\s*)?(?::|=|:=|\?\?=|,)\s*(?:[|>][-+]?|\\|\(|)\s*$""", body)
            if last and is_sensitive(last[1]):
                waiting = last[1]
        if waiting and (k := following[0][no]) >= 0:
            value = re.match(r"""\s*(?P<q>["'`]?)(?P<val>[^"'`\s:=]+)(?P=q)[;,)\s]*$""", lines[k].rstrip("\r"))
            if value and (config or value["q"]) and _is_literal_secret(value["val"], _is_password(waiting)):
                add(starts[k] + value.start("val"), starts[k] + value.end("val"), where(waiting), "assignment")
        if config and (name := _NAME_ITEM.match(body)) and is_sensitive(name["key"]) and (k := following[1][no]) >= 0:
            value = _VALUE_ITEM.match(lines[k])
            span = keypaths.picked(value, starts[k]) if value else None
            if span and _is_literal_secret(span[2], _is_password(name["key"])):
                add(span[0], span[1], where(name["key"]), "assignment")
        if "<" in body:
            for m in _ELEMENT.finditer(body):
                value = m["val"].rstrip()
                if is_sensitive(m["key"]) and _is_secret_value(value, _is_password(m["key"])):
                    add(base + m.start("val"), base + m.start("val") + len(value), where(m["key"]), "assignment")
        if "value" in low:
            for m in _ATTRIBUTES.finditer(body):
                if is_sensitive(m["key"]) and _is_secret_value(m["val"], _is_password(m["key"])):
                    add(base + m.start("val"), base + m.end("val"), where(m["key"]), "assignment")
        if "-" in body:
            for m in _OPTION.finditer(body):
                if is_sensitive(m["key"].replace("-", "_")) and _is_literal_secret(m["val"], _is_password(m["key"])):
                    add(base + m.start("val"), base + m.end("val"), m["key"], "option")
            if "-u" in low or "login" in low:
                for m in _USER_OPTION.finditer(body):
                    if _is_literal_secret(m["val"], True):
                        add(base + m.start("val"), base + m.end("val"), m["user"], "option")
                for m in _LOGIN_OPTION.finditer(body):
                    g = "val" if m["val"] is not None else "val2"
                    if _is_literal_secret(m[g], True):
                        add(base + m.start(g), base + m.end(g), "password", "option")
        if "authorization" in low:
            for m in _HEADER.finditer(body):
                value = m["val"]
                if _basic_is_secret(value) if m["scheme"].lower() == "basic" else _is_literal_secret(value, False) and len(value) >= 12:
                    add(base + m.start("val"), base + m.end("val"), m["key"], "header")
        if "x-" in low or "private-token" in low or "api-key" in low:
            for m in _OTHER_HEADER.finditer(body):
                if _HEADER_NAME.search(m["key"]) and len(m["val"]) >= 12 and _is_literal_secret(m["val"], False):
                    add(base + m.start("val"), base + m.end("val"), m["key"], "header")
        if "cookie" in low:
            for m in _COOKIE.finditer(body):
                for p in _COOKIE_PAIR.finditer(m["val"]):
                    if _SESSION_COOKIE.search(p["key"]) and len(p["val"]) >= 8 and _is_literal_secret(p["val"], False):
                        add(base + m.start("val") + p.start("val"), base + m.start("val") + p.end("val"), p["key"], "cookie")
        if "=" in body and ";" in body:
            for m in _CONNECTION.finditer(body):
                if _is_literal_secret(m["val"], True):
                    add(base + m.start("val"), base + m.end("val"), m["key"], "connection")
        if "`" in body:
            for m in _TICKED.finditer(body):
                if is_sensitive(m["key"]) and _is_literal_secret(m["val"], _is_password(m["key"])):
                    add(base + m.start("val"), base + m.end("val"), m["key"], "phrase")
        if re.match(r"\s*(?://|#|/?\*|--|;|<!--|\"\"\")", body) or extension.lower() in ("md", "txt", "rst"):
            for m in _PHRASE.finditer(body):
                value = m["val"].rstrip(".,;)")
                if _is_literal_secret(value, True) and not body[: m.start("key")].endswith(("_", "-")):
                    add(base + m.start("val"), base + m.start("val") + len(value), m["key"], "phrase")
            for m in _SPOKEN.finditer(body):
                value = m["val"].rstrip(".")
                if _is_spoken_secret(value):
                    add(base + m.start("val"), base + m.start("val") + len(value), m["key"] or m["key2"], "phrase")

    found.sort(key=lambda c: (c.start, -c.end))
    kept: list[Credential] = []
    opened = [a for a, _ in blocks]
    for c in found:
        at = bisect.bisect_right(opened, c.start) - 1
        if c.kind != "private_key" and at >= 0 and c.start < blocks[at][1]:
            continue
        if kept and c.start < kept[-1].end:
            continue
        kept.append(c)
    return kept


def redact(text: str | None, found: list[Credential]) -> str | None:
    """The text with each credential masked by asterisks, line ends and everything else unchanged in place."""
    if text is None or not found:
        return text
    parts, at = [], 0
    for c in found:
        parts.append(text[at : c.start])
        secret = text[c.start : c.end]
        if c.kind == "private_key":
            inner = re.match(r"(-----BEGIN [A-Z0-9 ]+-----)(.*?)(-----END [A-Z0-9 ]+-----)?$", secret, re.S)
            parts.append(inner[1] + re.sub(r"(\\[nr])|[A-Za-z0-9+/=]", lambda m: m[1] or "*", inner[2]) + (inner[3] or ""))
        else:
            parts.append("*" * len(secret))
        at = c.end
    return "".join([*parts, text[at:]])


def _extension(path: str | None) -> str:
    name = (path or "").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1] if "." in name else ""


def locate(chunks: DataFrame) -> DataFrame:
    """``id, line_no, key_path, kind, start_byte, end_byte`` of every credential of every row of ``chunks``.

    A credential in several pieces has one row per piece, of kind ``continued`` from the second on.  Lines end with \\n and
    count from 1.  Null contents give nothing; repeated rows give repeated results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for i, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                at, line, byte = 0, 1, 0  # found spans are in order: each part of the text is encoded once
                for c in find_credentials(content, _extension(path)):
                    line += content.count("\n", at, c.start)
                    byte += len(content[at : c.start].encode("utf-8", "surrogatepass"))
                    own = len(content[c.start : c.end].encode("utf-8", "surrogatepass"))
                    rows.append((i, line, c.key_path, c.kind, byte, byte + own))
                    line += content.count("\n", c.start, c.end)
                    at, byte = c.end, byte + own
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "line_no", "key_path", "kind", "start_byte", "end_byte"])

    return chunks.select("id", "path", "content").where("id is not null and content is not null").mapInArrow(run, "id bigint, line_no int, key_path string, kind string, start_byte bigint, end_byte bigint")


def redacted(chunks: DataFrame) -> DataFrame:
    """``id, credentials, content`` of the rows that hold credentials, these masked; rows without any are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts, texts = [], [], []
            for i, path, content in zip(*(c.to_pylist() for c in batch.columns)):
                found = find_credentials(content, _extension(path))
                if found:
                    ids.append(i)
                    counts.append(sum(c.kind != "continued" for c in found))
                    texts.append(redact(content, found))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int32()), pa.array(texts, pa.string())], names=["id", "credentials", "content"])

    return chunks.select("id", "path", "content").where("id is not null and content is not null").mapInArrow(run, "id bigint, credentials int, content string")


def credential_lines(chunks: DataFrame) -> DataFrame:
    """``id, line_no`` on which the value of a credential begins, each once."""
    return locate(chunks).where(F.col("kind") != "continued").select("id", "line_no").distinct()
