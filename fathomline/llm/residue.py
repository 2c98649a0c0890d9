"""Template residue and error pages instead of content.

Two tests on the prose of a text, that is on what is left without code blocks, code spans, stack frames and log lines:

* an unfilled placeholder anywhere in prose or headings;
* sentences matched by the automaton make up at least ``share`` of the prose, page furniture such as navigation and
  copyright lines not counted.

One automaton holds the terms of all families and languages.  A sentence is matched by a phrase that says it alone, by a
subject and a predicate of one family (a page that is missing, scripts that must be on), or by being filler.  Sentences
of advice (try again, check the address) count where another sentence is matched, as they do on error pages.  Coverage is
the sum of matched sentences over all of them, so a text of any length that only mentions such a phrase stays.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

SHARE = 0.5

# Status codes of HTTP with their reasons.
STATUS_REASONS = {
    400: "bad request", 401: "unauthorized", 402: "payment required", 403: "forbidden", 404: "not found", 405: "method not allowed", 406: "not acceptable", 408: "request timeout", 409: "conflict", 410: "gone", 413: "payload too large", 414: "uri too long",
    418: "i'm a teapot", 421: "misdirected request", 422: "unprocessable entity", 423: "locked", 429: "too many requests", 431: "request header fields too large", 451: "unavailable for legal reasons", 500: "internal server error", 501: "not implemented",
    502: "bad gateway", 503: "service unavailable", 504: "gateway timeout", 505: "http version not supported", 507: "insufficient storage", 508: "loop detected", 511: "network authentication required",
}

# Phrases that say by themselves that something is an error page, a notice or filler, lower case.
PHRASES = """
could not be found on this server | was not found on this server | the requested url | find what you were looking for | find the page you | page you are looking for | page you requested | page you were looking for
something went wrong | an unexpected error occurred | an error occurred while processing | an error has occurred | -side exception has occurred | we're having trouble | we are having trouble | unable to process your request
did not answer in time | took too long to respond | temporarily unavailable | temporarily down | down for maintenance | maintenance is under way | undergoing maintenance | scheduled maintenance | be back soon | be back shortly
error establishing a database connection | error establishing a connection | upstream connect error | disconnect/reset before headers | rate limit reached | rate limit exceeded | you have been rate limited | you have exceeded | too many requests
you do not have permission to | you don't have permission to | you are not authorized to | not allowed to view | your session has expired | session timed out | seems to be gone | has been blocked | you have been blocked | unusual traffic | verify you are human
verify that you are human | are you a robot | checking your browser | attention required! | complete the captcha | complete the security check | ray id | access to this page has been | access to this site has been
die angeforderte seite | die angeforderte datei | ein fehler ist aufgetreten | etwas ist schiefgelaufen | zugriff verweigert | sitzung ist abgelaufen | vorübergehend nicht verfügbar | la page demandée | une erreur est survenue | une erreur s'est produite
accès refusé | accès interdit | session a expiré | temporairement indisponible | la página solicitada | se ha producido un error | ha ocurrido un error | algo salió mal | acceso denegado | sesión ha caducado | sesión ha expirado | temporalmente no disponible
la pagina richiesta | si è verificato un errore | qualcosa è andato storto | accesso negato | sessione è scaduta | temporaneamente non disponibile | a página solicitada | ocorreu um erro | algo deu errado | acesso negado | sessão expirou
er is een fout opgetreden | er ging iets mis | toegang geweigerd | wystąpił błąd | coś poszło nie tak | odmowa dostępu | brak dostępu | sesja wygasła | произошла ошибка | что-то пошло не так | доступ запрещен | доступ запрещён | сеанс истек | временно недоступен
アクセスが拒否されました | エラーが発生しました | 一時的に利用できません | 拒绝访问 | 访问被拒绝 | 发生错误 | 出错了 | 暂时无法访问 | 服务不可用
fatal error: uncaught | unhandled exception | took longer than | does not run scripts | does not support javascript | javascript is disabled | javascript is required | javascript is turned off | javascript is not enabled | scripts are disabled | scripts are turned off
enable javascript | turn on javascript | switch on javascript | allow javascript | activate javascript | javascript to run this | without javascript enabled | javascript aktivieren | javascript ist deaktiviert | javascript ist ausgeschaltet | activer javascript | activez javascript | activez les scripts
javascript est désactivé | activar javascript | active javascript | habilite javascript | habilitar javascript | javascript está desactivado | attivare javascript | abilita javascript | abilitare javascript | ative o javascript | habilite o javascript | schakel javascript in | włącz javascript | включите javascript
javascriptを有効 | javascriptが無効 | 启用javascript | 启用 javascript | 開啟 javascript
lorem ipsum | dolor sit amet | consectetur adipiscing | description goes here | text goes here | content goes here | goes here | to be written by | to be written | to be filled in | to be completed | to be added later | fill this in | fill me in
add a short summary | add a short description | add a description | add your description | write a short description | insert text here | insert usage notes | placeholder text | dummy text | sample copy | sample text | sample heading | body copy | real copy later
replace before release | replace this text | replace with your | content will follow | text follows | more text to come | coming soon | under construction | work in progress page | stay tuned
platzhaltertext | blindtext | beispieltext | hier folgt | text folgt | im aufbau | in kürze verfügbar | texte de remplissage | faux texte | à compléter | en construction | bientôt disponible | texto de relleno | texto de ejemplo | por completar | en construcción | próximamente
testo segnaposto | testo di esempio | da completare | in costruzione | prossimamente | texto de exemplo | em construção | em breve | voorbeeldtekst | in aanbouw | tekst zastępczy | w budowie | wkrótce | текст-заполнитель | здесь будет текст | в разработке | скоро здесь
ダミーテキスト | 準備中 | 工事中 | ここに本文 | ここに説明 | 此处填写 | 占位文本 | 建设中 | 敬请期待
"""
# Phrases that count at the beginning of a sentence only.
OPENINGS = """page not found | file not found | not found | bad gateway | gateway timeout | service unavailable | internal server error | application error: | server error | access denied | permission denied | forbidden
oops! | oops, | whoops | page introuvable | {"error" | {"errors" | {"message":"not found | {"status":4 | {"status":5 | {"status":"error | {"code":4 | {"code":5 | {"detail":"not found | tbd tbd | todo todo"""
# Families of subjects and predicates; a sentence that has both of one family is matched.
FAMILIES = {
    "missing": (
        "page | pages | site | website | web page | seite | webseite | página | pagina | strona | strony | stronę | страница | страницы | страницу | ページ | 页面 | 網頁 | 网页",
        """not found | could not be found | couldn't be found | cannot be found | can't be found | couldn't find | could not find | can't find | cannot find | does not exist | doesn't exist | no longer exists | no longer available | isn't available | is not available
        nicht gefunden | existiert nicht | nicht vorhanden | introuvable | n'existe pas | n'existe plus | no existe | no encontrada | no se encuentra | no se ha encontrado | no se encontró | non trovata | non esiste | inesistente | não encontrada | não existe | não foi encontrada
        niet gevonden | bestaat niet | nie znaleziono | nie istnieje | nie odnaleziono | не найдена | не найдено | не найден | не существует | 見つかりません | 見つかりませんでした | 存在しません | 不存在 | 找不到 | 未找到 | 不可用""",
    ),
    "scripts": (
        "javascript | java script | scripts | scripting | skripte | script | le script | les scripts | スクリプト | 脚本 | джаваскрипт",
        """enable | enabled | turn on | turn it on | turned on | switch on | switched on | activate | activated | allow | requires | required | require | is needed | needs | need to | disabled | turned off | blocked | does not run | doesn't run | cannot run | does not support | doesn't support | without
        aktivieren | aktiviere | aktiviert | deaktiviert | benötigt | erforderlich | einschalten | ausgeschaltet | activez | activer | désactivé | désactivés | nécessaire | requis | autorisez | activar | active | activa | active los | habilite | habilitar | habilita | necesario | requiere | desactivado | deshabilitado
        abilita | abilitare | abilitate | attiva | attivare | attivate | disabilitato | disattivato | necessario | richiede | richiesto | ative | ativar | desativado | necessário | requer | schakel | inschakelen | ingeschakeld | uitgeschakeld | vereist | włącz | włączyć | wyłączony | wymaga | wymagany
        включите | включить | отключён | отключен | отключена | требуется | необходим | 有効 | 無効 | 必要 | 启用 | 啟用 | 禁用 | 需要 | 开启""",
    ),
}
# What error pages and notices advise; counts beside a matched sentence.
ADVICE = """try again | please retry | check the address | check the url | check the link | check the spelling | check your connection | without it | without them | cannot show | can't show | cannot display | cannot be shown | cannot be displayed | stays empty | stay empty | change this in | upgrade your plan | or wait | go back | return to | back to the | start page | home page | homepage | reload | refresh | contact | has been told | has been notified
have been notified | been informed | may have been | might have been | was deleted | was moved | been removed | come back | log in again | sign in again | sign in with | log in to continue | ask its owner | request id | reference id | error code | incident | resets in | in a few minutes | turn them on
to continue | to proceed | in your browser | your browser | vérifiez | revenez | retournez | rechargez | réessayez | veuillez | versuchen sie | laden sie | zurück zur | startseite | verschoben | gelöscht | inténtelo | vuelva a | volver a | compruebe | recargue | página de inicio
riprova | ricarica | torna alla | controlla | tente novamente | volte para | recarregue | probeer | ga terug | spróbuj | wróć | odśwież | попробуйте | вернитесь | обновите | 再読み込み | もう一度 | 戻る | 请稍后 | 刷新 | 返回 | real copy | later | write real"""
# Words of texts about code; a subject and a predicate beside one of them say nothing.
DISCUSSION = """returns | return a | returning | raises | raised | throws | handler | handlers | function | parser | middleware | endpoint | endpoints | callers | loader | fallback | falls back | retries | means that | so that | batch | batches | commit | api | cache | index | crawler | renderer | worker | pipeline
module | modules | test | tests | unit test | we | our | build | compiled | bundle | config | option | flag | default | query | queries | schema | dependency | package | plugin | log | logs | template | templates"""

_NAME = r"[A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)*"
# Special names of Python, those that are names only beside a word of reading or setting, and such words; variables that the systems set.
_DUNDERS = "init main name file all call repr str dict class doc enter exit new del iter next len getitem slots future setitem delitem eq hash bool contains getattr setattr delattr missing aiter anext aenter aexit init_subclass class_getitem post_init pycache".split()
_SOFT_DUNDERS = frozenset("version author email license copyright path package spec loader builtins annotations module qualname bases mro debug import format date title tests mocks snapshots fixtures".split())
_NAMING = re.compile(r"(?i)\b(?:use|uses|used|using|read|reads|reading|via|set|sets|setting|define|defines|defined|attribute|variable|constant|import|imports|export|exports|the|its|see|look up|looks up|directory|folder)\s+$")
_ENVIRONMENT = "PATH HOME USERPROFILE APPDATA LOCALAPPDATA TEMP TMP SYSTEMROOT WINDIR PROGRAMFILES PROGRAMDATA USERNAME COMPUTERNAME HOMEDRIVE HOMEPATH PATHEXT COMSPEC ALLUSERSPROFILE PUBLIC PYTHONPATH JAVA_HOME GOPATH".split()
_IN_PARAGRAPH = r"(?:[^{0}\n]|\n(?![ \t]*\n))+"  # no blank line and no bracket
# The shapes of unfilled placeholders.
_SHAPES: dict[str, list[str]] = {
    "{": [
        r"\{\{-?\s*[A-Za-z_][^{}\n]*\}\}",
        r"\{%-?\s*\w[^%\n]*%\}",
        r"[$#]\{" + _NAME + r"\}",
        # a name in braces within a path or an address is that of a route
        r"(?<![\w{$#\\/=&?:.-])\{" + _NAME + r"\}(?![}/])",
    ],
    "<": [r"<%[=-]?\s*[A-Za-z_][^%\n]*%>", r"(?i:<(?:insert|your|enter)\s" + _IN_PARAGRAPH.format("<>") + ">)"],
    "[": [
        r"\[\[" + _NAME + r"\]\]",
        # up to the bracket within the paragraph; a long text in square brackets may also be that of a link
        r"(?i:\[(?:insert|your|enter|add)\s(?:[^\]\n]{1,40}\]|" + _IN_PARAGRAPH.format(r"\[\]") + r"\](?![(\[:])))",
        r"(?m:^(?:Dear|Hello|Hi)\s\[[A-Za-z][A-Za-z ]*\])",
        r"\[object Object\]",
    ],
    "%": [r"%\(" + _NAME + r"\)[sdfr]", r"(?<![\w%])%(?!(?:" + "|".join(_ENVIRONMENT) + r")%)[A-Za-z_]{3,40}%(?![\w%])"],
    "$": [r"(?<![\w$])\$[A-Za-z_]{3,40}\$(?![\w$])"],
    "@@": [r"@@[A-Za-z_][\w.]*@@"],
    "__": [r"(?<![\w_])__(?!(?:" + "|".join(_DUNDERS) + r")__)[A-Za-z][A-Za-z0-9_]*?__(?![\w_])"],
    **{word: [r"(?m:^#{1,6}\s(?:.*\s)?" + word + r"\b)", r"(?m:^(?:Welcome to|Version|Title:|Name:|Dear|Hello)\s" + word + r"\b)"] for word in ("undefined", "null", "NaN")},
}
_PLACEHOLDER = re.compile("|".join(shape for shapes in _SHAPES.values() for shape in shapes))
#: the same by the characters without which none of them can match
_PLACEHOLDERS = [(mark, re.compile("|".join(shapes))) for mark, shapes in _SHAPES.items()]
_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[^\n]*$|\Z)", re.M | re.S)
_TAGGED_CODE = {tag: re.compile(rf"<{tag}\b[^<>]*>.*?</{tag}>", re.S | re.I) for tag in ("pre", "code")}
_SPAN = re.compile(r"(`+)(?!`)(.+?)(?<!`)\1(?!`)", re.S)
_LOG_LINE = re.compile(r"^\s*(?:\[?\d{4}-\d\d-\d\d[T ]\d\d:\d\d|\w{3}\s+\d+ \d\d:\d\d:\d\d |(?:TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\b[ :\]])")
#: A line of letters only, as filler text is; real prose of this length has function words or other marks.
_LETTERS_ONLY = re.compile(r"^(?:[A-Za-z]+ ){7,}[A-Za-z]+\.?$")
_INNER_CAPITAL = re.compile(r"[a-z] [A-Z][a-z]+")
# Frequent function words of the languages written in Latin letters.
_FUNCTION_WORDS = frozenset(
    """the a an of and or to in is are was were be been for with on at by from that this it its as not no but if when while then than so
    der die das und ist nicht ein eine im den dem des zu mit von wird werden für auf le la les un une des du et est dans pour que qui sur par pas ne
    el los las una y es de en para por con se no su al lo il gli che di non per del della o os as um uma do da em não""".split()
)
_FURNITURE = re.compile(r"^(?:#{1,6}\s+\S{1,60}|\S{1,60}|(?:\(c\)|©|copyright)\s.{1,60}|\S+(?:(?:\s{2,}|\s*[|·»>]\s*)\S+){2,})$", re.I)
_FRAME = re.compile(r"^\s*(?:at [\w.$<>]+\(.*\)|File \".*\", line \d+.*|\.\.\. \d+ more)\s*$")
_TAG = re.compile(r"<(/?)(\w[\w-]*)[^<>]*>|<!--.*?-->|<!\w[^<>]*>", re.S)
_SENTENCE_END = re.compile(r"(?<=[.!?。！？])(?:\s+|(?<=[。！？]))")
_NOSCRIPT = "\x02"
_OPENS, _ALONE, _ADVISES, _DISCUSSES = 1, 2, 4, 8
_BITS = {name: (16 << 2 * i, 32 << 2 * i) for i, name in enumerate(FAMILIES)}


def _terms(block: str) -> list[str]:
    return [t for t in (x.strip() for x in re.split(r"\s*\|\s*|\n", block.strip())) if t]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Terms with their length and the roles they have, as bits."""
    roles: dict[str, int] = {_NOSCRIPT: _ALONE}

    def add(terms: list[str], role: int) -> None:
        for t in terms:
            roles[t] = roles.get(t, 0) | role

    add(_terms(PHRASES), _ALONE)
    add(_terms(OPENINGS), _OPENS)
    for code, reason in STATUS_REASONS.items():
        add([f"{code} {reason}", f"{code} - {reason}", f"{code}: {reason}", f"{code} | {reason}", f"error {code}", f"{code} error", f"http error {code}", f"http status {code}", f"http {code}", f"status {code}"], _OPENS)
    add(_terms(ADVICE), _ADVISES)
    add(_terms(DISCUSSION), _DISCUSSES)
    for name, (subjects, predicates) in FAMILIES.items():
        add(_terms(subjects), _BITS[name][0])
        add(_terms(predicates), _BITS[name][1])
    found = ahocorasick.Automaton()
    for term, role in roles.items():
        found.add_word(term, (len(term), role))
    found.make_automaton()
    return found


def prose_of(text: str) -> str:
    """The text without code blocks, code spans, stack frames and log lines; a span leaves one neutral character."""
    text = text.replace("\r\n", "\n").lstrip("\ufeff")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    for tag, element in _TAGGED_CODE.items():
        # what is opened after the last closing tag is never closed
        if f"<{tag}" in text and (last := text.lower().rfind(f"</{tag}>")) >= 0 and len(text) == len(text.lower()):
            text = element.sub("\u00b7", text[: last + len(tag) + 3]) + text[last + len(tag) + 3 :]
    if "`" in text:
        text = _SPAN.sub("\u00b7", text)
    return "\n".join(line for line in text.split("\n") if not _LOG_LINE.match(line) and not _FRAME.match(line))


def _is_filler_line(line: str) -> bool:
    """Whether a line strings words together without any function word, repeating words or capitals inside a sentence."""
    if not _LETTERS_ONLY.match(line):
        return False
    words = line.rstrip(".").lower().split(" ")
    return not _FUNCTION_WORDS.intersection(words) and (len(set(words)) < len(words) or _INNER_CAPITAL.search(line) is not None)


def _is_repetition(words: list[str]) -> bool:
    """Three words or more of which each is one of at most two that stand in runs, or of one letter each."""
    if len(words) < 3:
        return False
    if all(len(w) > 2 and len(set(w)) == 1 and w.isalpha() for w in words):
        return True
    return len(set(words)) <= 2 and all(w.isalpha() for w in words) and len(words) >= 2 * len(set(words)) and sum(a != b for a, b in zip(words, words[1:])) < len(set(words))


def _may_repeat(low: str) -> bool:
    """Whether a word follows itself, consists of one letter, or ends two sentences of up to four words in a row."""
    words = low.split()
    if any(a == b for a, b in zip(words, words[1:])) or any(len(w) > 3 and w == w[0] * len(w) for w in words):
        return True
    return any(a == b and a[-1] in ".!?" for d in (2, 3, 4) for a, b in zip(words, words[d:]))


def _is_border(text: str, at: int) -> bool:
    """Whether no letter or digit of a script with spaces stands at a position."""
    return not 0 <= at < len(text) or not text[at].isalnum() or ord(text[at]) > 0x2E80


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _roles(low: str, begin: int, hits: list[tuple[int, int, int]]) -> tuple[int, int]:
    """The roles of the terms inside a sentence, and how many characters of an opening term stand at its start."""
    roles = opening = 0
    for at, end, role in hits:
        opens = role & _OPENS and not low[begin:at].strip("#*>-=_ \t\"'")
        if opens:
            opening = max(opening, end - begin)
        roles |= role & ~_OPENS
    return roles, opening


def _is_matched(roles: int) -> bool:
    if roles & _ALONE:
        return True
    return not roles & _DISCUSSES and any(roles & s and roles & p for s, p in _BITS.values())


#: Keys of answers of services that report an error.
_ANSWER_KEYS = frozenset("error errors message code status detail details request request_id requestid timestamp path trace traceid type title documentation_url success ok reason statuscode error_description instance".split())


def _is_error_answer(text: str) -> bool:
    """Whether a text is one JSON object that only reports an error."""
    if not text.startswith("{") or not text.endswith("}"):
        return False
    try:
        answer = json.loads(text)
    except (ValueError, RecursionError):
        return False
    if not isinstance(answer, dict) or not answer or not {k.lower() for k in answer} <= _ANSWER_KEYS:
        return False
    low = {k.lower(): v for k, v in answer.items()}
    failed = any(str(low.get(k, ""))[:1] in "45" and str(low.get(k, "")).isdigit() and len(str(low[k])) == 3 for k in ("code", "status", "statuscode"))
    said = any(isinstance(low.get(k), str) and residue_share(low[k]) >= SHARE for k in ("message", "detail", "title", "reason"))
    return bool(low.get("error") or low.get("errors")) or failed or said


def residue_share(prose: str) -> float:
    """Share of the prose, furniture left out, in sentences that are matched; 0 where there is nothing but furniture."""
    if "<" in prose:
        prose = _TAG.sub(lambda m: f"\n{_NOSCRIPT}" if (m[2] or "").lower() == "noscript" and not m[1] else "\n" if m[2] else " ", prose)
    low = _lower(prose)
    hits = []
    for last, (length, role) in automaton().iter(low):
        begin, end = last - length + 1, last + 1
        if (_is_border(low, begin - 1) or not low[begin].isalnum()) and (_is_border(low, end) or not low[last].isalnum()):
            hits.append((begin, end, role))
    roles = 0
    for _, _, role in hits:
        roles |= role
    if not (roles & (_ALONE | _OPENS) or _may_repeat(low) or any(roles & s and roles & p for s, p in _BITS.values())):
        # without a match only lines of filler or an answer can count
        if not any(_is_filler_line(x.strip()) or x.lstrip()[:1] == "{" for x in prose.split("\n")):
            return 0.0
    hits.sort()
    total = hit = advice = 0
    place = used = 0
    before = ""
    for line in prose.split("\n"):
        at, place = place, place + len(line) + 1
        bare = line.strip()
        if not bare:
            continue
        counted = matched = advised = 0
        filler = _is_filler_line(bare) or (bare[0] == "{" and _is_error_answer(bare))
        start = at
        for sentence in _SENTENCE_END.split(line):
            start = prose.find(sentence, start) if sentence else start
            end = start + len(sentence)
            own = []
            while used < len(hits) and hits[used][0] < end:
                if hits[used][0] >= start:
                    own.append(hits[used])
                used += 1
            size = len(sentence.strip())
            if not size:
                continue
            roles, opening = _roles(low, start, own) if own else (0, 0)
            words = re.findall(r"[^\W_]+", low[start:end])
            # a status line says little beside its status
            is_status = opening > 0 and len(re.findall(r"[^\W_]+", low[start + opening : end])) <= 5
            same = 0 < len(words) <= 4 and size <= 40 and low[start:end].strip(" .#*") == before
            before = low[start:end].strip(" .#*")
            if filler or is_status or _is_matched(roles) or _is_repetition(words) or same:
                matched += size
            elif roles & _ADVISES:
                advised += size
            elif size <= 40 and sum(w.isalpha() for w in words) <= 3 and (matched or advised or hit):
                continue  # a number or mark beside the notice
            counted += size
            start = end
        if not matched and not advised and _FURNITURE.match(bare):
            continue
        total += counted
        hit += matched
        advice += advised
    return (hit + advice) / total if hit and total else 0.0


def has_placeholder(prose: str) -> bool:
    if not any(mark in prose and shape.search(prose) for mark, shape in _PLACEHOLDERS):
        return False
    for m in _PLACEHOLDER.finditer(prose):
        if not (m.group().strip("_").lower() in _SOFT_DUNDERS and m.group().startswith("__") and _NAMING.search(prose[max(0, m.start() - 20) : m.start()])):
            return True
    return False


def is_residue(text: str | None, share: float = SHARE) -> bool:
    """False for null and blank texts."""
    if not text or not text.strip():
        return False
    prose = prose_of(text)
    return has_placeholder(prose) or residue_share(prose) >= share or _is_error_answer(text.strip())


def flag_residue(df: DataFrame, key: str, text: str, share: float = SHARE) -> DataFrame:
    """``key, is_residue`` of every row; whole texts are read, repeated keys stay repeated rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags = [is_residue(t.as_py(), share) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flags, pa.bool_())], names=[key, "is_residue"])

    return df.select(key, text).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, is_residue boolean")


def without_residue(df: DataFrame, text: str, share: float = SHARE) -> DataFrame:
    """The rows of ``df`` whose text is no residue, with all their columns.

    Rows with null or blank texts stay; repeated rows stay repeated; nothing is shuffled.
    """
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not is_residue(t.as_py(), share) for t in batch.column(at)], pa.bool_()))

    return df.mapInArrow(run, df.schema)
