import time

import pytest

from fathomline.llm import residue


@pytest.mark.parametrize(
    "text",
    ["Страница не найдена", "Nie znaleziono strony", "Questa pagina non esiste", "Deze pagina bestaat niet.", "Abilita JavaScript per continuare", "Schakel JavaScript in om verder te gaan.", "Włącz JavaScript, aby kontynuować.", "Включите JavaScript, чтобы продолжить."]
    + ["404\nThis page doesn't exist", "Sorry, you have been blocked.\n\nAttention required! Complete the captcha to continue.", '{"message":"Not Found"}', '{"message": "Not Found", "documentation_url": "https://x.example/y"}', '{"detail":"Not found."}', '{"status": 503, "title": "upstream"}', "Dear [Customer Name]\n\nyour order has left our store today."]
    + ["Sorry, we can't find the page you asked for. Please go back to the home page.", "<html><head><title>504 Gateway Timeout</title></head><body><h1>504 Gateway Timeout</h1><p>nginx</p></body></html>", "La pagina richiesta non è stata trovata.", "Session timed out. Please sign in again to continue.", "Texto de relleno", "HTTP 503\n\nThe service is temporarily unavailable. Please try again in a few minutes."]
    + ["This is release __version__ of __title__.", "Contact __module__ for access."],
)
def test_more_residue(text):
    assert residue.is_residue(text)


@pytest.mark.parametrize(
    "text",
    ["The endpoint is GET /users/{id} and nothing else.", "Use __version__ to read the version", "Reading the __path__ of a package gives its folders.", "%PATH% is a Windows variable"]
    + ["Error 404 handling in our router\n\n" + "The handler maps unknown routes to a short answer. " * n for n in (1, 3, 12)]
    + ["404 Not Found is what the endpoint returns for an unknown id, and callers map it to an empty result.", "The loader returns null if the page does not exist, so callers need no special case for it.", "Run the build and check the log. Please try again later if the mirror is busy.", '{"name": "x", "error": false}', '{"message": "cache warmed in 3 s"}']
    + ["The build requires scripts in the bin folder of the module.", "This guide explains how pages are cached. " * 20 + "An unknown page is not found in the cache.", "この断片は長すぎるため、分けて保存します。この断片は長すぎるため、分けて保存します。索引の更新は行われます。"],
)
def test_what_only_mentions_residue(text):
    assert not residue.is_residue(text)


def test_coverage_decides_at_every_length():
    notice, prose = "Please enable JavaScript to continue. ", "The index is rebuilt after every change of a file. "
    for n in (1, 50, 2000):
        assert residue.is_residue(notice * n)
        assert not residue.is_residue(notice * n + prose * 4 * n)
        assert residue.residue_share(notice * 2 * n + prose * n) == pytest.approx(2 * 37 / (2 * 37 + 50), abs=0.03)


def test_long_texts_take_seconds():
    for text in ("asdf " * 300_000, "page not found. " * 100_000, "x" * 1_000_000, "{" * 200_000, "<" * 500_000, "[insert " * 100_000, "__a" * 200_000, "% a" * 200_000, "` " * 200_000):
        began = time.perf_counter()
        residue.is_residue(text)
        assert time.perf_counter() - began < 30, text[:10]


def test_clean_documents_keep_their_columns(spark):
    rows = [(1, "TBD TBD TBD", "a", True), (2, None, "b", True), (3, " ", None, False), (4, "Fine text stays here.", "c", None), (4, "Fine text stays here.", "c", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, is_residue string, keep boolean")
    kept = residue.without_residue(df, "text")
    assert kept.columns == df.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, rows[1:]))
    assert residue.without_residue(df.limit(0), "text").count() == 0
