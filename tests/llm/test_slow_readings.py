"""URL rules and fixed secret patterns against slow readings, character by character."""

import hashlib
import os

import pytest

from tidewater.llm import secret_scan, urls

SMALL = "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VALUE = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey")

needs_tables = pytest.mark.skipif(not os.path.exists(f"{SMALL}/pages.parquet"), reason="no test tables")


def slow_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url[url.index("://") + 3 :]
    i = 0
    while i < len(rest) and rest[i] not in "/?#":
        i += 1
    j = i
    while j < len(rest) and rest[j] not in "?#":
        j += 1
    host, path = rest[:i].translate(LOWER), rest[i:j]
    best = ("", None)
    for of_host, of_path, verdict in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")):
        labels = of_host.split(".")
        if host.split(".")[-len(labels) :] == labels and path[: len(of_path)] == of_path:
            best = max(best, (of_host + of_path, verdict), key=lambda x: len(x[0]))
    return host, path, best[0] or None, best[1]


def hold_urls(rows, out):
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()), key=str)
    assert len(got) == len(rows)
    want = {}
    for page, url in rows:
        want.setdefault(page, []).append(slow_url(url))
    for page, host, path, rule, verdict in got:
        fits = [w for w in want[page] if w[:3] == (host, path, rule)]
        assert fits and verdict == (fits[0][3] or verdict) and verdict in ("allow", "block")


def test_planted_urls(spark):
    texts = [None, "", "://", "a://", "http:/x.net/", "http://x.net", "http://x.net/", "HTTP://X.NET/a", "http://xnet/", "http://.net/", "http://net/?q", "http://example.net/en/", "http://a.example.net/en/x#y", "http://notexample.net/en/", "http://example.com/de/", "http://example.com/DE/", "http://example.com?/de/", "http://a.org/fr/?a://b.net/", "http://a.org#/fr/", "http://É.ORG/fr/", "x://y://z.net/", "http://a\n.net/b\nc", "http://" + "a" * 100_000 + ".net/" + "b/" * 50_000]
    rows = [(i, u) for i, u in enumerate(texts)] + [(5, "http://x.net"), (None, "http://x.org/fr/")]
    hold_urls(rows, urls.judge(spark.createDataFrame(rows, "page_id long, url string")))


@needs_tables
def test_all_urls(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()]
    hold_urls(rows, urls.QUERIES["op9_url_filter"](spark, SMALL))


def slow_assign(text):
    low, out, i = text.translate(LOWER), [], 0
    while i < len(text):
        after = None
        for name in NAMES:
            if low.startswith(name, i):
                j = i + len(name)
                j += text[j : j + 1] in ("'", '"')
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] not in (":", "="):
                    continue
                j += 1
                while text[j : j + 1] == " ":
                    j += 1
                j += text[j : j + 1] in ("'", '"')
                first = j
                while j < len(text) and text[j] in VALUE:
                    j += 1
                if j > first:
                    after = j
                    if j - first >= 6:
                        out.append((i, 0, j))
                    break
        i = after or i + 1
    return out


def slow_runs(text, kind, opening, allowed, least):
    out, i = [], 0
    while i < len(text):
        j = i
        if text.startswith(opening, i):
            j = i + len(opening)
            while j < len(text) and text[j] in allowed:
                j += 1
        if j > i + len(opening):
            if j - i >= least:
                out.append((i, kind, j))
            i = j
        else:
            i += 1
    return out


def slow_base(text):
    text = text or ""
    capitals = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    return sorted(slow_assign(text) + slow_runs(text, 1, "AKIA", capitals, 20) + slow_runs(text, 2, "", set("0123456789abcdef"), 24))


def digest(spans):
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)


def hold_secrets(rows, out):
    """Counts and hashes are those of the slow reading; added spans are apart from the base ones, all of which stay."""
    want = {}
    for doc, text in rows:
        want.setdefault(doc, []).append(slow_base(text))
    got, found = out.collect(), 0
    assert len(got) == len(rows)
    for r in got:
        fits = [w for w in want[r["doc_id"]] if hashlib.sha256(digest(w).encode()).hexdigest() == r["base_sha256"]]
        assert fits, r
        base = fits[0]
        found += len(base)
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == x[1] for x in base) for k in range(3)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert [s for s in spans if not s.startswith("format:")] == (digest(base).split(",") if base else [])
        for s in spans:
            if s.startswith("format:"):
                a, b = map(int, s.split(":")[1:])
                assert all(b <= x or y <= a for x, _, y in base)
    return found


def test_planted_secrets(spark):
    texts = [None, "", "Password: 'abc123'", "PASSWD=abcde", "passwd=abcdef", "token==abcdef", "token = = abcdef", 'api_key":"AKIA' + "A1" * 8, "apikey: 'x", "secrettoken=abcdef", "secret secret:abcdefg password=short token=longer", "AKIA" + "B" * 15, "AKIA" + "B" * 16, "AKIAAKIA" + "B" * 16, "xAKIA" + "9" * 20 + "z", "a" * 23, "a" * 24, "0f" * 12 + "g" + "1" * 30, "é" * 5 + "token:ü" + "token:abcdef", "to\u212aen=abcdef", "paſſword=abcdef", "token:\nabcdef", "token:\tabcdef", "password=" + "abcdef0123456789" * 3, "\U0001f600 secret=abcdef \U0001f600 " + "ab" * 12, "x " * 100_000 + "token=abcdef"]
    rows = list(enumerate(texts)) + [(3, "passwd=abcdef"), (None, "token=abcdef")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert hold_secrets(rows, secret_scan.scan(docs, [])) > 15


@needs_tables
def test_all_secrets(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert hold_secrets(rows, secret_scan.QUERIES["op10_secret_scan"](spark, SMALL)) > 0
