"""Boundary rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from pagelode.functions import redact as X
from pagelode.functions import urls as U
from pagelode.functions.hashing import fnv1a
from pagelode.operators import actions, capture, tasks


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


NORMAL = {
    "https://A.Com/x#a": "https://a.com/x", "https://a.com/x#/r": "https://a.com/x#/r", "https://a.com/x/#!/r": "https://a.com/x#!/r",
    "http://a.com/index.HTML": "http://a.com", "http://a.com/d/index.php?b=1&a=2": "http://a.com/d/?a=2&b=1",
    "http://a.com/?b=2&a=1&b=1": "http://a.com/?a=1&b=2&b=1", "http://a.com/p?utm_X=1&REF=2&q=1": "http://a.com/p?q=1",
    "http://a.com/p/?ref=1": "http://a.com/p", "https://a.com:443/x/": "https://a.com/x", "https://a.com:80/x": "https://a.com:80/x",
    "http://a.com/a/../b/./c": "http://a.com/b/c", "http://a.com/für x": "http://a.com/f%C3%BCr%20x", "not a url": None, "mailto:x@y.z": None,
    "http://a.com/?q=a%20b": "http://a.com/?q=a+b", "http://a.com/?flag": "http://a.com/?flag=",
}


def test_normalize_url(spark):
    got = values(spark, U.normalize_url, NORMAL)
    assert got == list(NORMAL.values())
    again = values(spark, U.normalize_url, [g for g in got if g])
    assert again == [g for g in got if g]


def test_resolve(spark):
    refs = ["/r", "s", "?q=1", "#h", "//o.org/x", "http://z.z/", "mailto:a@b"]
    got = values(spark, lambda c: U.resolve(F.lit("https://a.com/d/p?x=1"), c), refs)
    assert got == ["https://a.com/r", "https://a.com/d/s", "https://a.com/d/p?q=1", "https://a.com/d/p?x=1#h", "https://o.org/x", "http://z.z/", "mailto:a@b"]


def test_next_page(spark):
    urls = ["http://a.com/?page=x", "http://a.com/?offset=5", "http://a.com/?p=3&page=1", "http://a.com/"]
    assert values(spark, U.next_page, urls) == ["http://a.com/?page=2", "http://a.com/?offset=25", "http://a.com/?p=3&page=2", "http://a.com/?page=2"]


def test_names(spark):
    assert values(spark, U.site_name, ["https://app.notion.so", "www.app", "https://api.www.dev/", "x"]) == ["notion", "app", "dev", "x"]
    assert values(spark, U.file_slug, ["https://a.com/", "https://a.com/A b/page/" + "x" * 70]) == ["home", "a-20b-" + "x" * 70]
    assert values(spark, U.page_slug, ["https://a.com/models/GPT_2/", "https://a.com", "junk"]) == ["models-gpt-2", "home", "home"]


@pytest.mark.parametrize("text,kept", [
    ("a" * 39, True), ("a1" * 20, False), ("1" * 40, True), ("abcdefghij" * 4, True), ("Abcdefghi1" * 4, False), ("eyJhbGciOi", True)])
def test_secret_lengths(spark, text, kept):
    out = values(spark, X.redact_secrets, [f"see {text} here"])[0]
    assert (text in out) == kept


def test_secret_shapes(spark):
    got = values(spark, X.redact_secrets, ["short", "use eyJhbGciOiJI.abcdef.ghijkl now", "token abcdefghijkl", "Bearer abcdefghijkl.mn"])
    assert got == ["short", "use [REDACTED] now", "token [REDACTED]", "Bearer [REDACTED]"]


def test_normalize_text(spark):
    rows = ["n 123456789 1234567890 12345678901 1234567890123", "é1234567890", "$1,299 id=42", "123E4567-e89b-12d3-a456-426614174000",
            "2024-05-06T07:08:09.1+02:00", "a.b+c@d-e.fr", "Bearer x.y-z", "sk-abcdefghijk", "cafe0123deadbeef"]
    got = values(spark, X.normalize_text, rows)
    assert got == ["n 123456789 {{EPOCH}} 12345678901 {{EPOCH}}", "é{{EPOCH}}", "$1,299 id=42", "{{UUID}}", "{{TIMESTAMP}}", "{{EMAIL}}",
                   "Bearer {{TOKEN}}", "{{TOKEN}}", "{{HEX}}"]
    assert values(spark, X.normalize_text, got) == got


def test_normalize_html(spark):
    assert values(spark, X.normalize_html, ["<a nonce='x' integrity=\"y\" z='w'>"]) == ["<a nonce='' integrity=\"\" z='w'>"]


def plain_fnv(text):
    h = 0x811C9DC5
    raw = text.encode("utf-16-be")
    for i in range(0, len(raw), 2):
        h = ((h ^ int.from_bytes(raw[i:i + 2], "big")) * 16777619) & 0xFFFFFFFF
    return f"{h:08x}"


def test_fnv(spark):
    words = ["", "a", "été", "\U0001F600x", "longer text 123"]
    assert values(spark, fnv1a, words) == [plain_fnv(w) for w in words]


def test_retry_after(spark):
    now = 1704067230000
    rows = ["120", "2", "-1", "Mon, 01 Jan 2024 00:00:40 GMT", "Mon, 01 Jan 2024 00:00:10 GMT", "junk", ""]
    got = values(spark, lambda c: capture.retry_after_ms(c, F.lit(now)), rows)
    assert got == [30000, 2000, None, 10000, 0, None, None]


def test_salient(spark):
    rows = ["x", "xy", "x" * 80, "x" * 81, "https://a", "TRUE", "---", "2024-01-01T00"]
    assert values(spark, tasks.is_salient, rows) == [False, True, True, False, False, False, False, False]


def test_click_risk(spark):
    rows = ["Sign out", "Payload", "Pay", "Delete", "Open"]
    safe = values(spark, lambda c: actions.click_risk(c, F.lit(False), F.lit(False)), rows)
    assert [bool(v) for v in safe] == [True, False, True, True, False]
    bold = values(spark, lambda c: actions.click_risk(c, F.lit(False), F.lit(True)), rows)
    assert [bool(v) for v in bold] == [True, False, True, False, False]


BOUNDARIES = ["sk-" + "a1" * 12, "xsk-" + "a1" * 12, "_AKIA" + "B" * 16, "é1234567890", "x1234567890", " 1234567890.", "12345678901", "in 3 days", "begin 3 days",
              "a day ago, an hour ago", "banana day ago", "just now; adjust now", "1,234 likes", "x1,234", "a@b.co -.x@y.de", "nonce='a' xnonce='b' data-nonce=\"c\"",
              "abcdefab-abcd-abcd-abcd-abcdefabcdef", "gabcdefabcdefabcdef abcdefabcdefabcdef", "<p>a week ago</p><p title='1,234'>1,234</p> an", "3.5k 3.5km x3k", "",
              "\"api_key\": \"123456789\" \"PASSWORD\":\"abcdefghi\"", "Bearer " + "t" * 24 + " xBearer " + "t" * 24, "hf_" + "q" * 24 + " ghp_" + "r" * 24, None]


@pytest.mark.parametrize("name", ["scrub_html", "normalize_text", "normalize_html", "stabilize_text", "stabilize_html"])
def test_cheaper_boundaries_and_guards_change_nothing(spark, monkeypatch, name):
    got = values(spark, getattr(X, name), BOUNDARIES)
    monkeypatch.setattr(X, "_opened", lambda pattern: pattern)
    monkeypatch.setattr(X, "_guarded", lambda text, guard, pattern, mark: F.regexp_replace(text, pattern, mark))
    monkeypatch.setattr(X, "_CHANGES", "(?s)^")
    assert values(spark, getattr(X, name), BOUNDARIES) == got


def test_no_place_of_a_text_tests_both_sides_of_a_boundary():
    rules = [p for p, _ in X.R.VOLATILE_TEXT + X.R.VOLATILE_COUNTS + X.R.HTML_SECRETS]
    left = [p for p in rules if p.removeprefix("(?i)").startswith(X.R.B) and X._opened(p) == p]
    assert left == [p for p in rules if "@" in p and r"[\w.+-]" in p]


def test_collapse_equals_the_plain_rule(spark):
    from pyspark.sql import functions as F
    from pagelode.functions.core import WS, collapse
    texts = ["a b", "a  b", "a \t b", "\ta\n", " a b ", "a  b", "　", "", "a ﻿", "x\r\ny  z ", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(collapse(F.col("t")), F.trim(F.regexp_replace("t", WS + "+", " "))).collect()
    assert all(a == b for a, b in got)
    assert "&&[^ ]" in str(collapse(F.col("t")))
