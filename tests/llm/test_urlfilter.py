import re

import pytest

from vectorloom.llm import urlfilter
from vectorloom.llm.urlfilter import HOST_PATH_RULES, PATTERN_RULES, parse, url_filter

URLS = [
    None, "", "no scheme", "http://Example.ORG/es/1?x", "http://a.example.org/en/17#t", "http://a.example.org/en/27", "http://notexample.org/es/", "http://x.com/fr/", "http://x.com/FR/",
    "http://com/de/x", "http://x.com/de", "https://spam-farm.example.net/en", "https://www.spam-farmer.example.net/", "http://h?x/org/", "http://a.org:80/es/", "http://org/", "a://b://c.org/x",
    "http://x.net/casino/1", "http://x.net/CASINO", "http://x.net/casinos", "http://ñ.org/é",
]


def brute(url):
    """Every rule on every url."""
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER)), m[2]) if m else ("", "")
    fits = []
    for line in HOST_PATH_RULES:
        action, text = line.split(" ")
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(text), text, action))
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    folded = (url or "").translate(str.maketrans(urlfilter.UPPER, urlfilter.LOWER))
    hit = any(re.search(f"(?:^|[^a-z0-9]){re.escape(x.split('^')[1])}(?:$|[^a-z0-9])", folded) for x in PATTERN_RULES)
    return host, path, None, "block" if hit else "allow"


def test_like_brute_force(spark):
    rows = [(i, u, "x") for i, u in enumerate(URLS)] + [(3, URLS[3], "again"), (None, URLS[4], None)]
    got = url_filter(spark.createDataFrame(rows, "page_id bigint, url string, verdict string"), HOST_PATH_RULES + PATTERN_RULES).collect()
    want = sorted((str(i), *map(str, brute(u))) for i, u, _ in rows)
    assert sorted(tuple(map(str, r)) for r in got) == want


def test_rules():
    assert parse("block ^a-b^*c^").tokens == ("a", "b")
    assert parse("block *ads*").tokens == ()
    assert parse("block example.org/en/1").tokens == ("example", "org", "en")
    for bad in ("deny x/", "block", "block host"):
        with pytest.raises(ValueError):
            parse(bad)


def test_no_rules_and_no_rows(spark):
    assert url_filter(spark.createDataFrame([], "page_id bigint, url string"), HOST_PATH_RULES).count() == 0
    assert [r.verdict for r in url_filter(spark.createDataFrame([(1, "http://a.org/")], "page_id bigint, url string"), ["block *nothing*"]).collect()] == ["allow"]
