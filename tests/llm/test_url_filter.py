"""URL rules against a plain matcher, and the cascade's exactness over its universe."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from churnscope.llm import url_filter as U

SCHEMA = "page_id long, url string, rule string, host string, h1 string"


def plain(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    tail = rest[end:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h) + len(p), len(h), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[2:] if fits else (None, "allow")))


URLS = [
    None, "", "no scheme/en/", "http://", "http:///en/", "http://example.com", "http://example.com/", "HTTP://EXAMPLE.COM/en/x?y#z", "http://www.example.com/en/", "http://notexample.com/en/",
    "http://example.com?/en/", "http://example.com#/en/", "x://a.b.net/fr/", "ftp://net/es/1", "http://.net/fr/", "http://net./fr/", "http://É.Net/ES/", "http://a://b.net/fr/", "http://com", "http://example.com/en",
    "http://user@h.net:80/fr/", "http://h.net\n/fr/", "http://" + "s." * 3000 + "net/fr/" + "p" * 9000,
]


def judged(spark, urls, rules):
    rows = [(i, u, "clash", "clash", "clash") for i, u in enumerate(urls)]
    got = U.filter_urls(spark.createDataFrame(rows, SCHEMA), rules).collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in sorted(got, key=lambda r: r.page_id)]


def test_rules_of_the_query(spark):
    urls = URLS + URLS[5:8]
    assert judged(spark, urls, U.RULES) == [plain(u, U.RULES) for u in urls]


def test_many_rules_and_keys(spark):
    rng = np.random.default_rng(0)
    hosts = [f"h{i}.{d}" for i in range(60) for d in ("com", "net", "org.uk")]
    rules = sorted({(h, p) for h in [*hosts[:90], "com", "uk"] for p in rng.choice(["/", "/a/", "/a/b", "/a/bc/", ""], 3)})
    rules = [(["allow", "block"][int(rng.integers(2))], h, p) for h, p in rules]
    urls = [f"http://{'w.' * int(rng.integers(3))}{rng.choice(hosts)}{rng.choice(['', '/', '/a/', '/a/bc/d', '/x'])}{rng.choice(['', '?q', '#f'])}" for _ in range(3000)]
    assert judged(spark, urls, rules) == [plain(u, rules) for u in urls]


def test_empty_table_and_no_rules(spark):
    assert judged(spark, [], U.RULES) == []
    assert judged(spark, ["http://net/fr/"], []) == [("net", "/fr/", None, "allow")]


def test_cascade_is_exact_for_its_universe(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-(2**63), 2**63 - 1, (20_000, 2))
    listed = np.arange(len(keys)) % 9 == 0
    df = spark.createDataFrame([(int(a), int(b), bool(c)) for (a, b), c in zip(keys, listed)], "h1 long, h2 long, listed boolean")
    levels = U.build_cascade(df)
    assert len(levels) > 2
    assert (U.contains(levels, keys[:, 0].astype(np.uint64), keys[:, 1].astype(np.uint64)) == listed).all()
    assert sum(8 * len(w) for _, _, w in levels) < 4 * listed.sum()  # bytes


@given(st.integers(0, 2**63), st.integers(0, 2**63), st.integers(64, 10**6), st.integers(1, 20))
@settings(max_examples=50)
def test_places_are_inside(a, b, bits, hashes):
    at = U._places(np.array([a], np.uint64), np.array([b], np.uint64), 3, bits, hashes)
    assert at.shape == (1, hashes) and (at < bits).all()
