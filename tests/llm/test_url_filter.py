import re

import compare
import pyarrow as pa

from semcorpus.llm import url_filter
from semcorpus.llm.queries import QUERIES


def test_query_against_sql(spark, sf):
    q = QUERIES["op2_url_filter"]
    assert compare.compare(spark, compare.connect(sf), sf, q.run, q.sql) == ""


def test_globs_against_regular_expressions():
    globs = ["*.a.b/**", "a?c", "**x**y", "*", "**", "", "*.é/ü*", "/" * 70, "**" + "ab" * 80 + "**", "a*b*c/**d"]
    pattern = [re.compile("".join({"**": "(?s:.*)", "*": "[^/]*", "?": "."}.get(t, re.escape(t)) for t in re.findall(r"\*\*|\*|\?|[^*?]+", g)), re.S) for g in globs]
    urls = ["", "a", "abc", "a/c", ".a.b/", "x.a.b/c", "x/.a.b/c", "xxyy", "y.é/ü1", "/" * 70, "ab" * 80, "z" + "ab" * 81, "aXbYc/Zd", "a/bc/d", None]
    hit = url_filter.matches(url_filter.compile_globs(globs), pa.array(urls, pa.string()))
    want = [[bool(p.fullmatch(u or "")) for p in pattern] for u in urls]
    assert hit.tolist() == want


def test_odd_urls(spark):
    rows = [
        (1, None, "", "", None, "allow"), (2, "nothing", "", "", None, "allow"), (3, "http://EXAMPLE.org/es/X?q", "example.org", "/es/X", "example.org/es/", "block"),
        (4, "http://a.Example.ORG/en/1?x#y", "a.example.org", "/en/1", "example.org/en/1", "block"), (5, "http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        (6, "http://evil.net/x.example.org/es/", "evil.net", "/x.example.org/es/", None, "allow"), (7, "http://org", "org", "", None, "allow"), (8, "", "", "", None, "allow"),
        (9, "http://a.com:80/de/", "a.com:80", "/de/", None, "allow"), (10, "http://com/de/://x.org/", "com", "/de/://x.org/", "com/de/", "block"),
        (11, "x://m.ads-track.net/", "m.ads-track.net", "/", None, "block"), (11, "x://m.ads-track.net/", "m.ads-track.net", "/", None, "block"), (None, "http://" + "a." * 5000 + "org/" + "p" * 9000, "a." * 5000 + "org", "/" + "p" * 9000, "org/", "allow"),
    ]
    df = spark.createDataFrame([(r[0], r[1], 0, "x") for r in rows], "page_id long, url string, host int, verdict string")
    key = lambda r: (r[0] or 0, r[1] or "")
    found = sorted((tuple(r) for r in url_filter.judged(df).collect()), key=key)
    assert found == sorted(((r[0], *r[2:]) for r in rows), key=key)
    assert url_filter.judged(df.where("false")).count() == 0
    assert {r["verdict"] for r in url_filter.judged(df, rules=(), blocked=()).collect()} == {"allow"}


def test_equal_lengths_prefer_the_longer_host(spark):
    df = spark.createDataFrame([(1, "http://ab.org/xy")], "page_id long, url string")
    row = url_filter.judged(df, rules=(("org/xy", "allow"), ("b.org/", "allow"), ("ab.org", "block"))).first()
    assert (row["rule"], row["verdict"]) == ("ab.org", "block")
