from pyspark.sql import functions as F

from hopscope.llm import url_filters as uf

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def rows_of(spark, urls, **options):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    return {r.page_id: r for r in uf.judge_urls(pages, RULES, **options).collect()}


def test_parts_and_rules(spark):
    cases = [
        ("http://WWW.Example.ORG/es/x?q#f", "www.example.org", "/es/x", "example.org/es/", "block"),
        ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("x://example.org", "example.org", "", None, "allow"),
        ("http://badexample.org/es/", "badexample.org", "/es/", "org/", "allow"),
        ("http://a.com/de/1", "a.com", "/de/1", "com/de/", "block"),
        ("http://a.com/fr/://b.net/x", "a.com", "/fr/://b.net/x", "com/fr/", "allow"),
        ("http://a.com?x=/de/", "a.com", "", None, "allow"),
        ("ÀB://ÉX.net#/p", "Éx.net", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("://", "", "", None, "allow"),
        ("http://com/fr/", "com", "/fr/", "com/fr/", "allow"),
    ]
    got = rows_of(spark, [c[0] for c in cases])
    assert [(got[k].host, got[k].path, got[k].rule, got[k].verdict) for k in range(len(cases))] == [c[1:] for c in cases]


def test_alike_branches_merge_and_pure_ones_are_rejected(spark):
    """Branches merge by their share of blocked urls, at any depth; unlabelled ones have their siblings' purity."""
    urls = [f"http://h.net/a/b/c/{d}/{k}/x" for d in ("spam", "junk", "ok", "fine", "new") for k in range(100, 400)]
    rules = [("block", f"h.net/a/b/c/{d}/{k}") for d in ("spam", "junk") for k in range(100, 130)]
    rules += [("allow", f"h.net/a/b/c/{d}/{k}") for d in ("ok", "fine") for k in range(100, 130)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    out = uf.judge_urls(pages, rules).collect()
    free = [r for r in out if r.rule is None]
    assert len(free) == 1500 - 120 and {r.verdict for r in out if r.rule} == {"allow", "block"}
    for r in free:
        bad = "/spam/" in r.path or "/junk/" in r.path
        assert (r.verdict, r.template) == (("block", "/a/b/c/*2/**") if bad else ("allow", None)), r


def test_host_of_blocked_urls_only(spark):
    """A host whose labelled urls are all blocked loses its unlabelled ones, if there are enough labels."""
    for n, verdict in ((200, "block"), (5, "allow")):
        got = rows_of(spark, [*[f"http://h.com/de/{k}" for k in range(n)], *[f"http://g.com/fr/{k}" for k in range(n)], "http://h.com/it/7", "http://g.com/it/7"])
        assert (got[2 * n].verdict, got[2 * n + 1].verdict) == (verdict, "allow")


def test_segment_classes(spark):
    cases = {"12": "{n}", "2024-01-02": "{n}", "7.html": "{n}.html", "deadbeef01": "{h}", "a-long-title": "{s}", "news": "news", "abcdefgh": "abcdefgh"}
    frame = spark.createDataFrame([(c,) for c in cases], "s string").select("s", uf.segment_class(F.col("s")).alias("c"))
    assert {r.s: r.c for r in frame.collect()} == cases


def test_edge_tables(spark):
    pages = spark.createDataFrame([(1, "http://a.org/x")] * 3 + [(None, None), (2, "http://a.net/" + "s/" * 5000)], "page_id long, url string")
    got = uf.judge_urls(pages, RULES).collect()
    assert len(got) == 5 and all(r.verdict in ("allow", "block") for r in got)
    assert uf.judge_urls(pages.limit(0), RULES).count() == 0
    assert {r.verdict for r in uf.judge_urls(pages, []).collect()} == {"allow"}
