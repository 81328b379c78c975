from varkit.llm.url_filter import bad_host_urls, judge_urls

URLS = [(1, "http://A.example.NET/en/x?q#f"), (2, "https://net/de"), (3, "http://example.com/de/1"), (4, "ftp://b.org/fr/"), (5, None), (6, "no scheme"),
        (7, "http://xnet/"), (8, "http://www.b.org/p/"), (9, "http://b.org/p"), (10, "http://example.net"), (11, "http://x.org/a\nb"), (11, "http://x.org/a\nb"), (None, "http://b.org/p")]


def _judge(spark, listed, **kw):
    df = spark.createDataFrame([(*u, "c", "d") for u in URLS], "page_id long, url string, host string, verdict string")
    return judge_urls(df, spark.createDataFrame([(x,) for x in listed], "url string"), **kw).collect()


def test_rules_hosts_and_lists(spark):
    rows = _judge(spark, ["https://b.org/p/?utm_source=x&ref=y#z", "http://elsewhere.org/", None])
    by = {r.page_id: r for r in rows}
    assert len(rows) == len(URLS)
    assert (by[1].host, by[1].path, by[1].rule, by[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (by[2].rule, by[2].verdict) == ("net/", "block")
    assert (by[3].rule, by[3].verdict) == ("example.com/de/", "block")
    assert (by[4].rule, by[4].verdict) == ("org/fr/", "allow")
    assert (by[5].host, by[5].path, by[5].rule, by[5].verdict) == ("", "", None, "allow") and by[6].host == ""
    assert by[7].rule is None and by[10].path == "" and by[10].rule is None
    assert by[8].verdict == by[9].verdict == by[None].verdict == "block" and by[8].is_listed
    assert by[11].path == "/a\nb" and by[11].verdict == "allow"


def test_false_positives_are_removed(spark):
    """One block for many URLs: nearly everything passes the filter, and the verdicts stay right."""
    listed = [f"http://h{i}.org/{i}" for i in range(3000)]
    loose = _judge(spark, listed + ["http://b.org/p"], max_blocks=1)
    tight = _judge(spark, listed + ["http://b.org/p"])
    key = lambda r: (str(r.page_id), r.host, r.verdict, r.is_listed)
    assert sorted(map(key, loose)) == sorted(map(key, tight))
    assert sum(r.passed_filter for r in loose) > sum(r.passed_filter for r in tight)
    assert all(r.passed_filter for r in loose if r.is_listed)


def test_empty(spark):
    assert all(not r.is_listed for r in _judge(spark, []))
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert judge_urls(none, bad_host_urls(none)).count() == 0


def test_queries_that_tell_pages_apart_and_bad_hosts(spark):
    pages = spark.createDataFrame([(1, "http://a.org/index?id=1&utm_source=x"), (2, "http://a.org/index?ref=r&id=1"), (3, "http://a.org/index?id=2"), (4, "http://a.org/index"),
                                   (5, "http://www.Free-Bets.org/en/1"), (6, "http://alphabets.org/"), (7, None), (8, "http://b.org/" + "x" * 300_000 + "?id=1")],
                                  "page_id long, url string")
    by = {r.page_id: r for r in judge_urls(pages, spark.createDataFrame([("http://a.org/index?id=1",)], "url string")).collect()}
    assert [i for i in by if by[i].is_listed] == [1, 2] and by[1].canonical_url == by[2].canonical_url == "a.org/index?id=1"
    assert by[8].canonical_url.endswith("x?id=1") and len(by) == 8
    assert [r.url for r in bad_host_urls(pages).collect()] == ["http://www.Free-Bets.org/en/1"]


def test_only_hits_are_shuffled(spark):
    """Rows that the filter stops pass by the exact join: the branch of the misses holds no exchange but the filter's."""
    from varkit.llm.url_filter import bloom_blocks, probe
    urls = spark.createDataFrame([(i, f"u{i}") for i in range(100)], "page_id long, c string")
    stopped = probe(urls, "c", bloom_blocks(urls.where("page_id < 3"), "c", 1), 1).where("NOT _maybe")
    plan = stopped._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
