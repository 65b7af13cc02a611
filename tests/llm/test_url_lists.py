from __future__ import annotations

import datetime

import duckdb

from factloom.llm import url_lists as U


def test_intervals_and_precedence(spark):
    entries = spark.createDataFrame([("example.com", "block", "2024-01-10"), ("example.com", "remove", "2024-02-01"), ("good.example.com", "allow", "2024-01-15"), ("good.example.com/x", "block", "2024-01-20"), ("same.org", "allow", "2024-01-01"), ("same.org", "block", "2024-01-01"), (None, "block", "2024-01-01"), ("old.org", "block", "1990-01-01")], "key string, action string, since string")
    seen = [("http://example.com/a", "2024-01-09"), ("http://example.com/a", "2024-01-10"), ("http://EXAMPLE.com:80/a", "2024-01-31"), ("http://example.com/a", "2024-02-01"), ("https://u@a.good.example.com/x", "2024-01-14"), ("https://good.example.com/y?q", "2024-01-21"), ("https://good.example.com/x/z", "2024-01-21"), ("http://badexample.com/", "2024-01-20"), ("ftp://same.org", "2024-06-01"), (None, "2024-01-10"), ("http://example.com/a", None), ("nonsense", "2024-01-10"), ("http://old.org/", "2024-01-01")]
    out = {r.page_id: r.verdict for r in U.filter_urls(spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(seen)], "page_id long, url string, fetched_on string"), entries).collect()}
    assert [out[i] for i in range(len(seen))] == ["none", "block", "block", "none", "block", "allow", "block", "none", "block", "none", "none", "none", "block"]


def test_case_of_segments(spark):
    entries = spark.createDataFrame([("GitHub.com/UserName", "block", "2024-01-01"), ("site.org/Wiki", "block", "2024-01-01"), ("site.org/wiki", "allow", "2024-01-01"), ("site.org", "allow", "2024-01-01"), ("UPPER.org", "block", "2024-01-01")], "key string, action string, since string")
    seen = ["https://github.com/UserName/x", "https://github.com/username", "http://SITE.org/Wiki/a", "http://site.org/wiki", "http://upper.ORG/a"]
    out = U.filter_urls(spark.createDataFrame([(i, u, "2024-02-01") for i, u in enumerate(seen)], "page_id long, url string, fetched_on string"), entries).orderBy("page_id").collect()
    assert [(r.verdict, r.key) for r in out] == [("block", "github.com/UserName"), ("none", None), ("block", "site.org/Wiki"), ("allow", "site.org/wiki"), ("block", "upper.org")]


def test_hosts_and_far_days(spark):
    entries = spark.createDataFrame([("example.com.", "block", "2024-01-01"), ("[2001:DB8::1]/x", "block", "2024-01-01"), ("3.4", "block", "2024-01-01"), ("1.2.3.4", "allow", "2024-01-01"), ("late.org", "block", "2099-01-01"), ("old.org", "block", "1700-01-01")], "key string, action string, since string")
    seen = [("http://a.EXAMPLE.com./", "2024-02-01"), ("http://[2001:db8::1]:80/x/y", "2024-02-01"), ("http://[2001:db8::1]/z", "2024-02-01"), ("http://1.2.3.4:8/", "2024-02-01"), ("http://9.8.3.4/", "2024-02-01"), ("http://late.org/", "2150-06-01"), ("http://late.org/", "2098-12-31"), ("http://u:p@x@late.org/a@b", "9999-12-31"), ("http://old.org?x", "1800-01-01")]
    out = U.filter_urls(spark.createDataFrame([(i, u, d) for i, (u, d) in enumerate(seen)], "page_id long, url string, fetched_on string"), entries).orderBy("page_id").collect()
    assert [r.verdict for r in out] == ["block", "block", "none", "allow", "none", "block", "none", "block", "block"]


def test_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    wanted = con.sql(U.ORACLE).fetchall()
    out = U.op5_url_lists(spark, sf)
    assert sorted(map(str, (tuple(r) for r in out.select("page_id", "host", "fetched_on", "verdict", "key", "since").collect()))) == sorted(map(str, wanted))


def test_odd_input(spark):
    entries = spark.createDataFrame([("a.b", "block", datetime.date(2024, 1, 1))], "key string, action string, since date")
    captures = spark.createDataFrame([(1, "http://a.b/", "2024-01-01", "clash"), (1, "http://a.b/", "2024-01-01", "clash"), (None, "http://" + "x." * 5_000 + "a.b/", "2024-01-01", "clash")], "page_id long, url string, fetched_on string, key string")
    assert sorted(r.verdict for r in U.filter_urls(captures, entries).collect()) == ["block", "block", "none"]
    assert U.filter_urls(captures.limit(0), entries).count() == 0 and U.filter_urls(captures, entries.limit(0)).filter("verdict = 'none'").count() == 3
