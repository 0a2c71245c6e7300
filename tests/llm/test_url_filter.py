"""Rules, aliases and their precedence."""

from html import unescape
from urllib.parse import urljoin

import duckdb
from pyspark.sql import functions as F

from tallyveil.llm import url_filter

FOLDER = "/root/testdata/sf0.01"


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    names = ["page_id", "host", "path", "rule", "verdict"]
    expected = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({url_filter.ORACLES['op2_url_verdicts']})").fetchall(), key=str)
    assert sorted((tuple(r) for r in url_filter.op2_url_verdicts(spark, FOLDER).select(*names).collect()), key=str) == expected


def test_rules_aliases_and_edge_cases(spark, tmp_path):
    link = "<html><head><LINK href='{}' rel=canonical></head></html>"
    pages = [
        (1, "http://Bad.net/fr/1", ""), (2, "https://alias.org/x?a=1&b=2#top", link.format("http://bad.net/fr/1")),
        (3, "http://chain.org/", "<meta http-equiv='Refresh' content=\"0; URL=https://alias.org/x?a=1&amp;b=2\">"),
        (4, "http://www.example.com/en/ok", link.format("http://bad.net/fr/1")), (5, "http://sub.example.com/en/no", ""), (6, "http://example.com/enx", ""),
        (7, None, None), (8, "no scheme", "x"), (9, "http://net", ""), (10, "http://x.net/es/?q#f", ""), (11, "http://free.org/a", link.format("http://www.example.com/en/ok")),
        (12, "http://notexample.com/en/", ""), (12, "http://notexample.com/en/", ""), (13, "http://far.org/", link.format("http://y.net/es/7")),
    ]
    df = spark.createDataFrame([(*p, "z", 3) for p in pages], "page_id bigint, url string, html string, verdict string, rule int")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r.page_id: r for r in url_filter.judge_urls(df, rules, url_filter.page_links(df)).collect()}
    assert {k: r.verdict for k, r in got.items()} == {
        1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "block", 11: "allow", 12: "allow", 13: "block"
    }
    assert got[1].host == "bad.net" and got[10].path == "/es/" and got[7].host == got[8].path == "" and got[7].rule is None
    assert got[4].rule == "www.example.com/en/" and got[5].rule == "example.com/en/" and got[9].rule is None and got[12].rule == "com/"
    # Without the allowed alias in their group, 2 and 3 are blocked with 1.
    rest = df.filter("page_id NOT IN (4, 11)")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(rest, rules, url_filter.page_links(rest)).collect()}
    assert got[2] == got[3] == "block"
    # The SQL says the same of both tables.
    for name, part in (("all", df), ("rest", rest)):
        part.select("page_id", "url", "html").coalesce(1).write.parquet(str(tmp_path / name))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path / name}/*.parquet'")
        columns = ["page_id", "host", "path", "rule", "verdict"]
        expected = con.execute(f"SELECT {', '.join(columns)} FROM ({url_filter.ORACLES['op2_url_verdicts']})").fetchall()
        mine = url_filter.judge_urls(part, rules, url_filter.page_links(part)).select(*columns).collect()
        assert sorted(expected, key=str) == sorted(map(tuple, mine), key=str)
    empty = df.limit(0)
    assert url_filter.judge_urls(empty, rules, url_filter.page_links(empty)).collect() == []


def test_targets_are_resolved_as_urllib_does(spark):
    bases = ["http://a.net/b/c/d;p?q=1#f", "https://a.net", "http://a.net/b/"]
    targets = ["/en/page", "page.html", "//host.org/path", "?x=1", "#top", "../e", "./e/../g", "../../../g", "..", ".", "g/.", "g/..", "/a/./b/../c?d=../e", "https://z.org/u/../v", "x?y=http://z.org/", "/login?next=http://z.org/"]
    # urllib leaves the dots of a target with a scheme of its own, browsers do not.
    other = {"https://z.org/u/../v": "https://z.org/v"}
    df = spark.createDataFrame([(b, t, other.get(t, urljoin(b, t))) for b in bases for t in targets], "base string, target string, expected string")
    for r in df.select("*", url_filter.resolve(F.col("target"), F.col("base")).alias("got")).collect():
        assert r.got == r.expected, r
    # The fragment-only target of a url without path, and what leads nowhere.
    odd = spark.createDataFrame([("mailto:a@b.c", "http://a.net/"), ("javascript:x", "http://a.net/"), ("/en/", "no scheme"), ("/en/", "")], "target string, base string")
    assert all(r[0] is None for r in odd.select(url_filter.resolve(F.col("target"), F.col("base"))).collect())


def test_character_references(spark):
    texts = ["a&amp;b", "a&amp;#47;b&#47;c", "&#x2F;en&sol;x", "?a=1&copy=2&b=3", "&copy;&copy", "&#233;&#x1F600;&#128;&#0;&#xD800;&#99999999999999999999;", "&nosuch;&", "plain", "&amp", "&#47en"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.got for r in df.select("t", url_filter.decode_references(F.col("t")).alias("got")).collect()}
    # In attributes a name without semicolon before an equals sign is none.
    expected = {t: unescape(t) for t in texts} | {"?a=1&copy=2&b=3": "?a=1&copy=2&b=3"}
    assert got == expected


def test_relative_links_carry_blocks(spark):
    link, refresh = "<link rel='canonical' href='{}'>", "<meta http-equiv=refresh content='0;url={}'>"
    pages = [
        (1, "http://x.net/en/1", link.format("/fr/1")), (2, "http://x.net/a/2", refresh.format("../fr/2")), (3, "http://y.org/3", link.format("//x.net/fr/3")),
        (4, "http://y.org/4", "<base href='http://x.net/fr/'>" + link.format("page.html")), (5, "http://y.org/5", "<base target=_top><base href='//x.net'>" + refresh.format("&#47;fr&sol;5")),
        (6, "http://x.net/en/6", link.format("/en/66")), (7, "http://x.net/en/7", link.format("mailto:a@x.net/fr/")), (8, None, link.format("/fr/8")), (9, "http://x.net/en/9", link.format("?next=http://x.net/fr/9")),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    got = {r.page_id: r.verdict for r in url_filter.judge_urls(df, rules, url_filter.page_links(df)).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow"}
