"""URL filters: rules, edges from html and a table, components, precedence; against brute force and SQL."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gustfield.llm import urls
from gustfield.llm.queries import ORACLES, QUERIES

link = '<html><LINK href="{}" rel="canonical"></html>'.format
meta = "<meta http-equiv='Refresh' content='0; URL={}'>".format


def hub(n):
    return [(f"http://alias{i}.net/x", link("https://hub.net/")) for i in range(n)]


def chain(n):
    return [(f"http://c.net/{i}", meta(f"/{i + 1}")) for i in range(n)]


PAGES = [
    (None, None), ("", ""), ("no scheme", link("http://b.example.com/de/1")), ("http://", "x"), ("://h/p", None),
    ("HTTP://WWW.Example.ORG/es/1?x#y", None), ("http://example.org/en/1", None), ("http://example.org/en/2", None), ("http://example.org", ""), ("http://badexample.org/es/", None),
    ("http://a.com/de/1#top", None), ("http://b.com/fr/1", link("//a.com/de/1?z=1&amp;y=2")), ("http://a.com/de/1?z=1&y=2", None), ("http://c.net/start", meta("http://b.com/fr/1")),
    ("http://c.net/start#again", None), ("https://d.net/dir/page?q=1", link("other")), ("https://d.net/dir/other", meta("?r=2")), ("https://d.net/dir/other?r=2", link("http://e.com/de/")),
    ("http://free.net/a", link("http://free.net/b")), ("http://free.net/b", "<p>" * 20_000 + meta("http://free.net/c")), ("http://f.net/ü?a://b", link("http://f.net/" + "y" * 5000)), ("http://f.net/ü?a://b", "<link rel=stylesheet href=http://a.com/de/1>"),
    *chain(40), ("http://c.net/40", link("http://z.com/de/end")), *hub(60), ("https://hub.net", link("http://g.com/de/")),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pages"))
    rows = spark.createDataFrame([(i, u, h, "c", True) for i, (u, h) in enumerate(PAGES)], "page_id long, url string, html string, component string, moved boolean")
    rows.coalesce(2).write.parquet(f"{d}/full/pages.parquet")
    rows.where("false").write.parquet(f"{d}/none/pages.parquet")
    return d


def rows(df):
    return [(r.host, r.path, r.rule, r.verdict) for r in df.orderBy("page_id").collect()]


def test_brute_force_and_sql(spark, folder):
    got = rows(QUERIES["op11_url_filters"](spark, f"{folder}/full"))
    assert got == urls.brute_force(PAGES)
    assert {r[3] for r in got[-61:-1]} == {"block"} and {r[3] for r in got[22:63]} == {"block"}
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/full/pages.parquet/*.parquet'")
    assert [tuple(r) for r in con.sql(f"select host, path, rule, verdict from ({ORACLES['op11_url_filters']}) order by page_id").fetchall()] == got


def test_empty(spark, folder):
    assert QUERIES["op11_url_filters"](spark, f"{folder}/none").count() == 0


def test_columns_pass(spark, folder):
    pages = spark.read.parquet(f"{folder}/full/pages.parquet").withColumn("Host", F.lit("mine"))
    got = urls.judge(pages)
    assert got.columns == ["page_id", "url", "html", "component", "moved", "host", "path", "rule", "verdict"]
    assert got.where("component = 'c' and moved").count() == len(PAGES)


def test_redirect_table_and_rules(spark):
    r = random.Random(5)
    names = [f"http://{r.choice('abcdefgh')}.net/{r.randrange(40)}" for _ in range(120)] + [f"http://bad.org/{i}" for i in range(4)] + [f"http://good.org/{i}" for i in range(9)]
    log = [(r.choice(names), r.choice(names)) for _ in range(60)] + [(None, names[0]), (names[1], None), (names[2], names[2])]
    rules = [("block", "bad.org", ""), ("allow", "good.org", "/"), ("block", "good.org", "/1")]
    pages = spark.createDataFrame(list(enumerate(names)), "page_id long, url string")
    got = rows(urls.judge(pages, rules, html=None, redirects=spark.createDataFrame(log, "src string, dst string")))
    assert got == urls.brute_force([(n, None) for n in names], rules, log)
    assert {"allow", "block"} == {g[3] for g in got if g[2] is None}


def test_plan_is_native(spark, folder):
    plan = QUERIES["op11_url_filters"](spark, f"{folder}/full")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
