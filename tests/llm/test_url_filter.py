import random
from urllib.parse import urljoin

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from granary.llm.components import components
from granary.llm.url_filter import OP7_SQL, alias_edges, judge, resolved


def brute_components(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {x: root(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    edges += [(200, 201 + i) for i in range(50)] + edges[:5]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == brute_components(edges)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rules_and_aliases(spark):
    link = '<link href="{}" rel="canonical">'
    pages = [
        (1, "http://a.net/es/1", None, "x"),  # blocked by rule
        (2, "http://b.org/1", link.format("http://a.net/es/1?x=1&amp;y=2"), "x"),  # alias of a blocked url: block
        (3, "http://c.org/1", '<META HTTP-EQUIV="refresh" CONTENT="0; URL=http://b.org/1">', "x"),  # over two steps
        (4, "http://www.example.com/en/9", link.format("http://b.org/1"), "x"),  # allowed by its own rule
        (5, "http://d.org/2", link.format("http://e.net/fr/2"), "x"),
        (6, "HTTP://X.Example.COM/en/3", "", "x"),
        (7, "no scheme", None, None),
        (8, None, None, None),
        (5, "http://d.org/2", link.format("http://e.net/fr/2"), "x"),
    ]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, verdict string")
    found = {r.page_id: r for r in judge(frame, alias_edges(frame)).collect()}
    assert judge(frame, alias_edges(frame)).count() == len(pages)
    verdicts = {k: r.verdict for k, r in found.items()}
    # the component of 1 to 4 holds an explicit allow, which goes before its blocks; own rules stay
    assert verdicts == {1: "block", 2: "allow", 3: "allow", 4: "allow", 5: "block", 6: "block", 7: "allow", 8: "allow"}
    assert (found[6].host, found[6].path, found[6].rule) == ("x.example.com", "/en/3", "example.com/en/")
    assert (found[7].host, found[7].path, found[7].rule) == ("", "", None)


def test_relative_targets_as_the_standard_library_resolves_them(spark):
    bases = ["http://a.org/b/c/d?q=1#f", "https://a.org", "http://a.org?x", "http://a.org/b/"]
    targets = ["/x", "//h.net/x", "x", "./x", "../x", "../../../x?y=/../z", "..", ".", "x/../y/./z/..", "?n=2", "http://k.org/a/../b", "/x?u=http://y/", "x#y/../z"]
    rows = [(b, t, urljoin(b, t) if "://k.org" not in t else t) for b in bases for t in targets]
    found = spark.createDataFrame(rows, "base string, target string, right string").select("base", "target", "right", resolved(F.col("base"), F.col("target")).alias("got"))
    assert [r for r in found.collect() if r.got != r.right] == []


def test_targets_that_lead_nowhere(spark):
    rows = [("http://a.org/b", t) for t in ("", "#x", "mailto:a@b.org", "javascript:void(0)", None)] + [("no scheme", "/x"), (None, "/x")]
    assert [r.got for r in spark.createDataFrame(rows, "base string, target string").select(resolved(F.col("base"), F.col("target")).alias("got")).collect()] == [None] * len(rows)


def test_all_links_of_a_page_and_the_sql(spark):
    many = '<link rel=canonical href="http://e.org/none"><link href=/es/2 rel="canonical"><link rel="stylesheet" href="/es/9">'
    rows = [
        (1, "http://a.net/es/1", None),
        (2, "http://b.net/x", many),  # its second link is a path that is blocked
        (3, "http://c.org/y/z", '<base href="//a.net/es/"><link rel="canonical" href="../es/1">'),
        (4, "http://d.org/", '<meta content="0; url=http://b.net/x" http-equiv="refresh"><meta http-equiv=refresh content="1;url=//f.org/q?a=1&#38;b=2">'),
        (5, "http://f.org/q?a=1&b=2", ""),
        (6, "http://g.org/a", '<link rel="canonical" href="#top">'),
        (7, None, many),
        (8, "no scheme", '<link rel="canonical" href="/es/1">'),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = alias_edges(frame)
    assert {(r.a, r.b) for r in edges.collect()} == {
        ("http://b.net/x", "http://e.org/none"), ("http://b.net/x", "http://b.net/es/2"), ("http://c.org/y/z", "http://a.net/es/1"),
        ("http://d.org/", "http://b.net/x"), ("http://d.org/", "http://f.org/q?a=1&b=2"),
    }
    found = {r.page_id: (r.rule, r.verdict) for r in judge(frame, edges).collect()}
    assert {k: v for k, (_, v) in found.items()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow"}
    pages = pd.DataFrame(rows, columns=["page_id", "url", "html"])  # noqa: F841
    assert {k: (rule, verdict) for k, rule, verdict in duckdb.sql(f"select page_id, rule, verdict from ({OP7_SQL})").fetchall()} == found


def test_no_pages(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    assert judge(frame, alias_edges(frame)).count() == 0


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame([(1, "http://a.net/es/1", "")], "page_id long, url string, html string")
    plan = judge(frame, alias_edges(frame))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
