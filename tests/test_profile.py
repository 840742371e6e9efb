"""Links, prose, degrees, titles, page parsing and conversation steps on single values: nulls, empty and odd ones."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.functions import profile as Q
from lodestone.operators import agent as G
from lodestone.operators import relational as J
from lodestone.sources import html as H


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize("f", [Q.links, Q.portfolio, Q.place, Q.title_slot, Q.safe_metadata, lambda x: Q.longest_prose(x, x, F.array(x)), lambda x: Q.unsupported_facts(x, x), lambda x: Q.free_items(x, x, F.array(x))])
def test_null_and_empty(spark, f):
    for v in (None, ""):
        assert one(spark, v, f) in (None, [], "")


def test_no_links(spark):
    r = one(spark, None, lambda x: Q.classified_links(F.array(x), F.lit(None).cast("array<string>")))
    assert (r.linkedin, r.github, r.portfolio, r.email, r.others) == (None, None, None, None, [])


def test_no_degree(spark):
    assert tuple(one(spark, None, lambda x: Q.split_degree(x, x))) == (None, None)
    assert tuple(one(spark, "MBA", lambda x: Q.split_degree(x, F.lit("in Finance")))) == ("MBA", "Finance")
    assert tuple(one(spark, None, lambda x: Q.restored_degree(x, x, x))) == (None, None)


def test_suggestions(spark):
    arrays = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, "", lambda _: Q.suggested_skills(arrays("Go", " sql", "Go", "", "R", "C", "D", "E", "F"), arrays("SQL "))) == ["Go", "R", "C", "D", "E"]


def test_first_node():
    page = '<script type="application/ld+json">{"@type": "X", "a": [{"b": {"@type": ["Thing", "JOBPOSTING"], "title": "t"}}]} trailing {"@type": "JobPosting", "title": "u"}</script>'
    assert H.first_node(page, "JobPosting")["title"] == "t"
    assert H.first_node('<SCRIPT type=application/ld+json>{bad} {"@type":"JobPosting","title":"v"}</SCRIPT >', "JobPosting")["title"] == "v"
    assert H.first_node('<script type="application/ld+json">[1, {"@type": null}]</script>', "JobPosting") is None
    assert H.first_node(None, "JobPosting") is None and H.first_node("", "JobPosting") is None


def test_typed_nodes_and_cards_on_empty_pages(spark):
    pages = spark.createDataFrame([(1, None, "n"), (2, "", "n"), (3, "<p>plain", "n")], "id int, html string, node string")
    assert H.typed_nodes(pages).count() == 0
    assert H.cards(pages, "li.card", {"title": ("h3", None)}).count() == 0
    assert H.typed_nodes(pages.limit(0)).columns == ["id", "html", "node"]


def test_cards(spark):
    html = '<div class="card"><a class="l" href="/j/12345/"><h3>A <i>b</i></h3></a><h3>second</h3></div><div class="card"></div>'
    rows = H.cards(spark.createDataFrame([(1, html)], "id int, html string"), ".card", {"urn": ("div", "data-urn"), "href": (".l", "href"), "title": ("h3", None)})
    got = rows.select("place", "title", H.card_id().alias("k")).orderBy("place").collect()
    assert [tuple(r) for r in got] == [(0, "A b", "12345"), (1, None, None)]


def test_access(spark):
    rows = spark.createDataFrame([(1, 7), (2, 8)], "id int, user_id int")
    asked = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (1, None)], "id int, user_id int")
    got = G.access_status(asked, rows).select("id", "user_id", "status").collect()
    assert sorted((r.id, r.user_id or 0, r.status) for r in got) == [(1, 0, 403), (1, 7, 200), (2, 7, 403), (3, 7, 404)]


def test_upsert_rules(spark):
    kind = "content_hash string, source string, source_job_id string, title string, level string, description string, skills array<string>, metadata map<string,string>, posted_at timestamp, expires_at timestamp"
    day = dt.datetime(2025, 1, 2)
    have = spark.createDataFrame([("h1", "s", "1", "old", "mid", "long text", ["a"], {"k": "1"}, None, day), (None, "s", "2", "kept", None, None, None, None, None, None)], kind)
    new = spark.createDataFrame([("h1", "t", "9", None, None, "short", ["b", "a"], {"k": "2"}, day, None, 1), ("h3", "s", "3", "new", None, "", None, None, None, None, 2), ("h4", "s", "3", "newer", None, None, None, None, None, day, 3)], kind + ", seq int")
    got = {r.source_job_id: r for r in J.upsert_offers(have, new, F.lit(day)).collect()}
    assert {k: r.state for k, r in got.items()} == {"1": "updated", "2": "kept", "3": "inserted"}
    r = got["1"]
    assert (r.source, r.title, r.level, r.description, r.skills, r.metadata, r.posted_at, r.expires_at) == ("s", None, "mid", "long text", ["a", "b"], {"k": "2"}, day, dt.datetime(2025, 2, 1))
    assert (got["3"].title, got["3"].content_hash, got["3"].expires_at) == ("newer", "h4", day)
    assert J.upsert_offers(have, new.limit(0), F.lit(day)).where("state = 'kept'").count() == 2
    assert J.upsert_offers(have.limit(0), new, F.lit(day)).count() == 2
