"""Work that must not grow faster than the input: each expression once, rows dealt over tasks, no file for each small payload."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import preferences as P
from lodestone.functions import text as X
from lodestone.operators import documents as D
from lodestone.operators.analytics import nearest_rank
from lodestone.plans.registry import QUERIES
from lodestone.sources import html as H

TENTH = "/root/testdata/sf0.01"


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_usable_url_reads_its_host_once(spark):
    """the octets were split for each network and bound."""
    assert plan(spark.range(1).select(X.usable_url(F.col("id").cast("string")).alias("x"))).count("split(") < 30


def test_periods_and_reasons_are_read_once(spark):
    """dates were parsed again wherever a year or month was used, tokens for each wish."""
    text = F.col("id").cast("string")
    got = plan(spark.range(1).select(P.experience_period(text, F.lit("2024-06-15").cast("date"), F.lit("en"))))
    assert got.count("20[0-4]") < 20
    offer, context = {"title": text, "description": text}, {"query": text, "skills": F.array(text), "technologies": F.array(text)}
    assert plan(spark.range(1).select(P.match_reasons(offer, context))).count("regexp_extract_all") < 20


def test_wrapped_lines_are_split_once(spark):
    """the whole text was split again for each of its lines."""
    lines = "\n".join(f"w{i} and" for i in range(3000))
    got = plan(spark.range(1).select(D.join_wrapped(F.upper(F.col("id").cast("string"))).alias("x")))
    assert got.count("upper(") == 1
    assert spark.createDataFrame([(lines,)], "t string").select(F.size(D.join_wrapped(F.col("t"))).alias("n")).first().n == 1


def test_nodes_are_searched_once(spark):
    """The filter and the column each ran the search, before the pages were dealt."""
    found = H.typed_nodes(spark.range(4).select(F.col("id").cast("string").alias("html")))
    assert plan(found, "executedPlan").count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", ["experience_periods", "match_reasons", "page_lists", "page_cards", "address_urls", "resume_reports", "posting_nodes"])
def test_rows_are_dealt(spark, name):
    """One small file was one task."""
    assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, TENTH), "executedPlan")


@pytest.mark.parametrize("name", ["rss_offers", "source_ashby", "source_hackernews", "source_oracle_hcm", "source_phenom", "source_workday"])
def test_payloads_share_files(spark, name):
    """a file for each payload (40 or 80 here) grew with the table."""
    assert len(QUERIES[name](spark, TENTH).inputFiles()) <= 16


def test_equal_values_are_ranked_as_one(spark):
    """each row was put into its range; values count with their number now."""
    rows = spark.range(1000).select(F.lit("a").alias("k"), F.when(F.col("id") < 300, 1.0).when(F.col("id") < 600, -2.5).otherwise(F.col("id") % 7).alias("v"))
    got = {r.p: r.v for r in nearest_rank(rows, "k", "v", [0, 25, 50, 95, 100]).collect()}
    want = sorted(r.v for r in rows.collect())
    assert got == {p: want[round(p / 100 * 999)] for p in (0, 25, 50, 95, 100)}
    assert "sum(m" in plan(nearest_rank(rows, "k", "v", [50]))


@pytest.mark.parametrize("name", ["source_career_pages", "source_oracle_hcm", "source_talentbrew", "source_workday"])
def test_urls_and_places_are_read_once(spark, name):
    """the filter and the column each tested the URL, city and country each split the place."""
    got = plan(QUERIES[name](spark, TENTH))
    assert got.count("https?)://([^/?#]*)") == 1 and got.count("[,/·|]") <= 2
