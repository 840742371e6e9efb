"""Functions of skills, extraction and predicates on single values and small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.functions import dates as DT
from lodestone.functions import extract as E
from lodestone.functions import language as L
from lodestone.functions import predicates as P
from lodestone.functions import skills as K
from lodestone.functions import text as X

NOW = dt.datetime(2025, 3, 10, 8, 0, 0)


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("r")).first().r


@pytest.mark.parametrize("f", [L.detect_document, L.detect_message, L.detect_strict, X.guess_level, X.guess_remote_type, K.normalise, E.alnum_key, E.find_reference, X.normalize_url, E.certification, E.spoken_language])
def test_null_and_empty(spark, f):
    for v in (None, ""):
        assert one(spark, v, f) in (None, "", "en")


def test_accents(spark):
    assert one(spark, "Çà et là, Żółć, naïve été", L.strip_accents) == "Ca et la, Zołc, naive ete"
    assert one(spark, "Crème Brûlée 2.0", E.alnum_key) == "cremebrulee20"


@pytest.mark.parametrize(
    "text, want",
    [("just now", NOW), ("vor 2 Tagen", None), ("4 weeks", dt.datetime(2025, 2, 10, 8)), ("30+ days ago", dt.datetime(2025, 2, 8, 8)), ("il y a 2 heures", dt.datetime(2025, 3, 10, 6)), ("Yesterday at noon", dt.datetime(2025, 3, 9, 8)), ("12 manages", None)],
)
def test_relative_times(spark, text, want):
    got = one(spark, text, lambda x: DT.relative_time(x, F.lit(NOW).cast("timestamp")))
    assert (got and got.replace(tzinfo=None)) == want


def test_skill_analysis(spark):
    owned = spark.createDataFrame([(1, 0, "Postgres 15"), (1, 1, "Apache Spark Streaming"), (1, 2, "google cloud run"), (2, 0, "Go")], "id long, place int, skill string")
    wanted = spark.createDataFrame([(1, "PostgreSQL"), (1, "Spark Streaming"), (1, "GCP"), (1, "Rust"), (2, "Golang"), (2, ""), (3, "Go")], "id long, skill string")
    got = {(r.id, r.skill): (r.matched_to, r.confidence) for r in K.analyse(wanted, owned).collect()}
    assert got == {
        (1, "PostgreSQL"): ("Postgres 15", "exact"),
        (1, "Spark Streaming"): ("Apache Spark Streaming", "fuzzy"),
        (1, "GCP"): ("google cloud run", "fuzzy"),
        (1, "Rust"): (None, "missing"),
        (2, "Golang"): ("Go", "exact"),
        (3, "Go"): (None, "missing"),
    }
    assert K.analyse(wanted.limit(0), owned).count() == 0


def test_predicates(spark):
    rows = [("Welder", "Northwind Mills", "job"), ("Intern", None, "internship"), ("Baker", "Mill & Co", "job")]
    df = spark.createDataFrame(rows, "title string, company string, kind string")
    c = F.col
    titles = lambda cond: [r.title for r in df.where(cond).collect()]
    assert titles(P.context_filter(c("kind"), c("company"), None, ["mill"])) == ["Intern"]
    assert titles(P.context_filter(c("kind"), c("company"), "job", [])) == ["Welder", "Baker"]
    assert titles(P.keyword_match(c("title"), ["BAK", ""])) == ["Baker"]
    assert titles(P.keyword_match(c("title"), [])) == ["Welder", "Intern", "Baker"]
    assert titles(P.offer_matches(c("title"), c("company"), F.lit(None), c("kind"), "job", ["north"], ["co"])) == ["Baker"]


def test_maps_and_cached_results(spark):
    df = spark.createDataFrame([({f"k{i}" * 15: "v" * 80 for i in range(9)},), ({},), (None,)], "m map<string,string>")
    got = [r.m for r in df.select(P.safe_meta(F.col("m")).alias("m")).collect()]
    assert len(got[0]) == 8 and all(len(k) <= 40 and len(v) == 60 for k, v in got[0].items()) and got[1:] == [None, None]
    at = lambda d: dt.datetime(2025, 3, d)
    df = spark.createDataFrame([(1, True, None, at(9)), (2, False, None, at(9)), (3, True, at(1), at(9)), (4, True, None, at(1)), (5, True, None, None)], "id int, active boolean, expires timestamp_ntz, posted timestamp_ntz")
    good = P.still_good(F.col("active"), F.col("expires"), F.col("posted"), F.lit(NOW).cast("timestamp_ntz"), 5)
    assert [r.id for r in df.where(good).collect()] == [1, 5]


def test_owner(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "user_id long, x string")
    assert [r.x for r in P.owned_by(df, 2).collect()] == ["b"]
