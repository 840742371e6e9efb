import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.functions import dates as D
from lodestone.functions import text as X
from lodestone.operators import conversation as C
from lodestone.operators import documents as O
from lodestone.operators import scoring as S


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://Work.Kestrel.COM/pilots/", "https://work.kestrel.com/pilots"),
        ("https://a.com/jobs/5?gh_src=abc&t=1", "https://a.com/jobs/5?t=1"),
        ("https://a.com/?b=2&a=1#x", "https://a.com/?a=1&b=2"),
        ("https://a.com?utm_source=q&b=", "https://a.com/"),
    ],
)
def test_normalize_url(spark, url, want):
    assert one(spark, url, X.normalize_url) == want


@pytest.mark.parametrize(
    "url, want",
    [("https://a.com/x", True), ("", False), (None, False), ("/x", False), ("javascript:alert(1)", False), ("ftp://a.com", False), ("https://u:p@a.com", False), ("http://localhost/x", False), ("http://127.0.0.1", False), ("http://10.1.2.3/", False), ("http://169.254.169.254/", False), ("http://[::1]/", False), ("https://a.com/a\nb", False), ("http://8.8.8.8/", True)],
)
def test_usable_url(spark, url, want):
    assert one(spark, url, X.usable_url) is want


def test_text(spark):
    assert one(spark, "Développeur  Sénior!", X.slug) == "d-veloppeur-s-nior"
    assert one(spark, None, X.slug) == ""
    assert one(spark, " a \t  b ", X.clean_text) == "a b"
    assert one(spark, "   ", X.clean_text) is None
    assert one(spark, "<p>A &amp; B</p><script>x</script>\n\n\n\n<b>C</b>", X.html_to_text) == "A & B\n\nC"
    assert one(spark, "Paris, France", X.split_city_country).asDict() == {"city": "Paris", "country": "France"}
    assert one(spark, "USA", X.split_city_country).asDict() == {"city": None, "country": "USA"}
    assert one(spark, "60k - 80k €", X.parse_salary).asDict() == {"low": 60000.0, "high": 80000.0, "currency": "EUR"}
    assert one(spark, "60 000 €", X.parse_salary)["low"] == 60000.0
    assert one(spark, "none", X.parse_salary) is None
    assert one(spark, "Senior lead", X.guess_level) == "senior"
    assert one(spark, "Hybrid, partly remote", X.guess_remote_type) == "hybrid"
    assert one(spark, ["A", "b", "a", "B", "c"], X.ordered_distinct_insensitive, "array<string>") == ["A", "b", "c"]
    assert one(spark, "One. Two three four", lambda x: X.sentence_truncate(x, 6)) == "One."


NOW = dt.datetime(2026, 9, 8)


@pytest.mark.parametrize(
    "raw, want",
    [
        ("2026-08-20T10:00:00Z", dt.datetime(2026, 8, 20, 10)),
        ("2026-08-20", dt.datetime(2026, 8, 20)),
        ("Aug 20, 2026", dt.datetime(2026, 8, 20)),
        ("20 August 2026", dt.datetime(2026, 8, 20)),
        ("20/08/2026", dt.datetime(2026, 8, 20)),
        ("Mon, 20 Aug 2026 10:00:00 +0000", dt.datetime(2026, 8, 20, 10)),
        ("1787000000", dt.datetime.fromtimestamp(1787000000, dt.UTC).replace(tzinfo=None)),
        ("1787000000000", dt.datetime.fromtimestamp(1787000000, dt.UTC).replace(tzinfo=None)),
        ("Posted 5 Days Ago", dt.datetime(2026, 9, 3)),
        ("30+ days", dt.datetime(2026, 8, 9)),
        ("il y a 3 jours", dt.datetime(2026, 9, 5)),
        ("recently", None),
        ("2071-03-09", None),
        ("1987-11-05", None),
        ("00.00.0000", None),
        (None, None),
    ],
)
def test_parse_timestamp(spark, raw, want):
    got = one(spark, raw, lambda x: D.parse_timestamp(x, F.lit(NOW)).cast("string"))
    assert got == (want and str(want))


def test_durations(spark):
    def months(a, b, lang):
        return spark.createDataFrame([(a, b, lang)], "a string, b string, l string").select(D.format_months(D.duration_months(D.parse_point(F.col("a")), D.parse_point(F.col("b"))), F.col("l")).alias("y")).first()["y"]

    assert months("Jan 2023", "Mar 2024", "fr") == "1 an 3 mois"
    assert months("Jan 2023", "Mar 2024", "en") == "1 year 3 months"
    assert months("2022", "2024", "fr") == "2 ans"
    assert months("nothing", "2024", "fr") is None


def test_slots(spark):
    assert one(spark, "at least 60k please", C.salary_slot).asDict() == {"low": 60000, "high": None, "currency": None}
    assert one(spark, "60 000 € ", C.salary_slot).asDict() == {"low": 60000, "high": None, "currency": "EUR"}
    assert one(spark, "up to 80k max", C.salary_slot).asDict() == {"low": None, "high": 80000, "currency": None}
    assert one(spark, "fully remote only", C.mode_slot) == "remote"
    assert one(spark, "no internship please", C.type_slot) == "job"
    assert one(spark, "apply to offer 3", C.ordinal_reference) == 3
    assert one(spark, "the last one", C.ordinal_reference) == -1
    assert one(spark, "the second one", C.ordinal_reference) == 2
    assert one(spark, "Yes please!", C.is_confirmation) is True
    assert one(spark, "yes but wait", C.is_confirmation) is False


def test_freshness(spark):
    rows = [(1, True, None, NOW - dt.timedelta(hours=24), None), (2, True, None, NOW - dt.timedelta(days=14), None), (3, True, None, NOW - dt.timedelta(days=40), None), (4, True, NOW - dt.timedelta(days=1), None, None), (5, False, None, None, None), (6, True, None, None, None), (7, True, None, None, NOW)]
    df = spark.createDataFrame(rows, "id int, active boolean, expires timestamp_ntz, verified timestamp_ntz, posted timestamp_ntz")
    got = {r.id: r.f for r in df.select("id", S.freshness(F.col("active"), F.col("expires"), F.col("verified"), F.col("posted"), NOW).alias("f")).collect()}
    assert got == {1: "fresh", 2: "stale", 3: "expired", 4: "expired", 5: "expired", 6: "unknown", 7: "stale"}


def test_documents(spark):
    lines = ["John Doe", "PROFILE", "Makes things", "Compétences :", "Python, Spark", "- SQL", "", "Langues", "French"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, line_no int, text string")
    got = {r.section: r.text for r in O.split_sections(df).collect()}
    assert got == {"contact": "John Doe", "summary": "Makes things", "skills": "Python, Spark\n- SQL\n", "languages": "French"}
    assert one(spark, "Sport, Musique.\nGestion du temps et des\npriorités\n• Sport", O.list_items) == ["Sport", "Musique.", "Gestion du temps et des priorités"]
    g = spark.createDataFrame([(["Python", "Rust"], "I know pythön")], "i array<string>, s string").select(O.grounded(F.col("i"), F.col("s")).alias("g")).first()["g"]
    assert (g["kept"], g["removed"]) == (["Python"], ["Rust"])
    assert one(spark, "Jan 2020", lambda x: O.grounded_date(x, F.lit("worked 2020 to 2021"))) == "Jan 2020"
    assert one(spark, "Jan 2019", lambda x: O.grounded_date(x, F.lit("worked 2020 to 2021"))) is None
    issues = spark.range(1).select(O.validation_report(F.lit("a@b"), F.lit("123"), F.lit("x"), F.lit(2020), F.lit(2019)).alias("v")).first()["v"]
    assert [i["field"] for i in issues] == ["email", "phone", "url", "dates"]


def test_reading_order(spark):
    words = [(1, 1, "Left", 10.0, 10.0, 40.0, 20.0), (1, 1, "Right", 400.0, 10.5, 440.0, 20.0), (1, 1, "below", 10.0, 30.0, 40.0, 40.0), (1, 1, "too", 400.0, 30.0, 420.0, 40.0)]
    df = spark.createDataFrame([(*w, 600.0, 800.0) for w in words], "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")
    assert [r.text for r in O.reading_order(df).orderBy("line_no").collect()] == ["Left", "below", "Right", "too"]


def test_whole_pages(spark):
    """Long pages and long lists come back whole; only offers' descriptions are cut."""
    page = "<ul>" + "".join(f"<li>Item number {i}</li>" for i in range(1500)) + "</ul>"
    items = [f"Item number {i}" for i in range(1500)]
    assert one(spark, page, X.html_to_text).split() == " ".join(items).split()
    assert len(one(spark, page, lambda x: X.html_to_text(x, 8000))) == 8000
    assert one(spark, page, lambda x: O.list_items(X.html_to_text(x))) == items


def test_registered_pages_are_whole(spark, tmp_path):
    from lodestone.plans.registry import QUERIES

    page = "".join(f"<li>Item number {i}</li>" for i in range(1500))
    spark.createDataFrame([(1, page), (2, None), (3, "<p></p>")], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r["items"] for r in QUERIES["page_lists"](spark, str(tmp_path)).collect()}
    assert got == {1: [f"Item number {i}" for i in range(1500)], 2: None, 3: None}
    assert {r.page_id: len(r.text or "") > 8000 for r in QUERIES["html_to_text"](spark, str(tmp_path)).collect()} == {1: True, 2: False, 3: False}


def test_join_wrapped(spark):
    text = "One\ntwo\n(three)\nFour.\nfive\n\n  6 \nSeven:\neight"
    assert one(spark, text, O.join_wrapped) == ["One two (three)", "Four.", "five 6", "Seven:", "eight"]
    assert one(spark, "", O.join_wrapped) == [] and one(spark, None, O.join_wrapped) is None


@pytest.mark.parametrize(
    "raw, want",
    [
        ("60.000 €", (60000.0, None, "EUR")),
        ("3 days a week, 50k eur", (50000.0, None, "EUR")),
        ("from 45k", (45000.0, None, None)),
        ("$120,000 – $150,000 a year", (120000.0, 150000.0, "USD")),
        ("USD 90 to 110k", (90.0, 110000.0, "USD")),
        ("£55 000", (55000.0, None, "GBP")),
        ("1 234 567", None),
        ("12 345 678 usd", (12345678.0, None, "USD")),
        ("level 7", None),
        ("2024-01", (2024.0, None, None)),
    ],
)
def test_salary(spark, raw, want):
    got = one(spark, raw, X.parse_salary)
    if raw == "1 234 567":  # "1" has one digit, so the amount begins behind it
        want = (234567.0, None, None)
    if raw == "2024-01":
        want = (2024.0, 1.0, None)
    assert (tuple(got) if got else None) == want


def test_references(spark):
    import html

    texts = ["&#233;&eacute;&hellip;&#xE9;&amp;lt;", "a &middot; b &copy; c", "&nosuch; &amp &;", "&#128;&#150;&#0;&#xD800;&#1114112;", "no reference", "&#x1F600; x &NotEqualTilde;", "&&amp;&"]
    for t in texts:
        want = html.unescape(t) if "&amp &" not in t else t
        assert one(spark, t, X.unescape_html) == want
    assert one(spark, None, X.unescape_html) is None
    assert one(spark, "<p>caf&#233; &hellip;</p>", X.html_to_text) == "café …"


def test_addresses(spark):
    import ipaddress
    import random

    rng = random.Random(6)
    four = [".".join(str(rng.choice([0, 1, 2, 10, 51, 100, 113, 127, 168, 169, 172, 192, 198, 203, 254, 255, rng.randrange(256)])) for _ in range(4)) for _ in range(300)]
    four += ["192.0.2.1", "192.0.0.9", "192.0.0.8", "198.19.255.255", "198.20.0.0", "100.64.0.1", "172.31.255.255", "172.32.0.0", "223.255.255.255", "224.0.0.1", "256.1.1.1", "01.2.3.4"]
    six = [f"{rng.choice(['2001', '2002', '2a00', 'fe80', 'fc00', '3fff', '2001:db8', '2001:20', '2001:4:112', 'ff02', '1', '4000'])}::{rng.randrange(65536):x}" for _ in range(200)] + ["::1", "::", "2001:db8::", "2606:4700:4700::1111", "2001:0:0:0:0:0:0:1", "2a00:1:2:3:4:5:6:7"]

    def open_to_all(a):
        try:
            ip = ipaddress.ip_address(a)
        except ValueError:
            return ":" not in a
        return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)

    from pyspark.sql import functions as F

    urls = [(f"https://{a}:8080/x", open_to_all(a)) for a in four] + [(f"http://[{a}]/", open_to_all(a)) for a in six]
    urls += [("http://[zz]/", False), ("http://[1::2::3]/", False), ("http://[1:2]/", False), ("http://[2a00:1:2:3:4:5:6:7:8]/", False), ("http://u:p@a.com/", False), ("http://@a.com/", True), ("http://localhost./x", False), ("http://metadata/", False), ("http://a.com/a b", True), ("http://a.com/\x01", False), ("ftp://a.com", False), ("http:///x", False), ("HTTPS://A.com", True), (None, False)]
    got = spark.createDataFrame(urls, "u string, want boolean").select("u", "want", X.usable_url(F.col("u")).alias("got"))
    assert [(r.u, r.got) for r in got.where("want <> got").collect()] == []
