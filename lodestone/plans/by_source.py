"""One query for each job source: payloads made of parts, landed as the source's JSON or pages and read into offers, with SQL.

Titles, places, texts and dates are made of parts by one rule (``_P``), so what an offer must hold can be said once;
each source adds what it names in a way of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import roles as R
from ..sources import html as H, normalise as N
from ..storage import materialise
from .queries import query

# Expressions that both engines read
_TITLE = "p_name || CASE WHEN p_size % 4 = 0 THEN ' Senior' WHEN p_size % 4 = 1 THEN ' intern' ELSE '' END"
_PLACE = "'City ' || CAST(p_size % 9 AS STRING) || ', Land'"
_TEXT = "'about ' || p_type || CASE WHEN p_size % 5 = 0 THEN ' remote' ELSE '' END"
_DAY = "'2024-01-' || lpad(CAST(1 + p_size % 28 AS STRING), 2, '0')"
_STAMP = _DAY + " || 'T10:00:00Z'"
_URL = "'https://jobs.example.com/' || CAST(p_partkey AS STRING)"
_P = f"SELECT *, {_TITLE} AS t, {_PLACE} AS l, {_TEXT} AS d, {_DAY} AS day, {_STAMP} AS stamp, {_URL} AS u, CAST(p_partkey AS STRING) AS i FROM part"

_EXPECTED = {
    "source_job_id": "i", "source_url": "u", "title": "t", "company": "'Acme Corp'", "city": "'City ' || p_size % 9", "country": "'Land'",
    "job_type": "CASE WHEN p_size % 4 = 1 THEN 'internship' ELSE 'job' END", "remote_type": "CASE WHEN p_size % 5 = 0 THEN 'remote' END", "level": "CASE WHEN p_size % 4 = 0 THEN 'senior' WHEN p_size % 4 = 1 THEN 'student' END",
    "low": "CAST(NULL AS DOUBLE)", "high": "CAST(NULL AS DOUBLE)", "currency": "CAST(NULL AS VARCHAR)", "posted": "CAST(day AS TIMESTAMP) + INTERVAL 10 HOUR",
}


def _sql(where: str = "", **own: str) -> str:
    return f"WITH p AS ({_P.replace('AS STRING', 'AS VARCHAR')}) SELECT {', '.join(f'{v} AS {k}' for k, v in (_EXPECTED | own).items())} FROM p" + (f" WHERE {where}" if where else "")


def _parts(spark, sf) -> DataFrame:
    p = R.spread(R.read(spark, sf, "part"), "p_partkey")
    made = {"t": _TITLE, "l": _PLACE, "d": _TEXT, "day": _DAY, "stamp": _STAMP, "u": _URL, "i": "CAST(p_partkey AS STRING)"}
    return p.select("*", *(F.expr(v).alias(k) for k, v in made.items()))


def _shown(offers: DataFrame) -> DataFrame:
    return offers.select("source_job_id", "source_url", "title", "company", "city", "country", "job_type", "remote_type", F.col("experience_level").alias("level"), F.col("salary_min").alias("low"), F.col("salary_max").alias("high"), F.col("salary_currency").alias("currency"), F.col("posted_at").alias("posted"))


def _landed(spark, sf, source: str, item: dict[str, str], board: str = "acme-corp", each: int = 50, tail: str = "") -> DataFrame:
    """Parts as JSON payloads of the source (``each`` offers), landed as rows, since a file each would be as many files to list, and read back by its reader."""
    s = N.SOURCES[source]
    p = _parts(spark, sf)
    one = F.to_json(F.struct(*(F.expr(v).alias(k) for k, v in item.items())))
    lists = p.select(F.floor(F.col("p_partkey") / each).alias("k"), one.alias("o")).groupBy("k").agg(F.concat(F.lit("["), F.array_join(F.collect_list("o"), ","), F.lit(tail + "]")).alias("v"))
    opened, closed = "", ""
    for step in [x for x in s.rows.split(".") if x]:
        name, _, index = step.partition("[")
        opened += f'{{"{name}":' + ("[" if index else "")
        closed = ("]" if index else "") + "}" + closed
    return N.payload_rows(materialise(lists.select(F.concat(F.lit(opened), "v", F.lit(closed)).alias("value")), source), source, board)


def _source(name: str, item: dict[str, str], board: str = "acme-corp", where: str = "", tail: str = "", **own: str) -> None:
    def run(spark, sf):
        return _shown(N.to_offers(_landed(spark, sf, name, item, board, tail=tail), name, F.lit("2024-06-01").cast("timestamp")))

    run.__name__ = f"source_{name}"
    query(_sql(where, **own))(run)


_DATE_ONLY = {"posted": "CAST(day AS TIMESTAMP)"}
_source("greenhouse", {"id": "p_partkey", "title": "t", "updated_at": "stamp", "location": "named_struct('name', l)", "absolute_url": "u", "content": "'&lt;p&gt;' || d || '&lt;/p&gt;'", "departments": "array(named_struct('name', p_brand))"}, source_job_id="'acme-corp:' || i")
_source("lever", {"id": "i", "text": "t", "hostedUrl": "u", "createdAt": "unix_millis(CAST(stamp AS TIMESTAMP))", "categories": "named_struct('location', l, 'commitment', p_type)", "descriptionPlain": "d", "workplaceType": "CASE WHEN p_size % 2 = 0 THEN 'on-site' WHEN p_size % 3 = 0 THEN 'Hybrid' END"}, remote_type="CASE WHEN p_size % 2 = 0 THEN 'onsite' WHEN p_size % 3 = 0 THEN 'hybrid' WHEN p_size % 5 = 0 THEN 'remote' END")
_source(
    "ashby",
    {"id": "i", "title": "t", "location": "l", "isListed": "p_size % 7 <> 0", "isRemote": "p_size % 2 = 0", "descriptionPlain": "d", "publishedAt": "stamp", "jobUrl": "u", "compensation": "named_struct('compensationTierSummary', CASE WHEN p_size % 3 = 0 THEN '€' || CAST(p_size + 10 AS STRING) || 'K – €' || CAST(p_size + 30 AS STRING) || 'K' END)"},
    where="p_size % 7 <> 0", remote_type="CASE WHEN p_size % 2 = 0 OR p_size % 5 = 0 THEN 'remote' END", low="CASE WHEN p_size % 3 = 0 THEN (p_size + 10) * 1000.0 END", high="CASE WHEN p_size % 3 = 0 THEN (p_size + 30) * 1000.0 END", currency="CASE WHEN p_size % 3 = 0 THEN 'EUR' END",
)
_source("smartrecruiters", {"id": "i", "name": "t", "company": "named_struct('name', CASE WHEN p_size % 2 = 0 THEN p_brand END)", "releasedDate": "stamp", "location": "named_struct('city', 'City ' || CAST(p_size % 9 AS STRING), 'region', '', 'country', 'Land', 'remote', p_size % 3 = 0)", "experienceLevel": "named_struct('label', CASE WHEN p_size % 2 = 0 THEN 'Graduate' END)"}, source_url="'https://jobs.smartrecruiters.com/acme-corp/' || i", company="CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'Acme Corp' END", remote_type="CASE WHEN p_size % 3 = 0 THEN 'remote' END", level="CASE WHEN p_size % 2 = 0 THEN 'junior' WHEN p_size % 4 = 1 THEN 'student' END")
_source("workday", {"title": "t", "externalPath": "'/job/' || i", "locationsText": "CASE WHEN p_size % 2 = 0 THEN '2 Locations' ELSE l END", "bulletFields": "array('x', CASE WHEN p_size % 3 > 0 THEN 'R-' || i ELSE 'y' END)", "startDate": "day"}, board="acme.example.com", source_job_id="CASE WHEN p_size % 3 > 0 THEN 'R-' || i ELSE '/job/' || i END", source_url="'https://acme.example.com/job/' || i", company="'Acme'", city="CASE WHEN p_size % 2 > 0 THEN 'City ' || p_size % 9 END", country="CASE WHEN p_size % 2 > 0 THEN 'Land' END", remote_type="CAST(NULL AS VARCHAR)", **_DATE_ONLY)
_source("oracle_hcm", {"Id": "i", "Title": "t", "PostedDate": "day", "PrimaryLocation": "l", "PrimaryLocationCountry": "CASE WHEN p_size % 2 = 0 THEN 'FR' END", "WorkplaceType": "CASE WHEN p_size % 3 = 0 THEN 'Hybrid' END"}, board="acme.example.com", source_url="'https://acme.example.com/job/' || i", company="'Acme'", country="CASE WHEN p_size % 2 = 0 THEN 'FR' ELSE 'Land' END", remote_type="CASE WHEN p_size % 3 = 0 THEN 'hybrid' END", **_DATE_ONLY)
_source("phenom", {"jobId": "i", "title": "t", "applyUrl": "u || '/apply'", "cityStateCountry": "l", "postedDate": "day", "category": "p_brand", "type": "p_type", "description": "d", "ml_skills": "array('x', p_type)"}, board="www.acme.example.com", company="'Acme'", **_DATE_ONLY)
_source("adzuna", {"id": "i", "redirect_url": "u", "title": "t", "description": "d", "created": "stamp", "company": "named_struct('display_name', p_brand)", "location": "named_struct('display_name', l, 'area', array('UK'))", "salary_min": "p_retailprice", "contract_time": "p_type"}, board="gb", company="p_brand", country="'UK'", low="p_retailprice", currency="'GBP'")
_source("arbeitnow", {"slug": "i", "company_name": "p_brand", "title": "t", "description": "'<p>' || d || '</p>'", "remote": "p_size % 2 = 0", "url": "u", "tags": "array(p_brand, lower(p_brand))", "job_types": "array(p_type)", "location": "l", "created_at": "unix_timestamp(CAST(stamp AS TIMESTAMP))"}, company="p_brand", remote_type="CASE WHEN p_size % 2 = 0 OR p_size % 5 = 0 THEN 'remote' END")
_source("remotive", {"id": "p_partkey", "url": "u", "title": "t", "company_name": "p_brand", "publication_date": "day || 'T10:00:00'", "candidate_required_location": "l", "salary": "CASE WHEN p_size % 2 = 0 THEN '$' || CAST(p_size + 10 AS STRING) || ',000 to ' || CAST(p_size + 20 AS STRING) || ',000' ELSE 'good pay' END", "description": "d"}, company="p_brand", remote_type="'remote'", low="CASE WHEN p_size % 2 = 0 THEN (p_size + 10) * 1000.0 END", high="CASE WHEN p_size % 2 = 0 THEN (p_size + 20) * 1000.0 END", currency="CASE WHEN p_size % 2 = 0 THEN 'USD' END")
_source("jobicy", {"id": "p_partkey", "url": "u", "jobTitle": "t", "companyName": "p_brand", "jobType": "array(p_type)", "jobGeo": "l", "jobLevel": "CASE WHEN p_size % 2 = 0 THEN 'Head of all' END", "jobExcerpt": "d", "pubDate": "day || ' 10:00:00'", "annualSalaryMin": "CASE WHEN p_size % 3 = 0 THEN '0' ELSE CAST(p_size * 1000 AS STRING) END", "annualSalaryMax": "'90000'", "salaryCurrency": "'EUR'"}, company="p_brand", remote_type="'remote'", level="CASE WHEN p_size % 4 = 0 THEN 'senior' WHEN p_size % 4 = 1 THEN 'student' WHEN p_size % 2 = 0 THEN 'lead' END", low="CASE WHEN p_size % 3 > 0 AND p_size > 0 THEN p_size * 1000.0 END", high="90000.0", currency="'EUR'")
_source("remoteok", {"id": "i", "url": "u", "position": "t", "company": "p_brand", "tags": "array('a')", "location": "l", "salary_min": "CASE WHEN p_size % 2 = 0 THEN p_retailprice ELSE 0.0D END", "salary_max": "p_retailprice * 2", "date": "stamp", "description": "d"}, tail=',{"legal":"notice","id":"0","url":"https://a.example.com","position":"x"}', company="p_brand", remote_type="'remote'", low="CASE WHEN p_size % 2 = 0 THEN p_retailprice END", high="p_retailprice * 2", currency="CASE WHEN p_size % 2 = 0 THEN 'USD' END")
_source("himalayas", {"guid": "i", "title": "t", "companyName": "p_brand", "applicationLink": "u", "description": "d", "locationRestrictions": "array('City ' || CAST(p_size % 9 AS STRING), 'Land')", "categories": "array(p_type)", "seniority": "array(CASE WHEN p_size % 4 = 2 THEN 'Junior' ELSE 'x' END)", "employmentType": "p_type", "pubDate": "stamp"}, company="p_brand", remote_type="'remote'", level="CASE WHEN p_size % 4 = 0 THEN 'senior' WHEN p_size % 4 = 1 THEN 'student' WHEN p_size % 4 = 2 THEN 'junior' END")
_source("hackernews", {"id": "p_partkey", "author": "'x'", "created_at": "stamp", "text": "p_brand || ' | ' || t || ' | ' || l || '<p>' || d"}, source_url="'https://news.ycombinator.com/item?id=' || i", company="p_brand")


@query(_sql("p_size % 6 <> 1", source_job_id="i", remote_type="CASE WHEN p_size % 2 = 0 OR p_size % 5 = 0 AND p_size % 6 = 3 THEN 'remote' END"))
def source_rippling(spark, sf):
    """Every posting three times: the first stays, but for one that has a description where the first has none; postings that are not listed at all are left out."""
    copies = F.expr("sequence(0, 2)")
    p = _parts(spark, sf).where("p_size % 6 <> 1").select("*", F.explode(copies).alias("copy"))
    body = F.when((F.col("copy") == 1) & (F.col("p_size") % 6 == 3), F.concat(F.lit("<p>"), "d", F.lit("</p>"))).otherwise("")
    rows = p.select(
        F.col("p_partkey").alias("id"), F.col("i").alias("uuid"), F.when((F.col("copy") == 0) | ((F.col("copy") == 1) & (F.col("p_size") % 6 == 3)), F.col("t")).otherwise("later copy").alias("name"), F.col("u").alias("url"), F.struct(F.lit(None).cast("string").alias("id"), F.col("l").alias("label")).alias("workLocation"),
        (F.col("p_size") % 2 == 0).alias("isRemote"), F.col("p_type").alias("employmentType"), body.alias("descriptionHtml"), F.col("stamp").alias("createdAt"), F.lit("acme-corp").alias("board"), (F.col("p_partkey") * 3 + F.col("copy")).alias("seq"),
    )
    return _shown(N.to_offers(N.best_by_uuid(rows), "rippling", F.lit("2024-06-01").cast("timestamp")))


def _ld_page(node) -> F.Column:
    return F.concat(F.lit('<html><script type="application/ld+json">{"@graph":[{"@type":"WebPage"},'), node, F.lit("]}</script><p>x</p></html>"))


def _node(*extra):
    return F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.col("t").alias("title"), F.expr("'<b>' || d || '</b>'").alias("description"), F.col("day").alias("datePosted"), F.expr("array(named_struct('address', named_struct('addressLocality', 'City ' || CAST(p_size % 9 AS STRING), 'addressCountry', 'Land')))").alias("jobLocation"), *extra))


@query(_sql("p_size % 10 <> 4", source_job_id="'careers.acme.com:' || CASE WHEN p_size % 2 = 0 THEN 'K' || i ELSE i END", company="CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'Careers' END", low="p_retailprice", high="CASE WHEN p_size % 3 = 0 THEN p_retailprice + 5 END", currency="'EUR'", **_DATE_ONLY))
def source_career_pages(spark, sf):
    """Typed nodes of career pages: identifiers as objects or from the URL, companies from the node or the host; pages without a node have no offer."""
    ident = F.when(F.col("p_size") % 2 == 0, F.struct(F.concat(F.lit("K"), "i").alias("value"))).alias("identifier")
    org = F.when(F.col("p_size") % 3 == 0, F.struct(F.col("p_brand").alias("name"))).alias("hiringOrganization")
    pay = F.struct(F.lit("EUR").alias("currency"), F.struct(F.col("p_retailprice").alias("minValue"), F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice") + 5).alias("maxValue")).alias("value")).alias("baseSalary")
    html = F.when(F.col("p_size") % 10 == 4, F.lit("<html>no posting</html>")).otherwise(_ld_page(_node(ident, org, pay, F.col("u").alias("url"))))
    pages = _parts(spark, sf).select(F.lit("https://careers.acme.com/jobs").alias("url"), html.alias("html"))
    return _shown(N.to_offers(N.posting_rows(H.typed_nodes(pages)), "career_pages", F.lit("2024-06-01").cast("timestamp")))


@query(_sql("p_size % 2 = 0", source_url="'https://acme.example.com/job/' || i", company="p_brand", **_DATE_ONLY))
def source_talentbrew(spark, sf):
    """Postings whose link is on another host than the board's are left out."""
    html = _ld_page(_node(F.col("i").alias("identifier"), F.struct(F.col("p_brand").alias("name")).alias("hiringOrganization"), F.expr("CASE WHEN p_size % 2 = 0 THEN 'https://acme.example.com/job/' ELSE 'https://ads.example.com/job/' END || i").alias("url")))
    rows = N.posting_rows(H.typed_nodes(_parts(spark, sf).select(F.lit("https://acme.example.com/search").alias("url"), html.alias("html"))))
    return _shown(N.to_offers(rows.withColumn("board", F.lit("acme.example.com")), "talentbrew", F.lit("2024-06-01").cast("timestamp")))


@query(_sql(source_job_id="CAST(p_partkey + 100000 AS VARCHAR)", source_url="'https://in.example.com/jobs/view/' || (p_partkey + 100000)", company="p_brand", low="CASE WHEN p_size % 3 = 0 THEN (p_size + 10) * 1000.0 END", currency="CASE WHEN p_size % 3 = 0 THEN 'GBP' END", **_DATE_ONLY))
def source_indeed(spark, sf):
    """Cards with pay as text, details from the nodes of their pages."""
    n = (F.col("p_partkey") + 100000).cast("string")
    p = _parts(spark, sf)
    card = F.concat(F.lit('<div class="card"><a class="jcs" href="https://in.example.com/jobs/view/'), n, F.lit('">'), F.col("t"), F.lit('</a><span class="co">'), F.col("p_brand"), F.lit('</span><div class="loc">'), F.col("l"), F.lit('</div><div class="pay">'), F.expr("CASE WHEN p_size % 3 = 0 THEN '£' || CAST(p_size + 10 AS STRING) || 'k a year' ELSE '' END"), F.lit("</div></div>"))
    cards = H.cards(p.select(card.alias("html")), "div.card", {"href": ("a.jcs", "href"), "title": ("a.jcs", None), "company": ("span.co", None), "location": ("div.loc", None), "salary": ("div.pay", None)})
    cards = cards.select(H.card_id("href", "href").alias("id"), F.col("href").alias("url"), "title", "company", "location", F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("posted"), "salary")
    nodes = N.posting_rows(H.typed_nodes(p.select(F.concat(F.lit("https://in.example.com/jobs/view/"), n).alias("url"), _ld_page(_node(n.alias("identifier"))).alias("html"))))
    rows = N.merged_cards(cards, nodes).join(cards.select("id", "salary"), "id").withColumn("unit", F.lit("YEAR"))
    return _shown(N.to_offers(rows, "indeed", F.lit("2024-06-01").cast("timestamp")))


@query(_sql("p_size % 5 <> 1 OR p_size % 2 = 0", source_job_id="CAST(p_partkey + 100000 AS VARCHAR)", source_url="CASE WHEN p_size % 5 <> 1 THEN 'https://li.example.com/jobs/view/' ELSE 'https://li.example.com/jobs/role-' END || (p_partkey + 100000)", title="CASE WHEN p_size % 5 <> 1 THEN t || ' !' ELSE t END", company="CASE WHEN p_size % 5 <> 1 THEN p_brand ELSE 'Node' END", remote_type="CASE WHEN p_size % 5 = 0 AND p_size % 2 = 0 THEN 'remote' END", posted="CASE WHEN p_size % 2 = 0 THEN CAST(day AS TIMESTAMP) END"))
def source_linkedin(spark, sf):
    """Cards and typed nodes of a list, merged by number: the card's value wins, the node gives text and date, and nodes without a card are offers too."""
    n = (F.col("p_partkey") + 100000).cast("string")
    p = _parts(spark, sf)
    card = F.concat(F.lit('<li><div class="base-card" data-entity-urn="urn:li:jobPosting:'), n, F.lit('"><a class="full" href="https://li.example.com/jobs/view/'), n, F.lit('">go</a><h3>'), F.col("t"), F.lit(" !</h3><h4> "), F.col("p_brand"), F.lit(' </h4><span class="loc">'), F.col("l"), F.lit("</span></div></li>"))
    cards = H.cards(p.where("p_size % 5 <> 1").select(card.alias("html")), "div.base-card", {"urn": ("div.base-card", "data-entity-urn"), "href": ("a.full", "href"), "title": ("h3", None), "company": ("h4", None), "location": ("span.loc", None)})
    none = F.lit(None).cast("string")
    cards = cards.select(H.card_id().alias("id"), F.col("href").alias("url"), "title", "company", "location", none.alias("description"), none.alias("posted"))
    url = F.concat(F.lit("https://li.example.com/jobs/role-"), n)
    nodes = H.typed_nodes(p.where("p_size % 2 = 0").select(url.alias("url"), _ld_page(_node(F.struct(F.lit("Node").alias("name")).alias("hiringOrganization"), url.alias("url"))).alias("html")))
    details = N.posting_rows(nodes).withColumn("id", F.regexp_extract("url", r"(\d+)$", 1))
    return _shown(N.to_offers(N.merged_cards(cards, details), "linkedin", F.lit("2024-06-01").cast("timestamp")))


@query(_sql("p_size % 7 <> 0", source_url="'https://jobs.example.com/x/' || i", company="p_brand", remote_type="'remote'", city="'City ' || p_size % 9", country="'Land'"))
def source_weworkremotely(spark, sf):
    """Items of a feed; those without a link or a title are no offers."""
    p = _parts(spark, sf)
    rows = p.select(F.concat("p_brand", F.lit(": "), "t").alias("title"), F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("https://jobs.example.com/x/"), "i")).alias("link"), F.col("i").alias("guid"), F.col("d").alias("description"), F.concat("day", F.lit("T10:00:00Z")).alias("pubDate"), F.col("l").alias("region"), F.col("p_type").alias("category"))
    return _shown(N.to_offers(rows, "weworkremotely", F.lit("2024-06-01").cast("timestamp")))
