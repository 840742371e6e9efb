"""Raw payloads of job sources onto the one offer schema: a projection for each source.

Readers explode a payload's list of offers; ``to_offers`` fills what a projection does not give,
derives types, levels and places, and drops rows without an identifier, URL or title.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..functions.dates import parse_timestamp
from ..schemas import OFFER


#: Characters that an offer keeps of its description.
DESCRIPTION = 8000


@dataclass(frozen=True)
class Source:
    """How one source's rows become offers; ``rows`` is the path of the list in the payload, empty if the payload is the list; ``first`` columns are replaced before the others are read."""

    rows: str
    schema: str
    fields: Callable[[], dict[str, Column]]
    priority: int
    keep: Callable[[], Column] | None = None
    first: Callable[[], dict[str, Column]] = dict


def _c(name: str) -> Column:
    return F.col(name)


def _s(name: str) -> Column:
    return F.col(name).cast("string")


def board_company(token: Column) -> Column:
    """A board's token as a name: dashes as spaces, words capitalised."""
    return F.initcap(F.replace(token, F.lit("-"), F.lit(" ")))


def _joined(*cols: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *[F.nullif(c, F.lit("")) for c in cols]), F.lit(""))


def _unescape(x: Column) -> Column:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _salary(x: Column) -> dict[str, Column]:
    p = X.parse_salary(x)
    return {"salary_min": p["low"], "salary_max": p["high"], "salary_currency": p["currency"]}


def _positive(x: Column) -> Column:
    v = x.cast("string").try_cast("double")
    return F.when(v > 0, v)


def _card() -> dict[str, Column]:
    return {"source_job_id": _s("id"), "source_url": _c("url"), "title": _c("title"), "company": _c("company"), "location": _c("location"), "description": _c("description"), "posted": _s("posted")}


def url_id(url: Column) -> Column:
    """The last part of a URL's path."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")
    return F.element_at(F.split(path, "/"), -1)


_CARD = "id string, url string, title string, company string, location string, description string, posted string"

SOURCES: dict[str, Source] = {
    "linkedin": Source("", _CARD, _card, 100),
    "indeed": Source("", _CARD + ", salary string, unit string", lambda: _card() | _salary(_c("salary")) | {"salary_period": F.lower("unit")}, 90),
    "greenhouse": Source(
        "jobs",
        "id bigint, title string, updated_at string, location struct<name:string>, absolute_url string, content string, departments array<struct<name:string>>",
        lambda: {"source_job_id": F.concat_ws(":", "board", _s("id")), "source_url": _c("absolute_url"), "title": _c("title"), "company": board_company(_c("board")), "location": _c("location.name"), "description": X.html_to_text(_unescape(_c("content")), DESCRIPTION), "posted": _c("updated_at"), "skills": F.transform("departments", lambda d: d["name"])},
        55,
    ),
    "lever": Source(
        "",
        "id string, text string, hostedUrl string, applyUrl string, createdAt bigint, categories struct<commitment:string,location:string,team:string>, descriptionPlain string, workplaceType string",
        lambda: {"source_job_id": _c("id"), "source_url": _c("hostedUrl"), "title": _c("text"), "company": board_company(_c("board")), "location": _c("categories.location"), "description": _c("descriptionPlain"), "employment_type": _c("categories.commitment"), "posted": _s("createdAt"), "remote_type": F.when(F.lower("workplaceType").isin("remote", "hybrid"), F.lower("workplaceType")).when(F.lower("workplaceType") == "on-site", "onsite")},
        55,
    ),
    "ashby": Source(
        "jobs",
        "id string, title string, location string, isListed boolean, isRemote boolean, descriptionPlain string, publishedAt string, employmentType string, jobUrl string, compensation struct<compensationTierSummary:string>",
        lambda: {"source_job_id": _c("id"), "source_url": _c("jobUrl"), "title": _c("title"), "company": board_company(_c("board")), "location": _c("location"), "description": _c("descriptionPlain"), "employment_type": _c("employmentType"), "posted": _c("publishedAt"), "remote_type": F.when(_c("isRemote"), "remote")} | _salary(_c("compensation.compensationTierSummary")),
        55,
        lambda: F.coalesce(_c("isListed"), F.lit(True)),
    ),
    "rippling": Source(
        "",
        "id bigint, uuid string, name string, url string, workLocation struct<id:string,label:string>, isRemote boolean, employmentType string, descriptionHtml string, createdAt string",
        lambda: {"source_job_id": _c("uuid"), "source_url": _c("url"), "title": _c("name"), "company": board_company(_c("board")), "location": F.coalesce("workLocation.label", "workLocation.id"), "description": X.html_to_text(_c("descriptionHtml"), DESCRIPTION), "employment_type": _c("employmentType"), "posted": _c("createdAt"), "remote_type": F.when(_c("isRemote"), "remote")},
        55,
    ),
    "smartrecruiters": Source(
        "content",
        "id string, name string, refNumber string, company struct<name:string>, releasedDate string, location struct<city:string,region:string,country:string,remote:boolean>, typeOfEmployment struct<label:string>, experienceLevel struct<label:string>",
        lambda: {"source_job_id": _c("id"), "source_url": F.concat(F.lit("https://jobs.smartrecruiters.com/"), _c("board"), F.lit("/"), _c("id")), "title": _c("name"), "company": F.coalesce("company.name", board_company(_c("board"))), "location": _joined(_c("location.city"), _c("location.region"), _c("location.country")), "posted": _c("releasedDate"), "employment_type": _c("typeOfEmployment.label"), "experience_text": _c("experienceLevel.label"), "remote_type": F.when(_c("location.remote"), "remote")},
        55,
    ),
    "workday": Source(
        "jobPostings",
        "title string, externalPath string, locationsText string, postedOn string, bulletFields array<string>, startDate string",
        lambda: {"source_job_id": F.coalesce(F.get(F.filter("bulletFields", lambda b: b.rlike("[0-9]")), 0), _c("externalPath")), "source_url": F.concat(F.lit("https://"), _c("board"), _c("externalPath")), "title": _c("title"), "company": board_company(F.split_part(_c("board"), F.lit("."), F.lit(1))), "location": F.when(~_c("locationsText").rlike(r"^\d+ Locations$"), _c("locationsText")), "posted": F.coalesce("startDate", "postedOn")},
        55,
    ),
    "oracle_hcm": Source(
        "items[0].requisitionList",
        "Id string, Title string, PostedDate string, PrimaryLocation string, PrimaryLocationCountry string, WorkplaceType string",
        lambda: {"source_job_id": _c("Id"), "source_url": F.concat(F.lit("https://"), _c("board"), F.lit("/job/"), _c("Id")), "title": _c("Title"), "company": board_company(F.split_part(_c("board"), F.lit("."), F.lit(1))), "location": _c("PrimaryLocation"), "country": _c("PrimaryLocationCountry"), "posted": _c("PostedDate"), "remote_type": X.guess_remote_type(_c("WorkplaceType"))},
        55,
    ),
    "phenom": Source(
        "refineSearch.data.jobs",
        "jobId string, title string, applyUrl string, cityStateCountry string, postedDate string, category string, type string, description string, ml_skills array<string>",
        lambda: {"source_job_id": _c("jobId"), "source_url": F.regexp_replace("applyUrl", "/apply/?$", ""), "title": _c("title"), "company": board_company(F.split_part(_c("board"), F.lit("."), F.lit(2))), "location": _c("cityStateCountry"), "description": _c("description"), "employment_type": _c("type"), "posted": _c("postedDate"), "skills": F.slice(F.array_compact(F.concat(F.array("category"), F.coalesce("ml_skills", F.array().cast("array<string>")))), 1, 8)},
        50,
    ),
    "career_pages": Source(
        "",
        _CARD + ", employment string, low double, high double, currency string",
        lambda: _card() | {"source_job_id": F.concat(X.url_host(_c("board")), F.lit(":"), F.coalesce(_s("id"), url_id(_c("url")))), "company": F.coalesce(F.nullif(_c("company"), F.lit("")), F.initcap(F.split_part(X.url_host(_c("board")), F.lit("."), F.lit(1)))), "employment_type": _c("employment"), "salary_min": _positive(_c("low")), "salary_max": _positive(_c("high")), "salary_currency": _c("currency")},
        50,
    ),
    "talentbrew": Source("", _CARD, _card, 45, lambda: X.url_host(_c("url")) == F.lower("board")),
    "adzuna": Source(
        "results",
        "id string, redirect_url string, title string, description string, created string, company struct<display_name:string>, location struct<display_name:string,area:array<string>>, salary_min double, salary_max double, contract_time string",
        lambda: {"source_job_id": _c("id"), "source_url": _c("redirect_url"), "title": _c("title"), "company": _c("company.display_name"), "location": _c("location.display_name"), "country": F.get("location.area", 0), "description": _c("description"), "posted": _c("created"), "employment_type": _c("contract_time"), "salary_min": _c("salary_min"), "salary_max": _c("salary_max"), "salary_currency": F.when(F.coalesce(_c("board"), F.lit("")) == "gb", "GBP")},
        45,
    ),
    "arbeitnow": Source(
        "data",
        "slug string, company_name string, title string, description string, remote boolean, url string, tags array<string>, job_types array<string>, location string, created_at bigint",
        lambda: {"source_job_id": _c("slug"), "source_url": _c("url"), "title": _c("title"), "company": _c("company_name"), "location": _c("location"), "description": X.html_to_text(_c("description"), DESCRIPTION), "skills": F.slice("tags", 1, 20), "employment_type": F.get("job_types", 0), "posted": _s("created_at"), "remote_type": F.when(_c("remote"), "remote")},
        40,
    ),
    "remotive": Source(
        "jobs",
        "id bigint, url string, title string, company_name string, category string, tags array<string>, job_type string, publication_date string, candidate_required_location string, salary string, description string",
        lambda: {"source_job_id": _s("id"), "source_url": _c("url"), "title": _c("title"), "company": _c("company_name"), "location": _c("candidate_required_location"), "description": X.html_to_text(_c("description"), DESCRIPTION), "skills": F.slice("tags", 1, 20), "employment_type": _c("job_type"), "posted": _c("publication_date"), "remote_type": F.lit("remote")} | _salary(_c("salary")) | {"salary_period": F.when(X.parse_salary(_c("salary"))["low"] > 1000, "year")},
        40,
    ),
    "jobicy": Source(
        "jobs",
        "id bigint, url string, jobTitle string, companyName string, jobIndustry array<string>, jobType array<string>, jobGeo string, jobLevel string, jobExcerpt string, jobDescription string, pubDate string, annualSalaryMin string, annualSalaryMax string, salaryCurrency string",
        lambda: {"source_job_id": _s("id"), "source_url": _c("url"), "title": _c("jobTitle"), "company": _c("companyName"), "location": _c("jobGeo"), "description": X.html_to_text(F.coalesce("jobDescription", "jobExcerpt"), DESCRIPTION), "employment_type": F.get("jobType", 0), "posted": _c("pubDate"), "experience_text": _c("jobLevel"), "salary_min": _positive(_c("annualSalaryMin")), "salary_max": _positive(_c("annualSalaryMax")), "salary_currency": F.nullif(_c("salaryCurrency"), F.lit("")), "remote_type": F.lit("remote")},
        35,
    ),
    "weworkremotely": Source(
        "",
        "title string, link string, guid string, description string, pubDate string, region string, category string",
        lambda: {"source_job_id": F.element_at(F.filter(F.split(X.normalize_url(_c("link")), "[/?]"), lambda p: p != ""), -1), "source_url": _c("link"), "title": F.trim(F.coalesce(F.nullif(F.regexp_extract("title", r"^[^:]+:\s*(.+)$", 1), F.lit("")), _c("title"))), "company": F.nullif(F.trim(F.regexp_extract("title", r"^([^:]+):\s*.+$", 1)), F.lit("")), "location": _c("region"), "description": X.html_to_text(_unescape(_c("description")), DESCRIPTION), "posted": _c("pubDate"), "remote_type": F.lit("remote")},
        35,
    ),
    "remoteok": Source(
        "",
        "legal string, id string, url string, position string, company string, tags array<string>, location string, salary_min double, salary_max double, date string, description string",
        lambda: {"source_job_id": _c("id"), "source_url": _c("url"), "title": _c("position"), "company": _c("company"), "location": _c("location"), "description": X.html_to_text(_c("description"), DESCRIPTION), "skills": F.slice("tags", 1, 20), "posted": _c("date"), "salary_min": _positive(_c("salary_min")), "salary_max": _positive(_c("salary_max")), "salary_currency": F.when(_positive(_c("salary_min")).isNotNull(), "USD"), "salary_period": F.when(_positive(_c("salary_min")).isNotNull(), "year"), "remote_type": F.lit("remote")},
        30,
        lambda: _c("legal").isNull(),
    ),
    "himalayas": Source(
        "jobs",
        "guid string, title string, companyName string, applicationLink string, description string, locationRestrictions array<string>, categories array<string>, seniority array<string>, employmentType string, pubDate string",
        lambda: {"source_job_id": _c("guid"), "source_url": _c("applicationLink"), "title": _c("title"), "company": _c("companyName"), "location": F.array_join("locationRestrictions", ", "), "description": X.html_to_text(_c("description"), DESCRIPTION), "skills": F.slice("categories", 1, 20), "employment_type": _c("employmentType"), "experience_text": F.get("seniority", 0), "posted": _c("pubDate"), "remote_type": F.lit("remote")},
        30,
    ),
    "hackernews": Source(
        "children",
        "id bigint, author string, created_at string, text string",
        lambda: _comment(_c("text")),
        20,
        lambda: F.length("text") >= 20,
        lambda: {"text": X.html_to_text(_c("text"), 6000)},
    ),
}


def _comment(body: Column) -> dict[str, Column]:
    """First line split at bars, dots, dashes or wide gaps: company, title, location."""
    parts = F.filter(F.transform(F.split(F.split_part(body, F.lit("\n"), F.lit(1)), r"\s*[|·–—]\s*|\s{2,}"), lambda p: F.trim(p)), lambda p: p != "")
    return {"source_job_id": _s("id"), "source_url": F.concat(F.lit("https://news.ycombinator.com/item?id="), _s("id")), "company": F.get(parts, 0), "title": F.coalesce(F.get(parts, 1), F.get(parts, 0)), "location": F.get(parts, 2), "description": body, "posted": _c("created_at")}


def read_payloads(spark: SparkSession, source: str, path: str, board: str = "") -> DataFrame:
    """Rows of landed JSON payloads (multi-line), a file each, with the source's schema and the board they are of."""
    s = SOURCES[source]
    if not s.rows:
        return spark.read.schema(s.schema).json(path, multiLine=True).withColumn("board", F.lit(board))
    return payload_rows(spark.read.text(path, wholetext=True), source, board)


def payload_rows(payloads: DataFrame, source: str, board: str = "") -> DataFrame:
    """Rows of JSON payloads that are rows of a table (``value``), so that many share a file, as ``read_payloads`` reads them."""
    s = SOURCES[source]
    parts = [p for p in s.rows.replace("[0]", "").split(".") if p]
    ddl = f"array<struct<{_struct(s.schema)}>>"
    for p in reversed(parts):
        ddl = f"struct<{p}:{ddl}>" if not (p == "items" and "[0]" in s.rows) else f"struct<{p}:array<{ddl}>>"
    raw = payloads.select(F.from_json("value", ddl).alias("v"))
    return raw.select(F.explode(F.expr(f"v.{s.rows}" if s.rows else "v")).alias("r")).select("r.*").withColumn("board", F.lit(board))


def _struct(ddl: str) -> str:
    """"a b, c d<e,f>" as "a:b,c:d<e,f>"."""
    out, depth, cur = [], 0, ""
    for ch in ddl + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, _, kind = cur.strip().partition(" ")
            out.append(f"{name}:{kind}")
            cur = ""
        else:
            cur += ch
    return ",".join(out)


def to_offers(raw: DataFrame, source: str, now: Column) -> DataFrame:
    """``OFFER`` rows of one source; rows without identifier, usable URL or title go."""
    s = SOURCES[source]
    if "board" not in raw.columns:
        raw = raw.withColumn("board", F.lit(""))
    raw = raw.withColumns(s.first()) if s.first() else raw
    if s.keep is not None:
        raw = raw.where(s.keep())
    fields = s.fields()
    raw = raw.select(*(v.alias(f"__{k}") for k, v in fields.items()))  # computed once, however often they are used below
    got = {k: F.col(f"__{k}") for k in fields}
    null = F.lit(None).cast("string")
    title, body = got["title"], got.get("description", null)
    raw = raw.where(X.let(got["source_url"], X.usable_url))  # here, or the filter below would test a URL a second time
    raw, place = raw.select("*", X.split_city_country(got.get("location", null)).alias("__place")), F.col("__place")
    hints = F.concat_ws(" ", title, body)
    columns = {
        "source": F.lit(source),
        "source_job_id": F.nullif(got["source_job_id"], F.lit("")),
        "source_url": got["source_url"],
        "title": X.clean_text(title),
        "company": X.clean_text(got.get("company", null)),
        "location": X.clean_text(got.get("location", null)),
        "city": place["city"],
        "country": F.coalesce(got.get("country", null), place["country"]),
        "description": body,
        "employment_type": got.get("employment_type", null),
        "job_type": X.guess_job_type(F.concat_ws(" ", title, got.get("employment_type", null))),
        "remote_type": F.coalesce(got.get("remote_type", null), X.guess_remote_type(hints)),
        "salary_min": got.get("salary_min", null).cast("double"),
        "salary_max": got.get("salary_max", null).cast("double"),
        "salary_currency": got.get("salary_currency", null),
        "salary_period": got.get("salary_period", null),
        "experience_level": X.guess_level(F.concat_ws(" ", got.get("experience_text", null), title)),
        "skills": F.slice(X.ordered_distinct_insensitive(F.coalesce(got["skills"], F.array().cast("array<string>"))), 1, 25) if "skills" in got else F.array().cast("array<string>"),
        "posted_at": parse_timestamp(got.get("posted", null), now),
        "priority": F.lit(s.priority),
    }
    out = raw.select(*[columns[name].cast(kind).alias(name) for name, kind in OFFER.items()])
    return out.where(F.col("source_job_id").isNotNull() & F.col("source_url").isNotNull() & F.col("title").isNotNull())


def posting_rows(nodes: DataFrame, node: str = "node", page: str = "url") -> DataFrame:
    """Raw rows (``board``: the page's URL) of JSON-LD postings, as ``html.typed_nodes`` finds them; of several places the first counts."""
    at = lambda path: F.get_json_object(node, f"$.{path}")
    place = lambda part: F.coalesce(at(f"jobLocation[0].address.{part}"), at(f"jobLocation.address.{part}"))
    ident = F.when(at("identifier").startswith("{"), at("identifier.value")).otherwise(at("identifier"))
    return nodes.select(
        F.nullif(ident, F.lit("")).alias("id"), F.coalesce(at("url"), at("sameAs"), F.col(page)).alias("url"), F.coalesce(F.nullif(at("title"), F.lit("")), at("name")).alias("title"), at("hiringOrganization.name").alias("company"),
        _joined(*(F.coalesce(place(p), F.lit("")) for p in ("addressLocality", "addressRegion", "addressCountry"))).alias("location"), X.html_to_text(at("description"), DESCRIPTION).alias("description"), at("datePosted").alias("posted"),
        F.coalesce(at("employmentType[0]"), at("employmentType")).alias("employment"), at("baseSalary.value.minValue").try_cast("double").alias("low"), at("baseSalary.value.maxValue").try_cast("double").alias("high"), at("baseSalary.currency").alias("currency"), F.col(page).alias("board"),
    )


def merged_cards(cards: DataFrame, details: DataFrame) -> DataFrame:
    """Card rows and detail rows of one source by id: a full outer join where the card's value wins and fills what it lacks from the detail.

    Both have ``_CARD``'s columns; the first row of an id (in order of ``place``, if there) counts, rows without an id go.
    """
    names = [c.split(" ")[0] for c in _CARD.split(", ")]

    def once(rows: DataFrame, name: str) -> DataFrame:
        order = F.col("place") if "place" in rows.columns else F.lit(0)
        return rows.where("id IS NOT NULL AND id <> ''").groupBy("id").agg(F.min(F.struct(order.alias("o"), *names[1:])).alias(name))

    both = once(cards, "c").join(once(details, "d"), "id", "full")
    return both.select("id", *(F.coalesce(F.nullif(F.col(f"c.{n}"), F.lit("")), F.col(f"d.{n}")).alias(n) for n in names[1:]))


def best_by_uuid(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """One row of each uuid (else id): the first, or if that has no description the first one that has."""
    key = F.coalesce(F.nullif("uuid", F.lit("")), F.col("id").cast("string"))
    described = F.coalesce(F.nullif("descriptionHtml", F.lit("")).isNotNull(), F.lit(False))
    return rows.where(key.isNotNull()).groupBy(key.alias("__k")).agg(F.min(F.struct((~described).alias("bare"), F.col(seq).alias("first"), F.struct(*rows.columns).alias("r"))).alias("m")).select("m.r.*").drop("__k")


def within_source(offers: DataFrame, seq: str = "seq") -> DataFrame:
    """The first row of each (source, identifier), ignoring case."""
    keyed = offers.withColumn("__k", F.lower("source_job_id"))
    rest = [c for c in offers.columns if c not in ("source", seq)]
    return keyed.groupBy("source", "__k").agg(F.min(F.struct(seq, *rest)).alias("t")).select("source", "t.*").select(*offers.columns)


RSS_ITEM = "title: string, link: string, guid: string, description: string, content: string, pubDate: string, region: string, category: string"


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    """``rss_items`` of feeds that are a file each."""
    return rss_items(spark.read.text(path, wholetext=True))


def rss_items(feeds: DataFrame) -> DataFrame:
    """Items of RSS 2.0 feeds, rows of a table (``value``), as rows of text fields, by Spark's XML parser.

    Name spaces are stripped, and of repeated elements (title and media:title) the last counts; a description that is missing
    comes from the content.  CDATA and references are text.  A feed that is not well-formed has no items.
    """
    feed = F.from_xml("value", f"channel struct<item: array<struct<{RSS_ITEM}>>>", {"ignoreNamespace": "true"})
    item = feeds.select(feed.alias("v")).select(F.explode("v.channel.item").alias("i"))
    text = lambda c: F.nullif(F.trim(F.col("i")[c]), F.lit(""))
    rest = ("title", "link", "guid", "pubDate", "region", "category")
    return item.select(*[text(c).alias(c) for c in rest], F.coalesce(text("description"), text("content")).alias("description"))


def json_ld(pages: DataFrame, html: str = "html", kind: str = "JobPosting") -> DataFrame:
    """JSON-LD nodes of one type in the pages' script blocks; single objects, lists and @graph lists."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    node = pages.select("*", F.explode(blocks).alias("__b"))
    parsed = F.from_json("__b", "struct<`@graph`:array<string>>")
    as_list = F.from_json("__b", "array<string>")
    nodes = F.when(F.col("__b").rlike(r"^\s*\["), as_list).when(F.size(parsed["@graph"]) > 0, parsed["@graph"]).otherwise(F.array("__b"))
    return node.withColumn("node", F.explode(F.coalesce(nodes, F.array().cast("array<string>")))).drop("__b").where(F.get_json_object("node", "$['@type']") == kind)


def board_tokens(lines: DataFrame, pattern: str = "^[A-Za-z0-9._-]{1,100}$") -> DataFrame:
    """Tokens of a list file: a comment starts at #, invalid lines go, the first spelling stays."""
    t = F.trim(F.split_part("value", F.lit("#"), F.lit(1)))
    return lines.select(t.alias("token")).where(F.col("token").rlike(pattern)).groupBy(F.lower("token").alias("k")).agg(F.min("token").alias("token")).select("token")
