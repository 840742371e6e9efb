"""Functions of people's documents beside results labelled by hand, and conversation steps, sources and upserts on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import roles as R
from ..functions import profile as Q
from ..operators import agent as G
from ..operators import relational as J
from ..sources import html as H
from .labelled import _part, labelled
from .queries import query


def _written(t):
    return Q.classified_links(F.lit(None).cast("array<string>"), Q.links(t))


def _annotated(t):
    return Q.classified_links(F.array(_part(t, 1)), F.array(_part(t, 2)))


def register() -> None:
    labelled(
        "written_links",
        [
            ("see https://linkedin.com/in/ann{n} and github.com/ann{n}/tool", "https://linkedin.com/in/ann{n}", "https://github.com/ann{n}/tool", None, []),
            ("mail ann@firm.org, site www.ann{n}.dev.", None, None, "https://www.ann{n}.dev", []),
            ("github.com/a{n} github.com/b{n}, GITHUB.com/a{n}/", None, "https://github.com/a{n}", None, ["https://github.com/b{n}"]),
            ("https://ann{n}.github.io twitter.com/ann", None, None, "https://ann{n}.github.io", ["https://twitter.com/ann"]),
            ("nothing here {n}", None, None, None, []),
        ],
        {
            "linkedin": lambda t: _written(t)["linkedin"],
            "github": lambda t: _written(t)["github"],
            "portfolio": lambda t: _written(t)["portfolio"],
            "others": lambda t: _written(t)["others"],
        },
    )
    labelled(
        "annotated_links",
        [
            ("mailto:ann{n}@firm.org|https://a{n}.example.org/x", "ann{n}@firm.org", "https://a{n}.example.org/x"),
            ("https://b{n}.org|https://a{n}.org", None, "https://b{n}.org"),
            ("  |x{n}.io", None, "https://x{n}.io"),
        ],
        {
            "email": lambda t: _annotated(t)["email"],
            "portfolio": lambda t: _annotated(t)["portfolio"],
        },
    )
    labelled(
        "personal_pages",
        [
            ("https://www.linkedin.com/in/x https://me{n}.org/work", "https://me{n}.org/work"),
            ("x@gmail.com · ann{n}.dev", "ann{n}.dev"),
            ("https://github.com/x{n}", None),
        ],
        {"portfolio": lambda t: Q.portfolio(t)},
    )
    labelled(
        "contact_places",
        [
            ("Ann Lee\n+ Rabat, Morocco | +212 600 000 000\nann@firm.org", "Rabat, Morocco"),
            ("\n\nAnn Lee\n12 Main Road, Leeds, England", "12 Main Road, Leeds, England"),
            ("Ann Lee\n\nParis, France", None),
            ("ann@firm.org; Saint-Denis, France", "Saint-Denis, France"),
            ("one\ntwo\nthree\nfour\nfive\nParis, France {n}", None),
        ],
        {"place": lambda t: Q.place(t)},
    )
    labelled(
        "profile_prose",
        [
            ("ANN LEE\nann@firm.org\nEngineer who builds large data systems\nand likes to explain them well.\nRabat city", "Engineer who builds large data systems and likes to explain them well."),
            ("Too short {n}", None),
            ("Writes careful code every single day\n\nand tests it {n} times\nAnn Lee\nshort line", "Writes careful code every single day and tests it {n} times"),
            ("Builds pipelines for many teams\nphone\nBuilds dashboards for many users", "Builds dashboards for many users"),
        ],
        {"prose": lambda t: Q.longest_prose(t, F.lit("Ann Lee"), F.array(F.lit("ann@firm.org")))},
    )
    labelled(
        "interest_items",
        [
            ("Chess, Running, ann@firm.org, Data engineer", ["Chess", "Running"]),
            ("Music; LEE; Travel 2019; Hobbies", ["Music"]),
            ("Ann Lee, Climbing, climbing {n}x", ["Climbing", "climbing {n}x"]),
            ("", []),
        ],
        {"items": lambda t: Q.free_items(t, F.lit("Ann Lee"), F.array(F.lit("ann@firm.org")))},
    )
    labelled(
        "degree_fields",
        [
            ("Master en Informatique {n}|", "Master", "Informatique {n}"),
            ("B.Sc. (Excellence) in AI|", "B.Sc. (Excellence)", "AI"),
            ("Licence d'Excellence|", "Licence d'Excellence", None),
            ("Bachelor of Science in Physics|", "Bachelor of Science", "Physics"),
            ("Bachelor, Biology|", "Bachelor", "Biology"),
            ("Master|en Data {n}", "Master", "Data {n}"),
            ("Course {n}|", "Course {n}", None),
            ("|", None, None),
        ],
        {"degree": lambda t: Q.split_degree(_part(t, 1), _part(t, 2))["degree"], "field": lambda t: Q.split_degree(_part(t, 1), _part(t, 2))["field"]},
    )
    labelled(
        "restored_degrees",
        [
            ("Licence|d'Excellence - Droit|2019 Licence d'Excellence - Droit", "Licence d'Excellence", "Droit"),
            ("Bachelor|Physics {n}|BACHELOR of Science, Physics", "BACHELOR of Science", "Physics {n}"),
            ("Master|Law|Master in Law {n}", "Master", "Law"),
            ("|Law|of science", None, "Law"),
        ],
        {"degree": lambda t: Q.restored_degree(_part(t, 1), _part(t, 2), _part(t, 3))["degree"], "field": lambda t: Q.restored_degree(_part(t, 1), _part(t, 2), _part(t, 3))["field"]},
    )
    labelled(
        "unsupported_claims",
        [
            ("Led 12 people, saved 40 % with Kubernetes|I led 12 people", ["40 %", "Kubernetes"]),
            ("Managed the Kafka cluster|kafka user {n}", []),
            ("Built 3 services in Rust and PostgreSQL|postgresql, rust", ["3"]),
            ("  |x", []),
        ],
        {"facts": lambda t: Q.unsupported_facts(_part(t, 1), _part(t, 2))},
    )
    labelled(
        "title_wishes",
        [
            ("i am looking for a backend engineer python in lyon", "Backend Engineer Python"),
            ("bonjour, un poste de data analyst, cdi {n}", "Data Analyst"),
            ("looking for a gardener, please {n}", "Gardener"),
            ("something in devops {n}", "Devops"),
            ("senior site reliability engineer wanted", "Senior Site Reliability Engineer"),
            ("hello {n}", None),
        ],
        {"title": lambda t: Q.title_slot(t)},
    )
    labelled(
        "pending_actions",
        [
            ("apply|a,b|2024-06-15T11:45:00Z", True),
            ("apply|a|2024-06-15T11:29:00Z", False),
            ("apply||2024-06-15T11:45:00Z", False),
            ("search|a|2024-06-15T11:45:00Z", False),
            ("apply|a|soon {n}", False),
            ("apply|a|2024-06-15 11:30:00", True),
        ],
        {"valid": lambda t: G.pending_is_valid(_part(t, 1), F.filter(F.split(_part(t, 2), ","), lambda x: x != ""), _part(t, 3), F.lit("2024-06-15 12:00:00Z").cast("timestamp"))},
    )


register()


@query(
    """WITH s AS (SELECT l_orderkey AS id, list(l_partkey ORDER BY l_linenumber, l_partkey) AS sel, list(p_name ORDER BY l_linenumber, l_partkey) AS names FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)
    SELECT id, CASE id % 4 WHEN 0 THEN sel WHEN 1 THEN list_filter(sel, lambda x, i: contains(names[i], 'ring')) WHEN 2 THEN [sel[1]] ELSE CASE WHEN len(sel) >= 2 THEN [sel[2]] ELSE [] END END AS targets FROM s"""
)
def apply_targets(spark, sf):
    """Offers a user applies to: all, by title, by identifier (one that isn't selected is left out), or by place."""
    offers = R.offers(spark, sf).select("offer_id", "title")
    entry = F.struct("seq", "offer_id", F.col("offer_id").cast("string").alias("id"), "title")
    s = R.saved(spark, sf).join(offers, "offer_id").groupBy(F.col("application_id").alias("id")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    s = s.select("id", F.transform("e", lambda e: F.struct(e["id"].alias("id"), e["title"].alias("title"))).alias("sel"))
    scope = F.get(F.array(F.lit("all"), F.lit("filter"), F.lit("ids"), F.lit("ids")), (F.col("id") % 4).cast("int"))
    named = F.when(F.col("id") % 4 == 2, F.array(F.get("sel", 0)["id"], F.lit("-5"))).otherwise(F.array(F.lit(" 2"), F.lit("-99"), F.lit("x")))
    targets = G.apply_targets(scope, F.lit(" Ring"), named, F.col("sel"))
    return s.select("id", F.transform(targets, lambda t: t.cast("long")).alias("targets"))


@query(
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'top' WHEN o_orderkey % 4 = 1 THEN 's1' END AS target_id, o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 4 >= 2 AS requires_information,
    CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 4 >= 2 THEN 'Which of your selected roles do you mean exactly? (give its number)' END AS question FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0 OR o_orderkey % 4 <> 0"""
)
def clarified_targets(spark, sf):
    i = F.col("id")
    recs = R.applications(spark, sf).select(
        "id", F.when(i % 5 == 0, "Review the best").otherwise("Write a letter").alias("action"), F.when(i % 3 == 0, "document").otherwise("job").alias("target_type"), F.lit(None).cast("string").alias("target_id"), F.lit(None).cast("string").alias("question")
    )
    selected = F.slice(F.array(F.lit("s1"), F.lit("s2"), F.lit("s3")), 1, (i % 4).cast("int"))
    return G.resolved_targets(recs, selected, F.lit("en"), F.array(F.lit("top"))).select("id", "target_id", "requires_information", "question")


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_orderkey % 2 = 0 AS job, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice % 100 END AS ats, o_orderkey % 40 AS w, o_orderkey % 6 AS sel, o_orderkey % 3 AS app FROM orders)
    SELECT id, array_to_string(list_filter([CASE WHEN job AND ats < 50 THEN 'review_match' END, CASE WHEN job AND ats < 60 AND w < 25 THEN 'improve_summary' END, CASE WHEN job AND (w = 0 OR coalesce(ats < 55, false)) THEN 'review_experience' END, CASE WHEN job THEN 'confirm_skill:Kafka' END, CASE WHEN job AND w % 2 = 0 THEN 'review_uncertain_skill:SQL' END,
      CASE WHEN job AND w % 3 = 0 THEN 'generate_targeted_cv' END, CASE WHEN w % 5 <> 0 AND (job OR sel > 0) THEN 'generate_cover_letter' END, CASE WHEN w % 5 = 0 AND w % 2 = 0 THEN 'review_cover_letter' END, CASE WHEN sel >= 3 AND app = 0 THEN 'review_selected_jobs' END, CASE WHEN sel - app >= 1 AND w > 10 THEN 'apply_to_selected_jobs' END, CASE WHEN w = 7 THEN 'request_information:period' END], lambda x: x IS NOT NULL), ',') AS actions FROM o"""
)
def next_actions(spark, sf):
    i = F.col("id")
    w, strings = i % 40, "array<string>"
    c = {
        "has_job": i % 2 == 0, "ats": F.when(i % 7 == 0, None).otherwise(F.col("score") % 100), "summary_words": w, "bullet_counts": F.array(w, F.lit(3).cast("long")), "missing": F.array(F.lit("Kafka")),
        "uncertain": F.when(w % 2 == 0, F.array(F.lit("SQL"))), "has_cv": w % 3 != 0, "has_letter": w % 5 == 0, "letter_outdated": w % 2 == 0, "selected": i % 6, "applied": i % 3, "weak_jobs": F.array().cast(strings), "commanded": w <= 10, "topic": F.when(w == 7, "period"),
    }
    acts = G.next_actions(c)
    return R.applications(spark, sf).select("id", F.array_join(F.transform(acts, lambda a: F.concat_ws(":", a["type"], a["subject"])), ",").alias("actions"))


@query(
    """WITH r AS (SELECT l_partkey AS id, arg_max(x, (l_orderkey * 10 + l_linenumber, x)) AS b FROM (SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag || l_linenumber AS x FROM lineitem) GROUP BY 1)
    SELECT p_partkey AS offer_id, CASE WHEN b IS NOT NULL AND p_size % 2 = 0 THEN [b] WHEN p_size % 3 = 0 THEN ['own'] WHEN p_size % 5 = 0 THEN [] ELSE [p_type] END AS bullets FROM part LEFT JOIN r ON id = p_partkey"""
)
def role_bullets(spark, sf):
    o = R.offers(spark, sf)
    flag = R.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("id"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("b"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    experience = o.select(
        F.col("offer_id").alias("id"), F.col("title").alias("position"), "company", F.when(F.col("size") % 3 == 0, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>")).alias("achievements"), F.when(F.col("size") % 5 == 0, "").otherwise(F.col("job_type")).alias("description"), "size"
    )
    names = o.where("size % 2 = 0").select(F.col("offer_id").alias("id"), F.upper(F.concat_ws(" @ ", "title", "company")).alias("role"))
    return G.role_bullets(experience, flag.join(names, "id").select("id", "role", "seq", F.array("b").alias("bullets"))).select(F.col("id").alias("offer_id"), "bullets")


@query(
    """SELECT l_orderkey * 8 + l_linenumber AS request, CASE WHEN l_linenumber % 3 = 0 THEN 404 WHEN o_custkey % 2 = 0 THEN 200 ELSE 403 END AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
)
def access_by_owner(spark, sf):
    apps = R.applications(spark, sf).select("id", "user_id")
    asked = R.saved(spark, sf).join(apps, F.col("application_id") == F.col("id"))
    user = F.when(F.col("user_id") % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1)
    requests = asked.select((F.col("application_id") * 8 + F.col("seq")).alias("request"), F.when(F.col("seq") % 3 == 0, -F.col("id") - 1).otherwise(F.col("id")).alias("id"), user.alias("user_id"))
    return G.access_status(requests, apps).select("request", "status")


@query("SELECT event_id, ['k=' || CAST(json_extract(props, '$.k') AS VARCHAR), repeat('n', 40) || '=' || repeat('v', 60), 'u=' || user_id] AS kept FROM events")
def safe_metadata(spark, sf):
    """Metadata of events with a long key and value, a nested value and more entries than are kept."""
    e = R.usage_events(spark, sf)
    extra = f', "{"n" * 45}": "{"v" * 70}", "deep": {{"x": 1}}, "list": [1], "u": '
    filler = "".join(f', "m{i}": {{}}' for i in range(3)) + ', "ninth": 9}'
    json = F.concat(F.regexp_replace("meta", r"\}$", ""), F.lit(extra), F.col("user_id").cast("string"), F.lit(filler))
    kept = F.map_entries(Q.safe_metadata(json))
    return e.select("event_id", F.transform(kept, lambda x: F.concat(x["key"], F.lit("="), x["value"])).alias("kept"))


@query("SELECT page_id, url AS posting_url, 'Role ' || page_id AS title FROM pages WHERE page_id % 4 <> 3")
def posting_nodes(spark, sf):
    """The first JSON-LD posting of pages that hold it in a graph, in a second object, in a list, or (every fourth) broken."""
    p, i = R.spread(R.read(spark, sf, "pages"), "page_id"), F.col("page_id")
    node = F.to_json(F.struct(F.array(F.lit("Thing"), F.lit("jobPosting")).alias("@type"), F.concat(F.lit("Role "), i.cast("string")).alias("title"), F.col("url").alias("url")))
    site = F.lit('{"@type": "WebSite", "name": "s"}')
    body = F.when(i % 4 == 0, F.concat(F.lit('{"@graph": [{"@type": "Org"}, {"main": '), node, F.lit("}]}"))).when(i % 4 == 1, F.concat(site, F.lit("\n"), node)).when(i % 4 == 2, F.concat(F.lit("["), site, F.lit(","), node, F.lit("]"))).otherwise(F.concat(F.lit('{"@type": "JobPosting", "title": oops}')))
    pages = p.select("page_id", F.concat(F.lit('<script type="application/ld+json">'), body, F.lit("</script>"), F.coalesce("html", F.lit(""))).alias("html"))
    found = H.typed_nodes(pages)
    return found.select("page_id", F.get_json_object("node", "$.url").alias("posting_url"), F.get_json_object("node", "$.title").alias("title"))


@query(
    """SELECT p_partkey AS offer_id, place, CAST(100000 + p_partkey + place AS VARCHAR) AS job_id, p_name || ' & co' AS title, CASE WHEN place = 0 THEN p_brand END AS company FROM part, (VALUES (0), (1)) v(place)"""
)
def page_cards(spark, sf):
    """Cards of pages: the number from the urn or else the link, texts with entities and inner tags, missing parts."""
    o, n = R.spread(R.offers(spark, sf), "offer_id"), F.col("offer_id")
    text = lambda s: F.lit(s)
    first = F.concat(text('<li class="x card"><div data-urn="urn:li:job:'), (n + 100000).cast("string"), text('"></div><h3 class="t">\n '), F.col("title"), text(' <b>&amp;</b> co</h3><img class="c"><h4 class="c">'), F.col("company"), text("</h4></li>"))
    second = F.concat(text('<li class="card"><a class="full" href="/view/role-at-x-'), (n + 100001).cast("string"), text('?ref=1">go</a><h3 class="t">'), F.col("title"), text(" &amp;  co</h3><h4 class='c'> </h4></li>"))
    pages = o.select("offer_id", F.concat(text("<ul><h3 class='t'>outside</h3>"), first, second, text("</ul>")).alias("html"))
    rows = H.cards(pages, "li.card", {"urn": ("div", "data-urn"), "href": ("a.full", "href"), "title": ("h3.t", None), "company": ("h4.c", None)})
    return rows.select("offer_id", "place", H.card_id().alias("job_id"), "title", "company")


@query(
    """WITH n AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 1 ELSE 2 END AS way, * FROM part WHERE p_size >= 10)
    SELECT p_partkey AS id, CASE WHEN p_size BETWEEN 10 AND 40 THEN 'updated' WHEN p_size < 10 THEN 'kept' ELSE 'inserted' END AS state, CASE WHEN p_size BETWEEN 10 AND 40 THEN CASE WHEN p_size % 3 = 0 THEN p_name || p_name ELSE p_name END WHEN p_size < 10 THEN p_name ELSE CASE WHEN p_size % 3 = 0 THEN p_name || p_name ELSE 'x' END END AS description,
    CASE WHEN p_size < 10 THEN ['sql', p_brand] WHEN p_size <= 40 THEN ['sql', p_brand, 'rust'] ELSE [p_brand, 'rust'] END AS skills, CASE WHEN p_size < 10 THEN 'a=1;b=1' WHEN p_size <= 40 THEN 'a=1;b=2;c=3' ELSE 'b=2;c=3' END AS meta,
    CASE WHEN p_size < 10 THEN NULL WHEN p_size % 5 = 0 THEN DATE '2024-07-15' ELSE DATE '2024-06-01' + 30 END AS expires FROM part"""
)
def offer_upsert(spark, sf):
    """Fetched offers into a table: matched by content hash, else by source and number."""
    o, s = R.offers(spark, sf), F.col("size")
    text = F.col("offer_id").cast("string")
    have = o.where("size <= 40").select(
        F.col("offer_id").alias("id"), F.concat(F.lit("h"), text).alias("content_hash"), F.lit("feed").alias("source"), text.alias("source_job_id"), "title", F.col("title").alias("description"), F.array(F.lit("sql"), F.col("company")).alias("skills"),
        F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")).alias("metadata"), F.lit(None).cast("date").alias("posted_at"), F.lit(None).cast("date").alias("expires_at"),
    )
    new = o.where("size >= 10").select(
        F.when((s % 2 == 0) | (s > 40), F.concat(F.lit("h"), text)).otherwise(F.concat(F.lit("other"), text)).alias("content_hash"), F.lit("feed").alias("source"), F.when(s % 2 == 0, F.concat(F.lit("moved"), text)).otherwise(text).alias("source_job_id"), "title", F.when(s % 3 == 0, F.concat("title", "title")).otherwise("x").alias("description"),
        F.array(F.col("company"), F.lit("rust")).alias("skills"), F.create_map(F.lit("b"), F.lit("2"), F.lit("c"), F.lit("3")).alias("metadata"), F.when(s % 5 != 0, F.lit("2024-06-01").cast("date")).alias("posted_at"), F.lit(None).cast("date").alias("expires_at"), F.col("offer_id").alias("seq"),
    )
    out = J.upsert_offers(have, new, F.lit("2024-06-15").cast("date"))
    key = F.regexp_extract(F.coalesce("source_job_id", F.lit("")), r"(\d+)$", 1).cast("long")
    meta = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.select(F.coalesce("id", key).alias("id"), "state", "description", "skills", meta.alias("meta"), F.col("expires_at").alias("expires"))
