"""Scalar functions on texts made of the offers table, beside results labelled by hand.

Every offer gets one of a few texts by its number, with its own number put in; the SQL
holds what should come out, so it shares no rule with the functions.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .. import roles as R
from ..functions import dates as DT
from ..functions import extract as E
from ..functions import language as L
from ..functions import predicates as P
from ..functions import skills as K
from ..functions import text as X
from ..operators import conversation as C
from .queries import ORACLE_SQL, QUERIES

NOW = dt.datetime(2024, 6, 15, 12, 0, 0)


def _literal(v, types: list[str]) -> str:
    if v is None:
        return f"CAST(NULL AS {types[0]})"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, list):
        return "CAST([" + ", ".join(_literal(x, types) for x in v) + "] AS VARCHAR[])"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _sql(cases: list[tuple], names: list[str]) -> str:
    kinds, outs = [], []
    for i, n in enumerate(names, 1):
        known = next((c[i] for c in cases if c[i] is not None), "")
        kinds.append("VARCHAR[]" if isinstance(known, list) else "BOOLEAN" if isinstance(known, bool) else "INTEGER" if isinstance(known, int) else "DOUBLE" if isinstance(known, float) else "VARCHAR")
        put = "replace({}, '{{n}}', CAST(p_partkey AS VARCHAR))"
        outs.append((put.format(n) if kinds[-1] == "VARCHAR" else f"list_transform({n}, lambda x: {put.format('x')})" if kinds[-1] == "VARCHAR[]" else n) + f" AS {n}")
    rows = ", ".join(f"({k}, {', '.join(_literal(v, [t]) for v, t in zip(c[1:], kinds, strict=True))})" for k, c in enumerate(cases))
    return f"WITH v AS (SELECT * FROM (VALUES {rows}) t(k, {', '.join(names)})) SELECT p_partkey AS offer_id, {', '.join(outs)} FROM part JOIN v ON k = p_partkey % {len(cases)}"


def labelled(name: str, cases: list[tuple], build: dict[str, Callable[[Column], Column]]) -> None:
    """Register a query: ``cases`` are (text, *results), ``build`` names the functions of the text; ``{n}`` is the offer's number."""

    def run(spark, sf):
        offers = R.offers(spark, sf)
        chosen = F.get(F.array(*[F.lit(c[0]) for c in cases]), F.pmod("offer_id", F.lit(len(cases))).cast("int"))
        rows = offers.select("offer_id", F.replace(chosen, F.lit("{n}"), F.col("offer_id").cast("string")).alias("text"))
        return rows.select("offer_id", *[f(F.col("text")).alias(n) for n, f in build.items()])

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = _sql(cases, list(build))


def _at(x: Column) -> Column:
    return F.date_format(x, "yyyy-MM-dd HH:mm:ss")


def _part(x: Column, i: int) -> Column:
    return F.split_part(x, F.lit("|"), F.lit(i))


def register() -> None:
    labelled(
        "offer_hints",
        [
            ("International sales manager {n}", "job", None, None),
            ("Internal auditor, hybrid {n}", "job", "hybrid", None),
            ("Summer intern {n}", "internship", None, "student"),
            ("Stagiaire data, télétravail {n}", "internship", "remote", "student"),
            ("Backstage technician, on-site {n}", "job", "onsite", None),
            ("Leadership coach, wfh {n}", "job", "remote", None),
            ("Lead engineer, remote-friendly {n}", "job", "hybrid", "lead"),
            ("Sr. developer, in office {n}", "job", "onsite", "senior"),
            ("Junior staff accountant {n}", "job", None, "junior"),
            ("Working student, mid-level {n}", "internship", None, "student"),
            ("Étudiant confirmé {n}", "job", None, "student"),
            ("Head of apprentices {n}", "job", None, "lead"),
            ("Werkstudent Einkauf {n}", "internship", None, None),
        ],
        {"job_type": lambda t: X.guess_job_type(t), "mode": lambda t: X.guess_remote_type(t), "level": lambda t: X.guess_level(t)},
    )
    labelled(
        "canonical_urls",
        [
            ("HTTPS://Jobs.Example.org/role/{n}/?utm_source=x&lever-source=y&b=2&a=1#top", "https://jobs.example.org/role/{n}?a=1&b=2"),
            ("https://e.example/?msclkid=1&trackingId=2", "https://e.example/"),
            ("http://e.example/x?q=a%20b&z=&k=%C3%A9", "http://e.example/x?k=%C3%A9&q=a+b"),
            ("http://e.example/x//?gh_jid={n}&position=3", "http://e.example/x?gh_jid={n}"),
            ("http://e.example/x?b=2&b=1&_ga={n}", "http://e.example/x?b=1&b=2"),
        ],
        {"url": lambda t: X.normalize_url(t)},
    )
    labelled(
        "languages_by_markers",
        [
            ("Formation et compétences pour le poste {n}", "fr", "fr", "fr"),
            ("The skills and education of candidate {n} with a degree", "en", "en", "en"),
            ("Python {n}", "en", "en", None),
            ("Réalisations dans les projets de données {n}", "fr", "fr", "fr"),
            ("Je cherche un stage avec une équipe {n}", "fr", "fr", "fr"),
            ("I am looking for a job with you {n}", "en", "en", "en"),
            ("numbers one two three {n}", "en", "en", None),
        ],
        {"document": lambda t: L.detect_document(t), "message": lambda t: L.detect_message(t), "strict": lambda t: L.detect_strict(t)},
    )
    labelled(
        "posting_times",
        [
            ("2024-05-01T10:20:30+02:00", "2024-05-01 08:20:30", "2024-05-01 08:20:30"),
            ("2024-05-01", "2024-05-01 00:00:00", "2024-05-01 00:00:00"),
            ("03/04/2024", "2024-04-03 00:00:00", "2024-04-03 00:00:00"),
            ("04/23/2024", "2024-04-23 00:00:00", "2024-04-23 00:00:00"),
            ("7 May 2024", "2024-05-07 00:00:00", "2024-05-07 00:00:00"),
            ("May 7, 2024", "2024-05-07 00:00:00", "2024-05-07 00:00:00"),
            ("1714550400000", "2024-05-01 08:00:00", "2024-05-01 08:00:00"),
            ("2024-12-24", "2024-12-24 00:00:00", None),
            ("2031-01-01", None, None),
            ("1997-01-01", None, None),
            ("Posted 5 days ago", "2024-06-10 12:00:00", "2024-06-10 12:00:00"),
            ("3 hr", "2024-06-15 09:00:00", "2024-06-15 09:00:00"),
            ("il y a 2 semaines", "2024-06-01 12:00:00", "2024-06-01 12:00:00"),
            ("publiée hier", "2024-06-14 12:00:00", "2024-06-14 12:00:00"),
            ("1 année", "2023-06-16 12:00:00", "2023-06-16 12:00:00"),
            ("recently {n}", None, None),
        ],
        {"time": lambda t: _at(DT.parse_timestamp(t, F.lit(NOW).cast("timestamp"))), "posted": lambda t: _at(DT.posted_date(t, F.lit(NOW).cast("timestamp")))},
    )
    labelled(
        "skill_names",
        [
            ("Python 3.11", "python", ["python"]),
            ("K8s", "kubernetes", ["kubernetes"]),
            ("Postgres v15", "postgresql", ["postgresql"]),
            ("React.JS", "react", ["react"]),
            ("CI-CD", "ci/cd", []),
            ("Node.js 20", "node.js", ["node"]),
            ("  MS SQL ", "sql server", ["sql", "server"]),
            ("C++", "c++", ["c++"]),
            ("Golang!", "go", []),
            ("Spring-Boot {n}", "spring boot", ["spring", "boot"]),
        ],
        {"norm": lambda t: K.normalise(t), "tokens": lambda t: K.skill_tokens(t)},
    )
    labelled("item_lists", [("Python, React / Node.js", ["Python", "React", "Node.js"]), ("a;b • c.", ["a", "b", "c"]), ("x/y {n}", ["x/y {n}"]), (" .; ", [])], {"items": lambda t: K.split_items(t)})
    labelled("plain_glyphs", [("“{n}”…", '"{n}"...'), ("it’s – so", "it's - so"), ("a—b", "a - b"), ("plain {n}", "plain {n}")], {"plain": lambda t: E.plain_glyphs(t)})
    labelled("letter_paragraphs", [("a\nb\n\n c{n} \n\n\nd", ["a b", "c{n}", "d"]), ("one", ["one"]), ("\n\n", [])], {"blocks": lambda t: E.paragraphs(t)})
    labelled(
        "generated_references",
        [("see CV_AB12CD please", "CV_AB12CD"), ("LETTER_ZZZZZ9 and CV_AAAAA1", "LETTER_ZZZZZ9"), ("cv_ab12cd {n}", None), ("CV_ABC", None), ("xCV_ABCDEF", None)],
        {"reference": lambda t: E.find_reference(t)},
    )
    labelled("json_replies", [('```json\n{"a": {n}}\n```', '{"a": {n}}'), ('Sure: {"a": {"b": 1}} done', '{"a": {"b": 1}}'), ("nothing", None)], {"object": lambda t: E.json_object(t)})
    labelled("escaped_html", [("a < b & c > {n}", "a &lt; b &amp; c &gt; {n}"), ("&amp;", "&amp;amp;")], {"escaped": lambda t: E.html_escape(t)})
    labelled("normal_emails", [("  Joe.{n}@Example.ORG ", "joe.{n}@example.org"), ("a@b.c", "a@b.c")], {"email": lambda t: E.normal_email(t)})
    labelled(
        "education_dates",
        [
            ("2022|2024", "2022", "2024"),
            ("2022|Present", "2022", "Present"),
            ("2020|présent", "2020", "Présent"),
            ("Depuis 2022|", "2022", "Présent"),
            ("since 2018 -|now", "2018", "Présent"),
            ("|", None, None),
            ("Depuis {n}|2021", "{n}", "2021"),
        ],
        {"starts": lambda t: E.education_dates(_part(t, 1), _part(t, 2))["start"], "ends": lambda t: E.education_dates(_part(t, 1), _part(t, 2))["end"]},
    )
    labelled(
        "certifications",
        [
            ("• Cloud Practitioner, Skyhouse (2023)", "Cloud Practitioner", "Skyhouse", 2023),
            ("Data Analyst - Specialty 2019", "Data Analyst - Specialty", None, 2019),
            ("Cluster Admin (CA{n}), Orchard Foundation, 2021", "Cluster Admin (CA{n})", "Orchard Foundation", 2021),
            ("- First aid", "First aid", None, None),
            ("2020", None, None, None),
        ],
        {"name": lambda t: E.certification(t)["name"], "issuer": lambda t: E.certification(t)["issuer"], "year": lambda t: E.certification(t)["year"]},
    )
    labelled(
        "spoken_languages",
        [
            ("Anglais : Courant (C1)", "Anglais", "Courant (C1"),
            ("French - native", "French", "native"),
            ("Espagnol notions scolaires", "Espagnol", "notions scolaires"),
            ("German", "German", None),
            ("• Arabe (langue maternelle)", "Arabe", "langue maternelle"),
            ("Language {n} fluent", "Language {n}", "fluent"),
        ],
        {"language": lambda t: E.spoken_language(t)["language"], "level": lambda t: E.spoken_language(t)["level"]},
    )
    labelled(
        "derived_locations",
        [("Lyon|Banque de Lyon", None), ("Saint-Étienne|SAINT ETIENNE Métropole", None), ("Paris|Acme {n}", "Paris"), ("|Acme", ""), ("Rabat|", "Rabat")],
        {"location": lambda t: E.company_derived(_part(t, 1), _part(t, 2))},
    )
    labelled(
        "ownership_claims",
        [("I used it at work {n}", True), ("add Kafka", False), ("je maîtrise Spark", True), ("Depuis 2019", True), ("please remove {n}", False)],
        {"owns": lambda t: E.asserts_ownership(t)},
    )
    labelled(
        "job_titles",
        [
            ("Data engineer {n}|https://a.example/{n}", True),
            ("Apply now|https://a.example", False),
            ("Deutsch|https://a.example", False),
            ("12 - 14.5|https://a.example", False),
            ("QA|https://a.example", False),
            ("Join our talent pool {n}|http://a.example", False),
            ("Nurse|ftp://a.example", False),
            ("  SRE |HTTP://a.example", True),
        ],
        {"job": lambda t: P.looks_like_job(_part(t, 1), _part(t, 2))},
    )
    labelled(
        "board_ids",
        [("acme-{n}", True, True), ("-acme", False, False), ("a:b", False, True), ("a b", False, False), ("x" * 101, False, True), ("x" * 129, False, False), ("é", False, False)],
        {"slug": lambda t: P.valid_slug(t), "number": lambda t: P.valid_id(t)},
    )
    labelled(
        "salary_wishes",
        [
            ("at least 60k € please {n}", 60000, None, "EUR"),
            ("up to 75 000 usd", None, 75000, "USD"),
            ("max 50k gbp", None, 50000, "GBP"),
            ("no more than three offers, and remote; i want 55k eur", 55000, None, "EUR"),
            ("7 k", None, None, None),
            ("nothing {n}", None, None, None),
        ],
        {"low": lambda t: C.salary_slot(t)["low"], "high": lambda t: C.salary_slot(t)["high"], "currency": lambda t: C.salary_slot(t)["currency"]},
    )


register()
