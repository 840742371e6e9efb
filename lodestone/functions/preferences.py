"""Wishes of a conversation, contexts of searches, reasons of a match, durations of work, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .dates import duration_months, format_months, parse_point
from .extract import PRESENT, SINCE
from .text import let

# Words of work modes, of internships, of levels and of contracts, in the order in which they are looked for
MODES = [
    ("remote", r"remote|télétravail|tele-travail|télé-travail|100%?\s*remote|fully remote|full remote"),
    ("hybrid", r"hybrid|hybride|\d\s*(?:jours?|days?)\s*(?:de\s*)?(?:télétravail|remote|présentiel|bureau|office)"),
    ("onsite", r"on-?site|sur site|sur place|présentiel|in office|in-office|on premises"),
]
NO_INTERNSHIP = r"pas de stage|aucun stage|no internship|not an internship|non stage|hors stage"
INTERNSHIP = r"stage|internship|stagiaire|alternance|apprentissage|intern"
LEVELS = [
    ("lead", r"lead|principal|staff engineer|head of"), ("senior", r"senior|sénior|confirmé|expérimenté|expert"), ("mid", r"mid-?level|intermédiaire|medior"),
    ("junior", r"junior|débutant accepté"), ("entry", r"entry-?level|premier emploi|graduate"), ("student", r"étudiant|student|en études"),
]
CONTRACTS = [
    ("permanent", r"cdi|permanent|full[- ]?time perm"), ("fixed-term", r"cdd|fixed[- ]?term|temporary contract"),
    ("freelance", r"freelance|indépendant|independent contractor|contractor"), ("apprenticeship", r"alternance|apprentissage|apprenticeship"),
]
#: What is asked for, the most wanted first.
QUESTIONS = [
    ("query/keywords", "What kind of role or field are you looking for?"),
    ("job_type", "Are you looking for a job or an internship?"),
    ("location/remote_type", "Which location are you targeting, or do you prefer remote / hybrid?"),
    ("internship_start_date/availability", "When would you be available to start?"),
    ("internship_duration_months", "How long an internship do you need (in months)?"),
    ("skills", "Which skills or technologies should the role involve?"),
    ("experience_level", "What experience level are you targeting (student, junior, mid, senior)?"),
]
#: Numbers in words, units of time, and what separates two dates.
NUMBERS = {
    "un": 1, "une": 1, "one": 1, "deux": 2, "two": 2, "trois": 3, "three": 3, "quatre": 4, "four": 4, "cinq": 5, "five": 5, "six": 6, "sept": 7, "seven": 7, "huit": 8, "eight": 8, "neuf": 9, "nine": 9,
    "dix": 10, "ten": 10, "onze": 11, "eleven": 11, "douze": 12, "twelve": 12, "dix-huit": 18, "eighteen": 18, "vingt-quatre": 24,
}
UNITS = r"mois|months?|semaines?|weeks?|ans?|annees?|années?|years?|jours?|days?"
BETWEEN = r"(?iU)\s*(?:-|–|—|to|à|au|\bjusqu['’]?\s*(?:au|à)?\b)\s*"

_STRINGS = "array<string>"


def _whole(words: str) -> str:
    return rf"(?U)\b({words})\b"


def _first_of(blob: Column, choices: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for name, words in reversed(choices):
        out = F.when(blob.rlike(_whole(words)), name).otherwise(out)
    return out


def slots(blob: Column, mode: Column | None = None, kind: Column | None = None, level: Column | None = None, contract: Column | None = None, excluded: Column | None = None) -> Column:
    """struct(remote_type, job_type, experience_level, contract_type, excluded_keywords) of a user's lower-case words and what is set already.

    What is set stays.  Who wants no internship wants a job, unless a type other than "any" is set, and excludes
    "internship" and "stage"; a null blob says nothing.
    """
    null = F.lit(None).cast("string")
    mode, kind, level, contract = (null if c is None else c for c in (mode, kind, level, contract))
    b = F.coalesce(blob, F.lit(""))
    none, excluded = b.rlike(_whole(NO_INTERNSHIP)), F.coalesce(excluded if excluded is not None else F.lit(None).cast(_STRINGS), F.array().cast(_STRINGS))
    kind = F.when(none, F.when(kind.isNull() | (kind == "any"), "job").otherwise(kind)).otherwise(F.coalesce(kind, F.when(b.rlike(_whole(INTERNSHIP)), "internship")))
    low = F.transform(excluded, lambda w: F.lower(w))
    more = F.filter(F.array(F.lit("internship"), F.lit("stage")), lambda w: ~F.array_contains(low, w))
    return F.struct(
        F.coalesce(mode, _first_of(b, MODES)).alias("remote_type"), kind.alias("job_type"), F.coalesce(level, _first_of(b, LEVELS)).alias("experience_level"),
        F.coalesce(F.nullif(contract, F.lit("")), _first_of(b, CONTRACTS)).alias("contract_type"), F.when(none, F.concat(excluded, more)).otherwise(excluded).alias("excluded_keywords"),
    )


def missing(context: dict[str, Column]) -> Column:
    """Names of what a search still lacks, in order; ``context`` has columns by name, absent ones are unset."""
    null = F.lit(None).cast("string")

    def given(*names: str) -> Column:
        out = F.lit(False)
        for n in names:
            if n not in context:
                continue
            c = context[n]
            out = out | F.coalesce((F.size(c) > 0) if n in ("keywords", "skills", "technologies") else (c.isNotNull() & (c.cast("string") != "")), F.lit(False))
        return out

    intern = F.coalesce(context.get("job_type", null) == "internship", F.lit(False))
    rules = [
        ("query/keywords", ~given("query", "keywords")), ("location/remote_type", ~given("location", "city", "country", "remote_type")), ("job_type", ~given("job_type")), ("skills", ~given("skills", "technologies")),
        ("experience_level", ~given("experience_level")), ("internship_duration_months", intern & ~given("internship_duration_months")), ("internship_start_date/availability", intern & ~given("availability", "internship_start_date")),
    ]
    return F.array_compact(F.array(*(F.when(c, name) for name, c in rules)))


def next_question(lacking: Column) -> Column:
    """The question for the most wanted of what is missing; null if nothing is."""
    out = F.lit(None).cast("string")
    for name, question in reversed(QUESTIONS):
        out = F.when(F.array_contains(lacking, name), question).otherwise(out)
    return out


def profile_context(profile: dict[str, Column]) -> Column:
    """The search that a profile stands for: its first title is the query and the others are keywords, its skills are technologies too, its first place and language count; only what is set is carried."""
    null, none = F.lit(None).cast("string"), F.array().cast(_STRINGS)
    listed = lambda n: F.coalesce(profile.get(n, F.lit(None).cast(_STRINGS)), none)
    titles = listed("target_titles")
    lists = {n: listed(n) for n in ("excluded_keywords", "excluded_companies", "preferred_companies", "sectors")}
    return F.struct(
        F.get(titles, 0).alias("query"), F.slice(titles, F.lit(2), F.greatest(F.size(titles), F.lit(1))).alias("keywords"), listed("skills").alias("skills"), listed("skills").alias("technologies"), *(v.alias(k) for k, v in lists.items()),
        F.get(listed("locations"), 0).alias("location"), profile.get("remote_preference", null).alias("remote_type"), F.get(listed("languages"), 0).alias("language"),
        *(profile.get(n, null).alias(n) for n in ("experience_level", "salary_min", "salary_max", "salary_currency")),
    )


def match_tokens(*parts: Column) -> Column:
    """Distinct lower-case tokens of letters, digits, plus, hash and inner points."""
    blob = F.lower(F.concat_ws(" ", *parts))
    bare = F.transform(F.regexp_extract_all(blob, F.lit(r"[a-z0-9+#][a-z0-9+#.]*"), F.lit(0)), lambda t: F.regexp_replace(t, r"^\.+|\.+$", ""))
    return F.array_distinct(F.filter(bare, lambda t: t != ""))


def match_reasons(offer: dict[str, Column], context: dict[str, Column]) -> Column:
    """struct(reasons, missing_skills): why an offer fits a search, at most eight reasons in a fixed order, and at most twelve wished skills that it lacks.

    Title, skills (six), work mode or else place, level, pay reached and pay below, language (its first two letters),
    sectors (three); without any of these the match is weak.  Null values are unset.
    """
    null, none = F.lit(None).cast("string"), F.array().cast(_STRINGS)
    o = lambda n: offer.get(n, null)
    c = lambda n: context.get(n, null)
    listed = lambda d, n: F.coalesce(d.get(n, F.lit(None).cast(_STRINGS)), none)
    meets = lambda text, tokens: F.arrays_overlap(match_tokens(text), tokens)
    some = lambda xs: F.size(xs) > 0
    titles = F.filter(F.concat(F.array(c("query")), listed(context, "keywords")), lambda t: t.isNotNull() & (t != ""))
    tokens = F.struct(
        match_tokens(o("title")).alias("title"), match_tokens(o("title"), o("description"), F.array_join(listed(offer, "skills"), " ")).alias("blob"), match_tokens(o("title"), o("description"), o("company")).alias("sector"),
        F.array_distinct(F.concat(listed(context, "skills"), listed(context, "technologies"))).alias("wanted"),
    )
    found = lambda t: F.struct(
        F.filter(titles, lambda x: meets(x, t["title"])).alias("fits"), F.filter(t["wanted"], lambda x: meets(x, t["blob"])).alias("have"), F.filter(listed(context, "sectors"), lambda x: meets(x, t["sector"])).alias("sectors"), t["wanted"].alias("wanted")
    )
    mode = F.coalesce((c("remote_type") != "any") & (o("remote_type") == c("remote_type")), F.lit(False))
    near = F.arrays_overlap(match_tokens(c("city"), c("location"), c("country")), match_tokens(o("city"), o("location"), o("country"))) & (F.coalesce(c("city"), c("location"), F.lit("")) != "")
    pay, least = o("salary_min").cast("double"), c("salary_min").cast("double")
    paid = F.coalesce((pay != 0) & (least != 0), F.lit(False))
    two = lambda x: F.substring(F.lower(x), 1, 2)
    reasons = lambda f: F.array_compact(
        F.array(
            F.when(some(f["fits"]), F.concat(F.lit("title matches “"), F.get(f["fits"], 0), F.lit("”"))),
            F.when(some(f["have"]), F.concat(F.lit("skills present: "), F.array_join(F.slice(f["have"], 1, 6), ", "))),
            F.when(mode, F.concat(F.lit("work mode: "), c("remote_type"))).when(near, F.lit("location matches")),
            F.when((c("experience_level") != "any") & (o("experience_level") == c("experience_level")), F.concat(F.lit("seniority: "), o("experience_level"))),
            F.when(paid & (pay >= least), F.lit("salary meets the minimum")).when(paid & (pay < least), F.lit("⚠ posted salary below your minimum")),
            F.when((F.coalesce(c("language"), F.lit("")) != "") & (F.coalesce(o("language"), F.lit("")) != "") & (two(c("language")) == two(o("language"))), F.concat(F.lit("language: "), o("language"))),
            F.when(some(f["sectors"]), F.concat(F.lit("sector: "), F.array_join(F.slice(f["sectors"], 1, 3), ", "))),
        )
    )
    weak = F.array(F.lit("weak match — few of your criteria are present in this posting"))
    said = lambda f: let(reasons(f), lambda r: F.when(some(r), F.slice(r, 1, 8)).otherwise(weak))
    lacking = lambda f: F.slice(F.filter(f["wanted"], lambda s: ~F.array_contains(f["have"], s)), 1, 12)
    return let(let(tokens, found), lambda f: F.struct(said(f).alias("reasons"), lacking(f).alias("missing_skills")))


def whole_document_needed(sections: Column, education: Column, experience: Column) -> Column:
    """A header of education or experience was found (names of sections), but both bodies (arrays) are empty."""
    empty = lambda a: F.coalesce(F.size(a), F.lit(0)) <= 0
    return empty(education) & empty(experience) & F.coalesce(F.arrays_overlap(sections, F.array(F.lit("education"), F.lit("experience"))), F.lit(False))


def experience_period(raw: Column, today: Column, language: Column) -> Column:
    """How long a job was held, by the first rule that applies.

    A duration as written, if there is no range of two dates; "since" a date, up to ``today``; a range of dates, open ends being today;
    a lone date of up to three words as written; else null.  Months count inclusively, years without months are whole ones.
    """
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    is_open = lambda x: F.exists(F.array(*map(F.lit, PRESENT)), lambda w: F.contains(low(x), w))
    now = F.struct(F.year(today).alias("year"), F.month(today).alias("month"))
    words = "|".join(sorted(NUMBERS, key=len, reverse=True))
    written = rf"(?iU)\b(\d{{1,3}}|{words})[\s\-]+({UNITS})\b"
    number = lambda n: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in NUMBERS.items() for x in kv)), n), n.try_cast("int"))
    between = lambda a, b: let(duration_months(a, b), lambda n: format_months(n, language))
    long_ago = lambda text: let(parse_point(F.regexp_replace(text, r"^\S+ ", "")), lambda after: F.when(after.isNotNull(), between(after, now)))

    def by_rule(text: Column, ends: Column) -> Column:
        ranged, unit = ends["ranged"], ends["unit"]
        return (
            F.when(text == "", None)
            .when((unit != "") & ~ranged, F.concat(number(ends["n"]).cast("string"), F.lit(" "), unit))
            .when(F.lower(text).rlike(rf"^({'|'.join(SINCE)}) ") & ~ranged, long_ago(text))
            .when(ranged, between(ends["start"], F.when(ends["open"], now).otherwise(ends["end"])))
            .when(parse_point(text).isNotNull() & (F.size(F.split(text, " ")) <= 3), text)
        )

    def of(text: Column) -> Column:
        found = lambda i: F.lower(F.regexp_extract(text, written, i))
        point = lambda p: F.struct((F.size(p) == 2).alias("two"), parse_point(F.get(p, 0)).alias("start"), parse_point(F.get(p, 1)).alias("end"), is_open(F.get(p, 1)).alias("open"), found(1).alias("n"), found(2).alias("unit"))
        ranged = lambda e: F.coalesce(e["two"] & e["start"].isNotNull() & (e["end"].isNotNull() | e["open"]), F.lit(False))
        ends = let(let(F.split(text, BETWEEN, 2), point), lambda e: F.struct(ranged(e).alias("ranged"), *(e[c].alias(c) for c in ("start", "end", "open", "n", "unit"))))
        return let(ends, lambda e: by_rule(text, e))

    return let(F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)\s+", " ")), of)
