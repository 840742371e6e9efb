"""Predicates of sources and of a search, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Titles that are links of a page, parts of such titles, and names of languages.
GARBAGE_TITLES = [
    "apply", "apply now", "contact", "contact us", "search", "search jobs", "job search", "back", "next", "previous", "filter", "filters", "reset", "clear", "sign in", "sign up", "login", "log in", "register", "submit",
    "load more", "show more", "view all", "see all", "close", "menu", "home", "about", "about us", "privacy", "terms", "cookie", "cookies", "accept", "decline", "subscribe", "follow", "share", "save",
    "join talent network", "join our talent network", "talent network", "sign up for alerts", "sign up for job alerts", "job alerts", "create job alert", "set up job alert", "email me jobs",
    "explore careers", "explore opportunities", "why work here", "our culture", "our values", "benefits", "open roles", "learn more", "read more", "find out more", "get started",
    "all locations", "all departments", "all categories", "accessibility", "equal opportunity", "eeo", "privacy policy", "terms of use", "terms and conditions", "sitemap", "locations", "teams", "departments", "categories",
]
GARBAGE_PARTS = ["join talent network", "join our talent", "talent community", "sign up for job alert", "create job alert", "email me jobs", "cookie settings", "cookie preferences", "privacy policy", "equal opportunity employer", "© 20"]
LOCALES = ["nederlands", "deutsch", "français", "español", "português", "italiano", "polski", "svenska", "norsk", "dansk", "suomi", "english", "english (us)", "english (uk)", "日本語", "한국어", "中文"]


def valid_slug(x: Column) -> Column:
    return F.coalesce(F.trim(x).rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]{0,99}$"), F.lit(False))


def valid_id(x: Column) -> Column:
    return F.coalesce(F.trim(x).rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"), F.lit(False))


def looks_like_job(title: Column, url: Column) -> Column:
    """A title of three characters or more that is no link of a page, no name of a language and no number, with a web address."""
    t = F.trim(F.coalesce(title, F.lit("")))
    low = F.lower(t)
    part = F.exists(F.array(*map(F.lit, GARBAGE_PARTS)), lambda g: F.contains(low, g))
    return (F.length(t) >= 3) & ~low.isin(GARBAGE_TITLES + LOCALES) & ~part & ~t.rlike(r"^[\d\s\-.]+$") & F.lower(F.trim(F.coalesce(url, F.lit("")))).rlike("^https?://")


def keyword_match(text: Column, terms: list[str]) -> Column:
    """Any term is a part of the text, ignoring case; no terms match everything."""
    terms = [t.lower() for t in terms if t] if terms else []
    if not terms:
        return F.lit(True)
    return F.exists(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(F.coalesce(text, F.lit(""))), t))


def context_filter(job_type: Column, company: Column, wanted_type: str | None, excluded: list[str]) -> Column:
    """The type asked for, and no excluded company (a part of the name, ignoring case)."""
    fine = job_type == wanted_type if wanted_type in ("job", "internship") else F.lit(True)
    if excluded:
        fine = fine & ~F.coalesce(F.exists(F.array(*[F.lit(x.lower()) for x in excluded]), lambda x: F.contains(F.lower(company), x)), F.lit(False))
    return fine


def offer_matches(title: Column, company: Column, text: Column, job_type: Column, wanted_type: str | None, excluded: list[str], terms: list[str]) -> Column:
    """``context_filter`` and ``keyword_match`` over title, company and text."""
    return context_filter(job_type, company, wanted_type, excluded) & keyword_match(F.concat_ws(" ", title, company, text), terms)


def still_good(active: Column, expires: Column, posted: Column, now: Column, max_age_days: int | None = None) -> Column:
    """A cached result: active, not expired, and not older than asked for."""
    fine = active & (expires.isNull() | (expires >= now))
    if max_age_days is not None:
        fine = fine & (posted.isNull() | (posted >= now - F.expr(f"INTERVAL {int(max_age_days)} DAYS")))
    return fine


def safe_meta(meta: Column, keys: int = 8, key_length: int = 40, value_length: int = 60) -> Column:
    """The first entries of a string map with keys and values cut; null if there are none."""
    entries = F.slice(F.map_entries(meta), 1, keys)
    cut = F.transform(entries, lambda e: F.struct(F.substring(e["key"], 1, key_length), F.substring(e["value"], 1, value_length)))
    return F.when(F.size(entries) > 0, F.map_from_entries(cut))


def owned_by(df, user_id, owner: str = "user_id"):
    """Rows of one user; every query on users' rows goes through this."""
    return df.where(F.col(owner) == F.lit(user_id))
