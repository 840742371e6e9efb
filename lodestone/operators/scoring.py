"""Relevance, freshness and confidence as Column expressions."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, functions as F

from ..functions.text import tokens

#: Weights of the parts of a relevance score.
WEIGHTS = {"title": 0.30, "skills": 0.20, "location": 0.15, "job_type": 0.12, "experience": 0.08, "language": 0.05, "freshness": 0.10}
PREFERRED_BONUS = 0.10
LEVELS = ["student", "junior", "mid", "senior", "lead", "executive"]
FRESH = {"fresh": 1.0, "unknown": 0.55, "stale": 0.4, "expired": 0.0}
FRESH_RANK = {"expired": 0, "unknown": 1, "stale": 2, "fresh": 3}


@dataclass(frozen=True)
class SearchContext:
    """What is searched for; bound as literals."""

    title: str = ""
    skills: tuple[str, ...] = ()
    job_type: str | None = None
    level: str | None = None
    language: str | None = None
    locations: tuple[str, ...] = ()
    remote: bool = False
    preferred_companies: tuple[str, ...] = ()
    excluded_companies: tuple[str, ...] = ()
    excluded_keywords: tuple[str, ...] = field(default=())


def _wanted(*texts: str) -> list[str]:
    import re

    return list(dict.fromkeys(t for x in texts for t in re.findall(r"[a-z0-9+#.]+", x.lower())))


def overlap(have: Column, want: list[str]) -> Column:
    """Share of the wanted tokens; 0.5 if none is wanted."""
    if not want:
        return F.lit(0.5)
    return F.size(F.array_intersect(have, F.array(*map(F.lit, want)))) / F.lit(float(len(want)))


def freshness(active: Column, expires: Column, verified: Column, posted: Column, now: dt.datetime, fresh_hours: int = 24, stale_days: int = 14) -> Column:
    """expired, fresh, stale or unknown."""
    at = lambda **k: F.lit(now - dt.timedelta(**k)).cast("timestamp_ntz")
    return (
        F.when(~active | F.coalesce(expires < at(), F.lit(False)), "expired")
        .when(verified >= at(hours=fresh_hours), "fresh")
        .when(verified >= at(days=stale_days), "stale")
        .when(verified.isNotNull(), "expired")
        .when(posted.isNull() & expires.isNull(), "unknown")
        .otherwise("stale")
    )


def freshness_rank(name: Column) -> Column:
    out = F.lit(1)
    for k, v in FRESH_RANK.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def location_score(remote_type: Column, place: Column, ctx: SearchContext) -> Column:
    want = _wanted(*ctx.locations)
    if ctx.remote:
        return F.when(remote_type == "remote", 1.0).when(remote_type.isNull() | (remote_type == "hybrid"), 0.4).otherwise(0.2)
    if not want:
        return F.lit(0.6)
    return F.when(F.coalesce(place, F.lit("")) == "", 0.4).when(F.arrays_overlap(tokens(place), F.array(*map(F.lit, want))), 1.0).otherwise(0.15)


def level_score(level: Column, ctx: SearchContext) -> Column:
    if ctx.level in (None, "any"):
        return F.lit(0.6)
    order = F.array(*map(F.lit, LEVELS))
    gap = F.abs(F.array_position(order, level) - F.array_position(order, F.lit(ctx.level)))
    return F.when(level.isNull(), 0.5).when(F.array_position(order, level) == 0, 0.5).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - gap * 0.34))


def relevance(title: Column, text: Column, skills: Column, job_type: Column, level: Column, language: Column, remote_type: Column, place: Column, fresh: Column, company: Column, ctx: SearchContext) -> Column:
    """Weighted sum of the parts, with a bonus for preferred companies, in 0 to 1, four places."""
    fresh_value = F.lit(0.55)
    for k, v in FRESH.items():
        fresh_value = F.when(fresh == k, v).otherwise(fresh_value)
    all_tokens = tokens(F.concat_ws(" ", title, text, skills))
    parts = {
        "title": overlap(tokens(title), _wanted(ctx.title)),
        "skills": overlap(all_tokens, _wanted(*ctx.skills)),
        "location": location_score(remote_type, place, ctx),
        "job_type": F.lit(0.6) if ctx.job_type in (None, "any") else F.when(job_type == ctx.job_type, 1.0).otherwise(0.0),
        "experience": level_score(level, ctx),
        "language": F.lit(0.5) if not ctx.language else F.when(language.isNull(), 0.5).when(language == ctx.language, 1.0).otherwise(0.3),
        "freshness": fresh_value,
    }
    total = sum((F.lit(w) * parts[k] for k, w in WEIGHTS.items()), F.lit(0.0))
    if ctx.preferred_companies:
        total = total + F.when(F.lower(company).isin([c.lower() for c in ctx.preferred_companies]), PREFERRED_BONUS).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def hard_filter(title: Column, company: Column, job_type: Column, ctx: SearchContext) -> Column:
    """Type, excluded companies (by substring) and excluded keywords (whole words of three characters or more)."""
    import re

    ok = F.lit(True)
    if ctx.job_type in ("job", "internship"):
        ok = ok & (job_type == ctx.job_type)
    for c in ctx.excluded_companies:
        ok = ok & ~F.contains(F.lower(F.coalesce(company, F.lit(""))), F.lit(c.lower()))
    words = [re.escape(k.lower()) for k in ctx.excluded_keywords if len(k) >= 3]
    return ok & ~F.lower(F.coalesce(title, F.lit(""))).rlike(rf"\b({'|'.join(words)})\b") if words else ok


def explain(title: Column, salary: Column, company: Column, ctx: SearchContext, least_salary: float) -> Column:
    """Reasons in a fixed order, or that the match is weak."""
    want = _wanted(ctx.title)
    reasons = F.array_compact(
        F.array(
            F.when(F.arrays_overlap(tokens(title), F.array(*map(F.lit, want))), "title matches") if want else F.lit(None),
            F.when(salary >= least_salary, "salary ok").when(salary.isNotNull(), "salary below"),
            F.when(F.lower(company).isin([c.lower() for c in ctx.preferred_companies]), "preferred company"),
        )
    )
    return F.when(F.size(reasons) == 0, F.array(F.lit("weak match"))).otherwise(reasons)


def section_confidence(required: Column, optional: Column, errors: Column, warnings: Column) -> Column:
    """70 for the share of required fields, 30 for optional ones, less 10 an error and 3 a warning, in 0 to 100."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), required * 70 + optional * 30 - errors * 10 - warnings * 3))


def skills_confidence(n: Column) -> Column:
    return F.when(n == 0, 0).when(n < 3, 60).when(n < 6, 85).otherwise(97)


def keyword_coverage(text: Column, keywords: Column) -> Column:
    """Share of keywords that the text contains as substrings, in percent with one place; repeated keywords count."""
    hit = F.filter(keywords, lambda k: F.contains(F.lower(text), F.lower(k)))
    return F.when(F.size(keywords) == 0, 0.0).otherwise(F.round(F.size(hit) / F.size(keywords) * 100, 1))


def health_note(open_until: Column, best: Column, empty_streak: Column, now: Column, proven: int = 5, streak: int = 6) -> Column:
    """Why a source needs a look: its breaker is open, or it delivered before and has been empty since."""
    return F.when(open_until > now, "breaker open").when((best >= proven) & (empty_streak >= streak), "empty since a good run")


#: Weights of the fields of a contact section.
CONTACT_WEIGHTS = {"name": 30, "email": 30, "phone": 15, "linkedin": 10, "github": 10, "portfolio": 5}


def contact_confidence(found: dict[str, Column], errors: Column, warnings: Column) -> Column:
    """Weights of the fields that are there, less 15 an error and 5 a warning, in 0 to 100."""
    total = sum((F.when(found[k], w).otherwise(0) for k, w in CONTACT_WEIGHTS.items() if k in found), F.lit(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), total - errors * 15 - warnings * 5))


def low_layout(score: Column, cap: int = 55) -> Column:
    """A score where the layout was not understood."""
    return F.least(score, F.lit(cap))


def revalidated(probe: Column, active: Column, recomputed: Column) -> tuple[Column, Column]:
    """Activity and freshness after a probe: gone, alive, or unknown (which only recomputes)."""
    return F.when(probe == "gone", F.lit(False)).when(probe == "alive", F.lit(True)).otherwise(active), F.when(probe == "gone", "expired").when(probe == "alive", "fresh").otherwise(recomputed)
