"""Links of projects, taken from the URLs of a document only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Parts of URLs that identify nothing, the shape of a repository, and what reads as a URL in a text
COMMON = "com org net io dev me app co www github gitlab bitbucket vercel netlify herokuapp streamlit fly onrender pages git http https demo live repo code project app".split()
REPOSITORY = r"(?i)github\.com/[^/\s]+/[^/\s#?]+"
URL = r"(?i)(?:https?://|www\.)[^\s<>()\[\]|]+|(?:[a-z0-9-]+\.)+(?:com|org|net|io|dev|me|app|co|xyz|tech|pages?\.dev|vercel\.app|netlify\.app|herokuapp\.com|streamlit\.app|fly\.dev|onrender\.com)(?:/[^\s<>()\[\]|]*)?"
PROJECTS = "array<struct<title: string, github: string, demo: string>>"
_SCHEME = r"^(?i)https?://"


def _let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), 0)


def _schemed(u: Column) -> Column:
    return F.when(u.rlike(_SCHEME), u).otherwise(F.concat(F.lit("https://"), u))


def plain_title(x: Column) -> Column:
    """Lower case without accents or anything but letters and digits."""
    return F.regexp_replace(F.lower(F.translate(F.coalesce(x, F.lit("")), _ACCENTED, _PLAIN)), "[^a-z0-9]", "")


def _accents() -> tuple[str, str]:
    import unicodedata

    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in range(0xC0, 0x250) if len(unicodedata.normalize("NFKD", chr(i))) > 1 and unicodedata.combining(unicodedata.normalize("NFKD", chr(i))[1])]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _accents()


def url_words(url: Column) -> Column:
    """Words of three letters or more of host and path that identify a project."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(url), "^https?://", ""), "^/+|/+$", "")
    return F.array_except(F.filter(F.split(F.regexp_replace(bare, r"[?#].*$", ""), r"[/._\-]"), lambda p: F.length(p) >= 3), F.array(*map(F.lit, COMMON)))


def text_urls(text: Column, more: Column | None = None) -> Column:
    """URLs of a text, then of ``more``, with a scheme; the first spelling of each, ignoring case, scheme and a slash at the end."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), F.lit(0))
    every = found if more is None else F.concat(found, F.coalesce(F.filter(more, lambda u: u.isNotNull() & (u != "")), F.array().cast("array<string>")))
    keyed = F.transform(every, lambda u: F.struct(F.regexp_replace(F.regexp_replace(F.lower(u), "^https?://", ""), "/+$", "").alias("k"), u.alias("u")))
    once = F.filter(F.transform(keyed, lambda x, i: F.struct(x["k"].alias("k"), x["u"].alias("u"), F.exists(F.slice(keyed, F.lit(1), i), lambda y: y["k"] == x["k"]).alias("again"))), lambda x: ~x["again"] & (x["k"] != ""))
    return F.transform(once, lambda x: _schemed(x["u"]))


def ground_links(projects: Column, urls: Column) -> Column:
    """``projects`` with empty ``github`` and ``demo`` slots filled from ``urls``, one URL after another.

    A repository goes to github, another page to demo, a profile nowhere.  A URL belongs to the project whose title
    shares most words with it (the first on ties), or else to the only one whose slot is still empty; a filled slot stays.
    Null projects stay null.
    """
    tidy = lambda v: _let(F.regexp_replace(F.trim(F.coalesce(v, F.lit(""))), r"^[.,;)]+|[.,;)]+$", ""), lambda s: F.when(s == "", F.lit("")).otherwise(F.when(s.rlike(_SCHEME), s).otherwise(F.concat(F.lit("https://"), F.regexp_replace(s, "^/+", "")))))
    given = lambda new, old: F.when(new == "", old).otherwise(new)
    start = F.transform(projects, lambda p: F.struct(p["title"].alias("title"), given(tidy(p["github"]), p["github"]).alias("github"), given(tidy(p["demo"]), p["demo"]).alias("demo")))

    def step(state: Column, url: Column) -> Column:
        repo = url.rlike(REPOSITORY)
        slot = lambda p: F.coalesce(F.when(repo, p["github"]).otherwise(p["demo"]), F.lit(""))

        def fill(at: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                mine = (i == at) & (slot(p) == "")
                return F.struct(p["title"].alias("title"), F.when(mine & repo, url).otherwise(p["github"]).alias("github"), F.when(mine & ~repo, url).otherwise(p["demo"]).alias("demo"))

            return F.transform(state, one)

        def target(words: Column) -> Column:
            shared = lambda t: F.when(t == "", F.lit(0)).otherwise(F.size(F.filter(words, lambda w: t.contains(w) | w.contains(t))))
            scores = F.transform(state, lambda p: _let(plain_title(p["title"]), shared))
            missing = F.filter(F.transform(state, lambda p, i: F.when(slot(p) == "", i)), lambda i: i.isNotNull())
            return _let(scores, lambda s: F.when(F.array_max(s) > 0, F.array_position(s, F.array_max(s)).cast("int") - 1).when(F.size(missing) == 1, F.get(missing, 0)))

        profile = F.lower(url).contains("github.com") & ~repo
        return F.when(profile, state).otherwise(_let(target(url_words(url)), lambda at: F.when(at.isNull(), state).otherwise(fill(at))))

    return F.aggregate(F.coalesce(urls, F.array().cast("array<string>")), start.cast(PROJECTS), step)
