"""A person's name at the head of a document, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .profile import let

#: Words in lines that hold no name, and headers that are no part of one.
NOISE = ["curriculum", "resume", "cv", "cover letter", "linkedin", "github", "email", "phone", "address", "contact", "tel", "tél"]
HEADERS = ["profile", "summary", "contact", "resume", "cv", "curriculum", "education", "experience", "skills", "languages", "projects", "certifications", "interests", "objective", "about"]
#: Names on one line, in title case or in capitals; one word of a name; a word in capitals.
TITLE_CASE = r"(?U)^[A-ZÀ-Ý][a-zà-ÿ']*(?:-[A-ZÀ-Ý][a-zà-ÿ']*)*(?:\s+[A-ZÀ-Ý][a-zà-ÿ']*(?:-[A-ZÀ-Ý][a-zà-ÿ']*)*){1,3}$"
UPPER_CASE = r"(?U)^[A-ZÀ-Ý][A-ZÀ-Ý'\-]*(?:\s+[A-ZÀ-Ý][A-ZÀ-Ý'\-]*){1,3}$"
WORD = r"^[A-ZÀ-Ý][A-ZÀ-Ýa-zà-ÿ'\-]+$"
UPPER_WORD = r"^[A-ZÀ-Ý][A-ZÀ-Ý'\-]+$"
#: An address, and a line that is a telephone number.
MAIL = r"[a-zA-Z0-9][a-zA-Z0-9._%+\-]*@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = r"^(\+?\d{1,3}[\s.\-]?)?(\d[\s.\-])?(\(?\d{2,4}\)?[\s.\-]?){2,5}\d{2,4}$"
#: Lines that are looked at in a contact block and in a whole document.
CONTACT_LINES, DOCUMENT_LINES = 6, 40


def _lines(text: Column) -> Column:
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda x: x != "")


def _word(x: Column, pattern: str) -> Column:
    return x.rlike(pattern) & ~F.lower(x).isin(HEADERS)


def _pair(lines: Column, pattern: str) -> Column:
    """The first two lines in succession that are a word of a name each; null without such lines."""
    both = F.transform(lines, lambda x, i: F.when(_word(x, pattern) & _word(F.get(lines, i + 1), pattern), F.concat_ws(" ", x, F.get(lines, i + 1))))
    return F.get(F.array_compact(both), 0)


def proper_case(name: Column) -> Column:
    """Names in capitals get a capital at each word's start, after hyphens and apostrophes too; others stay."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(?U)[^\s\-'’]+|[\s\-'’]+"), F.lit(0))
    cased = F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))), "")
    return F.when(name.rlike(r"\p{Lu}") & ~name.rlike(r"\p{Ll}"), cased).otherwise(name)


def contact_name(contact: Column) -> Column:
    """The name in a contact block: its first two lines, else a line that is a name, else two lines in succession; null if there is none."""

    def noise(x: Column) -> Column:
        low = F.lower(x)
        out = x.rlike(MAIL) | F.contains(low, F.lit("http")) | x.rlike(PHONE)
        for word in NOISE:
            out = out | F.contains(low, F.lit(word))
        return out

    def find(lines: Column) -> Column:
        line = F.get(F.filter(lines, lambda x: x.rlike(TITLE_CASE) | x.rlike(UPPER_CASE)), 0)
        return F.coalesce(_pair(F.slice(lines, 1, 2), WORD), line, _pair(lines, WORD))

    return proper_case(let(F.slice(F.filter(_lines(contact), lambda x: ~noise(x)), 1, CONTACT_LINES), find))


def person_name(contact: Column, text: Column) -> Column:
    """The name in the contact block, else two lines in capitals near the head of the whole text; null if there is none."""
    far = let(F.slice(_lines(text), 1, DOCUMENT_LINES), lambda lines: _pair(lines, UPPER_WORD))
    return F.coalesce(contact_name(contact), proper_case(far))
