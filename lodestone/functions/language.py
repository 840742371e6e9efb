"""Language of documents and messages by marker words, as Column builders."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

#: Markers of documents (after accents are stripped).
DOCUMENT = {
    "fr": [" et ", " de ", " des ", " le ", " la ", " les ", " du ", " pour ", " avec ", " dans ", "experience professionnelle", "competences", "formation", "diplome", "langues", "projets", "realisations", "responsable", "annee", "stage"],
    "en": [" and ", " the ", " of ", " for ", " with ", " in ", "professional experience", "skills", "education", "degree", "languages", "projects", "achievements", "responsible", "year", "internship"],
}
#: Markers of messages.
MESSAGE = {
    "fr": [" le ", " la ", " les ", " des ", " une ", " un ", " je ", " vous ", " êtes ", " et ", " avec ", " pour ", " poste ", " stage ", " offre ", " offres ", " postule ", " candidate ", " cherche ", " recherche ", "é", "è", "ê", "à", "ç"],
    "en": [" the ", " a ", " an ", " you ", " are ", " and ", " with ", " for ", " job ", " jobs ", " role ", " apply ", " looking ", " search ", " find "],
}
#: Markers of short generated texts (one stands twice and counts twice).
STRICT = {
    "fr": [" le ", " la ", " les ", " des ", " une ", " un ", " je ", " vous ", " êtes ", " et ", " avec ", " pour ", " votre ", " vos ", " êtes ", "é", "è", "ê", "à", "ç"],
    "en": [" the ", " a ", " an ", " you ", " are ", " and ", " with ", " for ", " your ", " is ", " it ", " this "],
}
LEAST_WORDS = 4


def _bare(cp: int) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))


#: Latin letters with marks, and the letters without, by decomposition.
_MARKED = [chr(c) for c in range(0xC0, 0x250) if len(_bare(c)) == 1 and _bare(c) != chr(c)]


def strip_accents(x: Column) -> Column:
    """Latin letters without their marks; combining marks that stand alone go."""
    return F.regexp_replace(F.translate(x, "".join(_MARKED), "".join(_bare(ord(c)) for c in _MARKED)), r"\p{Mn}+", "")


def _count(text: Column, markers: list[str]) -> Column:
    """Occurrences of all markers, each without overlaps of its own."""
    return sum((F.regexp_count(text, F.lit(m)) for m in markers), F.lit(0))


def detect_document(x: Column) -> Column:
    """fr or en; a tie is en."""
    t = F.concat(F.lit(" "), strip_accents(F.lower(F.coalesce(x, F.lit("")))), F.lit(" "))
    return F.when(_count(t, DOCUMENT["fr"]) > _count(t, DOCUMENT["en"]), "fr").otherwise("en")


def detect_message(x: Column) -> Column:
    """fr or en; accents speak for fr, a tie is en."""
    t = F.concat(F.lit(" "), F.lower(F.coalesce(x, F.lit(""))), F.lit(" "))
    return F.when(_count(t, MESSAGE["fr"]) > _count(t, MESSAGE["en"]), "fr").otherwise("en")


def detect_strict(x: Column) -> Column:
    """fr or en; null for a tie or for under four words."""
    t = F.concat(F.lit(" "), F.lower(F.coalesce(x, F.lit(""))), F.lit(" "))
    fr, en = _count(t, STRICT["fr"]), _count(t, STRICT["en"])
    words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    return F.when(words < LEAST_WORDS, F.lit(None)).when(fr > en, "fr").when(en > fr, "en")
