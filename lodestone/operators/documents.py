"""Document extraction: sections, fields, grounding, validation, layout."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import let

#: Section headers in English and French without accents, in the order in which they are tried.
SECTIONS = {
    "summary": r"summary|professional\s+summary|profile|professional\s+profile|about\s*(me)?|career\s+summary|objective|career\s+objective|resume\s+summary|profil|profil\s+professionnel|a\s+propos|a\s+propos\s+de\s+moi|objectif|objectif\s+professionnel|objectif\s+de\s+carriere|synthese|resume|presentation|en\s+bref",
    "education": r"education|academic\s+background|academic\s+history|educational\s+background|qualifications|formation|formations|formation\s+academique|parcours\s+academique|diplomes?|etudes|scolarite|education\s+et\s+formation|cursus|cursus\s+scolaire|parcours\s+scolaire",
    "experience": r"experience|experiences|work\s+experience|professional\s+experience|employment\s+history|career\s+history|work\s+history|experience\s+professionnelle|experiences\s+professionnelles|parcours\s+professionnel|stages?(\s+et\s+experiences?)?|emplois?|experience\s+de\s+travail|historique\s+professionnel|vie\s+professionnelle",
    "projects": r"projects?|personal\s+projects?|academic\s+projects?|side\s+projects?|key\s+projects?|selected\s+projects?|projets?|projets?\s+personnels?|projets?\s+academiques?|realisations?",
    "skills": r"skills?|technical\s+skills?|competenc(e|ies)|core\s+competenc(e|ies)|technologies|tech\s+stack|tools?(\s+(and|&)\s+technologies)?|competences|competences\s+techniques|competences\s+cles|outils",
    "certifications": r"certifications?|licenses?(\s+(and|&)\s+certifications?)?|certificates?|certifications?\s+professionnelles?|certificats?",
    "languages": r"languages?|language\s+skills?|langues?|langues?\s+parlees?",
    "interests": r"interests?|hobbies(\s+(and|&)\s+interests?)?|hobbies?|personal\s+interests?|activities|extracurricular\s+activities|centres?\s+d.?interet(s)?|loisirs?|activites?|activites?\s+extra[\s\-]?professionnelles?|divers",
    "personal_qualities": r"personal\s+qualities|personal\s+qualities\s+and\s+skills|qualities|soft\s+skills?|strengths?|character\s+traits?|qualites?|qualites?\s+personnelles?|qualites?\s+humaines?|qualites?\s+et\s+competences|savoir[\s\-]?etre|traits?\s+de\s+caractere|atouts?|points?\s+forts?",
    "contact": r"contact|contact\s+information|contact\s+details|personal\s+information|personal\s+details|coordonnees|informations?\s+personnelles?|informations?\s+de\s+contact",
}
#: Accented letters that headers are compared without.
ACCENTED, PLAIN = "éèêëàâäîïôöùûüçÉÈÊÀÂÎÏÔÙÛÇ", "eeeeaaaiioouuuceeeaaiiouuc"


def section_header(line: Column) -> Column:
    """Name of the section a line opens: at most 45 characters and six words; decoration, case and accents don't count."""
    raw = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    bare = F.lower(F.regexp_replace(F.translate(raw, ACCENTED, PLAIN), r"(?U)^[#=\-*_•\s]+|[#=\-*_•\s:]+$", ""))
    out = F.lit(None).cast("string")
    for name, p in reversed(SECTIONS.items()):
        out = F.when(bare.rlike(f"(?iU)^({p})$"), name).otherwise(out)
    return F.when((F.length(raw) <= 45) & (F.size(F.split(raw, r"(?U)\s+")) <= 6) & (bare != ""), out)


def split_sections(lines: DataFrame) -> DataFrame:
    """(doc_id, section, text): header lines switch the section and go; before the first is "contact"."""
    w = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("header", section_header(F.col("text"))).withColumn("section", F.coalesce(F.last("header", ignorenulls=True).over(w), F.lit("contact")))
    body = rows.where(F.col("header").isNull()).groupBy("doc_id", "section").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("a"))
    return body.select("doc_id", "section", F.regexp_replace(F.array_join(F.transform("a", lambda x: x["text"]), "\n"), r"^\n+|\n+$", "").alias("text"))


def lines_of(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "text"))


def alnum_key(x: Column) -> Column:
    """Lower-cased letters and digits without the common accents."""
    plain = F.translate(F.lower(F.coalesce(x, F.lit(""))), "àâäáãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(plain, "[^a-z0-9]", "")


def grounded(items: Column, section: Column) -> Column:
    """struct(kept, removed): items whose key occurs in the section's key."""
    hay = alnum_key(section)
    inside = lambda x: F.contains(hay, alnum_key(x)) & (alnum_key(x) != "")
    return F.struct(F.filter(items, inside).alias("kept"), F.filter(items, lambda x: ~inside(x)).alias("removed"))


def grounded_date(value: Column, section: Column) -> Column:
    """The value, or null if none of its years is in the section."""
    years = lambda x: F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(19[5-9][0-9]|20[0-4][0-9])"), F.lit(1))
    return F.when((F.size(years(value)) == 0) | F.arrays_overlap(years(value), years(section)), value)


def validation_report(email: Column, phone: Column, url: Column, start_year: Column, end_year: Column) -> Column:
    """Issues (field, message, severity) in a fixed order."""
    issue = lambda bad, f, m, s: F.when(bad, F.struct(F.lit(f).alias("field"), F.lit(m).alias("message"), F.lit(s).alias("severity")))
    digits = F.length(F.regexp_replace(phone, "[^0-9]", ""))
    return F.array_compact(
        F.array(
            issue(email.isNull(), "email", "missing", "warning"),
            issue(email.isNotNull() & ~email.rlike(r"^[^@ ]+@[^@ ]+\.[A-Za-z]{2,}$"), "email", "malformed", "error"),
            issue(phone.isNotNull() & ~digits.between(7, 15), "phone", "7 to 15 digits", "error"),
            issue(url.isNotNull() & ~url.rlike(r"^https?://[^ /]+\.[^ ]+"), "url", "malformed", "warning"),
            issue(end_year < start_year, "dates", "end before start", "error"),
        )
    )


# What reads as an address, a URL, a year and a duration, and words of dates without a year
_ADDRESS, _LINK = r"^[a-zA-Z0-9][a-zA-Z0-9._%+\-]*@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$", r"^(https?://)?([a-zA-Z0-9\-]+\.)+[a-zA-Z]{2,}(/[^\s]*)?$"
_YEAR, _DURATION = r"\b(19[5-9]\d|20[0-4]\d)\b", r"(?iU)^\s*(?:\d{1,3}\s+(?:mois|months?|semaines?|weeks?|ans?|annees?|années?|years?|jours?|days?)\s*)+$"
_UNDATED = ["present", "présent", "presente", "current", "now", "ongoing", "actuel", "en cours", "depuis", "since", "maintenant", "aujourd", "à ce jour", "a ce jour", "expected", "prévu", "prevu", "attendu"]
ISSUE = "array<struct<field: string, message: string, severity: string>>"


def _issue(bad: Column, field: Column | str, message: Column | str, severity: str = "warning") -> Column:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(bad, F.struct(text(field).alias("field"), text(message).alias("message"), F.lit(severity).alias("severity")))


def _issues(*found: Column) -> Column:
    return F.array_compact(F.array(*found)).cast(ISSUE)


def _set(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def _undated(x: Column, field: Column) -> Column:
    """A text of a date without a year, unless it says that it is open."""
    t = F.trim(F.coalesce(x, F.lit("")))
    known = F.exists(F.array(*map(F.lit, _UNDATED)), lambda w: F.contains(F.lower(t), w)) | t.rlike(_YEAR)
    return _issue((t != "") & ~known, field, F.concat(F.lit("Date text has no recognisable year: '"), t, F.lit("'")))


def entries_by(entries: Column, *fields: str) -> Column:
    """Entries without later ones of equal ``fields`` (trimmed, ignoring case); entries whose fields are all blank stay."""
    key = lambda e: F.transform(F.array(*(e[f] for f in fields)), lambda v: F.lower(F.trim(F.coalesce(v, F.lit("")))))
    keys = F.transform(entries, key)
    return F.filter(entries, lambda e, i: (F.array_join(key(e), "") == "") | (F.array_position(keys, key(e)) == i + 1))


def single_technologies(values: Column) -> Column:
    """Technologies one by one, in order, each once: items that hold a comma, slash or semicolon are split."""
    pieces = F.flatten(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.split(F.coalesce(v, F.lit("")), r"(?U)\s*[,/;]\s*")))
    return F.array_distinct(F.filter(F.transform(pieces, lambda p: F.regexp_replace(p, r"^[ .]+|[ .]+$", "")), lambda p: p != ""))


def _grouped(values: Column) -> Column:
    parts = lambda v: F.size(F.filter(F.split(v, r"(?U)\s*[,/;]\s*"), lambda p: F.regexp_replace(p, r"^[ .]+|[ .]+$", "") != ""))
    return F.coalesce(F.exists(values, lambda v: F.coalesce(parts(v) > 1, F.lit(False))), F.lit(False))


def resume_report(contact: Column, experience: Column, education: Column, projects: Column) -> Column:
    """struct(issues, experience, education, projects): what is odd about an extracted profile, in order, and the numbers of repeated entries that were left out.

    ``contact`` has email, phone, linkedin, github, portfolio, address and name; experience company, position, period and technologies; education institution, degree,
    field, start_date and end_date; projects title, github, demo and technologies.  Null arrays are empty; blank values are missing ones; entries are numbered after repeats are gone.
    """
    c = lambda f: contact[f]
    digits = F.length(F.regexp_replace(c("phone"), r"\D", ""))
    quoted = lambda head, x: F.concat(F.lit(head + "'"), x, F.lit("'"))
    own = _issues(
        _issue(_set(c("email")) & ~F.trim(c("email")).rlike(_ADDRESS), "email", quoted("Email format looks invalid: ", c("email"))),
        _issue(_set(c("phone")) & ~digits.between(7, 15), "phone", quoted("Phone number looks implausible: ", c("phone"))),
        *(_issue(_set(c(f)) & ~F.trim(c(f)).rlike(_LINK), f, quoted(f"{f} URL looks invalid: ", c(f))) for f in ("linkedin", "github", "portfolio")),
        _issue(_set(c("address")) & (c("address").contains("@") | F.lower(c("address")).contains("http")), "address", quoted("Address looks like it captured contact/URL text: ", c("address"))),
        _issue(~_set(c("name")), "name", "No name could be extracted.", "error"),
        _issue(~_set(c("email")), "email", "No email could be extracted.", "error"),
    )

    def section(name: str, entries: Column, keys: tuple[str, ...], of) -> Column:
        kept = lambda entries: F.struct(entries_by(entries, *keys).alias("kept"), F.size(entries).alias("all"))
        return let(let(F.coalesce(entries, F.array()), kept), lambda entries: listed(name, entries["kept"], entries["all"] - F.size(entries["kept"]), of))

    def listed(name: str, kept: Column, gone: Column, of) -> Column:
        label = {"projects": "project"}.get(name, name)
        message = F.concat(F.lit("Removed "), gone.cast("string"), F.lit(f" duplicate {label} entr"), F.when(gone == 1, "y").otherwise("ies"), F.lit("."))
        place = lambda i, f: F.concat(F.lit(f"{name}["), i.cast("string"), F.lit(f"].{f}"))
        each = F.flatten(F.transform(kept, lambda e, i: _issues(*of(e, lambda f: place(i, f)))))
        return F.struct(F.concat(_issues(_issue(gone > 0, name, message, "info")), each).alias("issues"), gone.alias("gone"))

    split = "Grouped technologies were split into individual items."
    year = lambda x: F.nullif(F.regexp_extract(F.coalesce(x, F.lit("")), _YEAR, 1), F.lit("")).cast("int")
    work = section(
        "experience", experience, ("company", "position"),
        lambda e, at: (
            _issue(~_set(e["company"]), at("company"), "Missing company name."), _issue(~_set(e["position"]), at("position"), "Missing position/title."),
            _issue(~_set(e["period"]), at("period"), "No experience date or duration found in source document."), F.when(_set(e["period"]) & ~e["period"].rlike(_DURATION), _undated(e["period"], at("period"))),
            _issue(_grouped(e["technologies"]), at("technologies"), split, "info"),
        ),
    )
    studies = section(
        "education", education, ("institution", "degree", "field"),
        lambda e, at: (
            _issue(~_set(e["institution"]), at("institution"), "Missing institution name."), _issue(~_set(e["degree"]), at("degree"), "Missing degree."), _undated(e["start_date"], at("start_date")), _undated(e["end_date"], at("end_date")),
            _issue(F.coalesce(year(e["end_date"]) < year(e["start_date"]), F.lit(False)), at("end_date"), F.concat(F.lit("End date ("), e["end_date"], F.lit(") is before start date ("), e["start_date"], F.lit(") — likely a mis-attributed date."))),
        ),
    )
    built = section(
        "projects", projects, ("title",),
        lambda e, at: (
            _issue(~_set(e["title"]), at("title"), "Missing project title."), *(_issue(_set(e[f]) & ~F.trim(e[f]).rlike(_LINK), at(f), quoted(f"{f} URL looks invalid: ", e[f])) for f in ("github", "demo")), _issue(_grouped(e["technologies"]), at("technologies"), split, "info"),
        ),
    )
    names = {"experience": work, "education": studies, "projects": built}
    whole = lambda r: F.struct(F.concat(own, *(r[n]["issues"] for n in names)).alias("issues"), *(r[n]["gone"].alias(n) for n in names))
    return let(F.struct(*(v.alias(n) for n, v in names.items())), whole)


def join_wrapped(text: Column) -> Column:
    """Lines joined to the one before where that ends open and this begins in lower case, with a digit or a bracket."""

    def led(lines: Column, x: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)  # a joined line ends as its last part does
        goes_on = ~before.rlike(r"[.!?:;]$") & x.rlike(r"^[\p{Ll}0-9(]")
        return F.concat(F.when(i == 0, "").when(goes_on, " ").otherwise("\n"), x)

    lines = F.filter(F.transform(F.split(text, "\n"), lambda p: F.trim(p)), lambda x: x != "")
    joined = let(lines, lambda lines: F.array_join(F.transform(lines, lambda x, i: led(lines, x, i)), ""))
    return F.filter(F.split(joined, "\n"), lambda x: x != "")


def list_items(text: Column) -> Column:
    """Items of a skill or interest list: wrapped lines joined, bullets and labels dropped, split, distinct in order."""
    lines = F.transform(join_wrapped(text), lambda x: F.regexp_replace(F.regexp_replace(x, r"^[•*·–-]\s*", ""), r"^[\p{L} ]{2,25}:\s*", ""))
    items = F.flatten(F.transform(lines, lambda x: F.split(x, r"[,;•]| / ")))
    return F.array_distinct(F.filter(F.transform(items, lambda p: F.trim(p)), lambda x: x != ""))


LAYOUT = "doc_id bigint, page int, line_no int, x0 double, y0 double, text string"


def reading_order(words: DataFrame, tolerance: float = 3.0, gap: float = 20.0) -> DataFrame:
    """Lines of pages in reading order: words within ``tolerance`` of a row's first word are a row, gaps split it, left column first.

    The anchor of a row is its first word, which no window expresses, so pages go through pandas one by one; a page is bounded.
    """

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y0", "x0"])
        rows, anchor = [], None
        for w in pdf.itertuples():
            if anchor is None or abs(w.y0 - anchor) > tolerance:
                rows.append([])
                anchor = w.y0
            rows[-1].append(w)
        parts = []
        for r in rows:
            r.sort(key=lambda w: w.x0)
            cur = [r[0]]
            for w in r[1:]:
                if w.x0 - cur[-1].x1 > max(gap, 1.8 * (w.y1 - w.y0)):
                    parts.append(cur)
                    cur = []
                cur.append(w)
            parts.append(cur)
        middle = pdf["page_width"].iloc[0] / 2
        across = [p for p in parts if p[0].x0 < middle < p[-1].x1]
        two = len(parts) - len(across) > len(across)
        column = lambda p: 0 if not two or p in across else 1 if p[0].x0 < middle else 2
        parts.sort(key=lambda p: (column(p), p[0].y0, p[0].x0))
        return pd.DataFrame([(int(p[0].doc_id), int(p[0].page), i, p[0].x0, p[0].y0, " ".join(w.text for w in p)) for i, p in enumerate(parts)], columns=["doc_id", "page", "line_no", "x0", "y0", "text"])

    return words.groupBy("doc_id", "page").applyInPandas(page, LAYOUT)
