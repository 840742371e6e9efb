"""Text functions as Column builders; everything stays in built-in expressions."""

from __future__ import annotations

import html.entities
import ipaddress
import json

from pyspark.sql import Column, functions as F

#: Query parameters that only track; so does every name that begins with utm_.
TRACKING = [
    "src", "source", "ref", "refid", "refsrc", "refsource", "referrer", "origin", "from", "channel", "medium", "trk", "trackingid", "tracking_id",
    "gh_src", "lever-source", "lever_source", "lever-origin", "lever_origin", "lever-source[]", "recommendedflavor", "savedsearchid", "position", "pagenum", "distance", "ebp", "rid",
    "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "igshid", "yclid", "twclid", "dclid", "zanpid", "_ga", "_gl", "_hsenc", "_hsmi", "mkt_tok",
]
#: Whole words that hint at an internship or a work mode, in English, French and German.
INTERNSHIP = r"(?iU)\b(intern|internship|stage|stagiaire|apprenti|apprentice|working student|werkstudent|praktikum|trainee)\b"
REMOTE = r"(?iU)\b(remote|t[ée]l[ée]travail|work from home|wfh|anywhere)\b"
HYBRID = r"(?iU)\b(hybrid|hybride|partially remote|remote-friendly)\b"
ONSITE = r"(?iU)\b(on[- ]?site|sur site|in[- ]office|présentiel|presentiel)\b"
#: Levels in the order in which they are looked for.
LEVELS = [
    ("student", r"(?iU)\b(intern|student|stagiaire|étudiant|etudiant)\b"),
    ("junior", r"(?iU)\b(entry[- ]level|graduate|débutant|junior)\b"),
    ("mid", r"(?iU)\b(mid[- ]level|confirmé|confirme|intermediate)\b"),
    ("senior", r"(?iU)\b(senior|sr\.?)\b"),
    ("lead", r"(?iU)\b(lead|principal|staff|head of|director)\b"),
]


def let(x: Column, f) -> Column:
    """``f`` of ``x``, which is computed once a row however often ``f`` uses it: a plain expression is repeated wherever it is used."""
    return F.get(F.transform(F.array(x), f), 0)


def slug(x: Column) -> Column:
    """Lower case, runs of other than a-z and 0-9 as one dash, no dash at the ends; null as empty."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def contains_query(x: Column, query: str) -> Column:
    """``x`` holds the trimmed query, ignoring case; its % and _ are wildcards, and a blank query is in every text."""
    return x.ilike(f"%{query.strip()}%")


def clean_text(x: Column, limit: int = 512) -> Column:
    """Runs of spaces, tabs and no-break spaces as one space, trimmed, cut; null if nothing is left."""
    t = F.trim(F.regexp_replace(x, "[ \\t\u00a0]+", " "))
    return F.nullif(F.substring(t, 1, limit), F.lit(""))


def _entities() -> str:
    """Named character references that end in a semicolon, as the HTML standard lists them, and the numbers 128 to 159, which it reads as Windows-1252."""
    named = {k: html.entities.html5[f"{k};"] for k in ("amp", "lt", "gt", "quot", "nbsp", "apos")}  # first, as they are most frequent
    named |= {k[:-1]: v for k, v in html.entities.html5.items() if k.endswith(";")}
    for n in range(128, 160):
        named[f"#{n}"] = bytes([n]).decode("cp1252", "replace")
    return json.dumps(named)


def unescape_html(x: Column) -> Column:
    """Character references decoded once: named and numeric ones (decimal or hexadecimal) that end in a semicolon; unknown names stay, numbers that are no character become U+FFFD."""
    pattern = "&(#[0-9]{1,8}|#[xX][0-9A-Fa-f]{1,7}|[A-Za-z][A-Za-z0-9]*);"
    names = F.from_json(F.lit(_entities()), "map<string,string>")
    bad = F.lit("\ufffd")

    def number(ref: Column) -> Column:
        n = F.when(F.lower(ref).startswith("#x"), F.conv(F.substring(ref, 3, 8), 16, 10)).otherwise(F.substring(ref, 2, 8)).cast("long")
        char = lambda v: F.decode(F.unhex(F.lpad(F.hex(v), 8, "0")), "UTF-32")
        return let(n, lambda v: F.when((v == 0) | (v > 0x10FFFF) | v.between(0xD800, 0xDFFF), bad).when(v.between(128, 159), F.try_element_at(names, F.concat(F.lit("#"), v.cast("string")))).otherwise(char(v)))

    def one(ref: Column) -> Column:
        return F.when(ref.startswith("#"), number(ref)).otherwise(F.coalesce(F.try_element_at(names, ref), F.concat(F.lit("&"), ref, F.lit(";"))))

    def whole(t: Column) -> Column:
        refs = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), one)
        joined = F.array_join(F.transform(F.arrays_zip(F.split(t, pattern, -1).alias("gap"), refs.alias("ref")), lambda z: F.concat(z["gap"], F.coalesce(z["ref"], F.lit("")))), "")
        return F.when(t.contains("&"), joined).otherwise(t)

    return let(x, whole)


def html_to_text(x: Column, limit: int | None = None) -> Column:
    """Visible text: script-like elements dropped, tags as line breaks, character references decoded, blank lines capped at one; all of it without a limit."""
    t = F.regexp_replace(x, r"(?is)<(script|style|noscript|template|svg)\b.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", "")
    t = F.regexp_replace(t, r"<[^>]*>", "\n")
    t = unescape_html(t)
    t = F.regexp_replace(t, "[ \\t\u00a0]+", " ")
    t = F.regexp_replace(t, r" ?\n ?", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    return F.nullif(t if limit is None else F.substring(t, 1, limit), F.lit(""))


def url_host(x: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(x, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def _decoded(x: Column) -> Column:
    return F.coalesce(F.try_url_decode(x), x)


def _encoded(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(x: Column) -> Column:
    """Scheme and host lower-cased, fragment, tracking and blank parameters dropped, the rest decoded, sorted and encoded anew, no trailing slash; empty stays empty."""
    bare = F.regexp_replace(F.trim(x), "#.*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([^:/?]+://[^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^:/?]+://[^/?]*([^?]*)", 1), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    params = F.transform(F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&"), lambda p: F.struct(_decoded(F.split_part(p, F.lit("="), F.lit(1))).alias("k"), _decoded(F.regexp_extract(p, "=(.+)$", 1)).alias("v")))
    keep = F.filter(params, lambda p: ~F.lower(p["k"]).isin(TRACKING) & ~F.lower(p["k"]).startswith("utm_") & (p["v"] != ""))
    query = F.array_join(F.transform(F.array_sort(keep), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")
    return F.when(bare == "", "").otherwise(F.concat(head, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))))


#: Networks that are private, reserved or for one use only, and parts of them that are not.
CLOSED_IPV4 = "0.0.0.0/8 10.0.0.0/8 127.0.0.0/8 169.254.0.0/16 172.16.0.0/12 192.0.0.0/24 192.0.2.0/24 192.168.0.0/16 198.18.0.0/15 198.51.100.0/24 203.0.113.0/24 224.0.0.0/3".split()
OPEN_IPV4 = "192.0.0.9/32 192.0.0.10/32".split()
CLOSED_IPV6 = "2001::/23 2001:db8::/32 2002::/16".split()
OPEN_IPV6 = "2001:1::1/128 2001:1::2/128 2001:3::/32 2001:4:112::/48 2001:20::/28 2001:30::/28".split()
INTERNAL_HOSTS = ["localhost", "localhost.localdomain", "ip6-localhost", "metadata"]


def _within(number: Column, networks: list[str], bits: int) -> Column:
    """An address as a hexadecimal number of fixed width lies in one of the networks."""
    out = F.lit(False)
    for n in map(ipaddress.ip_network, networks):
        low, high = (f"{int(a):0{bits // 4}x}" for a in (n.network_address, n.broadcast_address))
        out = out | number.between(low, high)
    return out


def _ipv6(literal: Column) -> Column:
    """The 32 hexadecimal digits of an address, null if it is none."""
    groups = lambda x: F.filter(F.split(x, ":"), lambda g: g != "")
    head, tail = groups(F.split_part(literal, F.lit("::"), F.lit(1))), groups(F.split_part(literal, F.lit("::"), F.lit(2)))
    gap = literal.contains("::")
    missing = F.lit(8) - F.size(head) - F.size(tail)
    valid = literal.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$") & F.when(gap, missing >= 1).otherwise(missing == 0)
    full = F.concat(head, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), tail)
    return F.when(valid, F.array_join(F.transform(full, lambda g: F.lpad(g, 4, "0")), ""))


def usable_url(x: Column) -> Column:
    """http(s), at most 2,048 characters, no control characters or credentials, and a host that is not internal: names, and public addresses of either kind."""
    rest = F.regexp_extract(x, r"^(?i:https?)://([^/?#]*)", 1)
    octets = r"^(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})$"

    def public4(host: Column) -> Column:
        parts = F.transform(F.split(host, "[.]"), lambda p: p.try_cast("long"))
        digits = lambda ps: F.lower(F.array_join(F.transform(ps, lambda p: F.lpad(F.hex(p), 2, "0")), ""))
        address = lambda ps: F.exists(ps, lambda p: p > 255) | let(digits(ps), lambda four: ~_within(four, CLOSED_IPV4, 32) | _within(four, OPEN_IPV4, 32))
        return F.when(host.rlike(octets), let(parts, address)).otherwise(True)

    def public6(server: Column) -> Column:
        literal = F.regexp_extract(server, r"^\[([^\]]*)\](?::[0-9]*)?$", 1)
        fine = lambda six: six.between("2" + "0" * 31, "3" + "f" * 31) & (~_within(six, CLOSED_IPV6, 128) | _within(six, OPEN_IPV6, 128))
        return F.coalesce(let(let(literal, _ipv6), fine), F.lit(False))

    def of_server(server: Column) -> Column:
        host = F.rtrim(F.split_part(server, F.lit(":"), F.lit(1)), F.lit("."))
        fine4 = let(host, lambda h: (h != "") & ~h.contains("[") & ~h.isin(INTERNAL_HOSTS) & public4(h))
        return F.when(server.startswith("["), public6(server)).otherwise(fine4)

    def of_rest(rest: Column) -> Column:
        return F.regexp_extract(rest, r"^(?s)(.*)@", 1).isin("", ":") & let(F.lower(F.regexp_replace(rest, r"^(?s).*@", "")), of_server)

    plain = x.rlike(r"^(?i:https?)://") & (F.length(x) <= 2048) & ~x.rlike(r"[\x00-\x1f\x7f]")
    return F.coalesce(plain & let(rest, of_rest), F.lit(False))


def host_matches(x: Column, domain: str) -> Column:
    """The host is the domain or below it; never a substring test."""
    h = url_host(x)
    return (h == domain) | h.endswith("." + domain)


def guess_job_type(x: Column) -> Column:
    return F.when(x.rlike(INTERNSHIP), "internship").otherwise("job")


def guess_remote_type(x: Column) -> Column:
    return F.when(x.rlike(HYBRID), "hybrid").when(x.rlike(REMOTE), "remote").when(x.rlike(ONSITE), "onsite")


def guess_level(x: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(LEVELS):
        out = F.when(x.rlike(pattern), name).otherwise(out)
    return out


def tokens(x: Column, pattern: str = r"[a-z0-9+#.]+") -> Column:
    """Distinct tokens in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(x, F.lit(""))), F.lit(pattern), F.lit(0)))


def split_city_country(x: Column) -> Column:
    """struct(city, country): one part is a country if it has at most three characters or is upper case."""
    parts = F.filter(F.transform(F.split(x, r"[,/·|]"), lambda p: F.trim(p)), lambda p: p != "")

    def named(parts: Column) -> Column:
        one = F.get(parts, 0)
        short = (F.length(one) <= 3) | (one == F.upper(one))
        city = F.when(F.size(parts) > 1, one).when(~short, one)
        country = F.when(F.size(parts) > 1, F.element_at(parts, -1)).when(short, one)
        return F.when(F.size(parts) > 0, F.struct(city.alias("city"), country.alias("country")))

    return let(parts, named)


#: A number of two digits or more, its thousands grouped by a space, comma or point or not, in a range or alone, with its currency before it.
_AMOUNT = r"([0-9]{2,3}(?:[ ,.][0-9]{3})+|[0-9]{2,7})(\s*[kK])?"
SALARY = rf"(?U)([$€£]|USD|EUR|GBP|CAD)?\s*{_AMOUNT}(?:\s*(?:[-–—]|to)\s*[$€£]?\s*{_AMOUNT})?"


def parse_salary(x: Column) -> Column:
    """struct(low, high, currency) of the first amount or range; k is thousand, separators go, a single amount has no upper bound; null without an amount."""
    part = lambda i: F.nullif(F.regexp_extract(x, SALARY, i), F.lit(""))
    value = lambda i: F.regexp_replace(part(i), "[ ,.]", "").cast("double") * F.when(part(i + 1).isNotNull(), 1000.0).otherwise(1.0)
    sign = part(1)
    named = F.when(sign == "$", "USD").when(sign == "€", "EUR").when(sign == "£", "GBP").otherwise(sign)
    currency = F.coalesce(named, F.when(x.rlike("(?i)€|eur"), "EUR").when(x.rlike(r"(?i)\$|usd"), "USD"))
    return F.when(part(2).isNotNull(), F.struct(value(2).alias("low"), value(4).alias("high"), currency.alias("currency")))


def safe_label(x: Column) -> Column:
    """URLs and long tokens hidden, white space collapsed, at most 120 characters."""
    t = F.regexp_replace(x, r"https?://[^ \t\n\r]+", "[url]")
    t = F.regexp_replace(t, r"[A-Za-z0-9_-]{32,}", "[token]")
    return F.substring(F.trim(F.regexp_replace(t, r"[ \t\n\r]+", " ")), 1, 120)


def glyph_clean(x: Column) -> Column:
    """Control, format and private characters as spaces; three spaces or more as two."""
    return F.regexp_replace(F.regexp_replace(x, r"[\p{Cc}\p{Cf}\p{Co}\p{Cn}\p{Cs}&&[^\t\n\r]]", " "), " {3,}", "  ")


def single_letter_share(x: Column) -> Column:
    """Share of single letters among alphabetic tokens; null under 40 tokens."""
    t = F.filter(F.split(x, r"[ \t\n\r]+"), lambda w: w.rlike(r"^[A-Za-z]+$"))
    return F.when(F.size(t) >= 40, F.size(F.filter(t, lambda w: F.length(w) == 1)) / F.size(t))


def emails(x: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), F.lit(0)), F.lower))


def phones(x: Column) -> Column:
    """Digit runs with separators and 7 to 15 digits, digits only."""
    found = F.regexp_extract_all(x, F.lit(r"\+?[0-9][0-9 ().-]{5,20}[0-9]"), F.lit(0))
    return F.filter(F.transform(found, lambda p: F.regexp_replace(p, "[^0-9]", "")), lambda d: F.length(d).between(7, 15))


def ordered_distinct_insensitive(xs: Column) -> Column:
    """First spelling of each entry, in order, ignoring case."""
    return F.aggregate(xs, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def sentence_truncate(x: Column, limit: int) -> Column:
    """Cut at the last sentence end beyond half of ``limit``, else with an ellipsis."""
    head = F.substring(x, 1, limit)
    sentence = F.regexp_extract(head, r"(?s)^(.*[.!?])", 1)
    return F.when(F.length(x) <= limit, x).when(F.length(sentence) > limit / 2, sentence).otherwise(F.concat(F.rtrim(head), F.lit("…")))
