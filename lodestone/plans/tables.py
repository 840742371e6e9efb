"""Rules of texts and feeds applied to values of the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import roles as R
from ..functions import text as X
from .queries import query

_AMOUNT = r"([0-9]{2,3}(?:[ ,.][0-9]{3})+|[0-9]{2,7})(\s*[kK])?"
_PAY = rf"([$€£]|USD|EUR|GBP|CAD)?\s*{_AMOUNT}(?:\s*(?:[-–—]|to)\s*[$€£]?\s*{_AMOUNT})?"
_PAY_TEXT = """CASE p_size % 8 WHEN 0 THEN format('{:,}', CAST(floor(p_retailprice * 100) AS BIGINT)) || ' USD' WHEN 1 THEN '€' || CAST(CAST(floor(p_retailprice) AS BIGINT) % 90 + 10 AS VARCHAR) || 'k to ' || CAST(CAST(floor(p_retailprice) AS BIGINT) % 90 + 20 AS VARCHAR) || 'K'
    WHEN 2 THEN p_size % 10 || ' days a week, £' || replace(format('{:,}', CAST(floor(p_retailprice * 10) AS BIGINT)), ',', '.') || ' – £' || CAST(CAST(floor(p_retailprice) AS BIGINT) AS VARCHAR) WHEN 3 THEN 'from ' || CAST(p_size + 10 AS VARCHAR) || 'k' WHEN 4 THEN p_name || ' level ' || p_size % 10
    WHEN 5 THEN 'CAD ' || replace(format('{:,}', CAST(floor(p_retailprice * 10) AS BIGINT)), ',', ' ') || ' eur' WHEN 6 THEN '' END"""


@query(
    f"""WITH t AS (SELECT p_partkey AS id, {_PAY_TEXT} AS pay FROM part), m AS (SELECT *, regexp_extract(pay, '{_PAY}', 1) AS cur, regexp_extract(pay, '{_PAY}', 2) AS lo, regexp_extract(pay, '{_PAY}', 3) AS lok, regexp_extract(pay, '{_PAY}', 4) AS hi, regexp_extract(pay, '{_PAY}', 5) AS hik FROM t)
    SELECT id, CAST(regexp_replace(nullif(lo, ''), '[ ,.]', '', 'g') AS DOUBLE) * CASE WHEN lok <> '' THEN 1000 ELSE 1 END AS low, CAST(regexp_replace(nullif(hi, ''), '[ ,.]', '', 'g') AS DOUBLE) * CASE WHEN hik <> '' THEN 1000 ELSE 1 END AS high,
    CASE WHEN lo = '' OR lo IS NULL THEN NULL WHEN cur = '$' THEN 'USD' WHEN cur = '€' THEN 'EUR' WHEN cur = '£' THEN 'GBP' WHEN cur <> '' THEN cur WHEN regexp_matches(pay, '€|eur', 'i') THEN 'EUR' WHEN regexp_matches(pay, '\\$|usd', 'i') THEN 'USD' END AS currency FROM m"""
)
def offer_salaries(spark, sf):
    """Pay written in seven ways out of prices and sizes: grouped thousands, ranges, k, currencies before and behind, none."""
    p, size = R.read(spark, sf, "part"), F.col("p_size")
    price = F.col("p_retailprice")
    whole = lambda c: F.floor(c).cast("long")
    grouped = lambda c, sep: F.replace(F.format_number(whole(c), 0), F.lit(","), F.lit(sep))
    text = lambda c: c.cast("string")
    pay = (
        F.when(size % 8 == 0, F.concat(grouped(price * 100, ","), F.lit(" USD")))
        .when(size % 8 == 1, F.concat(F.lit("€"), text(whole(price) % 90 + 10), F.lit("k to "), text(whole(price) % 90 + 20), F.lit("K")))
        .when(size % 8 == 2, F.concat(text(size % 10), F.lit(" days a week, £"), grouped(price * 10, "."), F.lit(" – £"), text(whole(price))))
        .when(size % 8 == 3, F.concat(F.lit("from "), text(size + 10), F.lit("k")))
        .when(size % 8 == 4, F.concat("p_name", F.lit(" level "), text(size % 10)))
        .when(size % 8 == 5, F.concat(F.lit("CAD "), grouped(price * 10, " "), F.lit(" eur")))
        .when(size % 8 == 6, F.lit(""))
    )
    s = X.parse_salary(pay)
    return p.select(F.col("p_partkey").alias("id"), s["low"].alias("low"), s["high"].alias("high"), s["currency"].alias("currency"))


@query(
    """WITH u AS (SELECT event_id, (event_id * 7919) % 4294967296 AS n, event_type, user_id FROM events), h AS (SELECT event_id, n // 16777216 AS a, n // 65536 % 256 AS b, n // 256 % 256 AS c, n % 256 AS d, event_type, user_id FROM u),
    x AS (SELECT event_id, event_type, user_id, CASE WHEN user_id % 3 = 0 THEN [10, 192, 172, 198, 169, 203, 100, 240][1 + user_id % 8] ELSE a END AS a, CASE WHEN user_id % 3 = 0 THEN [0, 168, 16, 18, 254, 0, 64, 51][1 + event_id % 8] ELSE b END AS b, CASE WHEN user_id % 3 = 0 THEN [0, 2, 113, 100][1 + event_id % 4] ELSE c END AS c, d FROM h)
    SELECT event_id, event_type <> 'error' AND NOT (a IN (0, 10, 127) OR a >= 224 OR a = 169 AND b = 254 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 192 AND b = 0 AND (c = 2 OR c = 0 AND d NOT IN (9, 10)) OR a = 198 AND (b BETWEEN 18 AND 19 OR b = 51 AND c = 100) OR a = 203 AND b = 0 AND c = 113) AS usable FROM x"""
)
def address_urls(spark, sf):
    """URLs with addresses made of events: public, private, reserved and for documentation; errors have credentials."""
    e = R.spread(R.read(spark, sf, "events").select("event_id", "user_id", "event_type"), "event_id")
    n = F.pmod(F.col("event_id") * 7919, F.lit(1 << 32))
    part = lambda k: F.floor(n / (1 << k)).cast("long") % 256
    pick = lambda xs, c: F.get(F.array(*map(F.lit, xs)), (c % len(xs)).cast("int"))
    odd = F.col("user_id") % 3 == 0
    a = F.when(odd, pick([10, 192, 172, 198, 169, 203, 100, 240], F.col("user_id"))).otherwise(part(24))
    b = F.when(odd, pick([0, 168, 16, 18, 254, 0, 64, 51], F.col("event_id"))).otherwise(part(16))
    c = F.when(odd, pick([0, 2, 113, 100], F.col("event_id"))).otherwise(part(8))
    user = F.when(F.col("event_type") == "error", "me:secret@").otherwise("")
    host = F.concat_ws(".", *(x.cast("string") for x in (a, b, c, part(0))))
    return e.select("event_id", X.usable_url(F.concat(F.lit("https://"), user, host, F.lit(":8443/x?y"))).alias("usable"))
