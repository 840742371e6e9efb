"""A search from source to page, and the joins, rollups and table steps around it, on the test tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from .. import roles as R
from ..functions import extract as E
from ..functions import predicates as P
from ..functions import skills as K
from ..operators import analytics as A
from ..operators import scoring as S
from .queries import query

_TOKENS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9+#.]+'))"


def _postings(spark, sf):
    """Offers with a work mode, a level, a language, a state and a posting date, made of their numbers."""
    o, i = R.offers(spark, sf), F.col("offer_id")
    pick = lambda n, *xs: F.get(F.array(*map(F.lit, xs)), F.pmod(i, F.lit(n)).cast("int"))
    now = F.lit("2024-06-15 12:00:00").cast("timestamp_ntz")
    return o.select(
        "offer_id", "title", "company", pick(3, "job", "internship", "job").alias("job_type"), pick(4, "remote", "hybrid", "onsite", None).alias("mode"), pick(5, "student", "junior", "mid", "senior", None).alias("level"),
        pick(3, "en", "fr", None).alias("language"), pick(7, "Paris", "Lyon", "Rabat", "Paris", "", "Berlin", "Lyon").alias("place"), pick(4, "fresh", "unknown", "stale", "expired").alias("freshness"),
        (now - F.expr("make_dt_interval(int(size))")).alias("posted"), pick(6, True, True, True, True, True, False).alias("active"), "size", "salary",
    )


_POSTINGS = """postings AS (SELECT p_partkey AS offer_id, p_name AS title, p_brand AS company, ['job', 'internship', 'job'][p_partkey % 3 + 1] AS job_type, ['remote', 'hybrid', 'onsite', NULL][p_partkey % 4 + 1] AS mode, ['student', 'junior', 'mid', 'senior', NULL][p_partkey % 5 + 1] AS level,
  ['en', 'fr', NULL][p_partkey % 3 + 1] AS language, ['Paris', 'Lyon', 'Rabat', 'Paris', '', 'Berlin', 'Lyon'][p_partkey % 7 + 1] AS place, ['fresh', 'unknown', 'stale', 'expired'][p_partkey % 4 + 1] AS freshness, TIMESTAMP '2024-06-15 12:00:00' - to_days(CAST(p_size AS INTEGER)) AS posted, p_partkey % 6 <> 5 AS active, p_size AS size, p_retailprice AS salary FROM part)"""
_SCORE = f"""round(0.3 * len(list_intersect({_TOKENS.format('title')}, ['small', 'ring'])) / 2.0 + 0.2 * len(list_intersect({_TOKENS.format("title || ' ' || title")}, ['ring', 'bolt'])) / 2.0
  + 0.15 * CASE WHEN place = '' THEN 0.4 WHEN place = 'Paris' THEN 1.0 ELSE 0.15 END + 0.12 * CASE WHEN job_type = 'job' THEN 1.0 ELSE 0.0 END
  + 0.08 * CASE level WHEN 'senior' THEN 1.0 WHEN 'mid' THEN 0.66 WHEN 'junior' THEN 0.32 WHEN 'student' THEN 0.0 ELSE 0.5 END + 0.05 * CASE language WHEN 'fr' THEN 1.0 WHEN 'en' THEN 0.3 ELSE 0.5 END
  + 0.1 * CASE freshness WHEN 'fresh' THEN 1.0 WHEN 'unknown' THEN 0.55 WHEN 'stale' THEN 0.4 ELSE 0.0 END, 4)"""
_CONTEXT = S.SearchContext(title="small ring", skills=("ring", "bolt"), job_type="job", level="senior", language="fr", locations=("Paris",), excluded_companies=("Brand#1",))


def _ranked(spark, sf):
    """Rank without sorting: excluded companies go, the rest is scored with all seven parts."""
    p = _postings(spark, sf)
    kept = p.where(P.context_filter(F.col("job_type"), F.col("company"), None, ["Brand#1"]))
    c = lambda n: F.col(n)
    return kept.withColumn("score", S.relevance(c("title"), c("title"), F.lit(""), c("job_type"), c("level"), c("language"), c("mode"), c("place"), c("freshness"), c("company"), _CONTEXT))


@query(f"WITH {_POSTINGS} SELECT offer_id, {_SCORE} AS score FROM postings WHERE NOT contains(lower(company), 'brand#1')")
def ranked_offers(spark, sf):
    return _ranked(spark, sf).select("offer_id", "score")


@query(
    f"""WITH {_POSTINGS}, r AS (SELECT *, {_SCORE} AS score FROM postings WHERE job_type = 'job' AND NOT contains(lower(company), 'brand#1') AND (contains(lower(title || ' ' || company), 'ring') OR contains(lower(title || ' ' || company), 'bolt')) AND active AND posted >= TIMESTAMP '2024-06-15 12:00:00' - INTERVAL 30 DAY),
    t AS (SELECT *, count(*) OVER () AS total, row_number() OVER (ORDER BY score DESC, posted DESC, offer_id) AS place_in FROM r) SELECT place_in AS place, offer_id, score, total FROM t WHERE place_in BETWEEN 11 AND 20"""
)
def search_page(spark, sf):
    """Source predicates, recheck, score, two-key sort and the second page of ten with the total."""
    p = _ranked(spark, sf)
    now = F.lit("2024-06-15 12:00:00").cast("timestamp_ntz")
    fine = P.offer_matches(F.col("title"), F.col("company"), F.lit(None), F.col("job_type"), "job", ["Brand#1"], ["ring", "bolt"]) & P.still_good(F.col("active"), F.lit(None).cast("timestamp_ntz"), F.col("posted"), now, 30)
    rows = p.where(fine)
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(F.desc("score"), F.col("posted").desc_nulls_last(), "offer_id").limit(20).select("offer_id", "score", "posted")
    place = F.row_number().over(Window.orderBy(F.desc("score"), F.col("posted").desc_nulls_last(), "offer_id"))  # over twenty rows
    return page.withColumn("place", place.cast("long")).where("place > 10").join(F.broadcast(total)).select("place", "offer_id", "score", "total")


@query(f"WITH {_POSTINGS}, r AS (SELECT *, {_SCORE} AS score FROM postings WHERE NOT contains(lower(company), 'brand#1')) SELECT offer_id, score FROM r WHERE level IS NULL ORDER BY score DESC, posted DESC NULLS LAST, offer_id LIMIT 20")
def enrichment_targets(spark, sf):
    """The twenty most relevant offers that lack a field, for a bounded budget of lookups."""
    return _ranked(spark, sf).where("level IS NULL").orderBy(F.desc("score"), F.col("posted").desc_nulls_last(), "offer_id").limit(20).select("offer_id", "score")


@query(
    """WITH t AS (SELECT p_partkey AS offer_id, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part) SELECT offer_id, list_filter(['ring', 'Small Bolt', 'COBOL', 'bolt'], lambda s: len(list_intersect(string_split(lower(s), ' '), w)) > 0) AS matched, list_filter(['ring', 'Small Bolt', 'COBOL', 'bolt'], lambda s: len(list_intersect(string_split(lower(s), ' '), w)) = 0) AS missing FROM t"""
)
def skills_in_offers(spark, sf):
    wanted = F.array(*map(F.lit, ["ring", "Small Bolt", "COBOL", "bolt"]))
    t = K.match_tokens(F.col("title"))
    return R.offers(spark, sf).select("offer_id", K.matched_skills(wanted, t).alias("matched"), K.missing_skills(wanted, t).alias("missing"))


@query(
    """WITH o AS (SELECT o_custkey AS id, p_name AS raw, min(l_orderkey * 10 + l_linenumber) AS place FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), w AS (SELECT DISTINCT id, s AS skill FROM o, (VALUES ('small ring'), ('bolt 2'), ('large steel'), ('Fortran')) v(s)),
    n AS (SELECT w.id, skill, raw, place, CASE skill WHEN 'bolt 2' THEN ['bolt'] ELSE list_distinct(string_split(lower(skill), ' ')) END AS wt, list_filter(list_distinct(string_split(lower(raw), ' ')), lambda t: length(t) >= 3) AS ot FROM w JOIN o USING (id)),
    x AS (SELECT id, skill, arg_min(raw, (place, raw)) FILTER (WHERE lower(raw) = CASE skill WHEN 'bolt 2' THEN 'bolt' ELSE lower(skill) END) AS exact, arg_min(raw, (place, raw)) FILTER (WHERE len(list_intersect(wt, ot)) >= 2 OR (len(list_intersect(wt, ot)) > 0 AND (len(list_intersect(wt, ot)) = len(wt) OR len(list_intersect(wt, ot)) = len(ot)))) AS fuzzy FROM n GROUP BY 1, 2)
    SELECT id, skill, coalesce(exact, fuzzy) AS matched_to, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN fuzzy IS NOT NULL THEN 'fuzzy' ELSE 'missing' END AS confidence FROM x"""
)
def skill_analysis(spark, sf):
    """Wanted skills of each user against the names of what the user selected, first selected first."""
    apps = R.applications(spark, sf).select(F.col("id").alias("application_id"), F.col("user_id"))
    s = R.saved(spark, sf).join(apps, "application_id").join(R.offers(spark, sf).select("offer_id", "title"), "offer_id")
    owned = s.groupBy(F.col("user_id").alias("id"), F.col("title").alias("skill")).agg(F.min(F.col("application_id") * 10 + F.col("seq")).alias("place"))
    wanted = owned.select("id").distinct().select("id", F.explode(F.array(*map(F.lit, ["small ring", "bolt 2", "large steel", "Fortran"]))).alias("skill"))
    return K.analyse(wanted, owned)


@query(
    """WITH c AS (SELECT l_orderkey AS id, list({'ms': l_quantity, 'hit': l_linenumber % 3 = 0, 'fallback': l_linenumber % 4 = 0, 'ok': l_returnflag <> 'R', 'tin': l_suppkey}) AS calls, sum(CAST(l_quantity AS DECIMAL(28, 6))) AS llm FROM lineitem GROUP BY 1), r AS (SELECT o_orderkey, CAST(o_totalprice / 1000 AS DECIMAL(28, 6)) AS total, calls, CAST(coalesce(llm, 0) AS DECIMAL(28, 6)) AS llm FROM orders LEFT JOIN c ON c.id = o_orderkey)
    SELECT o_orderkey AS id, CAST(round(total, 1) AS DOUBLE) AS total_ms, CAST(round(llm, 1) AS DOUBLE) AS llm_ms, CAST(round(greatest(0, total - llm), 1) AS DOUBLE) AS local_ms, len(list_filter(coalesce(calls, []), lambda x: NOT x.hit)) AS n, len(list_filter(coalesce(calls, []), lambda x: x.hit)) AS cache_hits,
    len(list_filter(coalesce(calls, []), lambda x: x.fallback)) AS fallbacks, len(list_filter(coalesce(calls, []), lambda x: NOT x.ok)) AS errors, coalesce(list_sum(list_transform(calls, lambda x: x.tin)), 0) AS prompt_tokens FROM r"""
)
def request_summary(spark, sf):
    """Requests with an array of calls each: times and counts over the nested calls."""
    line = R.read(spark, sf, "lineitem")
    call = F.struct(F.col("l_quantity").alias("ms"), (F.col("l_linenumber") % 3 == 0).alias("hit"), (F.col("l_linenumber") % 4 == 0).alias("fallback"), (F.col("l_returnflag") != "R").alias("ok"), F.col("l_suppkey").alias("tin"))
    calls = line.groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(call).alias("calls"))
    requests = R.applications(spark, sf).select("id", (F.col("score") / 1000).alias("total")).join(calls, "id", "left")
    return A.request_summary(requests)


@query(
    """WITH c AS (SELECT l_linestatus || l_linenumber % 5 AS request_type, l_quantity AS ms, l_suppkey AS tin, l_linenumber % 4 = 0 AS fallback, l_linenumber % 3 = 0 AS hit, l_returnflag = 'R' AS failed, l_returnflag AS model FROM lineitem),
    r AS (SELECT request_type, count(*) AS n, round(avg(ms), 1) AS avg_ms, round(avg(tin), 0) AS avg_in_tokens, round(avg(CAST(fallback AS INTEGER)), 3) AS fallback_rate, round(avg(CAST(hit AS INTEGER)), 3) AS cache_hit_rate, round(avg(CAST(failed AS INTEGER)), 3) AS error_rate, list(ms ORDER BY ms) AS l FROM c GROUP BY 1), m AS (SELECT request_type, string_agg(model || '=' || k, ',' ORDER BY model) AS models FROM (SELECT request_type, model, count(*) AS k FROM c GROUP BY 1, 2) GROUP BY 1)
    SELECT request_type, n, l[CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) + 1] AS p50_ms, l[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1] AS p95_ms, avg_ms, avg_in_tokens, fallback_rate, cache_hit_rate, error_rate, models FROM r JOIN m USING (request_type)"""
)
def call_types(spark, sf):
    """Calls by request type: nearest-rank percentiles, means, rates and a histogram of models."""
    n = F.col("l_linenumber")
    calls = R.read(spark, sf, "lineitem").select(F.concat("l_linestatus", (n % 5).cast("string")).alias("request_type"), F.col("l_quantity").alias("ms"), F.col("l_suppkey").alias("tin"), (n % 4 == 0).alias("fallback"), (n % 3 == 0).alias("hit"), (F.col("l_returnflag") == "R").alias("failed"), F.col("l_returnflag").alias("model"))
    return A.call_types(calls)


@query("SELECT p_partkey AS offer_id, 30 * CAST(p_size % 2 = 0 AS INTEGER) AS x, greatest(0, least(100, 30 * CAST(p_size % 2 = 0 AS INTEGER) + 30 + 15 * CAST(p_size % 3 = 0 AS INTEGER) + 10 * CAST(p_size % 5 = 0 AS INTEGER) - 15 * (p_size % 3) - 5 * (p_size % 4))) AS confidence, least(55, greatest(0, least(100, 30 * CAST(p_size % 2 = 0 AS INTEGER) + 30 + 15 * CAST(p_size % 3 = 0 AS INTEGER) + 10 * CAST(p_size % 5 = 0 AS INTEGER) - 15 * (p_size % 3) - 5 * (p_size % 4)))) AS capped FROM part")
def contact_confidence(spark, sf):
    s = F.col("size")
    found = {"name": s % 2 == 0, "email": F.lit(True), "phone": s % 3 == 0, "linkedin": s % 5 == 0}
    c = S.contact_confidence(found, s % 3, s % 4)
    return R.offers(spark, sf).select("offer_id", F.when(found["name"], 30).otherwise(0).alias("x"), c.alias("confidence"), S.low_layout(c).alias("capped"))


@query(
    f"""WITH {_POSTINGS} SELECT offer_id, CASE size % 3 WHEN 0 THEN false WHEN 1 THEN true ELSE active END AS active, CASE WHEN size % 3 = 0 THEN 'expired' WHEN size % 3 = 1 THEN 'fresh' WHEN NOT active THEN 'expired' WHEN posted >= TIMESTAMP '2024-06-15 12:00:00' - INTERVAL 24 HOUR THEN 'fresh' WHEN posted >= TIMESTAMP '2024-06-15 12:00:00' - INTERVAL 14 DAY THEN 'stale' ELSE 'expired' END AS freshness FROM postings"""
)
def revalidation(spark, sf):
    import datetime as dt

    p = _postings(spark, sf).withColumn("probe", F.get(F.array(F.lit("gone"), F.lit("alive"), F.lit("unknown")), (F.col("size") % 3).cast("int")))
    now = dt.datetime(2024, 6, 15, 12)
    active, fresh = S.revalidated(F.col("probe"), F.col("active"), S.freshness(F.col("active"), F.lit(None).cast("timestamp_ntz"), F.col("posted"), F.col("posted"), now))
    return p.select("offer_id", active.alias("active"), fresh.alias("freshness"))


@query("SELECT o_custkey AS user_id, count(*) AS runs, round(avg(CAST(o_orderstatus <> 'P' AS INTEGER)), 3) AS success_rate, round(sum(o_totalprice) / count(*), 2) AS offers_per_run, round(count(*) FILTER (WHERE o_totalprice < 50000) / nullif(count(*) FILTER (WHERE o_orderstatus <> 'P'), 0), 3) AS empty_result_rate FROM orders GROUP BY 1")
def source_run_rates(spark, sf):
    a = R.applications(spark, sf)
    ok = F.col("status") != "P"
    return a.groupBy("user_id").agg(
        F.count("*").alias("runs"),
        F.round(F.avg(ok.cast("int")), 3).alias("success_rate"),
        F.round(F.sum("score") / F.count("*"), 2).alias("offers_per_run"),
        F.round(F.try_divide(F.count_if(F.col("score") < 50000), F.count_if(ok)), 3).alias("empty_result_rate"),
    )


@query(
    """WITH t AS (SELECT event_id, user_id, event_type = 'error' AS failed, event_type = 'view' AS empty_run, ts FROM events), g AS (SELECT *, sum(CASE WHEN NOT failed AND NOT empty_run THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM t)
    SELECT event_id, CAST(sum(CASE WHEN empty_run THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, e ORDER BY ts, event_id) AS BIGINT) AS empty_streak, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS last30 FROM g JOIN (SELECT event_id, value FROM events) v USING (event_id)"""
)
def empty_streaks(spark, sf):
    """Empty runs in a row (a failure leaves the count), and the last thirty durations as a list."""
    e = R.usage_events(spark, sf)
    order = ["created_at", "event_id"]
    w = Window.partitionBy("user_id").orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    empty, failed = F.col("kind") == "view", F.col("kind") == "error"
    rows = e.withColumn("e", F.sum(F.when(~failed & ~empty, 1).otherwise(0)).over(running))
    inside = Window.partitionBy("user_id", "e").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("event_id", F.sum(empty.cast("long")).over(inside).alias("empty_streak"), F.collect_list("duration_ms").over(w.rowsBetween(-29, 0)).alias("last30"))


@query("SELECT o_orderkey AS id, o_custkey AS user_id, o_totalprice AS score, count(*) OVER () AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def page_with_total(spark, sf):
    a = R.applications(spark, sf)
    page = a.orderBy(F.desc("created_at"), "id").offset(50).limit(25).select("id", "user_id", "score")
    return page.join(F.broadcast(a.agg(F.count("*").alias("total"))))


@query("SELECT o_orderkey AS id, o_totalprice AS score FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders) UNION ALL SELECT o_orderkey, o_totalprice FROM orders JOIN (SELECT DISTINCT p_partkey * 7 AS k FROM part WHERE p_size < 5) ON k = o_orderkey AND o_orderkey <> (SELECT min(o_orderkey) FROM orders)")
def looked_up(spark, sf):
    """A point lookup by key, and the rows of a list of keys by a semi-join instead of chunks of IN lists."""
    a = R.applications(spark, sf)
    one = a.agg(F.min("id").alias("k")).first()["k"]
    keys = R.offers(spark, sf).where("size < 5").select((F.col("offer_id") * 7).alias("id"))
    point = a.where(F.col("id") == F.lit(one))
    return point.unionByName(a.where(F.col("id") != F.lit(one)).join(keys, "id", "left_semi")).select("id", "score")


@query("SELECT user_id, kind, origin FROM (SELECT DISTINCT user_id, event_type AS kind, 'kept' AS origin FROM events WHERE event_type IN ('click', 'view')) UNION ALL SELECT user_id, kind, 'new' FROM (SELECT DISTINCT o_custkey AS user_id, 'view' AS kind FROM orders) n WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = n.user_id AND e.event_type = n.kind)")
def insert_once(spark, sf):
    """Rows are only inserted where their key is not there yet; what is there keeps its origin."""
    have = R.usage_events(spark, sf).where(F.col("kind").isin("click", "view")).select("user_id", "kind").distinct()
    new = R.applications(spark, sf).select("user_id", F.lit("view").alias("kind")).distinct()
    return have.withColumn("origin", F.lit("kept")).unionByName(new.join(have, ["user_id", "kind"], "left_anti").withColumn("origin", F.lit("new")))


@query("SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def users_without_large(spark, sf):
    return R.users(spark, sf).select("user_id", "name").join(R.applications(spark, sf).where("score > 200000"), "user_id", "left_anti")


@query(
    """SELECT p_partkey AS offer_id, list_transform([p_name, 'Led ' || p_brand, '', p_type], lambda b, i: CASE WHEN b = '' OR regexp_matches(b, '^(Designed|Developed|Implemented|Architected|Optimized|Delivered|Led|Managed|Automated|Reduced|Improved|Built|Deployed|Integrated|Analysed|Migrated|Scaled|Streamlined|Coordinated|Mentored)') THEN b ELSE ['Designed', 'Developed', 'Implemented', 'Architected'][i] || ' ' || lower(b[1]) || b[2:] END) AS bullets FROM part"""
)
def strong_bullets(spark, sf):
    b = F.array("title", F.concat(F.lit("Led "), "company"), F.lit(""), "job_type")
    return R.offers(spark, sf).select("offer_id", E.strong_bullets(b).alias("bullets"))


@query("SELECT p_partkey AS offer_id, CASE WHEN lower(p_name) = lower(p_type) THEN 2 ELSE 3 END + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS n, [p_brand] || CASE WHEN p_size % 2 = 0 THEN ['Own'] ELSE [] END || ['x' || p_size] AS merged, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type END AS newest FROM part")
def merged_entries(spark, sf):
    """Entries of a document once (blank ones stay), lists united ignoring case, and scalars where the newer one wins unless blank."""
    entry = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    t, j, s = F.col("title"), F.col("job_type"), F.col("size")
    blank = entry(F.lit(""), F.lit(None).cast("string"))
    entries = F.concat(F.array(entry(t, F.lit("k")), entry(F.concat(F.lit(" "), F.upper(t)), F.lit("K ")), entry(j, F.lit("k")), blank), F.when(s % 2 == 0, F.array(blank)).otherwise(F.array().cast("array<struct<a:string,b:string>>")))
    old = F.concat(F.array("company"), F.when(s % 2 == 0, F.array(F.lit("Own"))).otherwise(F.array().cast("array<string>")))
    new = F.array(F.lower("company"), F.concat(F.lit("x"), s.cast("string")), F.concat(F.lit("X"), s.cast("string")))
    newer = E.newer_scalar(t, F.when(s % 3 != 0, j).otherwise(""))
    return R.offers(spark, sf).select("offer_id", F.size(E.entries_once(entries, "a", "b")).alias("n"), E.merged_lists(old, new).alias("merged"), newer.alias("newest"))


@query("SELECT company AS board, CASE WHEN n = 0 THEN 'unavailable' WHEN failed > 0 THEN 'partial' ELSE 'success' END AS status, n AS offers FROM (SELECT p_brand AS company, count(*) FILTER (WHERE p_size % 10 <> 0) AS n, count(*) FILTER (WHERE p_size % 10 = 0) AS failed FROM part GROUP BY 1)")
def board_status(spark, sf):
    """Boards fetched apart: a failed page makes its board partial, no page at all unavailable; other boards don't notice."""
    good = F.col("size") % 10 != 0
    b = R.offers(spark, sf).groupBy(F.col("company").alias("board")).agg(F.count_if(good).alias("offers"), F.count_if(~good).alias("failed"))
    status = F.when(F.col("offers") == 0, "unavailable").when(F.col("failed") > 0, "partial").otherwise("success")
    return b.select("board", status.alias("status"), "offers")
