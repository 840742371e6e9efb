"""The operators applied to the test tables' roles, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from .. import roles as R
from ..functions import language as L
from ..functions import text as X
from ..operators import analytics as A
from ..operators import conversation as C
from ..operators import documents as D
from ..operators import relational as J
from ..operators import resolve as E
from ..operators import scoring as S

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


NOW = "(SELECT max(ts) FROM events)"
_W = {"day": 1, "week": 7, "month": 30, "year": 365}
_SHORT = {"d1": 1, "d3": 3, "d7": 7, "d14": 14}
KINDS = ["click", "error", "purchase", "view"]


def _cnt(col: str, now: str, w: dict, pre: str) -> str:
    return ", ".join(f"count(*) FILTER (WHERE {col} >= {now} - INTERVAL {d} DAY) AS {pre}{k}" for k, d in w.items())


@query(f"""SELECT {', '.join(f"count(DISTINCT user_id) FILTER (WHERE ts >= {NOW} - INTERVAL {d} DAY) AS active_{k}" for k, d in _W.items())}, (SELECT count(*) FROM customer) AS total_users FROM events""")
def usage_overview(spark, sf):
    e = R.usage_events(spark, sf)
    return A.active_users(e, R.users(spark, sf), R.latest(e))


@query(f"SELECT {_cnt('ts', NOW, _SHORT, 'new_')} FROM events WHERE event_type = 'signup'")
def signups_by_window(spark, sf):
    e = R.usage_events(spark, sf)
    return A.signups(e, R.latest(e), windows=_SHORT)


@query(
    f"""SELECT k.kind, {', '.join(f"count(*) FILTER (WHERE ts >= {NOW} - INTERVAL {d} DAY) AS events_{w}" for w, d in _SHORT.items())},
    {', '.join(f"count(DISTINCT user_id) FILTER (WHERE ts >= {NOW} - INTERVAL {d} DAY) AS users_{w}" for w, d in _SHORT.items())}
    FROM (VALUES ('click'), ('error'), ('purchase'), ('view'), ('export')) k(kind) LEFT JOIN events ON event_type = k.kind GROUP BY 1"""
)
def activity_by_kind_window(spark, sf):
    e = R.usage_events(spark, sf)
    return A.activity_by_kind(e, R.latest(e), [*KINDS, "export"], _SHORT)


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf):
    return A.status_counts(R.applications(spark, sf))


_ONOW = "(SELECT max(o_orderdate) FROM orders)"


@query(f"SELECT {_cnt('o_orderdate', _ONOW, _W, 'n_')}, count(*) AS n_total FROM orders")
def window_counts(spark, sf):
    a = R.applications(spark, sf)
    return A.window_counts(a, R.latest(a))


@query("SELECT coalesce(nullif(trim(o_orderpriority), ''), 'unknown') AS source, count(*) AS n FROM orders GROUP BY 1")
def source_counts(spark, sf):
    return A.source_counts(R.applications(spark, sf))


@query("SELECT CAST(trunc(avg(o_totalprice)) AS BIGINT) AS avg_int, round(avg(o_totalprice), 4) AS avg_4, count(o_totalprice) AS n FROM orders")
def avg_rounding(spark, sf):
    return A.averages(R.applications(spark, sf))


@query("SELECT l_returnflag AS flag, count(DISTINCT l_partkey) AS offers, count(DISTINCT l_orderkey) AS applications FROM lineitem GROUP BY 1")
def distinct_used(spark, sf):
    li = R.read(spark, sf, "lineitem")
    return li.groupBy(F.col("l_returnflag").alias("flag")).agg(F.count_distinct("l_partkey").alias("offers"), F.count_distinct("l_orderkey").alias("applications"))


@query(f"SELECT 'cv' AS kind, count(*) AS total, {_cnt('o_orderdate', _ONOW, _W, 'n_')} FROM orders UNION ALL SELECT 'letter', count(*), {_cnt('l_shipdate', _ONOW, _W, 'n_')} FROM lineitem")
def document_totals(spark, sf):
    a = R.applications(spark, sf)
    return A.document_totals({"cv": a, "letter": R.saved(spark, sf).withColumnRenamed("saved_at", "created_at")}, R.latest(a))


@query(f"SELECT user_id, {', '.join(f'''count(*) FILTER (WHERE event_type = '{k}') AS \"{k}\"''' for k in KINDS)} FROM events GROUP BY 1")
def user_event_pivot(spark, sf):
    return A.user_event_pivot(R.usage_events(spark, sf), KINDS)


@query("SELECT o_custkey AS user_id, o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def user_status_map(spark, sf):
    return R.applications(spark, sf).groupBy("user_id", "status").agg(F.count("*").alias("n"))


@query("SELECT p_brand AS company, count(*) AS total, count(*) FILTER (WHERE p_size >= 10) AS enabled, count(*) FILTER (WHERE p_size < 10) AS disabled, count(*) FILTER (WHERE p_size >= 40) AS large FROM part GROUP BY 1")
def board_overview(spark, sf):
    return A.board_overview(R.offers(spark, sf))


@query(
    f"""SELECT o_custkey AS user_id, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS status_f, count(*) FILTER (WHERE o_orderstatus = 'O') AS status_o, count(*) FILTER (WHERE o_orderstatus = 'P') AS status_p,
    {_cnt('o_orderdate', _ONOW, _W, 'n_')}, round(avg(o_totalprice), 6) AS avg_score, max(o_totalprice) AS max_score, count(*) FILTER (WHERE o_totalprice >= 200000) AS good, count(DISTINCT o_orderpriority) AS sources, max(o_orderdate) AS last_at FROM orders GROUP BY 1"""
)
def user_dashboard(spark, sf):
    a = R.applications(spark, sf)
    return A.user_dashboard(a, R.latest(a), 200000.0)


@query(
    """WITH last AS (SELECT p_partkey AS o, p_name FROM part ORDER BY p_partkey DESC LIMIT 500), w AS (SELECT o, unnest(string_split(p_name, ' ')) AS term, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM last),
    c AS (SELECT term, count(*) AS n, max(o) AS fo, arg_min(i, -o * 100 + i) AS fi FROM w WHERE term <> '' GROUP BY 1) SELECT term, n FROM c ORDER BY n DESC, fo DESC, fi, term LIMIT 8"""
)
def top_missing_terms(spark, sf):
    return A.top_terms(R.offers(spark, sf), "title", "offer_id")


@query(
    """WITH s AS (SELECT event_type AS kind, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT kind, max(n) AS n, round(avg(value), 1) AS avg_ms, max(value) FILTER (WHERE i = round_even(0.50 * (n - 1), 0)) AS p50, max(value) FILTER (WHERE i = round_even(0.95 * (n - 1), 0)) AS p95 FROM s GROUP BY 1"""
)
def latency_rollup(spark, sf):
    return A.latency_rollup(R.usage_events(spark, sf))


@query(
    """SELECT event_type AS kind, count(*) AS n, round(avg(value), 1) AS avg_ms, round(count(*) FILTER (WHERE value > 100) / count(*), 3) AS slow_rate, round(count(*) FILTER (WHERE value IS NULL) / count(*), 3) AS empty_rate,
    round(count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0) / count(*), 3) AS even_rate FROM events GROUP BY 1"""
)
def call_rollup(spark, sf):
    return A.call_rollup(R.usage_events(spark, sf))


@query(
    """SELECT user_id, count(*) AS runs, round(count(*) FILTER (WHERE event_type <> 'error') / count(*), 3) AS success_rate, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 3) AS error_rate,
    round(sum(value) FILTER (WHERE event_type <> 'error') / nullif(count(*) FILTER (WHERE event_type <> 'error'), 0), 2) AS per_run, max(value) FILTER (WHERE event_type <> 'error') AS best FROM events GROUP BY 1"""
)
def provider_stats(spark, sf):
    return A.source_health(R.usage_events(spark, sf), "user_id", F.col("kind") == "error")


@query("SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_audit(spark, sf):
    return A.duplicate_audit(R.read(spark, sf, "documents").select(F.sha2("text", 256).alias("digest")), "digest")


@query(
    """WITH s AS (SELECT o_custkey AS user_id, o_orderstatus AS st, count(*) AS n FROM orders GROUP BY 1, 2), l AS (SELECT o_custkey AS user_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest_id FROM orders GROUP BY 1)
    SELECT user_id, CAST(sum(n) AS BIGINT) AS total, string_agg(st || '=' || n, ', ' ORDER BY st) AS by_status, any_value(latest_id) AS latest_id FROM s JOIN l USING (user_id) GROUP BY 1"""
)
def context_summary(spark, sf):
    return A.context_summary(R.applications(spark, sf))


@query("SELECT c_custkey AS user_id, n, c_name AS name, c_mktsegment AS segment FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey ORDER BY n DESC, user_id LIMIT 20 OFFSET 5")
def orders_per_user_top(spark, sf):
    return J.totals_with_users(R.applications(spark, sf), R.users(spark, sf), 20, 5)


@query(
    """WITH a AS (SELECT l_partkey AS offer_id, l_orderkey, o_orderdate, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey), t AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY offer_id ORDER BY o_orderdate DESC, l_orderkey DESC) = 1)
    SELECT l.l_orderkey AS application_id, l_linenumber AS seq, l_partkey AS offer_id, p_name AS title, p_brand AS company, t.l_orderkey AS latest_application, t.o_orderstatus AS latest_status
    FROM lineitem l JOIN part ON p_partkey = l_partkey LEFT JOIN t ON t.offer_id = l_partkey"""
)
def selected_with_latest(spark, sf):
    s = R.saved(spark, sf).select("application_id", "seq", "offer_id")
    apps = s.join(R.applications(spark, sf).select(F.col("id").alias("application_id"), "created_at", "status"), "application_id").select("offer_id", "application_id", "created_at", "status").distinct()
    return J.selected_with_latest(s, R.offers(spark, sf).select("offer_id", "title", "company"), apps).select("application_id", "seq", "offer_id", "title", "company", "latest_application", "latest_status")


@query(
    """SELECT c_custkey AS user_id, c_name AS name, coalesce(a.n, 0) AS applications, coalesce(e.n, 0) AS events, coalesce(s.n, 0) AS saved FROM customer
    LEFT JOIN (SELECT o_custkey u, count(*) n FROM orders GROUP BY 1) a ON a.u = c_custkey LEFT JOIN (SELECT user_id u, count(*) n FROM events GROUP BY 1) e ON e.u = c_custkey
    LEFT JOIN (SELECT o_custkey u, count(*) n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1) s ON s.u = c_custkey"""
)
def per_user_enriched(spark, sf):
    apps = R.applications(spark, sf)
    saved = R.saved(spark, sf).join(apps.select(F.col("id").alias("application_id"), "user_id"), "application_id")
    return J.enriched_users(R.users(spark, sf).select("user_id", "name"), {"applications": apps, "events": R.usage_events(spark, sf), "saved": saved})


@query("SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice >= 250000)")
def semi_join(spark, sf):
    a = R.applications(spark, sf).where("score >= 250000")
    return R.users(spark, sf).select("user_id", "name").join(a, "user_id", "left_semi")


@query("SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(spark, sf):
    return R.users(spark, sf).select("user_id", "name").join(R.applications(spark, sf), "user_id", "left_anti")


@query(
    """SELECT t.o_orderkey AS target_id, arg_max(a.o_orderkey, (a.o_orderdate, a.o_orderkey)) AS latest FROM (SELECT * FROM orders WHERE o_orderstatus = 'P') t
    JOIN (SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders) a ON a.o_custkey = t.o_custkey OR a.o_totalprice = t.o_totalprice GROUP BY 1"""
)
def or_join_latest(spark, sf):
    a = R.applications(spark, sf)
    return J.any_key_latest(a.where("status = 'P'").withColumn("target_id", F.col("id")), a, ["user_id", "score"], ["created_at", "id"], "id").withColumnRenamed("id", "latest")


@query(
    """WITH a AS (SELECT DISTINCT p_partkey AS left_id, unnest(string_split(lower(p_name), ' ')) AS t FROM part), b AS (SELECT DISTINCT p_type AS right_id, unnest(string_split(lower(p_type) || ' ring bolt', ' ')) AS t FROM part)
    SELECT left_id, min(right_id) AS right_id FROM (SELECT left_id, right_id FROM a JOIN b USING (t) GROUP BY 1, 2 HAVING count(*) >= 1) GROUP BY 1"""
)
def fuzzy_token_join(spark, sf):
    o = R.offers(spark, sf)
    left = o.select(F.col("offer_id").alias("left_id"), F.array_distinct(F.split(F.lower("title"), " ")).alias("tokens"))
    right = o.select(F.col("job_type").alias("right_id")).distinct().withColumn("tokens", F.array_distinct(F.split(F.concat(F.lower("right_id"), F.lit(" ring bolt")), " ")))
    return J.token_join(left, right, 1)


@query("SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5)")
def last_n_messages(spark, sf):
    return C.history(R.messages(spark, sf), 5)


@query(
    """WITH r AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
    SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS BIGINT) AS fail_streak, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS best FROM r"""
)
def streaks(spark, sf):
    return J.streaks(R.usage_events(spark, sf), "user_id", ["created_at", "event_id"], F.col("kind") == "error").select("event_id", "user_id", "fail_streak", "best")


@query(
    """SELECT event_id, round(avg(value) OVER w, 6) AS avg_n, max(value) OVER w AS max_n, count(value) OVER w AS count_n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"""
)
def sliding_list(spark, sf):
    return J.sliding(R.usage_events(spark, sf), "user_id", ["created_at", "event_id"], "duration_ms", 30).select("event_id", "avg_n", "max_n", "count_n")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS calls FROM events")
def rate_limit_window(spark, sf):
    return J.calls_in_window(R.usage_events(spark, sf), "user_id", 3600).select("event_id", "calls")


@query(
    """WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) <= 14400000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM s GROUP BY 1, 2"""
)
def user_sessions(spark, sf):
    return J.sessions(R.usage_events(spark, sf), "user_id", 240)


@query("SELECT o_custkey AS user_id, arg_max(o_orderkey, (o_orderstatus = 'F', o_totalprice, o_orderdate, o_orderkey)) AS id FROM orders GROUP BY 1")
def best_per_user(spark, sf):
    return R.applications(spark, sf).groupBy("user_id").agg(F.max_by("id", F.struct((F.col("status") == "F").alias("s"), "score", "created_at", "id")).alias("id"))


@query("SELECT o_orderkey AS id, o_orderdate AS created_at, o_totalprice AS score FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40")
def page_offset(spark, sf):
    return R.applications(spark, sf).select("id", "created_at", "score").orderBy(F.desc("created_at"), F.desc("id")).offset(40).limit(20)


@query("SELECT o_orderkey AS id, o_totalprice AS score FROM orders ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey LIMIT 60")
def stable_sort_cap(spark, sf):
    return R.applications(spark, sf).orderBy(F.desc("score"), F.desc("created_at"), "id").limit(60).select("id", "score")


@query("SELECT * FROM (SELECT l_partkey AS offer_id, l_suppkey AS source_id, l_orderkey AS application_id, l_linenumber AS seq, l_quantity AS quantity FROM lineitem) QUALIFY row_number() OVER (PARTITION BY offer_id, source_id ORDER BY application_id, seq) = 1")
def first_wins_dedup(spark, sf):
    return J.first_wins(R.saved(spark, sf).select("offer_id", "source_id", "application_id", "seq", "quantity"), ["offer_id", "source_id"], ["application_id", "seq"])


_SLUG = "regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT p_partkey AS offer_id, sha256('part|' || p_partkey || '|' || {_SLUG.format('p_brand')} || '|' || {_SLUG.format('p_name')} || '|' || {_SLUG.format('p_type')}) AS content_hash, {_SLUG.format('p_brand')} || '|' || {_SLUG.format('p_name')} AS job_key FROM part")
def content_hash(spark, sf):
    o = R.offers(spark, sf)
    parts = [F.lit("part"), F.col("offer_id").cast("string"), X.slug(F.col("company")), X.slug(F.col("title")), X.slug(F.col("job_type"))]
    return o.select("offer_id", F.sha2(F.concat_ws("|", *parts), 256).alias("content_hash"), F.concat_ws("|", *parts[2:4]).alias("job_key"))


@query(
    """WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), q AS (SELECT page_id, lower(regexp_extract(u, '^([^:/?]+://[^/?]*)', 1)) AS head,
    regexp_replace(regexp_extract(u, '^[^:/?]+://[^/?]*([^?]*)', 1), '/+$', '') AS path, list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: lower(split_part(x, '=', 1)) NOT IN ('fbclid','gclid','gh_src','mc_cid','mc_eid','ref','source','src','trk') AND NOT starts_with(lower(x), 'utm_') AND regexp_extract(x, '=(.+)$', 1) <> '')) AS ps FROM p)
    SELECT head || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(ps) > 0 THEN '?' || array_to_string(ps, '&') ELSE '' END AS url, count(*) AS n, min(page_id) AS first_page FROM q GROUP BY 1"""
)
def url_dedup(spark, sf):
    return R.read(spark, sf, "pages").groupBy(X.normalize_url(F.col("url")).alias("url")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host, regexp_matches(url, '^https?://') AS usable, (regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), '(^|\\.)example\\.com$')) AS in_domain FROM pages")
def url_hosts(spark, sf):
    u = F.col("url")
    return R.read(spark, sf, "pages").select("page_id", X.url_host(u).alias("host"), X.usable_url(u).alias("usable"), X.host_matches(u, "example.com").alias("in_domain"))


def _offers_for_resolution(spark, sf):
    """Up to three postings of an offer, whose links cross companies.

    The board's posting has an id, a city or remote work and its page's URL, if it has one; a mirror
    has the page's URL with tracking and now and then no city or company; an agency reposts under the
    board's id, in the name of the next company.
    """
    o, p = R.offers(spark, sf), R.read(spark, sf, "pages")
    o = R.spread(o, "offer_id").join(p.select(F.col("page_id").alias("offer_id"), "url"), "offer_id", "left")
    i, size = F.col("offer_id"), F.col("size")
    when = lambda c, x: F.when(c, x).otherwise(F.lit(None).cast("string"))
    company = lambda k: F.concat_ws(" ", "company", F.floor((i + k) / 400).cast("string"))
    url = F.coalesce("url", F.lit(""))
    tracked = F.when(url != "", F.concat(F.regexp_replace(url, "#.*$", ""), F.when(url.contains("?"), "&").otherwise("?"), F.lit("utm_source=mirror"))).otherwise("")
    title = F.concat_ws(" ", "title", "job_type")
    city = when(size % 7 != 0, F.concat(F.lit("City "), (size % 9).cast("string")))
    level = when(size % 4 == 0, F.when(size % 8 == 0, "junior").otherwise("senior"))

    def posting(k, source, jid, link, name, employer, place, lv):
        fields = [(i * 3 + k).alias("seq"), F.lit(source).alias("source"), jid.alias("source_job_id"), link.alias("source_url"), name.alias("title"), employer.alias("company"), place.alias("city")]
        return F.struct(*fields, when(size % 11 == 0, F.lit("remote")).alias("remote_type"), F.when(size % 13 == 0, "internship").otherwise("job").alias("job_type"), lv.alias("level"), F.lit({"board": 55, "mirror": 90}[source]).alias("priority"))

    none = F.lit(None).cast("string")
    board = posting(0, "board", i.cast("string"), url, title, company(0), city, level)
    mirror = posting(1, "mirror", F.lit(""), tracked, F.concat(title, F.lit("s")), when(size % 10 != 0, company(0)), when(size % 3 != 0, city), none)
    agency = posting(2, "board", i.cast("string"), F.lit(""), title, company(400), city, none)
    rows = o.select(F.explode(F.array_compact(F.array(board, F.when(size % 2 == 0, mirror), F.when(i % 20 == 0, agency)))).alias("x"))
    return rows.select("x.*")


@query()
def entity_resolution(spark, sf):
    return E.resolve(_offers_for_resolution(spark, sf))


@query(
    """WITH r AS (SELECT p_partkey AS seq, p_partkey - p_partkey % 6 AS g, p_size % 4 AS priority, 'feed' || p_size % 3 AS source, 'https://a.org/' || p_size % 7 AS url, p_name AS title, CASE WHEN p_size % 3 > 0 THEN p_brand END AS company, CASE WHEN p_size % 2 > 0 THEN p_type ELSE '' END AS city,
    CASE WHEN p_size % 5 > 1 THEN p_retailprice END AS salary, CASE WHEN p_size % 6 > 0 THEN repeat('d', p_size % 6) || p_partkey % 2 END AS description, [p_brand, 's' || p_size % 9, p_type, p_brand] AS skills, CASE WHEN p_size % 8 > 0 THEN DATE '2024-01-01' + p_size END AS posted FROM part),
    l AS (SELECT *, coalesce(priority > max(priority) OVER (PARTITION BY g ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS led FROM r),
    o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY led DESC, CASE WHEN led THEN -priority ELSE 0 END, seq) AS k FROM l),
    e AS (SELECT g, k, unnest(skills) AS skill, generate_subscripts(skills, 1) AS i FROM o), s AS (SELECT g, list(skill ORDER BY m)[1:4] AS skills FROM (SELECT g, skill, min(k * 10 + i) AS m FROM e GROUP BY 1, 2) GROUP BY 1)
    SELECT o.g AS group_seq, min(seq) FILTER (WHERE k = 1) AS lead_seq, min(title) FILTER (WHERE k = 1) AS title, arg_min(company, k) FILTER (WHERE company <> '') AS company, arg_min(city, k) FILTER (WHERE city <> '') AS city, arg_min(salary, k) FILTER (WHERE salary IS NOT NULL) AS salary_min,
    arg_min(description, k - 10000 * length(description)) FILTER (WHERE description IS NOT NULL) AS description, min(posted) AS posted_at, list_sort(list_distinct(list(source))) AS merged_sources, list_sort(list_filter(list_distinct(list(url)), lambda u: u <> min(url) FILTER (WHERE k = 1))) AS also_seen_on, any_value(s.skills) AS skills, count(*) AS n
    FROM o JOIN s ON s.g = o.g GROUP BY 1"""
)
def merged_records(spark, sf):
    """Offers in groups of up to six, each merged into one record."""
    o, s, i = R.offers(spark, sf), F.col("size"), F.col("offer_id")
    text = lambda c, x: F.when(c, x)
    rows = o.select(
        i.alias("seq"), (s % 4).alias("priority"), F.concat(F.lit("feed"), (s % 3).cast("string")).alias("source"), F.concat(F.lit("https://a.org/"), (s % 7).cast("string"), F.lit("?utm_source=x")).alias("source_url"), "title", text(s % 3 > 0, F.col("company")).alias("company"),
        text(s % 2 > 0, F.col("job_type")).otherwise("").alias("city"), text(s % 5 > 1, F.col("salary")).alias("salary_min"), text(s % 6 > 0, F.concat(F.expr("repeat('d', size % 6)"), (i % 2).cast("string"))).alias("description"),
        F.array("company", F.concat(F.lit("s"), (s % 9).cast("string")), "job_type", "company").alias("skills"), text(s % 8 > 0, F.date_add(F.lit("2024-01-01").cast("date"), s)).alias("posted_at"),
    )
    return E.merge_groups(rows, o.select(i.alias("seq"), (i - i % 6).alias("group_seq")), skills_cap=4).drop("source", "source_url")


@query()
def resolved_offers(spark, sf):
    """Entity resolution and the merged record of each group."""
    offers = _offers_for_resolution(spark, sf).withColumn("description", F.col("title")).withColumn("posted_at", F.lit(None).cast("timestamp"))
    return E.merge_groups(offers, E.resolve(offers))


@query(
    """WITH b AS (SELECT p_partkey AS id, p_name AS title, p_brand AS company, p_size AS size FROM part WHERE p_size <= 30), n AS (SELECT p_partkey AS id, p_name || ' new' AS title, CASE WHEN p_size > 25 THEN p_type END AS company, p_size + 1 AS size FROM part WHERE p_size >= 20)
    SELECT coalesce(n.id, b.id) AS id, CASE WHEN coalesce(length(n.title), -1) >= coalesce(length(b.title), -1) THEN n.title ELSE b.title END AS title, coalesce(b.company, n.company) AS company, coalesce(n.size, b.size) AS size,
    CASE WHEN b.id IS NULL THEN 'inserted' WHEN n.id IS NULL THEN 'kept' ELSE 'updated' END AS merge_state FROM b FULL JOIN n ON b.id = n.id"""
)
def upsert_merge(spark, sf):
    o = R.offers(spark, sf)
    base = o.where("size <= 30").select(F.col("offer_id").alias("id"), "title", "company", "size")
    new = o.where("size >= 20").select(F.col("offer_id").alias("id"), F.concat("title", F.lit(" new")).alias("title"), F.when(F.col("size") > 25, F.col("job_type")).alias("company"), (F.col("size") + 1).alias("size"))
    return J.upsert(base, new, "id", ["title"], ["company"], ["size"])


@query("SELECT t.token FROM (SELECT lower(p_brand) AS k, min(p_brand) AS token FROM part GROUP BY 1) t WHERE k NOT IN (SELECT lower(p_brand) FROM part WHERE p_size = 1)")
def token_overlay(spark, sf):
    o = R.offers(spark, sf)
    return J.overlay(o.select(F.col("company").alias("token")), o.select(F.upper("company").alias("token")), o.where("size = 1").select(F.col("company").alias("token")))


@query(f"SELECT p_partkey AS offer_id, {_SLUG.format('p_name')} AS slug, list_sort(list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9+#.]+'))) AS tokens FROM part")
def slug_tokens(spark, sf):
    return R.offers(spark, sf).select("offer_id", X.slug(F.col("title")).alias("slug"), F.array_sort(X.tokens(F.col("title"))).alias("tokens"))


@query(
    r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<(script|style|noscript|template|svg)\b.*?</(script|style|noscript|template|svg)\s*>', '', 'gis'), '<!--.*?-->', '', 'gs'), '<[^>]*>', chr(10), 'g') AS t FROM pages),
    u AS (SELECT page_id, replace(replace(replace(replace(t, '&middot;', '·'), '&copy;', '©'), '&quot;', '"'), '&amp;', '&') AS t FROM t)
    SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[ \t\x{00a0}]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'), '') AS text FROM u"""
)
def html_to_text(spark, sf):
    return R.read(spark, sf, "pages").select("page_id", X.html_to_text(F.col("html")).alias("text"))


@query(
    r"""WITH t AS (SELECT doc_id, ' ' || array_to_string(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), ' ') || ' ' AS w, text FROM documents)
    SELECT doc_id, CASE WHEN len(list_filter(['intern', 'internship', 'stage', 'stagiaire', 'apprenti', 'apprentice', 'working student', 'werkstudent', 'praktikum', 'trainee'], lambda h: contains(w, ' ' || h || ' '))) > 0 THEN 'internship' ELSE 'job' END AS job_type, length(trim(regexp_replace(text, '[ \t ]+', ' ', 'g'))) AS n_clean FROM t"""
)
def text_hints(spark, sf):
    t = F.col("text")
    return R.read(spark, sf, "documents").select("doc_id", X.guess_job_type(t).alias("job_type"), F.length(F.trim(F.regexp_replace(t, "[ \\t\u00a0]+", " "))).cast("long").alias("n_clean"))


_TIMES = lambda words: " + ".join(f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words)


@query(f"""WITH d AS (SELECT doc_id, lang, ' ' || strip_accents(lower(coalesce(text, ''))) || ' ' AS t FROM documents) SELECT doc_id, lang, CASE WHEN {_TIMES(L.DOCUMENT['fr'])} > {_TIMES(L.DOCUMENT['en'])} THEN 'fr' ELSE 'en' END AS detected FROM d""")
def lang_detect(spark, sf):
    return R.read(spark, sf, "documents").select("doc_id", "lang", L.detect_document(F.col("text")).alias("detected"))


@query(
    r"""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: regexp_matches(x, '^[A-Za-z]+$')) AS w FROM documents) SELECT doc_id, CASE WHEN len(w) >= 40 THEN len(list_filter(w, lambda x: length(x) = 1)) / len(w) END AS share FROM t"""
)
def glyph_quality(spark, sf):
    return R.read(spark, sf, "documents").select("doc_id", X.single_letter_share(F.col("text")).alias("share"))


@query(r"""SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: lower(x)))) AS emails FROM documents WHERE regexp_matches(text, '@')""")
def contact_emails(spark, sf):
    return R.read(spark, sf, "documents").where(F.col("text").contains("@")).select("doc_id", F.array_sort(X.emails(F.col("text"))).alias("emails"))


@query(r"""WITH t AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '\+?[0-9][0-9 ().-]{5,20}[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda d: length(d) BETWEEN 7 AND 15) AS phones FROM documents) SELECT doc_id, phones FROM t WHERE len(phones) > 0""")
def contact_phones(spark, sf):
    return R.read(spark, sf, "documents").select("doc_id", X.phones(F.col("text")).alias("phones")).where(F.size("phones") > 0)


@query(
    """WITH t AS (SELECT p_partkey AS offer_id, p_name, p_type, p_brand, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9+#.]+')) AS a, list_distinct(regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z0-9+#.]+')) AS b FROM part)
    SELECT offer_id, round(greatest(0.0, least(1.0, 0.3 * len(list_intersect(a, ['small', 'ring'])) / 2.0 + 0.2 * len(list_intersect(b, ['ring', 'bolt', 'brass'])) / 3.0 + 0.15 * 0.6 + 0.12 * CASE WHEN p_type = 'STANDARD' THEN 1.0 ELSE 0.0 END + 0.08 * 0.6 + 0.05 * 0.5 + 0.1 * 0.55 + CASE WHEN lower(p_brand) = 'brand#2' THEN 0.1 ELSE 0.0 END)), 4) AS score FROM t"""
)
def relevance_score(spark, sf):
    ctx = S.SearchContext(title="small ring", skills=("ring", "bolt", "brass"), job_type="STANDARD", preferred_companies=("Brand#2",))
    n = F.lit(None).cast("string")
    return R.offers(spark, sf).select("offer_id", S.relevance(F.col("title"), F.col("job_type"), F.lit(""), F.col("job_type"), n, n, n, n, F.lit("unknown"), F.col("company"), ctx).alias("score"))


@query(r"SELECT p_partkey AS offer_id FROM part WHERE NOT contains(lower(p_brand), 'brand#1') AND NOT regexp_matches(lower(p_name), '\b(ring|bolt)\b')")
def hard_filter(spark, sf):
    ctx = S.SearchContext(excluded_companies=("Brand#1",), excluded_keywords=("ring", "bolt"))
    return R.offers(spark, sf).where(S.hard_filter(F.col("title"), F.col("company"), F.col("job_type"), ctx)).select("offer_id")


@query(
    """SELECT p_partkey AS offer_id, CASE WHEN len(r) = 0 THEN ['weak match'] ELSE r END AS reasons FROM (SELECT p_partkey, list_filter([CASE WHEN len(list_intersect(regexp_extract_all(lower(p_name), '[a-z0-9+#.]+'), ['small', 'ring'])) > 0 THEN 'title matches' END,
    CASE WHEN p_retailprice >= 1200 THEN 'salary ok' WHEN p_retailprice IS NOT NULL THEN 'salary below' END, CASE WHEN lower(p_brand) = 'brand#2' THEN 'preferred company' END], lambda x: x IS NOT NULL) AS r FROM part)"""
)
def match_explanation(spark, sf):
    ctx = S.SearchContext(title="small ring", preferred_companies=("Brand#2",))
    return R.offers(spark, sf).select("offer_id", S.explain(F.col("title"), F.col("salary"), F.col("company"), ctx, 1200.0).alias("reasons"))


@query(
    f"""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' OR o_orderdate + INTERVAL 700 DAY < {_ONOW} THEN 'expired' WHEN o_orderdate >= {_ONOW} - INTERVAL 24 HOUR THEN 'fresh' WHEN o_orderdate >= {_ONOW} - INTERVAL 14 DAY THEN 'stale' ELSE 'expired' END AS freshness FROM orders"""
)
def freshness(spark, sf):
    a = R.applications(spark, sf)
    c = F.col("created_at")
    return a.select("id", S.freshness(F.col("status") != "P", c + F.expr("INTERVAL 700 DAYS"), c, c, R.latest(a)).alias("freshness"))


@query(
    """SELECT conv_id, string_agg(coalesce(text, ''), chr(10) ORDER BY turn) AS blob FROM (SELECT conv_id, turn, lower(coalesce(text, '')) AS text FROM conversations WHERE role = 'user') GROUP BY 1"""
)
def user_blobs(spark, sf):
    return C.user_blob(R.messages(spark, sf))


@query()
def conversation_slots(spark, sf):
    b = F.col("blob")
    s = C.salary_slot(b)
    slots = {"salary": s["low"], "mode": C.mode_slot(b), "type": C.type_slot(b)}
    return C.user_blob(R.messages(spark, sf)).select("conv_id", s["low"].alias("salary_low"), s["high"].alias("salary_high"), slots["mode"].alias("mode"), slots["type"].alias("type"), C.missing_slots(slots).alias("missing"))


@query("SELECT o_custkey AS user_id, o_orderkey AS id, row_number() OVER w AS version, lag(o_orderkey) OVER w AS parent_id, o_orderkey = first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS is_latest FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def versions(spark, sf):
    w = Window.partitionBy("user_id").orderBy("created_at", "id")
    n = F.count("*").over(Window.partitionBy("user_id"))
    v = F.row_number().over(w)
    return R.applications(spark, sf).select("user_id", "id", v.cast("long").alias("version"), F.lag("id").over(w).alias("parent_id"), (v == n).alias("is_latest"))


@query("SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS from_user, max(turn) AS last_turn FROM conversations GROUP BY 1")
def conversation_counts(spark, sf):
    return R.messages(spark, sf).groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("from_user"), F.max("turn").alias("last_turn"))


@query("SELECT quality, toxic, count(*) AS n, round(avg(length(text)), 4) AS avg_chars FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def label_confidence(spark, sf):
    j = R.read(spark, sf, "labels").join(R.read(spark, sf, "documents").select("doc_id", F.length("text").alias("n")), "doc_id")
    return j.groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n"), 4).alias("avg_chars"))


@query("SELECT doc_id, round(len(list_filter(['the', 'de', 'von', 'the', 'ring'], lambda k: contains(lower(text), k))) / 5 * 100, 1) AS coverage FROM documents")
def keyword_coverage(spark, sf):
    return R.read(spark, sf, "documents").select("doc_id", S.keyword_coverage(F.col("text"), F.array(*[F.lit(k) for k in ("the", "de", "von", "the", "ring")])).alias("coverage"))


@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k, event_type AS kind FROM events WHERE event_type IN ('view', 'click', 'purchase') AND user_id IS NOT NULL")
def event_admission(spark, sf):
    e = R.usage_events(spark, sf).where(F.col("kind").isin("view", "click", "purchase") & F.col("user_id").isNotNull())
    return e.select("event_id", F.get_json_object("meta", "$.k").cast("bigint").alias("k"), "kind")


@query(f"SELECT * FROM events WHERE ts >= {NOW} - INTERVAL 7 DAY")
def retention(spark, sf):
    e = R.read(spark, sf, "events")
    return e.where(F.col("ts") >= A.cutoff(R.latest(e, "ts"), 7))


@query("SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE c_name ILIKE '%' || trim(' 01 ') || '%'")
def name_search(spark, sf):
    return R.users(spark, sf).where(X.contains_query(F.col("name"), " 01 ")).select("user_id", "name")


@query(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_lines, length(text) AS n FROM documents")
def document_lines(spark, sf):
    return D.lines_of(R.read(spark, sf, "documents")).groupBy("doc_id").agg(F.count_if(F.trim("text") != "").alias("n_lines"), (F.sum(F.length("text")) + F.count("*") - 1).alias("n"))
