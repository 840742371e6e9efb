"""Further operators on the test tables: guards, cursors, event-time windows, slots, state."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from .. import roles as R
from ..functions import text as X
from ..operators import conversation as C
from ..operators import documents as D
from ..operators import relational as J
from ..operators import scoring as S
from ..streaming import state as ST
from .queries import query


@query(
    """WITH a AS (SELECT o_orderkey AS id, o_custkey AS user_id, o_orderpriority AS source, row_number() OVER w AS attempt_count, first_value(o_orderkey) OVER w AS original FROM orders WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate, o_orderkey))
    SELECT id, user_id, source, attempt_count, original, CASE WHEN attempt_count > 1 THEN 'duplicate' ELSE 'new' END AS state FROM a"""
)
def duplicate_guard(spark, sf):
    w = Window.partitionBy("user_id", "source").orderBy("created_at", "id")
    a = R.applications(spark, sf).withColumn("attempt_count", F.row_number().over(w).cast("long")).withColumn("original", F.first("id").over(w))
    return a.select("id", "user_id", "source", "attempt_count", "original", F.when(F.col("attempt_count") > 1, "duplicate").otherwise("new").alias("state"))


@query(
    """WITH l AS (SELECT o_custkey AS user_id, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS ids FROM orders GROUP BY 1), x AS (SELECT user_id, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM l)
    SELECT user_id, pos, id, o_orderstatus AS status FROM x JOIN orders ON o_orderkey = id WHERE pos BETWEEN 3 AND 5"""
)
def resume_cursor(spark, sf):
    """A frozen order of ids per user, and its page at offset 3."""
    a = R.applications(spark, sf)
    frozen = a.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.negative("score").alias("s"), "id"))).alias("ids"))
    page = frozen.select("user_id", F.posexplode(F.transform("ids", lambda x: x["id"])).alias("pos", "id")).where(F.col("pos").between(3, 5))
    return page.join(a.select("id", "status"), "id").select("user_id", F.col("pos").cast("long").alias("pos"), "id", "status")


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_orderdate IS NULL OR o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAY ORDER BY o_orderdate DESC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 60")
def date_sort(spark, sf):
    a = R.applications(spark, sf)
    now = R.latest(a)
    fresh = F.col("created_at").isNull() | (F.col("created_at") >= F.lit(now).cast("timestamp_ntz") - F.expr("INTERVAL 90 DAYS"))
    return a.where(fresh).orderBy(F.col("created_at").desc_nulls_last(), F.desc("score"), "id").limit(60).select("id", "created_at")


@query(
    """WITH f AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'expired' WHEN o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 24 HOUR THEN 'fresh' WHEN o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 14 DAY THEN 'stale' ELSE 'expired' END AS freshness FROM orders)
    SELECT id, freshness FROM f WHERE freshness IN ('stale', 'fresh')"""
)
def freshness_at_least(spark, sf):
    a = R.applications(spark, sf)
    c = F.col("created_at")
    f = S.freshness(F.col("status") != "P", F.lit(None).cast("timestamp_ntz"), c, c, R.latest(a))
    return a.select("id", f.alias("freshness")).where(S.freshness_rank(F.col("freshness")) >= 2)


@query("SELECT date_trunc('hour', ts) AS start, event_type AS kind, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def hourly_activity(spark, sf):
    e = R.usage_events(spark, sf)
    return e.groupBy(F.window("created_at", "1 hour").alias("w"), "kind").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users")).select(F.col("w.start").alias("start"), "kind", "n", "users")


@query(
    """WITH x AS (SELECT event_id, ts, date_trunc('hour', ts) - INTERVAL (h) HOUR AS start FROM events, (VALUES (0), (1), (2)) v(h)) SELECT start, count(*) AS n FROM x WHERE ts < start + INTERVAL 3 HOUR GROUP BY 1"""
)
def sliding_activity(spark, sf):
    return R.usage_events(spark, sf).groupBy(F.window("created_at", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "n")


@query(
    """WITH o AS (SELECT DISTINCT o_custkey AS user_id, o_orderstatus AS target_id FROM orders WHERE o_totalprice > 100000), r AS (SELECT o_custkey AS user_id, o_orderpriority AS action, o_orderstatus AS target_id, o_orderkey AS rec_seq, CASE WHEN o_totalprice > 250000 THEN 'high' WHEN o_totalprice > 150000 THEN 'medium' ELSE 'low' END AS priority, o_totalprice AS confidence FROM orders),
    f AS (SELECT r.* FROM r SEMI JOIN o USING (user_id, target_id)), u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY user_id, action, target_id ORDER BY rec_seq) = 1)
    SELECT user_id, action, target_id, rec_seq, priority, confidence, row_number() OVER (PARTITION BY user_id ORDER BY CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, confidence DESC, rec_seq) AS place FROM u QUALIFY place <= 3"""
)
def rank_and_cap(spark, sf):
    a = R.applications(spark, sf)
    owned = a.where("score > 100000").select("user_id", F.col("status").alias("target_id"))
    level = F.when(F.col("score") > 250000, "high").when(F.col("score") > 150000, "medium").otherwise("low")
    recs = a.select("user_id", F.col("source").alias("action"), F.col("status").alias("target_id"), F.col("id").alias("rec_seq"), level.alias("priority"), F.col("score").alias("confidence"))
    return C.recommendations(recs, owned)


_MEANT = ["", "the second one please", "apply to offer 3", "le dernier", "offre n° 12 or the first", "job #4, not the last", "la première", "Fifth!", "the thirdly", "number 7"]
_WORD = "regexp_matches(t, '(^|[^a-z]){}([^a-z]|$)')"


@query(
    f"""WITH m AS (SELECT conv_id, turn, lower(coalesce(text, '') || ' ' || [{', '.join(f"'{x}'" for x in _MEANT)}][1 + (conv_id + turn) % {len(_MEANT)}]) AS t FROM conversations WHERE role = 'user')
    SELECT conv_id, turn, length(t) AS n, coalesce(TRY_CAST(regexp_extract(t, '(?:offer|offre|job|number|numéro|#) ?(?:n° ?)?([0-9]{{1,2}})', 1) AS INTEGER), CASE WHEN {_WORD.format('(last|dernier|dernière)')} THEN -1 {' '.join(f"WHEN {_WORD.format(w)} THEN {n}" for w, n in C.ORDINALS.items())} END) AS meant FROM m"""
)
def message_references(spark, sf):
    """Which offer a user's message means, by number, ordinal or as the last one; each message has one of ten references behind it."""
    m = R.messages(spark, sf).where("role = 'user'")
    said = F.get(F.array(*map(F.lit, _MEANT)), ((F.col("conv_id") + F.col("turn")) % len(_MEANT)).cast("int"))
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), said)
    return m.select("conv_id", "turn", F.length(t).cast("long").alias("n"), C.ordinal_reference(t).alias("meant"))


@query(
    """WITH d AS (SELECT doc_id, sha256(text) AS h FROM documents) SELECT a.doc_id AS doc_id, min(b.doc_id) AS earlier FROM d a JOIN d b ON a.h = b.h AND b.doc_id < a.doc_id GROUP BY 1"""
)
def digest_join(spark, sf):
    """Documents whose digest an earlier one has; the earliest is enough, so a group is never joined with itself."""
    d = R.read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("earlier"), F.count("*").alias("n")).where("n > 1").drop("n")
    return d.join(first, "h").where("doc_id > earlier").select("doc_id", "earlier")


@query("SELECT conv_id, role, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1")
def latest_message_per_role(spark, sf):
    return J.latest_per(R.messages(spark, sf).select("conv_id", "role", "turn", "text"), ["conv_id", "role"], "turn")


@query("SELECT user_id, event_type AS kind, round(sum(value), 4) AS total, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase') GROUP BY 1, 2")
def buyers_activity(spark, sf):
    e = R.usage_events(spark, sf)
    return e.join(e.where("kind = 'purchase'").select("user_id").distinct(), "user_id", "left_semi").groupBy("user_id", "kind").agg(F.round(F.sum("duration_ms"), 4).alias("total"), F.count("*").alias("n"))


@query("SELECT n_name AS nation, r_name AS region, count(DISTINCT c_custkey) AS users, count(o_orderkey) AS applications, round(coalesce(sum(o_totalprice), 0), 2) AS score FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def activity_by_place(spark, sf):
    n, r = R.read(spark, sf, "nation"), R.read(spark, sf, "region")
    c, a = R.read(spark, sf, "customer"), R.applications(spark, sf)
    per = a.groupBy("user_id").agg(F.count("*").alias("k"), F.sum("score").alias("s"))
    j = c.join(per, c.c_custkey == per.user_id, "left").join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("users"), F.coalesce(F.sum("k"), F.lit(0)).alias("applications"), F.round(F.coalesce(F.sum("s"), F.lit(0.0)), 2).alias("score"))


@query("SELECT p_partkey AS offer_id, CASE WHEN p_size < 10 THEN 0 WHEN p_size < 20 THEN 60 WHEN p_size < 35 THEN 85 ELSE 97 END AS confidence, greatest(0.0, least(100.0, (p_size % 3) / 2.0 * 70 + (p_size % 2) * 30.0 - (p_size % 5) * 10.0 - (p_size % 7) * 3.0)) AS section FROM part")
def confidence(spark, sf):
    o = R.offers(spark, sf)
    n = F.when(F.col("size") < 10, 0).when(F.col("size") < 20, 2).when(F.col("size") < 35, 5).otherwise(9)
    s = F.col("size")
    return o.select("offer_id", S.skills_confidence(n).alias("confidence"), S.section_confidence((s % 3) / F.lit(2.0), (s % 2).cast("double"), s % 5, s % 7).alias("section"))


@query(
    """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS source, ts, event_type <> 'error' AS fine FROM events), g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY source ORDER BY ts, fine DESC)) > 1260000000, false) AS gone FROM r),
    i AS (SELECT *, count(*) FILTER (WHERE fine OR gone) OVER (PARTITION BY source ORDER BY ts, fine DESC ROWS UNBOUNDED PRECEDING) AS island FROM g), f AS (SELECT *, CAST(count(*) FILTER (WHERE NOT fine) OVER (PARTITION BY source, island ORDER BY ts, fine DESC ROWS UNBOUNDED PRECEDING) AS INTEGER) AS fails FROM i)
    SELECT source, ts, CASE WHEN fails >= 3 THEN 'open' WHEN fails > 0 THEN 'half_open' ELSE 'closed' END AS state, fails, CASE WHEN fails >= 3 THEN ts + INTERVAL 600 SECOND END AS open_until FROM f"""
)
def breaker_fold(spark, sf):
    e = R.usage_events(spark, sf)
    runs = e.select(F.col("user_id").cast("string").alias("source"), F.col("created_at").cast("timestamp").alias("ts"), F.when(F.col("kind") == "error", "failed").otherwise("success").alias("state"))
    return ST.breaker_batch(runs)


@query()
def document_sections(spark, sf):
    return D.split_sections(D.lines_of(R.read(spark, sf, "documents")))


@query()
def page_lists(spark, sf):
    return R.spread(R.read(spark, sf, "pages").select("page_id", "html"), "page_id").select("page_id", D.list_items(X.html_to_text(F.col("html"))).alias("items"))
