"""Wishes, contexts, reasons and durations over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import roles as R
from ..functions import preferences as P
from ..operators import conversation as C
from .queries import query


def _has(words: str) -> str:
    """A whole word in DuckDB, whose word borders know ASCII only."""
    return f"regexp_matches(b, '(^|[^\\p{{L}}\\p{{N}}_])({words})($|[^\\p{{L}}\\p{{N}}_])')"


def _choice(choices) -> str:
    return "CASE " + " ".join(f"WHEN {_has(w)} THEN '{n}'" for n, w in choices) + " END"


_SAID = ["", "I want a remote senior role, cdi", "no internship please, on-site", "un stage hybride, étudiant", "freelance contractor, head of data", "2 days office, entry-level, fixed term", "alternance sur place", "junior or graduate; not an internship"]
_BLOB = "lower(coalesce(string_agg(text, ' ' || chr(10) ORDER BY turn) FILTER (WHERE role = 'user'), '')) || ' ' || lower([" + ", ".join(f"'{s}'" for s in _SAID) + f"][1 + conv_id % {len(_SAID)}])"


@query(
    f"""WITH u AS (SELECT conv_id, {_BLOB} AS b FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE role = 'user') GROUP BY conv_id),
    s AS (SELECT conv_id, {_choice(P.MODES)} AS remote_type, CASE WHEN {_has(P.NO_INTERNSHIP)} THEN 'job' WHEN {_has(P.INTERNSHIP)} THEN 'internship' END AS job_type, {_choice(P.LEVELS)} AS experience_level, {_choice(P.CONTRACTS)} AS contract_type, CASE WHEN {_has(P.NO_INTERNSHIP)} THEN ['internship', 'stage'] ELSE [] END AS excluded FROM u),
    m AS (SELECT *, list_filter([CASE WHEN conv_id % 3 > 0 THEN 'query/keywords' END, CASE WHEN remote_type IS NULL THEN 'location/remote_type' END, CASE WHEN job_type IS NULL THEN 'job_type' END, CASE WHEN conv_id % 5 > 0 THEN 'skills' END, CASE WHEN experience_level IS NULL THEN 'experience_level' END,
    CASE WHEN job_type = 'internship' THEN 'internship_duration_months' END, CASE WHEN job_type = 'internship' THEN 'internship_start_date/availability' END], lambda x: x IS NOT NULL) AS lacking FROM s)
    SELECT conv_id, remote_type, job_type, experience_level, contract_type, excluded, lacking, CASE {' '.join(f"WHEN list_contains(lacking, '{n}') THEN '{q}'" for n, q in P.QUESTIONS)} END AS question FROM m"""
)
def preference_slots(spark, sf):
    """What users say, with a wish of eight for each conversation, as slots; what a search still lacks, and the next question."""
    m = R.messages(spark, sf)
    b = C.user_blob(m)
    said = F.get(F.array(*map(F.lit, _SAID)), (F.col("conv_id") % len(_SAID)).cast("int"))
    s = b.select("conv_id", P.slots(F.lower(F.concat("blob", F.lit(" "), said))).alias("s")).select("conv_id", "s.*")
    context = {"query": F.when(F.col("conv_id") % 3 == 0, "x"), "skills": F.when(F.col("conv_id") % 5 == 0, F.array(F.lit("sql")))} | {n: F.col(n) for n in ("remote_type", "job_type", "experience_level")}
    out = s.withColumn("lacking", P.missing(context))
    return out.select("conv_id", "remote_type", "job_type", "experience_level", "contract_type", F.col("excluded_keywords").alias("excluded"), "lacking", P.next_question(F.col("lacking")).alias("question"))


@query(
    """WITH o AS (SELECT p_partkey AS offer_id, list_distinct(regexp_extract_all(lower(p_name), '[a-z0-9+#]+')) AS t, lower(p_type) AS y, p_size AS s, p_retailprice AS pay, p_brand FROM part),
    r AS (SELECT offer_id, CASE WHEN list_has_any(t, ['small', 'ring']) THEN 'title matches “small ring”' WHEN list_contains(t, 'bolt') THEN 'title matches “Bolt”' END AS a, list_filter(['hot', 'Large', 'C++', 'blue'], lambda k: list_contains(t, lower(k)) OR lower(k) = y OR (k = 'C++' AND s % 6 = 0)) AS have, CASE WHEN s % 5 = 0 THEN 'work mode: remote' WHEN s % 4 = 1 THEN 'location matches' END AS c,
    CASE WHEN s % 3 = 0 THEN 'seniority: senior' END AS d, CASE WHEN s % 7 = 0 THEN NULL WHEN pay >= 1200 THEN 'salary meets the minimum' ELSE '⚠ posted salary below your minimum' END AS e, CASE WHEN s % 2 = 0 THEN 'language: EN-gb' END AS f, list_filter(['economy', 'gear', 'nothing'], lambda k: k = y OR list_contains(t, k)) AS g FROM o),
    q AS (SELECT offer_id, have, list_filter([a, CASE WHEN len(have) > 0 THEN 'skills present: ' || array_to_string(have, ', ') END, c, d, e, f, CASE WHEN len(g) > 0 THEN 'sector: ' || array_to_string(g, ', ') END], lambda x: x IS NOT NULL) AS reasons FROM r)
    SELECT offer_id, CASE WHEN len(reasons) = 0 THEN ['weak match — few of your criteria are present in this posting'] ELSE reasons END AS reasons, list_filter(['hot', 'Large', 'C++', 'blue'], lambda k: NOT list_contains(have, k)) AS missing_skills FROM q"""
)
def match_reasons(spark, sf):
    o, s = R.spread(R.offers(spark, sf), "offer_id"), F.col("size")
    text = lambda *xs: F.array(*map(F.lit, xs))
    offer = {
        "title": F.col("title"), "description": F.col("job_type"), "skills": F.when(s % 6 == 0, text("c++.")), "remote_type": F.when(s % 5 == 0, "remote"), "city": F.when(s % 4 == 1, "Porto"), "company": F.col("company"),
        "experience_level": F.when(s % 3 == 0, "senior").otherwise("junior"), "salary_min": F.when(s % 7 != 0, F.col("salary")), "language": F.when(s % 2 == 0, "EN-gb"),
    }
    context = {"query": F.lit("small ring"), "keywords": text("Bolt"), "skills": text("hot", "Large"), "technologies": text("C++", "hot", "blue"), "remote_type": F.lit("remote"), "location": F.lit("Porto, PT"), "experience_level": F.lit("senior"), "salary_min": F.lit(1200), "language": F.lit("en"), "sectors": text("economy", "gear", "nothing")}
    return o.select("offer_id", P.match_reasons(offer, context).alias("m")).select("offer_id", "m.*")


@query(
    """SELECT c_custkey AS user_id, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS query, CASE WHEN c_custkey % 3 = 2 THEN [c_name, 'x'] ELSE [] END AS keywords, CASE WHEN c_custkey % 2 = 0 THEN ['sql', c_mktsegment] ELSE [] END AS skills, CASE WHEN c_custkey % 2 = 0 THEN ['sql', c_mktsegment] ELSE [] END AS technologies,
    CASE WHEN c_custkey % 4 > 0 THEN 'City ' || c_nationkey END AS location, CASE WHEN c_acctbal > 0 THEN 'remote' END AS remote_type, c_acctbal AS salary_min FROM customer"""
)
def profile_contexts(spark, sf):
    c, k = R.read(spark, sf, "customer"), F.col("c_custkey")
    profile = {
        "target_titles": F.when(k % 3 == 1, F.array("c_mktsegment")).when(k % 3 == 2, F.array(F.col("c_mktsegment"), F.col("c_name"), F.lit("x"))), "skills": F.when(k % 2 == 0, F.array(F.lit("sql"), F.col("c_mktsegment"))),
        "locations": F.when(k % 4 > 0, F.array(F.concat(F.lit("City "), F.col("c_nationkey").cast("string")), F.lit("other"))), "remote_preference": F.when(F.col("c_acctbal") > 0, "remote"), "salary_min": F.col("c_acctbal"),
    }
    got = c.select(k.alias("user_id"), P.profile_context(profile).alias("x"))
    return got.select("user_id", *(F.col(f"x.{n}").alias(n) for n in ("query", "keywords", "skills", "technologies", "location", "remote_type", "salary_min")))


@query(
    """WITH p AS (SELECT p_partkey AS id, p_size AS s, 1990 + p_size % 20 AS y, 1 + p_size % 12 AS m FROM part), r AS (SELECT *, CASE s % 8 WHEN 0 THEN (y + 3 - y) * 12 + 12 - m + 1 WHEN 3 THEN (2024 - y) * 12 + 6 - m + 1 WHEN 4 THEN (2024 - y) * 12 + 6 - m + 1 END AS n FROM p)
    SELECT id, CASE s % 8 WHEN 1 THEN (s + 1) || ' months' WHEN 2 THEN '3 mois' WHEN 5 THEN s % 5 + 1 || CASE WHEN s % 5 > 0 THEN ' years' ELSE ' year' END WHEN 6 THEN lpad(CAST(m AS VARCHAR), 2, '0') || '/' || y WHEN 7 THEN NULL
    ELSE concat_ws(' ', CASE WHEN n // 12 > 0 THEN n // 12 || CASE WHEN n // 12 > 1 THEN ' years' ELSE ' year' END END, CASE WHEN n % 12 > 0 THEN n % 12 || CASE WHEN n % 12 > 1 THEN ' months' ELSE ' month' END END) END AS period FROM r"""
)
def experience_periods(spark, sf):
    """Durations as written, ranges with months, open ranges, since a date, ranges of years, lone dates and nothing."""
    s = F.col("p_size")
    y, m = 1990 + s % 20, F.lpad((1 + s % 12).cast("string"), 2, "0")
    t = lambda *xs: F.concat(*(x.cast("string") if isinstance(x, Column) else F.lit(x) for x in xs))
    k = s % 8
    raw = (
        F.when(k == 0, t(m, "/", y, " – 12/", y + 3)).when(k == 1, t("for ", s + 1, " Months in all")).when(k == 2, t("Stage de trois  mois (", y, ")")).when(k == 3, t(m, "/", y, " - Present"))
        .when(k == 4, t("Since ", m, "/", y)).when(k == 5, t(y, " - ", y + s % 5 + 1)).when(k == 6, t(m, "/", y)).otherwise(t("a while ago, in the summer"))
    )
    return R.spread(R.read(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey").select(F.col("p_partkey").alias("id"), P.experience_period(raw, F.lit("2024-06-15").cast("date"), F.lit("en")).alias("period"))


@query(
    """WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id, (contains(t, 'education') OR contains(t, 'formation') OR doc_id % 3 = 0) AND NOT (doc_id % 5 = 0 OR doc_id % 7 = 0) AS needed FROM d"""
)
def fallback_needed(spark, sf):
    """Documents with a header of education, some of which have a body of either section."""
    d, t = R.read(spark, sf, "documents"), F.lower(F.coalesce("text", F.lit("")))
    header = t.contains("education") | t.contains("formation") | (F.col("doc_id") % 3 == 0)
    sections = F.array_compact(F.array(F.lit("skills"), F.when(header, "education")))
    body = lambda k: F.when(F.col("doc_id") % k == 0, F.array(F.lit("x")))
    return d.select("doc_id", P.whole_document_needed(sections, body(5), body(7)).alias("needed"))


@query(
    """WITH p AS (SELECT p_partkey, 'ats-' || p_size % 6 AS source, p_size AS board, p_size % 3 AS third FROM part), e AS (SELECT DISTINCT source, board, board AS seq, CASE WHEN source = 'ats-1' THEN 'denied 403' WHEN source = 'ats-2' THEN CASE WHEN board % 4 = 0 THEN 'denied 429' ELSE 'timeout ' || board END WHEN board % 4 = 3 THEN 'denied 403' END AS error FROM p),
    o AS (SELECT p.source, e.seq, p.p_partkey, row_number() OVER (PARTITION BY p.source ORDER BY e.seq, p.p_partkey) AS k FROM p JOIN e USING (source, board) WHERE e.error IS NULL AND p_partkey % 7 <> 0),
    f AS (SELECT source, least(count(*), 25) AS offers, max(seq) FILTER (WHERE k = 25) AS until, list(p_partkey ORDER BY k) FILTER (WHERE k <= 25) AS kept FROM o GROUP BY 1),
    s AS (SELECT e.source, count(*) AS boards, count(error) AS failed, count(*) FILTER (WHERE error = 'denied 403') AS denied, max_by(error, seq) FILTER (WHERE error IS NOT NULL) AS last_error FROM e LEFT JOIN f ON f.source = e.source WHERE f.until IS NULL OR e.seq <= f.until GROUP BY 1)
    SELECT s.source, CASE WHEN failed = boards AND denied = boards THEN 'blocked' WHEN failed = boards THEN 'unavailable' ELSE 'ok' END AS state, boards, failed, coalesce(offers, 0) AS offers, CASE WHEN failed = boards THEN last_error END AS last_error, coalesce(list_sum(kept), 0) AS kept FROM s LEFT JOIN f ON f.source = s.source"""
)
def boards_union(spark, sf):
    """Six sources of boards: all denied, all failing, some failing; 25 offers of a source at most."""
    from ..operators.boards import board_offers, source_states

    p = R.read(spark, sf, "part").select("p_partkey", F.concat(F.lit("ats-"), (F.col("p_size") % 6).cast("string")).alias("source"), F.col("p_size").alias("board"))
    b, source = F.col("board"), F.col("source")
    error = F.when(source == "ats-1", "denied 403").when(source == "ats-2", F.when(b % 4 == 0, "denied 429").otherwise(F.concat(F.lit("timeout "), b.cast("string")))).when(b % 4 == 3, "denied 403")
    fetches = p.select("source", "board", b.alias("seq"), error.alias("error")).distinct()
    kept = board_offers(fetches, p.select("source", "board", F.col("p_partkey").alias("place")), F.col("place") % 7 != 0, 25)
    sums = kept.groupBy("source").agg(F.sum("place").alias("kept"))
    return source_states(fetches, kept, 25).join(sums, "source", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))


_ACTIONS = ["apply_to_job", "generate_cover_letter", "review_cover_letter", "delete_all_data", "create_cv", "learn_skill", "Rédiger une lettre", "supprimer_le_compte", "improve_cv", ""]


@query(
    f"""WITH r AS (SELECT o_custkey AS user_id, o_orderkey AS rec_seq, lower([{', '.join(f"'{a}'" for a in _ACTIONS)}][1 + o_orderkey % 10]) AS action, CASE WHEN o_orderkey % 4 = 3 THEN 'page' ELSE 'job' END AS target_type, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 3 END AS target_id,
    CASE WHEN o_totalprice > 250000 THEN 'high' WHEN o_totalprice > 150000 THEN 'medium' ELSE 'low' END AS priority, o_totalprice AS confidence, CASE WHEN o_orderkey % 5 = 0 THEN 'SQL' WHEN o_orderkey % 5 = 1 THEN 'rust' END AS skill, o_orderkey % 6 = 0 AS info FROM orders),
    a AS (SELECT * FROM r WHERE action NOT IN ('', 'delete_all_data', 'supprimer_le_compte') AND (target_id IS NULL OR user_id % 3 >= target_id) AND NOT coalesce(target_id = 0 AND user_id % 2 = 0 AND action = 'apply_to_job', false) AND NOT coalesce(target_id = 1 AND action IN ('generate_cover_letter', 'rédiger une lettre'), false) AND NOT coalesce(target_id = 2 AND user_id % 4 = 2 AND action = 'create_cv', false)),
    u AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY user_id, action, target_id ORDER BY rec_seq) = 1),
    d AS (SELECT *, info OR coalesce(skill = 'rust' OR skill = 'SQL' AND user_id % 2 = 1, false) AS asks, CASE WHEN action IN ('generate_cover_letter', 'review_cover_letter', 'rédiger une lettre') THEN 'letter' WHEN action IN ('create_cv', 'improve_cv') THEN 'cv' ELSE CAST(rec_seq AS VARCHAR) END AS kind, CASE priority WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END AS w FROM u),
    b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY user_id, target_type, target_id, kind ORDER BY w DESC, asks, confidence DESC, rec_seq) = 1)
    SELECT user_id, rec_seq, action, target_id, asks, CASE WHEN asks AND NOT info THEN 'Do you actually have experience with ' || skill || '?' END AS question, action = 'apply_to_job' AS confirm, row_number() OVER (PARTITION BY user_id ORDER BY w DESC, asks, confidence DESC, rec_seq) AS place FROM b QUALIFY place <= 3"""
)
def shown_recommendations(spark, sf):
    """Ten kinds of suggestions out of orders: ownership, what is done already, unknown skills, documents that collapse, three of each user."""
    from ..operators import recommendations as V

    o = R.read(spark, sf, "orders")
    k, u = F.col("o_orderkey"), F.col("o_custkey")
    none = F.lit(None).cast("string")
    level = F.when(F.col("o_totalprice") > 250000, "high").when(F.col("o_totalprice") > 150000, "medium").otherwise("low")
    recs = o.select(
        u.alias("user_id"), k.alias("rec_seq"), F.get(F.array(*map(F.lit, _ACTIONS)), (k % 10).cast("int")).alias("action"), F.when(k % 4 == 3, "page").otherwise("job").alias("target_type"), (k % 3).alias("target_id"), level.alias("priority"), F.col("o_totalprice").alias("confidence"),
        F.when(k % 5 == 0, "SQL").when(k % 5 == 1, "rust").alias("skill"), none.alias("question"), (k % 6 == 0).alias("requires_information"), F.lit(False).alias("requires_confirmation"), F.lit("x").alias("title"), F.lit("y").alias("message"), F.lit("z").alias("reason"),
    )
    users = o.select(u.alias("user_id")).distinct()
    jobs = users.select("user_id", F.explode(F.array(*(F.lit(x).cast("long") for x in range(3)))).alias("target_id"))
    mine, t = F.col("user_id"), F.col("target_id")
    owned = jobs.where(mine % 3 >= t).withColumn("target_type", F.lit("job"))
    made = jobs.where(t == 1).withColumn("category", F.lit("letter")).unionByName(jobs.where((t == 2) & (mine % 4 == 2)).withColumn("category", F.lit("cv")))
    fine = V.validated(recs.withColumn("target_id", t.cast("long")), owned, jobs.where((t == 0) & (mine % 2 == 0)), made, users.where(mine % 2 == 0).withColumn("skill", F.lit(" sql")))
    return V.ranked(fine).select("user_id", "rec_seq", "action", "target_id", F.col("requires_information").alias("asks"), "question", F.col("requires_confirmation").alias("confirm"), "place")
