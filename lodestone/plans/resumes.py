"""Sections and reports of résumés, activity without events, conversation lists and token lists, over the given tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import roles as R
from ..operators import analytics as A, documents as D, relational as J
from .queries import query

_HEADERS = ["=== Compétences techniques ===", "EDUCATION:", "  Éducation et Formation", "Work   Experience", "• Centres d'intérêt", "Points forts", "Résumé", "Contact details", "Tools & Technologies", "Licenses and Certifications", "Langues parlées :", "Side projects", "not a header at all", "Experience of a very long kind that is far too long"]
_NAMES = ["skills", "education", "education", "experience", "interests", "personal_qualities", "summary", "contact", "skills", "certifications", "languages", "projects", None, None]
_N = len(_HEADERS)


@query(
    f"""WITH l AS (SELECT p_partkey // 12 AS doc_id, p_partkey % 12 AS line_no, CASE WHEN p_size % 3 = 0 THEN [{', '.join(f"'{h.replace(chr(39), chr(39) * 2)}'" for h in _HEADERS)}][1 + p_partkey % {_N}] ELSE p_name END AS text, CASE WHEN p_size % 3 = 0 THEN [{', '.join(f"'{n}'" if n else 'NULL' for n in _NAMES)}][1 + p_partkey % {_N}] END AS header FROM part),
    s AS (SELECT *, coalesce(last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'contact') AS section FROM l) SELECT doc_id, section, string_agg(text, chr(10) ORDER BY line_no) AS text FROM s WHERE header IS NULL GROUP BY 1, 2"""
)
def resume_sections(spark, sf):
    """Twelve parts are a document: every third line is a header in one of fourteen forms, two of which are none."""
    k = F.col("p_partkey")
    header = F.get(F.array(*map(F.lit, _HEADERS)), (k % _N).cast("int"))
    lines = R.read(spark, sf, "part").select(F.floor(k / 12).alias("doc_id"), (k % 12).alias("line_no"), F.when(F.col("p_size") % 3 == 0, header).otherwise(F.col("p_name")).alias("text"))
    return D.split_sections(lines)


_W, _I, _E = "'warning|' || ", "'info|' || ", "'error|' || "
_UNDATED = "CASE WHEN {0} IS NOT NULL AND NOT regexp_matches({0}, '(19[5-9][0-9]|20[0-4][0-9])') AND NOT contains(lower({0}), 'present') THEN 'warning|{1}|Date text has no recognisable year: ''' || {0} || '''' END"


@query(
    f"""WITH p AS (SELECT p_partkey AS id, p_size AS s, p_brand AS b, p_type AS t, CASE p_size % 4 WHEN 1 THEN 'bad@' WHEN 0 THEN NULL ELSE 'a@b.co' END AS email, CASE p_size % 5 WHEN 1 THEN '3 mois' WHEN 2 THEN 'Summer' WHEN 3 THEN '2020 - Present' WHEN 4 THEN '2019' END AS period, CASE p_size % 5 WHEN 0 THEN '2018' WHEN 1 THEN 'later' ELSE 'Present' END AS ended FROM part)
    SELECT id, list_filter([CASE WHEN s % 4 = 1 THEN 'warning|email|Email format looks invalid: ''bad@''' END, CASE WHEN s % 3 = 0 THEN 'warning|phone|Phone number looks implausible: ''12345''' END, CASE WHEN s % 5 = 0 THEN 'warning|linkedin|linkedin URL looks invalid: ''not a url''' END,
    CASE WHEN s % 6 = 0 THEN 'warning|address|Address looks like it captured contact/URL text: ''me@x.y''' END, CASE WHEN s % 7 = 0 THEN 'error|name|No name could be extracted.' END, CASE WHEN s % 4 = 0 THEN 'error|email|No email could be extracted.' END,
    CASE WHEN s % 3 = 0 THEN 'info|experience|Removed 1 duplicate experience entry.' END, CASE WHEN s % 2 = 0 THEN 'warning|experience[0].position|Missing position/title.' END, CASE WHEN period IS NULL THEN 'warning|experience[0].period|No experience date or duration found in source document.' END,
    CASE WHEN s % 5 <> 1 THEN {_UNDATED.format('period', 'experience[0].period')} END, CASE WHEN s % 4 = 0 THEN 'info|experience[0].technologies|Grouped technologies were split into individual items.' END,
    CASE WHEN s % 8 = 0 THEN 'warning|education[0].institution|Missing institution name.' END, {_UNDATED.format('ended', 'education[0].end_date')}, CASE WHEN ended = '2018' THEN 'warning|education[0].end_date|End date (2018) is before start date (Sept 2020) — likely a mis-attributed date.' END,
    CASE WHEN s % 9 <> 0 THEN 'info|projects|Removed 2 duplicate project entries.' END, CASE WHEN s % 9 = 0 THEN 'warning|projects[0].title|Missing project title.' END, CASE WHEN s % 10 = 0 THEN 'warning|projects[0].github|github URL looks invalid: ''x y''' END, CASE WHEN s % 9 = 0 THEN 'warning|projects[1].title|Missing project title.' END, CASE WHEN s % 9 = 0 THEN 'warning|projects[2].title|Missing project title.' END], lambda x: x IS NOT NULL) AS issues,
    CASE WHEN s % 3 = 0 THEN 1 ELSE 0 END AS experience, 0 AS education, CASE WHEN s % 9 <> 0 THEN 2 ELSE 0 END AS projects FROM p"""
)
def resume_reports(spark, sf):
    """Profiles made of parts with every kind of fault, repeated entries among them."""
    p, s = R.spread(R.read(spark, sf, "part"), "p_partkey"), F.col("p_size")
    null = F.lit(None).cast("string")
    st = lambda **f: F.struct(*(v.alias(k) for k, v in f.items()))
    text = F.lit
    contact = st(email=F.when(s % 4 == 1, "bad@").when(s % 4 > 0, "a@b.co"), phone=F.when(s % 3 == 0, "12345").when(s % 3 == 1, "+1 (555) 123-4567"), linkedin=F.when(s % 5 == 0, "not a url").otherwise("linkedin.com/in/x"), github=null, portfolio=text(" https://me.dev/x "), address=F.when(s % 6 == 0, "me@x.y").otherwise("Porto"), name=F.when(s % 7 > 0, F.col("p_name")))
    period = F.when(s % 5 == 1, "3 mois").when(s % 5 == 2, "Summer").when(s % 5 == 3, "2020 - Present").when(s % 5 == 4, "2019")
    job = lambda company: st(company=company, position=F.when(s % 2 == 1, F.col("p_type")), period=period, technologies=F.when(s % 4 == 0, F.array(text("a, b"), text("c"))).otherwise(F.array(text("c ,"))))
    work = F.when(s % 3 == 0, F.array(job(F.col("p_brand")), job(F.concat(text(" "), F.upper("p_brand"))))).otherwise(F.array(job(F.col("p_brand"))))
    school = F.array(st(institution=F.when(s % 8 > 0, "U"), degree=text("BSc"), field=null, start_date=text("Sept 2020"), end_date=F.when(s % 5 == 0, "2018").when(s % 5 == 1, "later").otherwise("Present")))
    title = F.when(s % 9 == 0, "").otherwise("P")
    made = lambda github: st(title=title, github=github, demo=null, technologies=F.array().cast("array<string>"))
    built = F.array(made(F.when(s % 10 == 0, "x y").otherwise("github.com/a/b")), made(null), made(null))
    r = p.select(F.col("p_partkey").alias("id"), D.resume_report(contact, work, school, built).alias("r"))
    shown = F.transform("r.issues", lambda x: F.concat_ws("|", x["severity"], x["field"], x["message"]))
    return r.select("id", shown.alias("issues"), "r.experience", "r.education", "r.projects")


@query(
    """WITH u AS (SELECT c_custkey AS user_id, (SELECT max(o_orderdate) FROM orders WHERE o_custkey = c_custkey) AS seen, c_acctbal > 0 AS live FROM customer), n AS (SELECT max(o_orderdate) AS now FROM orders)
    SELECT count(*) FILTER (WHERE seen >= now - INTERVAL 1 DAY) AS active_day, count(*) FILTER (WHERE seen >= now - INTERVAL 7 DAY) AS active_week, count(*) FILTER (WHERE seen >= now - INTERVAL 30 DAY) AS active_month, count(*) FILTER (WHERE seen >= now - INTERVAL 365 DAY) AS active_year,
    count(*) AS total_users, count(*) FILTER (WHERE live) AS active_users, 'last_active_at' AS activity_source FROM u, n"""
)
def usage_without_events(spark, sf):
    """An empty event log: users are active by the time of their last order."""
    o = R.read(spark, sf, "orders")
    last = o.groupBy(F.col("o_custkey").alias("user_id")).agg(F.max("o_orderdate").alias("last_active_at"))
    users = R.read(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("is_active")).join(last, "user_id", "left")
    return A.active_users_or_last_seen(R.usage_events(spark, sf).where("false"), users, R.latest(o, "o_orderdate"))


@query("SELECT c_custkey AS conv_id, c_name AS name, (SELECT count(*) FROM conversations WHERE conv_id = c_custkey) AS messages FROM customer")
def conversation_list(spark, sf):
    """Conversations (named by customers) with the number of their messages, none counting as 0."""
    n = R.messages(spark, sf).groupBy("conv_id").agg(F.count("*").alias("messages"))
    c = R.read(spark, sf, "customer").select(F.col("c_custkey").alias("conv_id"), F.col("c_name").alias("name"))
    return c.join(n, "conv_id", "left").withColumn("messages", F.coalesce("messages", F.lit(0)))


@query(
    """WITH e AS (SELECT ' ' || p_name || '-' || p_size || ' ' AS token, 0 AS later, p_partkey AS seq FROM part WHERE p_size % 2 = 0 UNION ALL SELECT upper(p_name) || '-' || p_size, 1, p_partkey FROM part), c AS (SELECT trim(token) AS token, later, seq FROM e), f AS (SELECT * FROM c WHERE token <> '' AND NOT contains(token, 'o') AND lower(token) NOT IN (SELECT lower(p_name) || '-' || p_size FROM part WHERE p_size % 5 = 0)),
    o AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY lower(token) ORDER BY later, seq) = 1) SELECT token, row_number() OVER (ORDER BY later, seq, token) AS place FROM o QUALIFY place <= 60"""
)
def board_token_list(spark, sf):
    """Tokens of a file and of a table, without the removed and the invalid ones (with an o): the first sixty."""
    p = R.read(spark, sf, "part")
    t = lambda x: F.concat(x, F.lit("-"), F.col("p_size").cast("string"))
    base = p.where("p_size % 2 = 0").select(F.concat(F.lit(" "), t(F.col("p_name")), F.lit(" ")).alias("token"), F.col("p_partkey").alias("seq"))
    added = p.select(t(F.upper("p_name")).alias("token"), F.col("p_partkey").alias("seq"))
    return J.resolved_tokens(base, added, p.where("p_size % 5 = 0").select(t(F.col("p_name")).alias("token")), lambda x: ~F.contains(x, F.lit("o")))
