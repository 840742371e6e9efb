"""Entity resolution of offers: exact, order-dependent merging inside sparse connected blocks.

Two offers can only meet if they share an identifier or a URL, or if they have one company and place and
titles of a ratio of ``SIMILAR`` or more (equal titles, without a company).  Blocks are the components over these
links, so a company with very many different postings is as many blocks.  Titles that are that alike differ by at most
a tenth of their joint length in insertions and deletions; such pairs are found by equi-joins over the rarest
q-grams of either (a prefix filter), within a company and place, never by all pairs.  A component that shared
identifiers or URLs hold together may stand for any company, place and title in it at once, as its merged record can take each from
another row; it is given all these combinations, until no component gains one.

The sequential rules run inside a block, streamed in order of seq, and hold a block's groups only.
"Repeats" (rows that the rules treat alike) count once where a block has no shared identifier or URL: there they
always join the first one's group.  In other blocks every row is seen.

A group stands for its merged record: the row of the highest priority so far (the first of equals) gives title,
type, company, place and level, and what it lacks comes from the others.  Keys of both the row and the merged
record point to the group that got them last.
"""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..components import components
from ..functions.text import normalize_url, slug
from ..storage import materialise, parts_for, ship

SIMILAR = 0.90
#: Combinations of company, place and title of one linked component; a larger one is linked to all rows of its companies instead.
COMBINATIONS = 4096

RECORD = ["id_key", "url_key", "company_slug", "title_slug", "city", "country", "location", "remote_type", "job_type", "level", "priority"]
#: What a merged record takes from another row where it has nothing.
FILLED = ["company_slug", "city", "country", "location", "remote_type", "level"]


def _name(x):
    """A slug; a text without letters or digits is a dash, which isn't nothing but names nothing."""
    s = slug(x)
    return F.when(F.coalesce(x, F.lit("")) == "", "").when(s == "", "-").otherwise(s)


def _keyed(offers: DataFrame) -> DataFrame:
    """seq and ``RECORD``, all that the rules read; what is missing is empty, not null (priority: 0)."""
    null = F.lit(None).cast("string")
    col = lambda c: F.col(c) if c in offers.columns else null
    text = lambda c: F.coalesce(c, F.lit(""))
    return offers.select(
        F.col("seq").cast("bigint"),
        text(F.when(F.col("source_job_id") != "", F.concat(F.lit("id:"), F.lower("source"), F.lit(":"), F.lower("source_job_id")))).alias("id_key"),
        text(F.when(F.col("source_url") != "", F.concat(F.lit("url:"), normalize_url(F.col("source_url"))))).alias("url_key"),
        _name(F.col("company")).alias("company_slug"),
        slug(F.col("title")).alias("title_slug"),
        *[_name(col(c)).alias(c) for c in ("city", "country", "location")],
        text(col("remote_type")).alias("remote_type"),
        F.coalesce(col("job_type"), F.lit("job")).alias("job_type"),
        text(col("level")).alias("level"),
        F.coalesce(col("priority").cast("int"), F.lit(0)).alias("priority"),
    )


def _named(x: str) -> Column:
    return F.regexp_replace(x, "^-$", "")


def _place() -> Column:
    first = F.coalesce(F.nullif("city", F.lit("")), F.nullif("country", F.lit("")), F.col("location"))
    return F.when(F.col("remote_type") == "remote", "@remote").otherwise(F.regexp_replace(first, "^-$", ""))


def _shared_keys(keyed: DataFrame) -> DataFrame:
    """(seq, first) of every row with an identifier or URL that another row has: the first row of each such key."""
    keys = keyed.select("seq", F.explode(F.array("id_key", "url_key")).alias("key")).where("key != ''")
    first = keys.groupBy("key").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    return keys.join(first, "key").select("seq", "first").distinct()


def _coarse_edges(rows: DataFrame) -> DataFrame:
    """Edges (a, b) of rows (seq, company, title) that name one company or, without one, one title."""
    coarse = F.when(F.col("company") != "", F.concat(F.lit("c:"), "company")).otherwise(F.concat(F.lit("t:"), "title"))
    first = rows.groupBy(coarse.alias("key")).agg(F.min("seq").alias("b"))
    return rows.select(F.col("seq").alias("a"), coarse.alias("key")).join(first, "key").where("a != b").select("a", "b")


def block_labels(offers: DataFrame) -> DataFrame:
    """(seq, block): the smallest seq connected over identifier, URL or coarse name (coarser than what ``resolve`` needs)."""
    keyed = _keyed(offers)
    named = keyed.select("seq", _named("company_slug").alias("company"), F.col("title_slug").alias("title"))
    edges = _shared_keys(keyed).select(F.col("seq").alias("a"), F.col("first").alias("b")).unionByName(_coarse_edges(named)).distinct()
    return components(edges, keyed.select(F.col("seq").alias("node"))).select(F.col("node").alias("seq"), F.col("comp").alias("block"))


def title_tokens(titles: DataFrame) -> DataFrame:
    """(title, token) for the distinct ``titles``: of the q-grams of each (the k-th of its kind apart), those that a similar title must share one of.

    An insertion or deletion breaks q grams at most, and similar titles of n characters differ by 2n/11 deletions (or less,
    with insertions), so but for 2qn/11 all grams of a title are in a similar one: the rarest 2qn/11 + 1 of each have one
    in common.  Trigrams serve titles from seven characters on, bigrams those up to seven; under five only equal titles are similar.
    """
    n = F.length("title")

    def grams(q: int, when: Column) -> DataFrame:
        at = F.transform(F.sequence(F.lit(1), n - q + 1), lambda i: F.substring(F.col("title"), i, F.lit(q)))
        return titles.where(when).select("title", F.lit(q).alias("q"), F.explode(at).alias("gram"))

    each = grams(3, n >= 7).unionByName(grams(2, n.between(4, 7))).groupBy("title", "q", "gram").agg(F.count("*").alias("k"))
    often = each.groupBy("gram").agg(F.count("*").alias("often"))  # 37 cubed rows and 37 squared at most: slugs have 37 characters
    ranked = each.join(F.broadcast(often), "gram").groupBy("title", "q").agg(F.array_sort(F.collect_list(F.struct("often", "gram", "k"))).alias("g"))
    repeated = F.flatten(F.transform("g", lambda g: F.transform(F.sequence(F.lit(1), g["k"].cast("int")), lambda i: F.concat(g["gram"], F.lit("#"), i.cast("string")))))
    return ranked.select("title", F.explode(F.slice(repeated, F.lit(1), F.floor(2 * F.col("q") * n / 11).cast("int") + 1)).alias("token"))


def similar_pairs(left: DataFrame, right: DataFrame, tokens: DataFrame, once: bool = False) -> DataFrame:
    """(a, b) of the nodes of two tables (company, place, title, node) with one company and place whose titles may have the wanted ratio; ``once``: both are one table."""
    other = right.join(tokens, "title").select("company", "place", "token", F.col("title").alias("t"), F.col("node").alias("b"))
    a, b = F.length("title"), F.length("t")
    near = left.join(tokens, "title").join(other, ["company", "place", "token"]).where((F.col("title") < F.col("t")) if once else (F.col("title") != F.col("t")))
    return near.where((F.col("node") != F.col("b")) & (10 * F.abs(a - b) <= a + b)).where(10 * F.levenshtein("title", "t") <= a + b).select(F.col("node").alias("a"), "b").distinct()


NAME = ["company", "place", "title"]


def _entries(rows: DataFrame) -> DataFrame:
    """Of rows (seq, node, company, place, title, places): distinct (node, company, place, title, wide), all combinations where a node's rows differ; a wide row stands for too many."""
    each = rows.select("node", *NAME, "places").distinct()
    plain = each.select("node", *NAME).distinct()
    several = plain.select("node", "company", "place").distinct().groupBy("node").count().where("count > 1").select("node")  # few: lists are made of these only
    sets = each.join(several, "node", "left_semi").groupBy("node").agg(F.collect_set("company").alias("cs"), F.array_distinct(F.flatten(F.collect_set(F.array_append("places", F.col("place"))))).alias("ps"), F.collect_set("title").alias("ts"))
    few = F.size("cs").cast("long") * F.size("ps") * F.size("ts") <= COMBINATIONS
    grown = sets.where(few).select("node", F.explode("cs").alias("company"), "ps", "ts").select("node", "company", F.explode("ps").alias("place"), "ts").select("node", "company", "place", F.explode("ts").alias("title"))
    wide = sets.where(~few).select("node", *(F.lit("").alias(c) for c in NAME))
    return plain.unionByName(grown).distinct().withColumn("wide", F.lit(False)).unionByName(wide.withColumn("wide", F.lit(True)))


def _blocks(keyed: DataFrame, links: DataFrame, size: int) -> DataFrame:
    """(seq, block) over shared identifiers and URLs and over similar names; see the module."""
    parts = parts_for(size, 50_000)
    places = F.array_except(F.transform(F.array("city", "country", "location"), lambda p: F.regexp_replace(p, "^-$", "")), F.array(F.lit("")))
    fields = keyed.select("seq", _named("company_slug").alias("company"), _place().alias("place"), F.col("title_slug").alias("title"), places.alias("places"))
    tokens = materialise(title_tokens(fields.select("title").distinct()), "offer-tokens", parts)
    linked = components(links.select(F.col("seq").alias("a"), F.col("first").alias("b")), size=size)
    rows = fields.join(linked.withColumnRenamed("node", "seq"), "seq", "left").select("*", F.coalesce("comp", "seq").alias("node")).drop("comp")
    rows = materialise(rows, "offer-blocks", parts)
    entries = fresh = materialise(_entries(rows), "offer-entries", parts)
    first = True
    while True:
        plain = entries.where("NOT wide")
        if first:
            named = new = plain.groupBy(*NAME).agg(F.min("node").alias("node"))
        else:  # a later turn reads the companies of its new entries only
            new = fresh.where("NOT wide").select(*NAME, "node")
            named = plain.join(new.select("company").distinct(), "company", "left_semi").groupBy(*NAME).agg(F.min("node").alias("node"))
        edges = (plain if first else new).select(*NAME, F.col("node").alias("a")).join(named.withColumnRenamed("node", "b"), NAME).select("a", "b")
        edges = edges.where("a != b").unionByName(similar_pairs(new.where("company != ''"), named, tokens, first))
        if not fresh.where("wide").isEmpty():
            far = rows.join(fresh.where("wide").select("node"), "node").select("company", "title").distinct()
            met = rows.join(far, ["company", "title"], "left_semi").unionByName(rows.where("company != ''").join(far.select("company").distinct(), "company", "left_semi"))
            edges = edges.unionByName(_coarse_edges(met.select(F.col("node").alias("seq"), "company", "title").distinct()))
        comp, first = components(edges.distinct(), size=size), False
        moved = lambda t, how: t.join(comp, "node", how).select(*(c for c in t.columns if c != "node"), F.coalesce("comp", "node").alias("node"))  # noqa: E731, B023
        rows = materialise(moved(rows, "left"), "offer-blocks", parts)
        # only nodes that were joined stand for more than before
        joined = materialise(_entries(rows.join(comp.select(F.col("comp").alias("node")).distinct(), "node", "left_semi")), "offer-entries", parts)
        fresh = materialise(joined.join(moved(entries, "inner"), ["node", *NAME, "wide"], "left_anti"), "offer-entries", parts)  # the others are known under another node
        if fresh.isEmpty():
            return rows.select("seq", F.col("node").alias("block"))
        entries = materialise(entries.join(comp.select("node"), "node", "left_anti").unionByName(joined), "offer-entries", parts)


def _similar(a: str, b: str) -> bool:
    """The ratio of difflib, after its upper bounds."""
    if 2 * min(len(a), len(b)) < SIMILAR * (len(a) + len(b)):
        return False
    m = difflib.SequenceMatcher(None, a, b)
    return m.quick_ratio() >= SIMILAR and m.ratio() >= SIMILAR


def _city(r: dict) -> str:
    return "@remote" if r["remote_type"] == "remote" else (r["city"] or r["country"] or r["location"]).strip("-")


def _compatible(a: dict, b: dict) -> bool:
    if {a["job_type"], b["job_type"]} == {"job", "internship"}:
        return False
    return not (a["level"] and b["level"] and a["level"] != b["level"])


def _absorb(lead: dict, other: dict) -> dict:
    """The merged record: the one of higher priority leads, the other fills what it lacks."""
    if other["priority"] > lead["priority"]:
        lead, other = other, lead
    return lead | {f: lead[f] or other[f] for f in FILLED}


class _Block:
    """Greedy grouping of one block in arrival order: strong keys first, then equal name and place, then similar titles."""

    def __init__(self):
        self.groups: list[dict] = []
        self.first: list[int] = []
        self.strong: dict[str, int] = {}
        self.named: dict[tuple, dict[int, None]] = {}
        self.placed: dict[tuple, dict[int, None]] = {}

    def add(self, r: dict) -> int:
        """The first seq of the group that the row joins."""
        groups = self.groups
        company, title = r["company_slug"].strip("-"), r["title_slug"]
        hit = next((self.strong[k] for k in (r["id_key"], r["url_key"]) if k in self.strong), None)
        if hit is None:
            hit = next((g for g in self.named.get((company, title, _city(r)), ()) if _compatible(groups[g], r)), None)
        if hit is None and company:
            hit = next((g for g in self.placed.get((company, _city(r)), ()) if _compatible(groups[g], r) and _similar(groups[g]["title_slug"], title)), None)
        if hit is None:
            hit = len(groups)
            groups.append(r)
            self.first.append(r["seq"])
        else:
            groups[hit] = _absorb(groups[hit], r)
        for x in (r, groups[hit]):
            name = x["company_slug"].strip("-")
            for k in (x["id_key"], x["url_key"]):
                if k:
                    self.strong[k] = hit
            self.named.setdefault((name, x["title_slug"], _city(x)), {})[hit] = None
            if name:
                self.placed.setdefault((name, _city(x)), {})[hit] = None
        return self.first[hit]


def _rules(rows: list[dict]) -> list[tuple[int, int]]:
    """(seq, group_seq) of rows taken as one block."""
    block = _Block()
    return [(r["seq"], block.add(r)) for r in sorted(rows, key=lambda r: r["seq"])]


def _grouped(batches):
    """Rows that come by block, then seq."""
    at, block = None, _Block()
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["block"] != at:
                at, block = r["block"], _Block()
            out.append(block.add(r))
        yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(out, pa.int64())], ["rep", "group_seq"])


def blocked_records(offers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that the rules must see (block, seq and ``RECORD``), and (seq, rep) of all rows: rep is the record that stands for the row."""
    keyed = materialise(_keyed(offers), "offer-rows")
    size = keyed.count()
    links = materialise(_shared_keys(keyed), "offer-links", parts_for(size))
    blocks = _blocks(keyed, links, size)
    bound = links.select("seq").distinct().join(blocks, "seq").select("block").distinct().withColumn("linked", F.lit(True))
    rows = keyed.join(blocks, "seq").join(bound, "block", "left")
    alone = F.when(F.col("linked"), F.col("seq")).otherwise(-1).alias("own")  # a row of a linked block is a record of its own
    key = lambda c: F.when(F.col("linked"), F.col(c)).otherwise("").alias(c)  # noqa: E731  elsewhere no other row has them
    rows = materialise(rows.select("seq", "block", alone, key("id_key"), key("url_key"), *RECORD[2:]), "offer-records")
    same = ["block", "own", *RECORD]
    records = rows.groupBy(*same).agg(F.min("seq").alias("rep"))
    return records.withColumnRenamed("rep", "seq").drop("own"), rows.join(records, same).select("seq", "rep")


def resolve(offers: DataFrame) -> DataFrame:
    """(seq, group_seq) for offers with seq, source, source_job_id, source_url, title, company and, if there, city, country, location, remote_type, job_type, level, priority."""
    ship(offers.sparkSession)
    records, reps = blocked_records(offers)
    grouped = records.repartition("block").sortWithinPartitions("block", "seq").mapInArrow(_grouped, "rep bigint, group_seq bigint")
    return reps.join(grouped, "rep").select("seq", "group_seq")


#: What the leading row of a group takes from the others where it has nothing.
MERGED = ["company", "company_url", "location", "city", "country", "salary_min", "salary_max", "salary_currency", "salary_period", "experience_level", "remote_type", "employment_type", "internship_duration_months", "internship_start_date"]


def merge_groups(offers: DataFrame, groups: DataFrame, skills_cap: int = 25) -> DataFrame:
    """One record per group of (seq, group_seq), merged as if its rows came one by one in order of seq.

    The row of highest priority (ties: the first) leads; rows that led before come next, the latest first, then the
    others.  Each of ``MERGED`` that ``offers`` has is the first that isn't null or empty in that order, the description
    the first of the longest, ``skills`` the first ``skills_cap`` different ones; other URLs and sources are united, the
    earliest posting and the latest expiry stay.  Only aggregates: no group is collected.  Rows without a group go.
    """
    j = offers.join(groups, "seq").withColumn("priority", F.coalesce("priority", F.lit(0)))
    starts = j.groupBy("group_seq", "priority").agg(F.min("seq").alias("seq"))  # a row per priority, of which there are few
    before = F.max("priority").over(Window.partitionBy("group_seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    leads = starts.withColumn("__b", before).where("__b IS NULL OR priority > __b").select("seq", F.negative("priority").alias("__l"))
    order = F.struct(F.col("__l").isNull().alias("later"), F.coalesce("__l", F.lit(0)).alias("lead"), F.col("seq").alias("seq"))
    j = j.join(leads, "seq", "left").withColumn("__o", order).withColumn("__u", F.coalesce(normalize_url(F.col("source_url")), F.lit("")))
    given = lambda c: F.col(c).isNotNull() & (F.col(c).cast("string") != "")
    fields = [F.min_by(F.when(given(c), F.col(c)), F.when(given(c), F.col("__o"))).alias(c) for c in MERGED if c in offers.columns]
    lead = lambda c, name: F.min_by(F.col(c), F.col("__o")).alias(name)
    longest = F.when(given("description"), F.struct((-F.length("description")).alias("n"), F.col("__o").alias("o")))
    dates = [f(c).alias(c) for f, c in ((F.min, "posted_at"), (F.max, "expires_at")) if c in offers.columns]
    out = j.groupBy("group_seq").agg(
        lead("seq", "lead_seq"), lead("source", "source"), lead("source_url", "source_url"), lead("title", "title"), lead("__u", "__u"), *fields, F.min_by("description", longest).alias("description"), *dates,
        F.collect_set("__u").alias("__us"), F.sort_array(F.collect_set("source")).alias("merged_sources"), F.count("*").alias("n"),
    )
    out = out.withColumn("also_seen_on", F.array_sort(F.array_except("__us", F.array("__u", F.lit(""))))).drop("__us", "__u")
    if "skills" not in offers.columns:
        return out
    each = j.select("group_seq", "__o", F.posexplode("skills").alias("__p", "skill")).where("skill IS NOT NULL").groupBy("group_seq", "skill").agg(F.min(F.struct("__o", "__p")).alias("o"))
    kept = each.withColumn("k", F.row_number().over(Window.partitionBy("group_seq").orderBy("o"))).where(F.col("k") <= skills_cap)
    lists = kept.groupBy("group_seq").agg(F.array_sort(F.collect_list(F.struct("k", "skill"))).alias("s")).select("group_seq", F.transform("s", lambda x: x["skill"]).alias("skills"))
    return out.join(lists, "group_seq", "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<string>")))
