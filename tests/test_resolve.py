import random
import re

import pytest

from lodestone.operators.resolve import resolve

SCHEMA = "seq long, source string, source_job_id string, source_url string, title string, company string, city string, remote_type string, job_type string, level string"


def offer(seq, source="a", jid="", url="", title="Harbour Pilot", company="Kestrel Works", city="Porto", remote=None, kind="job", level=None):
    return (seq, source, jid, url, title, company, city, remote, kind, level)


CASES = [
    ("same source and id", [offer(1, jid="x", title="A"), offer(2, jid="x", title="B", company="C")], 1),
    ("trailing slash", [offer(1, url="https://a.com/x/", title="A"), offer(2, source="b", url="https://a.com/x", title="B")], 1),
    ("same name and place", [offer(1), offer(2, source="b")], 1),
    ("other title", [offer(1), offer(2, source="b", title="Harbour Master")], 2),
    ("other city", [offer(1), offer(2, source="b", city="Braga")], 2),
    ("both remote", [offer(1, city=None, remote="remote"), offer(2, source="b", city=None, remote="remote")], 1),
    ("tracking only", [offer(1, url="https://a.com/x?utm_source=q", title="A"), offer(2, url="https://a.com/x", title="B")], 1),
    ("functional parameter", [offer(1, url="https://a.com/x?id=1", title="Abc"), offer(2, url="https://a.com/x?id=2", title="Xyz")], 2),
    ("job and internship", [offer(1), offer(2, kind="internship")], 2),
    ("junior and senior", [offer(1, level="junior"), offer(2, level="senior")], 2),
    ("url beats level", [offer(1, url="https://a.com/x", level="junior"), offer(2, url="https://a.com/x", level="senior")], 1),
]


@pytest.mark.parametrize("name, rows, groups", CASES, ids=[c[0] for c in CASES])
def test_cases(spark, name, rows, groups):
    assert resolve(spark.createDataFrame(rows, SCHEMA)).select("group_seq").distinct().count() == groups


def test_bridge_and_order(spark):
    rows = [offer(1, jid="1", title="Alpha"), offer(2, source="b", url="https://b.com/1", title="Beta"), offer(3, jid="1", url="https://b.com/1", title="Gamma")]
    want = {(1, 1), (2, 2), (3, 1)}
    for _ in range(2):
        random.shuffle(rows)
        assert {tuple(r) for r in resolve(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()} == want


def test_long_chain(spark):
    """60 offers linked in turn by id, URL and company: all in one block, so every shared id and URL merges."""
    n = 60
    rows = [offer(i, jid=f"j{i // 3}" if i % 3 != 2 else "", url=f"https://a.com/{i // 3}" if i % 3 else "", title=f"Title {i * 7919}", company=f"Firm {(i + 1) // 3}", city=f"City {i}") for i in range(n)]
    got = {r.seq: r.group_seq for r in resolve(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: i // 3 * 3 for i in range(n)}
    from lodestone.operators.resolve import block_labels

    assert block_labels(spark.createDataFrame(rows, SCHEMA)).select("block").distinct().count() == 1


def test_registered_offers_link(spark):
    """The registered offers meet over ids, URLs and companies, and blocks cross companies."""
    from conftest import SMALL
    from lodestone.operators.resolve import block_labels
    from lodestone.plans.queries import _offers_for_resolution
    from pyspark.sql import functions as F

    o = _offers_for_resolution(spark, SMALL)
    assert o.select("seq").distinct().count() == o.count()
    for key in (["source", "source_job_id"], ["company", "city"]):
        assert o.where(F.col(key[-1]) != "").groupBy(*key).count().where("count > 1").count() > 0
    assert block_labels(o).join(o, "seq").groupBy("block").agg(F.count_distinct("company").alias("n")).where("n > 1").count() > 0
    groups = resolve(o).join(o, "seq").groupBy("group_seq").agg(F.count_distinct("source").alias("s"), F.count_distinct("company").alias("c"))
    assert groups.where("s > 1").count() > 0 and groups.where("c > 1").count() > 0


def test_distinct_records_with_links(spark):
    """Random offers with repeats, blanks and shared keys beside the rules over all rows."""
    from lodestone.operators import resolve as E

    rng = random.Random(11)
    pick = rng.choice
    rows = [
        offer(i, pick("ab"), pick(["", "", f"{pick(range(25))}", f"u{i}"]), pick(["", "", f"https://a.com/{pick(range(25))}", f"https://b.com/{i}"]), pick(["Harbour Pilot", "Harbour Pilots", "Harbour Master", "Cook"]), pick(["", "Kestrel Works", "Acme", "Initech"]), pick([None, "Porto", "Braga"]), pick([None, None, "remote"]), pick(["job", "job", "internship"]), pick([None, "junior", "senior"]))
        for i in range(600)
    ]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = set(E._rules([r.asDict() for r in E._keyed(df).collect()]))
    got = {tuple(r) for r in resolve(df).collect()}
    assert got == want and len({g for _, g in want}) < 300


def test_hot_company_is_few_records(spark):
    """3,000 postings of a company under ids of their own are as many records as differ in title and place."""
    from lodestone.operators import resolve as E

    rows = [offer(i, jid=f"j{i}", url=f"https://a.com/{i}", title=f"Title {'xyz'[i % 3] * 9}", city=f"City {i % 4}") for i in range(3000)]
    records, reps = E.blocked_records(spark.createDataFrame(rows, SCHEMA))
    assert records.count() == 12 and reps.count() == 3000


FULL = SCHEMA + ", country string, location string, priority int"


def one_by_one(rows):
    """The rules of resolution and merging, a row at a time over plain records: (groups of seq, merged records)."""
    from difflib import SequenceMatcher

    slug = lambda x: re.sub("[^a-z0-9]+", "-", (x or "").lower()).strip("-")
    place = lambda r: "@remote" if r["remote_type"] == "remote" else slug(r["city"] or r["country"] or r["location"])
    record = lambda r: (slug(r["company"]), slug(r["title"]), place(r))
    links = lambda r: [("id", r["source"], r["source_job_id"])] * bool(r["source_job_id"]) + [("url", r["source_url"].rstrip("/"))] * bool(r["source_url"])
    groups = []  # [merged record, members, all (company, title, city) ever held]
    owner = {}

    def fits(g, r):
        kinds, levels = {g["job_type"], r["job_type"]}, {g["level"], r["level"]} - {None, ""}
        return len(kinds) == 1 and len(levels) < 2

    for r in sorted(rows, key=lambda r: r["seq"]):
        at = next((owner[k] for k in links(r) if k in owner), None)
        # groups in the order in which they came to hold the name, then the place
        if at is None:
            at = next((g for _, g in sorted((e[2][record(r)], g) for g, e in enumerate(groups) if record(r) in e[2]) if fits(groups[g][0], r)), None)
        if at is None and record(r)[0]:
            near = sorted((e[3][record(r)[0], place(r)], g) for g, e in enumerate(groups) if (record(r)[0], place(r)) in e[3])
            at = next((g for _, g in near if fits(groups[g][0], r) and SequenceMatcher(None, slug(groups[g][0]["title"]), slug(r["title"])).ratio() >= 0.9), None)
        if at is None:
            at = len(groups)
            groups.append([dict(r), [], {}, {}])
        else:
            lead, rest = groups[at][0], r
            if rest["priority"] > lead["priority"]:
                lead, rest = rest, lead
            lead = dict(lead)
            for f in ("company", "location", "city", "country", "level", "remote_type"):
                if lead[f] in (None, ""):
                    lead[f] = rest[f]
            groups[at][0] = lead
        groups[at][1].append(r["seq"])
        for x in (r, groups[at][0]):
            for k in links(x):
                owner[k] = at
            groups[at][2].setdefault(record(x), r["seq"])
            groups[at][3].setdefault((record(x)[0], place(x)), r["seq"])
    return {(s, e[1][0]) for e in groups for s in e[1]}, {e[1][0]: e[0] for e in groups}


def batches(seed, n, size, linked):
    """Random batches that have no key in common; linked ones share identifiers and URLs and repeat no record."""
    rng = random.Random(seed)
    pick, rows = rng.choice, []
    for b in range(n):
        for i in range(size):
            jid = pick(["", f"b{b}-{rng.randrange(4)}"]) if linked else pick(["", f"b{b}-u{i}"])
            url = pick(["", f"https://a.com/{b}/{rng.randrange(4)}", f"https://a.com/{b}/{rng.randrange(4)}/"]) if linked else pick(["", f"https://b.com/{b}/{i}"])
            title = f"b{b} " + pick(["Harbour Pilot", "Harbour Pilots", "Harbour Master", "Ship Cook", "Ships Cook"])
            company = pick([None, f"B{b} Kestrel", f"B{b} Kestrel", f"B{b} Acme"])
            city = pick(["Porto", "Braga"]) if linked else pick([None, "Porto", "Braga"])
            country = f"C{i}" if linked else pick([None, "", "PT"])
            rows.append(dict(zip([f.split()[0] for f in FULL.split(", ")], (len(rows), pick("ab"), jid, url, title, company, city, pick([None, None, "remote", "hybrid"]), pick(["job", "job", "internship"]), pick([None, "junior", "senior"]), country, pick([None, "Lisbon"]), pick([40, 55, 90])), strict=True)))
    return rows


@pytest.mark.parametrize("linked", [False, True])
def test_random_batches_one_by_one(spark, linked):
    """400 batches of 14 rows at once, beside the rules applied to one row after another."""
    rows = batches(5 + linked, 400, 14, linked)
    want = set().union(*(one_by_one(rows[i : i + 14])[0] for i in range(0, len(rows), 14)))  # batches have no key in common
    df = spark.createDataFrame([tuple(r.values()) for r in rows], FULL).repartition(4)
    assert {tuple(r) for r in resolve(df).collect()} == want


def test_merged_as_one_by_one(spark):
    """Leaders and filled fields of merged groups, beside merging a row at a time."""
    from lodestone.operators.resolve import merge_groups

    rows = batches(9, 60, 14, True)
    groups, merged = one_by_one(rows)
    df = spark.createDataFrame([(*r.values(), None, None) for r in rows], FULL + ", description string, posted_at timestamp")
    got = {r.group_seq: r for r in merge_groups(df, spark.createDataFrame(sorted(groups), "seq long, group_seq long")).collect()}
    assert got.keys() == merged.keys()
    for k, m in merged.items():
        assert [getattr(got[k], f) or None for f in ("title", "company", "city", "country", "location", "remote_type")] == [m[f] or None for f in ("title", "company", "city", "country", "location", "remote_type")]


def test_similar_titles_are_all_found(spark):
    """Every pair of titles with the wanted ratio, of lengths 1 to 40, comes out of the prefix join; pairs of other companies or places don't."""
    from difflib import SequenceMatcher

    from lodestone.operators.resolve import similar_pairs, title_tokens

    rng = random.Random(12)
    titles = {""}
    for _ in range(130):
        t = [rng.choice("aab-c1") for _ in range(rng.randint(1, 40))]
        titles.add("".join(t))
        for _ in range(3):
            u = list(t)
            for _ in range(rng.randint(1, 4)):
                k = rng.randrange(len(u) + 1)
                if rng.random() < 0.5 and u:
                    u.pop(min(k, len(u) - 1))
                else:
                    u.insert(k, rng.choice("aab-c1"))
            titles.add("".join(u))
    titles = sorted(titles)
    rows = [("co", "here", t, i) for i, t in enumerate(titles)] + [("co", "there", t, 10_000 + i) for i, t in enumerate(titles[:50])]
    entries = spark.createDataFrame(rows, "company string, place string, title string, node long")
    got = {frozenset(r) for r in similar_pairs(entries, entries, title_tokens(entries.select("title").distinct()), once=True).collect()}
    want = {frozenset((i, j)) for i, a in enumerate(titles) for j, b in enumerate(titles) if i < j and max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.9}
    assert want <= {p for p in got if max(p) < 10_000} and len(want) > 100
    assert all((min(p) < 10_000) == (max(p) < 10_000) for p in got)


def test_all_places_of_a_node_are_combined(spark):
    """Of rows with one name, only the places of one row were taken, whichever came first."""
    from lodestone.operators.resolve import _entries

    rows = [(1, 1, "c", "@remote", "t", ["porto"]), (2, 1, "c", "@remote", "t", ["braga"]), (3, 1, "c", "faro", "t", ["faro"]), (4, 4, "d", "porto", "t", ["porto"])]
    got = {tuple(r) for r in _entries(spark.createDataFrame(rows, "seq long, node long, company string, place string, title string, places array<string>")).collect()}
    assert got == {(1, "c", p, "t", False) for p in ("@remote", "porto", "braga", "faro")} | {(4, "d", "porto", "t", False)}


def test_offers_are_dealt(spark):
    """Offers of one small file were made and keyed in one task."""
    from conftest import SMALL
    from lodestone.plans.queries import _offers_for_resolution

    assert "REPARTITION_BY_NUM" in _offers_for_resolution(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
