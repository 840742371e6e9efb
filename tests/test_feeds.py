"""Paged sources, sinks, expiring tables, anchors, trees, digests and links, beside plain versions."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.sources import paged


def sequential(pages, size, limit, most):
    """One page after another, as a client would: items, and the last page that it opens."""
    got, seen, items, last = [], set(), 0, -1
    for k in range(most if most is not None else len(pages) + 1):
        if k not in pages:
            break
        total, rows = pages[k]
        last = k
        items += len(rows)
        fresh = [r for r in rows if r["id"] is None or r["id"] not in seen]
        new = {r["id"] for r in fresh if r["id"] is not None}
        for r in fresh:
            if r["id"] is None or r["id"] not in seen:
                got.append((k, r["id"], r["t"]))
                seen.add(r["id"]) if r["id"] is not None else None
        if len(rows) < size or not new or (total is not None and items >= total) or (limit is not None and len(seen) >= limit):
            break
    return got if limit is None else got[:limit], last


@pytest.mark.parametrize("limit, most", [(None, None), (7, None), (None, 2)])
def test_pages_as_a_client_reads_them(spark, tmp_path, limit, most):
    rng = random.Random(3)
    sources = {}
    for s in range(12):
        pages = {}
        for k in range(rng.randint(0, 5)):
            rows = [{"id": None if rng.random() < 0.05 else str(rng.randrange(30) if rng.random() < 0.3 else 1000 + 4 * k + j), "t": f"{s}-{k}-{j}"} for j in range(4 if rng.random() < 0.85 else rng.randint(1, 3))]
            pages[k] = (rng.choice([None, None, 8, 100]), rows)
        if s == 3 and len(pages) > 2:
            del pages[1]
        sources[f"s{s}"] = pages
    folder = f"file://{tmp_path}"
    facts = []
    for s, pages in sources.items():
        _, stop = sequential(pages, 4, limit, most)
        for k, (total, rows) in pages.items():
            d = tmp_path / "pages" / f"source={s}" / f"page={k}"
            d.mkdir(parents=True)
            # a page behind the stop would fail if it were opened
            (d / "part-0.txt").write_text(json.dumps({"total": total, "items": rows}) if k <= stop else "{broken")
            facts.append((s, k, len(rows), total, [r["id"] for r in rows]))
    spark.createDataFrame(facts, paged.FACTS).write.parquet(f"{folder}/facts")
    got = paged.read_pages(spark, folder, 4, limit, most).collect()
    mine = {}
    for r in got:
        item = json.loads(r.item)
        mine.setdefault(r.source, []).append((r.page, r.place, item["id"], item["t"]))
    for s, pages in sources.items():
        assert [(k, i, t) for k, _, i, t in sorted(mine.get(s, []), key=lambda x: x[:2])] == sequential(pages, 4, limit, most)[0], s


def test_stray_page_is_not_opened(spark, tmp_path):
    items = [("a", i, json.dumps({"id": i}), 8) for i in range(12)]
    folder = f"file://{tmp_path}/x"
    paged.land(spark.createDataFrame(items, "source string, position int, item string, total long"), folder, 4)
    for f in (tmp_path / "x/pages/source=a/page=2").glob("part-*"):
        f.write_text("{broken")
    assert paged.read_pages(spark, folder, 4).count() == 8
    with pytest.raises(Exception, match="JSON|Expecting|Error"):
        spark.read.format("lodestone_pages").option("last", json.dumps({"a": 2})).load(folder).collect()


def chain(places, gap, strict):
    out = []
    for p in sorted(set(places)):
        if not out or (p > out[-1] + gap if strict else p >= out[-1] + gap):
            out.append(p)
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_anchors_row_by_row(spark, strict):
    from lodestone.operators.anchors import anchor_rows, anchors

    rng = random.Random(5)
    rows = [(rng.choice("aaaaab"), float(rng.randrange(0, 4000)) / 4) for _ in range(900)] + [("c", 1.0), ("c", 1.0), ("d", None), (None, 3.0), ("e", 0.0), ("e", 3.0), ("e", 6.5), ("e", 900.0), ("e", -7.0)]
    df = spark.createDataFrame(rows, "k string, y double")
    want = {k: chain([y for kk, y in rows if kk == k and y is not None], 3.0, strict) for k in "abcde"}
    got = {}
    for r in anchors(df, ["k"], "y", 3.0, strict).collect():
        got.setdefault(r.k, []).append(r.y)
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}
    numbered = anchor_rows(df, ["k"], "y", 3.0, strict).collect()
    assert len(numbered) == len(rows)
    for r in numbered:
        assert r.row_no == (None if r.k is None or r.y is None else sum(a <= r.y for a in want[r.k]) - 1)
    assert anchors(df.limit(0), ["k"], "y", 3.0).count() == 0


def test_last_seen_keeps_the_written_anchor(spark):
    from lodestone.operators.anchors import throttled_last_seen

    at = lambda m: dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)
    rows = [(1, at(m)) for m in (0, 5, 9, 12, 14, 30, 40)] + [(2, at(3)), (None, at(1)), (3, None)]
    got = sorted(tuple(r) for r in throttled_last_seen(spark.createDataFrame(rows, "user_id long, ts timestamp")).collect())
    assert got == [(1, at(0)), (1, at(12)), (1, at(30)), (1, at(40)), (2, at(3))]


def test_canonical_digests(spark):
    from lodestone.functions.canonical import canonical_json, digest

    pairs = [('{"b": [1, 2.50, null], "a": {"y": "é\\n", "x": true}}', '{ "a":{"x":true,"y":"\\u00e9\\n"},"b":[1,2.5,null] }'), ("[]", " [ ] "), ('"x"', '"x"'), ('{"a":1,"a":2}', '{"a":2}')]
    for a, b in pairs:
        r = spark.createDataFrame([(a, b)], "a string, b string").select(canonical_json(F.col("a")).alias("c"), (digest(F.col("a")) == digest(F.col("b"))).alias("same")).first()
        assert r.same and r.c == json.dumps(json.loads(a), sort_keys=True, separators=(",", ":"))
    v = spark.createDataFrame([(pairs[0][1],)], "a string").select(canonical_json(F.to_json(F.parse_json("a"))).alias("v")).first().v
    assert json.loads(v) == json.loads(pairs[0][0])
    bad = spark.createDataFrame([(None,), ("{broken",), ("",)], "a string").select(digest(F.col("a")).alias("d"))
    assert [r.d for r in bad.collect()] == [None] * 3


def grounded(projects, urls):
    """URL by URL, as the rule is written."""
    import re
    import unicodedata

    from lodestone.operators.links import COMMON

    norm = lambda t: re.sub("[^a-z0-9]", "", "".join(c for c in unicodedata.normalize("NFKD", t or "") if not unicodedata.combining(c)).lower())
    out = [dict(p) for p in projects]
    for u in urls:
        repo = re.search(r"github\.com/[^/\s]+/[^/\s#?]+", u, re.I)
        if "github.com" in u.lower() and not repo:
            continue
        slot = "github" if repo else "demo"
        bare = re.sub(r"[?#].*$", "", re.sub("^https?://", "", u.lower()).strip("/"))
        words = {w for w in re.split(r"[/._\-]", bare) if len(w) >= 3} - set(COMMON)
        scores = [sum(w in norm(p["title"]) or norm(p["title"]) in w for w in words) if norm(p["title"]) else 0 for p in out]
        empty = [i for i, p in enumerate(out) if not p[slot]]
        at = scores.index(max(scores)) if scores and max(scores) else empty[0] if len(empty) == 1 else None
        if at is not None and not out[at][slot]:
            out[at][slot] = u
    return [(p["title"], p["github"] or None, p["demo"] or None) for p in out]


def test_project_links(spark):
    from lodestone.operators.links import ground_links, text_urls

    rng = random.Random(9)
    names = ["Harbour Map", "Weather", "Élan Vital", "Map", "", None, "Tide-Tables"]
    urls = [f"https://{h}" for h in ("github.com/me", "github.com/me/harbour-map", "github.com/me/weather.git", "weather.vercel.app", "tide.example.org/tables", "elan.dev", "me.dev/x?tide=map", "GitHub.com/you/Map#readme", "nothing.example.net/abc")]
    rows = []
    for i in range(200):
        ps = [{"title": rng.choice(names), "github": rng.choice([None, None, "", "https://github.com/own/one"]), "demo": rng.choice([None, None, "https://own.dev"])} for _ in range(rng.randint(0, 4))]
        rows.append((i, [tuple(p.values()) for p in ps], rng.sample(urls, rng.randint(0, 6)), ps))
    df = spark.createDataFrame([(i, p, u) for i, p, u, _ in rows], "id int, p array<struct<title: string, github: string, demo: string>>, u array<string>")
    got = {r.id: [(x.title, x.github or None, x.demo or None) for x in r.out] for r in df.select("id", ground_links(F.col("p"), F.col("u")).alias("out")).collect()}
    for i, _, u, ps in rows:
        assert got[i] == grounded(ps, u), (ps, u)
    one = spark.createDataFrame([("see github.com/a/b, HTTPS://GITHUB.com/a/b/ and www.x.dev (demo.fly.dev/q)", ["mailto", None, "", "y.io"], [("t", " a.dev).", None)])], "t string, m array<string>, p array<struct<title: string, github: string, demo: string>>")
    r = one.select(text_urls(F.col("t"), F.col("m")).alias("u"), ground_links(F.col("p"), F.lit(None).cast("array<string>")).alias("g")).first()
    assert r.u[0] == "https://github.com/a/b," and "https://www.x.dev" in r.u and r.u[-1] == "https://y.io" and r.g[0].github == "https://a.dev"


def test_trees(spark):
    from lodestone.operators.trees import descend, newest

    rows = [(1, None, "2024-01-01"), (2, None, "2024-03-01"), (3, 2, None), (4, 3, None), (5, 4, None), (6, 1, None), (7, 8, None), (8, 7, None), (9, 99, None), (10, None, "2024-03-01"), (11, 3, None)]
    df = spark.createDataFrame(rows, "id int, parent int, day string")
    story = newest(df, F.col("parent").isNull(), "day")
    assert sorted((r.id, r.depth) for r in descend(df, story).collect()) == [(2, 0), (3, 1), (4, 2), (5, 3), (11, 2)]
    assert descend(df, df.limit(0)).count() == 0 and newest(df, F.lit(False), "day").count() == 0
    assert sorted(r.id for r in descend(df, df.where("id = 7")).collect()) == [7, 8]


def test_expiring_table(spark, tmp_path):
    from lodestone.sources.store import ExpiringTable

    t = ExpiringTable(spark, f"file://{tmp_path}/cache")
    now = dt.datetime(2026, 1, 10, 12)
    keys = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "key string")
    read = lambda when: {r.key: r.value if r.hit else "-" for r in t.get(keys, when).collect()}
    assert set(read(now).values()) == {"-"}
    put = lambda rows, when, s: t.put(spark.createDataFrame(rows, "key string, value string"), when, s)
    put([("a", "old"), ("b", "x"), (None, "none")], now, 3600)
    put([("a", "new")], now + dt.timedelta(minutes=1), 86_400)
    put([("c", "for ever")], now, None)
    assert read(now + dt.timedelta(minutes=2)) == {"a": "new", "b": "x", "c": "for ever", None: "none"}
    assert read(now) == {"a": "old", "b": "x", "c": "for ever", None: "none"}
    assert read(now + dt.timedelta(hours=1)) == {"a": "new", "b": "x", "c": "for ever", None: "none"}
    assert read(now + dt.timedelta(hours=2)) == {"a": "new", "b": "-", "c": "for ever", None: "-"}
    later = now + dt.timedelta(days=1)
    plan = t.live(later)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "day#" in plan
    for f in (tmp_path / "cache/day=2026-01-11").glob("*.parquet"):
        f.write_bytes(b"broken")
    for f in (tmp_path / "cache/day=2026-01-11").glob(".*.crc"):
        f.unlink()
    assert read(now + dt.timedelta(minutes=2))["a"] == "old"
    assert t.sweep(later) == 1 and t.sweep(later + dt.timedelta(days=1)) == 1 and read(later)["c"] == "for ever"


def test_event_sink(spark, tmp_path):
    from lodestone.sources.store import EventSink

    now = dt.datetime(2026, 1, 10, 12)
    rows = [(i, now - dt.timedelta(hours=7 * i)) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "id int, ts timestamp")
    sink = EventSink(spark, f"file://{tmp_path}/events")
    for batch, part in ((0, df.where("id % 2 = 0")), (1, df.where("id % 2 = 1")), (1, df.where("id % 2 = 1"))):
        sink.append(part, batch)
    assert sorted(r.id for r in sink.read().collect()) == sorted(r[0] for r in rows)
    untouched = {p: p.stat().st_mtime_ns for p in (tmp_path / "events").glob("day=2026-01-1*/*/*.parquet")}
    assert sink.prune(now, 2) == sum(t is not None and t < now - dt.timedelta(days=2) for _, t in rows)
    left = sorted(r.id for r in sink.read().collect())
    assert left == sorted(i for i, t in rows if t is None or t >= now - dt.timedelta(days=2))
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "events").glob("day=2026-01-1*/*/*.parquet")} == untouched
    assert not list((tmp_path / "events").glob("day=2026-01-0[1-7]")) and sink.prune(now, 2) == 0
    assert sink.prune(now, 0) > 0 and sorted(r.id for r in sink.read().collect()) == [0, 1, 2, 3, 99]
    # as the target of a stream, whose batches may come again
    src = str(tmp_path / "in")
    df.where("ts IS NOT NULL").write.parquet(src)
    other = EventSink(spark, f"file://{tmp_path}/streamed")
    for _ in range(2):
        q = spark.readStream.schema("id int, ts timestamp").parquet(src).writeStream.foreachBatch(other.append).trigger(availableNow=True).start()
        q.awaitTermination()
    assert other.read().count() == 40


def test_feeds_with_name_spaces(spark, tmp_path):
    from lodestone.sources.normalise import read_rss

    (tmp_path / "a.xml").write_text('<?xml version="1.0"?><rss xmlns:content="c" xmlns:media="m"><channel><title>feed</title><item><media:title>no</media:title><title>Co &amp; Co: Dev</title><link>https://a.com/1</link><guid isPermaLink="false">g1</guid><description><![CDATA[<p>x &amp; y</p>]]></description></item><item><title>T</title><media:title>U</media:title><link>l</link><content:content>body</content:content></item></channel></rss>')
    (tmp_path / "b.xml").write_text("not a feed <item>")
    (tmp_path / "c.xml").write_text("<rss><item><title>ok</title></item><item><title>bad</titel></item></rss>")
    got = {r.title: (r.link, r.guid, r.description) for r in read_rss(spark, str(tmp_path)).collect()}
    assert got == {"Co & Co: Dev": ("https://a.com/1", "g1", "<p>x &amp; y</p>"), "U": ("l", None, "body")}
