"""Near-duplicate documents by BagMinHash signatures, bands and exact multiset overlap.

Texts are bags of shingles of five lower-cased words.  A shingle of weight w
(its count) owns the part [0, w) of a weight axis that is cut into the intervals
[0,1), [1,2), [2,4), [4,8), ...  Every shingle and interval has a Poisson process
of points, as dense as the interval is wide, that depends on nothing else: a point
has a time, a place on the weight axis and one of M registers.  The first point of
a register that falls below w is the text's signature there, so two texts agree in
a register with exactly their weighted Jaccard similarity.  Points are made in order
of time and only up to the time by which all registers are filled.

Texts with the same words collapse first.  Signatures are cut into bands; texts that
share a band are candidates.  A bucket is not expanded into pairs: first its most central
text is compared with the others (exactly, by multiset overlap) and links join components.
Texts of buckets that still hold several components are then matched by an exact prefix
filter over their shingles, across components only, and compared: of the texts that share a
rare shingle first one for each component, so that most components join before the rest
meets.  So every pair that
shares a band is either linked, directly or through others, or was compared, or cannot
reach the threshold.

Defined results: texts without words (null, empty, blank) are copies of one another;
a text of one to four words is one shingle; rows are kept one for one, those without a
doc_id too, and class_id is the smallest doc_id of the class (null if all its numbers are).
Columns other than text and doc_id play no part, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textkit as tk
from .common import materialise, parts_for, ship
from .components import components

WORDS = 5
THRESHOLD = 0.8
ROWS, BANDS = 5, 25
M = ROWS * BANDS
U64 = np.uint64
_NO_ID = -(1 << 63)


def bags(raw: np.ndarray, offsets: np.ndarray, words: int = WORDS):
    """Distinct shingles of each document: document, 44-bit element, weight; ordered by document."""
    h, at = tk.shingles(raw, offsets, words)
    doc = np.repeat(np.arange(len(offsets) - 1, dtype=U64), np.diff(at))
    key = np.sort(doc << U64(44) | h >> U64(20))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> U64(44)).astype(np.int64), key & U64((1 << 44) - 1), weight


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int = M) -> np.ndarray:
    """n_docs x m registers (uint64); rows of documents without elements are all ones."""
    out = np.full(n_docs * m, np.iinfo(U64).max, U64)
    if not len(doc):
        return out.reshape(n_docs, m)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    levels = np.ceil(np.log2(weight)).astype(np.int64) + 1  # intervals that begin below the weight
    row = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(row)) - np.repeat(np.cumsum(levels) - levels, levels)
    width = np.where(level == 0, 1.0, 2.0 ** np.maximum(level - 1, 0))
    low = np.where(level == 0, 0.0, width)
    with np.errstate(over="ignore", divide="ignore"):
        seed = tk.mix(element[row] * U64(0x9E3779B97F4A7C15) + level.astype(U64))
        until = m * (np.log(m) + 3.0) / np.maximum(total, 1)
        todo = np.arange(len(row))
        while len(todo):
            d, w = doc[row[todo]], weight[row[todo]]
            active, time, k = todo, np.zeros(len(todo)), 0
            while len(active):
                k += 1
                h = tk.mix(seed[active] + U64(k) * U64(0xD1B54A32D192ED03))
                time = time - np.log(((h >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width[active]
                live = time <= until[d]
                active, time, d, w, h = active[live], time[live], d[live], w[live], h[live]
                if not len(active):
                    break
                g = tk.mix(h ^ U64(0xA0761D6478BD642F))
                place = low[active] + width[active] * ((g >> U64(40)).astype(np.float64) * 2.0**-24)
                inside = place < w
                register = ((g & U64(0xFFFFFFFF)) * U64(m)) >> U64(32)
                point = time.astype(np.float32).view(np.uint32).astype(U64) << U64(32) | (h & U64(0xFFFFFFFF))
                np.minimum.at(out, d[inside] * m + register[inside].astype(np.int64), point[inside])
            empty = (out.reshape(n_docs, m) == np.iinfo(U64).max).any(1) & (total > 0)
            until = np.where(empty, until * 2, until)  # beyond the time no filled register changes; others go on
            todo = np.flatnonzero(empty[doc[row]])
    return out.reshape(n_docs, m)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band, different between bands."""
    n, m = sig.shape
    s = sig.reshape(n, m // rows, rows)
    with np.errstate(over="ignore"):
        key = np.broadcast_to((np.arange(m // rows, dtype=U64) + U64(1)) * U64(0x9E3779B97F4A7C15), s.shape[:2]).copy()
        for j in range(rows):
            key = tk.mix(key ^ s[:, :, j])
    return key.view(np.int64)


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, x (hash of the text) and the lower-cased text of every row."""
    body = F.lower(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(body).alias("x"), body.alias("text"))


def signed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, x, node (of the words in order), bands; one row per input row."""
    ship(docs.sparkSession)

    def run(batches):
        tk.begin()
        for batch in batches:
            for a, b, raw, offsets in tk.chunks(batch.column(2)):
                n = b - a
                s, e, at = tk.words(raw, offsets)
                w = memoryview(tk.span_hashes(raw, s, e).tobytes()) if len(s) else memoryview(b"")
                node = [int.from_bytes(hashlib.blake2b(w[8 * x : 8 * y], digest_size=8).digest(), "little", signed=True) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                keys = band_keys(signatures(*bags(raw, offsets), n)) if n else np.zeros((0, BANDS), np.int64)
                wordless = np.diff(at) == 0
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.where(wordless, 0, BANDS)))).astype(np.int32)), pa.array(keys[~wordless].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(node, pa.int64()), bands], ["doc_id", "x", "node", "bands"])

    return _keyed(docs, text, doc_id).mapInArrow(tk.released(run), "doc_id bigint, x bigint, node bigint, bands array<bigint>")


def overlap(leader: pa.Array, members: pa.Array, words: int = WORDS) -> np.ndarray:
    """Weighted Jaccard similarity of one text with each of many."""
    lead = np.concatenate([tk.shingles(raw, off, words)[0] for _, _, raw, off in tk.chunks(leader)])
    u, c = np.unique(lead, return_counts=True)
    out = []
    for _, _, raw, offsets in tk.chunks(members):
        h, at = tk.shingles(raw, offsets, words)
        n = len(offsets) - 1
        doc = np.repeat(np.arange(n), np.diff(at))
        if len(u) and len(h):
            i = np.minimum(np.searchsorted(u, h), len(u) - 1)
            hit = u[i] == h
            key, times = np.unique(doc[hit] * len(u) + i[hit], return_counts=True)
            both = np.bincount(key // len(u), weights=np.minimum(times, c[key % len(u)]), minlength=n)
        else:
            both = np.zeros(n)
        out.append(both / np.maximum(len(lead) + np.diff(at) - both, 1))
    return np.concatenate(out)


def verified(pairs: DataFrame, texts: DataFrame, threshold: float = THRESHOLD, group: int = 256) -> DataFrame:
    """The (a, b) whose texts overlap by ``threshold``.  A leader with many members is split into groups."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    sizes = materialise(sizes.withColumn("parts", F.ceil(F.col("n") / group).cast("int")).drop("n"), "leaders", 6)
    members = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).join(texts.select(F.col("node").alias("b"), F.col("text").alias("t")), "b").select("a", "part", "b", "t")
    leaders = sizes.join(texts.select(F.col("node").alias("a"), F.col("text").alias("t")), "a").select(F.col("a").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("lead_part"), F.col("t").alias("lead_text"))

    def check(m: pa.Table, lead: pa.Table) -> pa.Table:
        if not m.num_rows or not lead.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        good = overlap(lead.column("lead_text").combine_chunks().slice(0, 1), m.column("t"), WORDS) >= threshold - 1e-12
        return pa.table({"a": m.column("a").filter(pa.array(good)), "b": m.column("b").filter(pa.array(good))})

    return members.groupBy("a", "part").cogroup(leaders.groupBy("lead", "lead_part")).applyInArrow(check, "a bigint, b bigint")


def _labelled(docs: DataFrame, text: str, doc_id: str, threshold: float) -> DataFrame:
    """doc_id, x, node and comp (of the class) of every row.  What is joined to is written first, so that adaptive execution can split hot keys."""
    rows = materialise(signed(docs, text, doc_id), "signed")
    kinds = rows.groupBy("node").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), "x")).alias("row"), F.first("bands").alias("bands"))
    postings = kinds.select("node", F.explode("bands").alias("key"))
    shared = postings.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    buckets = materialise(postings.join(shared, "key"), "buckets")
    # the most central text of a bucket is the one whose buckets are largest in sum
    centre = buckets.groupBy("node").agg(F.sum("size").alias("centre"))
    buckets = materialise(buckets.drop("size").join(centre, "node"), "buckets")
    wanted = centre.select("node").join(kinds.select("node", "row.d", "row.x"), "node")
    texts = materialise(_of_rows(docs, text, doc_id, wanted), "texts")

    n = buckets.count()
    parts = parts_for(n)
    # first the most central text of each bucket against the others
    best = materialise(buckets.groupBy("key").agg(F.max(F.struct("centre", F.negative("node").alias("o"), "node")).alias("t")).select("key", F.col("t.node").alias("a")), "centres")
    pairs = materialise(buckets.join(best, "key").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b")).distinct(), "pairs", parts)
    labels = components(verified(pairs, texts, threshold), size=n)
    # then the texts of buckets that still hold several components
    open_ = buckets.join(labels, "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    spread = materialise(open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where(F.col("lo") != F.col("hi")).select("key"), "spread", parts)
    live = materialise(open_.join(spread, "key", "left_semi").select("node", "comp").distinct(), "open", parts)
    if live.limit(1).count():
        prefix = prefixes(texts, live.select("node"), threshold)
        for first_only in (True, False):
            rest = materialise(prefix_pairs(prefix, live, threshold, first_only).join(pairs, ["a", "b"], "left_anti"), "pairs", parts)
            if not rest.limit(1).count():
                continue
            star = labels.select(F.col("node").alias("a"), F.col("comp").alias("b"))
            labels = components(verified(rest, texts, threshold).unionByName(star), size=n)
            pairs = pairs.unionByName(rest)
            live = materialise(live.select("node").join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")), "open", parts)
    return rows.select("doc_id", "x", "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, node, class_id and class_size of every row."""
    out = materialise(_labelled(docs, text, doc_id, threshold), "labelled")
    ids = materialise(out.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size")), "classes")
    return out.join(ids, "comp").select("doc_id", "node", "class_id", "class_size")


def _of_rows(docs: DataFrame, text: str, doc_id: str, wanted: DataFrame) -> DataFrame:
    """node and text of the rows ``wanted`` (node, d, x).  Repeated rows are sent once a task, so that many of them are no hot key."""
    ship(docs.sparkSession)

    def once(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            new = []
            for key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new.append(key not in seen)
                seen.add(key)
            yield batch.filter(pa.array(new, pa.bool_()))

    rows = _keyed(docs, text, doc_id).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), "x", "text").mapInArrow(tk.released(once), "d bigint, x bigint, text string")
    return rows.join(wanted, ["d", "x"]).dropDuplicates(["d", "x", "node"]).select("node", "text")


def prefixes(texts: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(node, n, c, i, token): the rarest tokens of each text, of which two texts that may overlap by ``threshold`` share one.

    The k-th copy of a shingle in a text is a token of its own, so bags are sets.  Two sets of n and m tokens can
    only overlap enough if their n - ceil(threshold * n) + 1 rarest tokens meet.  Tokens met once match nothing:
    they use up the prefix and bound the overlap (c tokens are met again, this is the i-th of them).
    """
    ship(texts.sparkSession)

    def split(batches):
        for batch in batches:
            for a, b, raw, offsets in tk.chunks(batch.column(1)):
                h, at = tk.shingles(raw, offsets, WORDS)
                size = np.diff(at)
                doc = np.repeat(np.arange(b - a), size)
                order = np.lexsort((h, doc))
                hs, ds = h[order], doc[order]
                new = np.concatenate(([True], (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1]))) if len(hs) else np.zeros(0, bool)
                first = np.maximum.accumulate(np.where(new, np.arange(len(hs)), 0))
                with np.errstate(over="ignore"):
                    token = tk.mix(hs + (np.arange(len(hs)) - first).astype(U64) * U64(0x9E3779B97F4A7C15))
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(0).slice(a, b - a))[ds]), pa.array(size[ds].astype(np.int32)), pa.array(token.view(np.int64))], ["node", "n", "token"])

    tokens = materialise(texts.join(nodes, "node", "left_semi").select("node", "text").mapInArrow(tk.released(split), "node bigint, n int, token bigint"), "tokens")
    often = materialise(tokens.groupBy("token").agg(F.count("*").alias("f")).where(F.col("f") > 1), "often")
    met = tokens.join(often, "token").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("f", "token"))).alias("met"))  # a text's own tokens
    size = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1 - (F.col("n") - F.size("met"))
    kept = met.where(size > 0).select("node", "n", F.size("met").alias("c"), F.posexplode(F.transform(F.slice("met", F.lit(1), size.cast("int")), lambda x: x["token"])).alias("i", "token"))
    return materialise(kept, "prefix")


def prefix_pairs(prefix: DataFrame, live: DataFrame, threshold: float = THRESHOLD, first_only: bool = False) -> DataFrame:
    """Pairs (a < b) of ``live`` (node, comp) texts of different components that share a token of ``prefix`` and may overlap by ``threshold``.

    Texts of a token's largest component are only met by others; with ``first_only``, one text of it meets one of each other component.
    """
    rows = prefix.join(live, "node").select("token", "node", "n", (F.col("c") - F.col("i")).alias("c"), "comp")
    count = rows.groupBy("token", "comp").agg(F.count("*").alias("k"), F.min(F.struct("node", "n", "c")).alias("one"))
    main = count.groupBy("token").agg(F.max(F.struct("k", "comp", "one")).alias("t"), F.count("*").alias("comps")).where(F.col("comps") > 1)
    main = materialise(main.select("token", F.col("t.comp").alias("main"), F.col("t.one").alias("one")), "main")
    if first_only:
        x = count.select("token", "comp", "one.*").join(main.select("token", "main", F.col("one.node").alias("y"), F.col("one.n").alias("yn"), F.col("one.c").alias("yc")), "token")
        x = x.where(F.col("comp") != F.col("main")).withColumnsRenamed({"node": "x", "n": "xn", "c": "xc", "comp": "xcomp", "main": "ycomp"})
    else:
        some = materialise(rows.join(main.select("token", "main"), "token"), "some")
        x = some.where(F.col("comp") != F.col("main")).select("token", F.col("node").alias("x"), F.col("n").alias("xn"), F.col("c").alias("xc"), F.col("comp").alias("xcomp"))
        y = some.select("token", F.col("node").alias("y"), F.col("n").alias("yn"), F.col("c").alias("yc"), F.col("comp").alias("ycomp"))
        x = x.join(y, "token")
    most = F.least("xc", "yc")  # if a pair's first common token is its i-th, no more can be common
    fine = (F.col("xcomp") != F.col("ycomp")) & (most >= (F.col("xn") + F.col("yn") - most) * threshold - 1e-9)
    return x.where(fine).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one of the smallest doc_id.

    A class without any doc_id keeps one text.  Rows that repeat the one that stays stay too (repeated rows are one document).
    """
    found = _labelled(docs, text, doc_id, threshold)
    best = found.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), "x")).alias("row"))
    keep = materialise(best.select(F.col("row.d").alias("d"), F.col("row.x").alias("x")).distinct(), "stay")
    body = F.lower(F.coalesce(docs[text].cast("string"), F.lit("")))
    same = (F.coalesce(docs[doc_id].cast("long"), F.lit(_NO_ID)) == keep["d"]) & (F.xxhash64(body) == keep["x"])
    return docs.join(keep, same, "left_semi")
