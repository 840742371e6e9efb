"""Repeated passages: longest-previous-factor arrays over suffix order, for corpora of any size.

A byte is repeated if a string of ``length`` bytes that covers it also starts
somewhere else.  Matches never cross documents and are judged on the input.

No suffix array could hold the corpus, so equal strings are first brought
together.  Every window of ``length`` bytes selects the ``gram``-byte string of
smallest hash in it (leftmost of ties); equal windows select the same one at the
same place.  The windows that one selected place stands for are consecutive, and
the bytes they span are its block.  What is shuffled is a row per selected place,
about one in 80 bytes; places whose gram occurs once are dropped.  Equal blocks
collapse into one that knows how often it occurs: all its copies but the first are
repeated as a whole.  The distinct blocks of a gram meet in one part.  There a
suffix array with its LCP values is built, previous and next smaller positions in
suffix order give each window's longest previous factor and the place of that
earlier match, and a factor of ``length`` or more means repeated bytes.  If a gram
has very many distinct blocks (it lies near the end of a passage that many
documents share), they are first cut into pieces that only meet where they have a
core in common, turn by turn, until few enough meet (see ``_refined``).

Mode ``all`` removes every copy, ``later`` keeps the first by (doc_id, place).

Defined results: null text has no bytes; texts shorter than ``length`` keep all;
rows repeated whole count as copies of each other in mode ``all`` and as one row in
mode ``later``; null doc_ids come first in the order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import fresh, materialise, ship

LENGTH = 200
GRAM = 40
U64 = np.uint64
#: Different blocks that meet at most before they are cut into pieces, and blocks of a part on average.
PART_BLOCKS = 250
BLOCKS = 4000

ANCHORS = "h bigint, block bigint, d bigint, t bigint, lo int, hi int, at int"


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    m, have = v, 1
    while have * 2 <= width:
        m = np.minimum(m[: len(m) - have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Selected places: document, gram hash, block hash, first and last window start, place (positions in the document)."""
    n = len(raw)
    if n < length:
        return (np.zeros(0, np.int64),) * 6
    windows = tk.Windows(raw)
    g = windows.every(gram)
    i = np.arange(len(g))
    packed = (g & U64(0xFFFFFFFF00000000)) | i.astype(U64)
    low = sliding_min(packed, length - gram + 1)  # for every window start
    place = (low & U64(0xFFFFFFFF)).astype(np.int64)
    size = np.diff(offsets)
    doc = np.repeat(np.arange(len(size)), size)[: len(place)]
    valid = np.flatnonzero(np.arange(len(place)) + length <= offsets[1:][doc])
    if not len(valid):
        return (np.zeros(0, np.int64),) * 6
    p, d = place[valid], doc[valid]
    new = np.concatenate(([True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])))
    first = np.flatnonzero(new)
    lo, hi = valid[first], valid[np.append(first[1:], len(valid)) - 1]
    at, d = p[first], d[first]
    with np.errstate(over="ignore"):
        block = tk.mix(windows.spans(lo, hi + length, length) ^ ((at - lo).astype(U64) * U64(0x9E3779B97F4A7C15)))
    base = offsets[d]
    return d, g[at].view(np.int64), block.view(np.int64), lo - base, hi - base, at - base


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(body).alias("t"), body.alias("text"))


def _places(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    ship(keyed.sparkSession)
    names = [c.split(" ")[0] for c in ANCHORS.split(", ")]

    def run(batches):
        tk.begin()
        for batch in batches:
            d_all, t_all = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for a, b, raw, offsets in tk.chunks(batch.column(2)):
                doc, h, block, lo, hi, at = anchors(raw, offsets, length, gram)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h, block, d_all[a:b][doc], t_all[a:b][doc], lo.astype(np.int32), hi.astype(np.int32), at.astype(np.int32))], names)

    return keyed.mapInArrow(tk.released(run), ANCHORS)


# --- suffix order of a part ------------------------------------------------------


class SuffixOrder:
    """Suffixes of a byte string ordered by their first ``depth`` bytes, by prefix doubling.

    ``levels`` holds, for growing sizes, the rank of the string of that size from every place;
    the end of the text is smaller than any byte.
    """

    def __init__(self, s: np.ndarray, depth: int):
        n, size = len(s), min(7, depth)
        self.s = np.concatenate((s.astype(np.int64) + 1, np.zeros(size, np.int64)))
        key = np.zeros(n, np.int64)
        for k in range(size):  # 257 symbols, so seven fit into a number
            key = key * 257 + self.s[k : n + k]
        _, rank = np.unique(key, return_inverse=True)
        self.levels = [(size, rank)]
        while size < depth and n and int(rank.max()) + 1 < n:
            step = min(size, depth - size)
            after = np.zeros(n, np.int64)
            after[: max(0, n - step)] = rank[step:] + 1
            _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
            size += step
            self.levels.append((size, rank))
        self.rank = rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes ``i`` and ``j``, to the depth of the order."""
        n, out = len(self.s) - min(7, self.levels[0][0]), np.zeros(len(i), np.int64)
        for size, rank in reversed(self.levels):
            inside = np.maximum(i, j) + out < n
            same = inside.copy()
            same[inside] = rank[(i + out)[inside]] == rank[(j + out)[inside]]
            out += same * size
        for _ in range(self.levels[0][0] - 1):
            inside = np.maximum(i, j) + out < n
            same = inside.copy()
            same[inside] = self.s[(i + out)[inside]] == self.s[(j + out)[inside]]
            out += same
        return np.minimum(out, np.where(i == j, 0, n - np.maximum(i, j)))


def previous_smaller(values: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier entry of the same run with a smaller value, or -1.

    Everything between an entry and its candidate is larger than the entry, so a candidate that is
    larger too can be replaced by its own candidate, for all entries at a time.
    """
    near = np.arange(len(values)) - 1
    near[np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1])))[: len(values)]] = -1
    todo = np.flatnonzero(near >= 0)
    todo = todo[values[near[todo]] > values[todo]]
    while len(todo):
        near[todo] = near[near[todo]]
        todo = todo[near[todo] >= 0]
        todo = todo[values[near[todo]] > values[todo]]
    return near


def longest_previous(s: np.ndarray, starts: np.ndarray, depth: int, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous factors of the suffixes ``starts`` (ascending): length and the start of the earlier match.

    Lengths go to ``depth``; where no earlier start shares ``least`` bytes, both are 0 and -1.
    """
    factor, source = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    if not len(starts):
        return factor, source
    order = SuffixOrder(s, depth)
    array = starts[np.argsort(order.rank[starts], kind="stable")]  # the suffix array of the starts
    lcp = order.common(array[:-1], array[1:])
    run = np.concatenate(([0], np.cumsum(lcp < least)))  # no match of ``least`` bytes goes beyond a run
    before = previous_smaller(array, run)
    after = len(array) - 1 - previous_smaller(array[::-1], run[::-1])[::-1]
    after[after == len(array)] = -1
    where = np.searchsorted(starts, array)
    for near in (before, after):
        k = np.flatnonzero(near >= 0)
        length = order.common(array[k], array[near[k]])
        k, length = k[length > factor[where[k]]], length[length > factor[where[k]]]
        factor[where[k]], source[where[k]] = length, array[near[k]]
    return factor, source


def repeated_windows(s: np.ndarray, starts: np.ndarray, length: int, depth: int, later_only: bool) -> np.ndarray:
    """Which windows of ``length`` bytes have an earlier copy or, unless ``later_only``, are the earlier copy of one."""
    factor, source = longest_previous(s, starts, depth, length)
    hit = factor >= length
    if not later_only:
        hit = hit.copy()
        hit[np.searchsorted(starts, source[factor >= length])] = True  # the first copy is the only one before the second
    return hit


def _runs(flag: np.ndarray, owner: np.ndarray):
    """First and last index of the runs of set flags with one owner."""
    i = np.flatnonzero(flag)
    if not len(i):
        return i, i
    cut = np.flatnonzero((np.diff(i) > 1) | (owner[i[1:]] != owner[i[:-1]])) + 1
    return i[np.concatenate(([0], cut))], i[np.concatenate((cut - 1, [len(i) - 1]))]


SPANS = "d bigint, t bigint, start int, stop int"


def _settle(length: int, later_only: bool):
    """applyInArrow on a part's blocks (d, t, lo, hi, bytes): their repeated spans.  Earlier is by (d, t, lo)."""
    names = [c.split(" ")[0] for c in SPANS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("d", "ascending"), ("t", "ascending"), ("lo", "ascending")])
        data = part.column("bytes").combine_chunks().cast(pa.large_binary())
        col = {c: np.asarray(part.column(c)) for c in ("d", "t", "lo", "hi")}
        if not len(data):
            return pa.table([pa.array([], t) for t in types], names=names)
        off = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, data.offset * 8)
        s = np.frombuffer(data.buffers()[2], np.uint8)[off[0] : off[-1]]
        off = off[:-1] - off[0]
        count = col["hi"] - col["lo"] + 1
        owner = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        hit = repeated_windows(s, off[owner] + within, length, length + int(count.max()) - 1, later_only)
        out = []
        a, b = _runs(hit, owner)
        k = owner[a]
        out.append((col["d"][k], col["t"][k], col["lo"][k] + within[a], col["lo"][k] + within[b] + length))
        return pa.table([pa.array(np.concatenate(x), t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return run


def _blocks(keyed: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Bytes of the wanted places; the texts are shuffled once."""
    lists = wanted.groupBy("d", "t").agg(F.collect_list(F.struct("h", "block", "lo", "hi", "at", "parts", "n")).alias("places"))
    joined = keyed.join(lists, ["d", "t"]).dropDuplicates(["d", "t"]).select("d", "t", "text", "places")
    schema = "h bigint, block bigint, d bigint, t bigint, lo int, hi int, at int, parts int, n bigint, bytes binary"
    names = [c.split(" ")[0] for c in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def run(batches):
        tk.begin()
        for batch in batches:
            rows = []
            for d, t, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                rows += [(p["h"], p["block"], d, t, p["lo"], p["hi"], p["at"], p["parts"], p["n"], raw[p["lo"] : p["hi"] + length]) for p in places]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return joined.mapInArrow(tk.released(run), schema)


#: Sizes of the cells of window places that blocks are cut into, turn by turn.
CELLS = (128, 32, 8, 1)


def _refined(blocks: DataFrame, length: int, later_only: bool, part_blocks: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Blocks of grams that have more than ``part_blocks`` different ones: spans found by collapsing, and groups that may meet.

    A window is named by how far before its gram it begins.  Windows of a block in one cell of such distances are
    a piece.  Pieces of equal bytes collapse, as blocks do: all but the first are repeated as a whole.  All windows
    of a cell have a core in common, so pieces only need to meet where their cores are equal; groups of equal cores
    that are small enough are returned, others are cut into smaller cells.  In cells of one window the core is the
    window, so that nothing is left.  Rows with equal keys are gathered into lists within salted parts before any
    join, so a join has a row for each list.
    """
    key = ["h", "cell", "near", "far", "bytes"]
    rows = blocks.select("h", "d", "t", "at", "parts", (F.col("at") - F.col("hi")).alias("near"), (F.col("at") - F.col("lo")).alias("far"), "bytes")
    found, groups = [], []
    for size in CELLS:
        cells = F.explode(F.sequence(F.expr(f"int(near div {size})"), F.expr(f"int(far div {size})")))
        cut = rows.withColumn("cell", cells)
        cut = cut.withColumn("n2", F.greatest("near", F.col("cell") * size)).withColumn("f2", F.least("far", F.col("cell") * size + (size - 1)))
        cut = cut.withColumn("bytes", F.expr(f"substring(bytes, far - f2 + 1, f2 - n2 + {length})")).drop("near", "far").withColumnsRenamed({"n2": "near", "f2": "far"})
        who = F.struct("d", "t", "at")
        lists = cut.groupBy(*key, "parts", F.pmod(F.xxhash64("d", "t", "at"), F.col("parts")).alias("salt")).agg(F.collect_list(who).alias("who"))
        lists = materialise(lists, "pieces")
        kinds = materialise(lists.groupBy(*key, "parts").agg(F.sum(F.size("who")).alias("n"), F.min(F.array_min("who")).alias("first")), "kinds")
        again = lists.join(kinds.where(F.col("n") > 1).select(*key, "first"), key).select("near", "far", F.explode(F.array_except("who", F.array("first")) if later_only else F.col("who")).alias("w"))
        start = F.col("w.at") - F.col("far")
        found.append(again.select("w.d", "w.t", start.cast("int").alias("start"), (F.col("w.at") - F.col("near") + length).cast("int").alias("stop")))
        core = F.xxhash64(F.expr(f"substring(bytes, far - cell * {size} + 1, {length - size + 1})"))
        some = kinds.withColumn("core", core).groupBy("h", "cell", "core", F.pmod(F.xxhash64("bytes"), F.col("parts") * 4).alias("salt")).agg(F.collect_list(F.struct("first", "parts", "near", "far", "bytes")).alias("kinds"))
        some = materialise(some, "met")
        met = materialise(some.groupBy("h", "cell", "core").agg(F.sum(F.size("kinds")).alias("c")).where(F.col("c") > 1), "cores")
        one = some.join(met, ["h", "cell", "core"]).select("h", F.xxhash64("h", "cell", "core").alias("g"), "c", F.explode("kinds").alias("k"))
        one = one.select("h", "g", "c", "k.first.d", "k.first.t", "k.first.at", "k.parts", "k.near", "k.far", "k.bytes")
        few = F.col("c") <= part_blocks
        groups.append(one.where(few).select("g", "d", "t", (F.col("at") - F.col("far")).cast("int").alias("lo"), (F.col("at") - F.col("near")).cast("int").alias("hi"), "bytes"))
        if not met.where(~few).limit(1).count():
            break
        rows = one.where(~few).select("h", "d", "t", "at", "parts", "near", "far", "bytes")
    return found, groups


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, mode: str = "all", text: str = "text", doc_id: str = "doc_id", part_blocks: int = PART_BLOCKS) -> DataFrame:
    """(d, t, spans): for each text (number and hash) with repeated bytes, their spans (start, stop), unordered, overlapping."""
    if mode not in ("all", "later"):
        raise ValueError(mode)
    later = mode == "later"
    keyed = _keyed(docs, text, doc_id)
    # what is joined to is written first, so that adaptive execution can split the hot keys of the other side
    places = materialise(_places(keyed, length, gram), "places")
    common = materialise(places.groupBy("h").agg(F.count("*").alias("n"), (F.min("block") == F.max("block")).alias("pure")).where(F.col("n") > 1).drop("n"), "common")
    rows = materialise(places.join(common, "h"), "repeated")
    blocks = materialise(rows.groupBy("h", "block").agg(F.count("*").alias("n"), F.min(F.struct("d", "t", "lo", "hi", "at")).alias("first"), F.first("pure").alias("pure")), "blocks")
    twice = materialise(blocks.where(F.col("n") > 1).select("h", "block", "first"), "twice")
    whole = rows.join(twice, ["h", "block"])
    if later:
        whole = whole.where(F.struct("d", "t", "lo") != F.struct("first.d", "first.t", "first.lo"))
    found = [whole.select("d", "t", F.col("lo").alias("start"), (F.col("hi") + length).alias("stop"))]

    mixed = blocks.where(~F.col("pure"))
    kinds = materialise(mixed.groupBy("h").agg(F.count("*").alias("k")), "kinds")
    total = kinds.agg(F.sum("k").alias("k"), F.max("k").alias("most")).first()
    if total["k"]:
        wanted = mixed.join(kinds.select("h", F.ceil(F.col("k") / part_blocks).cast("int").alias("parts")), "h").select("h", "block", "n", "first.*", "parts")
        stored = materialise(_blocks(keyed, wanted, length), "block-bytes")
        groups = [stored.where(F.col("parts") == 1).select(F.col("h").alias("g"), "d", "t", "lo", "hi", "bytes")]
        if total["most"] > part_blocks:
            more, refined = _refined(stored.where(F.col("parts") > 1), length, later, part_blocks)
            found += more
            groups += refined
        n = max(1, -(-total["k"] // BLOCKS))
        for part in groups:
            found.append(part.withColumn("part", F.pmod(F.xxhash64("g"), F.lit(n))).groupBy("part").applyInArrow(_settle(length, later), SPANS))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("d", "t").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def merged(spans) -> list[tuple[int, int]]:
    """Union of spans, in order."""
    out: list[list[int]] = []
    for s in sorted((x["start"], x["stop"]) for x in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [tuple(x) for x in out]


def _with_spans(docs: DataFrame, text: str, doc_id: str, spans: DataFrame) -> DataFrame:
    """``docs`` with its text's spans as the last column."""
    d, t, found = fresh(docs, "__d"), fresh(docs, "__t"), fresh(docs, "__spans")
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    keyed = docs.withColumns({d: F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))), t: F.xxhash64(body)})
    return keyed.join(spans.select(F.col("d").alias(d), F.col("t").alias(t), F.col("spans").alias(found)), [d, t], "left").drop(d, t)


def removal_digests(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of mode ``all``."""
    rows = _with_spans(docs.select(doc_id, text), text, doc_id, repeated_spans(docs, length, text=text, doc_id=doc_id))
    schema = T.StructType([docs.schema[doc_id]]).add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")

    def run(batches):
        for batch in batches:
            out = []
            for raw, spans in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                raw = raw.as_buffer().to_pybytes() if raw.is_valid else b""
                cut = merged(spans)
                sha, p = hashlib.sha256(), 0
                for a, b in cut:
                    sha.update(raw[p:a])
                    p = b
                sha.update(raw[p:])
                out.append((len(raw), sum(b - a for a, b in cut), len(cut), sha.hexdigest()))
            cols = list(zip(*out, strict=True)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], schema.fieldNames())

    return rows.select(doc_id, F.col(text).cast("string"), rows.columns[-1]).mapInArrow(tk.released(run), schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, mode: str = "later", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text``; cuts are narrowed to whole characters."""
    rows = _with_spans(docs, text, doc_id, repeated_spans(docs, length, mode=mode, text=text, doc_id=doc_id))
    order = docs.columns
    schema = T.StructType([T.StructField(text, T.StringType()) if c == text else docs.schema[c] for c in order])

    def run(batches):
        tk.begin()
        for batch in batches:
            kept = []
            for raw, spans in zip(batch.column(len(order)), batch.column(len(order) + 1).to_pylist(), strict=True):
                if not raw.is_valid or not spans:
                    kept.append(raw.as_py())
                    continue
                data, out, p = raw.as_buffer().to_pybytes(), [], 0
                for a, b in merged(spans):
                    while a < b and data[a] & 0xC0 == 0x80:
                        a += 1
                    while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
                        b -= 1
                    out.append(data[p:a])
                    p = max(p, b)
                kept.append((b"".join(out) + data[p:]).decode("utf-8", "replace"))
            cols = [pa.array(kept, pa.string()) if c == text else batch.column(i) for i, c in enumerate(order)]
            yield pa.RecordBatch.from_arrays(cols, order)

    return rows.select(*order, F.col(text).cast("string").alias(fresh(rows, "__body")), rows.columns[-1]).mapInArrow(tk.released(run), schema)
