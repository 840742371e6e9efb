"""Runs of repeated words: tiles per octave of periods, solved alone and stitched by document and period.

A run is a maximal stretch of consecutive words with smallest period q and a length
of at least max(6, 4q).  Periods are taken by octaves [B, 2B), B = 1, 2, 4, ...

*Tiles.*  In an octave a document has a boundary every B words.  A run of period q
holds for each boundary b in it (but near its end) the 2B words from b also from
b + q, so a place i can only answer to one boundary and the candidates of an octave are one
comparison of names per word; names of 2B words come from those of B.  Two or more
candidates at a boundary are B or less apart, so they are multiples of a shorter
period, whose run another octave finds; a boundary with exactly one stays.  Boundaries that
stay are cut into tiles of a bounded number of words (or sixteen boundaries, in high
octaves) that overlap by what a boundary can see: B words before, 5B behind.  Tiles
are rows of their own and dealt over all tasks, whatever document they are from.

*Boundary Z-functions.*  In its tile a boundary's common prefix and suffix at shift q
give the stretch of places i with word i = word i + q; neighbouring boundaries of one
period are settled together.  A period whose root is a power is dropped here.

*Stitching.*  Stretches of a document and period that touch are one; then lengths are judged.

Names of single words are exact within a task; those of more words are 64-bit hashes that only choose what is
compared.  A clash can add a candidate, which comparison rejects; that one hides the
only true candidate of every boundary of a run is as likely as several clashes of 64 bits in one place.

Defined results: a null or empty text, or one of white space, has no words and no runs; rows are kept one for one, repeated
rows each with their runs; columns are carried, whatever their names, but for those named like an output.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import fresh, materialise, ship

LEAST_LENGTH, LEAST_REPEATS = 6, 4
#: Words of a tile in low octaves; in high ones a tile has this many boundaries.
TILE_WORDS, TILE_BOUNDARIES = 4096, 16
U64 = np.uint64
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
_TILE = pa.struct([("octave", pa.int32()), ("first", pa.int64()), ("at", pa.list_(pa.int64())), ("period", pa.list_(pa.int64())), ("words", pa.binary())])


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the words (equal where the words are), the words' ends in the text without white space, each document's offsets."""
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    solid = np.flatnonzero(~gap)
    start = np.zeros(len(raw) + 1, bool)
    start[offsets] = True  # a word doesn't cross documents
    start[1:] |= np.concatenate((gap, [True]))[:-1]
    begins = start[:-1] & ~gap
    first = np.flatnonzero(begins[solid])
    ends = np.append(first[1:], len(solid)).astype(np.int64)
    dense = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, len(solid)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw[solid]))])
    ids = np.asarray(dense.dictionary_encode().indices, np.int32) if len(first) else np.zeros(0, np.int32)
    at = np.searchsorted(np.flatnonzero(begins), offsets)
    return ids, ends, at


def _doubled(h: np.ndarray, size: int) -> np.ndarray:
    """Names of 2 * size words from those of size words, from every place but the last ones."""
    with np.errstate(over="ignore"):
        out = h[: len(h) - size] * U64(0x9E3779B97F4A7C15) + tk.mix(h[size:])
        return tk.mix(out)


def candidates(ids: np.ndarray, at: np.ndarray):
    """For each octave (k, document, boundary, period), places counted within documents; arrays are ordered by document, then boundary."""
    docs = np.arange(len(at) - 1)
    sizes = np.diff(at)
    h, off = tk.mix(ids.astype(U64) + U64(1)), at[:-1].astype(np.int64)
    k = 0
    while True:
        span = 1 << k
        long = sizes >= max(LEAST_LENGTH, LEAST_REPEATS * span)
        if not long.any():
            return
        if not long.all():  # documents that are too short for this octave go
            docs, sizes, off = docs[long], sizes[long], off[long]
            total = np.concatenate(([0], np.cumsum(sizes)))
            take = np.repeat(off - total[:-1], sizes) + np.arange(total[-1])
            h, off = h[take], total[:-1]
        wide = _doubled(h, span)
        n = len(wide)
        owner = np.repeat(np.arange(len(docs)), sizes)[:n]
        place = np.arange(n) - off[owner]
        boundary = (place >> k << k) - span
        real = np.flatnonzero((boundary >= 0) & (place + 2 * span <= sizes[owner]))
        hit = real[wide[real] == wide[real - place[real] + boundary[real]]]
        if len(hit):
            mark = off[owner[hit]] + boundary[hit]
            new = np.append(True, mark[1:] != mark[:-1])
            alone = new & np.append(new[1:], True)
            hit = hit[alone]
            if len(hit):
                yield k, docs[owner[hit]], boundary[hit], place[hit] - boundary[hit]
        h, k = np.append(wide, np.zeros(span, U64)), k + 1  # places near a document's end have no name; none is asked of them


def tiles(ids: np.ndarray, at: np.ndarray) -> dict[int, list[dict]]:
    """By document its tiles that have candidates."""
    out: dict[int, list[dict]] = {}
    for k, doc, boundary, period in candidates(ids, at):
        span = 1 << k
        each = max(TILE_BOUNDARIES, TILE_WORDS >> k) * span
        tile = boundary // each
        cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (tile[1:] != tile[:-1])))
        for a, b in zip(cut, np.append(cut[1:], len(doc)), strict=True):
            d = int(doc[a])
            begin = max(0, int(boundary[a]) - span)
            end = min(int(at[d + 1] - at[d]), int(boundary[b - 1]) + 5 * span)
            row = {"octave": k, "first": begin, "at": boundary[a:b].tolist(), "period": period[a:b].tolist(), "words": ids[at[d] + begin : at[d] + end].tobytes()}
            out.setdefault(d, []).append(row)
    return out


def _is_power(root: np.ndarray) -> bool:
    q, r = len(root), 2
    rest = q
    while rest > 1:
        if r * r > rest:
            r = rest
        if rest % r == 0:
            part = q // r
            if np.array_equal(root[: q - part], root[part:]):
                return True
            while rest % r == 0:
                rest //= r
        r += 1
    return False


def stretches(w: np.ndarray, octave: int, at: np.ndarray, period: np.ndarray) -> list[tuple[int, int, int]]:
    """(period, first, last + 1) of the places i with word i = word i + period around the boundaries of a tile."""
    span, out = 1 << octave, []
    cut = np.flatnonzero(np.append(True, (period[1:] != period[:-1]) | (at[1:] != at[:-1] + span)))
    for a, b in zip(cut, np.append(cut[1:], len(at)), strict=True):
        first, last, q = int(at[a]), int(at[b - 1]), int(period[a])
        low, high = max(0, first - span), min(len(w) - q, last + 3 * span)
        unequal = low + np.flatnonzero(w[low:high] != w[low + q : high + q])
        k = int(np.searchsorted(unequal, first))
        x = int(unequal[k - 1]) + 1 if k else low
        y = int(unequal[k]) if k < len(unequal) else high
        if y - first >= 2 * span and not _is_power(w[first : first + q]):
            out.append((q, x, y))
    return out


def with_tiles(docs: DataFrame, text: str = "text", thin: bool = False) -> DataFrame:
    """``docs`` with columns behind its own: row (a number), n_words, plain_sha256 (of all words) and tiles; written, so that numbers stay.

    ``thin`` leaves out the texts that have no tile: nothing is to be done for them any more.
    """
    spark = docs.sparkSession
    ship(spark)
    names = [fresh(docs, c) for c in ("row", "n_words", "plain_sha256", "tiles")]
    staged = docs.withColumn(names[0], F.monotonically_increasing_id()).withColumn(fresh(docs, "__body"), F.coalesce(F.col(text).cast("string"), F.lit("")))
    fields = [*staged.columns[:-1], *names[1:]]
    added = T.StructType.fromDDL("n bigint, sha string, tiles array<struct<octave: int, first: bigint, at: array<bigint>, period: array<bigint>, words: binary>>")
    schema = T.StructType([*staged.schema.fields[:-1], *(T.StructField(name, f.dataType) for name, f in zip(names[1:], added.fields, strict=True))])

    at_text = docs.columns.index(text)

    def run(batches):
        tk.begin()
        for batch in batches:
            cols = batch.columns
            for a, b, raw, offsets in tk.chunks(cols[-1]):
                ids, ends, at = words(raw, offsets)
                found = tiles(ids, at)
                digests = plain_digests(raw, offsets)
                rows = pa.array([found.get(i, []) for i in range(b - a)], pa.list_(_TILE))
                own = [c.slice(a, b - a) for c in cols[:-1]]
                if thin:
                    own[at_text] = pa.array([cols[at_text][a + i].as_py() if i in found else None for i in range(b - a)], cols[at_text].type)
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(at)), pa.array(digests, pa.string()), rows], fields)

    return materialise(staged.mapInArrow(run, schema), "tiles")


def plain_digests(raw: np.ndarray, offsets: np.ndarray) -> list[str]:
    """SHA-256 of each document's words joined by one space."""
    data = raw.tobytes()
    return [hashlib.sha256(b" ".join(_split(data[a:b]))).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def _split(text: bytes) -> list[bytes]:
    return text.split()  # bytes are split at the space and at 0x09 to 0x0D, nothing else


def runs_of(tiled: DataFrame) -> DataFrame:
    """(row, runs): of what ``with_tiles`` returned, the rows that have runs; runs by start, then period."""
    row, _, _, tile = tiled.columns[-4:]

    def solve(batches):
        tk.begin()
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = t.as_py()
                base = v["first"]
                w = np.frombuffer(v["words"], np.int32)
                out += [(key, q, x + base, y + base) for q, x, y in stretches(w, v["octave"], np.array(v["at"]) - base, np.array(v["period"]))]
            cols = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["row", "period", "x", "y"])

    dealt = tiled.select(F.col(row).alias("row"), F.explode(tile).alias("tile")).repartition(F.col("row"), F.col("tile.octave"), F.col("tile.first"))
    found = dealt.mapInArrow(solve, "row bigint, period bigint, x bigint, y bigint")
    order = Window.partitionBy("row", "period").orderBy("x", "y")
    reach = F.max("y").over(order.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.withColumn("new", F.when(F.col("x") <= reach, 0).otherwise(1)).withColumn("part", F.sum("new").over(order))
    whole = parts.groupBy("row", "period", "part").agg(F.min("x").alias("start"), (F.max("y") - F.min("x") + F.col("period")).alias("length"))
    judged = whole.where((F.col("length") >= LEAST_LENGTH) & (F.col("length") >= LEAST_REPEATS * F.col("period")))
    run = F.struct("start", "length", "period")
    by_start = F.transform(F.array_sort(F.transform(F.collect_list(run), lambda r: F.struct(r["start"], r["period"], r["length"]))), lambda r: F.struct(r["start"], r["length"], r["period"]))
    return judged.groupBy("row").agg(by_start.cast(RUNS).alias("runs"))


def longest(runs: Column) -> Column:
    """The run of greatest length; ties: smallest start, then period."""
    best = F.array_min(F.transform(runs, lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    return F.struct(best["start"].alias("start"), (-best["l"]).alias("length"), best["period"].alias("period"))


def kept_words(n: int, runs: list[dict]) -> np.ndarray:
    """Which words stay: those that no run holds behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    for r in runs:
        edge[r["start"] + r["period"]] += 1
        edge[r["start"] + r["length"]] -= 1
    return np.cumsum(edge[:n]) == 0


def collapse(docs: DataFrame, text: str = "text", texts: bool = True) -> DataFrame:
    """``docs`` with n_words, runs and collapsed_sha256 behind its own columns, and ``text`` replaced by the words that stay, joined by one space.

    ``texts=False`` returns no texts: then only those that have a tile are written, and no other is shuffled in either case.
    """
    outputs = ("n_words", "runs", "collapsed_sha256")
    staged = with_tiles(docs.select(*(c for c in docs.columns if c not in outputs)), text, not texts)
    keep, (row, n_words, sha, tile) = staged.columns[:-4], staged.columns[-4:]
    key, listed = fresh(staged, "__row"), fresh(staged, "__runs")
    found = runs_of(staged).withColumnsRenamed({"row": key, "runs": listed})
    tiled = F.size(tile) > 0
    joined = staged.where(tiled).join(found, F.col(row) == F.col(key), "left").unionByName(staged.where(~tiled), allowMissingColumns=True)
    ready = joined.select(*keep, F.col(n_words).alias("n_words"), F.coalesce(listed, F.array().cast(RUNS)).alias("runs"), F.col(sha).alias("collapsed_sha256"))
    schema, at_text = ready.schema, keep.index(text)

    def run(batches):
        tk.begin()
        for batch in batches:
            cols = list(batch.columns)
            sha256, bodies = cols[-1].to_pylist(), cols[at_text].to_pylist()
            has = np.asarray(pa.compute.list_value_length(cols[-2])) > 0
            for i in range(len(bodies)) if texts else np.flatnonzero(has).tolist():
                if bodies[i] is None:
                    continue
                w = _split(bodies[i].encode())
                if has[i]:
                    w = [w[j] for j in np.flatnonzero(kept_words(len(w), cols[-2][int(i)].as_py()))]
                    sha256[i] = hashlib.sha256(b" ".join(w)).hexdigest()
                bodies[i] = b" ".join(w).decode() if texts else None
            cols[at_text] = pa.array(bodies, cols[at_text].type)
            cols[-1] = pa.array(sha256, pa.string())
            yield pa.RecordBatch.from_arrays(cols, schema.fieldNames())

    out = ready.mapInArrow(run, schema)
    return out if texts else out.drop(text)


def digests(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` with n_runs, the longest run, and digests of the runs' list and of the words that stay."""
    outputs = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    keep = tuple(c for c in keep if c not in (*outputs, text, "runs", "n_words"))
    seen = collapse(docs.select(*keep, text), text, texts=False)
    best = longest(F.col("runs"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return seen.select(
        *keep, F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), "collapsed_sha256",
    )


def planted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a period in every tenth text (by crc32 of doc_id): what the query looks for besides the corpus's own runs."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    w = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    let = lambda v, f: F.get(F.transform(F.array(v), f), 0)

    def of(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, F.greatest(n, F.lit(1)))
        p = F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8)))) + 1
        place = lambda i: F.when(i < a, i).otherwise(a + F.pmod(i - a, p))
        made = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int")))
        return F.when(n > 0, F.array_join(made, " ")).otherwise(F.lit(""))

    return docs.withColumn(text, F.when(h % 10 == 0, let(w, of)).otherwise(F.col(text)))
