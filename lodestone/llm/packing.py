"""Packing documents into sequences of a fixed window with hardly any padding.

Each document is its token ids and a closing id.  Whole windows are cut off
first; what remains of a document is 0 to window-1 ids long, so that a corpus of
any size is described by a histogram of window-1 lengths.  Shallow combinations
(one, two or three lengths that fill the window) are enumerated, their repeat
counts are solved against the histogram by non-negative least squares on the
driver, rounded and made feasible, twice: what the first plan leaves is solved for
again.  What both leave is packed greedily: the pieces left follow one another and are cut at window borders; the
last partial window is cut into powers of two, which need no padding.

Only the histogram and the plan, both of bounded size, pass through the driver.
Which sequence a piece goes to is arithmetic on its rank within its length:
tasks number their own rows, and offsets of tasks are summed by length.

Ids are those of the library on the whole text: added tokens of the vocabulary
file that stand in a text are matched first and get their id.

Defined results: a null or empty text is its closing id alone; repeated rows are
packed one by one (rows, not ids, are packed); an empty table gives no pieces.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .bpe import _bytes_of, _word_spans
from .common import materialise, ship

WINDOW = 1024


class WordTokenizer:
    """Ids of distinct words by the ``tokenizers`` library; added tokens are whole words by ``split_added`` and get their id."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        odd = [t.content for t in added.values() if t.lstrip or t.rstrip or t.single_word or (t.normalized and self.tokenizer.normalizer is not None)]
        if odd:
            raise ValueError(f"added tokens {odd} take in neighbours or are normalised; only plain ones are supported")
        self.added = {t.content: i for i, t in added.items() if t.content}
        # the library takes the longest of the tokens that start leftmost
        self.pattern = re.compile(b"|".join(re.escape(t.encode()) for t in sorted(self.added, key=lambda t: -len(t.encode())))) if self.added else None
        self.batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)

    def split_added(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends, in bytes, of the added tokens in the texts; a match never crosses texts."""
        none = np.zeros(0, np.int64)
        if self.pattern is None:
            return none, none
        data = raw.tobytes()
        if self.pattern.search(data) is None:
            return none, none
        bounds = offsets.tolist()
        at = [m.span() for a, b in zip(bounds[:-1], bounds[1:], strict=True) for m in self.pattern.finditer(data, a, b)]
        found = np.array(at, np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def spans(self, raw: np.ndarray, offsets: np.ndarray):
        """``_word_spans`` with each added token as one word; the parts between are pre-tokenised as texts of their own."""
        first, last = self.split_added(raw, offsets)
        if not len(first):
            return _word_spans(raw, offsets)
        parts = np.unique(np.concatenate((offsets, first, last)))
        cps, s, e, h, at = _word_spans(raw, parts)
        # words of an added token are united: the first one ends where the token does
        a, b = at[np.searchsorted(parts, first)], at[np.searchsorted(parts, last)]
        keep = np.ones(len(s) + 1, np.int64)
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            keep[x + 1 : y] = 0
        place = np.concatenate(([0], np.cumsum(keep)))[:-1]  # a word's number among those kept
        e[a] = e[b - 1]
        kept = keep[:-1].astype(bool)
        s, e = s[kept], e[kept]
        return cps, s, e, tk.span_hashes(cps, s, e), place[at[np.searchsorted(parts, offsets)]]

    def __call__(self, raw, cps, s, e, which):
        data, off = _bytes_of(raw, cps, s, e, which)
        text = data.tobytes()
        bounds = off.tolist()
        words = [text[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        lists = [x.ids for x in self.batch(words, add_special_tokens=False)]
        out = np.zeros(len(lists) + 1, np.int64)
        np.cumsum([len(x) for x in lists], out=out[1:])
        return out, np.fromiter((i for x in lists for i in x), np.int32, int(out[-1]))


TOKENISED = "pid int, row bigint, doc_id bigint, doc_tokens bigint, n_full bigint, full_before bigint, full_crcs array<bigint>, rem int, rem_rank bigint, rem_crc bigint, rem_ids binary"


def tokenise(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", end_id: int = 0) -> DataFrame:
    """One row per document: lengths, checksums of its whole windows, and the ids that remain.

    ``full_before`` and ``rem_rank`` count within the task ``pid``: whole windows before this row, and rows before it with as long a remainder.
    """
    ship(docs.sparkSession)
    names = [c.split(" ")[0] for c in TOKENISED.split(", ")]

    def run(batches):
        from pyspark import TaskContext

        pid = TaskContext.get().partitionId()
        encode, lists = tk.state(("pack", tokenizer_path), lambda: (WordTokenizer(tokenizer_path), tk.WordLists()))
        row, full, ranks = 0, 0, np.zeros(window, np.int64)
        for batch in batches:
            for a, b, raw, offsets in tk.chunks(batch.column(1)):
                n = b - a
                if len(raw):
                    cps, s, e, h, at = encode.spans(raw, offsets)
                    ids, woff = lists.lists(h, lambda which, r=raw, c=cps, s=s, e=e: encode(r, c, s, e, which))
                    off = woff[at]
                else:
                    ids, off = np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
                size = np.diff(off)
                flat = np.full(len(ids) + n, end_id, np.int32)  # with each document's closing id
                flat[np.arange(len(ids)) + np.repeat(np.arange(n), size)] = ids
                off = off + np.arange(n + 1)
                size = size + 1
                n_full, rem = size // window, size % window
                le = memoryview(flat.astype("<u4").tobytes())
                crcs, rem_crc, rem_ids, rem_rank = [], [], [], np.zeros(n, np.int64)
                for i, (x, k, r) in enumerate(zip(off[:-1].tolist(), n_full.tolist(), rem.tolist(), strict=True)):
                    crcs.append([zlib.crc32(le[4 * (x + j * window) : 4 * (x + (j + 1) * window)]) for j in range(k)])
                    tail = le[4 * (x + k * window) : 4 * (x + k * window + r)]
                    rem_crc.append(zlib.crc32(tail))
                    rem_ids.append(bytes(tail))
                    rem_rank[i] = ranks[r]
                    ranks[r] += 1
                before = full + np.cumsum(n_full) - n_full
                full += int(n_full.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, pid, np.int32)),
                        pa.array(row + np.arange(n)),
                        batch.column(0).slice(a, n),
                        pa.array(size),
                        pa.array(n_full),
                        pa.array(before),
                        pa.array(crcs, pa.list_(pa.int64())),
                        pa.array(rem.astype(np.int32)),
                        pa.array(rem_rank),
                        pa.array(rem_crc, pa.int64()),
                        pa.array(rem_ids, pa.binary()),
                    ],
                    names,
                )
                row += n

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, TOKENISED)


def combinations(histogram: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """All rows of up to three lengths (0: none) that fill the window, of lengths that occur; powers of two also stand alone.

    Their number depends on the window only: at most 87,381 + 512 + 10 for 1,024.
    """
    have = histogram > 0
    have[0] = False
    out = [(x, 0, 0) for x in (1 << k for k in range(window.bit_length() - 1)) if x < window and have[x]]
    out += [(a, window - a, 0) for a in range(1, window // 2 + 1) if have[a] and have[window - a]]
    triples = []
    for a in range(1, window // 3 + 1):
        if have[a]:
            b = np.arange(a, (window - a) // 2 + 1)
            b = b[have[b] & have[window - a - b]]
            triples.append(np.stack((np.full(len(b), a), b, window - a - b), 1))
    return np.concatenate((np.array(out, np.int64).reshape(-1, 3), *triples))


def solve(combos: np.ndarray, histogram: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Repeat counts: non-negative least squares by accelerated projected gradients, on index lists instead of a matrix."""
    h = histogram.astype(float)
    h[0] = 0
    if not len(combos) or h.sum() == 0:
        return np.zeros(len(combos))
    columns = [np.ascontiguousarray(c) for c in combos.T]

    def forward(x):
        out = sum(np.bincount(c, weights=x, minlength=len(h)) for c in columns)
        out[0] = 0  # no length
        return out

    def back(r):
        return sum(r[c] for c in columns)  # r[0] is 0

    v = np.ones(len(combos))
    for _ in range(30):  # the largest eigenvalue, for the step
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 0.95 / norm
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * back(forward(y) - h))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        x, y, t = new, new + (t - 1) / t2 * (new - x), t2
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[list[dict], np.ndarray, int]:
    """Allotments of each length's ranks to sequences, the counts left for the greedy part, and sequences used."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    taken = np.zeros(window, np.int64)
    rows, sequences = [], 0
    for _ in range(2):
        combos = combinations(left, window)
        x = solve(combos, left)
        # what rounding takes from a combination its neighbours get, so that sums over neighbours are kept
        whole = np.diff(np.floor(np.concatenate(([0.0], np.cumsum(x))) + 0.5)).astype(np.int64)
        for combo, repeat in zip(combos[whole > 0].tolist(), whole[whole > 0].tolist(), strict=True):
            times = {v: combo.count(v) for v in combo if v}
            repeat = min(repeat, *(int(left[v]) // m for v, m in times.items()))
            if repeat <= 0:
                continue
            offset = 0
            for v, m in times.items():
                rows.append({"rem": v, "first": int(taken[v]), "count": repeat * m, "times": m, "sequence": sequences, "at": offset})
                taken[v] += repeat * m
                left[v] -= repeat * m
                offset += v * m
            sequences += repeat
    return rows, left, sequences


def borders(total: int, window: int = WINDOW) -> np.ndarray:
    """Starts of the sequences that a run of ``total`` ids is cut into after its last whole window, ``total`` at the end."""
    at, out = total // window * window, []
    rest = total - at
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append(at)
        at, rest = at + size, rest - size
    return np.array([*out, total], np.int64)


PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id", end_id: int = 0) -> DataFrame:
    """Pieces of all documents: ``PIECES``."""
    spark = docs.sparkSession
    rows = materialise(tokenise(docs, tokenizer_path, window, text, doc_id, end_id), "pack")
    counts = rows.groupBy("pid", "rem").agg(F.count("*").alias("n"))
    by_task = materialise(counts, "pack-counts")
    histogram = np.zeros(window, np.int64)
    for r in by_task.groupBy("rem").agg(F.sum("n").alias("n")).collect():  # window rows at most
        histogram[r["rem"]] = r["n"]
    n_full = rows.agg(F.coalesce(F.sum("n_full"), F.lit(0)).alias("n")).first()["n"]
    allotted, left, planned = plan(histogram, window)
    base = np.zeros(window, np.int64)  # where each length's leftover pieces begin in the greedy run
    order = np.arange(window - 1, 0, -1)
    base[order] = np.concatenate(([0], np.cumsum(left[order] * order)[:-1])) if len(order) else 0
    total = int((left * np.arange(window)).sum())
    greedy_first = n_full + planned
    edge = borders(total, window)

    # offsets of the tasks: by length, and of whole windows; a row for each task (and length)
    before = Window.partitionBy("rem").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("pid", "rem", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rem_base"))
    tasks = rows.groupBy("pid").agg(F.sum("n_full").alias("k"))
    ahead = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("pid", F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias("full_base"))

    slim = rows.drop("rem_ids")
    whole = (
        slim.where(F.col("n_full") > 0)
        .join(tasks, "pid")
        .select("doc_id", F.posexplode("full_crcs").alias("j", "ids_crc32"), "doc_tokens", (F.col("full_base") + F.col("full_before")).alias("s0"))
        .select(
            "doc_id", (F.col("j") * F.lit(window)).cast("long").alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("s0") + F.col("j")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
        )
    )
    ranked = slim.where(F.col("rem") > 0).join(offsets, ["pid", "rem"]).withColumn("g", F.col("rem_base") + F.col("rem_rank")).withColumn("start", F.col("n_full") * F.lit(window))

    # the plan: a row for each length, a slot for each combination that is used, whatever the corpus
    per = {}
    for r in allotted:
        per.setdefault(r["rem"], []).append((r["first"], r["count"], r["times"], n_full + r["sequence"], r["at"]))
    plan_schema = "rem int, slots array<struct<first: bigint, count: bigint, times: bigint, sequence: bigint, at: bigint>>, planned bigint, run bigint"
    slots = spark.createDataFrame([(v, per.get(v, []), int(histogram[v] - left[v]), int(base[v])) for v in range(1, window) if histogram[v]], plan_schema)
    placed = ranked.join(F.broadcast(slots), "rem")
    slot = F.get(F.filter("slots", lambda s: (F.col("g") >= s["first"]) & (F.col("g") < s["first"] + s["count"])), 0)
    fitted = (
        placed.where(F.col("g") < F.col("planned"))
        .withColumn("s", slot)
        .withColumn("i", F.col("g") - F.col("s.first"))
        .select(
            "doc_id",
            "start",
            F.col("rem").cast("long").alias("length"),
            F.col("rem_crc").alias("ids_crc32"),
            "doc_tokens",
            (F.col("s.sequence") + F.expr("i div s.times")).alias("sequence_id"),
            (F.col("s.at") + F.col("i") % F.col("s.times") * F.col("rem")).alias("offset"),
        )
    )
    run_at = F.col("run") + (F.col("g") - F.col("planned")) * F.col("rem")
    rest = placed.where(F.col("g") >= F.col("planned")).select("pid", "row", "doc_id", "start", "rem", "doc_tokens", run_at.alias("p")).join(rows.select("pid", "row", "rem_ids"), ["pid", "row"]).drop("pid", "row")
    names = [c.split(" ")[0] for c in PIECES.split(", ")]

    def cut(batches):
        tail = int(edge[0])
        for batch in batches:  # of Arrow, where a null doesn't turn the other numbers into floats
            out = []
            for d, start, rem, tokens, p, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "rem", "doc_tokens", "p", "rem_ids")), strict=True):
                a = p
                while a < p + rem:
                    if a < tail:
                        k, first = a // window, a // window * window
                        end = first + window
                    else:
                        i = int(np.searchsorted(edge, a, "right")) - 1
                        k, first, end = tail // window + i, int(edge[i]), int(edge[i + 1])
                    b = min(end, p + rem)
                    out.append((d, start + a - p, b - a, zlib.crc32(ids[4 * (a - p) : 4 * (b - p)]), tokens, greedy_first + k, a - first))
                    a = b
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names)

    return whole.unionByName(fitted).unionByName(rest.mapInArrow(cut, PIECES))


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence: its length, number of pieces and padding (none at a power of two)."""
    size = F.sum("length")
    power = F.bit_count(size) == 1
    return pieces.groupBy("sequence_id").agg(size.alias("length"), F.count("*").alias("n_pieces"), F.when(power, 0).otherwise(F.lit(WINDOW) - size).alias("padding"))
