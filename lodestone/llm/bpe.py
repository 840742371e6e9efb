"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Distinct words of the corpus (matches of the vocabulary's pattern) are counted
first.  The most frequent, at most ``max_dictionary`` of them, are encoded by a
Spark higher-order fold: their byte arrays become arrays of byte ranks, and
``aggregate`` merges the leftmost pair of lowest rank until no pair has a rank.
The rank map is a literal: two arrays that hold every mergeable pair at one of
two hashed places, so that a lookup reads two elements.  The encoded words, of
bounded number, are broadcast; one pass over the documents replaces words by
their ids.  Words outside the dictionary are merged in that pass by the same
rule, many words at a time.  Texts are never shuffled, and no result depends on
which words the dictionary holds.

Defined results: a null or empty text has no ids and decodes to no bytes; rows
are kept one for one, repeated rows included; other columns are carried through if
named in ``keep``, but for those that have the name of an output, which takes their place.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import materialise, ship

#: Words that the broadcast dictionary holds at most, and bytes of a word in it at most.
MAX_DICTIONARY = 1 << 18
MAX_WORD_BYTES = 48
NO_RANK = 1 << 20  # ranks are below
_LONG = 2000  # bytes from which one word is merged with a heap


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def mergeable_pairs(ranks: dict[bytes, int]) -> np.ndarray:
    """Rows (left rank, right rank, rank) of all pairs of tokens whose bytes together are a token."""
    out = []
    for token, r in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                out.append((a, b, r))
    return np.array(out, np.int64).reshape(-1, 3)


# --- the fold in Spark -----------------------------------------------------

_H = ((40503, 7919), (12289, 52711))


def _two_places(pairs: np.ndarray) -> tuple[list[list], int]:
    """Every pair stands in one of two arrays, each at its hashed place."""
    bits = max(4, int(len(pairs)).bit_length())
    while True:
        mask = (1 << bits) - 1
        tables: list[dict] = [{}, {}]
        for pair in map(tuple, pairs.tolist()):
            k = 0
            for _ in range(1000):
                c = _H[k]
                slot = (pair[0] * c[0] + pair[1] * c[1]) & mask
                old = tables[k].get(slot)
                tables[k][slot] = pair
                if old is None:
                    break
                pair, k = old, 1 - k
            else:
                break
        else:
            out = []
            for t in tables:
                a: list = [None] * (mask + 1)  # null where no pair stands
                for slot, (x, y, r) in t.items():
                    a[slot] = x << 40 | y << 20 | r
                out.append(a)
            return out, mask
        bits += 1


def fold_words(word_bytes: Column, ranks: dict[bytes, int]) -> Column:
    """Ids (array<bigint>) of a word given as the array of its byte values; empty for an empty array."""
    tables, mask = _two_places(mergeable_pairs(ranks))
    lit = lambda a: F.from_json(F.lit(json.dumps(a, separators=(",", ":"))), "array<bigint>")
    places, single = [lit(t) for t in tables], lit([ranks[bytes([i])] for i in range(256)])
    big = lambda x: F.lit(x).cast("bigint")
    let = lambda value, f: F.get(F.transform(F.array(value), f), 0)

    def pair_rank(a: Column, b: Column) -> Column:
        key = F.shiftleft(a, 40).bitwiseOR(F.shiftleft(b, 20))
        at = [(a * big(c) + b * big(d)).bitwiseAND(big(mask)).cast("int") for c, d in _H]
        return F.least(big(NO_RANK), *(F.get(t, i).bitwiseXOR(key) for t, i in zip(places, at, strict=True)))  # nulls are skipped

    def merged(p: Column) -> Column:
        """``p`` after one merge, or null if no pair has a rank; a rank and its place are found as one number."""
        ranked = F.transform(p, lambda x, i: F.shiftleft(pair_rank(x, F.get(p, i + 1)), 20).bitwiseOR(i.cast("bigint")))
        return let(
            F.array_min(F.filter(ranked, lambda v: v < (NO_RANK << 20))),
            lambda best: F.when(
                best.isNotNull(),
                let(
                    best.bitwiseAND(big((1 << 20) - 1)).cast("int"),
                    lambda i: F.concat(F.slice(p, F.lit(1), i), F.array(F.shiftright(best, 20)), F.slice(p, i + 3, F.size(p))),
                ),
            ),
        )

    def step(state: Column, _: Column) -> Column:
        after = lambda q: F.when(q.isNull(), F.struct(state["ids"].alias("ids"), F.lit(True).alias("done"))).otherwise(F.struct(q.alias("ids"), F.lit(False).alias("done")))
        return F.when(state["done"], state).otherwise(let(merged(state["ids"]), after))

    start = F.transform(word_bytes, lambda b: F.get(single, b.cast("int")))
    turns = F.sequence(F.lit(0), F.size(word_bytes))
    return F.aggregate(turns, F.struct(start.alias("ids"), F.lit(False).alias("done")), step, lambda s: s["ids"])


def byte_values(word: Column) -> Column:
    """Byte values of a binary column, as array<int>."""
    return F.when(F.length(word) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.conv(F.hex(F.substring(word, i, F.lit(1))), 16, 10).cast("int"))
    )


# --- the same rule for many words at a time --------------------------------


class Merger:
    """Merges arrays of byte values by rank; ``fold`` takes many words as one array with offsets."""

    def __init__(self, single: np.ndarray, pairs: np.ndarray):
        self.single = single.astype(np.int64)
        key = pairs[:, 0] << 20 | pairs[:, 1]
        order = np.argsort(key)
        self.key, self.rank = key[order], pairs[order, 2]
        self.index = tk.HashIndex(max(16, len(key)))
        with np.errstate(over="ignore"):
            self.index.add(tk.mix(self.key.astype(np.uint64)))

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            at = self.index.get(tk.mix((a << 20 | b).astype(np.uint64)))
        return np.where(at >= 0, self.rank[at], NO_RANK)  # the mixer is a bijection: equal hashes are equal pairs

    def fold(self, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(offsets) - 1
        sizes = np.diff(offsets)
        done: dict[int, np.ndarray] = {int(i): self._heap(values[offsets[i] : offsets[i + 1]]) for i in np.flatnonzero(sizes > _LONG)}
        keep = np.repeat(sizes <= _LONG, sizes)
        ids = self.single[values[keep]]
        word = np.repeat(np.arange(n), sizes)[keep]
        out_ids, out_word = [], []
        while len(ids):
            rank = np.full(len(ids), NO_RANK, np.int64)
            same = word[:-1] == word[1:]
            rank[:-1][same] = self.pair_ranks(ids[:-1][same], ids[1:][same])
            first = np.flatnonzero(np.concatenate(([True], ~same)))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(ids)), first)
            open_ = (best >> 32) < NO_RANK
            length = np.diff(np.append(first, len(ids)))
            live = np.repeat(open_, length)
            out_ids.append(ids[~live])
            out_word.append(word[~live])
            at = best[open_] & 0xFFFFFFFF
            ids[at] = best[open_] >> 32
            live[at + 1] = False
            ids, word = ids[live], word[live]
        flat = np.concatenate([*out_ids, *done.values()]) if out_ids or done else np.zeros(0, np.int64)
        owner = np.concatenate([*out_word, *(np.full(len(v), k) for k, v in done.items())]) if out_word or done else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        off = np.zeros(n + 1, np.int64)
        np.cumsum(np.bincount(owner.astype(np.int64), minlength=n), out=off[1:])
        return flat[order], off

    def _heap(self, values: np.ndarray) -> np.ndarray:
        """One long word: linked neighbours and a heap of pairs, n log n."""
        ids = self.single[values].tolist()
        n = len(ids)
        nxt, prv = [*range(1, n), -1], [-1, *range(n - 1)]
        table = dict(zip(self.key.tolist(), self.rank.tolist(), strict=True)) if not hasattr(self, "_map") else self._map
        self._map = table
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := table.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        gone = [False] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if gone[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], nxt[i] = r, True, nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for x in (prv[i], i):
                if x >= 0 and nxt[x] >= 0 and (q := table.get(ids[x] << 20 | ids[nxt[x]])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[nxt[x]]))
        return np.array([v for v, g in zip(ids, gone, strict=True) if not g], np.int64)


class Vocabulary:
    """What a task needs: merger, whole-word ranks and the bytes of each id.  Small and of fixed size."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = sorted(ranks, key=ranks.get)
        self.numbers = np.array([ranks[t] for t in tokens], np.int64)
        top = int(self.numbers.max()) + 1
        self.bytes_off = np.zeros(top + 1, np.int64)
        self.bytes_off[self.numbers + 1] = [len(t) for t in tokens]
        np.cumsum(self.bytes_off, out=self.bytes_off)
        self.bytes_val = np.frombuffer(b"".join(tokens), np.uint8)
        self.merger = Merger(np.array([ranks[bytes([i])] for i in range(256)], np.int64), mergeable_pairs(ranks))

    @functools.cached_property
    def whole(self) -> dict[bytes, int]:
        return {self.bytes_val[a:b].tobytes(): int(r) for r in self.numbers for a, b in ((self.bytes_off[r], self.bytes_off[r + 1]),)}

    def encode_words(self, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A word that is a token gets its id at once, as in the library; others are merged."""
        ids, off = self.merger.fold(values, offsets)
        whole = self.whole
        many = np.flatnonzero(np.diff(off) > 1)
        hit = [i for i in many.tolist() if values[offsets[i] : offsets[i + 1]].tobytes() in whole]
        if hit:
            lists = np.split(ids, off[1:-1])
            for i in hit:
                lists[i] = np.array([whole[values[offsets[i] : offsets[i + 1]].tobytes()]])
            off = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
            ids = np.concatenate(lists)
        return ids, off

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Concatenated pieces; offsets of the lists of ids become offsets of bytes."""
        data, at = tk.gather(self.bytes_off, self.bytes_val, ids)
        return data, at[offsets]


def _word_spans(raw, offsets):
    """Code points, starts and ends of the pre-tokens, their hashes, and each document's offsets among them."""
    cps, at = tk.code_points(raw, offsets)
    s = tk.pretokens(cps, at)
    e = np.append(s[1:], len(cps))
    h = tk.span_hashes(cps, s, e) if len(s) else np.zeros(0, np.uint64)
    return cps, s, e, h, np.searchsorted(s, at)


def _bytes_of(raw, cps, s, e, which):
    """Bytes of the spans ``which`` with their offsets."""
    if len(cps) == len(raw):
        bounds = None
        a, b = s[which], e[which]
    else:
        bounds = np.concatenate(([0], np.cumsum(tk.utf8_lengths(cps))))
        a, b = bounds[s[which]], bounds[e[which]]
    off = np.zeros(len(which) + 1, np.int64)
    np.cumsum(b - a, out=off[1:])
    idx = np.repeat(a - off[:-1], b - a) + np.arange(off[-1])
    return raw[idx], off


def _counter(most: int, max_bytes: int):
    """mapInArrow: distinct words of each task with their counts; flushed when ``most`` words are held."""

    def run(batches):
        tk.begin()
        index, counts, pieces = tk.HashIndex(), np.zeros(0, np.int64), []

        def flush():
            often = np.flatnonzero(counts > 1)  # a word met once can't earn a place
            words = [w for p in pieces for w in p]
            return pa.RecordBatch.from_arrays([pa.array([words[i] for i in often], pa.binary()), pa.array(counts[often], pa.int64())], ["word", "n"])

        for batch in batches:
            for _, _, raw, offsets in tk.chunks(batch.column(0)):
                if not len(raw):
                    continue
                cps, s, e, h, _ = _word_spans(raw, offsets)
                u, at, n = np.unique(h, return_index=True, return_counts=True)
                which = index.get(u)
                new = np.flatnonzero(which < 0)
                if len(new):
                    data, off = _bytes_of(raw, cps, s, e, at[new])
                    blob = data.tobytes()
                    pieces.append([blob[a : min(b, a + max_bytes + 1)] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
                    index.add(u[new])
                    which[new] = index.get(u[new])
                    counts = np.concatenate((counts, np.zeros(len(new), np.int64)))
                counts[which] += n
                if index.n > most:
                    yield flush()
                    index, counts, pieces = tk.HashIndex(), np.zeros(0, np.int64), []
        if index.n:
            yield flush()

    return run


def word_counts(texts: DataFrame, text: str = "text", max_bytes: int = MAX_WORD_BYTES) -> DataFrame:
    """(word binary, n) of the corpus' words of at most ``max_bytes`` bytes met more than once in a task."""
    ship(texts.sparkSession)
    return (
        texts.select(F.col(text).cast("string"))
        .mapInArrow(_counter(400_000, max_bytes), "word binary, n bigint")
        .where(F.length("word") <= max_bytes)
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
    )


def dictionary(texts: DataFrame, ranks: dict[bytes, int], text: str = "text", max_dictionary: int = MAX_DICTIONARY) -> DataFrame:
    """(word binary, ids array<int>): the most frequent words, at most ``max_dictionary``, folded in Spark; a word that is a token is that token."""
    # counts are cut off by classes of a sixteenth of a power of two: a small histogram instead of an order over all words
    grade = F.floor(F.log2("n") * 16).cast("int")
    counted = materialise(word_counts(texts, text).withColumn("grade", grade), "word-counts")
    room, whole, part, share = max_dictionary, None, None, 0.0
    for r in sorted(counted.groupBy("grade").agg(F.count("*").alias("k")).collect(), key=lambda r: -r["grade"]):
        if r["k"] > room:
            part, share = r["grade"], max(0.0, room / r["k"] - 0.01)
            break
        room, whole = room - r["k"], r["grade"]
    often = F.lit(False) if whole is None else F.col("grade") >= whole
    some = F.lit(False) if part is None else (F.col("grade") == part) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20)))
    top = counted.where(often | some).select("word")
    # written in as many parts as there are cores: the fold's plan then has no exchange, and its long literal is planned once
    top = materialise(top.repartition(max(8, texts.sparkSession.sparkContext.defaultParallelism)), "bpe-words")
    tokens = pa.table({"word": pa.array(list(ranks), pa.binary()), "id": pa.array(list(ranks.values()), pa.int32())})
    known = F.broadcast(texts.sparkSession.createDataFrame(tokens))  # the vocabulary: of fixed size
    fold = fold_words(byte_values(F.col("word")), ranks).cast("array<int>")
    return top.join(known, "word", "left").select("word", F.when(F.col("id").isNotNull(), F.array("id")).otherwise(fold).alias("ids"))


def _collected(spark, words: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The dictionary, of bounded size, as hashes in ascending order, offsets and ids."""
    limit = spark.conf.get("spark.sql.maxPlanStringLength")
    spark.conf.set("spark.sql.maxPlanStringLength", "20000")  # the rank map is long; plan descriptions are kept by the driver
    try:
        known = words.toArrow()
    finally:
        spark.conf.set("spark.sql.maxPlanStringLength", limit)
    hashes, lists = [], known.column("ids").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    for _, _, raw, offsets in tk.chunks(known.column("word")):
        cps, at = tk.code_points(raw, offsets)
        hashes.append(tk.span_hashes(cps, at[:-1], at[1:]))
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    off = np.asarray(lists.offsets, np.int64) if len(hashes) else np.zeros(1, np.int64)
    val = np.asarray(lists.values, np.int32)
    distinct, one = np.unique(hashes, return_index=True)
    val, off = tk.gather(off, val, one)
    return distinct, off, val


def encode(
    docs: DataFrame, vocabulary_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), max_dictionary: int = MAX_DICTIONARY, digests_only: bool = False
) -> DataFrame:
    """``keep`` columns with n_tokens, ids_sha256, decoded_sha256 and, unless ``digests_only``, ids array<int> and decoded binary."""
    spark = docs.sparkSession
    own = {"n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"}
    keep = tuple(c for c in keep if c not in own)
    ship(spark)
    ranks = load_ranks(vocabulary_path)
    hashes, off, val = _collected(spark, dictionary(docs, ranks, text, max_dictionary))
    shared, run_id = spark.sparkContext.broadcast((Vocabulary(ranks), hashes, off, val)), uuid.uuid4().hex
    kept = [docs.schema[c] for c in keep]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in kept])
    schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if not digests_only:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", "binary")

    def run(batches):
        vocab, h0, o0, v0 = shared.value
        lists = tk.state(("bpe", run_id), lambda: tk.WordLists(h0, o0, v0))
        for batch in batches:
            for a, b, raw, offsets in tk.chunks(batch.column(len(keep))):
                if len(raw):
                    cps, s, e, h, at = _word_spans(raw, offsets)

                    def merge(which, cps=cps, s=s, e=e, raw=raw):
                        ids, off = vocab.encode_words(*_bytes_of(raw, cps, s, e, which))
                        return off, ids

                    ids, woff = lists.lists(h, merge)
                    doc_off = woff[at]
                    data, doc_bytes = vocab.decode(ids, doc_off)
                else:
                    ids, data = np.zeros(0, np.int32), np.zeros(0, np.uint8)
                    doc_off = doc_bytes = np.zeros(b - a + 1, np.int64)
                le, plain = memoryview(ids.astype("<u4").tobytes()), memoryview(data.tobytes())
                sha = hashlib.sha256
                columns = [
                    *(batch.column(i).slice(a, b - a) for i in range(len(keep))),
                    pa.array(np.diff(doc_off), pa.int64()),
                    pa.array([sha(le[4 * x : 4 * y]).hexdigest() for x, y in zip(doc_off[:-1].tolist(), doc_off[1:].tolist(), strict=True)], pa.string()),
                    pa.array([sha(plain[x:y]).hexdigest() for x, y in zip(doc_bytes[:-1].tolist(), doc_bytes[1:].tolist(), strict=True)], pa.string()),
                ]
                if not digests_only:
                    columns.append(pa.ListArray.from_arrays(pa.array(doc_off.astype(np.int32)), pa.array(ids.astype(np.int32))))
                    columns.append(pa.array([bytes(plain[x:y]) for x, y in zip(doc_bytes[:-1].tolist(), doc_bytes[1:].tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    return docs.select(*keep, F.col(text).cast("string")).mapInArrow(run, schema)
