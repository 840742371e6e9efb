"""Nearest neighbours by multi-index hashing over learned rotated binary codes.

Rotations that make signs lose little (iterative quantisation on principal
components) are learned, from two starts or more until there are 128 bits, on a
bounded sample of the vectors; the signs of all rotations together are a vector's
code.  Codes are split into substrings of eight bits and every substring is indexed
by value.  A code within Hamming radius r of a query agrees with it up to
r // (number of substrings) bits in at least one substring (pigeonhole), so probing
all values that near in every index finds every code within r.  The radius is a
share of the code's length.  Those found are reranked by exact cosines in double
precision.  A radius that holds fewer than k codes grows until it does.

Every row is indexed.  Rows are dealt into blocks of bounded size, which have an
index each, and the stated queries visit all of them; queries beyond one part's
bound are further parts.  A block sends at most k rows a query on, so equal vectors,
however many, need no room.

Defined results: null or repeated ids, null vectors, null, NaN or infinite
components, zero vectors and vectors of another dimension than most take no part
(of rows with one id the smallest vector does); a query never returns its own id; ties
go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import materialise, ship

#: Vectors the rotations are learned from at most.
SAMPLE = 20_000
BITS, ROUNDS = 128, 30
RADIUS = 0.46  # of the code's bits
#: Bytes of the vectors of a block of rows and of a part of the queries, as doubles.
ROW_BYTES, QUERY_BYTES = 32 << 20, 32 << 20
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_NEAR = _POP[np.arange(256)[:, None] ^ np.arange(256)]  # distance of two substrings


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v): one row for each id whose vector takes part."""
    v = F.col(vector)
    if df.schema[vector].dataType.simpleString() != "array<float>":
        v = v.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & fine)
    common = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "n").first()
    if common is None:
        return rows
    return rows.where(F.size("v") == common["n"]).groupBy("vec_id").agg(F.min("v").alias("v"))


def learn(rows: DataFrame, sample: int = SAMPLE, seed: int = 7) -> np.ndarray:
    """Directions (dimension + 1, bits): the last row is the offset.  From ``sample`` rows chosen by the hash of their id."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    got = got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got
    if not len(got):
        return np.zeros((1, 0))
    x = np.asarray(got.flatten(), np.float64).reshape(len(got), -1)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(0)
    _, axes = np.linalg.eigh(np.cov(x - mean, rowvar=False, bias=True).reshape(x.shape[1], -1))
    axes = axes[:, ::-1]
    y, rng, out = (x - mean) @ axes, np.random.default_rng(seed), []
    for _ in range(max(2, -(-BITS // x.shape[1]))):
        r = np.linalg.qr(rng.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(ROUNDS if x.shape[1] <= 256 else 5):
            u, _, w = np.linalg.svd(np.sign(y @ r).T @ y)
            r = (u @ w).T
        out.append(axes @ r)
    d = np.concatenate(out, 1)
    bits = d.shape[1] // 8 * 8 or d.shape[1]
    return np.concatenate((d, -(mean @ d)[None]))[:, :bits]


def codes(v: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Packed codes, a byte for each substring."""
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    return np.packbits(unit @ directions[:-1] + directions[-1] > 0, axis=1)


def _words(code: np.ndarray) -> np.ndarray:
    """Codes as 64-bit words."""
    wide = np.zeros((len(code), -(-code.shape[1] // 8) * 8), np.uint8)
    wide[:, : code.shape[1]] = code
    return wide.view(np.uint64)


class MultiIndex:
    """Rows of a block by the value of each substring of their codes."""

    def __init__(self, code: np.ndarray):
        self.code, self.words = code, _words(code)
        self.order = [np.argsort(c, kind="stable") for c in code.T]
        self.start = [np.searchsorted(c[o], np.arange(257)) for c, o in zip(code.T, self.order, strict=True)]
        self.near: dict[tuple[int, int, int], np.ndarray] = {}

    def probe(self, s: int, value: int, bits: int) -> np.ndarray:
        """Rows whose substring ``s`` is within ``bits`` of ``value``."""
        key = (s, value, bits)
        if key not in self.near:
            o, b = self.order[s], self.start[s]
            hits = [o[b[v] : b[v + 1]] for v in np.flatnonzero(_NEAR[value] <= bits)]
            found = np.zeros(len(self.code), bool)
            found[np.concatenate(hits) if hits else o[:0]] = True
            self.near[key] = np.packbits(found)
        return self.near[key]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Every row within ``radius`` of ``code``."""
        found = np.zeros(-(-len(self.code) // 8), np.uint8)
        for s, value in enumerate(code.tolist()):
            found |= self.probe(s, value, radius // len(code))
        rows = np.flatnonzero(np.unpackbits(found, count=len(self.code)))
        return rows[np.bitwise_count(self.words[rows] ^ _words(code[None])).sum(1, dtype=np.int64) <= radius]


def _search(directions: np.ndarray, k: int, radius: float):
    names = ["query_id", "vec_id", "score"]
    empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def dense(t: pa.Table) -> np.ndarray:
        c = t.column("v").combine_chunks()
        return np.asarray(c.flatten(), np.float64).reshape(len(c), -1)

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return empty
        rows = rows.sort_by("vec_id")
        ids, x, qids, q = np.asarray(rows.column("vec_id")), dense(rows), np.asarray(queries.column("vec_id")), dense(queries)
        index, qcode = MultiIndex(codes(x, directions)), codes(q, directions)
        norm, qnorm = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
        least = min(k + 1, len(ids))
        out = []
        for i, qid in enumerate(qids.tolist()):
            r = int(radius * qcode.shape[1] * 8)
            near = index.within(qcode[i], r)
            while len(near) < least:
                r += 8
                near = index.within(qcode[i], r)
            near = near[ids[near] != qid]
            score = (x[near] * q[i]).sum(1) / (norm[near] * qnorm[i])  # row by row, so that equal vectors have equal scores
            best = np.argsort(-score, kind="stable")[:k]  # rows are in order of id
            out.append((np.full(len(best), qid), ids[near[best]], score[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    return run


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, radius: float = RADIUS, directions: np.ndarray | None = None, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows by cosine."""
    spark = df.sparkSession
    ship(spark)
    rows = materialise(usable(df, vec_id, vector), "vectors")
    asked = usable(queries, vec_id, vector)
    directions = learn(rows) if directions is None else directions
    n, m, each = rows.count(), asked.count(), 8 * max(1, len(directions) - 1)
    blocks, parts = max(8, -(-n * each // ROW_BYTES)), max(1, -(-m * each // QUERY_BYTES))
    deal = lambda parts, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(parts)).cast("int")
    left = asked.withColumn("part", deal(parts, 0)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = rows.withColumn("block", deal(blocks, 1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(_search(directions, k, radius), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
