"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else becomes one space, and the n-grams of 1
to 4 characters of that are hashed into ``buckets`` counts.  Training sums the
counts of every labelled row by language; tasks add up their own rows first, so
what is shuffled is a row per task, language and bucket met.  The log-probability
matrix (languages x buckets, a fixed size) is broadcast, and documents are scored
in batches: each n-gram fetches its row of the matrix, rows are summed by
document.

Defined results: null text, or text without a letter, is ``und`` with score 0;
so is every text if no row was labelled.  Rows are kept one for one; ties go to the
language that sorts first.  Columns with the name of an output are replaced by it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import fresh, ship

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
UNDETERMINED = "und"
SMOOTHING = 0.5
#: Numbers of the matrix at most: beyond 512 languages the buckets are halved until they fit, and no language is left out.
MATRIX = 512 << 16
#: n-grams that count as independent evidence in a score; longer texts are not more certain than that.
EVIDENCE = 60.0


def letters_only(text: Column) -> Column:
    """Lower-cased runs of letters, one space between and around."""
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), r"[^\p{L}]+", " ")


def _ngrams(cps: np.ndarray, at: np.ndarray, buckets: int):
    """For each order: buckets of the n-grams of all documents and each document's offsets among them."""
    c = cps.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(len(c), np.uint64)
        shift = np.uint64(64 - (buckets.bit_length() - 1))
        sizes = np.diff(at)
        for n in range(1, max(ORDERS) + 1):
            h = (h[: len(c) - n + 1] if n > 1 else h) * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :] + np.uint64(1)
            if len(h) == 0:
                return
            if n not in ORDERS:
                continue
            b = ((h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> shift).astype(np.int32)
            if n == 1:
                yield b, at
                continue
            inside = np.ones(len(b), bool)  # n-grams that do not reach into the next document
            borders = at[1:-1]
            for k in range(1, n):
                x = borders - k
                inside[x[(x >= 0) & (x < len(b))]] = False
            off = np.zeros(len(at), np.int64)
            np.cumsum(np.maximum(sizes - n + 1, 0), out=off[1:])
            if int(inside.sum()) != off[-1]:  # documents shorter than n
                doc = np.repeat(np.arange(len(sizes)), sizes)[: len(b)]
                inside = doc == np.repeat(np.arange(len(sizes)), sizes)[n - 1 :]
            yield b[inside], off


def train(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities (languages x buckets, float32) from all rows with text and language."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(letters_only(F.col(text)).alias("t"), F.col(lang).cast("string").alias("l"))
    n_langs = rows.select("l").distinct().count()
    while n_langs * buckets > MATRIX and buckets > 256:
        buckets //= 2

    def count(batches):
        tk.begin()
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            for a, b, raw, offsets in tk.chunks(batch.column(0)):
                if not len(raw):
                    continue
                cps, at = tk.code_points(raw, offsets)
                names, which = np.unique(langs[a:b], return_inverse=True)
                for grams, off in _ngrams(cps, at, buckets):
                    owner = np.repeat(which, np.diff(off))
                    n = np.bincount(owner * buckets + grams, minlength=len(names) * buckets).reshape(len(names), buckets)
                    for i, name in enumerate(names):
                        held[name] = held[name] + n[i] if name in held else n[i].copy()
        for name, n in held.items():
            met = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(met)), pa.array(met.astype(np.int32)), pa.array(n[met])], ["lang", "bucket", "n"])

    counts = rows.mapInArrow(tk.released(count), "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()  # languages x buckets numbers at most
    names = sorted(set(got.column("lang").to_pylist()))
    matrix = np.full((len(names), buckets), SMOOTHING)
    if names:
        row = np.searchsorted(names, got.column("lang").to_pylist())
        matrix[row, np.asarray(got.column("bucket"))] += np.asarray(got.column("n"))
    return names, np.log(matrix / matrix.sum(1, keepdims=True)).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text", keep: tuple[str, ...] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns (all, by default) with ``names``: language and score (0 to 1: the posterior, with bounded evidence)."""
    spark = docs.sparkSession
    ship(spark)
    keep = tuple(c for c in (docs.columns if keep is None else keep) if c not in names)
    outputs = names
    names, matrix = model
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(matrix.T))  # a row for each bucket
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(outputs[0], T.StringType()), T.StructField(outputs[1], T.DoubleType())])
    buckets = matrix.shape[1]

    def run(batches):
        tk.begin()
        logp = shared.value
        for batch in batches:
            cols = batch.columns
            for a, b, raw, offsets in tk.chunks(cols[-1]):
                n = b - a
                total, seen = np.zeros((n, max(1, len(names)))), np.zeros(n)
                if len(raw) and names:
                    cps, at = tk.code_points(raw, offsets)
                    for grams, off in _ngrams(cps, at, buckets):
                        full = np.flatnonzero(np.diff(off) > 0)
                        if len(full):
                            total[full] += np.add.reduceat(logp[grams], off[full], axis=0, dtype=np.float64)
                            seen += np.diff(off)
                letters = np.diff(offsets) > 1  # more than the one space
                mean = total / np.maximum(seen, 1)[:, None] * np.minimum(seen, EVIDENCE)[:, None]
                best = mean.argmax(1)
                score = 1 / np.exp(mean - mean.max(1, keepdims=True)).sum(1)
                known = letters & bool(names)
                pred = [names[k] if ok else UNDETERMINED for k, ok in zip(best.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, n) for c in cols[:-1]), pa.array(pred, pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))], schema.fieldNames())

    return docs.select(*keep, letters_only(F.coalesce(F.col(text), F.lit(""))).alias(fresh(docs, "__letters"))).mapInArrow(tk.released(run), schema)


def held_out(doc_id: Column) -> Column:
    """crc32 of the number as text, modulo 4, is 2; false for a null number."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_and_predict(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Trained on the rows that are not held out, applied to all."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.withColumn("held_out", held_out(F.col("doc_id"))), model, keep=(*(c for c in keep if c != "held_out"), "held_out"))
