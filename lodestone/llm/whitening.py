"""Embedding whitening: identical vectors are one weighted row of the fit, and each is whitened once.

A vector c becomes the integers x = floor(64 * c) + 1000000.  Rows are grouped by x,
which leaves each distinct vector once with its multiplicity; the fit weighs a
distinct vector by one or by that count.  Sums are exact.  The covariance is a
weighted matrix product of x - S/n, centred before multiplying, that each task adds
up for its own rows; what reaches the driver are d x d numbers, whatever the number
of rows, of which the eigenvectors are taken there.  The distinct vectors are whitened
and joined back to their rows by x.

Vectors that many rows share are few and make a hot key: those with more than a
256th of all rows (255 at most) are joined by broadcast, the others by a shuffle.

Defined results: rows whose vector is null, empty or holds null, NaN or infinite entries
take no part, nor do entries that a long can't hold once they are multiplied.  All vectors
of a fit have one length: the one that most rows have (ties: the smaller); other rows take no part.
Rows that repeat, also by number, each get their result; a null number is carried.  A component without variance
has a null ``whitened`` and doesn't count in ``identity_error``, which is null if none has.  ``deviation`` is null where the
exact value is beyond a long.  An empty table gives no rows.  Columns that are not kept may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import materialise, ship

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 16
#: Numbers that a kernel takes at a time.
BLOCK = 1 << 18
#: Entries beyond this don't fit into a long once they are multiplied and shifted.
LARGEST = float(1 << 56)


def lattice(vector: Column) -> Column:
    """The integers of a vector, null if it takes no part."""
    d = F.transform(vector, lambda c: c.cast("double"))
    usable = (F.size(vector) > 0) & F.forall(d, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return F.when(usable, F.transform(d, lambda c: F.floor(c * SCALE).cast("long") + SHIFT))


def _rows(array: pa.Array, d: int):
    """Blocks of rows of a list column as (first, integers)."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    flat = np.asarray(array.flatten()).reshape(len(array), d)
    step = max(1, BLOCK // d)
    for a in range(0, len(flat), step):
        yield a, flat[a : a + step]


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """(x, m): each distinct vector of ``rows`` (with a column x) and how many rows have it."""
    return rows.groupBy("x").agg(F.count("*").alias("m"))


@dataclass
class Whitening:
    n: int
    sums: list[int]
    eigenvalues: np.ndarray
    vectors: np.ndarray  # d x components
    trace: float
    covariance: np.ndarray

    @property
    def usable(self) -> np.ndarray:
        """Components that have variance, beyond what rounding makes of none."""
        e = self.eigenvalues
        return e > (e.max(initial=0.0) * len(self.sums) * 1e-15)


def _weight(m: np.ndarray, weights: str) -> np.ndarray:
    return m.astype(np.int64) if weights == "counts" else np.ones(len(m), np.int64)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n with one rounding: the difference is exact in whole numbers."""
    return (x.astype(np.int64) * n - sums) / float(n) if _fits(x, n, sums) else np.array([[(int(v) * n - int(s)) / n for v, s in zip(r, sums, strict=True)] for r in x], float).reshape(x.shape)


def _fits(x: np.ndarray, n: int, sums: np.ndarray) -> bool:
    big = max(float(np.abs(x).max(initial=0)) * n, max((abs(float(s)) for s in sums), default=0.0))
    return big < 2.0**61


def _longs(values) -> np.ndarray:
    """As 64-bit integers where all fit, as Python's otherwise."""
    return np.array(values, np.int64 if all(abs(v) < 2**62 for v in values) else object)


def _products(table: DataFrame, column: str, kind: str, d: int, centre, weight: str | None) -> np.ndarray:
    """Sum over rows of weight * a aT, with a = centre(row): each task adds up its own rows, then entries are summed."""
    i, j = np.triu_indices(d)

    def run(batches):
        tk.begin()
        total = np.zeros((d, d))
        for batch in batches:
            w = _weight(np.asarray(batch.column(1)), weight or "one")
            for a, x in _rows(batch.column(0), d):
                c = centre(x)
                total += (c * w[a : a + len(x), None]).T @ c
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "v"])

    got = table.select(F.col(column).cast(kind), "m").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # d x d numbers
    out = np.zeros((d, d))
    out[np.asarray(got.column("i")), np.asarray(got.column("j"))] = np.asarray(got.column("v"))
    return np.triu(out) + np.triu(out, 1).T


def _sums(table: DataFrame, d: int, weights: str) -> tuple[int, list[int]]:
    """Total weight and exact sums by dimension."""

    def run(batches):
        tk.begin()
        n, total = 0, [0] * d
        for batch in batches:
            w = _weight(np.asarray(batch.column(1)), weights)
            n += int(w.sum())
            for a, x in _rows(batch.column(0), d):
                wide = float(np.abs(x).max(initial=0)) * float(w[a : a + len(x)].sum()) < 2.0**62
                part = (x * w[a : a + len(x), None]).sum(0) if wide else (x.astype(object) * w[a : a + len(x), None].astype(object)).sum(0)
                total = [t + int(p) for t, p in zip(total, part, strict=True)]
        yield pa.RecordBatch.from_pydict({"i": list(range(-1, d)), "v": [str(v) for v in (n, *total)]}, pa.schema([("i", pa.int32()), ("v", pa.string())]))

    got = table.select("x", "m").mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()  # d + 1 rows
    by = {r["i"]: int(r["v"]) for r in got}
    return by[-1], [by[i] for i in range(d)]


def fit(table: DataFrame, weights: str = "one", components: int = COMPONENTS) -> Whitening | None:
    """Of (x, m), all of one length; None without rows.  ``weights``: "one" for each distinct vector, or their "counts"."""
    ship(table.sparkSession)
    first = table.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first["d"]
    n, sums = _sums(table, d, weights)
    s = _longs(sums)
    v = _products(table, "x", "array<bigint>", d, lambda x: _centred(x, n, s), weights) / n
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[: min(components, d)]
    u = u[:, order]
    u = u * np.where(np.take_along_axis(u, np.abs(u).argmax(0)[None], 0)[0] < 0, -1.0, 1.0)  # either sign will do: the largest entry is positive
    return Whitening(n, sums, np.maximum(e[order], 0.0), u, float(np.trace(v)), v)


def whiten(table: DataFrame, model: Whitening, weights: str = "one") -> DataFrame:
    """(x, m, deviation, whitened array): each distinct vector once."""
    spark = table.sparkSession
    d, n, k = len(model.sums), model.n, model.vectors.shape[1]
    s, ok = _longs(model.sums), model.usable
    scaled = spark.sparkContext.broadcast(model.vectors / np.where(ok, np.sqrt(np.where(ok, model.eigenvalues, 1.0)), np.nan))  # d x components

    def deviation(x: np.ndarray) -> list:
        if _fits(x, n, s):
            off = x.astype(np.int64) * n - s
            small = (off.astype(float) ** 2).sum(1) < 2.0**62
            out: list = (off * off).sum(1).tolist()
            for i in np.flatnonzero(~small):
                out[i] = sum(int(v) ** 2 for v in off[i])
        else:
            out = [sum((int(v) * n - int(t)) ** 2 for v, t in zip(r, s, strict=True)) for r in x]
        return [v if v < 2**63 else None for v in out]

    def run(batches):
        tk.begin()
        for batch in batches:
            dev, white = [], []
            for _, x in _rows(batch.column(0), d):
                dev += deviation(x)
                white.append(_centred(x, n, s) @ scaled.value)
            w = np.concatenate(white) if white else np.zeros((0, k))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.ravel(), from_pandas=True))  # nan is null
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dev, pa.int64()), lists], ["x", "m", "deviation", "w"])

    return table.select("x", "m").mapInArrow(run, "x array<bigint>, m bigint, deviation bigint, w array<double>")


def identity_error(whitened: DataFrame, model: Whitening, weights: str = "one") -> float | None:
    """Largest entry of the covariance of what ``whiten`` returned (written and read again) minus the identity, as measured."""
    use = np.flatnonzero(model.usable)
    if not len(use):
        return None
    w = F.col("m").cast("double") if weights == "counts" else F.lit(1.0)
    mean = whitened.agg(*(F.sum(F.get("w", F.lit(int(i))) * w / model.n).alias(f"c{i}") for i in use)).first()
    centre = np.array(mean, float)
    picked = whitened.select(F.array(*(F.get("w", F.lit(int(i))) for i in use)).alias("w"), "m")
    cov = _products(picked, "w", "array<double>", len(use), lambda x: x - centre, weights)
    return float(np.abs(cov / model.n - np.eye(len(use))).max())


def whitened_rows(rows: DataFrame, vector: str = "embedding", keep: tuple[str, ...] = ("vec_id",), weights: str = "one", components: int = COMPONENTS) -> DataFrame:
    """A row for each row that takes part and each component: ``keep``, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    outputs = ("component", "n", "deviation", "whitened", "explained", "identity_error")
    keep = tuple(c for c in keep if c not in outputs)
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in outputs[3:])])
    carried = F.struct(*keep).alias("k") if keep else F.lit(0).alias("k")
    usable = rows.select(carried, lattice(F.col(vector)).alias("x")).where(F.col("x").isNotNull())
    lengths = usable.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "d").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    usable = usable.where(F.size("x") == lengths["d"])
    table = materialise(distinct_vectors(usable), "vectors")
    model = fit(table, weights, components)
    white = materialise(whiten(table, model, weights), "whitened")
    error = identity_error(white, model, weights)
    known = white.select("x", "m", "deviation", "w")
    hot = known.where(F.col("m") * 256 > lengths["rows"])  # fewer than 256, as each has more than a 256th of the rows
    by_broadcast = usable.join(F.broadcast(hot), "x").select("k", "deviation", "w")
    by_shuffle = usable.join(F.broadcast(hot.select("x")), "x", "left_anti").join(known.where(F.col("m") * 256 <= lengths["rows"]), "x").select("k", "deviation", "w")
    explained = [float(e) / model.trace if model.trace > 0 else None for e in model.eigenvalues]
    out = by_broadcast.unionByName(by_shuffle).select("k", "deviation", F.posexplode("w").alias("at", "whitened"))
    of = F.array(*(F.lit(v).cast("double") for v in explained))
    return out.select(
        *(F.col("k")[c].alias(c) for c in keep), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(of, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
