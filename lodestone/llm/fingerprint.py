"""Document fingerprints: bottom-k sketches of word shingles; DataFrame functions only.

A sketch is the sorted array of the ``K`` smallest 64-bit hashes of a text's
distinct shingles of five words (runs without white space).  A text of one to
four words has one shingle, of all its words; one without words has an empty
sketch.  Sketches of parts merge into the sketch of their union, and estimate
resemblance, containment and the number of distinct shingles.

Defined results: null text counts as empty; two empty sketches have likeness 1,
an empty and another 0; rows are kept one for one, those of one doc_id in the order of
their texts and those without one last; columns not named play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

K = 128
WORDS = 5


def _let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), 0)


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """Hashes of every ``words`` words in a row, repeated ones included."""
    tokens = F.filter(F.split(text, r"\s+"), lambda w: w != "")

    def of(h: Column) -> Column:
        size = F.greatest(F.size(h) - (words - 1), F.lit(1))
        run = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.xxhash64(*(F.coalesce(F.get(h, i + j), F.lit(0).cast("bigint")) for j in range(words))))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(run)

    return _let(F.transform(tokens, lambda w: F.xxhash64(w)), of)


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The ``k`` smallest distinct shingle hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, words))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, keys: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """Sketch of each group's union: distinct hashes, then the ``k`` smallest, without gathering a group in one place."""
    hashes = df.select(*keys, F.explode(column).alias("__h")).distinct()
    groups = 64  # first within salted parts of the group, then among k hashes a part
    part = counted = hashes.withColumn("__p", F.pmod("__h", F.lit(groups)))
    for by in ([*keys, "__p"], keys):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("__h"))
        counted = part.withColumn("__r", rank).where(F.col("__r") <= k).drop("__r")
        part = counted
    return counted.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the sketched sets (0 to 1)."""

    def of(u: Column) -> Column:
        return F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u))

    return _let(merge(a, b, k), of)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else (k-1) over the share of hash space below the k-th."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has (0 to 1); 1 if a has none."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """Sixteen hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, columns: dict[str, str], doc_id: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Each row with columns of the next one by descending ``doc_id`` (after the last: the first).

    Rows are dealt into ranges of ``doc_id`` whose number grows with them (at most 8,192); the first row of a range is
    also sent to the range above, so that one exchange of the rows is enough.  Rows of one doc_id
    are ordered by the first of ``columns``; null numbers come last.
    """
    spark = docs.sparkSession
    parts = parts or min(8192, max(4, docs.count() // 2500))
    wanted = [i / parts for i in range(1, parts)]
    ids = docs.select(F.col(doc_id).cast("long").alias("d"))
    cuts = sorted(set(ids.agg(F.percentile_approx("d", wanted, 10_000).alias("c")).first()["c"] or []))
    lit = lambda v: F.array(*[F.lit(x).cast("long") for x in v]) if v else F.array().cast("array<bigint>")
    place = lambda d: F.coalesce(F.size(F.filter(lit(cuts), lambda c: c <= d)), F.lit(0)) if cuts else F.lit(0)
    known = lambda d: F.when(d.isNull(), F.lit(0)).otherwise(place(d))
    top = {r["b"]: r["m"] for r in ids.groupBy(known(F.col("d")).alias("b")).agg(F.max("d").alias("m")).collect()}  # a row for each range
    full = sorted(top)
    above = {b: full[(i + 1) % len(full)] for i, b in enumerate(full)}  # the highest range's first row follows the lowest range
    size = (full[-1] + 1) if full else 1
    tops, targets = lit([top.get(b) if top.get(b) is not None else -(1 << 62) for b in range(size)]), lit([above.get(b, -1) for b in range(size)])
    names = list(columns)
    d = F.col("__d")
    rows = docs.withColumn("__d", F.col(doc_id).cast("long")).withColumn("__own", known(d))
    heads = F.when(F.coalesce(d, F.lit(-(1 << 62))) == F.get(tops, F.col("__own")), F.array(F.struct(F.get(targets, F.col("__own")).cast("int").alias("b"), F.lit(1).alias("ghost")))).otherwise(F.array().cast("array<struct<b:int,ghost:int>>"))
    rows = rows.withColumn("__to", F.explode(F.concat(F.array(F.struct(F.col("__own").cast("int").alias("b"), F.lit(0).alias("ghost"))), heads)))
    rows = rows.withColumn("__b", F.col("__to.b")).withColumn("__ghost", F.col("__to.ghost")).drop("__to", "__own")
    order = Window.partitionBy("__b").orderBy("__ghost", F.col("__d").desc_nulls_last(), F.col(columns[names[0]]).asc_nulls_first())
    for new, old in columns.items():
        rows = rows.withColumn(new, F.lead(old).over(order))
    return rows


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = K) -> DataFrame:
    """doc_id, n_chars, edited text and both sketches, and their likeness to each other and to the next document's."""
    base = docs.select(F.col(doc_id), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    rows = with_next(base, {"__next": "__text"}, doc_id)
    order = Window.partitionBy("__b").orderBy("__ghost", F.col("__d").desc_nulls_last(), F.col("__text").asc_nulls_first())
    n = F.length("__text")
    half = F.floor(n / 2).cast("int")
    rows = (
        rows.withColumn("sketch", sketch(F.col("__text"), k))
        .withColumn("__next_sketch", F.lead("sketch").over(order))
        .where(F.col("__ghost") == 0)
        .withColumn("n_chars", n.cast("long"))
        .withColumn("edited", F.concat(F.substring(F.col("__text"), F.lit(1), n - half), F.substring(F.col("__next"), F.lit(1), half)))
        .withColumn("edited_sketch", sketch(F.col("edited"), k))
    )
    return rows.select(doc_id, "n_chars", "edited", "sketch", "edited_sketch", resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("__next_sketch"), k).alias("near_next"))


def digests(rows: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return rows.select(doc_id, "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")
