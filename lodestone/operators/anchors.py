"""Chains of anchors: from the first row on, the next anchor is the first row far enough behind the last one.

The successor of every row is found first, by an as-of join on sorted buckets of one distance each, so that a hot key is
dealt over its buckets.  Anchors are then marked by pointer doubling: a round joins the marked rows with their
successors and the successors with theirs, so a chain of n anchors takes log2(n) rounds of joins and no group is
folded in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import materialise


def successors(places: DataFrame, keys: list[str], at: str, gap: float, strict: bool = False) -> DataFrame:
    """(keys, at, next) for distinct (keys, at): the smallest place at least ``gap`` (``strict``: more than it) behind, null if there is none."""
    bucket = lambda x: F.floor(x / gap).cast("long")
    rows = places.select(*keys, F.col(at).alias("p"), bucket(F.col(at)).alias("b"), F.col(at).alias("found"), F.lit(None).cast(places.schema[at].dataType).alias("of"))
    aim = (F.col(at) + gap).cast(places.schema[at].dataType)
    asks = places.select(*keys, aim.alias("p"), bucket(aim).alias("b"), F.lit(None).cast(places.schema[at].dataType).alias("found"), F.col(at).alias("of"))
    # strict: a row at the very place comes before the question, else behind it
    order = Window.partitionBy(*keys, "b").orderBy("p", F.when(F.col("of").isNotNull(), 1 if strict else 0).otherwise(0 if strict else 1))
    here = rows.unionByName(asks).withColumn("here", F.first("found", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))).where(F.col("of").isNotNull())
    # the first row of the next bucket that has one
    starts = rows.groupBy(*keys, "b").agg(F.min("p").alias("start"))
    wanted = here.where("here IS NULL").select(*keys, "b").distinct().withColumn("start", F.lit(None).cast(places.schema[at].dataType)).withColumn("ask", F.lit(True))
    later = Window.partitionBy(*keys).orderBy("b").rangeBetween(1, Window.unboundedFollowing)
    ahead = starts.withColumn("ask", F.lit(False)).unionByName(wanted).withColumn("later", F.first("start", ignorenulls=True).over(later)).where("ask").select(*keys, "b", "later")
    return here.join(ahead, [*keys, "b"], "left").select(*keys, F.col("of").alias(at), F.coalesce("here", "later").alias("next"))


def anchors(rows: DataFrame, keys: list[str], at: str, gap: float, strict: bool = False) -> DataFrame:
    """(keys, at) of the anchors of each key; rows with a null key or place take no part, rows at one place count once."""
    there = rows.select(*keys, at).where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*keys, at])).distinct()
    pointers = materialise(successors(there, keys, at, gap, strict).where("next IS NOT NULL"), "successors")
    marked = new = there.groupBy(*keys).agg(F.min(at).alias(at))
    while True:
        new = materialise(marked.join(pointers, [*keys, at]).select(*keys, F.col("next").alias(at)), "anchors")
        if new.isEmpty():
            return marked
        marked = materialise(marked.unionByName(new), "anchors")
        onward = pointers.select(*keys, F.col(at).alias("next"), F.col("next").alias("then"))
        pointers = materialise(pointers.join(onward, [*keys, "next"]).select(*keys, at, F.col("then").alias("next")), "successors")


def anchor_rows(rows: DataFrame, keys: list[str], at: str, gap: float, strict: bool = True, name: str = "row_no") -> DataFrame:
    """``rows`` with the number (from 0) of the anchor that each belongs to: the last at or before its place; rows without a key or place have none."""
    marks = anchors(rows, keys, at, gap, strict).withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(at)) - 1)
    joined = rows.join(marks, [*keys, at], "left")
    order = Window.partitionBy(*keys).orderBy(at).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    complete: Column = F.lit(True)
    for c in [*keys, at]:
        complete = complete & F.col(c).isNotNull()
    return joined.withColumn(name, F.when(complete, F.max(name).over(order))).select(*rows.columns, name)


def throttled_last_seen(events: DataFrame, user: str = "user_id", ts: str = "ts", minutes: int = 10) -> DataFrame:
    """(user, seen_at): what is written when a user's last written time is refreshed only once it is ``minutes`` old; the anchor is what was written."""
    micros = events.select(F.col(user), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"))
    return anchors(micros, [user], "at", minutes * 60_000_000).select(user, F.timestamp_micros("at").alias("seen_at"))
