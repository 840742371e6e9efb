"""Many boards of one source, fetched apart: one union of their offers, and what became of the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def board_offers(fetches: DataFrame, offers: DataFrame, keep: Column, limit: int) -> DataFrame:
    """Offers (source, board, place, ...) that ``keep`` lets through, in order of their boards (``seq`` in fetches: source, board, seq, error), at most ``limit`` of a source.

    A board with an error has no offers and doesn't hinder the others.  Spark limits each task's rows of a source before it deals them out.
    """
    fine = fetches.where(F.col("error").isNull()).select("source", "board", "seq")
    order = Window.partitionBy("source").orderBy("seq", "place")
    return offers.where(keep).join(fine, ["source", "board"]).withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).drop("seq")


def source_states(fetches: DataFrame, kept: DataFrame, limit: int) -> DataFrame:
    """(source, state, boards, failed, offers, last_error): of a source all of whose boards failed.

    "blocked" if all were denied ("denied", but not for asking too often, which says 429), else "unavailable", with the last board's error;
    any other source is "ok".  Boards behind the one that filled ``limit`` were not needed and don't count.
    """
    full = kept.groupBy("source").agg(F.count("*").alias("offers"), F.max(F.struct("k", "board")).alias("last"))
    until = full.where(F.col("offers") >= limit).select("source", F.col("last.board").alias("board")).join(fetches.select("source", "board", "seq"), ["source", "board"]).select("source", F.col("seq").alias("until"))
    seen = fetches.join(until, "source", "left").where(F.col("until").isNull() | (F.col("seq") <= F.col("until")))
    denied = F.col("error").startswith("denied") & ~F.col("error").contains("429")
    counts = seen.groupBy("source").agg(
        F.count("*").alias("boards"), F.count("error").alias("failed"), F.count_if(F.coalesce(denied, F.lit(False))).alias("denied"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("seq"))).alias("last_error")
    )
    every = F.col("failed") == F.col("boards")
    state = F.when(every & (F.col("denied") == F.col("boards")), "blocked").when(every, "unavailable").otherwise("ok")
    return counts.join(full.select("source", "offers"), "source", "left").select("source", state.alias("state"), "boards", "failed", F.coalesce("offers", F.lit(0)).alias("offers"), F.when(every, F.col("last_error")).alias("last_error"))
