"""Adapter views: the test tables in the roles that the operators are written for."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task of ``spread``.
EACH = 50_000


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The rows dealt over all tasks by ``key``: a table of narrow rows is one small file, so that costly expressions over it would run in one task.

    Tasks grow in number with the rows, counted from the files' footers; adaptive execution would join them by their few bytes.
    """
    tasks = -(-rows.count() // EACH)
    return rows.repartition(max(tasks, 2 * rows.sparkSession.sparkContext.defaultParallelism), key)


def usage_events(spark, sf_dir) -> DataFrame:
    """event_id, user_id, kind, created_at, duration_ms, meta."""
    return read(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), F.col("ts").alias("created_at"), F.col("value").alias("duration_ms"), F.col("props").alias("meta"))


def users(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))


def applications(spark, sf_dir) -> DataFrame:
    """id, user_id, status, score, created_at, source."""
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("source")
    )


def saved(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("application_id"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("offer_id"), F.col("l_suppkey").alias("source_id"), F.col("l_shipdate").alias("saved_at"), F.col("l_quantity").alias("quantity"))


def offers(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("offer_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("company"), F.col("p_type").alias("job_type"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("salary"))


def messages(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def latest(events: DataFrame, column: str = "created_at") -> dt.datetime:
    """The data's own "now": one scalar."""
    return events.agg(F.max(column).alias("m")).first()["m"] or dt.datetime(1970, 1, 1)
