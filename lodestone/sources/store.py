"""Tables that change: results that expire, appends that may be repeated, and deletion of what is old."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import drop_paths, materialise


def _exists(spark: SparkSession, path: str) -> bool:
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hp)


def _folders(spark: SparkSession, path: str, column: str) -> list[tuple[str, str]]:
    """(value, path) of the partitions of a table: one for each day."""
    if not _exists(spark, path):
        return []
    hp = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hp.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(hp)
    return [(f.getPath().getName().partition("=")[2], f.getPath().toString()) for f in found if f.isDirectory() and f.getPath().getName().startswith(f"{column}=")]


class ExpiringTable:
    """Results by key, each row with the time when it was written and expires; partitioned by the day of expiry.

    ``put`` only appends, so writers don't wait for each other; of a key's live rows the one written last is
    read (ties: that which expires last, then the greater value).  Reading asks for the days from today on, so expired partitions are
    pruned, not scanned.  What can't be read (a missing or broken file, no table at all) is a miss.  A row is live up to and at its time of
    expiry; without a time to live it never expires.  A null key is a key like others.
    """

    SCHEMA = "key string, value string, written_at timestamp, expires_at timestamp, day date"
    NEVER = dt.date(9999, 12, 31)

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, rows: DataFrame, now: dt.datetime, seconds: int | None) -> None:
        """Rows (key, value), live for ``seconds``."""
        end = None if not seconds else now + dt.timedelta(seconds=seconds)
        day = end.date() if end else self.NEVER
        stamped = rows.select("key", F.col("value").cast("string").alias("value"), F.lit(now).alias("written_at"), F.lit(end).cast("timestamp").alias("expires_at"), F.lit(day).alias("day"))
        stamped.write.mode("append").partitionBy("day").parquet(self.path)

    def _rows(self) -> DataFrame:
        if not _exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(self.path)

    def live(self, now: dt.datetime) -> DataFrame:
        """(key, value, written_at, expires_at): the latest live row of each key."""
        rows = self._rows().where((F.col("day") >= F.lit(now.date())) & (F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit(now))) & (F.col("written_at") <= F.lit(now)))
        last = F.max(F.struct("written_at", F.coalesce("expires_at", F.lit(dt.datetime(9999, 12, 31))).alias("until"), "value", "expires_at")).alias("r")
        return rows.groupBy("key").agg(last).select("key", "r.value", "r.written_at", "r.expires_at")

    def get(self, keys: DataFrame, now: dt.datetime) -> DataFrame:
        """``keys`` (key, and other columns) with value and ``hit``."""
        found = self.live(now).select(F.col("key").alias("__k"), "value", F.lit(True).alias("hit"))
        return keys.join(found, F.col("key").eqNullSafe(F.col("__k")), "left").drop("__k").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def sweep(self, now: dt.datetime) -> int:
        """Removes the partitions of days that are over; their number."""
        old = [p for day, p in _folders(self.spark, self.path, "day") if day < now.date().isoformat()]
        drop_paths(self.spark, *old)
        return len(old)


class EventSink:
    """An append-only table of rows with a time, by day and batch.

    A batch is written under its id and replaces what an earlier attempt of that id has written, so repeating it adds
    nothing.  As ``foreachBatch`` target: ``query.foreachBatch(sink.append)``.
    """

    def __init__(self, spark: SparkSession, path: str, ts: str = "ts"):
        self.spark, self.path, self.ts = spark, path, ts

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Rows of one batch; those without a time are kept under a null day."""
        stamped = rows.withColumn("day", F.to_date(self.ts)).withColumn("batch", F.lit(int(batch_id)).cast("long"))
        for _, day in _folders(self.spark, self.path, "day"):  # a day that only the earlier attempt had
            drop_paths(self.spark, f"{day}/batch={int(batch_id)}")
        stamped.write.mode("append").partitionBy("day", "batch").parquet(self.path)

    def read(self, schema: str | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(self.path).drop("day", "batch")

    def prune(self, now: dt.datetime, days: int) -> int:
        """Deletes what is older than ``days`` (one at least): whole days by their partitions, the day of the cutoff by rewriting it; returns the number of rows."""
        cutoff = now - dt.timedelta(days=max(1, days))
        edge = cutoff.date().isoformat()
        days_held = [(d, p) for d, p in _folders(self.spark, self.path, "day") if d != "__HIVE_DEFAULT_PARTITION__" and d <= edge]
        if not days_held:
            return 0
        table = self.spark.read.parquet(self.path)
        gone = table.where((F.col("day") <= F.lit(edge).cast("date")) & (F.col(self.ts) < F.lit(cutoff))).count()
        over = [p for d, p in days_held if d < edge]
        if any(d == edge for d, _ in days_held):
            kept = materialise(table.where((F.col("day") == F.lit(edge).cast("date")) & (F.col(self.ts) >= F.lit(cutoff))), "kept")
            if kept.isEmpty():
                over += [p for d, p in days_held if d == edge]
            else:
                batches = {r["batch"] for r in kept.select("batch").distinct().collect()}  # of one day
                kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(self.path)
                here = next(p for d, p in days_held if d == edge)
                over += [p for b, p in _folders(self.spark, here, "batch") if int(b) not in batches]
        drop_paths(self.spark, *over)
        return gone
