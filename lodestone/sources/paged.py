"""Paged sources: landed pages, a stop rule over their facts, and a data source with a partition per page.

A page is a JSON file of its own, ``{folder}/source=<name>/page=<number>.json`` with
"total" (may be absent) and "items", objects that have an "id".  Beside the pages lie their facts
(``{folder}/facts``: source, page, n, total, ids), narrow rows from which Spark finds for each source where a reader that takes one
page after another would stop:

* after a page that is missing or empty, shorter than the page size, or without an id that no earlier page had;
* once as many items have come as the source says that it has, or as the reader wants (``limit``);
* after ``most`` pages.

Only pages up to that one become partitions of the data source ``lodestone_pages``, so no later page is opened.

Defined results: a source without pages has no items; of items that repeat an id of the source the first one stays; a null or
missing id is an item of its own and never new; items keep their order (page, place).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import ship

ITEMS = "source string, page int, place int, item string"
FACTS = "source string, page int, n int, total bigint, ids array<string>"


def land(items: DataFrame, folder: str, size: int) -> None:
    """Write (source, position from 0, item: JSON, total) as pages of ``size`` items with their facts."""
    paged = items.withColumn("page", F.floor(F.col("position") / size).cast("int"))
    by_page = paged.groupBy("source", "page").agg(F.array_sort(F.collect_list(F.struct("position", "item"))).alias("rows"), F.max("total").alias("total"))
    bodies = F.array_join(F.transform("rows", lambda r: r["item"]), ",")
    text = F.concat(F.lit('{"total":'), F.coalesce(F.col("total").cast("string"), F.lit("null")), F.lit(',"items":['), bodies, F.lit("]}"))
    ids = F.transform("rows", lambda r: F.get_json_object(r["item"], "$.id"))
    pages = by_page.select("source", "page", text.alias("value"), F.size("rows").alias("n"), F.col("total").cast("long"), ids.alias("ids"))
    pages.select("source", "page", "value").repartition("source", "page").write.partitionBy("source", "page").text(f"{folder}/pages")
    pages.select("source", "page", "n", "total", "ids").write.parquet(f"{folder}/facts")


def last_pages(facts: DataFrame, size: int, limit: int | None = None, most: int | None = None) -> DataFrame:
    """(source, last): the page after which reading stops, as the running minimum of the stop rule over the pages of each source."""
    so_far = Window.partitionBy("source").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    first = facts.select("source", "page", F.explode("ids").alias("id")).where("id IS NOT NULL").groupBy("source", "id").agg(F.min("page").alias("page"))
    fresh = first.groupBy("source", "page").agg(F.count("*").alias("fresh"))
    known = facts.select("source", "page", "n", "total").join(fresh, ["source", "page"], "left").withColumn("fresh", F.coalesce("fresh", F.lit(0)))
    seen = known.withColumn("items", F.sum("n").over(so_far)).withColumn("got", F.sum("fresh").over(so_far)).withColumn("at", F.row_number().over(Window.partitionBy("source").orderBy("page")) - 1)
    stop = (F.col("n") < size) | (F.col("fresh") == 0) | (F.col("page") != F.col("at")) | F.coalesce(F.col("items") >= F.col("total"), F.lit(False))
    if limit is not None:
        stop = stop | (F.col("got") >= limit)
    if most is not None:
        stop = stop | (F.col("at") + 1 >= most)
    # a gap in the numbers ends before it
    end = F.when(F.col("page") != F.col("at"), F.col("at") - 1).otherwise(F.col("page"))
    return seen.groupBy("source").agg(F.coalesce(F.min(F.when(stop, end)), F.max("page")).cast("int").alias("last"))


class _Page(InputPartition):
    def __init__(self, source: str, page: int, paths: list[str]):
        self.source, self.page, self.paths = source, page, paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.last = options["path"].rstrip("/"), json.loads(options["last"])

    def partitions(self) -> list[_Page]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        out = []
        for source, last in sorted(self.last.items()):
            for page in range(last + 1):
                found = store.get_file_info(fs.FileSelector(f"{root}/pages/source={source}/page={page}", allow_not_found=True))
                names = sorted(f.path for f in found if f.base_name.startswith("part-"))
                if names:
                    out.append(_Page(source, page, names))
        return out or [_Page("", 0, [])]

    def read(self, partition: _Page) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.folder)
        rows = []
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                for line in f.read().decode().splitlines():
                    rows += [json.dumps(item, ensure_ascii=False, separators=(",", ":")) for item in json.loads(line)["items"]]
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([partition.source] * n, pa.string()), pa.array([partition.page] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array(rows, pa.string())], ["source", "page", "place", "item"])


class PagedSource(DataSource):
    """``spark.read.format("lodestone_pages").option("last", JSON of source: last page).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_pages"

    def schema(self) -> str:
        return ITEMS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_pages(spark: SparkSession, folder: str, size: int, limit: int | None = None, most: int | None = None) -> DataFrame:
    """(source, page, place, item): the items of every source up to its stop, the first of each id, ``limit`` of each source at most."""
    ship(spark)
    spark.dataSource.register(PagedSource)
    last = {r["source"]: r["last"] for r in last_pages(spark.read.schema(FACTS).parquet(f"{folder}/facts"), size, limit, most).collect()}  # a number for each source
    items = spark.read.format("lodestone_pages").option("last", json.dumps(last)).load(folder)
    key = F.coalesce(F.get_json_object("item", "$.id"), F.concat_ws(":", F.lit("none"), F.col("page").cast("string"), F.col("place").cast("string")))
    kept = items.groupBy("source", key.alias("key")).agg(F.min(F.struct("page", "place", "item")).alias("r")).select("source", "r.*")
    if limit is None:
        return kept
    return kept.withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("page", "place"))).where(F.col("k") <= limit).drop("k")
