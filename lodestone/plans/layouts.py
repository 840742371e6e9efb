"""Layouts of pages made of the offers table, beside results worked out by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import roles as R
from ..operators import layout as P
from .queries import query

#: By kind of page: blocks of lines as (x0, x1, first y0, step, number).
_KINDS = [
    [(50.0, 550.0, 40.0, 20.0, 12)],
    [(150.0, 450.0, 40.0, 20.0, 1), (200.0, 400.0, 60.0, 20.0, 1), (50.0, 250.0, 120.0, 20.0, 8), (330.0, 550.0, 120.0, 20.0, 8)],
    [(50.0, 250.0, 40.0, 20.0, 8), (330.0, 550.0, 40.0, 20.0, 3)],
    [(40.0, 180.0, 40.0, 30.0, 10), (240.0, 360.0, 40.0, 30.0, 10), (420.0, 560.0, 40.0, 30.0, 10)],
    [(50.0, 250.0, 40.0, 20.0, 3)],
]


def _lines(spark, sf):
    box = lambda x0, x1, y: F.struct(F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), F.lit(y).alias("y0"), F.lit(y + 10.0).alias("y1"))
    kinds = [F.array(*[box(x0, x1, y + i * step) for x0, x1, y, step, n in k for i in range(n)]) for k in _KINDS]
    boxes = F.get(F.array(*kinds), F.pmod("offer_id", F.lit(len(_KINDS))).cast("int"))
    rows = R.spread(R.offers(spark, sf).select("offer_id"), "offer_id").select(F.col("offer_id").alias("doc_id"), F.lit(1).alias("page"), F.posexplode(boxes).alias("i", "b"))
    return rows.select("doc_id", "page", "b.*", F.col("i").cast("string").alias("text"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))


@query(
    """WITH v AS (SELECT * FROM (VALUES (0, 0, 12, 0, 0, 1.0, NULL, '0'), (1, 2, 0, 8, 8, 1.0, 291.0, '0,1,2'), (2, 0, 0, 8, 3, 0.965, 291.0, '0,1,2'), (3, 0, 0, 10, 20, 0.5, 210.0, '0,1,2'), (4, 0, 3, 0, 0, 1.0, NULL, '0,1,2')) t(k, header, body, lefts, rights, confidence, split_x, first_lines))
    SELECT p_partkey AS doc_id, CAST(header AS BIGINT) AS header, CAST(body AS BIGINT) AS body, CAST(lefts AS BIGINT) AS lefts, CAST(rights AS BIGINT) AS rights, CAST(confidence AS DOUBLE) AS confidence, CAST(split_x AS DOUBLE) AS split_x, CASE WHEN k = 0 THEN '0,1,2' ELSE first_lines END AS first_lines FROM part JOIN v ON k = p_partkey % 5"""
)
def page_layouts(spark, sf):
    rows = P.page_layouts(_lines(spark, sf))
    n = lambda z: F.count_if(F.col("zone") == z)
    first = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("place") < 3, F.struct("place", "text")))), lambda x: x["text"]), ",")
    return rows.groupBy("doc_id").agg(n("header").alias("header"), n("body").alias("body"), n("left").alias("lefts"), n("right").alias("rights"), F.max("confidence").alias("confidence"), F.max("split_x").alias("split_x"), first.alias("first_lines"))
