"""Rounded times where a binary remainder used to decide."""

import compare

from lodestone.plans.registry import ORACLE_SQL, QUERIES


def test_request_summary_rounds_exactly(spark, tmp_path):
    """204.85 less 153 is 51.85, and 204.95 less 204 is 0.95: half up in the query and in its SQL (F2)."""
    orders = [(1, 204850.0), (2, 204950.0), (3, None), (4, 1000.0)]
    lines = [(1, 1, float(q), i, "N") for i, q in enumerate((50, 50, 53), 1)] + [(2, 1, float(q), i, "R") for i, q in enumerate((100, 104), 1)] + [(4, 1, None, 1, "N"), (4, 2, 0.25, 2, "N")]
    spark.createDataFrame([(k, 1, "F", p, None, "x") for k, p in orders], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double, l_linenumber int, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = QUERIES["request_summary"](spark, str(tmp_path))
    assert {r.id: (r.total_ms, r.llm_ms, r.local_ms) for r in df.collect()} == {1: (204.9, 153.0, 51.9), 2: (205.0, 204.0, 1.0), 3: (None, 0.0, 0.0), 4: (1.0, 0.3, 0.8)}
    con = compare.duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert compare.differences(df, con, ORACLE_SQL["request_summary"]) == ""
