import datetime as dt

from lodestone.streaming import state as S


def at(m):
    return dt.datetime(2026, 1, 1) + dt.timedelta(minutes=m)


RUNS = [("a", at(0), "failed", 0, 1), ("a", at(1), "failed", 0, 1), ("a", at(2), "failed", 0, 1), ("a", at(3), "failed", 0, 1), ("a", at(20), "success", 3, 1), ("b", at(0), "empty", 0, 1)]
SCHEMA = "source string, ts timestamp, state string, offers int, duration_ms int"


def drain(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


#: Three failures open, more keep open; a success closes; one failure is half open; a gap of 21 minutes forgets.
STATES = [("a", at(0), "half_open"), ("a", at(1), "half_open"), ("a", at(2), "open"), ("a", at(3), "open"), ("a", at(20), "closed"), ("b", at(0), "closed")]


def test_breaker_states(spark):
    more = [("c", at(0), "failed", 0, 1), ("c", at(20), "failed", 0, 1), ("c", at(42), "failed", 0, 1), ("c", at(50), "failed", 0, 1), ("c", at(60), "failed", 0, 1)]
    got = sorted((r.source, r.ts, r.state) for r in S.breaker_batch(spark.createDataFrame(RUNS + more, SCHEMA)).collect())
    assert got == sorted(STATES + [("c", at(0), "half_open"), ("c", at(20), "half_open"), ("c", at(42), "half_open"), ("c", at(50), "half_open"), ("c", at(60), "open")])


def test_breaker_stream(spark, tmp_path):
    """State lives through micro-batches, equals the batch form, and keys leave the store when they have run out."""
    src = tmp_path / "runs"
    steps = [RUNS[:2] + RUNS[5:], RUNS[2:4], RUNS[4:5], [("z", at(200), "failed", 0, 1)], [("z", at(201), "failed", 0, 1), ("a", at(201), "failed", 0, 1)]]
    q, kept = None, []
    for i, rows in enumerate(steps):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(SCHEMA).parquet(str(src))
        q = S.breaker(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        kept.append(q.recentProgress[-1].stateOperators[0].numRowsTotal)
    got = {(r.source, r.ts, r.state, r.fails) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    everything = [r for rows in steps for r in rows]
    assert got == {(r.source, r.ts, r.state, r.fails) for r in S.breaker_batch(spark.createDataFrame(everything, SCHEMA)).collect()}
    assert set(STATES) <= {r[:3] for r in got} and ("a", at(201), "half_open", 1) in got
    assert kept[-2] < kept[2] + 2  # a and b have left while z came


def test_last_seen_and_windows(spark, tmp_path):
    rows = [(i, at(m), 1, "view") for i, m in enumerate([0, 5, 9, 12, 14, 30])]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long, event_type string").parquet(str(tmp_path / "e"))
    assert sorted(r.seen_at for r in drain(spark, S.throttled_last_seen(stream), "seen").collect()) == [at(0), at(12), at(30)]
    assert drain(spark, S.rolling_activity(stream, "1 hour", "1 hour", "0 seconds"), "rolling", "update").collect()[0].n == 6
    assert drain(spark, S.once(stream), "once").count() == 6


def test_breaker_batch_by_windows(spark):
    """Row by row as the fold, ties apart, and no Python group holds a whole source."""
    import random

    import pandas as pd

    rng = random.Random(2)
    rows = [(rng.choice("aaab"), at(i), rng.choice(["failed", "failed", "failed", "success", "empty", None])) for i in range(300)]
    rng.shuffle(rows)
    out = S.breaker_batch(spark.createDataFrame(rows, "source string, ts timestamp, state string"))
    want = set()
    for k in "ab":
        pdf = pd.DataFrame([r for r in rows if r[0] == k], columns=["source", "ts", "state"])
        want |= {(k, r.ts, r.state, r.fails, None if pd.isna(r.open_until) or r.state != "open" else r.open_until) for r in S._fold(None, pdf, k)[1].itertuples()}
    assert {tuple(r) for r in out.collect()} == want
    assert "InPandas" not in out._jdf.queryExecution().toString()
