"""Activity, application and latency analytics: conditional aggregates over one scan each."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

WINDOWS = {"day": 1, "week": 7, "month": 30, "year": 365}


def cutoff(now: dt.datetime, days: int):
    return F.lit(now - dt.timedelta(days=days)).cast("timestamp_ntz")


def active_users(events: DataFrame, users: DataFrame, now: dt.datetime, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """Users and rolling active users.  A user is active in a window iff the last event is, so one row per user is enough and no window needs a distinct count of its own."""
    widest = max(windows.values())
    last = events.where((F.col("created_at") >= cutoff(now, widest)) & F.col("user_id").isNotNull()).groupBy("user_id").agg(F.max("created_at").alias("last"))
    counted = last.agg(*[F.count_if(F.col("last") >= cutoff(now, d)).alias(f"active_{w}") for w, d in windows.items()])
    return counted.withColumn("total_users", F.lit(users.count()).cast("long"))


def active_users_or_last_seen(events: DataFrame, users: DataFrame, now: dt.datetime, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """``active_users`` with its ``activity_source``: without any event, users count by their ``last_active_at``; users who are not ``is_active`` only count as users."""
    empty = events.isEmpty()
    seen = users.select("user_id", F.col("last_active_at").alias("created_at")).where("created_at IS NOT NULL") if empty else events
    enabled = users.where("is_active").count()
    return active_users(seen, users, now, windows).withColumns({"active_users": F.lit(enabled).cast("long"), "activity_source": F.lit("last_active_at" if empty else "events")})


def signups(events: DataFrame, now: dt.datetime, kind: str = "signup", windows: dict[str, int] = WINDOWS) -> DataFrame:
    return events.where(F.col("kind") == kind).agg(*[F.count_if(F.col("created_at") >= cutoff(now, d)).alias(f"new_{w}") for w, d in windows.items()])


def activity_by_kind(events: DataFrame, now: dt.datetime, kinds: list[str], windows: dict[str, int] = WINDOWS) -> DataFrame:
    """Events and distinct users per kind and window; kinds without events get zeros."""
    last = events.where(F.col("kind").isin(kinds) & (F.col("created_at") >= cutoff(now, max(windows.values()))))
    per_user = last.groupBy("kind", "user_id").agg(F.max("created_at").alias("last"), *[F.count_if(F.col("created_at") >= cutoff(now, d)).alias(w) for w, d in windows.items()])
    got = per_user.groupBy("kind").agg(*[F.sum(w).alias(f"events_{w}") for w in windows], *[F.count_if((F.col("last") >= cutoff(now, d)) & F.col("user_id").isNotNull()).alias(f"users_{w}") for w, d in windows.items()])
    frame = events.sparkSession.createDataFrame([(k,) for k in kinds], "kind string")
    return frame.join(got, "kind", "left").na.fill(0)


def status_counts(apps: DataFrame) -> DataFrame:
    return apps.groupBy("status").agg(F.count("*").alias("n"))


def window_counts(apps: DataFrame, now: dt.datetime, windows: dict[str, int] = WINDOWS) -> DataFrame:
    return apps.agg(*[F.count_if(F.col("created_at") >= cutoff(now, d)).alias(f"n_{w}") for w, d in windows.items()], F.count("*").alias("n_total"))


def source_counts(apps: DataFrame) -> DataFrame:
    """Null and empty sources are one group, "unknown", and are summed."""
    return apps.groupBy(F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))


def averages(apps: DataFrame) -> DataFrame:
    """Averages truncated to an integer and rounded to four places, nulls ignored."""
    return apps.agg(F.avg("score").cast("long").alias("avg_int"), F.round(F.avg("score"), 4).alias("avg_4"), F.count("score").alias("n"))


def document_totals(tables: dict[str, DataFrame], now: dt.datetime, column: str = "created_at", windows: dict[str, int] = WINDOWS) -> DataFrame:
    """A row of totals for each table of documents."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) >= cutoff(now, d)).alias(f"n_{w}") for w, d in windows.items()]).select(F.lit(name).alias("kind"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def user_event_pivot(events: DataFrame, kinds: list[str]) -> DataFrame:
    return events.groupBy("user_id").pivot("kind", kinds).agg(F.count("event_id")).na.fill(0)


def board_overview(offers: DataFrame) -> DataFrame:
    """Count, enabled and disabled offers, and those that are large."""
    on = F.col("size") >= 10
    return offers.groupBy("company").agg(F.count("*").alias("total"), F.count_if(on).alias("enabled"), (F.count("*") - F.count_if(on)).alias("disabled"), F.sum(F.when(F.col("size") >= 40, 1).otherwise(0)).cast("long").alias("large"))


def user_dashboard(apps: DataFrame, now: dt.datetime, good: float, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """One pass over each user's applications: totals, by status, by window, scores, distinct sources, the last one."""
    return apps.groupBy("user_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(f"status_{s.lower()}") for s in ("F", "O", "P")],
        *[F.count_if(F.col("created_at") >= cutoff(now, d)).alias(f"n_{w}") for w, d in windows.items()],
        F.round(F.avg("score"), 6).alias("avg_score"),
        F.max("score").alias("max_score"),
        F.count_if(F.col("score") >= good).alias("good"),
        F.count_distinct("source").alias("sources"),
        F.max("created_at").alias("last_at"),
    )


def top_terms(rows: DataFrame, text: str, order: str, recent: int = 500, k: int = 8) -> DataFrame:
    """The ``k`` most frequent words of the ``recent`` rows; ties in order of first appearance."""
    last = rows.orderBy(F.desc(order)).limit(recent)
    words = last.select(F.col(order).alias("o"), F.posexplode(F.split(text, " ")).alias("i", "term")).where(F.col("term") != "")
    counted = words.groupBy("term").agg(F.count("*").alias("n"), F.max(F.struct("o", F.negative("i").alias("i"))).alias("first"))
    return counted.orderBy(F.desc("n"), F.desc("first.o"), F.desc("first.i"), "term").limit(k).select("term", "n")


def _range_of(v, cuts, n: int):
    """How many of ``n`` (a power of two, less one) sorted cuts are at most ``v``: a binary search."""
    let = lambda x, f: F.get(F.transform(F.array(x), f), 0)

    def step(at, width: int):
        if not width:
            return at
        return let(at + F.when(F.get(cuts, at + width - 1) <= v, width).otherwise(0), lambda x: step(x, width // 2))

    return step(F.lit(0), (n + 1) // 2)


def nearest_rank(rows: DataFrame, key: str, value: str, percents: list[int], ranges: int = 256) -> DataFrame:
    """Element at index rint(p/100 * (n-1)) (half to even) of each group's sorted values, null values left out.

    A group is never sorted in one place: values are counted in ranges of the group between approximate quantiles, so that
    each has about as many rows whatever the values' spread; the range that holds the wanted index is found on those counts, and
    only its rows are numbered, unless they all are one value.  Equal values are one row with their number, so that the work behind
    the first aggregate grows with the different values.
    """
    rows = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).groupBy("k", "v").agg(F.count("*").alias("m"))
    share = [i / ranges for i in range(1, ranges)]
    ends = rows.groupBy("k").agg(F.percentile_approx("v", share, 20 * ranges).alias("cuts"), F.sum("m").alias("n"))
    placed = rows.join(ends, "k").withColumn("b", _range_of(F.col("v"), F.col("cuts"), ranges - 1))
    sizes = placed.groupBy("k", "b").agg(F.sum("m").alias("c"), F.first("n").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    below = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("before", F.coalesce(F.sum("c").over(below), F.lit(0)))
    wanted = sizes.withColumn("p", F.explode(F.array(*map(F.lit, percents)))).withColumn("i", F.rint(F.col("p") / 100 * (F.col("n") - 1)).cast("long"))
    wanted = wanted.where((F.col("i") >= F.col("before")) & (F.col("i") < F.col("before") + F.col("c"))).select("k", "b", "p", "lo", "hi", (F.col("i") - F.col("before") + 1).alias("r"))
    mixed = wanted.where("lo < hi")
    upto = F.sum("m").over(Window.partitionBy("k", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    inside = placed.select("k", "v", "b", "m").join(mixed.select("k", "b").distinct(), ["k", "b"]).withColumn("upto", upto)
    found = inside.join(mixed.select("k", "b", "p", "r"), ["k", "b"]).where((F.col("r") <= F.col("upto")) & (F.col("r") > F.col("upto") - F.col("m"))).select("k", "p", "v")
    return found.unionByName(wanted.where("NOT lo < hi").select("k", "p", F.col("lo").alias("v"))).select(F.col("k").alias(key), "p", "v")


def latency_rollup(events: DataFrame, key: str = "kind", value: str = "duration_ms") -> DataFrame:
    """n, p50, p95 and the average (one place) per kind."""
    q = nearest_rank(events, key, value, [50, 95]).groupBy(key).agg(F.max(F.when(F.col("p") == 50, F.col("v"))).alias("p50"), F.max(F.when(F.col("p") == 95, F.col("v"))).alias("p95"))
    return events.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(value), 1).alias("avg_ms")).join(q, key)


def call_rollup(events: DataFrame) -> DataFrame:
    """Calls by kind: averages, and the shares of slow, empty and failed ones (three places, null without calls)."""
    share = lambda c: F.round(F.try_divide(F.count_if(c), F.count("*")), 3)
    return events.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 1).alias("avg_ms"), share(F.col("duration_ms") > 100).alias("slow_rate"), share(F.col("duration_ms").isNull()).alias("empty_rate"), share(F.get_json_object("meta", "$.k").cast("int") % 2 == 0).alias("even_rate"))


def source_health(events: DataFrame, source: str, failed) -> DataFrame:
    """Runs per source with success and error rates, offers a run and the best run; null where nothing ran."""
    ok = ~failed
    return events.groupBy(source).agg(
        F.count("*").alias("runs"),
        F.round(F.try_divide(F.count_if(ok), F.count("*")), 3).alias("success_rate"),
        F.round(F.try_divide(F.count_if(failed), F.count("*")), 3).alias("error_rate"),
        F.round(F.try_divide(F.sum(F.when(ok, F.col("duration_ms"))), F.count_if(ok)), 2).alias("per_run"),
        F.max(F.when(ok, F.col("duration_ms"))).alias("best"),
    )


def duplicate_audit(rows: DataFrame, *keys) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def context_summary(apps: DataFrame) -> DataFrame:
    """Counts, latest row and a status histogram in words, per user."""
    per = apps.groupBy("user_id", "status").agg(F.count("*").alias("n"), F.max(F.struct("created_at", "id")).alias("last"))
    hist = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("status", "n"))), lambda x: F.concat(x["status"], F.lit("="), x["n"].cast("string"))), ", ")
    return per.groupBy("user_id").agg(F.sum("n").alias("total"), hist.alias("by_status"), F.max("last").alias("l")).select("user_id", "total", "by_status", F.col("l.id").alias("latest_id"))


def request_summary(requests: DataFrame) -> DataFrame:
    """Requests (id, total, calls: an array of structs ms, hit, fallback, ok, tin): time in calls and around them, and counts over the calls.

    Times are decimals of six places until they are rounded, half up, so that no binary remainder decides a tie.
    """
    exact = lambda x: x.cast("decimal(28,6)")
    calls = F.coalesce("calls", F.array().cast(requests.schema["calls"].dataType))
    count = lambda f: F.size(F.filter(calls, f)).cast("long")
    spent = F.aggregate(calls, exact(F.lit(0)), lambda acc, c: exact(acc + F.coalesce(exact(c["ms"]), exact(F.lit(0)))))
    total, one = exact(F.col("total")), lambda x: F.round(x, 1).cast("double")
    return requests.select(
        "id",
        one(total).alias("total_ms"),
        one(spent).alias("llm_ms"),
        one(F.greatest(exact(F.lit(0)), exact(total - spent))).alias("local_ms"),
        count(lambda c: ~c["hit"]).alias("n"),
        count(lambda c: c["hit"]).alias("cache_hits"),
        count(lambda c: c["fallback"]).alias("fallbacks"),
        count(lambda c: ~c["ok"]).alias("errors"),
        F.aggregate(calls, F.lit(0).cast("long"), lambda acc, c: acc + F.coalesce(c["tin"].cast("long"), F.lit(0))).alias("prompt_tokens"),
    )


def call_types(calls: DataFrame) -> DataFrame:
    """Calls (request_type, ms, tin, fallback, hit, failed, model) by type: percentiles, means, rates and the models' counts as text."""
    q = nearest_rank(calls, "request_type", "ms", [50, 95]).groupBy("request_type").agg(F.max(F.when(F.col("p") == 50, F.col("v"))).alias("p50_ms"), F.max(F.when(F.col("p") == 95, F.col("v"))).alias("p95_ms"))
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 3)
    per = calls.groupBy("request_type").agg(F.count("*").alias("n"), F.round(F.avg("ms"), 1).alias("avg_ms"), F.round(F.avg("tin"), 0).alias("avg_in_tokens"), share("fallback").alias("fallback_rate"), share("hit").alias("cache_hit_rate"), share("failed").alias("error_rate"))
    models = calls.groupBy("request_type", "model").agg(F.count("*").alias("k")).groupBy("request_type").agg(F.sort_array(F.collect_list(F.struct("model", "k"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: F.concat(x["model"], F.lit("="), x["k"].cast("string"))), ",")
    return per.join(q, "request_type").join(models.select("request_type", text.alias("models")), "request_type")


def last_values(value: str, keys: list[str], order: list[str], n: int = 30):
    """The values of the last ``n`` rows of a key up to each row, nulls among them left out: a frame of ``n`` rows, whatever the key's size."""
    return F.collect_list(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, Window.currentRow))


def ranked_value(values, percent: float):
    """The element at index rint(percent/100 * (n-1)) (half to even) of a list's sorted values; null for an empty list."""
    return F.get(F.array_sort(values), F.rint(F.lit(percent / 100) * (F.size(values) - 1)).cast("int"))
