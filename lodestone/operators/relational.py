"""Joins, windows, paging and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that is last by ``order`` (which must break ties), by aggregation instead of a sort."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    top = df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__t"))
    return top.select(*keys, *[F.col(f"__t.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def totals_with_users(facts: DataFrame, users: DataFrame, n: int, offset: int = 0) -> DataFrame:
    """Page of users by their number of facts; users unknown to ``users`` drop out."""
    counts = facts.groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.join(users, "user_id").orderBy(F.desc("n"), "user_id").offset(offset).limit(n)


def selected_with_latest(saved: DataFrame, offers: DataFrame, apps: DataFrame) -> DataFrame:
    """Saved rows with their offer (inner) and the latest application of it (left)."""
    latest = latest_per(apps, ["offer_id"], "created_at", "application_id").select("offer_id", F.col("application_id").alias("latest_application"), F.col("status").alias("latest_status"))
    return saved.join(offers, "offer_id").join(latest, "offer_id", "left")


def enriched_users(users: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Users with one count per fact table, 0 where none; every table is aggregated before it is joined."""
    out = users
    for name, f in facts.items():
        out = out.join(f.groupBy("user_id").agg(F.count("*").alias(name)), "user_id", "left")
    return out.na.fill(0, list(facts))


def any_key_latest(targets: DataFrame, apps: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """For each target the latest row that agrees in any of ``keys``: one equi-join per key, never an OR."""
    best = None
    top = F.max(F.struct(*order)).alias("t")
    for k in keys:
        part = targets.where(F.col(k).isNotNull()).select("target_id", k).join(apps.where(F.col(k).isNotNull()).groupBy(k).agg(top), k).select("target_id", "t")
        best = part if best is None else best.unionByName(part)
    return best.groupBy("target_id").agg(F.max("t").alias("t")).select("target_id", F.col(f"t.{out}").alias(out))


def token_join(left: DataFrame, right: DataFrame, least: int = 2) -> DataFrame:
    """(left_id, right_id): for each left text the first right one (by id) that shares ``least`` distinct tokens."""
    a = left.select("left_id", F.explode("tokens").alias("t"))
    b = right.select("right_id", F.explode("tokens").alias("t"))
    shared = a.join(b, "t").groupBy("left_id", "right_id").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return shared.groupBy("left_id").agg(F.min("right_id").alias("right_id"))


def last_n(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def sliding(df: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """Average and maximum of the last ``n`` values, this row's included, and their number."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.select("*", F.round(F.avg(value).over(w), 6).alias("avg_n"), F.max(value).over(w).alias("max_n"), F.count(value).over(w).alias("count_n"))


def streaks(df: DataFrame, key: str, order: list[str], failed) -> DataFrame:
    """Running number of failures in a row (reset by a success), running best value and total."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("failed", failed).withColumn("__island", F.sum(F.when(~F.col("failed"), 1).otherwise(0)).over(w))
    inside = Window.partitionBy(key, "__island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("fail_streak", F.sum(F.col("failed").cast("int")).over(inside).cast("long")).withColumn("best", F.max("duration_ms").over(w)).drop("__island")


def calls_in_window(df: DataFrame, key: str, seconds: int) -> DataFrame:
    """Number of calls of the key in the last ``seconds``, this one included."""
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    w = Window.partitionBy(key).orderBy("__at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return df.withColumn("__at", at).withColumn("calls", F.count("*").over(w)).drop("__at")


def sessions(df: DataFrame, key: str, minutes: int) -> DataFrame:
    """Sessions by gaps of more than ``minutes``."""
    w = Window.partitionBy(key).orderBy("created_at", "event_id")
    gap = F.unix_micros(F.col("created_at").cast("timestamp")) - F.unix_micros(F.lag("created_at").over(w).cast("timestamp"))
    rows = df.withColumn("__new", F.when(gap.isNull() | (gap > minutes * 60_000_000), 1).otherwise(0))
    rows = rows.withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "session").agg(F.count("*").alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``, by aggregation."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("__t")).select(*keys, *[F.col(f"__t.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def upsert(base: DataFrame, new: DataFrame, key: str, longest: list[str], fill: list[str], overwrite: list[str]) -> DataFrame:
    """Full outer merge with a rule per column: the longer text (ties take the new), fill if null, or overwrite."""
    b, n = base.alias("b"), new.alias("n")
    j = b.join(n, F.col(f"b.{key}") == F.col(f"n.{key}"), "full_outer")
    cols = [F.coalesce(f"n.{key}", f"b.{key}").alias(key)]
    size = lambda c: F.coalesce(F.length(c), F.lit(-1))
    for c in base.columns:
        if c == key:
            continue
        x, y = F.col(f"b.{c}"), F.col(f"n.{c}")
        cols.append((F.when(size(y) >= size(x), y).otherwise(x) if c in longest else F.coalesce(x, y) if c in fill else F.coalesce(y, x)).alias(c))
    state = F.when(F.col(f"b.{key}").isNull(), "inserted").when(F.col(f"n.{key}").isNull(), "kept").otherwise("updated")
    return j.select(*cols, state.alias("merge_state"))


#: Columns of an offer that a fetched row overwrites, also with null; the rest is only filled.
OVERWRITTEN = ["source_url", "title", "company", "company_url", "location", "city", "country"]


def upsert_offers(base: DataFrame, new: DataFrame, now: Column, expiry_days: int = 30, skills_cap: int = 25) -> DataFrame:
    """``base`` with the fetched offers ``new`` (and seq) in it, and a state: kept, updated or inserted.

    A fetched row belongs to the row with its content hash, else to the one with its (source, source_job_id).  Keys of a row
    stay; the longer description wins (ties take the new one), skills are united, metadata is merged with the new values on
    top, and an offer without an expiry gets one ``expiry_days`` after its posting, or after ``now``.  Of several fetched rows for one
    row the last by seq counts; base has each (source, source_job_id) once.
    """
    key = ["source", "source_job_id"]
    rest = [c for c in new.columns if c != "seq"]
    by_hash = base.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.min(F.struct(*key)).alias("__h"))
    by_key = base.select(*key, F.struct(*key).alias("__p")).dropDuplicates(key)
    target = F.coalesce("__h", "__p", F.struct(*key))
    found = new.join(by_hash, "content_hash", "left").join(by_key, key, "left").withColumn("__t", target)
    last = found.groupBy("__t").agg(F.max_by(F.struct(*rest), "seq").alias("n"))
    j = base.withColumn("__t", F.struct(*key)).alias("b").join(last.alias("l"), F.col("b.__t") == F.col("l.__t"), "full_outer")
    fetched, there = F.col("n").isNotNull(), F.col("b.__t").isNotNull()

    def merged(c: str) -> Column:
        x = F.col(f"b.{c}")
        if c not in rest:
            return x
        y = F.col(f"n.{c}")
        if c in [*key, "content_hash"]:
            return F.when(there, x).otherwise(y)
        if c in OVERWRITTEN:
            return F.when(fetched, y).otherwise(x)
        if c == "description":
            return F.when((F.length(y) > 0) & (F.length(y) >= F.coalesce(F.length(x), F.lit(0))), y).otherwise(x)
        if c == "skills":
            none = F.array().cast("array<string>")
            return F.when(fetched, F.slice(F.array_distinct(F.concat(F.coalesce(x, none), F.coalesce(y, none))), 1, skills_cap)).otherwise(x)
        if c == "metadata":
            return F.when(x.isNull() | y.isNull(), F.coalesce(x, y)).otherwise(F.map_concat(F.map_filter(x, lambda k, _: ~F.array_contains(F.map_keys(y), k)), y))
        if c == "expires_at":
            return F.when(fetched, F.coalesce(y, F.date_add(F.coalesce("n.posted_at", now), expiry_days).cast(dict(base.dtypes)[c]))).otherwise(x)
        return F.coalesce(y, x)

    state = F.when(~fetched, "kept").when(there, "updated").otherwise("inserted")
    return j.select(*[merged(c).alias(c) for c in base.columns], state.alias("state"))


def overlay(base: DataFrame, enabled: DataFrame, disabled: DataFrame) -> DataFrame:
    """Tokens of base or enabled, ignoring case, first spelling wins, without the disabled ones."""
    both = base.select("token", F.lit(0).alias("o")).unionByName(enabled.select("token", F.lit(1).alias("o")))
    kept = both.withColumn("k", F.lower("token")).groupBy("k").agg(F.min(F.struct("o", "token")).alias("t"))
    return kept.join(disabled.select(F.lower("token").alias("k")), "k", "left_anti").select(F.col("t.token").alias("token"))


def resolved_tokens(base: DataFrame, added: DataFrame, removed: DataFrame, valid, cap: int = 60) -> DataFrame:
    """(token, place): tokens of ``base`` (token, seq), then those of ``added``, trimmed, without those of ``removed`` and those for which ``valid`` doesn't hold.

    Of spellings that differ in case the first valid one stays; at most ``cap``.  Blank and null tokens go.
    """
    every = base.select("token", F.lit(0).alias("later"), "seq").unionByName(added.select("token", F.lit(1).alias("later"), "seq")).withColumn("token", F.trim("token"))
    out = removed.select(F.lower(F.trim("token")).alias("k")).where("k <> ''").distinct()
    fine = every.where((F.col("token") != "") & valid(F.col("token"))).withColumn("k", F.lower("token")).join(out, "k", "left_anti")
    once = fine.groupBy("k").agg(F.min(F.struct("later", "seq", "token")).alias("t")).select("t.*")
    place = F.row_number().over(Window.orderBy("later", "seq", "token"))
    return once.orderBy("later", "seq", "token").limit(cap).withColumn("place", place).select("token", "place")
