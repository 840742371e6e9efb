"""History windows and slot filling over message logs; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .relational import last_n


def history(messages: DataFrame, n: int = 20) -> DataFrame:
    """Each conversation's last ``n`` messages with their place, oldest first."""
    from pyspark.sql import Window

    kept = last_n(messages, "conv_id", "turn", n)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))


def user_blob(messages: DataFrame) -> DataFrame:
    """What the user said, lower-cased, a line per turn."""
    said = messages.where(F.col("role") == "user").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t")))).alias("a"))
    return said.select("conv_id", F.lower(F.array_join(F.transform("a", lambda x: x["t"]), "\n")).alias("blob"))


def salary_slot(blob: Column) -> Column:
    """struct(low, high, currency): "60k" or "60 000 €" of 1,000 to 1,000,000; an upper hint within 25 characters and no lower one make it the upper bound."""
    short, long = r"\b(\d{2,3})\s?k\b", r"\b(\d{1,3}(?:[ .,]\d{3})+)\s?(?:€|eur|\$|usd|£|gbp)"
    k = F.regexp_extract(blob, short, 1).try_cast("int") * 1000
    plain = F.regexp_replace(F.regexp_extract(blob, long, 1), "[ .,]", "").try_cast("int")
    amount = F.coalesce(k, plain)
    amount = F.when(amount.between(1000, 1_000_000), amount)
    found = F.when(k.isNotNull(), F.regexp_extract(blob, short, 0)).otherwise(F.regexp_extract(blob, long, 0))
    at = F.call_function("instr", blob, found)
    near = F.substring(blob, F.greatest(at - 25, F.lit(1)), F.length(found) + F.least(at - 1, F.lit(25)) + 25)
    upper = near.rlike(r"(max|up to|at most|jusqu|no more than)") & ~near.rlike(r"(at least|minimum|min\b|au moins|from)")
    currency = F.when(blob.rlike("€|eur"), "EUR").when(blob.rlike(r"\$|usd"), "USD").when(blob.rlike("£|gbp"), "GBP")
    return F.when(amount.isNotNull(), F.struct(F.when(~upper, amount).alias("low"), F.when(upper, amount).alias("high"), currency.alias("currency")))


def mode_slot(blob: Column) -> Column:
    return F.when(blob.rlike(r"hybrid"), "hybrid").when(blob.rlike(r"(fully remote|remote|télétravail|full remote)"), "remote").when(blob.rlike(r"(on-?site|présentiel)"), "onsite")


def type_slot(blob: Column) -> Column:
    """"no internship" asks for a job."""
    return F.when(blob.rlike(r"(no|not an?|pas de) (internship|stage)"), "job").when(blob.rlike(r"(internship|stage|alternance)"), "internship").when(blob.rlike(r"\b(job|cdi|full-time)\b"), "job")


def fill(existing: Column, found: Column) -> Column:
    """A slot that is set is never overridden."""
    return F.coalesce(existing, found)


def missing_slots(slots: dict[str, Column]) -> Column:
    """Names of the empty slots, in order."""
    return F.array_compact(F.array(*[F.when(c.isNull(), name) for name, c in slots.items()]))


ORDINALS = {"first": 1, "premier": 1, "première": 1, "second": 2, "deuxième": 2, "third": 3, "troisième": 3, "fourth": 4, "fifth": 5}


def ordinal_reference(text: Column) -> Column:
    """1-based number of the offer meant; -1 for the last one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(low.rlike(r"(^|[^a-z])(last|dernier|dernière)([^a-z]|$)"), -1)
    for w, n in ORDINALS.items():
        out = out.when(low.rlike(rf"(^|[^a-z]){w}([^a-z]|$)"), n)
    return F.coalesce(F.regexp_extract(low, r"(?:offer|offre|job|number|numéro|#) ?(?:n° ?)?([0-9]{1,2})", 1).try_cast("int"), out)


def company_reference(texts: DataFrame, companies: DataFrame) -> DataFrame:
    """(id, company) where exactly one company of three letters or more is named by whole words; single words join, longer names are then looked up."""
    words = texts.select("id", F.lower("text").alias("low"), F.explode(F.array_distinct(F.split(F.lower("text"), "[^a-z0-9#]+"))).alias("w"))
    named = companies.where(F.length("company") >= 3).select("company", F.lower("company").alias("c"), F.element_at(F.filter(F.split(F.lower("company"), "[^a-z0-9#]+"), lambda w: w != ""), 1).alias("w"))
    hit = words.join(named, "w").where(F.expr("locate(c, low) > 0")).groupBy("id").agg(F.count_distinct("company").alias("n"), F.min("company").alias("company"))
    return hit.where(F.col("n") == 1).drop("n")


#: Phrases of agreement, and words that take it back.
YES = ["yes", "oui", "ok", "okay", "sure", "go ahead", "d'accord", "vas-y", "confirm", "yes please"]
CAVEATS = ["but", "mais", "not", "pas", "wait", "attends", "except"]


def is_confirmation(text: Column, limit: int = 40) -> Column:
    low = F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"[.!? ]+$", "")
    words = F.split(low, r"[^a-zà-ÿ'-]+")
    plain = ~F.arrays_overlap(words, F.array(*map(F.lit, CAVEATS)))
    return (F.length(low) <= limit) & plain & (low.isin(YES) | (F.get(words, 0).isin(YES) & (F.size(words) <= 3)))


def recommendations(recs: DataFrame, owned: DataFrame, cap: int = 3) -> DataFrame:
    """Owned targets only, one per action and target, ranked by priority and confidence, at most ``cap`` a user."""
    from pyspark.sql import Window

    rank = F.when(F.col("priority") == "high", 3).when(F.col("priority") == "medium", 2).otherwise(1)
    fine = recs.where(F.col("target_id").isNull()).unionByName(recs.where(F.col("target_id").isNotNull()).join(owned.select("user_id", "target_id").distinct(), ["user_id", "target_id"], "left_semi"))
    once = fine.groupBy("user_id", "action", "target_id").agg(F.min(F.struct("rec_seq", "priority", "confidence")).alias("t")).select("user_id", "action", "target_id", "t.*")
    w = Window.partitionBy("user_id").orderBy(rank.desc(), F.desc("confidence"), "rec_seq")
    return once.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)
