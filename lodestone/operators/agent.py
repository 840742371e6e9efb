"""Steps around a conversation: pending actions, targets, clarifying, recommendations by rule, rewritten bullets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Words of an action that is about one job, and the questions that ask which.
JOB_WORDS = ["review", "analy", "fit", "match", "top", "best", "compare"]
WHICH = {"fr": "De quelle offre parlez-vous exactement ? (donnez son numéro)", "en": "Which of your selected roles do you mean exactly? (give its number)"}


def pending_is_valid(kind: Column, job_ids: Column, proposed_at: Column, now: Column, minutes: int = 30) -> Column:
    """An application that was proposed for some jobs at a readable time not more than ``minutes`` ago; a time without a zone is UTC."""
    zoned = F.when(proposed_at.rlike(r"(Z|[+-]\d\d:?\d\d)$"), proposed_at).otherwise(F.concat(proposed_at, F.lit("Z")))
    age = F.timestamp_diff("MICROSECOND", zoned.try_cast("timestamp"), now)
    return F.coalesce((kind == "apply") & (F.size(job_ids) > 0) & (age <= minutes * 60_000_000), F.lit(False))


def apply_targets(scope: Column, needle: Column, job_ids: Column, selected: Column) -> Column:
    """Identifiers to apply to, of ``selected`` (array of struct(id, title)): all, those whose title holds ``needle``, or named ones, by identifier or else by place."""
    ids = F.transform(selected, lambda s: s["id"])
    word = F.lower(F.trim(F.coalesce(needle, F.lit(""))))
    titled = F.transform(F.filter(selected, lambda s: (word != "") & F.contains(F.lower(F.coalesce(s["title"], F.lit(""))), word)), lambda s: s["id"])
    named = F.filter(job_ids, lambda j: F.array_contains(ids, j))
    places = F.array_compact(F.transform(job_ids, lambda j: F.when(F.trim(j).rlike("^[0-9]+$"), F.get(ids, F.trim(j).try_cast("int") - 1))))
    by_filter = (scope == "filter") & (F.coalesce(needle, F.lit("")) != "")
    return F.when(scope == "all", ids).when(by_filter, titled).when(F.size(named) > 0, named).otherwise(places)


def resolved_targets(recs: DataFrame, selected: Column, lang: Column, found: Column) -> DataFrame:
    """Recommendations about a job without a target: one that reviews or compares gets the best of ``found``; else the only selected job; of several it asks which; without any it goes.

    recs: action, target_type, target_id, question; adds requires_information.
    """
    about = (F.col("target_type") == "job") & F.col("target_id").isNull()
    focus = F.exists(F.array(*map(F.lit, JOB_WORDS)), lambda w: F.contains(F.lower("action"), w))
    best = recs.withColumn("target_id", F.when(about & focus, F.get(found, 0)).otherwise(F.col("target_id")))
    n = F.coalesce(F.size(selected), F.lit(0))
    asked = best.where(~about | (n > 0)).withColumn("requires_information", about & (n >= 2))
    question = F.when(F.col("requires_information"), F.coalesce("question", F.when(lang == "fr", WHICH["fr"]).otherwise(WHICH["en"]))).otherwise(F.col("question"))
    return asked.withColumn("question", question).withColumn("target_id", F.when(about & (n == 1), F.get(selected, 0)).otherwise(F.col("target_id")))


def next_actions(c: dict[str, Column]) -> Column:
    """Actions by rule, as array of struct(type, subject), in a fixed order; a rule whose fields are null doesn't fire.

    Fields: has_job, ats, summary_words, bullet_counts, missing, uncertain, has_cv, has_letter, letter_outdated, selected, applied, weak_jobs, commanded, topic.
    """
    strings = "array<string>"
    act = lambda t, when: F.when(when, F.array(F.struct(F.lit(t).alias("type"), F.lit(None).cast("string").alias("subject"))))
    many = lambda t, xs, cap: F.transform(F.slice(F.coalesce(xs, F.array().cast(strings)), 1, cap), lambda x: F.struct(F.lit(t).alias("type"), x.alias("subject")))
    job = F.coalesce(c["has_job"], F.lit(False))
    thin = F.exists(c["bullet_counts"], lambda n: n == 0) | F.coalesce(c["ats"] < 55, F.lit(False))
    unapplied = c["selected"] - c["applied"]
    parts = [
        act("review_match", job & (c["ats"] < 50)),
        act("improve_summary", job & (c["ats"] < 60) & (c["summary_words"] < 25)),
        act("review_experience", job & thin & (F.size(c["bullet_counts"]) > 0)),
        F.when(job, many("confirm_skill", c["missing"], 8)),
        F.when(job, many("review_uncertain_skill", c["uncertain"], 5)),
        act("generate_targeted_cv", job & ~c["has_cv"]),
        act("generate_cover_letter", ~c["has_letter"] & (job | (c["selected"] > 0))),
        act("review_cover_letter", c["has_letter"] & c["letter_outdated"]),
        act("review_selected_jobs", (c["selected"] >= 3) & (c["applied"] == 0)),
        act("apply_to_selected_jobs", (unapplied >= 1) & ~c["commanded"]),
        many("review_job", c["weak_jobs"], 5),
        F.when(c["topic"].isNotNull(), F.array(F.struct(F.lit("request_information").alias("type"), c["topic"].alias("subject")))),
    ]
    return F.flatten(F.array_compact(F.array(*parts)))


def role_bullets(experience: DataFrame, rewritten: DataFrame) -> DataFrame:
    """Experience (id, position, company, achievements, description) with the bullets written anew for "position @ company", ignoring case.

    Of several the last by seq (then by the bullets) counts; without any, or an empty one, the achievements stay, or else the description.
    """
    key = F.lower(F.concat_ws(" @ ", F.coalesce("position", F.lit("")), F.coalesce("company", F.lit(""))))
    last = rewritten.where(F.col("role") != "").groupBy("id", F.lower("role").alias("__k")).agg(F.max_by("bullets", F.struct("seq", "bullets")).alias("__b"))
    own = F.when(F.size("achievements") > 0, F.col("achievements")).when(F.col("description") != "", F.array("description")).otherwise(F.array().cast("array<string>"))
    joined = experience.withColumn("__k", key).join(last, ["id", "__k"], "left")
    return joined.withColumn("bullets", F.when(F.size("__b") > 0, F.col("__b")).otherwise(own)).drop("__k", "__b")


def access_status(requests: DataFrame, rows: DataFrame) -> DataFrame:
    """Requests (id, user_id) with a status: 200 for the owner of the row, 403 for another user, 404 where no row has the identifier."""
    owners = rows.groupBy("id").agg(F.min("user_id").alias("__owner"))
    status = F.when(F.col("__owner").isNull(), 404).when(F.col("__owner") == F.col("user_id"), 200).otherwise(403)
    return requests.join(owners, "id", "left").withColumn("status", status).drop("__owner")
