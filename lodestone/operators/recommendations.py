"""Suggestions to users: what may not be shown goes, what isn't certain becomes a question, and the best few are kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.language import detect_strict

# Verbs of destruction, what belongs to users, words of making something new, of documents, of applying and deleting
FORBIDDEN = (
    r"(?i)delet\w*[_ ]?(?:the|my|all|every)?[_ ]?(all|account|user|profile|document|data)|drop[_ ]?table|shell|exec\w*[_ ]?sql|remov\w*[_ ]?account|format\w*[_ ]?disk|sudo|rm[_ ]?-rf|"
    r"\brm\b|truncat\w*|grant|revoke|shut[_ -]?down|(?<![a-zA-Z])kill(?:ed|ing|s)?(?![a-zA-Z])|"
    r"supprim\w*[_ ]?(?:le|la|les|du|de|des)?[_ ]?(tout|compte|utilisateur|profil|donn[eé]es)|effa[cç]\w*[_ ]?(?:le|la|les|du|de|des)?[_ ]?(tout|compte|utilisateur|profil|donn[eé]es)"
)
OWNABLE = ["job", "cv", "letter", "application"]
MAKING = ["generate", "create", "write", "draft", "rédig", "créer", "écrire", "redig"]
LETTERS, RESUMES = ["letter", "lettre"], ["cv", "resume", "résumé", "curriculum"]
APPLYING, CONFIRMED = ["apply", "postul"], ["apply", "postul", "delete", "supprim"]
WEIGHTS = {"high": 2, "medium": 1}
MOST = 3


def _any(x: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w))


def validated(recs: DataFrame, owned: DataFrame, applied: DataFrame, made: DataFrame, skills: DataFrame, language: str | None = None) -> DataFrame:
    """``recs`` (user_id, rec_seq, action, target_type, target_id, skill, question, requires_information, requires_confirmation, title, message, reason, ...) that may be shown.

    Dropped: empty and destructive actions; targets that the user doesn't own (``owned``: user_id, target_type, target_id); applying to a job of ``applied``
    (user_id, target_id); making a letter or résumé for a job that has one (``made``: user_id, target_id, category); texts surely in another ``language``; all but the first
    of an action on a target.  A target of a type that can't be owned is forgotten.  A skill that the profile (``skills``: user_id, skill) doesn't have turns a claim into a
    question.  Applying and deleting ask for confirmation.
    """
    a = F.lower(F.trim(F.coalesce("action", F.lit(""))))
    r = recs.withColumn("action", a).where((F.col("action") != "") & ~F.col("action").rlike(FORBIDDEN))
    r = r.withColumn("target_id", F.when(F.col("target_type").isin(OWNABLE), F.col("target_id")))
    keys = ["user_id", "target_type", "target_id"]
    r = r.where(F.col("target_id").isNull()).unionByName(r.where(F.col("target_id").isNotNull()).join(owned.select(*keys).distinct(), keys, "left_semi"))
    action, on_job = F.col("action"), F.col("target_type") == "job"
    about = F.when(_any(action, LETTERS) & _any(action, MAKING), "letter")
    again = F.array_compact(F.array(F.when(_any(action, APPLYING), F.lit("applied")), about, F.when(_any(action, RESUMES) & _any(action, MAKING), F.lit("cv"))))
    # a suggestion to make a letter, or none at all, is judged by that alone
    again = F.when(_any(action, LETTERS) & ~_any(action, MAKING), F.filter(again, lambda c: c == "applied")).otherwise(again)
    state = applied.select("user_id", "target_id", F.lit("applied").alias("category")).unionByName(made.select("user_id", "target_id", "category")).distinct()
    meant = r.where(on_job & F.col("target_id").isNotNull()).select("user_id", "rec_seq", "target_id", F.explode(again).alias("category"))
    against = meant.join(state, ["user_id", "target_id", "category"], "left_semi").select("user_id", "rec_seq").distinct()
    r = r.join(against, ["user_id", "rec_seq"], "left_anti")
    known = skills.select("user_id", F.lower(F.trim("skill")).alias("__skill")).distinct().withColumn("__known", F.lit(True))
    r = r.withColumn("__skill", F.lower(F.trim("skill"))).join(known, ["user_id", "__skill"], "left")
    doubt = F.coalesce((F.col("skill") != "") & ~F.col("requires_information") & F.col("__known").isNull(), F.lit(False))
    ask = F.concat(F.lit("Avez-vous vraiment de l'expérience avec "), "skill", F.lit(" ?")) if language == "fr" else F.concat(F.lit("Do you actually have experience with "), "skill", F.lit("?"))
    r = r.withColumn("question", F.when(doubt, F.coalesce(F.nullif("question", F.lit("")), ask)).otherwise(F.col("question"))).withColumn("requires_information", doubt | F.coalesce("requires_information", F.lit(False))).drop("__skill", "__known")
    if language:
        said = detect_strict(F.concat_ws(" ", "title", "message", "reason", F.coalesce("question", F.lit(""))))
        r = r.where(said.isNull() | (said == language))
    r = r.withColumn("requires_confirmation", _any(F.col("action"), CONFIRMED) | F.coalesce("requires_confirmation", F.lit(False)))
    rest = [c for c in r.columns if c not in ("user_id", "action", "target_id", "rec_seq")]
    return r.groupBy("user_id", "action", "target_id").agg(F.min(F.struct("rec_seq", *rest)).alias("t")).select("user_id", "action", "target_id", "t.*")


def ranked(recs: DataFrame, most: int = MOST) -> DataFrame:
    """The best ``most`` of each user with their ``place``: by priority, then those that need no more information, then confidence (ties: the first).

    Of those about one kind of document (letter, résumé) for one target only the best counts; others never collapse.
    """
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("priority")], F.lit(0))
    order = [weight.desc(), F.coalesce("requires_information", F.lit(False)), F.col("confidence").desc_nulls_last(), "rec_seq"]
    kind = F.when(_any(F.lower("action"), LETTERS), "letter").when(_any(F.lower("action"), RESUMES), "cv")
    same = Window.partitionBy("user_id", "target_type", "target_id", "__kind", F.when(F.col("__kind").isNull(), F.col("rec_seq"))).orderBy(*order)
    best = recs.withColumn("__kind", kind).withColumn("__k", F.row_number().over(same)).where("__k = 1").drop("__k", "__kind")
    return best.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))).where(F.col("place") <= most)
