"""Names of skills: normal form, tokens, splitting, and matching wanted skills with a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Other names of skills.
ALIASES = {
    "postgres": "postgresql",
    "psql": "postgresql",
    "k8s": "kubernetes",
    "js": "javascript",
    "ecmascript": "javascript",
    "ts": "typescript",
    "py": "python",
    "golang": "go",
    "gcp": "google cloud",
    "google cloud platform": "google cloud",
    "aws cloud": "aws",
    "amazon web services": "aws",
    "node": "node.js",
    "nodejs": "node.js",
    "reactjs": "react",
    "react.js": "react",
    "vuejs": "vue",
    "vue.js": "vue",
    "postgre": "postgresql",
    "ms sql": "sql server",
    "mssql": "sql server",
    "gh actions": "github actions",
    "ci cd": "ci/cd",
    "cicd": "ci/cd",
    "rest api": "rest",
    "restful": "rest",
    "tf": "terraform",
    "dl": "deep learning",
    "ml": "machine learning",
    "nlp": "natural language processing",
}


def normalise(x: Column) -> Column:
    """Lower case without a version at the end or punctuation, white space collapsed, other names replaced."""
    t = F.lower(F.trim(F.coalesce(x, F.lit(""))))
    t = F.regexp_replace(t, r"[\s\-_]*v?\d+(?:\.\d+){0,3}\+?$", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"[^a-z0-9+#./ ]+", " "), r"\s+", " "))
    table = F.create_map(*[F.lit(v) for kv in ALIASES.items() for v in kv])
    return F.coalesce(F.try_element_at(table, t), t)


def skill_tokens(x: Column) -> Column:
    """Distinct parts of three characters or more of the normal form."""
    return F.array_distinct(F.filter(F.split(normalise(x), r"[ /.\-_]+"), lambda w: F.length(w) >= 3))


def split_items(x: Column) -> Column:
    """Items between commas, semicolons, slashes with spaces and bullets."""
    parts = F.split(F.coalesce(x, F.lit("")), r"\s*[,;]\s*|\s+/\s+|\s+•\s+")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^[ .·]+|[ .·]+$", "")), lambda p: p != "")


def match_tokens(*texts: Column) -> Column:
    """Distinct tokens of letters, digits, plus, hash and inner dots."""
    blob = F.lower(F.concat_ws(" ", *texts))
    found = F.regexp_extract_all(blob, F.lit(r"[a-z0-9+#][a-z0-9+#.]*"), F.lit(0))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.regexp_replace(t, r"^\.+|\.+$", "")), lambda t: t != ""))


def matched_skills(wanted: Column, tokens: Column) -> Column:
    """The wanted skills that share a token with ``tokens``, in order."""
    return F.filter(wanted, lambda s: F.arrays_overlap(match_tokens(s), tokens))


def missing_skills(wanted: Column, tokens: Column, cap: int = 12) -> Column:
    """The wanted skills that share none, at most ``cap``."""
    return F.slice(F.filter(wanted, lambda s: ~F.arrays_overlap(match_tokens(s), tokens)), 1, cap)


def analyse(wanted: DataFrame, owned: DataFrame) -> DataFrame:
    """(id, skill, matched_to, confidence) for every wanted (id, skill) against the id's owned (id, place, skill).

    exact: equal normal forms, the first by place.  fuzzy: the first owned one by place whose tokens are a
    subset or superset, or share two.  Otherwise confidence is missing.  Candidates come from an equi-join on
    tokens, so that profiles are never crossed with wishes.
    """
    w = wanted.select("id", "skill", normalise(F.col("skill")).alias("norm"), skill_tokens(F.col("skill")).alias("wt")).where(F.col("norm") != "")
    o = owned.select("id", F.col("place"), F.col("skill").alias("raw"), normalise(F.col("skill")).alias("norm")).where(F.col("norm") != "")
    first = o.groupBy("id", "norm").agg(F.min(F.struct("place", "raw")).alias("o")).select("id", "norm", "o.*")
    exact = w.join(first, ["id", "norm"]).select("id", "skill", F.col("raw").alias("exact"))
    tokens = first.select("id", "place", "raw", skill_tokens(F.col("raw")).alias("ot"))
    shared = w.select("id", "skill", F.size("wt").alias("n"), F.explode("wt").alias("t")).join(tokens.select("id", "place", "raw", F.size("ot").alias("m"), F.explode("ot").alias("t")), ["id", "t"])
    near = shared.groupBy("id", "skill", "place", "raw", "n", "m").agg(F.count("*").alias("k")).where((F.col("k") >= 2) | (F.col("k") == F.col("n")) | (F.col("k") == F.col("m")))
    fuzzy = near.groupBy("id", "skill").agg(F.min(F.struct("place", "raw")).alias("f")).select("id", "skill", F.col("f.raw").alias("fuzzy"))
    out = w.select("id", "skill").distinct().join(exact.distinct(), ["id", "skill"], "left").join(fuzzy, ["id", "skill"], "left")
    confidence = F.when(F.col("exact").isNotNull(), "exact").when(F.col("fuzzy").isNotNull(), "fuzzy").otherwise("missing")
    return out.select("id", "skill", F.coalesce("exact", "fuzzy").alias("matched_to"), confidence.alias("confidence"))
