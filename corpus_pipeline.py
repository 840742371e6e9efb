"""Documents to packed training sequences: five stages, each by one operator of ``lodestone.llm``.

Every stage takes what its predecessor kept, written as Parquet and read again.
All but the last return the columns of ``documents``; ``n_chars`` follows the text.

Defined results, for every stage: an empty table gives no rows; columns other than
doc_id, text, lang and n_chars are carried through unread, whatever their names; rows
that repeat one whole are treated alike.  Each stage's docstring says what nulls and
ties do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lodestone.llm import langid, minhash, packing, secret_scan, suffix
from lodestone.llm.common import fresh, materialise, scope

LEAST_SCORE = 0.5


def _recount(docs: DataFrame, order: list[str]) -> DataFrame:
    out = docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in order else docs
    return out.select(*order)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a language: null, without letters, or between languages.

    Rows without lang or doc_id are judged like others; without any labelled row all go.
    A tie of two languages halves the score and stays at 0.5.
    """
    model = langid.train(docs)
    names = fresh(docs, "lang_pred"), fresh(docs, "score")
    seen = langid.predict(docs, model, names=names)
    return seen.where((F.col(names[0]) != langid.UNDETERMINED) & (F.col(names[1]) >= LEAST_SCORE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each near-duplicate class the document of the smallest doc_id.

    Null and wordless texts are copies of one another.  Rows without a doc_id come after all others;
    a class of such rows keeps one text.  Repeated rows of the document that stays stay.
    """
    return minhash.deduplicate(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later copies of repeated passages; documents that have nothing else go, and so do null texts.

    The first copy is that of the smallest doc_id (rows without one come first), then of the first place.
    """
    cut = suffix.remove_repeats(docs, mode="later")
    return _recount(cut.where(F.col("text").rlike(r"\S")), docs.columns)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; null texts stay null."""
    ratios = secret_scan.train(secret_scan.labelled_samples(docs))
    return _recount(secret_scan.redact(secret_scan.scan(docs, ratios)), docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1,024 ids; a null text is its closing id, each row is packed for itself."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("secret_redaction", secret_redaction),
    ("sequence_packing", sequence_packing),
]

ORACLE_SQL = None  # BagMinHash candidates, Markov spans and packing are no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scope(spark) as paths:  # once a stage is written, nothing reads its own tables or its predecessor's
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
            written = paths.pop()
            paths += [path] if path else []
        path = written
    return STAGES[-1][1](spark, docs, sf_dir)
