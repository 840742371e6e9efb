"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), digests_only=True)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import digests, fingerprints

    return digests(fingerprints(table(spark, sf_dir, "documents")))


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import pages_through_warc

    return pages_through_warc(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import classes

    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix import removal_digests

    return removal_digests(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import learn_and_predict

    return learn_and_predict(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op7_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import scratch
    from .token_rollup import corpus_history

    return corpus_history(table(spark, sf_dir, "documents"), scratch(spark, "rollup")).totals()


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import digests, labelled_samples, scan, train

    docs = table(spark, sf_dir, "documents")
    return digests(scan(docs, train(labelled_samples(docs))))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import nearest

    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 50 == 0))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic import digests, planted

    return digests(planted(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import detect, digests

    return digests(detect(table(spark, sf_dir, "documents"), keep=("doc_id",)))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened_rows

    return whitened_rows(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_fingerprints": op2_fingerprints,
    "op3_arc_to_warc": op3_arc_to_warc,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_repeated_passages": op5_repeated_passages,
    "op6_language_id": op6_language_id,
    "op7_token_rollup": op7_token_rollup,
    "op8_secret_scan": op8_secret_scan,
    "op9_nearest": op9_nearest,
    "op10_packing": op10_packing,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_personal_data": op12_personal_data,
    "op13_whitening": op13_whitening,
}

from .token_rollup import ORACLE as _ROLLUP  # noqa: E402

ORACLE_SQL: dict[str, str] = {"op7_token_rollup": _ROLLUP}
