"""Token totals by source, language and tokenizer version, maintained from deltas.

Totals are sums, so a batch of changes is a sum too: an insert adds a document and
its tokens, a delete takes them away, a revision takes away the count under the old
version and adds the one under the new.  A batch is summed by group (partially
before the shuffle, so that a hot source is no hot task) and written to its own
folder, named by its batch number; the writer's ``_SUCCESS`` file commits it.
Committing a batch again does nothing, and a batch that died half-way is
overwritten, so deliveries may be repeated.  Totals are the sum of the committed
folders; ``compact`` folds them into one.  A snapshot's list of the batches it stands
for is written before the snapshot itself, and counts from the moment the snapshot is
committed: readers and crashes in between see either the batches or the snapshot.

Defined results: null text has no tokens; null source, language or version are
groups of their own; a group without documents and tokens is left out; an empty
batch commits.  In ``corpus_history`` rows without a doc_id count as documents of their
own, and so do rows that repeat one whole; columns not named play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DELTA = "source string, lang string, version string, documents bigint, tokens bigint"
KEYS = ("source", "lang", "version")

#: Two counting tokenizers, as patterns of a token that Java's and RE2's syntax agree on.
TOKENIZERS = {
    "words-1": r"[^ \t\n\r]+",
    "pieces-2": r"[A-Za-z0-9]+|[^A-Za-z0-9 \t\n\r]",
}


def token_count(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[version])), F.lit(0)).cast("long")


def inserts(df: DataFrame, version: str | Column, tokens: Column) -> DataFrame:
    v = F.lit(version) if isinstance(version, str) else version
    return df.select(F.col("source").cast("string"), F.col("lang").cast("string"), v.alias("version"), F.lit(1).cast("long").alias("documents"), tokens.cast("long").alias("tokens"))


def deletes(df: DataFrame, version: str | Column, tokens: Column) -> DataFrame:
    return inserts(df, version, tokens).withColumns({"documents": F.negative("documents"), "tokens": F.negative("tokens")})


def revisions(df: DataFrame, old_version: str, old_tokens: Column, new_version: str, new_tokens: Column) -> DataFrame:
    """The signed rows of documents that are counted anew."""
    both = F.array(
        F.struct(F.lit(old_version).alias("version"), F.lit(-1).cast("long").alias("documents"), F.negative(old_tokens).cast("long").alias("tokens")),
        F.struct(F.lit(new_version).alias("version"), F.lit(1).cast("long").alias("documents"), new_tokens.cast("long").alias("tokens")),
    )
    return df.select(F.col("source").cast("string"), F.col("lang").cast("string"), F.explode(both).alias("x")).select("source", "lang", "x.*")


class TokenRollup:
    """Committed deltas in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(sc._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def committed(self) -> list[str]:
        """Folders of the committed batches; a snapshot stands for the batches named in it."""
        fs, root = self._fs(self.path)
        if not fs.exists(root):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(root))
        done = [n for n in names if n.startswith("batch=") and self._exists(f"{self.path}/{n}/_SUCCESS")]
        lists = [f"{self.path}/folds={n.removeprefix('batch=')}" for n in done if n.startswith("batch=snapshot-")]
        folded = {r["value"] for r in self.spark.read.text(lists).collect()} if lists else set()  # names of batches
        return [f"{self.path}/{n}" for n in done if n not in folded]

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Add a batch once; false if it had been committed before."""
        folder = f"{self.path}/batch={batch}"
        if self._exists(f"{folder}/_SUCCESS"):
            return False
        summed = deltas.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        summed.write.mode("overwrite").parquet(folder)
        return True

    def totals(self) -> DataFrame:
        return self._summed(self.committed())

    def _summed(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(*folders)
        out = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return out.where((F.col("documents") != 0) | (F.col("tokens") != 0))

    def compact(self, name: str) -> None:
        """Fold the committed batches into one; their numbers stay taken."""
        folders = self.committed()
        if len(folders) < 2 or self._exists(f"{self.path}/batch=snapshot-{name}/_SUCCESS"):
            return
        names = [(f.rpartition("/")[2],) for f in folders]
        self.spark.createDataFrame(names, "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/folds=snapshot-{name}")
        self.commit(f"snapshot-{name}", self._summed(folders))


def corpus_history(docs: DataFrame, path: str) -> TokenRollup:
    """A corpus loaded, cleaned of exact copies and partly counted anew, as three batches, the second delivered twice.

    Later copies (by doc_id) of a text are deleted; what stays and has more than 1,000 tokens is
    counted anew by the second tokenizer.
    """
    from .common import materialise

    spark = docs.sparkSession
    old, new = TOKENIZERS
    body = F.col("text").cast("string")
    counted = docs.select("doc_id", "source", "lang", F.sha2(F.coalesce(body, F.lit("")), 256).alias("digest"), token_count(body, old).alias("n_old"), token_count(body, new).alias("n_new"))
    counted = materialise(counted, "counted")
    firsts = materialise(counted.groupBy("digest").agg(F.min("doc_id").alias("first")), "firsts")  # written, so that adaptive execution can split a hot digest
    marked = counted.join(firsts, "digest").withColumn("copy", F.col("doc_id") != F.col("first"))
    rollup = TokenRollup(spark, path)
    rollup.commit("0001", inserts(counted, old, F.col("n_old")))
    copies = deletes(marked.where("copy"), old, F.col("n_old"))
    rollup.commit("0002", copies)
    rollup.commit("0002", copies)
    rollup.commit("0003", revisions(marked.where(~F.coalesce("copy", F.lit(False)) & (F.col("n_old") > 1000)), old, F.col("n_old"), new, F.col("n_new")))
    return rollup


ORACLE = """
WITH counted AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS body,
         length(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS n_old,
         length(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+|[^A-Za-z0-9 \\t\\n\\r]')) AS n_new
  FROM documents
), kept AS (
  SELECT * FROM (SELECT *, min(doc_id) OVER (PARTITION BY body) AS first FROM counted) WHERE doc_id = first OR doc_id IS NULL
)
SELECT source, lang, CASE WHEN n_old > 1000 THEN 'pieces-2' ELSE 'words-1' END AS version,
       count(*) AS documents, CAST(sum(CASE WHEN n_old > 1000 THEN n_new ELSE n_old END) AS BIGINT) AS tokens
FROM kept GROUP BY 1, 2, 3
"""
