"""Shipping the package, the shared folder, cutting lineage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Bytes of an Arrow batch for Python workers, where the session leaves Spark's default of 64 MB: a worker holds a few batches at a time.
ARROW_BYTES = 16 << 20


def ship(spark: SparkSession) -> None:
    """Make the package importable in the executors' Python workers (once per application), and keep their batches small."""
    batch, default = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"
    if spark.conf.get(batch, default) == default:
        spark.conf.set(batch, f"{ARROW_BYTES}b")
    sc = spark.sparkContext
    if getattr(sc, "_lodestone_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="lodestone-")
    path = os.path.join(folder, "lodestone_pkg.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, dirs, names in os.walk(os.path.join(_ROOT, "lodestone")):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(top, n)
                    z.write(full, os.path.relpath(full, _ROOT))
    sc.addPyFile(path)
    sc._lodestone_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, set here only where unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = getattr(spark.sparkContext, "_lodestone_dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-lodestone-")
        spark.sparkContext._lodestone_dir = folder
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_OPEN: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/lodestone/{name}-{uuid.uuid4().hex[:12]}"
    for paths in _OPEN:
        paths.append(path)
    return path


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Tables written inside are removed at the end, but for the paths that the block takes out of the list it is given.

    For steps that end in a written table: nothing reads the step's own tables after that.
    """
    paths: list[str] = []
    _OPEN.append(paths)
    try:
        yield paths
    finally:
        _OPEN.pop()
        drop_paths(spark, *paths)


def materialise(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and lost executors don't matter.

    ``parts`` bounds the number of files of a table whose size is known to be small (see ``parts_for``).
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    (df if parts is None else df.coalesce(parts)).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(rows: int, each: int = 200_000) -> int:
    """Parts for a table of narrow rows: it grows with them, and small tables don't cost hundreds of empty tasks."""
    return max(6, -(-rows // each))


def drop_paths(spark: SparkSession, *paths: str) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        hp = jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(conf).delete(hp, True)
