"""What the operators share; shipping and the shared folder are those of ``lodestone.storage``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..storage import drop_paths, materialise, parts_for, scope, scratch, shared_dir, ship  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it the first that no column of ``df`` has (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
