"""Trees of rows that name their parent: the newest root of a kind, and everything below it."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F


def newest(stories: DataFrame, of_kind: Column, when: str, ident: str = "id") -> DataFrame:
    """The one story of a kind with the latest date (ties: the smallest id; without a date: last); none if there is none."""
    return stories.where(of_kind).orderBy(F.col(when).desc_nulls_last(), ident).limit(1)


def descend(nodes: DataFrame, roots: DataFrame, ident: str = "id", parent: str = "parent", deepest: int = 100) -> DataFrame:
    """(root, id, depth, path) of all nodes below ``roots`` (id) and of these: a recursive query that joins one level with its children a turn.

    A node whose parent is unknown or null is below no root.  A node on a cycle is never below a root, as a root has no
    way in from its own descendants but through itself; ``path`` (ids from the root) ends such turns.  More than ``deepest`` levels are an error of Spark.
    """
    spark = nodes.sparkSession
    names = [f"lodestone_{k}_{uuid.uuid4().hex[:8]}" for k in ("nodes", "roots")]
    nodes.select(F.col(ident).alias("id"), F.col(parent).alias("parent")).createOrReplaceTempView(names[0])
    roots.select(F.col(ident).alias("id")).distinct().createOrReplaceTempView(names[1])
    spark.conf.set("spark.sql.cteRecursionLevelLimit", str(deepest))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark.sql(
        f"""WITH RECURSIVE below(root, id, depth, path) AS (
            SELECT id, id, 0, array(id) FROM {names[1]}
            UNION ALL
            SELECT b.root, n.id, b.depth + 1, array_append(b.path, n.id) FROM below b JOIN {names[0]} n ON n.parent = b.id WHERE NOT array_contains(b.path, n.id))
        SELECT root, id, depth, path FROM below"""
    )
