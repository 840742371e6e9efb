"""Canonical JSON: sorted keys, no spaces, everything beyond ASCII escaped, so that equal values have equal digests."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T


def _written(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
    except (ValueError, RecursionError):
        return None


def canonical_json(x: Column) -> Column:
    """The canonical text of a JSON text (of a VARIANT: of its ``to_json``); null for null and for what is no JSON.  Of repeated keys the last counts."""

    @F.pandas_udf(T.StringType())
    def write(texts: pd.Series) -> pd.Series:
        return texts.map(_written)

    return write(x.cast("string"))


def digest(x: Column) -> Column:
    """SHA-256 of the canonical text, in hexadecimal."""
    return F.sha2(canonical_json(x), 256)
