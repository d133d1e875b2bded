"""Names for columns made on the way that no input column has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(df: DataFrame, prefix: str) -> str:
    """`prefix`, with underscores before it until no column of `df` begins so in any case."""
    names = [c.lower() for c in df.columns]
    while any(c.startswith(prefix.lower()) for c in names):
        prefix = "_" + prefix
    return prefix
