"""Sinks: JSON lines, ordered CSV, append-only logs and manifests."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame

from larkspan.sources.readers import CSV


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str], order: Column | str) -> None:
    """One CSV in a fixed order, for results of a bounded size."""
    df.orderBy(order).select(fields).coalesce(1).write.mode("overwrite").options(**CSV).csv(path)


def append_responses(df: DataFrame, path: str) -> None:
    """Adds rows to a log partitioned by model and never rewrites any."""
    df.write.mode("append").partitionBy("model_name").parquet(path)


def manifest(values: dict, path: str, script: str | None = None) -> dict:
    """Writes a manifest with the SHA-256 of `script`."""
    if script:
        with open(script, "rb") as f:
            values = values | {"script_sha256": hashlib.sha256(f.read()).hexdigest()}
    with open(path, "w") as f:
        json.dump(values, f, indent=2, default=str)
    return values
