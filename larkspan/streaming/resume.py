"""The resumable scoring step as a stream of prompt files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from larkspan.operators.scoring import SCORERS, pending, wanted_calls


def score_stream(spark: SparkSession, prompts_dir: str, schema: StructType, log_dir: str, checkpoint: str, scorer: str = "mock", runs: int = 1) -> StreamingQuery:
    """Scores new prompt files as they come; what the log already has is left out, so a repeated batch adds nothing."""

    def step(batch: DataFrame, _: int) -> None:
        calls = wanted_calls(batch, runs)
        try:
            log = spark.read.parquet(log_dir)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            log = None
        todo = calls if log is None else pending(calls, log)
        SCORERS[scorer](todo).write.mode("append").parquet(log_dir)

    stream = spark.readStream.schema(schema).parquet(prompts_dir)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
