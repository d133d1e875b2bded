"""Gapless numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def numbered(df: DataFrame, key: Column, name: str, seed: str = "") -> DataFrame:
    """`df` with a number from 0 in the order of md5(seed || key).

    Rows are numbered inside the 4,096 ranges of the hash's first three digits;
    the ranges' counts (a bounded table) give each its first number.
    """
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(seed), key.cast("string")))).withColumn("_b", F.substring("_h", 1, 3))
    counts = hashed.groupBy("_b").count()
    first = counts.select("_b", (F.sum("count").over(Window.orderBy("_b")) - F.col("count")).alias("_first"))
    nth = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)) - 1
    return hashed.withColumn("_nth", nth).join(F.broadcast(first), "_b").withColumn(name, F.col("_first") + F.col("_nth")).drop("_h", "_b", "_first", "_nth")
