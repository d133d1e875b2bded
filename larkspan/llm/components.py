"""Connected components over an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.lineage import saved

#: A hub's links, and the nodes of one label, meet their label in as many groups.
SALTS = 8


def _salt(node: str) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(SALTS)).cast("byte").alias("salt")


def _dealt(labels: DataFrame) -> DataFrame:
    return labels.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<byte>")))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all ends of `edges` (a long, b long); the component is its smallest node.

    Each round takes the smallest label among neighbours and then jumps to the
    label's own label, so rounds grow with the logarithm of the longest path.
    Labels only fall, so an unchanged sum ends it.  No edges: an empty table.
    """
    both = saved(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct().select("a", "b", _salt("a")))
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")))
    total = None
    while True:
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
        near = both.join(_dealt(labels.withColumnRenamed("node", "b")), ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("least"))
        nearer = labels.join(near, "node").select("node", F.least("component", "least").alias("component"))
        jump = _dealt(nearer.select(F.col("node").alias("component"), F.col("component").alias("further")))
        labels = saved(nearer.select("node", "component", _salt("node")).join(jump, ["component", "salt"], "left").select("node", F.coalesce("further", "component").alias("component")))
