"""Deduplication, stratified and proportional samples, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.functions.numbering import numbered


def first_of_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in `order`; copies fold before the exchange, so a frequent key is no hot spot."""
    rows = F.struct(*(F.col(c) for c in df.columns))
    return df.groupBy(key).agg(F.min_by(rows, F.struct(*order)).alias("_r")).select("_r.*")


def stratified(df: DataFrame, quotas: dict[int, int], seed: str, stratum: str = "stars", key: str = "review_id") -> DataFrame:
    """Up to quota rows of every (source, stratum), by md5 of seed, source and id.  The constant bound lets Spark keep only the top rows before the exchange."""
    order = F.md5(F.concat_ws(":", F.lit(seed), "source", F.col(key).cast("string")))
    rn = F.row_number().over(Window.partitionBy("source", stratum).orderBy(order, key))
    quota = F.coalesce(*(F.when(F.col(stratum) == s, F.lit(q)) for s, q in quotas.items()), F.lit(0))
    return df.withColumn("_rn", rn).filter(F.col("_rn") <= max(quotas.values())).filter(F.col("_rn") <= quota).drop("_rn")


def shortfall(eligible: DataFrame, quotas: dict[int, int]) -> DataFrame:
    """source, stars, n_eligible, n_selected, n_short."""
    grid = eligible.select("source").distinct().withColumn("_q", F.explode(F.array(*(F.struct(F.lit(s).alias("stars"), F.lit(q).alias("quota")) for s, q in quotas.items())))).select("source", "_q.*")
    counts = eligible.groupBy("source", "stars").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return grid.join(counts, ["source", "stars"], "left").select("source", "stars", n.alias("n_eligible"), F.least(n, F.col("quota")).alias("n_selected"), (F.col("quota") - F.least(n, F.col("quota"))).alias("n_short"))


def proportional(df: DataFrame, k: int) -> DataFrame:
    """source, stars, n, take: max(1, half-even k * share) of every stratum."""
    counts = df.groupBy("source", "stars").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("source", "stars", "n", F.greatest(F.lit(1), F.rint(F.lit(k) * F.col("n") / F.col("total")).cast("int")).alias("take"))


def annotation_sheet(df: DataFrame, k: int, seed: str) -> DataFrame:
    """Blind columns of a proportional sample, numbered in shuffled order."""
    rn = F.row_number().over(Window.partitionBy("source", "stars").orderBy(F.md5(F.concat(F.lit(seed), "review_id")), "review_id"))
    picked = df.withColumn("_rn", rn).filter(F.col("_rn") <= k).join(F.broadcast(proportional(df, k).select("source", "stars", "take")), ["source", "stars"]).filter("_rn <= take")
    blank = {c: F.lit("") for c in ("annotator1_label", "annotator2_label", "notes")}
    return numbered(picked.select("review_id", "text").withColumns(blank), F.col("review_id"), "seq", seed)


def label_totals(selected: DataFrame) -> DataFrame:
    return selected.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("n"))


def preview(df: DataFrame, key: str, n: int = 10, seed: str = "42") -> DataFrame:
    """`n` rows in an order that only the seed and the key decide."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)
