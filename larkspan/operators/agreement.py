"""The annotation sheet against the reviews: keys, labels, raters and the gold label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions import text as T
from larkspan.operators.inference import kappa


def sheet_with_reviews(sheet: DataFrame, reviews: DataFrame) -> DataFrame:
    """id, a, b, gold of every row of a sheet (review_id, annotator1_label, annotator2_label), labels normalised; a review that isn't there is an error."""
    gold = reviews.select("review_id", F.col("sentiment_label").alias("gold"), F.lit(True).alias("_there"))
    rows = sheet.join(gold, "review_id", "left")
    there = F.when(F.col("_there"), F.col("review_id")).otherwise(F.raise_error(F.concat(F.lit("the sheet names a review that isn't there: "), F.coalesce("review_id", F.lit("(none)")))).cast("string"))
    return rows.select(there.alias("id"), T.normal_label(F.col("annotator1_label")).alias("a"), T.normal_label(F.col("annotator2_label")).alias("b"), "gold")


def invalid_labels(rows: DataFrame) -> DataFrame:
    """The rows (id, a, b) of which a label is none of the known ones."""
    return rows.filter(~(F.col("a").isin(T.LABELS) & F.col("b").isin(T.LABELS)))


def against_gold(rows: DataFrame) -> DataFrame:
    """rater, n, raw_agreement, kappa, status of each rater against the gold label."""
    one = lambda rater: kappa(rows.select("id", F.col(rater).alias("a"), F.col("gold").alias("b"))).withColumn("rater", F.lit(rater))
    return one("a").union(one("b")).select("rater", "n", "raw_agreement", "kappa", "status")
