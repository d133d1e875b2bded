"""Descriptive statistics: means, contrasts, confusion, accuracy and flips."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.text import LABELS
from larkspan.operators.design import NAMED, n_named


def complete_models(merged: DataFrame, least: int = 250) -> DataFrame:
    """model, n_reviews, status: models with fewer reviews than `least` are reported, not dropped."""
    n = merged.groupBy("model").agg(F.countDistinct("review_id").alias("n_reviews"))
    return n.withColumn("status", F.when(F.col("n_reviews") >= least, "ok").otherwise("too few reviews"))


def of_complete_models(merged: DataFrame, least: int = 250) -> DataFrame:
    """The rows of models with enough reviews: what the statistics are taken over."""
    return merged.join(complete_models(merged, least).filter("status = 'ok'").select("model"), "model", "left_semi")


def matrix_from_json(column: str) -> Column:
    """The matrix that `class_metrics` writes, as arrays: rows by truth."""
    return F.from_json(column, "array<array<bigint>>")


def condition_means(merged: DataFrame) -> DataFrame:
    named = merged.filter(F.col("condition").isin(NAMED))
    sem = F.stddev_samp("score") / F.sqrt(F.count("score"))
    return named.groupBy("model", "condition").agg(F.avg("score").alias("mean_score"), sem.alias("sem"), (1.96 * sem).alias("half_bar"))


def contrast(merged: DataFrame, column: str, a: str, b: str) -> DataFrame:
    """Row-level mean difference a - b, pooled SD over both levels, Cohen's d (null if the SD is 0).  Rows fold by review first, so reviews are counted without a copy of the rows."""
    both = merged.filter(F.col("condition").isin(NAMED) & F.col(column).isin(a, b))
    score, at = F.col("score"), lambda level, x: F.when(F.col(column) == level, x)
    per = both.groupBy("model", "review_id").agg(F.sum(at(a, score)).alias("sa"), F.count(at(a, score)).alias("na"), F.sum(at(b, score)).alias("sb"), F.count(at(b, score)).alias("nb"), F.sum(score * score).alias("q"))
    g = per.groupBy("model").agg(F.count("review_id").alias("n_clusters"), *(F.sum(c).alias(c) for c in ("sa", "na", "sb", "nb", "q")))
    n, s = F.col("na") + F.col("nb"), (F.coalesce("sa", F.lit(0)) + F.coalesce("sb", F.lit(0))).cast("double")
    sd = F.when(n > 1, F.sqrt(F.greatest(F.col("q") - s * s / n, F.lit(0.0)) / (n - 1)))
    m = g.select("model", "n_clusters", F.try_divide("sa", "na").alias("mean_a"), F.try_divide("sb", "nb").alias("mean_b"), sd.alias("sd"))
    return m.withColumn("mean_diff", F.col("mean_a") - F.col("mean_b")).withColumn("cohens_d", F.col("mean_diff") / F.nullif("sd", F.lit(0.0)))


def confusion(merged: DataFrame) -> DataFrame:
    """model, condition, truth, predicted, n: nine cells each, empty ones too."""
    cells = merged.groupBy("model", "condition").agg(*(F.sum(((F.col("ground_truth_label") == t) & (F.col("predicted_label") == p)).cast("long")).alias(f"{t}>{p}") for t in LABELS for p in LABELS))
    grid = F.array(*(F.struct(F.lit(t).alias("truth"), F.lit(p).alias("predicted"), F.col(f"{t}>{p}").alias("n")) for t in LABELS for p in LABELS))
    return cells.select("model", "condition", F.explode(grid).alias("c")).select("model", "condition", "c.*")


def class_metrics(merged: DataFrame) -> DataFrame:
    """n, accuracy, macro precision, recall and F1 (the mean over all labels, 0 where undefined) and the matrix as JSON, for every condition."""
    y, p = F.col("ground_truth_label"), F.col("predicted_label")
    sums = [F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy")]
    for x in LABELS:
        sums += [F.sum(((y == x) & (p == x)).cast("long")).alias(f"t_{x}"), F.sum((p == x).cast("long")).alias(f"p_{x}"), F.sum((y == x).cast("long")).alias(f"y_{x}")]
    sums += [F.sum(((y == t) & (p == q)).cast("long")).alias(f"{t}>{q}") for t in LABELS for q in LABELS]
    g = merged.groupBy("model", "condition").agg(*sums)
    mean = lambda f: reduce(lambda a, b: a + b, (F.coalesce(f(x), F.lit(0.0)) for x in LABELS)) / len(LABELS)
    div = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))
    f1 = lambda x: F.try_divide(2 * F.col(f"t_{x}").cast("double"), (F.col(f"p_{x}") + F.col(f"y_{x}")).cast("double"))
    matrix = F.to_json(F.array(*(F.array(*(F.col(f"{t}>{q}") for q in LABELS)) for t in LABELS)))
    return g.select("model", "condition", "n", "accuracy", mean(lambda x: div(f"t_{x}", f"p_{x}")).alias("macro_precision"), mean(lambda x: div(f"t_{x}", f"y_{x}")).alias("macro_recall"), mean(f1).alias("macro_f1"), matrix.alias("confusion_matrix"))


def flip_rate(merged: DataFrame) -> DataFrame:
    """Per model and subset (overall, ambiguous: three stars, clear_cut): reviews with all named conditions, how many have more than one label, and the share.  One reading of `merged`; stars belong to the review."""
    named = F.col("condition").isin(NAMED)
    label = F.coalesce(*(F.when(F.col("predicted_label") == x, 1 << i) for i, x in enumerate(LABELS)), F.lit(0))
    per = merged.groupBy("model", "review_id").agg(n_named().alias("k"), (F.bit_count(F.bit_or(F.when(named, label))) > 1).alias("flip"), F.min(F.when(named, F.col("stars"))).alias("stars"))
    full, three = F.col("k") == len(NAMED), F.coalesce(F.col("stars") == 3, F.lit(False))
    sets = {"overall": full, "ambiguous": full & three, "clear_cut": full & ~three}
    g = per.groupBy("model").agg(*(F.sum(c.cast("long")).alias(f"n_{s}") for s, c in sets.items()), *(F.sum((c & F.col("flip")).cast("long")).alias(f"f_{s}") for s, c in sets.items()))
    rows = g.select("model", F.inline(F.array(*(F.struct(F.lit(s).alias("subset"), F.col(f"n_{s}").alias("n_reviews"), F.coalesce(f"f_{s}", F.lit(0).cast("long")).alias("n_flipped")) for s in sets))))
    return rows.withColumn("flip_rate", F.try_divide("n_flipped", "n_reviews"))


def self_consistency(merged: DataFrame) -> DataFrame:
    """model, mean self-consistency over prompts of several runs, and what it says of the noise floor."""
    several = F.when(F.col("n_valid_runs") > 1, F.col("self_consistency"))
    g = merged.groupBy("model").agg(F.avg(several).alias("mean_self_consistency"), F.count(several).alias("n_repeated"))
    return g.withColumn("note", F.when(F.col("n_repeated") > 0, "flips at or below 1 - self-consistency may be noise").otherwise("single runs: flips cannot be told from noise"))


def label_agreement(raters: DataFrame) -> DataFrame:
    """The table of two raters' labels: one row per rater 1 label, a column per rater 2 label."""
    return raters.groupBy("a").pivot("b", LABELS).count().na.fill(0)
