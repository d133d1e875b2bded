"""Bootstrap, equivalence, multiplicity, mixed models and rater agreement."""

from __future__ import annotations

import math
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.functions.draws import first_words, kind_counts, picks
from larkspan.functions.text import LABELS
from larkspan.operators.design import NAMED, n_named


#: Draws of one replicate that a call makes.
BLOCK = 262_144
#: Draws of a task, a few seconds' work.
TASK = 30_000_000


def kinds_of(clusters: DataFrame, sums: list[str], by: str | None = None) -> list:
    """The combinations of `sums` (and `by`) with their number of clusters, `_k`: a few dozen rows, collected."""
    return clusters.groupBy(*([by] if by else []), *sums).agg(F.count(F.lit(1)).alias("_k")).collect()


def resampled(clusters: DataFrame, sums: list[str], replicates: int, seed: str, by: str | None = None) -> DataFrame:
    """b and the sums of every replicate of `clusters` (sums...), for each value of `by`: n draws of n clusters each, by hash.

    The sums of a cluster are small whole numbers, so Spark reduces the clusters to
    one row per combination (a few dozen), and a draw takes a combination by its
    share: no draw meets a table of clusters, and the table is read once.
    """
    return redrawn(clusters.sparkSession, kinds_of(clusters, sums, by), sums, replicates, seed, by, dict(clusters.dtypes).get(by))


def redrawn(spark: SparkSession, kinds: list, sums: list[str], replicates: int, seed: str, by: str | None = None, by_type: str | None = None) -> DataFrame:
    """`resampled` from the combinations.  Draws are hashed in blocks on the executors, once for all values of `by`, and only sums leave a block."""
    schema = ", ".join(["b long", *(f"{s} long" for s in sums), *([f"{by} {by_type}"] if by else [])])
    groups = []
    for group in sorted({r[by] for r in kinds}) if by else [None]:
        own = sorted((tuple(int(r[s]) for s in sums), r["_k"]) for r in kinds if not by or r[by] == group)
        groups.append((group, list(accumulate(k for _, k in own)), np.array([v for v, _ in own], np.int64)))
    most = max((ends[-1] for _, ends, _ in groups if ends), default=0)
    if not most:
        return spark.createDataFrame([], schema)
    size = BLOCK
    blocks = -(-most // size)

    def draw(batches):
        for units in batches:
            out = []
            for unit in units["id"].tolist():
                b, start = unit // blocks, unit % blocks * size
                words = first_words(f"{seed}:{b}:", start, min(most, start + size))
                taken: dict[int, np.ndarray] = {}
                for group, ends, values in groups:
                    n = ends[-1]
                    if n > start:
                        if n not in taken:
                            taken = {n: picks(words[: n - start], n)}
                        out.append((b, *(np.array(kind_counts(taken[n], ends)) @ values).tolist(), *([group] if by else [])))
            yield pd.DataFrame(out, columns=["b", *sums, *([by] if by else [])])

    tasks = max(32, replicates * most // TASK)
    units = spark.range(0, replicates * blocks, 1, min(tasks, replicates * blocks))
    return units.mapInPandas(draw, schema).groupBy("b", *([by] if by else [])).agg(*(F.sum(s).alias(s) for s in sums)).select("b", *sums, *([by] if by else []))


def level_sums(merged: DataFrame, column: str, a: str, b: str) -> DataFrame:
    both = merged.filter(F.col("condition").isin(NAMED) & F.col(column).isin(a, b))
    at = lambda level, x: F.sum(F.when(F.col(column) == level, x).otherwise(0))
    return both.groupBy(F.col("review_id").alias("cluster")).agg(at(a, F.col("score")).alias("sa"), at(a, F.lit(1)).alias("na"), at(b, F.col("score")).alias("sb"), at(b, F.lit(1)).alias("nb"), F.sum(F.col("score") * F.col("score")).alias("q"))


def bootstrap_difference(merged: DataFrame, column: str, a: str, b: str, replicates: int = 2000, seed: str = "42") -> DataFrame:
    """Replicate differences (b, diff) of mean scores a - b, reviews resampled."""
    return differences(resampled(level_sums(merged, column, a, b), ["sa", "na", "sb", "nb"], replicates, seed))


def differences(sums: DataFrame) -> DataFrame:
    return sums.select("b", (F.try_divide("sa", "na") - F.try_divide("sb", "nb")).alias("diff")).filter("diff IS NOT NULL")


def difference_with_sd(merged: DataFrame, column: str, a: str, b: str, replicates: int = 2000, seed: str = "42") -> tuple[DataFrame, Column]:
    """`bootstrap_difference`, and the SD of the scores of both levels (null below two rows), from one reading of `merged`."""
    sums = ["sa", "na", "sb", "nb", "q"]  # q is last, so the draws are those of the other four
    kinds = kinds_of(level_sums(merged, column, a, b), sums)
    n, s, q = (sum(r["_k"] * sum(r[x] for x in xs) for r in kinds) for xs in (("na", "nb"), ("sa", "sb"), ("q",)))
    sd = math.sqrt((q * n - s * s) / n / (n - 1)) if n > 1 else None
    return differences(redrawn(merged.sparkSession, kinds, sums, replicates, seed)), F.lit(sd).cast("double")


def interval(replicates: DataFrame, value: str = "diff", by: str | None = None) -> DataFrame:
    return replicates.groupBy(*([by] if by else [])).agg(*(F.percentile(value, F.lit(q)).alias(n) for n, q in (("ci95_lo", 0.025), ("ci95_hi", 0.975), ("ci90_lo", 0.05), ("ci90_hi", 0.95))))


def tost(intervals: DataFrame, sd: Column, sesoi: float = 0.2) -> DataFrame:
    """Adds sesoi_raw and verdict: equivalent if the 90% interval is strictly inside, else significant if the 95% interval excludes 0, else inconclusive."""
    raw = sesoi * sd
    verdict = F.when((F.col("ci90_lo") > -raw) & (F.col("ci90_hi") < raw), "equivalent").when((F.col("ci95_lo") > 0) | (F.col("ci95_hi") < 0), "significant").otherwise("inconclusive")
    return intervals.withColumns({"sesoi_raw": raw, "verdict": verdict})


def holm(p_values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Adds p_holm to (term, p): step-down adjustment of a family of tests (a handful of rows), or of one for each value of `by`."""
    family = Window.partitionBy(*(by or []))
    order = family.orderBy("p", "term")
    ranked = p_values.withColumn("_r", F.row_number().over(order)).withColumn("_m", F.count(F.lit(1)).over(family))
    return ranked.withColumn("p_holm", F.least(F.lit(1.0), F.max((F.col("_m") - F.col("_r") + 1) * F.col("p")).over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_r", "_m")


#: The two contrasts whose p-values are adjusted together.
PRIMARY = ["region[south_asian]", "gender[female]"]


def primary_contrasts(terms: DataFrame) -> DataFrame:
    """model, term, p, p_holm of the primary contrasts of each model; `terms` has their p_value."""
    return holm(terms.filter(F.col("term").isin(PRIMARY)).select("model", "term", F.col("p_value").alias("p")), ["model"])


def mixed_model_balanced(merged: DataFrame) -> DataFrame:
    """term, coef, se, z, and the variances of a random-intercept model of region x gender, in closed form over reviews with all four cells; reference levels western and male."""
    cell = lambda r, g: F.avg(F.when((F.col("region") == r) & (F.col("gender") == g), F.col("score")))
    wide = merged.filter(F.col("condition").isin(NAMED)).groupBy("model", "review_id").agg(cell("western", "male").alias("wm"), cell("western", "female").alias("wf"), cell("south_asian", "male").alias("sm"), cell("south_asian", "female").alias("sf"), n_named().alias("k")).filter("k = 4")
    cells = ["wm", "wf", "sm", "sf"]
    mean = (F.col("wm") + F.col("wf") + F.col("sm") + F.col("sf")) / 4
    stats = wide.withColumn("m", mean).groupBy("model").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(f"a_{c}") for c in cells), *(F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in cells), F.sum(F.col("m") * F.col("m")).alias("qm"), F.avg("m").alias("am"))
    n = F.col("n")
    within = sum((F.col(f"q_{c}") - n * F.col(f"a_{c}") * F.col(f"a_{c}") for c in cells[1:]), F.col("q_wm") - n * F.col("a_wm") * F.col("a_wm"))
    review = 4 * (F.col("qm") - n * F.col("am") * F.col("am"))
    s2e = (within - review) / (3 * (n - 1))
    s2u = (review / (n - 1) - s2e) / 4
    edge = s2u < 0
    fitted = stats.withColumns({"s2e": F.when(edge, within / (4 * n - 4)).otherwise(s2e), "s2u": F.when(edge, 0.0).otherwise(s2u)})
    e, u = F.col("s2e"), F.col("s2u")
    terms = [
        ("intercept", F.col("a_wm"), (e + u) / n),
        ("region[south_asian]", F.col("a_sm") - F.col("a_wm"), 2 * e / n),
        ("gender[female]", F.col("a_wf") - F.col("a_wm"), 2 * e / n),
        ("region[south_asian]:gender[female]", F.col("a_sf") - F.col("a_sm") - F.col("a_wf") + F.col("a_wm"), 4 * e / n),
    ]
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("term"), c.alias("coef"), F.sqrt(v).alias("se")) for t, c, v in terms)))
    return fitted.select("model", "n", "s2e", "s2u", rows.alias("t")).select("model", F.col("n").alias("n_groups"), F.col("s2e").alias("residual_var"), F.col("s2u").alias("intercept_var"), "t.*").withColumn("z", F.try_divide("coef", "se"))


def with_p(terms: DataFrame) -> DataFrame:
    """Adds p_value and the 95% interval to a table of terms (a handful of rows)."""
    return terms.mapInPandas(
        lambda batches: (x.assign(p_value=[math.erfc(abs(z) / math.sqrt(2)) if z == z else float("nan") for z in x["z"].astype(float)], ci95_lo=x["coef"] - 1.959963984540054 * x["se"], ci95_hi=x["coef"] + 1.959963984540054 * x["se"]) for x in batches),
        ", ".join(f"{c} {t}" for c, t in terms.dtypes) + ", p_value double, ci95_lo double, ci95_hi double",
    )


def reml(xtx: np.ndarray, xty: np.ndarray, yty: float, groups: list[tuple[int, int, np.ndarray, float, float]]) -> dict:
    """Random-intercept REML from sufficient statistics.

    groups: for each design pattern its cluster size, count, column sums of X, and the sums of cluster totals of y and of their squares.
    """
    n, p = sum(m * k for m, k, *_ in groups), len(xty)

    def fit(ratio: float):
        a, b, c, logdet = xtx.copy(), xty.copy(), yty, 0.0
        for m, k, x, t, q in groups:
            w = ratio / (1 + ratio * m)
            a -= w * k * np.outer(x, x)
            b = b - w * x * t
            c -= w * q
            logdet += k * math.log1p(ratio * m)
        beta = np.linalg.solve(a, b)
        rss = max(c - beta @ b, 1e-300)
        return -0.5 * ((n - p) * math.log(rss / (n - p)) + logdet + np.linalg.slogdet(a)[1]), beta, a, rss / (n - p)

    low, high = -12.0, 8.0
    golden = (math.sqrt(5) - 1) / 2
    for _ in range(120):
        x, y = high - golden * (high - low), low + golden * (high - low)
        low, high = (low, y) if fit(math.exp(x))[0] > fit(math.exp(y))[0] else (x, high)
    ratio = max((0.0, math.exp((low + high) / 2)), key=lambda r: fit(r)[0])
    _, beta, a, s2e = fit(ratio)
    return {"beta": beta, "se": np.sqrt(np.diag(np.linalg.inv(a)) * s2e), "s2e": s2e, "s2u": ratio * s2e}


def mixed_model_subregion(merged: DataFrame, region: str = "south_asian", reference: str = "India") -> DataFrame:
    """term, coef, se, z, p_value, interval and variances of sub_region x gender within one region.

    Spark reads the rows once and reduces them to one per pattern of a review's
    sub-regions, genders and scores (bounded by the sub-regions and labels); the
    driver searches one variance ratio.
    """
    spark = merged.sparkSession
    rows = merged.filter(F.col("region") == region)
    out = []
    per = rows.groupBy("model", "review_id").agg(F.array_sort(F.collect_list(F.struct("sub_region", "gender", "score"))).alias("rows"))
    patterns = per.groupBy("model", "rows").agg(F.count(F.lit(1)).alias("k")).collect()
    for model in sorted({p.model for p in patterns}):
        cells, designs = {}, {}
        for p in (p for p in patterns if p.model == model):
            for r in p.rows:
                n, s, q = cells.get((r.sub_region, r.gender), (0, 0, 0))
                cells[r.sub_region, r.gender] = n + p.k, s + p.k * r.score, q + p.k * r.score**2
            design, t = tuple((r.sub_region, r.gender) for r in p.rows), sum(r.score for r in p.rows)
            k, total, squares = designs.get(design, (0, 0, 0))
            designs[design] = k + p.k, total + p.k * t, squares + p.k * t * t
        found = {s for s, _ in cells}
        subs = sorted(found - {reference})
        if not subs or reference not in found:
            continue
        names = ["intercept", *(f"sub_region[{s}]" for s in subs), "gender[female]", *(f"sub_region[{s}]:gender[female]" for s in subs)]

        def x(sub: str, gender: str) -> np.ndarray:
            s, g = np.array([float(sub == y) for y in subs]), float(gender == "female")
            return np.concatenate([[1.0], s, [g], s * g])

        xs = [(x(*cell), *sums) for cell, sums in sorted(cells.items())]
        groups = [(len(d), k, sum(x(*cell) for cell in d), float(t), float(q)) for d, (k, t, q) in sorted(designs.items())]
        try:
            f = reml(sum(n * np.outer(v, v) for v, n, _, _ in xs), sum(float(s) * v for v, _, s, _ in xs), float(sum(q for *_, q in xs)), groups)
        except np.linalg.LinAlgError:
            continue
        out += [(model, sum(g[1] for g in groups), float(f["s2e"]), float(f["s2u"]), t, float(b), float(s), float(b / s) if s else None) for t, b, s in zip(names, f["beta"], f["se"], strict=True)]
    return with_p(spark.createDataFrame(out, "model string, n_groups long, residual_var double, intercept_var double, term string, coef double, se double, z double"))


def kappa_of(cells: dict[tuple[int, int], Column], weighted: bool) -> Column:
    """Cohen's kappa of a table of counts as columns; 1 where chance agreement is certain, null without rows."""
    k = range(len(LABELS))
    add = lambda xs: sum(xs[1:], xs[0])
    n = add([cells[i, j] for i in k for j in k])
    weight = lambda i, j: ((i - j) / (len(LABELS) - 1)) ** 2 if weighted else float(i != j)
    rows, cols = [add([cells[i, j] for j in k]) for i in k], [add([cells[i, j] for i in k]) for j in k]
    seen = add([weight(i, j) * cells[i, j] for i in k for j in k if i != j]) / F.nullif(n, F.lit(0))
    chance = add([weight(i, j) * rows[i] * cols[j] for i in k for j in k if i != j]) / F.nullif(n * n, F.lit(0))
    return F.when(chance == 0, 1.0).otherwise(1 - seen / F.nullif(chance, F.lit(0.0)))


def pair_counts(raters: DataFrame) -> list[Column]:
    return [F.sum(((F.col("a") == x) & (F.col("b") == y)).cast("long")).alias(f"c{i}{j}") for i, x in enumerate(LABELS) for j, y in enumerate(LABELS)]


_CELLS = {(i, j): f"c{i}{j}" for i in range(3) for j in range(3)}


def kappa(raters: DataFrame, weighted: bool = False) -> DataFrame:
    """n, raw_agreement, kappa of rows (id, a, b) with valid labels."""
    valid = raters.filter(F.col("a").isin(LABELS) & F.col("b").isin(LABELS))
    g = valid.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("raw_agreement"), *pair_counts(valid))
    return g.select("n", "raw_agreement", kappa_of({k: F.col(c) for k, c in _CELLS.items()}, weighted).alias("kappa"), F.when(F.col("n") < 30, "too few rows").otherwise("ok").alias("status"))


def kappa_interval(raters: DataFrame, weighted: bool = False, replicates: int = 2000, seed: str = "42") -> DataFrame:
    """95% interval of kappa, rows resampled; the ends are sorted values by index, not interpolated."""
    valid = raters.filter(F.col("a").isin(LABELS) & F.col("b").isin(LABELS))
    rows = valid.select(F.col("id").alias("cluster"), *(((F.col("a") == x) & (F.col("b") == y)).cast("long").alias(f"c{i}{j}") for i, x in enumerate(LABELS) for j, y in enumerate(LABELS)))
    sums = resampled(rows, list(_CELLS.values()), replicates, seed)
    values = sums.select(kappa_of({k: F.col(c) for k, c in _CELLS.items()}, weighted).alias("k")).filter("k IS NOT NULL AND NOT isnan(k)")
    ordered = values.agg(F.array_sort(F.collect_list("k")).alias("v"))  # one number per replicate
    n = F.size("v")
    return ordered.filter(n > 0).select(F.element_at("v", F.floor(0.025 * n).cast("int") + 1).alias("ci95_lo"), F.element_at("v", F.greatest(F.floor(0.975 * n).cast("int"), F.lit(1))).alias("ci95_hi"))


def accuracy_intervals(merged: DataFrame, replicates: int = 1000, seed: str = "42") -> DataFrame:
    """condition, ci95_lo, ci95_hi of the accuracy of every condition, reviews resampled."""
    clusters = merged.groupBy("condition", "review_id").agg(F.sum("correct").alias("ok"), F.count(F.lit(1)).alias("n_rows"))
    acc = resampled(clusters, ["ok", "n_rows"], replicates, seed, "condition").select("condition", (F.col("ok") / F.col("n_rows")).alias("diff"))
    return interval(acc, by="condition").select("condition", "ci95_lo", "ci95_hi")
