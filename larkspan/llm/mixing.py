r"""Mixing sources to target weights by iterative proportional fitting (operator 1).

Tokens are summed by cell (source, language, topic).  Raking scales the cells in
turn until their sums meet the target share of every source, language and topic.
A cell's weight is its raked tokens over its own; documents are kept with
probability min(1, c * weight), c such that KEEP of all tokens are expected to
stay.  Whether a document stays depends on its id and the seed alone.

Cells are combinations of labels, not documents; up to CELLS of them are raked in
memory, more as a table of their own: the same rounds, test of closeness and search
for c, with sums that Spark takes.  Labels fit the driver in either case.

Defined cases: null labels are the label "(none)"; null and empty texts have no
tokens and take the probability of their cell; cells without tokens have weight
1; a null doc_id draws as the empty string; repeated rows draw alike; an empty
table gives no rows; other columns pass through `mix` whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.columns import free
from larkspan.llm.lineage import saved

DIMENSIONS = ("source", "lang", "topic")
#: A target share is the share of tokens to this power, made to sum to one.
TEMPER = {"source": 0.7, "lang": 0.8, "topic": 0.9}
KEEP, SEED, ROUNDS, CLOSE, CELLS = 0.6, 11, 200, 1e-9, 500_000
_P = "__lm_"


def topic_of(text: Column) -> Column:
    """What stands in for a topic where documents carry none: the form of the text."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    size = F.length(text)
    return F.when(bars * 50 > size, "table").when(size < 500, "note").when(size < 5000, "article").otherwise("book")


def _labelled(docs: DataFrame, p: str = _P) -> DataFrame:
    """`docs` with the labels and tokens of each row under names that begin with `p`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of(text)
    labels = {"source": F.col("source").cast("string"), "lang": F.col("lang").cast("string"), "topic": topic}
    return docs.withColumns({p + k: F.coalesce(v, F.lit("(none)")) for k, v in labels.items()} | {f"{p}n": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")})


def draw(key: Column, seed: int = SEED) -> Column:
    """A uniform number in [0, 1) of a key and the seed."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)), 11) / F.lit(float(1 << 53))


def tempered(sums: dict[str, float], power: float) -> dict[str, float]:
    total = sum(sums.values())
    raised = {k: (v / total) ** power if v else 0.0 for k, v in sums.items()}
    return {k: v / sum(raised.values()) for k, v in raised.items()} if total else {}


def rake(cells: pd.DataFrame, targets: dict[str, dict[str, float]], rounds: int = ROUNDS, close: float = CLOSE) -> np.ndarray:
    """Raked tokens of each cell (source, lang, topic, tokens): of the total, each label has its target share of the labels present."""
    raked = cells["tokens"].to_numpy(float).copy()
    total = raked.sum()
    codes = {}
    for d in DIMENSIONS:
        code, labels = pd.factorize(cells[d])
        held = np.bincount(code, raked, len(labels)) > 0
        share = np.array([targets[d].get(x, 0.0) for x in labels]) * held
        codes[d] = (code, share / share.sum() * total if share.sum() else share)
    for _ in range(rounds):
        worst = 0.0
        for code, want in codes.values():
            have = np.bincount(code, raked, len(want))
            factor = np.divide(want, have, out=np.ones_like(want), where=have > 0)
            worst = max(worst, float(np.abs(have - want).max()) / total) if total else 0.0
            raked *= factor[code]
        if worst <= close:
            break
    return raked


_CODES = [_P + "code_" + d for d in DIMENSIONS]


def _raked(b: pa.RecordBatch, logs: list[np.ndarray]) -> np.ndarray:
    """Tokens by the factors of a cell's labels, as logarithms: a factor alone may leave the range of a float."""
    with np.errstate(divide="ignore"):
        out = np.log(np.asarray(b.column("tokens")).astype(float))
    return np.exp(out + sum(x[np.asarray(b.column(c))] for x, c in zip(logs, _CODES, strict=True)))


def _sums(logs, column: str):
    def run(batches):
        for b in batches:
            labels, at = np.unique(np.asarray(b.column(column)), return_inverse=True)
            if len(labels):
                yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(np.bincount(at, _raked(b, logs.value), len(labels)))], names=["label", "tokens"])

    return run


def _with_raked(logs):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (*DIMENSIONS, "tokens")), pa.array(_raked(b, logs.value))], names=[*DIMENSIONS, "tokens", "raked"])

    return run


def rake_table(cells: DataFrame, targets: dict[str, dict[str, float]], rounds: int = ROUNDS, close: float = CLOSE) -> DataFrame:
    """`rake` for any number of cells: source, lang, topic, tokens and raked.  Labels of a dimension must fit the driver."""
    spark, wants = cells.sparkSession, []
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    coded = cells.select(*DIMENSIONS, F.col("tokens").cast("long").alias("tokens"))
    for d, c in zip(DIMENSIONS, _CODES, strict=True):
        labels = cells.groupBy(d).agg(F.sum("tokens")).collect()
        share = np.array([targets[d].get(x, 0.0) * ((n or 0) > 0) for x, n in labels])
        wants.append(share / share.sum() * total if share.sum() else share)
        coded = coded.join(spark.createDataFrame([(r[0], i) for i, r in enumerate(labels)], f"{d} string, {c} int"), d)
    coded = saved(coded.select(*DIMENSIONS, "tokens", *_CODES))
    logs = [np.zeros(len(x)) for x in wants]
    for _ in range(rounds):
        worst = 0.0
        for i, want in enumerate(wants):
            known = spark.sparkContext.broadcast(logs)
            sums = coded.mapInArrow(_sums(known, _CODES[i]), "label int, tokens double").groupBy("label").agg(F.sum("tokens").alias("tokens")).toPandas()
            known.destroy()
            have = np.zeros(len(want))
            have[sums["label"].to_numpy(int)] = sums["tokens"].to_numpy(float)
            factor = np.divide(want, have, out=np.ones_like(want), where=have > 0)
            worst = max(worst, float(np.abs(have - want).max()) / total) if total else 0.0
            with np.errstate(divide="ignore"):
                logs[i] = logs[i] + np.log(factor)
        if worst <= close:
            break
    return saved(coded.mapInArrow(_with_raked(spark.sparkContext.broadcast(logs)), "source string, lang string, topic string, tokens long, raked double"))


def search(got: Callable[[float], float], want: float) -> float:
    """The least c, by doubling and halving, with got(c) = want; got must not fall."""
    low, high = 0.0, 1.0
    while got(high) < want and high < 1e18:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if got(mid) < want else (low, mid)
    return high


def scale(weights: np.ndarray, tokens: np.ndarray, keep: float) -> float:
    """c with sum(tokens * min(1, c * weights)) = keep * sum(tokens)."""
    return search(lambda c: (tokens * np.minimum(1, c * weights)).sum(), keep * tokens.sum())


def probabilities(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, limit: int = CELLS) -> DataFrame:
    """weight and probability of each cell of (source, lang, topic, tokens)."""
    spark = cells.sparkSession
    cells = saved(cells)
    if targets is None:
        targets = {d: tempered({r[0]: r[1] for r in cells.groupBy(d).agg(F.sum("tokens")).collect()}, TEMPER[d]) for d in DIMENSIONS}
    if cells.count() <= limit:
        table = cells.toPandas()
        raked = rake(table, targets)
        tokens = table["tokens"].to_numpy(float)
        weights = np.divide(raked, tokens, out=np.ones_like(raked), where=tokens > 0)
        table["weight"], table["probability"] = weights, np.minimum(1.0, scale(weights, tokens, keep) * weights)
        rows = list(table[[*DIMENSIONS, "weight", "probability"]].itertuples(index=False, name=None))
        return F.broadcast(spark.createDataFrame(rows, "source string, lang string, topic string, weight double, probability double"))  # `limit` rows at most
    raked = rake_table(cells, targets).withColumn("weight", F.coalesce(F.try_divide("raked", F.col("tokens").cast("double")), F.lit(1.0)))
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    high = search(lambda c: raked.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * c))).first()[0] or 0.0, keep * total)
    return raked.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), F.col("weight") * high).alias("probability"))


def _joined(labelled: DataFrame, targets, keep: float, p: str = _P) -> DataFrame:
    keys = [F.col(p + d).alias(d) for d in DIMENSIONS]
    cells = labelled.groupBy(*keys).agg(F.sum(f"{p}n").alias("tokens"))
    odds = probabilities(cells, targets, keep)
    return labelled.join(odds.select(*(F.col(d).alias(p + d) for d in DIMENSIONS), F.col("weight").alias(f"{p}weight"), F.col("probability").alias(f"{p}p")), [p + d for d in DIMENSIONS])


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """The rows of `docs` (doc_id, text, lang, source, perhaps topic) that are drawn."""
    p = free(docs, _P)
    return _joined(_labelled(docs, p), targets, keep, p).filter(draw(F.col("doc_id"), seed) < F.col(f"{p}p")).select(docs.columns)


def op1_raked_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _labelled(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", *(_P + x for x in (*DIMENSIONS, "n")))
    out = _joined(saved(labelled), None, KEEP)
    return out.select("doc_id", *(F.col(_P + d).alias(d) for d in DIMENSIONS), F.col(f"{_P}n").alias("n_tokens"), F.col(f"{_P}weight").alias("weight"), F.col(f"{_P}p").alias("probability"), (draw(F.col("doc_id")) < F.col(f"{_P}p")).alias("sampled"))
