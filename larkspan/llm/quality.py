r"""Quality rules compiled into Spark projections, without user functions (operator 4).

A threshold table names measures and their bounds; `verdict` compiles it into one
expression.  Windows repeat if their hash occurs twice in the text: only texts
with fewer distinct hashes than windows are sorted to find which.

Defined cases: null and empty texts have no words and fail `n_words`; texts of
fewer than five words have no window; a measure per word counts as 0 without
words; repeated rows are judged alike; all other columns pass through, and the
columns made on the way get names that no input column has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.columns import free

WINDOW = 5
#: Frequent function words of the four languages: fixed values.
STOP_WORDS = ["the", "of", "and", "to", "in", "a", "is", "that", "for", "on", "with", "de", "la", "le", "les", "des", "et", "en", "un", "une", "que", "der", "die", "das", "und", "ein", "mit", "von", "el", "los", "las", "del", "y", "se", "por"]
#: (rule, measure, least, most, words from which on it holds)
THRESHOLDS = [
    ("mean_word_length", "word_chars / n_words", 1.5, 30.0, 10),
    ("symbols_per_word", "n_symbols / n_words", 0.0, 0.1, 10),
    ("exclamations_per_word", "n_exclaims / n_words", 0.0, 0.3, 10),
    ("stop_word_share", "n_stops / n_words", 0.02, 1.0, 50),
    ("repeated_line_share", "n_dup_lines / n_lines", 0.0, 0.5, 50),
]
_P = "__lq_"


def _removed(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def measures(docs: DataFrame, p: str = _P) -> DataFrame:
    """`docs` with the measures of its `text` under names that begin with `p`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    with_words = docs.withColumn(f"{p}text", text).withColumn(f"{p}words", F.regexp_extract_all(f"{p}text", F.lit(r"([^\x20\x09-\x0D]+)"), 1))
    words = F.col(f"{p}words")
    lines = F.filter(F.split(f"{p}text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stops = F.filter(words, lambda w: F.lower(w).isin(STOP_WORDS))
    counted = with_words.select(
        *docs.columns,
        F.size(words).alias(f"{p}n_words"),
        F.length(F.translate(f"{p}text", " \t\n\x0b\x0c\r", "")).alias(f"{p}word_chars"),
        _removed(F.col(f"{p}text"), "#*$%&|<>").alias(f"{p}n_symbols"),
        _removed(F.col(f"{p}text"), "!").alias(f"{p}n_exclaims"),
        F.size(stops).alias(f"{p}n_stops"),
        lines.alias(f"{p}lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias(f"{p}h"),
    )
    h, n = F.col(f"{p}h"), F.col(f"{p}n_words")
    windows = F.transform(F.slice(h, 1, F.greatest(n - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + j) for j in range(1, WINDOW))))
    hashed = counted.withColumn(f"{p}n_lines", F.size(f"{p}lines")).withColumn(f"{p}n_dup_lines", F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).withColumn(f"{p}g", windows).drop(f"{p}lines", f"{p}h")
    g = F.col(f"{p}g")
    repeats = F.size(F.array_distinct(g)) < F.size(g)
    ranked = hashed.withColumn(f"{p}s", F.when(repeats, F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))).drop(f"{p}g")
    s = F.col(f"{p}s")
    same = F.filter(s, lambda e, i: ((i > 0) & (F.get(s, i - 1)["x"] == e["x"])) | F.coalesce(F.get(s, i + 1)["x"] == e["x"], F.lit(False)))
    placed = ranked.withColumn(f"{p}at", F.sort_array(F.transform(same, lambda e: e["i"]))).drop(f"{p}s")
    at = F.col(f"{p}at")
    covered = F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")), lambda a, x: F.struct((a["n"] + x + WINDOW - F.greatest(x, a["upto"])).alias("n"), (x + WINDOW).alias("upto")), lambda a: a["n"])
    return placed.withColumn(f"{p}n_repeat_words", F.coalesce(covered, F.lit(0))).drop(f"{p}at")


def _of(name: str, p: str = _P) -> Column:
    return F.col(p + name.strip())


def base_failed(p: str = _P) -> Column:
    return (_of("n_words", p) < 10) | (100 * _of("n_repeat_words", p).cast("long") > 20 * _of("n_words", p).cast("long"))


def verdict(thresholds=THRESHOLDS, p: str = _P) -> Column:
    """The rules of the table that a row fails, as an array of names."""
    arms = []
    for rule, measure, least, most, words in thresholds:
        part, whole = (_of(x, p) for x in measure.split("/"))
        value = F.coalesce(F.try_divide(part, whole), F.lit(0.0))
        arms.append(F.when((_of("n_words", p) >= words) & ((value < least) | (value > most)), F.lit(rule)))
    return F.array_compact(F.array(*arms))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that pass the base rules and the threshold table.

    The verdict goes through a generator: a filter on it isn't pushed below the
    projections, where it would evaluate every measure within every other.
    """
    p = free(docs, _P)
    judged = measures(docs, p).select(*docs.columns, (~base_failed(p) & (F.size(verdict(p=p)) == 0)).alias(f"{p}ok"))
    return judged.select(*docs.columns, F.explode(F.array(f"{p}ok")).alias(f"{p}kept")).filter(f"{p}kept").select(docs.columns)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and verdict of every row, through a generator as in `keep_good`, so that filters on them end."""
    m = measures(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [_of(x).cast("long").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    judged = m.select("doc_id", F.struct(*counts, base_failed().alias("base_failed"), verdict().alias("failed")).alias(f"{_P}row"))
    row = judged.select("doc_id", F.explode(F.array(f"{_P}row")).alias(f"{_P}one")).select("doc_id", f"{_P}one.*")
    return row.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"), F.array_join("failed", ",").alias("failed_rules"))


def _arms() -> str:
    return ", ".join(f"CASE WHEN n_words >= {words} AND (coalesce({a} / nullif({b}, 0), 0) < {least} OR coalesce({a} / nullif({b}, 0), 0) > {most}) THEN '{rule}' END" for rule, measure, least, most, words in THRESHOLDS for a, b in [measure.split("/")])


OP4_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM t WHERE len(w) >= 5)
), again AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM windows JOIN (SELECT doc_id, g FROM windows GROUP BY ALL HAVING count(*) > 1) USING (doc_id, g)
  ) GROUP BY doc_id
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(x, '[^!]', '', 'g')) AS n_exclaims, len(list_filter(w, lambda s: lower(s) IN ({", ".join(f"'{s}'" for s in STOP_WORDS)}))) AS n_stops,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM t LEFT JOIN again USING (doc_id)
), v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, concat_ws(',', {_arms()}) AS failed_rules FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM v
"""
