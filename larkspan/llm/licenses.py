r"""License scan by diagonal voting (operator 2).

All rolling word k-grams of a text are hashed and joined to the positions of the
same grams in license templates.  Each match votes for a diagonal, its place in
the text minus its place in the template; the voted template positions of a
diagonal are a bit mask.  Diagonals of one template at most DRIFT apart are
merged (words put in or left out), and a span is verified by the share of the
template's grams it has and by its width.  Phrases of up to three words are one
gram: every verified span is then one place of the phrase.

Only DataFrame functions are used.  The templates are a constant of this module
(under 200 grams), so the broadcast side has a fixed size, and grams that are in no
template are left out of a text's array before it is exploded: one pass over the
texts leaves a few places of each.  Grams are compared by 64-bit hashes, and rows
are told apart by a 64-bit hash of doc_id and text.

Defined cases: null and empty texts have no words; a text with no match has null
places, empty labels and score 0; repeated rows (same doc_id, same text) are scanned
alike, different texts of one doc_id, or of none, apart; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.llm.lineage import saved

DRIFT, SHARE, STRETCH = 2, 0.6, 1.5
#: (label, text, base phrase?): phrases and well-known openings of license texts: fixed values.
TEMPLATES = [
    ("cc-by", "cc by", True),
    ("gpl", "general public license", True),
    ("reserved", "all rights reserved", True),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", False),
    ("mit-notice", "released under the mit license", False),
    ("apache-2.0", "licensed under the apache license version 2 0", False),
    ("gpl-notice", "this work is licensed under the gnu general public license", False),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    ("cc-by-notice", "licensed under cc by nc 4 0", False),
    ("warranty", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", False),
]


def template_grams() -> list[tuple[int, int, int, str, bool, int, list[str]]]:
    """(template, place of the gram, its words, label, base, grams of the template, the gram's words)."""
    out = []
    for t, (label, text, base) in enumerate(TEMPLATES):
        words = text.split()
        k = min(3, len(words))
        out += [(t, i, k, label, base, len(words) - k + 1, words[i : i + k]) for i in range(len(words) - k + 1)]
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    grams = template_grams()
    if max(g[5] for g in grams) > 63:
        raise ValueError("a template has more grams than a mask has bits")
    table = spark.createDataFrame([(g[0], g[1], g[2], g[3], g[4], g[5], g[6]) for g in grams], "template int, place int, k int, label string, base boolean, n_grams int, words array<string>")
    h = F.transform("words", lambda w: F.xxhash64(w))
    table = table.select("template", "place", F.expr("shiftleft(1L, place)").alias("vote"), "k", "label", "base", "n_grams", F.when(F.size("words") == 2, F.xxhash64(h[0], h[1])).otherwise(F.xxhash64(h[0], h[1], F.get(h, F.lit(2)))).alias("hash"))
    # of the letters whose lower case is ASCII only the Kelvin sign is not A-Z
    text = F.lower(F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u00e9")))
    words = F.regexp_extract_all(text, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), 1)
    known = [r["hash"] for r in table.select("hash").distinct().collect()]
    doc_id, raw = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id.isNull(), doc_id, raw).alias("id"), words.alias("words"))
    hashed = rows.select("doc_id", "id", F.size("words").alias("n"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    wh, n = F.col("h"), F.col("n")
    rolling = lambda k: F.transform(F.slice(wh, 1, F.greatest(n - (k - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(wh, i + j) for j in range(1, k))))
    rolled = hashed.select("doc_id", "id", "n", rolling(2).alias("pairs"), rolling(3).alias("triples"))
    template = lambda g, i: F.when(g.isin(known), F.struct(g.alias("hash"), i.alias("at")))
    met = F.array_compact(F.concat(F.transform("pairs", template), F.transform("triples", template)))
    rows = saved(rolled.select("doc_id", "id", n.cast("long").alias("n_words"), met.alias("met")))
    places = rows.select("id", F.explode("met").alias("gram")).select("id", "gram.hash", "gram.at")
    voted = places.join(F.broadcast(table), "hash")  # a constant of this module
    diagonals = voted.groupBy("id", "template", "k", "label", "base", "n_grams", (F.col("at") - F.col("place")).alias("diagonal")).agg(
        F.bit_or("vote").alias("mask"), F.min("at").alias("low"), (F.max("at") + F.first("k")).alias("high")
    )
    by_diagonal = Window.partitionBy("id", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(by_diagonal) > F.when(F.col("n_grams") > 1, DRIFT).otherwise(0)
    merged = diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(by_diagonal.rowsBetween(Window.unboundedPreceding, 0)))
    spans = merged.groupBy("id", "template", "k", "label", "base", "n_grams", "run").agg(F.bit_or("mask").alias("mask"), F.min("low").alias("low"), F.max("high").alias("high"))
    share = F.bit_count("mask") / F.col("n_grams")
    verified = spans.withColumn("share", share).filter((F.col("share") >= SHARE) & (F.col("high") - F.col("low") <= STRETCH * (F.col("n_grams") + F.col("k"))))
    found = verified.groupBy("id").agg(
        F.sum(F.col("base").cast("long")).alias("n_base"),
        F.min(F.when(F.col("base"), F.col("low").cast("long"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("low").cast("long"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.struct("low", "high", "label"))).alias("spans"),
    )
    return rows.select("id", "doc_id", "n_words").join(found, "id", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )


def op2_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


OP2_SQL = rf"""
WITH grams(template, place, k, label, base, n_grams, g) AS (
  VALUES {", ".join(f"({t}, {i}, {k}, '{label}', {base}, {n}, '{' '.join(w)}')" for t, i, k, label, base, n, w in template_grams())}
), words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT doc_id, k, i - 1 AS "at", array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (VALUES (2), (3)) AS s(k) WHERE len(w) >= k)
), diagonals AS (
  SELECT doc_id, template, k, label, base, n_grams, "at" - place AS diagonal, list(place) AS voted, min("at") AS low, max("at" + k) AS high
  FROM places JOIN grams USING (k, g) GROUP BY ALL
), marked AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= CASE WHEN n_grams > 1 THEN {DRIFT} ELSE 0 END THEN 0 ELSE 1 END AS fresh FROM diagonals
), runs AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM marked
), spans AS (
  SELECT doc_id, template, k, label, base, n_grams, run, len(list_distinct(flatten(list(voted)))) AS votes, min(low) AS low, max(high) AS high FROM runs GROUP BY ALL
), verified AS (
  SELECT *, votes / n_grams AS share FROM spans WHERE votes / n_grams >= {SHARE} AND high - low <= {STRETCH} * (n_grams + k)
), found AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(low) FILTER (base) AS first_word, max(low) FILTER (base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM verified GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM words LEFT JOIN found USING (doc_id)
"""
