r"""Substring deduplication by seed and extend (operator 10).

0. Of equal texts only the first (smallest doc_id) goes on; every window of the
   others starts in it, so all their words go.
1. Every window of `span` words selects its smallest k-gram as an anchor
   (winnowing), by content alone: equal windows select equal anchors.
2. Anchors meet by hash; those in two documents or more are seeds.
3. Each seed is extended both ways: all windows that select it are hashed, and a
   window is a repeat if its sequence starts in a smaller doc_id too.  Runs of
   such windows are the maximal repeats of at least `span` words.
4. A last pass over the texts drops the covered words.

What a map task already knows to be shared it passes on by document, and tells
the others with one row per hash; a passage in a third of all documents puts no
more than one row per map chunk on its key.  Reduce tasks take their rows sorted by
hash (Spark's sort spills) and hold one batch and what is open of one hash.

Defined cases: null and empty texts have no words; texts shorter than `span`
words keep all; a null doc_id counts as the largest; repeated rows (same doc_id,
same text) each keep what one of them would keep; different texts of one doc_id,
or of none, have places of their own and repeat nothing from each other; other
columns are not read.  Windows and whole texts are compared by 64-bit hashes, and
places are kept by a 64-bit hash of doc_id and text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.lineage import saved
from larkspan.llm.textops import Words, mix, slices, winnow

SPAN, GRAM = 13, 6
_LAST = 2**63 - 1
_MEET = "key long, doc_id long, row long, at int"


def _ranks(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    new = np.ones(len(order), dtype=bool)
    new[1:] = values[order][1:] != values[order][:-1]
    return order, new


def _met(hashes: np.ndarray, docs: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row: whether its hash is in two documents or more, and the smallest document of its hash."""
    if not len(hashes):
        return np.empty(0, bool), docs
    order, new = _ranks(hashes)
    at = np.flatnonzero(new)
    least, most = np.minimum.reduceat(docs[order], at), np.maximum.reduceat(docs[order], at)
    many = (least != most) | np.logical_or.reduceat(told[order], at)
    group = np.cumsum(new) - 1
    out, low = np.empty(len(order), bool), np.empty(len(order), np.int64)
    out[order], low[order] = many[group], least[group]
    return out, low


def _batch(key, docs, row, at) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (key.view(np.int64), docs, row, at.astype(np.int32))], names=["key", "doc_id", "row", "at"])


def _combine(hashes, docs, row, at, known):
    """Rows for the exchange: by hash, or (at -2 and below: -2 - place) settled here and dealt out evenly.

    known "shared": settled if two documents of the chunk have the hash; at -1 then tells the others of it.
    known "later": settled if a smaller document of the chunk has it.
    """
    many, low = _met(hashes, docs, np.zeros(len(docs), bool))
    done = many & ((docs > low) if known == "later" else True)
    yield _batch(mix(row[done].astype(np.uint64) * np.uint64(31) + at[done].astype(np.uint64)), np.zeros(done.sum(), np.int64), row[done], -2 - at[done])
    rest = ~done
    # among anchors a document is a row: one column less to exchange
    yield _batch(hashes[rest], docs[rest] if known == "later" else np.zeros(rest.sum(), np.int64), row[rest], at[rest])
    if known == "shared" and many.any():
        told, first = np.unique(hashes[many], return_index=True)
        yield _batch(told, np.zeros(len(told), np.int64), row[many][first], np.full(len(told), -1))


def _anchors(span: int, gram: int):
    def run(batches):
        for b in slices(batches, "text"):
            w = Words(b.column("text"))
            g = w.grams(w.hashes(), gram)
            ok = w.within(span)
            if not ok.any():
                continue
            pick = np.unique((np.arange(len(ok)) + winnow(g, span - gram + 1))[ok])
            row = w.row[pick]
            own = np.asarray(b.column("row"))[row]
            yield from _combine(g[pick], own, own, pick - w.first[row], "shared")

    return run


def _meet(by, settle):
    """Reduce stage over rows sorted by key: (row, at) of the settled rows and of those that `settle` picks from the others of their hash.

    The last hash of a batch stays open: what is picked goes out at once, and `settle`
    keeps what the rest of the hash has to know.
    """
    names = ("key", by, "row", "at")

    def out(row, at):
        return pa.RecordBatch.from_arrays([pa.array(row), pa.array(at)], names=["row", "at"])

    def run(batches):
        open_ = [np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int32)]
        for b in batches:
            if not b.num_rows:
                continue
            new = [np.asarray(b.column(c)) for c in names]
            done = new[3] < -1
            yield out(new[2][done], -2 - new[3][done])
            key, docs, row, at = (np.concatenate([o, n[~done]]) for o, n in zip(open_, new, strict=True))
            many, low = _met(key, docs, at == -1)
            pick, keep = settle(docs, at, many, low)
            yield out(row[pick], at[pick])
            keep &= key == key[-1] if len(key) else keep
            open_ = [x[keep] for x in (key, docs, row, at)]
            if len(key) and settle is _pick_seeds and many[-1]:  # one row tells the rest
                open_ = [key[-1:], docs[-1:], row[-1:], np.array([-1], np.int32)]

    return run


def _pick_seeds(docs, at, many, low):
    pick = many & (at >= 0)
    return pick, ~pick


def _pick_later(docs, at, many, low):
    pick = docs > low
    return pick, ~pick


_seeds = _meet("row", _pick_seeds)
_later = _meet("doc_id", _pick_later)


def _flags(lists: pa.Array, w: Words) -> np.ndarray:
    """True at the word positions that the lists name, row by row."""
    out = np.zeros(len(w) + 1, dtype=bool)
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    at = lists.flatten().to_numpy(zero_copy_only=False)
    inside = at < np.repeat(w.counts, sizes)
    out[(np.repeat(w.first[:-1], sizes) + at)[inside]] = True
    return out[: len(w)]


def _extend(span: int, gram: int):
    def run(batches):
        for b in slices(batches, "text"):
            w = Words(b.column("text"))
            seed = _flags(b.column("ats"), w)
            h = w.hashes()
            g = w.grams(h, gram)
            ok = w.within(span)
            if not ok.any():
                continue
            n = np.arange(len(ok))
            start = n[ok & seed[n + winnow(g, span - gram + 1)]]
            row = w.row[start]
            yield from _combine(w.grams(h, span)[start], np.asarray(b.column("doc_id"))[row], np.asarray(b.column("row"))[row], start - w.first[row], "later")

    return run


def _cut(span: int):
    def run(batches):
        for b in slices(batches, "text"):
            w = Words(b.column("text"))
            step = np.zeros(len(w) + span + 1, dtype=np.int64)
            ok = np.zeros(len(w), bool)
            ok[: len(w) - span + 1 if len(w) >= span else 0] = w.within(span)
            again = ~np.asarray(b.column("first").fill_null(False))
            start = np.flatnonzero(_flags(b.column("ats"), w) | ok & again[w.row])
            np.add.at(step, start, 1)
            np.add.at(step, start + span, -1)
            gone = np.cumsum(step)[: len(w)] > 0
            before = np.concatenate([[0], np.cumsum(gone)])
            raw = w.data.tobytes()
            kept = []
            for i in range(b.num_rows):
                low, high = w.first[i], w.first[i + 1]
                if before[high] == before[low]:
                    words = raw[w.rows[i] : w.rows[i + 1]].split()
                else:
                    at = np.flatnonzero(~gone[low:high]) + low
                    words = [raw[s:e] for s, e in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(w.counts.astype(np.int64)), pa.array(before[w.first[1:]] - before[w.first[:-1]]), pa.array(kept, pa.string()), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in kept], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"],
            )

    return run


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text and kept_sha256 of every row of `docs` (doc_id, text)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    docs = docs.select(F.coalesce(doc_id, F.lit(_LAST)).alias("doc_id"), doc_id.isNull().alias("none"), F.xxhash64(doc_id.isNull(), doc_id, text).alias("row"), text.alias("text"))
    firsts = saved(docs.groupBy(F.xxhash64("text").alias("twin")).agg(F.min(F.struct("doc_id", "none", "row"))["row"].alias("row")).select("row"))
    dealt = lambda rows: rows.repartition(parts, "key").sortWithinPartitions("key")
    by_row = lambda rows: rows.groupBy("row").agg(F.collect_set("at").alias("ats"))
    seeds = by_row(dealt(docs.join(firsts, "row", "left_semi").mapInArrow(_anchors(span, gram), _MEET)).mapInArrow(_seeds, "row long, at int"))
    repeats = by_row(dealt(docs.join(seeds, "row").mapInArrow(_extend(span, gram), _MEET)).mapInArrow(_later, "row long, at int"))
    marks = firsts.join(repeats, "row", "left").select("row", "ats", F.lit(True).alias("first"))
    out = docs.join(marks, "row", "left").withColumn("doc_id", F.when(~F.col("none"), F.col("doc_id")))
    return out.mapInArrow(_cut(span), "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), least_doc AS (
  SELECT g, min(doc_id) AS d FROM windows GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN least_doc USING (g) WHERE d < doc_id
), numbered AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM words
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n FROM numbered ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
