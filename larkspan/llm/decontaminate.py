r"""Benchmark decontamination by winnowing (operator 6).

Every window of `span` words keeps its smallest k-gram hash, in documents and
items alike.  A shared window has a shared fingerprint, so joining fingerprints
misses none; each hit is extended both ways by comparing words, and the words of
a match of at least `span` are hit.  Items of fewer words are one window each:
their whole hash is looked up among the n-grams of that length.

The items' hashes go to the map tasks in blocks of at most `block` (documented
bound: 8 bytes each), one pass over the documents per block, so only candidate
fingerprints leave the map.  Items with the same words around a fingerprint meet
the documents as one class, so a passage that many items share costs a document
one row for each way the items go on from it, not one for each item; items are
named again for each distinct set of classes, not for each document.

Defined cases: null and empty texts have no words, hits or items; items without
words are no window; rows that share a doc_id and a text are judged alike, other
texts of that doc_id, or of none, apart; item_ids are numbers or strings, and a
null one is one more id (as the empty string); other columns are not read, and
`drop_contaminated` passes them through whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.columns import free
from larkspan.llm.lineage import saved
from larkspan.llm.textops import ALNUM, Words, mix, slices, winnow

SPAN, GRAM, BLOCK = 13, 6, 4_000_000
_NO_ID = 2**63 - 1


def _anchors(w: Words, hashes: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of the fingerprints of all windows of `span` words."""
    ok = w.within(span)
    if not ok.any():
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g = w.grams(hashes, gram)
    pick = np.unique((np.arange(len(ok)) + winnow(g, span - gram + 1))[ok])
    return pick, mix(g[pick] + np.uint64(span))


def _whole(w: Words, hashes: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
    """The hash of `n` words from each of `at`, as the only window of an item of `n` words has it."""
    return mix(w.grams(hashes, n)[at] + np.uint64(1000 + n))


def _around(w: Words, at: int, n: int, reach: int) -> tuple[list[str], list[str]]:
    """Up to `reach` words before a gram, nearest first, and the gram with up to `reach` words after it."""
    row = w.row[at]
    word = lambda i: w.data[w.starts[i] : w.ends[i]].tobytes().decode()
    return [word(i) for i in range(at - 1, max(w.first[row], at - reach) - 1, -1)], [word(i) for i in range(at, min(w.first[row + 1], at + n + reach))]


_ROW = "hash long, gram int, id long, part long, at int, n_words long, before array<string>, after array<string>"
_TYPES = pa.schema([("hash", pa.int64()), ("gram", pa.int32()), ("id", pa.int64()), ("part", pa.int64()), ("at", pa.int32()), ("n_words", pa.int64()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])


def _batch(rows: list[tuple], types: pa.Schema = _TYPES) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(types.names, r, strict=True)) for r in rows], schema=types)


def _item_rows(span: int, gram: int):
    """Map stage over items (id, text): a row per fingerprint; its gram is what both sides compare first."""

    def run(batches):
        for b in slices(batches, "text"):
            w, ids = Words(b.column("text"), ALNUM, lower=True), b.column("id").to_pylist()
            h, rows = w.hashes(), []
            found = [(gram, span - gram, *_anchors(w, h, span, gram))]
            for n in range(1, span):
                at = w.first[:-1][w.counts == n]
                found.append((n, 0, at, _whole(w, h, n, at) if len(at) else np.empty(0, np.uint64)))
            for n, reach, at, hashes in found:
                rows += [(x, n if reach else -n, ids[w.row[i]], None, i - int(w.first[w.row[i]]), None, *_around(w, i, n, reach)) for i, x in zip(at.tolist(), hashes.view(np.int64).tolist(), strict=True)]
            yield _batch(rows, _TYPES.set(2, pa.field("id", b.column("id").type)))

    return run


def _doc_rows(span: int, gram: int, sizes: list[int], known, counts: bool):
    """Map stage over documents (id, part, text): a row per fingerprint that is in `known`; with `counts` one per text with its number of words."""

    def run(batches):
        wanted = known.value
        for b in slices(batches, "text"):
            w, ids, parts = Words(b.column("text"), ALNUM, lower=True), b.column("id").to_pylist(), b.column("part").to_pylist()
            h, rows = w.hashes(), []
            if counts:
                rows += [(None, None, i, p, None, n, None, None) for i, p, n in zip(ids, parts, w.counts.tolist(), strict=True)]
            found = [(gram, span - gram, *_anchors(w, h, span, gram))]
            for n in sizes:
                at = np.flatnonzero(w.within(n))
                found.append((n, 0, at, _whole(w, h, n, at)))
            for n, reach, at, hashes in found:
                signed = hashes.view(np.int64)
                hit = wanted[np.minimum(np.searchsorted(wanted, signed), len(wanted) - 1)] == signed
                rows += [(x, n if reach else -n, ids[w.row[i]], parts[w.row[i]], i - int(w.first[w.row[i]]), None, *_around(w, i, n, reach)) for i, x in zip(at[hit].tolist(), signed[hit].tolist(), strict=True)]
            yield _batch(rows)

    return run


def _spans(span: int):
    """Map stage over joined fingerprints: the words of a document that a match of the full length covers."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["gram"] < 0:
                    if r["after"] == r["item_after"]:
                        out.append((r["id"], r["part"], r["class"], r["at"], r["at"] - r["gram"]))
                    continue
                same = lambda x, y: next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
                left, right = same(r["before"], r["item_before"]), same(r["after"], r["item_after"])
                if right >= r["gram"] and left + right >= span:
                    out.append((r["id"], r["part"], r["class"], r["at"] - left, r["at"] + right))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(5)], names=["id", "part", "class", "low", "high"])

    return run


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _doc_key() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))


def _part() -> Column:
    """Tells the texts of one doc_id, or of none, apart."""
    return F.xxhash64(F.col("doc_id").isNull(), _text())


def _items(bench: DataFrame) -> DataFrame:
    whole = dict(bench.dtypes)["item_id"] in ("tinyint", "smallint", "int", "bigint")
    ident = F.coalesce(F.col("item_id").cast("long"), F.lit(_NO_ID)) if whole else F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    return bench.select(ident.alias("id"), _text().alias("text")).distinct()


def _judged(docs: DataFrame, bench: DataFrame, span: int, gram: int, block: int) -> DataFrame:
    """id, part, n_words, n_hit, item_ids (array), contaminated, whole (a match of `span` words or more), for every row of `docs`."""
    spark, items = docs.sparkSession, _items(bench)
    kind = dict(items.dtypes)["id"]
    items = saved(items.mapInArrow(_item_rows(span, gram), _ROW.replace("id long", f"id {kind}")))
    sizes = sorted(-r.gram for r in items.filter("gram < 0").select("gram").distinct().collect())
    hashes = items.select("hash").distinct()
    blocks = max(1, -(-hashes.count() // block))
    found, texts = None, docs.select(_doc_key().alias("id"), _part().alias("part"), _text().alias("text"))
    for i in range(blocks):
        own = np.sort(hashes.filter(F.pmod("hash", F.lit(blocks)) == i).toPandas()["hash"].to_numpy(np.int64))
        known = spark.sparkContext.broadcast(own if len(own) else np.array([0], np.int64))
        rows = texts.mapInArrow(_doc_rows(span, gram, sizes, known, counts=not i), _ROW)
        found = rows if found is None else found.union(rows)
    found = saved(found)
    context = ["hash", "gram", "before", "after"]
    classes = items.select(*context, "id").distinct().withColumn("class", F.xxhash64(*context))
    sought = classes.select("class", "hash", "gram", F.col("before").alias("item_before"), F.col("after").alias("item_after")).distinct()
    met = found.filter("hash IS NOT NULL").join(sought, ["hash", "gram"]).mapInArrow(_spans(span), "id long, part long, class long, low long, high long")
    merge = "aggregate(array_sort(collect_set(struct(low, high))), struct(0L AS n, 0L AS upto), (a, x) -> struct(a.n + greatest(0L, x.high - greatest(x.low, a.upto)) AS n, greatest(a.upto, x.high) AS upto), a -> a.n)"
    per_doc = saved(met.groupBy("id", "part").agg(F.expr(merge).alias("n_hit"), F.array_sort(F.collect_set("class")).alias("classes"), F.max(F.col("high") - F.col("low") >= span).alias("whole")))
    named = per_doc.select("classes").distinct().select("classes", F.explode("classes").alias("class")).join(classes.select("class", F.col("id").alias("item_id")), "class")
    per_doc = per_doc.join(named.groupBy("classes").agg(F.collect_set("item_id").alias("item_ids")), "classes")
    out = found.filter("n_words IS NOT NULL").select("id", "part", "n_words").join(per_doc, ["id", "part"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    item_ids = F.coalesce("item_ids", F.array().cast(f"array<{kind}>"))
    return out.select("id", "part", "n_words", n_hit.alias("n_hit"), item_ids.alias("item_ids"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"), F.coalesce("whole", F.lit(False)).alias("whole"))


def contamination(docs: DataFrame, bench: DataFrame, span: int = SPAN, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (array), contaminated, for every row of `docs` (doc_id, text); `bench` has item_id, text."""
    out = _judged(docs, bench, span, gram, block)
    return out.select(F.nullif("id", F.lit(_NO_ID)).alias("doc_id"), "n_words", "n_hit", "item_ids", "contaminated")


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no window of SPAN words of an item, however long they are around it, and aren't contaminated by shorter items."""
    key, part = (free(docs, "_hit") + x for x in ("_id", "_part"))
    dirty = _judged(docs, bench, SPAN, GRAM, BLOCK).filter("contaminated OR whole").select(F.col("id").alias(key), F.col("part").alias(part)).distinct()
    return docs.join(dirty, (_doc_key() == F.col(key)) & (_part() == F.col(part)), "left_anti")


def op6_winnow_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    names = F.array_join(F.array_sort(F.transform("item_ids", lambda x: F.when(x.cast("string") == str(_NO_ID), "").otherwise(x.cast("string")))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


OP6_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM items WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT DISTINCT doc_id, item_id, i, n FROM places JOIN windows USING (n, g)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
