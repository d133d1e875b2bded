r"""Near copies beyond the reach of a 64-bit fingerprint: five-word shingles, resemblance of 0.8 or more.

Texts that share 0.8 of their five-word shingles differ in 2 to 14 bits of a
SimHash, where a ball has millions of variants.  So the stage that keeps one
document of each group also takes BANDS keys of ROWS minimum shingle hashes per
text (two texts at 0.8 share none with probability 0.002) and verifies on whole
shingle sets:

1. Each document of a key against the key's smallest and largest doc_id.
2. Where a key then still holds two groups or more of documents besides those two,
   they are compared with those of other groups, by the prefix filter: of two sets at 0.8 with shingles in one
   order, rare ones first, the first ninth of the smaller and the first fifth of
   the larger share a shingle that leaves enough behind it.  This misses none.

So every two texts at 0.8 that share a key end in one group.  A group of near
copies costs two links per document, as in 1, and no pairs of its own in 2.  The
shingles of a document that many pairs name are dealt out to as many tasks as it has
hundreds of pairs.

Defined cases: texts of fewer than five words have no shingles and no links;
rows that share a doc_id link that id once for each; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.llm.components import components
from larkspan.llm.lineage import saved, stored
from larkspan.llm.textops import Words, mix, slices

WORDS, SIMILAR, BANDS, ROWS = 5, 0.8, 16, 5
_ODDS = np.random.default_rng(80).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _shingles(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of the rows that have any, where each such row's begin, and which rows they are."""
    w = Words(batch.column("text"), lower=True)
    ok = w.within(WORDS)
    row, first = np.unique(w.row[: len(ok)][ok], return_index=True)
    return w.grams(w.hashes(), WORDS)[ok], first, row


def _bands(batches):
    for b in slices(batches, "text"):
        hashes, first, row = _shingles(b)
        if not len(row):
            continue
        docs = b.column("doc_id").take(pa.array(row))
        for band in range(BANDS):
            key = np.full(len(row), band, np.uint64)
            for odd in _ODDS[band * ROWS : (band + 1) * ROWS]:
                key = mix(key ^ np.minimum.reduceat(hashes * odd, first))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), docs], names=["key", "doc_id"])


def _sets(batches):
    for b in slices(batches, "text"):
        hashes, first, row = _shingles(b)
        if len(row):
            each = [np.unique(x) for x in np.split(hashes, first[1:])]
            ends = np.cumsum([0, *map(len, each)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(each).view(np.int64)))
            print_ = pa.array(np.array([np.bitwise_xor.reduce(mix(x)) for x in each]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), print_, lists], names=["doc_id", "print", "shingles"])


_SETS = "doc_id long, print long, shingles array<long>"


_SHARE = 100


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (a, b), b the smaller, of those of `pairs` (doc, hub, n) whose texts are similar; `hub` is in some `n` pairs, `doc` in few."""
    last = F.floor(F.col("n") / _SHARE)
    dealt = pairs.select("doc", "hub", F.pmod(F.xxhash64("doc"), last + 1).alias("part"))
    wanted = pairs.groupBy("hub").agg(F.max(last).alias("last"))
    y = sets.join(wanted, F.col("doc_id") == F.col("hub")).select("hub", F.col("shingles").alias("theirs"), F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("part"))
    x = sets.select(F.col("doc_id").alias("doc"), "shingles")
    # in sizes this far apart no two sets are similar
    both = dealt.join(x, "doc").join(y, ["hub", "part"]).filter(F.least(F.size("shingles"), F.size("theirs")) >= SIMILAR * F.greatest(F.size("shingles"), F.size("theirs")))
    shared = F.size(F.array_intersect("shingles", "theirs"))
    similar = both.filter(shared >= SIMILAR * (F.size("shingles") + F.size("theirs") - shared))
    return similar.select(F.greatest("doc", "hub").alias("a"), F.least("doc", "hub").alias("b")).distinct()


def _candidates(sets: DataFrame, grouped: DataFrame) -> DataFrame:
    """Pairs (doc, hub, n) of documents of `grouped` (doc_id, component) in two components; all that are similar are among them."""
    each = sets.join(grouped, "doc_id").select("doc_id", "print", "component", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    # a shingle of one component meets no other: such ones come first in the order
    wide = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("shingle", "n")
    text = Window.partitionBy("doc_id", "print", "size")
    last = F.count(F.lit(1)).over(text) - F.row_number().over(text.orderBy("n", "shingle"))
    need = lambda share, size: F.ceil(share * size - 1e-6)
    held = each.join(wide, "shingle").withColumn("left", last + 1)  # shingles from this one on
    held = saved(held.filter(F.col("left") >= need(SIMILAR, F.col("size"))).select("shingle", "doc_id", "component", "size", "left"))
    x, y = held.alias("x"), held.filter(F.col("left") >= need(2 * SIMILAR / (1 + SIMILAR), F.col("size"))).alias("y")
    xs, ys = F.col("x.size"), F.col("y.size")
    larger = (ys < xs) | (ys == xs) & (F.col("y.doc_id") < F.col("x.doc_id"))
    enough = F.least("x.left", "y.left") >= need(SIMILAR / (1 + SIMILAR), xs + ys)
    met = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component")) & larger & enough)
    return met.select(F.col("x.doc_id").alias("doc"), F.col("y.doc_id").alias("hub")).distinct().withColumn("n", F.lit(0).cast("long"))


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def hub_links(texts: DataFrame, among: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Step 1: links (a, b) to the hubs of each key, (key, doc_id) of the documents that step 2 may have to compare, and the shingle sets of all that share a key."""
    keys = saved(texts.mapInArrow(_bands, "key long, doc_id long").join(among, "doc_id").select("key", "doc_id"))
    hubs = keys.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high")
    met = saved(keys.join(hubs, "key").select("key", "doc_id", "low", "high", "n"))
    sets = stored(texts.join(met.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(_sets, _SETS))
    hub = met.select(F.col("doc_id").alias("doc"), F.explode(F.array("low", "high")).alias("hub"), "low", "n").filter("doc <> hub AND NOT (hub <> low AND doc = low)")
    links = saved(_verified(sets, saved(hub.groupBy("doc", "hub").agg(F.max("n").alias("n")))))
    return links, met.filter("n > 3 AND doc_id <> low AND doc_id <> high").select("key", "doc_id"), sets


def rest_links(sets: DataFrame, rest: DataFrame, groups: DataFrame) -> DataFrame:
    """Step 2: links (a, b) between documents of `rest` (key, doc_id) that share a key and are in two components of `groups` (node, component)."""
    grouped = rest.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    split = grouped.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    unsettled = saved(grouped.join(split, "key", "left_semi").select("doc_id", "component").distinct())
    return saved(_verified(sets, saved(_candidates(sets, unsettled))))


def resembling_links(docs: DataFrame, among: DataFrame) -> DataFrame:
    """Links (a, b), b the smaller, between documents of `docs` (doc_id, text) whose ids are in `among` (doc_id, each once)."""
    links, rest, sets = hub_links(texts_of(docs), among)
    return links.union(rest_links(sets, rest, components(links)))
