r"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 3).

Every distinct fingerprint emits all variants within half the radius: itself and
its 64 one-bit neighbours.  Two fingerprints within 2 bits share a variant, and
all that share one are within 2 bits of each other, so a variant has at most 65
fingerprints and linking each to the smallest of them loses no connection.  The
links are verified and joined to components.

Copies fold into their fingerprint before the exchange, so a group of copies of
any size costs 65 rows.

Defined cases: null and empty texts have fingerprint zero, linked like any other;
texts of fewer than three words are one shingle; a null doc_id is never a
component_id unless its component has no other; repeated rows are returned as
often as they came; other columns are not read.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.llm.columns import free
from larkspan.llm.components import components
from larkspan.llm.lineage import saved
from larkspan.llm.resemblance import hub_links, rest_links, texts_of
from larkspan.llm.textops import bytes_of, slices

SHINGLE, SEED, RADIUS = 3, 42, 2
_LOW_BITS = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, size: int = SHINGLE) -> list[int]:
    """XXH64 of the word shingles of a text, A-Z in lower case."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) < size:
        return [xxhash.xxh64_intdigest(joined, SEED)] if words else []
    digest = xxhash.xxh64_intdigest
    ends = [x + i for i, x in enumerate(accumulate(map(len, words)))]
    starts = [0, *(e + 1 for e in ends[: len(words) - size])]
    return [digest(joined[s:e], SEED) for s, e in zip(starts, ends[size - 1 :], strict=True)]


def fold(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of `counts` hashes: bits set in over half of them.

    Bits are counted eight bytes at a time, in blocks of 255 so that no byte overflows.
    """
    out = np.zeros(len(counts), dtype=np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    first = np.cumsum(n) - n
    blocks = -(-n // 255)
    at = np.cumsum(blocks) - blocks
    starts = np.repeat(first, blocks) + 255 * (np.arange(blocks.sum()) - np.repeat(at, blocks))
    for bit in range(8):
        per_block = np.add.reduceat((hashes >> np.uint64(bit)) & _LOW_BITS, starts)
        votes = np.add.reduceat(per_block.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), at, axis=0)
        for byte in range(8):
            out[full] |= (2 * votes[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def _fingerprints(batches):
    for b in slices(batches, "text"):
        data, rows = bytes_of(b.column("text"))
        raw = data.tobytes()
        each = [np.array(shingle_hashes(raw[s:e]), dtype=np.uint64) for s, e in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True)]
        prints = fold(np.concatenate(each), np.array([len(x) for x in each]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and print (64 bits as a long) of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, print long")


def ball_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between distinct values of `print` at most two bits apart, enough to connect all such."""
    flips = F.array(F.col("print"), *(F.col("print").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))
    near = prints.select("print", F.explode(flips).alias("variant")).withColumn("least", F.min("print").over(Window.partitionBy("variant")))
    links = near.filter("print <> least").select(F.col("print").alias("a"), F.col("least").alias("b")).distinct()
    return links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, print and component_id (the smallest doc_id reachable over links) of every row of `docs` (doc_id, text)."""
    prints = saved(fingerprints(docs))
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("first_id"))
    found = components(ball_links(classes.select("print"))).withColumnRenamed("node", "print")
    classes = classes.join(found, "print", "left").withColumn("component", F.coalesce("component", "print"))
    ids = classes.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return prints.join(classes.join(ids, "component").select("print", "component_id"), "print").select("doc_id", "print", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of `docs` with one document of each group of near-duplicates: its smallest doc_id, once.  Rows without an id stay.

    Groups are the components over fingerprints, joined with the links between texts
    that share 0.8 of their five-word shingles; of equal texts the smallest doc_id
    stands for all.  Of different texts under one kept doc_id, that of the smallest
    hash stays.
    """
    own = texts_of(docs.filter("doc_id IS NOT NULL"))
    nodes = saved(own.groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash")).agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct())
    prints = saved(fingerprints(own).join(nodes, "doc_id", "left_semi").distinct())
    classes = saved(prints.groupBy("print").agg(F.min("doc_id").alias("first_id")))
    first = lambda end: classes.select(F.col("print").alias(end), F.col("first_id").alias(f"first_{end}"))
    near = ball_links(classes.select("print")).join(first("a"), "a").join(first("b"), "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    alike = prints.join(classes, "print").filter("doc_id <> first_id").select("doc_id", "first_id")
    links, rest, sets = hub_links(own, nodes)
    links = saved(near.union(alike).union(links))
    groups = components(links)
    more = rest_links(sets, rest, groups)
    if not more.isEmpty():
        groups = components(links.union(more))
    later = groups.filter("node <> component").select(F.col("node").alias("doc_id"))
    kept = nodes.join(later, "doc_id", "left_anti")
    nth, text = free(docs, "_nth"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    one = docs.join(kept, "doc_id").withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64(text)))).filter(f"{nth} = 1")
    return one.select(docs.columns).union(docs.filter("doc_id IS NULL"))


def op3_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
