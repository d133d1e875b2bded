r"""Sharding over fixed virtual slots (operator 9).

A document's id hashes to one of SLOTS virtual slots, once and for all.  A
versioned map, stored as Parquet, gives each slot a shard; growing or rebalancing
stores a new version with some slots edited, so only the rows of those move.  The
first map of n shards depends on n alone: it is n - 1 grow edits of the map of one
shard.  Rows are numbered inside their slot
and the slots' row counts give each slot its first number, so no task holds a
shard.

Defined cases: a null text has no bytes; a null doc_id hashes as the empty
string; repeated rows stay together and are numbered in turn; an empty table
gives no rows; other columns are not read by `assign`, and `write_shards` passes
them through: where the input has a column `shard`, the folders are named `_shard=N`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.llm.columns import free
from larkspan.llm.lineage import new_path, saved

SLOTS, SHARDS = 4096, 16


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key: 32 bits of its md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % slots


def grown(slot_map: list[int]) -> list[int]:
    """The map after one more shard: of n + 1 shards, each gives every (n + 1)-th of its slots to the new one and takes none."""
    new, seen, out = max(slot_map) + 1, {}, []
    for shard in slot_map:
        seen[shard] = rank = seen.get(shard, -1) + 1
        out.append(new if rank % (new + 1) == new else shard)
    return out


def map_of(shards: int, slots: int = SLOTS) -> list[int]:
    out = [0] * slots
    for _ in range(shards - 1):
        out = grown(out)
    return out


def rebalanced(slot_map: list[int], slot_bytes: list[int], tolerance: float = 0.02) -> list[int]:
    """The map after moving slots from the fullest to the emptiest shard while that lessens the fullest, until it is within `tolerance` of the mean."""
    out = list(slot_map)
    load = [0] * (max(out) + 1)
    own: list[list[int]] = [[] for _ in load]
    for slot, shard in enumerate(out):
        load[shard] += slot_bytes[slot]
        own[shard].append(slot)
    mean = sum(load) / len(load)
    while (full := max(range(len(load)), key=load.__getitem__)) != (low := min(range(len(load)), key=load.__getitem__)) and load[full] > mean * (1 + tolerance):
        gap = load[full] - load[low]
        fits = [s for s in own[full] if 0 < slot_bytes[s] < gap]
        if not fits:
            break
        slot = min(fits, key=lambda s: (abs(gap / 2 - slot_bytes[s]), s))
        out[slot] = low
        own[full].remove(slot)
        own[low].append(slot)
        load[full] -= slot_bytes[slot]
        load[low] += slot_bytes[slot]
    return out


def slot_table(spark: SparkSession, versions: dict[int, list[int]]) -> DataFrame:
    """version, virtual_slot, shard: what is stored of a map's history."""
    return spark.createDataFrame([(v, i, s) for v, m in sorted(versions.items()) for i, s in enumerate(m)], "version int, virtual_slot long, shard int")


def slot_bytes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """virtual_slot, n_rows, n_bytes of every slot that has rows: at most `slots` rows."""
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long") + 1
    return docs.groupBy(slot_of(F.col("doc_id"), slots).alias("virtual_slot")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(size).alias("n_bytes"))


def store_map(spark: SparkSession, path: str, slot_map: list[int], version: int) -> None:
    """Adds a version to the maps under `path`; one that is there is never rewritten."""
    slot_table(spark, {version: slot_map}).drop("version").coalesce(1).write.parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[int]]:
    """(version, map) of one version, the latest by default; a map has one row per slot."""
    maps = spark.read.schema("virtual_slot long, shard int, version int").parquet(path)
    version = version if version is not None else maps.agg(F.max("version")).first()[0]
    return version, [r.shard for r in maps.filter(F.col("version") == version).orderBy("virtual_slot").collect()]


def rebalance(docs: DataFrame, path: str, tolerance: float = 0.02) -> int:
    """Stores and names the version after the latest under `path` with slots moved so that the bytes of `docs` are even."""
    spark = docs.sparkSession
    version, now = load_map(spark, path)
    size = {r.virtual_slot: r.n_bytes for r in slot_bytes(docs, len(now)).collect()}  # one row per slot at most
    store_map(spark, path, rebalanced(now, [size.get(s, 0) for s in range(len(now))], tolerance), version + 1)
    return version + 1


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, maps: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (the place in the shard, from 0), grown_shard, virtual_slot, slot_bytes, version.  With `maps` by the latest map stored there, else by the map of `shards`."""
    spark = docs.sparkSession
    version, now = load_map(spark, maps) if maps else (shards, map_of(shards, slots))
    slots = len(now)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = saved(docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot_of(F.col("doc_id"), slots).alias("virtual_slot")))
    both = slot_table(spark, {0: now, 1: grown(now)}).groupBy("virtual_slot").agg(F.min(F.when(F.col("version") == 0, F.col("shard"))).alias("shard"), F.min(F.when(F.col("version") > 0, F.col("shard"))).alias("grown_shard"))
    filled = rows.groupBy("virtual_slot").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("size").alias("slot_bytes"))
    before = F.sum("n_rows").over(Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1))
    table = both.join(F.broadcast(filled), "virtual_slot").withColumn("first", F.coalesce(before, F.lit(0))).drop("n_rows")  # at most `slots` rows
    nth = F.row_number().over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("nth", nth).join(F.broadcast(table), "virtual_slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("nth")).alias("slot"), "grown_shard", "virtual_slot", "slot_bytes", F.lit(version).alias("version")
    )


def write_shards(docs: DataFrame, path: str, slot_map: list[int]) -> None:
    """`docs` as Parquet under path/shard=N, a file or more for each group of slots."""
    slot, shard = free(docs, "_vslot"), free(docs, "shard")
    table = slot_table(docs.sparkSession, {1: slot_map}).select(F.col("virtual_slot").alias(slot), F.col("shard").alias(shard))
    # one row per slot
    docs.withColumn(slot, slot_of(F.col("doc_id"), len(slot_map))).join(F.broadcast(table), slot).repartition(slot).drop(slot).write.partitionBy(shard).parquet(path)


def op9_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    maps = new_path(spark)
    store_map(spark, maps, map_of(SHARDS), SHARDS)
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), maps=maps)


def _map_sql() -> str:
    out = [f"m1 AS (SELECT range AS v, 0 AS s FROM range({SLOTS}))"]
    for n in range(1, SHARDS + 1):
        out.append(f"m{n + 1} AS (SELECT v, CASE WHEN (row_number() OVER (PARTITION BY s ORDER BY v) - 1) % {n + 1} = {n} THEN {n} ELSE s END AS s FROM m{n})")
    return ", ".join(out)


OP9_SQL = f"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, i) AS c FROM (SELECT range AS i FROM range(256)))
), {_map_sql()}, rows AS (
  SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT % {SLOTS} AS v,
         xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT), lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1]), 4294967295), 4294967295) AS text_crc32
  FROM documents, crc
), placed AS (
  SELECT rows.*, a.s AS shard, b.s AS grown_shard, sum(size) OVER (PARTITION BY v) AS slot_bytes FROM rows JOIN m{SHARDS} a USING (v) JOIN m{SHARDS + 1} b USING (v)
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY v, doc_id, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard,
       v AS virtual_slot, CAST(slot_bytes AS BIGINT) AS slot_bytes, {SHARDS} AS version
FROM placed
"""
