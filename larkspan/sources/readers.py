"""Scans: files by suffix, tagged unions, response logs and name pools."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: Column names looked for, in order: fixed values.
TEXT_COLUMNS = ["text", "review_text", "reviewText", "review", "content", "body"]
RATING_COLUMNS = ["stars", "rating", "overall", "score", "star_rating"]
ID_COLUMNS = ["review_id", "id", "reviewID"]
CSV = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def starts_array(spark: SparkSession, path: str) -> bool:
    """Whether the first line of a JSON source that isn't blank begins with a bracket."""
    head = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
    return bool(head) and head[0][0].lstrip().startswith("[")


def read_terms(spark: SparkSession, path: str) -> list[str]:
    """A block or allow list, one term a line (a list that fits a pattern)."""
    return [r[0] for r in spark.read.text(path).select(F.trim("value").alias("t")).filter("t <> ''").collect()]


def read_records(spark: SparkSession, path: str, schema: StructType | str | None = None, array: bool | None = None) -> DataFrame:
    """A JSON (lines, or one `array`: None to look), CSV or Parquet source by its suffix; malformed JSON lines are dropped."""
    suffix = path.rstrip("/").lower().rpartition(".")[2]
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if suffix in ("json", "jsonl", "ndjson"):
        return reader.option("multiLine", starts_array(spark, path) if array is None else array).option("mode", "DROPMALFORMED").json(path)
    if suffix == "csv":
        return reader.options(**CSV).csv(path)
    if suffix == "parquet":
        return reader.parquet(path)
    raise ValueError(f"no reader for .{suffix}")


def detect_column(columns: list[str], candidates: list[str], override: str | None = None, what: str = "text") -> str:
    if override:
        if override not in columns:
            raise ValueError(f"{what} column {override!r} isn't there: {columns}")
        return override
    found = next((c for c in candidates if c in columns), None)
    if found is None:
        raise ValueError(f"no {what} column among {columns}")
    return found


def placed(df: DataFrame) -> DataFrame:
    """`df`, read from files, with `_place`: the row's number from 1 by file and position, however the files are split.

    Rows are numbered inside each split; the splits' counts (one row a split) give each its first number.
    """
    meta = F.col("_metadata")
    split = df.select("*", meta["file_path"].alias("_file"), meta["file_block_start"].alias("_from"), F.monotonically_increasing_id().alias("_at"))
    counts = split.groupBy("_file", "_from").count()
    before = counts.select("_file", "_from", (F.sum("count").over(Window.orderBy("_file", "_from")) - F.col("count")).alias("_before"))
    nth = F.row_number().over(Window.partitionBy("_file", "_from").orderBy("_at"))
    return split.withColumn("_nth", nth).join(F.broadcast(before), ["_file", "_from"]).withColumn("_place", F.col("_before") + F.col("_nth")).drop("_file", "_from", "_at", "_before", "_nth")


def reviews_from(df: DataFrame, text: str | None = None, rating: str | None = None, ident: str | None = None) -> DataFrame:
    """source_review_id, raw_rating, raw_text by detected columns; where there is no id, `row<N>` by the row's place in its source, from 1 (`df` read from files)."""
    own = ident if ident in df.columns else next((c for c in ID_COLUMNS if c in df.columns), None)
    number = F.concat(F.lit("row"), F.col("_place"))
    given = F.nullif(F.col(own).cast("string"), F.lit("")) if own else None
    key = F.coalesce(given, number) if own else number
    return placed(df).select(key.alias("source_review_id"), F.col(detect_column(df.columns, RATING_COLUMNS, rating, "rating")).cast("string").alias("raw_rating"), F.col(detect_column(df.columns, TEXT_COLUMNS, text)).alias("raw_text"))


def tagged_union(sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """All sources with `source` and their order `source_ord`."""
    return reduce(DataFrame.unionByName, [df.withColumns({"source": F.lit(name), "source_ord": F.lit(i)}) for i, (name, df) in enumerate(sources)])


def first_rows(df: DataFrame, order: Column, n: int) -> DataFrame:
    """The first `n` rows; 0 for all."""
    return df.orderBy(order).limit(n) if n else df


def read_responses(spark: SparkSession, glob: str, schema: StructType | str) -> DataFrame:
    """Response logs of all models; `model` is the file's name without raw_responses_ and its suffix."""
    return spark.read.schema(schema).options(**CSV).csv(glob).withColumn("model", F.regexp_extract(F.col("_metadata.file_name"), r"^raw_responses_(.*)\.csv$", 1))


def pull_labelled(df: DataFrame, limit: int = 0) -> DataFrame:
    """Hub rows of (text, label from 0): stars are label + 1."""
    out = df.select(F.col("text"), (F.col("label") + 1).cast("int").alias("stars"))
    return out.limit(limit) if limit else out


def pull_titled(df: DataFrame, limit: int = 0) -> DataFrame:
    """Hub rows of (title, text, rating): the title leads, blank texts go, ratings round half-even."""
    out = df.select(F.trim(F.concat_ws(". ", F.nullif(F.trim("title"), F.lit("")), F.trim("text"))).alias("text"), F.rint("rating").cast("int").alias("rating"), F.trim("text").alias("_t")).filter("_t <> ''").drop("_t")
    return out.limit(limit) if limit else out


def name_pool(df: DataFrame, conditions: list[str], least: int = 5) -> tuple[DataFrame, list[str]]:
    """(condition, pos, name, sub_region) and warnings; a missing pool or a name given twice is fatal."""
    pool = df.withColumn("sub_region", F.coalesce(F.nullif(F.col("sub_region"), F.lit("")), F.lit("unspecified")) if "sub_region" in df.columns else F.lit("unspecified"))
    sizes = {r.condition: (r.n, r.d) for r in pool.groupBy("condition").agg(F.count("name").alias("n"), F.countDistinct("name").alias("d")).collect()}
    if missing := [c for c in conditions if c not in sizes]:
        raise ValueError(f"no names for {missing}")
    if twice := [c for c, (n, d) in sizes.items() if n != d]:
        raise ValueError(f"names given twice in {twice}")
    return pool, [f"{c}: only {n} names" for c, (n, _) in sizes.items() if n < least]
