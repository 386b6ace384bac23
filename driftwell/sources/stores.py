"""Key-value stores, sketches and folders on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a store. The order of keys is not part of it; sort where it is needed."""
    return spark.read.parquet(path)


def point_read(store: DataFrame, keys: DataFrame, strict: bool = True) -> DataFrame:
    """Rows of ``keys`` (key). With ``strict``, a missing key raises when it is read."""
    rows = keys.select("key").distinct().join(store, "key", "left" if strict else "inner")
    if not strict:
        return rows
    missing = F.raise_error(F.concat(F.lit("no such key: "), F.col("key")))
    return rows.withColumn("value", F.when(F.col("value").isNull(), missing).otherwise(F.col("value")))


def upsert(store: DataFrame, patch: DataFrame, path: str) -> None:
    """Write the store with the patch applied to a fresh path; the old version stays readable until then."""
    from driftwell.operators.reconcile import apply_patch

    apply_patch(store, patch).write.mode("errorifexists").parquet(path)


def save_sketch(sketch: DataFrame, path: str) -> None:
    """A sketch is a DataFrame (bits, cells, strata, values, hashes or a delta): its file is a table."""
    sketch.write.mode("overwrite").parquet(path)


def load_sketch(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_hash_list(rows: DataFrame, path: str) -> None:
    """The distinct 32-bit item hashes of ``rows`` (key, value), one column h."""
    from driftwell.operators.reconcile import with_hash

    save_sketch(with_hash(rows).select("h").distinct(), path)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of every file below a folder, with paths relative to it. Content is
    only read where a query uses it. Spark's reader passes over empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.substring_index(F.col("path"), root + "/", -1)
    return files.select(relative.alias("path"), "length", "content")


def compare_folders(left: DataFrame, right: DataFrame) -> DataFrame:
    """(path, status) of every path of two ``list_files`` results: same, different, left_only or right_only."""
    a = left.select("path", F.sha2("content", 256).alias("a"))
    b = right.select("path", F.sha2("content", 256).alias("b"))
    status = (
        F.when(F.col("b").isNull(), "left_only").when(F.col("a").isNull(), "right_only").when(F.col("a") == F.col("b"), "same").otherwise("different")
    )
    return a.join(b, "path", "full").select("path", status.alias("status"))
