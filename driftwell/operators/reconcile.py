"""Reconciling key-value tables: exact classes, patches and their application."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions.hashing import item_block, murmur32_udf, murmur_id_udf


def with_hash(rows: DataFrame, out: str = "h") -> DataFrame:
    """``rows`` (key, value) with the 32-bit hash of each item."""
    return rows.withColumn(out, murmur32_udf(item_block()))


def with_id(rows: DataFrame, out: str = "id") -> DataFrame:
    """``rows`` (key, value) with the 64-bit id of each item."""
    return rows.withColumn(out, murmur_id_udf(item_block()))


def classes(server: DataFrame, client: DataFrame) -> DataFrame:
    """(key, class): same, modified, server_only or client_only. Null values equal null values."""
    s = server.select("key", F.struct("value").alias("s"))
    c = client.select("key", F.struct("value").alias("c"))
    kind = (
        F.when(F.col("c").isNull(), "server_only").when(F.col("s").isNull(), "client_only")
        .when(F.col("s.value").eqNullSafe(F.col("c.value")), "same").otherwise("modified")
    )
    return s.join(c, "key", "full").select("key", kind.alias("class"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (equal): same number of rows, and every key of a has the same value in b."""
    same = a.select("key", "value").exceptAll(b.select("key", "value")).limit(1)
    back = b.select("key", "value").exceptAll(a.select("key", "value")).limit(1)
    return same.unionByName(back).agg((F.count("*") == 0).alias("equal"))


def difference_count(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (differences): rows of a that b lacks or has otherwise, and the difference of the row counts."""
    side = a.select("key", F.struct("value").alias("x")).join(b.select("key", F.struct("value").alias("y")), "key", "full")
    here, there = F.col("x").isNotNull(), F.col("y").isNotNull()
    off = here & (~there | ~F.col("x.value").eqNullSafe(F.col("y.value")))
    counts = side.agg(F.count_if(off).alias("off"), F.count_if(here).alias("a"), F.count_if(there).alias("b"))
    return counts.select((F.col("off") + F.abs(F.col("a") - F.col("b"))).alias("differences"))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, columns of a): 1 for distinct rows of a alone, -1 for those of b alone."""
    return a.subtract(b).withColumn("side", F.lit(1)).unionByName(b.subtract(a).withColumn("side", F.lit(-1)))


def missing(expected: DataFrame, store: DataFrame) -> DataFrame:
    """Rows of ``expected`` that the store lacks or has with another value."""
    return expected.select("key", "value").exceptAll(store.select("key", "value"))


def apply_patch(client: DataFrame, patch: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Upsert: rows of the patch win, other client rows stay. ``deleted`` (key) removes rows, which is off by default."""
    kept = client.join(patch.select("key"), "key", "left_anti")
    if deleted is not None:
        kept = kept.join(deleted.select("key"), "key", "left_anti")
    return kept.unionByName(patch.select(*client.columns))


def hash_list_patch(server: DataFrame, client: DataFrame) -> DataFrame:
    """Server rows whose item hash is not among the client's distinct hashes; ``client`` has its rows, or the
    hashes alone (h), as ``stores.save_hash_list`` writes them."""
    known = (client if client.columns == ["h"] else with_hash(client)).select("h").distinct()
    return with_hash(server).join(known, "h", "left_anti").select("key", "value")
