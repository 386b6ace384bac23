"""Tables, key-value views of them, and the two replicas that the queries compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_values(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, value): the key as text, and the columns joined by '|' (nulls as empty text)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return rows.select(F.col(key).cast("string").alias("key"), F.concat_ws("|", *parts).alias("value"))


def thinned(rows: DataFrame, key: str) -> DataFrame:
    """The client's copy: rows whose key is divisible by 50 are missing."""
    return rows.where(F.col(key) % 50 != 0)


def edited(key: Column, value: Column) -> Column:
    """The client's value: changed where the key is divisible by 37."""
    return F.when(key % 37 == 0, F.concat(value, F.lit("*"))).otherwise(value)


def diverged_ids(rows: DataFrame, key: str, offset: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """Server and client ids: the client lacks ids divisible by 50 and has id + offset for those divisible by 101."""
    server = rows.select(F.col(key).cast("long").alias("id"))
    extra = server.where("id % 101 = 0").select((F.col("id") + offset).alias("id"))
    return server, thinned(server, "id").unionByName(extra)


def diverged_rows(rows: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Server and client key-value tables: the client misses keys divisible by 50 and changes those divisible by 37."""
    server = key_values(rows, key, columns)
    client = key_values(thinned(rows, key), key, columns)
    return server, client.withColumn("value", edited(F.col("key").cast("long"), F.col("value")))


def assert_unique(rows: DataFrame, key: str = "key") -> DataFrame:
    """``rows`` as they are; raises if a key occurs twice."""
    worst = rows.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    if worst > 1:
        raise ValueError(f"duplicate {key}")
    return rows
