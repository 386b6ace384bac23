"""The deterministic key-value generator of the stress grid."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions.hashing import murmur128_bytes


@F.pandas_udf(T.StringType())
def _value(seeds: pd.Series) -> pd.Series:
    """Upper-case hyphenated hex of the 128-bit hash of an int's 4 bytes, written twice."""
    raw = [int(s).to_bytes(4, "little", signed=True) for s in seeds]
    a, b = murmur128_bytes(raw)
    pairs = np.stack([a, b], axis=1).astype("<u8").tobytes()
    return pd.Series(["-".join(f"{x:02X}" for x in pairs[16 * i : 16 * i + 16]) * 2 for i in range(len(raw))])


def generate(spark: SparkSession, size: int, changed_percent: int) -> DataFrame:
    """(key, value) with keys 0 .. size + added - 1. Half of the change is modified rows (the first
    ones, by another seed), half is rows added at the end; the halves round down to whole percents."""
    touched = (changed_percent // 2) * size // 100
    seed = F.when(F.col("id") < touched, -F.col("id") - 1).otherwise(F.col("id")).cast("int")
    return spark.range(size + touched).select(F.col("id").cast("string").alias("key"), _value(seed).alias("value"))


def true_difference(size: int, changed_percent: int) -> float:
    """Ids that differ from an unchanged copy: two for each modified row, one for each added."""
    return 1.5 * changed_percent * size / 100
