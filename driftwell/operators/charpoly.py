"""Reconciliation by characteristic polynomials over a prime field.

A set's polynomial is the product of (x - s). Two sets' values at a few points give their quotient,
whose numerator vanishes exactly on the elements of the first set alone, and whose denominator on
those of the second alone. Values are products over all rows, formed by a sum of discrete steps:
each partition multiplies its own, and the partial products meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions import gf
from driftwell.operators import ibf
from driftwell.staging import stage

#: Points beyond the estimated difference, and those kept for verification.
PADDING, VERIFY = 3, 1


def sample_points(n: int, p: int = gf.PRIME) -> list[int]:
    """The n consecutive values that end at p - 1."""
    return list(range(p - n, p))


def evaluate(elements: DataFrame, points: list[int], p: int = gf.PRIME) -> DataFrame:
    """(x, value) of the characteristic polynomial of ``elements`` (element: long) at each point.

    Repeated elements are repeated factors. Each task folds its rows into one product for each point, so
    only points times partitions rows leave the tasks.
    """
    xs = np.array(points, dtype=np.int64)

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.ones(len(xs), dtype=np.int64)
        for part in parts:
            total = total * values_at(part["element"].to_numpy(dtype=np.int64), xs, p) % p
        yield pd.DataFrame({"x": xs, "value": total})

    partial = elements.select(F.col("element").cast("long")).mapInPandas(fold, "x long, value long")
    # The product over nothing is 1, also where an empty table has no task to say so.
    ones = elements.sparkSession.createDataFrame([(x, 1) for x in points], "x long, value long")
    partial = partial.unionByName(ones)
    product = F.aggregate(F.collect_list("value"), F.lit(1).cast("long"), lambda acc, v: gf.mul(acc, v, p))
    return partial.groupBy("x").agg(product.alias("value"))


def values_at(elements: np.ndarray, xs: np.ndarray, p: int = gf.PRIME) -> np.ndarray:
    """The characteristic polynomial of ``elements`` at each of ``xs``."""
    total = np.ones(len(xs), dtype=np.int64)
    for i in range(0, len(elements), 4096):
        factors = (xs[:, None] - elements[None, i : i + 4096]) % p
        while factors.shape[1] > 1:  # halve by pairs: products stay below 2**62
            if factors.shape[1] % 2:
                factors = np.concatenate([factors, np.ones((len(xs), 1), dtype=np.int64)], axis=1)
            factors = factors[:, ::2] * factors[:, 1::2] % p
        total = total * factors[:, 0] % p
    return total


def ratio(a: DataFrame, b: DataFrame, p: int = gf.PRIME) -> DataFrame:
    """(x, value): a's value over b's, point by point."""
    joined = a.join(b.withColumnRenamed("value", "_b"), "x")
    return joined.select("x", gf.divide(F.col("value"), F.col("_b"), p).alias("value"))


def roots_among(elements: DataFrame, coefficients: list[int], p: int = gf.PRIME) -> DataFrame:
    """The ``elements`` where the polynomial vanishes: own candidates are tried, nothing is factored."""
    return elements.where(gf.horner(coefficients, F.col("element"), p) == 0)


#: Most points that are interpolated: elimination on the driver takes their third power.
MOST_POINTS = 600


def difference(a: DataFrame, b: DataFrame, estimate: int, p: int = gf.PRIME) -> DataFrame:
    """(side, element): 1 for elements of a alone, -1 for those of b alone. Sets are made distinct first.

    The values at one point more than interpolation needs verify it; while they don't, the number
    of points doubles. Differences beyond MOST_POINTS go through invertible Bloom filters. Elements must lie below
    the sample points.
    """
    a, b = (stage(x.select("element").distinct(), "elements") for x in (a, b))
    counts = a.count() - b.count()
    n = max(estimate, abs(counts)) + PADDING
    while n <= MOST_POINTS:
        points = sample_points(n + VERIFY, p)
        values = {r["x"]: r["value"] for r in ratio(evaluate(a, points, p), evaluate(b, points, p), p).collect()}
        found = fitted(points, [values[x] for x in points], counts, p)
        if found:
            over, under = found
            return roots_among(a, over, p).withColumn("side", F.lit(1)).unionByName(roots_among(b, under, p).withColumn("side", F.lit(-1)))
        n *= 2
    ids = (x.select(F.col("element").alias("id")) for x in (a, b))
    return ibf.difference(*ids, n).select(F.col("id").alias("element"), "side")


def fitted(points: list[int], values: list[int], difference: int, p: int = gf.PRIME) -> tuple[list[int], list[int]] | None:
    """Numerator and denominator through all values but the last VERIFY, if those agree too."""
    found = gf.rational(points[:-VERIFY], values[:-VERIFY], difference, p)
    checks = zip(points[-VERIFY:], values[-VERIFY:], strict=True)
    if found and all(gf.poly_value(found[0], x, p) == v * gf.poly_value(found[1], x, p) % p for x, v in checks):
        return found
    return None
