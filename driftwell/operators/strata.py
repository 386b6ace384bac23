"""Strata estimator: the size of a difference from 32 small invertible Bloom filters.

An id falls into the stratum of its trailing zero bits, so stratum i samples one id in 2**(i+1).
All strata are one table of cells, built by one aggregation.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions.bits import trailing_zeros
from driftwell.operators import ibf

STRATA, CELLS = 32, 80


def encode(ids: DataFrame, cells: int = CELLS) -> DataFrame:
    """(stratum, cell, cnt, id_sum, hash_sum) of ``ids`` (id). Id 0 belongs to the last stratum."""
    return ibf.build(ids.select(trailing_zeros(F.col("id")).alias("stratum"), "id"), cells, by=("stratum",))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    return ibf.subtract(a, b, by=("stratum",))


def decoded(cells: DataFrame, size: int = CELLS) -> DataFrame:
    """(stratum, plus, minus, done): what each stratum's difference peels to; strata without cells are absent."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        plus, minus, done = ibf.peel(group, size)
        return pd.DataFrame({"stratum": [key[0]], "plus": [len(plus)], "minus": [len(minus)], "done": [done]})

    return cells.groupBy("stratum").applyInPandas(run, "stratum int, plus long, minus long, done boolean")


def estimate(a: DataFrame, b: DataFrame, signed: bool = True) -> int:
    """Estimated size of the difference of two encoded tables, from the sparsest stratum down: ids
    counted until a stratum does not decode, scaled up by the share sampled so far.

    ``signed`` counts a's own ids less b's, which is the net growth (modified rows cancel); otherwise
    both sides count, as in the published estimator.
    """
    rows = {r["stratum"]: r for r in decoded(subtract(a, b)).collect()}  # at most STRATA rows
    total = 0
    for i in range(STRATA - 1, -1, -1):
        row = rows.get(i)
        if row is None:
            continue
        if not row["done"]:
            return 2 ** (i + 1) * total
        total += row["plus"] - row["minus"] if signed else row["plus"] + row["minus"]
    return total
