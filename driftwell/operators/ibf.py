"""Invertible Bloom filters as tables of cells.

A filter is (cell, cnt, id_sum, hash_sum), one row for each cell that something fell into. Cells add
up, so building is one aggregation (partial on the map side), and merging and subtracting are a union
and the same aggregation. Every function takes further grouping columns (``by``), which is how
all strata of an estimator are built at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.functions.hashing import CHECK_SEED, murmur32, murmur32_bytes
from driftwell.staging import drop, stage

HASHES = 3
#: Cells for each estimated difference.
CELLS_PER_DIFFERENCE = 2
#: Cells that one task decodes; beyond, decoding runs as rounds of DataFrame operations.
ONE_TASK = 1 << 18
#: Most rounds of a decode across the cluster, and the side of the row that says that cells are left.
MOST_ROUNDS, STUCK = 100, 0


def build(ids: DataFrame, size: int, hashes: int = HASHES, by: tuple[str, ...] = (), weight: int = 1, times: str | None = None) -> DataFrame:
    """Cells of ``ids`` (id: long). Seeds may fall on one cell twice; both count. ``weight`` -1 removes. A row counts
    as often as its column ``times`` says, once without one."""
    cells = F.array(*[F.pmod(murmur32("id", s), F.lit(size).cast("long")).cast("int") for s in range(hashes)])
    rows = ids.select(*by, "id", murmur32("id", CHECK_SEED).alias("check"), F.explode(cells).alias("cell"), *[F.col(x).alias("_times") for x in (times,) if x])
    if times:  # what falls into a cell an even number of times leaves no trace in its sums
        odd = F.col("_times") % 2
        sums = [F.sum("_times"), F.bit_xor(F.col("id") * odd), F.bit_xor(F.col("check") * odd)]
    else:
        sums = [F.count("*"), F.bit_xor("id"), F.bit_xor("check")]
    return rows.groupBy(*by, "cell").agg((sums[0] * weight).alias("cnt"), sums[1].alias("id_sum"), sums[2].alias("hash_sum"))


def subtract(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Cells of a minus b (of equal size), without those that come out empty."""
    both = a.unionByName(b.withColumn("cnt", -F.col("cnt")))
    out = both.groupBy(*by, "cell").agg(
        F.sum("cnt").alias("cnt"), F.expr("bit_xor(id_sum)").alias("id_sum"), F.expr("bit_xor(hash_sum)").alias("hash_sum")
    )
    return out.where("cnt <> 0 OR id_sum <> 0 OR hash_sum <> 0")


def merge(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return subtract(a, b.withColumn("cnt", -F.col("cnt")), by)


def contains(ids: DataFrame, cells: DataFrame, size: int, hashes: int = HASHES) -> DataFrame:
    """``ids`` (id) with ``maybe``: none of its cells counts 0. A weak test, as cells may cancel."""
    at = F.explode(F.array(*[F.pmod(murmur32("id", s), F.lit(size).cast("long")).cast("int") for s in range(hashes)]))
    probes = ids.select("id").distinct().select("id", at.alias("cell")).join(cells, "cell", "left")
    return probes.groupBy("id").agg((F.min(F.coalesce(F.abs("cnt"), F.lit(0))) > 0).alias("maybe"))


def _hash_longs(ids: np.ndarray, seed: int) -> np.ndarray:
    raw = ids.astype("<i8").tobytes()
    return murmur32_bytes([raw[i : i + 8] for i in range(0, len(raw), 8)], seed).astype(np.int64)


def peel(cells: pd.DataFrame, size: int, hashes: int = HASHES) -> tuple[np.ndarray, np.ndarray, bool]:
    """Ids of the minuend alone, of the subtrahend alone, and whether all cells came out empty.

    A cell with count 1 or -1 whose id has the cell's hash holds one id. All of those leave at once, and
    what they uncover leaves in the next round. Two seeds of one id on one cell can make an id look as if it were on
    the other side; it then leaves more than once, so what counts is the sum of its signs.
    """
    cnt, ids, sums = (np.zeros(size, dtype=np.int64) for _ in range(3))
    at = cells["cell"].to_numpy()
    cnt[at], ids[at], sums[at] = cells["cnt"], cells["id_sum"], cells["hash_sum"]
    out, signs = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    look = np.flatnonzero(np.abs(cnt) == 1)
    while len(look):
        pure = look[_hash_longs(ids[look], CHECK_SEED) == sums[look]]
        found, first = np.unique(ids[pure], return_index=True)
        if not len(found):
            break
        sign, check = cnt[pure][first], sums[pure][first]
        out.append(found)
        signs.append(sign)
        touched = []
        for s in range(hashes):
            cell = _hash_longs(found, s) % size
            np.subtract.at(cnt, cell, sign)
            np.bitwise_xor.at(ids, cell, found)
            np.bitwise_xor.at(sums, cell, check)
            touched.append(cell)
        look = np.unique(np.concatenate(touched))
        look = look[np.abs(cnt[look]) == 1]
    done = not (cnt.any() or ids.any() or sums.any())
    found, of = np.unique(np.concatenate(out), return_inverse=True)
    net = np.bincount(of, weights=np.concatenate(signs), minlength=len(found))
    return found[net > 0], found[net < 0], done


def decode(cells: DataFrame, size: int, hashes: int = HASHES) -> DataFrame:
    """(side, id): 1 for ids of the minuend alone, -1 for those of the subtrahend alone.

    Filters hold a few cells for each difference, not for each row; up to ONE_TASK cells are peeled by one task,
    larger ones in rounds across the cluster. Reading the result raises (an error that names a failed
    decode) where peeling gets stuck.
    """
    failed = F.raise_error(F.lit(f"decoding failed with {size} cells"))
    return _peeled(cells, size, hashes).withColumn("side", F.when(F.col("side") == STUCK, failed.cast("int")).otherwise(F.col("side")))


def _peeled(cells: DataFrame, size: int, hashes: int) -> DataFrame:
    """As ``decode``, but where cells are left there is one more row, whose side is STUCK."""
    if size > ONE_TASK:
        return _decode_rounds(cells, size, hashes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(list(parts) or [pd.DataFrame({c: [] for c in ("cell", "cnt", "id_sum", "hash_sum")}, dtype="int64")])
        plus, minus, done = peel(whole, size, hashes)
        sides = np.repeat([1, -1, STUCK], [len(plus), len(minus), 0 if done else 1]).astype(np.int32)
        yield pd.DataFrame({"side": sides, "id": np.concatenate([plus, minus, np.zeros(0 if done else 1, dtype=np.int64)])})

    return cells.select("cell", "cnt", "id_sum", "hash_sum").repartition(1).mapInPandas(run, "side int, id long")


def _decode_rounds(cells: DataFrame, size: int, hashes: int) -> DataFrame:
    """Peeling as rounds of filter, explode, union and aggregate; their number is about log of the cells. A cell that
    looks pure by chance can come and go, so rounds end at MOST_ROUNDS."""
    now, found = stage(cells, "cells"), None
    for _ in range(MOST_ROUNDS):
        pure = now.where((F.abs("cnt") == 1) & (murmur32("id_sum", CHECK_SEED) == F.col("hash_sum")))
        new = stage(pure.groupBy(F.col("id_sum").alias("id")).agg(F.first("cnt").cast("int").alias("side")), "peeled")
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        plus, minus = (build(new.where(F.col("side") == s).select("id"), size, hashes) for s in (1, -1))
        before, now = now, stage(subtract(merge(now, minus), plus), "cells")
        drop(before)
    spark = cells.sparkSession
    out = spark.createDataFrame([], "side int, id long")
    if found is not None:
        net = found.groupBy("id").agg(F.sum("side").alias("net")).where("net <> 0")
        out = net.select(F.signum("net").cast("int").alias("side"), "id")
    left = spark.createDataFrame([(STUCK, 0)] if not now.isEmpty() else [], "side int, id long")
    drop(now)
    return out.unionByName(left)


def difference(a: DataFrame, b: DataFrame, estimate: int, hashes: int = HASHES, attempts: int = 6) -> DataFrame:
    """(side, id) of two id tables, from filters of 2 * ``estimate`` cells, doubled while they don't decode.

    After ``attempts`` filters the difference is taken exactly, by anti joins of the tables themselves. Sets are made
    distinct first: an id that one side holds twice would be found on the side that holds it more often.
    """
    a, b = (stage(x.select("id").distinct(), "ids") for x in (a, b))
    size = max(CELLS_PER_DIFFERENCE * estimate, 8)
    for _ in range(attempts):
        found = stage(_peeled(subtract(build(a, size, hashes), build(b, size, hashes)), size, hashes), "difference")
        if found.where(F.col("side") == STUCK).isEmpty():
            break
        drop(found)
        size *= 2
    else:
        plus = a.subtract(b).select(F.lit(1).alias("side"), "id")
        found = stage(plus.unionByName(b.subtract(a).select(F.lit(-1).alias("side"), "id")), "difference")
    drop(a, b)
    return found
