"""Syncing files (or any binary values by key) from an old to a new version by their chunks or blocks.

Variable chunks: the new side sends a Bloom filter of its chunk hashes; the old side estimates from it how
many chunks differ and sends the values of its characteristic polynomial at so many points; the new side
divides, interpolates and finds which of its own chunks the old side lacks; the delta has those as
literals and the others as references. The exchange works on a few bits of each chunk's digest; where two chunks of a
file share those, it is repeated with other bits, and at last with the digests themselves. Fixed blocks: the old side sends a Bloom filter of its blocks, the new
side answers with references to blocks and literals. Keys that only one side has are skipped.

What crosses between the sides is small and belongs to one file, so each file's exchange is one call of a vectorised
function over its hashes; chunks and bytes stay in tables.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions import gf
from driftwell.functions.hashing import murmur32_bytes
from driftwell.operators import bloom, charpoly, chunking, delta
from driftwell.staging import stage

#: Bytes of a chunk's digest, which tells chunks apart, and bits of it that an exchange uses, so that all elements lie
#: below the sample points. Each further exchange starts STEP bytes on.
DIGEST, HASH_BITS, STEP = 16, 28, 4
#: Points up to which a file's polynomial is interpolated; beyond, the hashes themselves are sent.
MOST_POINTS = 256

_EXCHANGE = T.StructType([
    T.StructField("missing", T.ArrayType(T.BinaryType())), T.StructField("estimate", T.LongType()),
    T.StructField("bloom_bytes", T.LongType()), T.StructField("polynomial_bytes", T.LongType()),
])


def _bits(hashes: np.ndarray, size: int) -> np.ndarray:
    """Positions of each hash (as 4 bytes) in a filter of ``size`` bits, one row for each seed."""
    raw = hashes.astype("<u4").tobytes()
    values = [raw[i : i + 4] for i in range(0, len(raw), 4)]
    return np.stack([murmur32_bytes(values, s).astype(np.int64) % size for s in range(bloom.DEFAULT_HASHES)])


def exchange(old: np.ndarray, new: np.ndarray) -> tuple[list[int], int, int, int]:
    """Hashes of ``new`` that ``old`` lacks (both distinct), the first estimate of the difference, and the bytes of
    the filter and of all polynomial values that were sent."""
    size = bloom.rounded(bloom.CHUNK_BITS * len(new))
    filter_bytes = size // 8 + 4
    hits, rate = 0, 0.0
    if size:
        bitmap = np.zeros(size, dtype=bool)
        bitmap[_bits(new, size).ravel()] = True
        hits = int(bitmap[_bits(old, size)].all(axis=0).sum()) if len(old) else 0
        rate = (1 - (1 - 1 / size) ** (bloom.DEFAULT_HASHES * len(new))) ** bloom.DEFAULT_HASHES
    estimate = ceil(len(new) - len(old) + 2 * (len(old) - hits) / (1 - rate)) + charpoly.PADDING
    counts = len(new) - len(old)
    n, sent = max(estimate, abs(counts) + charpoly.PADDING), 0
    while n <= MOST_POINTS:
        points = charpoly.sample_points(n + charpoly.VERIFY)
        xs = np.array(points, dtype=np.int64)
        over, under = charpoly.values_at(new, xs), charpoly.values_at(old, xs)
        sent += 4 * len(points) + 4
        found = charpoly.fitted(points, [int(a) * pow(int(b), -1, gf.PRIME) % gf.PRIME for a, b in zip(over, under, strict=True)], counts)
        if found:
            return [int(h) for h in new if not gf.poly_value(found[0], int(h))], estimate, filter_bytes, sent
        n *= 2
    return np.setdiff1d(new, old).tolist(), estimate, filter_bytes, sent + 4 * len(old)


def exchange_digests(old: list[bytes], new: list[bytes], bits: int = HASH_BITS) -> tuple[list[bytes], int, int, int]:
    """As ``exchange``, of digests (distinct on each side), whatever bits they share; the figures are those of the exchange that counts.

    A side sees by itself that two of its chunks share their bits, and a file that comes out with another digest than the
    new version's shows that a chunk of each side do. Both mean that the next bits are taken.
    """
    both = {*old, *new}
    for at in range(0, DIGEST, STEP):
        short = {d: int.from_bytes(d[at : at + STEP], "little") & ((1 << bits) - 1) for d in both}
        if len(set(short.values())) == len(both):
            sides = (np.sort(np.array([short[d] for d in side], dtype=np.int64)) for side in (old, new))
            found, *figures = exchange(*sides)
            lacking = set(found)
            return [d for d in new if short[d] in lacking], *figures
    known = set(old)
    found = [d for d in new if d not in known]
    return found, len(new) - len(old) + 2 * len(known.difference(new)), bloom.rounded(bloom.CHUNK_BITS * len(new)) // 8 + 4, DIGEST * len(old)


@F.pandas_udf(_EXCHANGE)
def _exchanged(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([exchange_digests(list(a), list(b)) for a, b in zip(old, new, strict=True)], columns=_EXCHANGE.names)


def sync_variable(old: DataFrame, new: DataFrame, key: str, data: str, half: int = chunking.HALF_WIDTH) -> DataFrame:
    """(key, data, estimate, bloom_bytes, polynomial_bytes, refs, literals, literal_bytes) of every key of both sides:
    the new version rebuilt on the old side, and what it took. An empty new version is rebuilt as empty."""
    both = stage(old.select(key, F.col(data).alias("_o")).join(new.select(key, F.col(data).alias("_n")), key), "versions")
    digest = F.unhex(F.substring(F.sha2("chunk", 256), 1, 2 * DIGEST)).alias("hash")
    a, b = (
        stage(chunking.chunks(both.select(key, F.col(c).alias("data")), key, "data", half=half, hashed=False).select(key, "seq", "chunk", digest), "chunks")
        for c in ("_o", "_n")
    )
    own = lambda chunks, name: chunks.groupBy(key).agg(F.array_sort(F.collect_set("hash")).alias(name))
    none = F.array().cast("array<binary>")
    sides = both.select(key).join(own(a, "a"), key, "left").join(own(b, "b"), key, "left")
    talks = stage(sides.select(key, _exchanged(F.coalesce("a", none), F.coalesce("b", none)).alias("t")).select(key, "t.*"), "exchange")
    missing = talks.select(key, F.explode("missing").alias("hash")).withColumn("_new", F.lit(True))
    literal = F.when(F.col("_new"), F.col("chunk"))
    steps = stage(b.join(missing, [key, "hash"], "left").select(key, "seq", "hash", literal.alias("data")), "delta")
    rebuilt = delta.apply_variable(a, steps, key)
    counts = steps.groupBy(key).agg(
        F.count_if(F.col("data").isNull()).alias("refs"), F.count_if(F.col("data").isNotNull()).alias("literals"),
        F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).cast("long").alias("literal_bytes"),
    )
    out = talks.drop("missing").join(rebuilt, key, "left").join(counts, key, "left")
    zero = F.lit(0).cast("long")
    return out.select(
        key, F.coalesce("data", F.lit(b"")).alias("data"), "estimate", "bloom_bytes", "polynomial_bytes",
        *[F.coalesce(c, zero).alias(c) for c in ("refs", "literals", "literal_bytes")],
    )


def sync_fixed(old: DataFrame, new: DataFrame, key: str, data: str, block: int = delta.BLOCK) -> DataFrame:
    """(key, data, bloom_bytes, refs, literal_bytes) of every key of both sides, by blocks of ``block`` bytes."""
    both = stage(old.select(key, F.col(data).alias("old")).join(new.select(key, F.col(data).alias("new")), key), "versions")
    steps = stage(delta.fixed_delta(both, key, "new", "old", block), "delta")
    rebuilt = delta.apply_fixed(steps, delta.old_blocks(both, key, "old", block), key)
    counts = steps.groupBy(key).agg(
        F.count_if(F.col("block").isNotNull()).alias("refs"), F.coalesce(F.sum(F.octet_length("data")), F.lit(0)).cast("long").alias("literal_bytes")
    )
    bits = bloom.BLOCK_BITS * F.floor(F.octet_length("old") / block)
    out = both.select(key, (F.ceil(bits / 8) + 4).cast("long").alias("bloom_bytes")).join(rebuilt, key, "left").join(counts, key, "left")
    zero = F.lit(0).cast("long")
    return out.select(key, F.coalesce("data", F.lit(b"")).alias("data"), "bloom_bytes", *[F.coalesce(c, zero).alias(c) for c in ("refs", "literal_bytes")])
