"""Bloom filters as tables of set bits.

A filter is (bit: long), one row for each set bit, beside its size and the number of adds. Building
is one distinct over exploded positions, combined on the map side; merging is a union and a distinct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.hashing import murmur32
from driftwell.staging import stage

DEFAULT_HASHES = 5


@dataclass(frozen=True)
class Bloom:
    bits: DataFrame
    size: int
    count: int
    hashes: int = DEFAULT_HASHES

    @property
    def false_positive_rate(self) -> float:
        if not self.size:
            return 0.0
        return (1 - (1 - 1 / self.size) ** (self.hashes * self.count)) ** self.hashes

    @property
    def bytes(self) -> int:
        """Size of the message: the bitmap and a 4-byte count."""
        return self.size // 8 + 4

    def merge(self, other: Bloom) -> Bloom:
        if (self.size, self.hashes) != (other.size, other.hashes):
            raise ValueError("filters differ in size or hashes")
        return Bloom(self.bits.union(other.bits).distinct(), self.size, self.count + other.count, self.hashes)

    def bitmap(self) -> DataFrame:
        """(bucket, bytes hex): the bitmap in pages of 4 KB, least significant bit first."""
        bucket = F.floor(F.col("bit") / 32768)
        at = F.pmod("bit", F.lit(32768)).cast("long")
        return self.bits.groupBy(bucket.alias("bucket")).agg(F.hex(F.bitmap_construct_agg(at)).alias("bytes"))


def rounded(bits: int) -> int:
    """Up to a whole number of bytes."""
    return -(-bits // 8) * 8


def positions(item: Column, size: int, hashes: int = DEFAULT_HASHES) -> Column:
    """The bits of an int, a long or bytes of length divisible by 4; seeds are 0 .. hashes - 1."""
    return F.array(*[F.pmod(murmur32(item, s), F.lit(size).cast("long")) for s in range(hashes)])


def build(items: DataFrame, item: Column, size: int, count: int, hashes: int = DEFAULT_HASHES) -> Bloom:
    """``count`` counts adds, repeated items included; ``size`` must be a multiple of 8."""
    if size % 8:
        raise ValueError("the number of bits must be divisible by 8")
    if not size:
        return Bloom(items.sparkSession.createDataFrame([], "bit long"), 0, count, hashes)
    bits = items.select(F.explode(positions(item, size, hashes)).alias("bit")).distinct()
    return Bloom(bits, size, count, hashes)


#: Bytes of a bitmap up to which it goes to every task; filters beyond are joined.
BROADCAST_BYTES = 8 << 20


def probe(items: DataFrame, item: Column, bloom: Bloom) -> DataFrame:
    """``items`` with ``hit``: whether all bits are set; a filter without bits contains nothing.

    A bitmap of at most BROADCAST_BYTES is one broadcast array of longs, of which an item reads single elements: an
    array is looked into where it lies, while a binary value would be copied whole for every item. Beyond, the
    positions of all items meet the set bits in one join, counted per row by a row id.
    """
    if not bloom.size:
        return items.withColumn("hit", F.lit(False))
    spots = positions(item, bloom.size, bloom.hashes)
    rows = items.select(F.struct(*items.columns).alias("row"), spots.alias("spots"))
    if bloom.size // 8 <= BROADCAST_BYTES:
        whole = _words(bloom).withColumn("one", F.lit(1))
        rows = rows.withColumn("one", F.lit(1)).join(F.broadcast(whole), "one")
        hit = F.lit(True)
        for s in range(bloom.hashes):
            spot = F.col("spots")[s]
            word = F.col("words")[F.shiftright(spot, 6).cast("int")]
            hit = hit & (F.getbit(word, spot.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return rows.select("row.*", hit.alias("hit"))
    spread = rows.withColumn("id", F.monotonically_increasing_id()).select("id", "row", F.explode("spots").alias("bit"))
    met = spread.join(bloom.bits.withColumn("set", F.lit(True)), "bit", "left")
    return met.groupBy("id").agg(F.first("row").alias("row"), F.min(F.coalesce("set", F.lit(False))).alias("hit")).select("row.*", "hit")


def _words(bloom: Bloom) -> DataFrame:
    """One row (words: array of longs) of all bits in order, 64 to a word. Pages of 512 words are put together first,
    so that the one row is made of few parts."""
    own = bloom.bits.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("word"))
    every = bloom.bits.sparkSession.range(-(-bloom.size // 64)).withColumnRenamed("id", "at")
    filled = every.join(own, "at", "left").select("at", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    ordered = lambda rows, value: F.transform(F.sort_array(F.collect_list(F.struct(*rows))), lambda x: x[value])
    pages = filled.groupBy(F.shiftright("at", 9).alias("page")).agg(ordered(("at", "word"), "word").alias("part"))
    return pages.agg(F.flatten(ordered(("page", "part"), "part")).alias("words"))


CHUNK_BITS, BLOCK_BITS = 12, 24


def of_chunks(hashes: DataFrame, h: str = "hash") -> Bloom:
    """A filter of chunk hashes (unsigned 32-bit in a long), added as 4 bytes: 12 bits a chunk."""
    own = stage(hashes.select(F.when(F.col(h) >= 1 << 31, F.col(h) - (1 << 32)).otherwise(F.col(h)).cast("int").alias("h")), "chunks")
    n = own.count()
    return build(own, F.col("h"), rounded(CHUNK_BITS * n), n)


def of_blocks(blocks: DataFrame, block: int, chunk: str = "chunk") -> Bloom:
    """A filter of whole fixed blocks of ``block`` bytes (divisible by 4), added as they are: 24 bits a block."""
    own = blocks.where(F.octet_length(chunk) == block).select(F.col(chunk).alias("b"))
    n = own.count()
    return build(own, F.col("b"), rounded(BLOCK_BITS * n), n)


def estimate_difference(size_a: int, size_b: int, hits: int, false_positive_rate: float) -> int:
    """Differing items of A and B, from how many of B's ``size_b`` items hit the filter of A."""
    from math import ceil

    return ceil(size_a - size_b + 2 * (size_b - hits) / (1 - false_positive_rate))
