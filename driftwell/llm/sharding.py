"""Sharding along a Hilbert curve over document metadata.

Language, source and size are quantised to a few bits each; the cell's place on the
Hilbert curve orders the rows, and the order is cut into runs of equal row counts. Neighbouring
cells stay together, so a shard covers a small box in every dimension and ``zone_map`` prunes
shards on any of them. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, with_ranks

SHARDS = 24
#: Bits of each dimension.
BITS = 5


def hilbert_index(dims: list[Column], bits: int) -> list[tuple[str, Column]]:
    """Named steps that lead from ``dims`` (each below 2**bits) to the curve index, the last step.

    Gray-code descent bit by bit, most significant first: reflect or swap the lower bits of the
    axes as the current octant asks, undo the Gray code, then interleave the bits.
    Steps are applied one projection at a time so that expressions stay small.
    """
    n = len(dims)
    steps: list[tuple[str, Column]] = [(f"_x{i}", d.cast("int")) for i, d in enumerate(dims)]
    bit = 1 << (bits - 1)
    while bit > 1:
        low = F.lit(bit - 1)
        for i in range(n):
            here = F.col(f"_x{i}").bitwiseAND(F.lit(bit)) != 0
            swap = F.when(here, F.lit(0)).otherwise(F.col("_x0").bitwiseXOR(F.col(f"_x{i}")).bitwiseAND(low))
            steps.append(("_t", swap))
            first = F.when(here, F.col("_x0").bitwiseXOR(low)).otherwise(F.col("_x0").bitwiseXOR(F.col("_t")))
            steps.append(("_x0", first))
            if i:
                steps.append((f"_x{i}", F.col(f"_x{i}").bitwiseXOR(F.col("_t"))))
        bit >>= 1
    for i in range(1, n):
        steps.append((f"_x{i}", F.col(f"_x{i}").bitwiseXOR(F.col(f"_x{i - 1}"))))
    steps.append(("_t", F.lit(0)))
    bit = 1 << (bits - 1)
    while bit > 1:
        steps.append(("_t", F.when(F.col(f"_x{n - 1}").bitwiseAND(F.lit(bit)) != 0, F.col("_t").bitwiseXOR(F.lit(bit - 1))).otherwise(F.col("_t"))))
        bit >>= 1
    for i in range(n):
        steps.append((f"_x{i}", F.col(f"_x{i}").bitwiseXOR(F.col("_t"))))
    index = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index * 2 + F.shiftright(F.col(f"_x{i}"), b).bitwiseAND(F.lit(1)).cast("long")
    steps.append(("curve", index))
    return steps


def _level(column: Column, bits: int) -> Column:
    """A number's place on a logarithmic scale, in ``bits`` bits, one step a doubling: 5 bits reach 2 GB. Null is 0."""
    scaled = F.floor(F.log2(F.greatest(F.coalesce(column, F.lit(0)), F.lit(0)) + 1))
    return F.least(scaled, F.lit((1 << bits) - 1)).cast("int")


def _bucket(column: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(column, F.lit(""))), F.lit(1 << bits)).cast("int")


def curve_keys(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, same (a hash of the text), dimensions and curve index of each row."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8
    out = docs.select(
        "doc_id",
        size.alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("same"),
        _bucket(F.col("lang"), bits).alias("d_lang"),
        _bucket(F.col("source"), bits).alias("d_source"),
        _level(size, bits).alias("d_size"),
    )
    for name, column in hilbert_index([F.col("d_lang"), F.col("d_source"), F.col("d_size")], bits):
        out = out.withColumn(name, column)
    return out.select("doc_id", "size", "text_crc32", "same", "d_lang", "d_source", "d_size", "curve")


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """Each row's shard and slot under the law ``rows``: shards differ by one row at most.

    Rows sort by curve index, then by text hash, so that equal texts lie side by side and a group
    of copies of any size is cut like anything else, then by doc_id (nulls first). Repeated rows
    take a slot each. Null metadata and texts count as empty. With fewer rows than shards some
    shards stay empty; an empty table gives an empty result. ``grown_shard`` is null: it belongs to
    another law.
    """
    order = [F.col(c) for c in ("curve", "same", "doc_id", "size")]
    ranked = with_ranks(curve_keys(docs, bits), order, "curve")
    low, more = divmod(ranked.count(), shards)  # the first ``more`` shards hold one row more
    wide = more * (low + 1)
    rank, past = F.col("rank"), F.col("rank") - wide
    in_wide = rank < wide
    shard = F.when(in_wide, F.floor(rank / F.lit(low + 1))).otherwise(more + F.floor(past / F.lit(max(low, 1))))
    slot = F.when(in_wide, F.pmod(rank, F.lit(low + 1))).otherwise(F.pmod(past, F.lit(max(low, 1))))
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"),
        slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        "d_lang", "d_source", "d_size", "curve",
    )


def zone_map(assigned: DataFrame) -> DataFrame:
    """Least and greatest value of every dimension in each shard, for pruning shards by predicate."""
    dims = ("d_lang", "d_source", "d_size", "doc_id")
    return assigned.groupBy("shard").agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes"),
        *[f(c).alias(f"{n}_{c}") for c in dims for n, f in (("min", F.min), ("max", F.max))],
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, max_rows: int = 500_000) -> DataFrame:
    """Write ``docs`` with their shard as a Parquet table partitioned by shard; returns the zone map.

    Repeated doc_ids share the shard of one of their rows. The table's column ``shard`` takes the place of one of
    that name.
    """
    assigned = hilbert_shards(docs, shards)
    place = assigned.groupBy(F.col("doc_id").alias("id")).agg(F.min("shard").alias("at"))
    names = [c for c in docs.columns if c != "shard"]
    rows = docs.select(F.struct(*names).alias("row")).join(place, F.col("row.doc_id").eqNullSafe(F.col("id"))).select("row.*", F.col("at").alias("shard"))
    rows.write.partitionBy("shard").option("maxRecordsPerFile", max_rows).parquet(path)
    return zone_map(assigned)


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(documents(spark, sf_dir))
