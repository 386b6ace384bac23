"""Deltas between an old and a new version of documents, and patches that rebuild the new one.

A variable-chunk delta refers to content-defined chunks of the old version by hash. A fixed-block
delta slides over the new version for blocks of the old one. References carry the hash, literals
their bytes; both keep the order of the new version.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions.hashing import murmur32_udf
from driftwell.operators import chunking

BLOCK = 2048


def variable_delta(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, seq, hash, data) from two chunk tables: data where no old chunk of the document has the hash, else null."""
    known = old.select(key, "hash").distinct().withColumn("_known", F.lit(True))
    joined = new.join(known, [key, "hash"], "left")
    return joined.select(key, "seq", "hash", F.when(F.col("_known").isNull(), F.col("chunk")).alias("data"))


def apply_variable(old: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """(key, data) rebuilt: a reference is the first old chunk with its hash."""
    first = old.groupBy(key, "hash").agg(F.min_by("chunk", "seq").alias("_old"))
    pieces = delta.join(first, [key, "hash"], "left").select(key, "seq", F.coalesce("data", "_old").alias("piece"))
    return _joined(pieces, key)


def _joined(pieces: DataFrame, key: str) -> DataFrame:
    """Pieces in order as one value. A document's pieces together are that one value, so they fit where it does."""
    return pieces.groupBy(key).agg(F.expr("listagg(piece) WITHIN GROUP (ORDER BY seq)").alias("data"))


_STEPS = T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("len", T.LongType()), T.StructField("block", T.LongType())]))


def scan_blocks(block: int = BLOCK) -> Column:
    """UDF (new, old) -> array of (pos, len, block): references to old blocks by number, and runs of literals (block null).

    Weak hashes of every window of the new version come from prefix sums; only windows whose weak hash
    an old block has are compared, byte by byte, so that a reference is never wrong.
    """

    @F.pandas_udf(_STEPS)
    def run(new: pd.Series, old: pd.Series) -> pd.Series:
        out = []
        for n, o in zip(new, old, strict=True):
            out.append(_scan(bytes(n or b""), bytes(o or b""), block))
        return pd.Series(out)

    return run


def _scan(new: bytes, old: bytes, block: int) -> list[dict]:
    steps: list[dict] = []

    def literal(lo: int, hi: int) -> None:
        if hi > lo:
            steps.append({"pos": lo, "len": hi - lo, "block": None})

    blocks: dict[bytes, int] = {}
    for i in range(len(old) // block):
        blocks.setdefault(old[i * block : (i + 1) * block], i)
    begin = at = 0
    if blocks and len(new) >= block:
        weak = chunking.rolling_adler(np.frombuffer(new, dtype=np.uint8), block)[: len(new) - block + 1]
        own = {int(chunking.rolling_adler(np.frombuffer(b, dtype=np.uint8), block)[0]) for b in blocks}
        for p in np.flatnonzero(np.isin(weak, list(own))).tolist():
            if p >= at and (found := blocks.get(new[p : p + block])) is not None:
                literal(begin, p)
                steps.append({"pos": p, "len": block, "block": found})
                begin = at = p + block
    literal(begin, len(new))
    return steps


def fixed_delta(pairs: DataFrame, key: str, new: str, old: str, block: int = BLOCK) -> DataFrame:
    """(key, seq, pos, hash, block, data) of ``pairs`` of versions: a reference has the hash and number of an old
    block, a literal its bytes. An exact last block may be a reference; a short tail of the old version is none."""
    steps = pairs.select(key, new, F.posexplode(scan_blocks(block)(F.col(new), F.col(old))).alias("seq", "s"))
    piece = F.substring(new, (F.col("s.pos") + 1).cast("int"), F.col("s.len").cast("int"))
    is_ref = F.col("s.block").isNotNull()
    out = steps.select(key, "seq", F.col("s.pos").alias("pos"), F.col("s.block").alias("block"), piece.alias("_piece"), is_ref.alias("_ref"))
    return out.select(
        key, "seq", "pos", F.when(F.col("_ref"), murmur32_udf("_piece")).alias("hash"), "block", F.when(~F.col("_ref"), F.col("_piece")).alias("data")
    )


def old_blocks(rows: DataFrame, key: str, data: str, block: int = BLOCK) -> DataFrame:
    """(key, block, chunk): the whole blocks of each document."""
    count = F.floor(F.octet_length(data) / block).cast("int")
    at = rows.where(count > 0).select(key, data, F.explode(F.sequence(F.lit(0), count - 1)).alias("block"))
    return at.select(key, F.col("block").cast("long").alias("block"), F.substring(data, F.col("block") * block + 1, F.lit(block)).alias("chunk"))


def apply_fixed(delta: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """(key, data) rebuilt from a delta and the blocks of the old version."""
    joined = delta.join(blocks.withColumnRenamed("chunk", "_old"), [key, "block"], "left")
    return _joined(joined.select(key, "seq", F.coalesce("data", "_old").alias("piece")), key)


def missing_hashes(delta: DataFrame, blocks: DataFrame, key: str) -> DataFrame:
    """References whose hash no old block has; none for deltas of ``fixed_delta``, which compares bytes."""
    known = blocks.select(key, murmur32_udf("chunk").alias("hash")).distinct()
    return delta.where("hash IS NOT NULL").join(known, [key, "hash"], "left_anti")


def size(delta: DataFrame, reference: int = 4, per_literal: int = 0) -> DataFrame:
    """One row (bytes): ``reference`` bytes a reference; literals their length, 4 and ``per_literal`` more. For
    fixed-block deltas a reference is 8 bytes."""
    cost = F.when(F.col("data").isNull(), F.lit(reference)).otherwise(F.octet_length("data") + 4 + per_literal)
    return delta.agg(F.coalesce(F.sum(cost), F.lit(0)).cast("long").alias("bytes"))

