"""An invertible Bloom filter of a stream of changes.

Cells only ever add up, so a running aggregation by cell is the whole state: its size is that of the
filter, not of the data, and it needs no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from driftwell.functions.hashing import CHECK_SEED, murmur32
from driftwell.operators.ibf import HASHES


def live_cells(changes: DataFrame, size: int, hashes: int = HASHES) -> DataFrame:
    """Cells of a streaming table of changes (id: long, weight: 1 for an insert, -1 for a delete)."""
    cells = F.array(*[F.pmod(murmur32("id", s), F.lit(size).cast("long")).cast("int") for s in range(hashes)])
    rows = changes.select("id", "weight", murmur32("id", CHECK_SEED).alias("check"), F.explode(cells).alias("cell"))
    return rows.groupBy("cell").agg(
        F.sum("weight").cast("long").alias("cnt"), F.expr("bit_xor(id)").alias("id_sum"), F.expr("bit_xor(check)").alias("hash_sum")
    )


def maintain(changes: DataFrame, size: int, name: str, checkpoint: str) -> StreamingQuery:
    """Run ``live_cells`` into the in-memory table ``name``, complete at every trigger."""
    return (
        live_cells(changes, size).writeStream.outputMode("complete").format("memory").queryName(name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
