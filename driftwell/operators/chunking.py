"""Content-defined chunking: rolling hash, local maxima, chunks and their hashes.

A document's bytes are one value, so each step is a vector computation over one row, run in Arrow
batches; documents are independent and spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwell.functions.hashing import murmur32_bytes

#: Window of the rolling hash, half-width of the maxima, and the offset added to each byte.
WINDOW, HALF_WIDTH, CHAR_OFFSET = 16, 32 * 1024, 31

_LONGS = T.ArrayType(T.LongType())


def rolling_adler(data: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """At each byte, the two-sum checksum of the window that starts there; past the end come zero bytes."""
    c = np.concatenate([data.astype(np.int64), np.zeros(window, dtype=np.int64)]) + CHAR_OFFSET
    n = len(data)
    plain = np.concatenate([[0], np.cumsum(c)])
    placed = np.concatenate([[0], np.cumsum(c * np.arange(len(c)))])
    at = np.arange(n)
    s1 = plain[at + window] - plain[at]
    s2 = (at + window) * s1 - (placed[at + window] - placed[at])
    return s1 % 65536 + (s2 % 65536 << 16)


def rolling_u32(data: np.ndarray) -> np.ndarray:
    """At each byte, the little-endian value of four bytes from there, zero-padded."""
    padded = np.concatenate([data, np.zeros(3, dtype=np.uint8)]).astype(np.int64)
    n = len(data)
    return padded[:n] | padded[1 : n + 1] << 8 | padded[2 : n + 2] << 16 | padded[3 : n + 3] << 24


def local_maxima(values: np.ndarray, half: int = HALF_WIDTH) -> np.ndarray:
    """Positions whose value is strictly greater than all others within ``half`` to either side.

    Running maxima over windows of ``half`` by doubling: linear in the values for any half-width.
    """
    n = len(values)
    if not n:
        return np.zeros(0, dtype=np.int64)
    low = np.int64(-1)
    half = min(half, n)
    padded = np.concatenate([np.full(half, low), values, np.full(half, low)])
    span, best = 1, padded
    while span * 2 <= half:
        best = np.maximum(best[:-span], best[span:])
        span *= 2
    over = np.maximum(best[: len(padded) - half + 1], best[half - span : half - span + len(padded) - half + 1])
    return np.flatnonzero((values > over[:n]) & (values > over[half + 1 : half + 1 + n]))


def modulo_boundaries(values: np.ndarray, modulus: int = 1024) -> np.ndarray:
    return np.flatnonzero(values % modulus == 0)


def _per_row(function) -> Column:
    @F.pandas_udf(_LONGS)
    def run(values: pd.Series) -> pd.Series:
        empty = np.zeros(0, dtype=np.int64)
        return pd.Series([empty if v is None else function(np.frombuffer(bytes(v), dtype=np.uint8)) for v in values])

    return run


def rolling_hashes(data: Column, window: int = WINDOW) -> Column:
    """Array of the rolling hash at each byte of a binary column."""
    return _per_row(lambda d: rolling_adler(d, window))(data)


def rolling_values(data: Column) -> Column:
    return _per_row(rolling_u32)(data)


def boundaries(data: Column, window: int = WINDOW, half: int = HALF_WIDTH) -> Column:
    """Array of the last position of each chunk but the tail: local maxima of the rolling hash."""
    return _per_row(lambda d: local_maxima(rolling_adler(d, window), half))(data)


def maxima_of(values: Column, half: int) -> Column:
    """Local maxima of an array column of non-negative values."""

    @F.pandas_udf(_LONGS)
    def run(rows: pd.Series) -> pd.Series:
        return pd.Series([local_maxima(np.asarray(v, dtype=np.int64), half) for v in rows])

    return run(values)


def cut(rows: DataFrame, key: str, data: str, edges: Column) -> DataFrame:
    """(key, seq, pos, len, chunk): from behind the previous boundary up to and with each one, then the tail.

    Null and empty values and null ``edges`` give no chunks.
    """
    return _cut(rows.select(key, F.col(data).cast("binary"), edges.cast(_LONGS).alias("_edges")), None, False)


def chunks(rows: DataFrame, key: str, data: str, window: int = WINDOW, half: int = HALF_WIDTH, hashed: bool = True) -> DataFrame:
    """(key, seq, pos, len, chunk, hash) of every document of ``rows`` by content; no ``hash`` where it is not wanted."""
    return _cut(rows.select(key, F.col(data).cast("binary")), lambda d: local_maxima(rolling_adler(d, window), half), hashed)


def _cut(rows: DataFrame, edges_of: Callable[[np.ndarray], np.ndarray] | None, hashed: bool) -> DataFrame:
    """Chunks of ``rows`` (key, data, and edges unless ``edges_of`` finds them). A value goes to Python once and
    its chunks come back, so the work is linear in its bytes; a row for each chunk that carried the value would not be."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, seq, pos, size, pieces = [], [], [], [], []
            for i in range(batch.num_rows):
                value = batch.column(1)[i].as_py()
                if not value or (edges_of is None and not batch.column(2)[i].is_valid):
                    continue
                edges = edges_of(np.frombuffer(value, dtype=np.uint8)) if edges_of else batch.column(2)[i].values.to_numpy()
                ends = np.unique(np.append(edges + 1, len(value)))
                begins = np.concatenate([[0], ends[:-1]])
                row.append(np.full(len(ends), i))
                seq.append(np.arange(len(ends), dtype=np.int32))
                pos.append(begins)
                size.append(ends - begins)
                pieces += [value[a:b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            if not row:
                continue
            columns = [batch.column(0).take(pa.array(np.concatenate(row))), pa.array(np.concatenate(seq))]
            columns += [pa.array(np.concatenate(x).astype(np.int64)) for x in (pos, size)] + [pa.array(pieces, pa.binary())]
            if hashed:
                columns.append(pa.array(murmur32_bytes(pieces).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "seq", "pos", "len", "chunk", "hash"][: len(columns)])

    out = T.StructType([T.StructField("key", rows.schema[0].dataType)]).add("seq", T.IntegerType()).add("pos", T.LongType())
    out = out.add("len", T.LongType()).add("chunk", T.BinaryType())
    return rows.mapInArrow(run, out.add("hash", T.LongType()) if hashed else out).withColumnRenamed("key", rows.columns[0])
