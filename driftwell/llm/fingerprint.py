"""Document fingerprints: improbable-feature digests.

Every byte window of a text has an entropy. Windows whose entropy level is rare in the whole
corpus are the most telling: levels are ranked by how seldom they occur, and a window is
selected where its rank is the least of its neighbourhood (ties by a hash of the window, so the
choice depends on content alone). Selected windows go into Bloom filters; a full filter is
closed and chained to a fresh one. Two digests compare by the bits that their filters share
beyond what chance would give.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, documents, in_batches, partitions, with_ranks
from .textvec import _BYTE, _powers, mix

#: Bytes of a window, and how far a selected window's rank is the least on either side.
WINDOW, REACH = 24, 16
#: A text of less than twice SHORT_BYTES has windows of SHORT bytes, one of less than twice TINY_BYTES windows of TINY
#: bytes, all of them selected; the wider kind begins at SHORT_BYTES and TINY_BYTES, so that there are both kinds
#: between. Editing keeps the number of characters and at most doubles or halves the bytes, so a text and its edited
#: text have a kind in common.
SHORT_BYTES, SHORT = 192, 6
TINY_BYTES, TINY = 24, 2
#: Bits and hashes of a filter, and the features after which a new one is chained.
BITS, HASHES, FULL = 2048, 4, 160

_U = np.uint64
_LEVEL = 0.05  # bits of entropy in one level
_COUNT_LOG = np.array([0.0, *(c * np.log2(c) for c in range(1, WINDOW + 1))])
_GAIN = np.round(np.diff(_COUNT_LOG) * 4096).astype(np.int64)  # of one more byte beside c equal ones
LEVELS = int(np.log2(WINDOW) / _LEVEL) + 2


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Entropy level of the window at each position: one pass per offset, no loop over positions."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    # How many of the WINDOW - 1 bytes before, and after, are equal to the byte.
    before = np.zeros(len(data), dtype=np.uint8)
    after = np.zeros(len(data), dtype=np.uint8)
    for k in range(1, WINDOW):
        same = data[k:] == data[:-k]
        before[k:] += same
        after[:-k] += same
    gained = np.cumsum(_GAIN[before])
    lost = np.concatenate([[0], np.cumsum(_GAIN[after[: n - 1]])])
    # The first windows of a text gain over what there is, so the sums start alike.
    total = (gained[WINDOW - 1 :] - lost) / 4096
    entropy = np.log2(WINDOW) - total / WINDOW
    return np.clip((entropy / _LEVEL).astype(np.int64), 0, LEVELS - 1)


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    forward, backward = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * forward[: len(data)], out=sums[1:])
    n = len(data) - width + 1
    return mix((sums[width:] - sums[:n]) * backward[:n])


def features(raw: bytes, rank: np.ndarray) -> np.ndarray:
    """Distinct hashes of the selected windows, each kind in order of position."""
    data = np.frombuffer(raw, dtype=np.uint8)
    if not len(data):
        return np.zeros(0, dtype=np.uint64)
    parts = []
    if len(data) >= SHORT_BYTES:
        hashes = window_hashes(data, WINDOW)
        key = (rank[entropy_levels(data)].astype(np.uint64) << _U(48)) | (hashes >> _U(16))
        # Least of REACH on either side, by doubling.
        width = 2 * REACH + 1
        padded = np.full(len(key) + 2 * REACH, ~_U(0), dtype=np.uint64)
        padded[REACH : REACH + len(key)] = key
        span, least = 1, padded
        while span * 2 <= width:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(key)], least[width - span : width - span + len(key)])
        parts.append(hashes[key == least])
    if TINY_BYTES <= len(data) < 2 * SHORT_BYTES:
        parts.append(window_hashes(data, SHORT))
    if len(data) < 2 * TINY_BYTES:
        parts.append(window_hashes(data, min(TINY, len(data))))
    found = np.concatenate(parts)
    _, first = np.unique(found, return_index=True)
    return found[np.sort(first)]


class Digest:
    """Chained filters as a bit matrix, and how many features each holds."""

    def __init__(self, bits: np.ndarray, held: np.ndarray):
        self.bits, self.held = bits, held

    @classmethod
    def of(cls, found: np.ndarray) -> Digest:
        filters = -(-len(found) // FULL)
        bits = np.zeros((filters, BITS), dtype=bool)
        row = np.arange(len(found)) // FULL
        for k in range(HASHES):
            bits[row, ((found >> _U(16 * k)) % _U(BITS)).astype(np.int64)] = True
        return cls(bits, np.bincount(row, minlength=filters) if len(found) else np.zeros(0, dtype=np.int64))

    def text(self) -> str:
        """Filters as base64, each behind its number of features; empty for an empty text."""
        packed = np.packbits(self.bits, axis=1)
        return ".".join(f"{n}:{base64.b64encode(p.tobytes()).decode()}" for n, p in zip(self.held, packed, strict=True))

    @classmethod
    def parse(cls, text: str) -> Digest:
        parts = [p.split(":") for p in text.split(".")] if text else []
        rows = [np.unpackbits(np.frombuffer(base64.b64decode(b), dtype=np.uint8)) for _, b in parts]
        return cls(np.array(rows, dtype=bool).reshape(len(parts), BITS), np.array([int(n) for n, _ in parts], dtype=np.int64))


def likeness(a: Digest, b: Digest) -> float:
    """Mean, over the filters of the digest with fewer, of the best normalised overlap: shared bits
    beyond those expected by chance, over the most that could be shared beyond them. Equal
    digests are 1, two empty ones too; an empty and another one are 0."""
    if len(b.held) < len(a.held) or (len(a.held) == len(b.held) and b.held.sum() < a.held.sum()):
        a, b = b, a
    if not len(a.held):
        return 1.0 if not len(b.held) else 0.0
    x, y = a.bits.astype(np.float32), b.bits.astype(np.float32)
    shared = x @ y.T
    ones_a, ones_b = x.sum(axis=1)[:, None], y.sum(axis=1)[None, :]
    chance = ones_a * ones_b / BITS
    most = np.minimum(ones_a, ones_b)
    # A filter with little in it next to a full one always finds much: compare like with like.
    over = np.where(most > chance, (shared - chance) / np.maximum(most - chance, 1e-6), 0.0)
    return float(np.clip(over.max(axis=1), 0, 1) @ a.held / a.held.sum())


def level_ranks(docs: DataFrame) -> np.ndarray:
    """Rank of each entropy level over all windows of all documents, rarest first. LEVELS numbers leave a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LEVELS, dtype=np.int64)
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    data = np.frombuffer(text.as_py().encode("utf-8", "surrogatepass"), dtype=np.uint8)
                    total += np.bincount(entropy_levels(data), minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(range(LEVELS), pa.int32()), pa.array(total)], names=["level", "n"])

    rows = in_batches(docs.select("text")).mapInArrow(count, "level int, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(LEVELS, dtype=np.int64)
    for r in rows:
        total[r["level"]] = r["n"]
    out = np.zeros(LEVELS, dtype=np.int64)
    out[np.lexsort((np.arange(LEVELS), total))] = np.arange(LEVELS)
    return out


def edited(text: str, following: str) -> str:
    third = len(text) // 3
    return text[: len(text) - third] + following[:third] if third else text


def fingerprints(docs: DataFrame, rank: np.ndarray | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row.

    The next document is that of the next smaller doc_id, after the last the first (nulls come
    last, repeated ids in order of their text hashes). One row is its own next. Null texts count
    as empty; an empty text has an empty fingerprint. An empty table gives an empty result.
    """
    if rank is None:
        rank = level_ranks(docs)
    spark = docs.sparkSession
    rows = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("did"), F.xxhash64("text").alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    # Ids and text hashes alone are ranked; they give the edges of runs that hold equally many rows.
    runs = partitions(spark) * 2
    ranked = with_ranks(rows.select("did", "th"), [F.desc("did"), F.col("th")], "ids")
    total = ranked.count()
    step = max(-(-total // runs), 1)
    # In order of the runs; at most one more than there are runs.
    edges = sorted({(-r["did"], r["th"]) for r in ranked.where(F.col("rank") % step == 0).select("did", "th").collect()})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A run's first row also goes to the run before, whose last document it follows.
        for batch in batches:
            places = [(-did, th) for did, th in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            run = np.array([bisect.bisect_right(edges, x) - 1 for x in places], dtype=np.int32)
            start = np.array([i for i, x in enumerate(places) if edges[run[i]] == x], dtype=np.int64)
            take = pa.array(np.concatenate([np.arange(len(run)), start]))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([run, (run[start] - 1) % len(edges)]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(len(run)), np.ones(len(start))]).astype(bool)),
                    *(batch.column(c).take(take) for c in range(3)),
                ],
                names=["run", "extra", "did", "th", "text"],
            )

    schema = "run int, extra boolean, did long, th long, text string"
    dealt = in_batches(rows).mapInArrow(deal, schema) if total else rows.selectExpr("0 AS run", "false AS extra", "did", "th", "text")
    order = [F.col("run"), F.col("extra"), F.desc("did"), F.col("th"), F.col("text")]
    together = dealt.repartition(partitions(spark), "run").sortWithinPartitions(*order).drop("th")
    out = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])

    def digest(text: str) -> Digest:
        return Digest.of(features(text.encode("utf-8", "surrogatepass"), rank))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        run, held = None, None
        for batch in batches:
            done = []
            for r, extra, did, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if r != run:
                    run, held = r, None
                elif extra and held is None:
                    continue  # further rows of the next run's first id
                text = text.as_py()
                own = digest(text)
                if held is not None:
                    at, before, mark = held
                    new = edited(before, text)
                    other = digest(new) if new != before else mark
                    sha = sha256(new.encode("utf-8", "surrogatepass")).hexdigest()
                    done.append((None if at == NULL_ID else at, len(before), sha, mark.text(), other.text(), likeness(mark, other), likeness(mark, own)))
                held = None if extra else (did, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), out.types, strict=True)] if done else [pa.array([], t) for t in out.types], schema=out)

    return in_batches(together).mapInArrow(compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
