"""Best-fit packing of token pieces by exact-complement hashing.

Only the histogram of piece lengths decides the packing, and it has one entry per length
(1024), however many documents there are. The planner indexes the sums of one, two and three
available lengths, fills the gap beside the longest piece left with a combination that closes
it exactly, as many times as the counts allow, and best-fits what is left over. The plan is a
list of (pattern, times); each length's pieces are ranked across the cluster and take their
places in the plan by rank.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, in_batches, materialise, with_ranks

CAPACITY = 1024
END_ID = 2


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths (longest first, together at most ``capacity``) and how often to use each.

    Triples close more gaps but use up short lengths early, which can cost a few sequences where
    lengths are sparse. So plans with combinations of up to three, two and one are made and the one
    of the fewest sequences is taken (of equals, that of the larger combinations).
    """
    return min((_plan(counts, capacity, most) for most in (3, 2, 1)), key=lambda p: sum(n for _, n in p))


def _plan(counts: dict[int, int], capacity: int, most: int) -> list[tuple[tuple[int, ...], int]]:
    """A plan whose gaps close with exact combinations of at most ``most`` lengths.

    Every step uses up at least one length or halves it, so there are few patterns: their number
    depends on ``capacity`` alone.
    """
    left = Counter({n: c for n, c in counts.items() if c > 0})
    out: list[tuple[tuple[int, ...], int]] = []

    def times(pattern: tuple[int, ...]) -> int:
        return min(left[n] // k for n, k in Counter(pattern).items())

    def exact(held: tuple[int, ...]) -> tuple[int, ...] | None:
        """``held`` with up to ``most`` more lengths that close its gap, as far as counts allow."""
        gap = capacity - sum(held)
        if not gap:
            return held
        if times((*held, gap)):
            return (*held, gap)
        if most == 1:
            return None
        alive = [n for n in ordered[: bisect.bisect_right(ordered, gap)][::-1] if times((*held, n))]
        for a in alive:
            if a >= gap - a and times((*held, a, gap - a)):
                return (*held, a, gap - a)
        if most == 2:
            return None
        pairs: dict[int, tuple[int, int]] = {}
        # Sums of pairs met so far: a third length looks its complement up.
        for at, a in enumerate(alive):
            for b in alive[: at + 1]:
                if a + b < gap:
                    pairs.setdefault(a + b, (b, a))
            if gap - a in pairs and times((*held, *pairs[gap - a], a)):
                return (*held, *pairs[gap - a], a)
        return None

    ordered = sorted(left)
    while ordered:
        pattern: tuple[int, ...] = (ordered[-1],)
        while (closed := exact(pattern)) is None:
            # Best fit: the longest length that the gap takes, then look for complements again.
            fits = ordered[: bisect.bisect_right(ordered, capacity - sum(pattern))]
            longest = next((n for n in reversed(fits) if times((*pattern, n))), None)
            if longest is None:
                closed = pattern
                break
            pattern = (*pattern, longest)
        n = times(closed)
        out.append((closed, n))
        for length, k in Counter(closed).items():
            left[length] -= k * n
            if not left[length]:
                del left[length]
                ordered.remove(length)
    return out


def placements(patterns: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each length, intervals of ranks: from ``first`` on, rank r sits in sequence
    ``sequence + r - first`` at ``offset``. Sorted by (length, first)."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return dict(zip(("length", "first", "sequence", "offset"), table.T, strict=True))


class Encoder:
    """Ids of byte-level BPE, as ``tokenizers`` gives them for the file ``tokenizer`` with add_special_tokens=False.

    ``tiktoken`` does the work with the file's vocabulary, as ``tokenizers`` takes several times as long (``tests/llm``
    compare their ids). Added tokens of the file that stand in a text are one id each. Texts with a
    run of white space of LONG_RUN characters, which overflow the stack of ``tiktoken``'s pattern,
    go through ``tokenizers`` itself.
    """

    LONG_RUN = 50_000

    def __init__(self, tokenizer: str):
        import json

        import public_tokenizers
        import tiktoken

        with open(tokenizer, encoding="utf-8") as f:
            whole = json.load(f)
        added = {t["content"]: t["id"] for t in whole.get("added_tokens", [])}
        # The file writes each byte as a printable character: printable Latin-1 as itself, the rest from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        ranks = {}
        for piece, i in whole["model"]["vocab"].items():
            if piece not in added:
                ranks[bytes(byte_of[c] for c in piece)] = i
        del whole
        self.tokenizer, self.added = tokenizer, list(added)
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.exact = None
        self.long_run = re.compile(rf"\s{{{self.LONG_RUN}}}")

    def ids(self, text: str) -> list[int]:
        if len(text) >= self.LONG_RUN and self.long_run.search(text):
            if self.exact is None:
                from tokenizers import Tokenizer

                self.exact = Tokenizer.from_file(self.tokenizer)
            return self.exact.encode_batch_fast([text], add_special_tokens=False)[0].ids
        if any(t in text for t in self.added):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer: str) -> Encoder:
    """One encoder per worker process and file."""
    if tokenizer not in _encoders:
        _encoders[tokenizer] = Encoder(tokenizer)
    return _encoders[tokenizer]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and ``end_id``, cut only where
    longer than ``capacity``; then the first piece takes the remainder, the others are full."""
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        own = encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*own.ids(text.as_py() or ""), end_id], dtype="<u4")
                edge = len(ids) % capacity or capacity
                start = 0
                for k in range(-(-len(ids) // capacity)):
                    rows.append((doc_id, k, start, edge - start, crc32(ids[start:edge].tobytes())))
                    start, edge = edge, edge + capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), out.types, strict=True)] if rows else [pa.array([], t) for t in out.types], schema=out)

    return in_batches(docs.select("doc_id", "text")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every row.

    Null and empty texts are one piece of the end id alone. Repeated rows are packed like others.
    Pieces of equal length are interchangeable; they rank by doc_id (nulls first), piece and
    checksum. An empty table gives an empty result.
    """
    order = [F.col(c) for c in ("length", "doc_id", "piece", "ids_crc32")]
    # Staged first: the range exchange of the ranks looks at its input twice.
    cut = materialise(pieces(docs, tokenizer, capacity, end_id), "cut")
    ranked = with_ranks(cut, order, "pieces")
    # One row per length: at most ``capacity``. A length's pieces hold consecutive ranks.
    spans = ranked.groupBy("length").agg(F.count("*").alias("n"), F.min("rank").alias("first")).collect()
    place = placements(plan({r["length"]: r["n"] for r in spans}, capacity))
    lowest = np.zeros(capacity + 1, dtype=np.int64)
    for r in spans:
        lowest[r["length"]] = r["first"]
    # (length, rank in length) as one number, so that one binary search finds the interval.
    wide = np.int64(1) << 50
    starts = place["length"] * wide + place["first"]

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() - lowest[length]
            at = np.searchsorted(starts, length * wide + rank, side="right") - 1
            keep = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            seats = [pa.array(place["sequence"][at] + rank - place["first"][at]), pa.array(place["offset"][at])]
            yield pa.RecordBatch.from_arrays([*keep, *seats], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return in_batches(ranked).mapInArrow(seat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), default_tokenizer())
