"""Line dedup by pairwise alignment.

A key is the shortest run of a document's lines that has the words of a block (ten), taken forwards from each line
and backwards from it; a line of ten words is its own run. Keys that two documents share show that they overlap.
Every line of every run of ten words that also stands in an earlier document lies in a shared key, so it is enough
that each document meets, for each of its keys, the earliest holder of that key.

Rare keys decide which documents are paired. A document's holders are taken from the one with the rarest key on;
the keys that the pair shares are anchors, which patience diff aligns: the longest increasing run of anchors,
grown to blocks along equal neighbours, then the rest again. A holder all of whose keys lie in
blocks that rarer holders have already taken is not aligned at all. Aligned blocks go from the later document.

What travels is one row for each key of a document; neither lines nor texts of holders are copied to
their followers. Texts are read again at the end and lose their lines there.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NULL_ID, documents, drop, in_batches, materialise
from .textvec import _powers, mix

#: Words of the shortest block that is deleted.
MIN_BLOCK_WORDS = 10

Anchor = tuple[int, int, int]


def patience_blocks(anchors: list[Anchor]) -> list[list[Anchor]]:
    """Alignments of ``anchors`` (start in old, start in new, length), which are common runs of lines.

    Each alignment is a list of blocks that increase on both sides. The first takes the longest increasing run of
    anchors, found by patience sorting; the others cover what crosses it, each anchor once, with
    the fewest increasing runs. Anchors on one diagonal that touch or overlap are one block.
    """
    left = sorted(set(anchors), key=lambda x: (x[1], x[0], x[2]))
    chains: list[list[Anchor]] = []
    if left:
        first = {left[k] for k in _increasing([(a, b) for a, b, _ in left])}
        chains.append([x for x in left if x in first])
        # The rest, dealt greedily: an anchor goes behind the chain whose end is the greatest below it.
        ends: list[tuple[int, int]] = []
        for x in sorted((x for x in left if x not in first), key=lambda x: (x[1], -x[0], x[2])):
            at = bisect.bisect_left(ends, (x[0], -1)) - 1
            if at < 0:
                chains.append([x])
                bisect.insort(ends, (x[0], len(chains) - 1))
            else:
                _, chain = ends.pop(at)
                chains[chain].append(x)
                bisect.insort(ends, (x[0], chain))
    out = []
    for chain in chains:
        blocks: list[Anchor] = []
        for a, b, n in chain:
            if blocks:
                a0, b0, n0 = blocks[-1]
                if a - a0 == b - b0 and a <= a0 + n0:
                    blocks[-1] = (a0, b0, max(n0, a + n - a0))
                    continue
            blocks.append((a, b, n))
        out.append(blocks)
    return out


def _increasing(pairs: list[tuple[int, int]]) -> list[int]:
    """Positions of a longest run of ``pairs`` (ordered by the second) that increases in both: patience sorting."""
    tops: list[int] = []
    where: list[int] = []
    back = [-1] * len(pairs)
    k = 0
    while k < len(pairs):
        # Of pairs with equal second, none may follow another: all look at the piles as they stand.
        stop = k
        while stop < len(pairs) and pairs[stop][1] == pairs[k][1]:
            stop += 1
        placed = [(bisect.bisect_left(tops, pairs[i][0]), i) for i in range(k, stop)]
        for pile, i in reversed(placed):
            back[i] = where[pile - 1] if pile else -1
            if pile == len(tops):
                tops.append(pairs[i][0])
                where.append(i)
            elif pairs[i][0] < tops[pile]:
                tops[pile], where[pile] = pairs[i][0], i
        k = stop
    out, k = [], where[-1] if where else -1
    while k >= 0:
        out.append(k)
        k = back[k]
    return out[::-1]


def lost_lines(held: list[tuple[int, tuple, int, int, int]], n_lines: int) -> np.ndarray:
    """Numbers (among the lines with words) of the lines that go.

    ``held`` are the shared keys: (documents that have it, its earliest holder, start there, start here, length).
    """
    by_holder: dict[tuple, list[tuple[int, Anchor]]] = {}
    for n, holder, old, new, length in held:
        by_holder.setdefault(holder, []).append((n, (old, new, length)))
    gone = np.zeros(n_lines + 1, dtype=bool)
    for _, anchors in sorted(by_holder.items(), key=lambda x: (min(n for n, _ in x[1]), x[0])):
        if all(gone[b : b + n].all() for _, (_, b, n) in anchors):
            continue
        for blocks in patience_blocks([x for _, x in anchors]):
            for _, b, n in blocks:
                gone[b : b + n] = True
    return np.flatnonzero(gone)


def _hashed(docs: DataFrame) -> DataFrame:
    """(did, th, one, two, words): row key and, for each line, two hashes of its trimmed text and its words."""
    rows = docs.where(F.col("text").isNotNull()).select(
        F.coalesce("doc_id", F.lit(NULL_ID)).alias("did"),
        F.xxhash64("text").alias("th"),
        F.transform(F.split("text", "\n"), lambda x: F.trim(x)).alias("line"),
    )
    spaces = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))
    return rows.select(
        "did", "th",
        F.transform("line", lambda x: F.xxhash64(x)).alias("one"),
        F.transform("line", lambda x: F.xxhash64(F.lit(1), x)).alias("two"),
        F.transform("line", lambda x: F.when(x == "", 0).when(F.contains(x, F.lit("  ")), F.regexp_count(x, F.lit("[^ ]+"))).otherwise(spaces(x) + 1)).alias("words"),
    )


def keys_of(hashes: list[np.ndarray], words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, key) of each line's shortest runs of ``least`` words, forwards and backwards, each run once.

    ``hashes`` and ``words`` are of lines with words; a key has one column for each kind of hash.
    """
    n = len(words)
    sums = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    at = np.arange(n)
    ahead = np.searchsorted(sums, sums[:-1] + least)  # the run at .. ahead
    behind = np.searchsorted(sums, sums[1:] - least, side="right") - 1  # the run behind .. at + 1
    start = np.concatenate([at[ahead <= n], behind[behind >= 0]])
    end = np.concatenate([ahead[ahead <= n], at[behind >= 0] + 1])
    runs = np.unique(start * (n + 1) + end)
    start, end = runs // (n + 1), runs % (n + 1)
    forward, backward = _powers(n + 1)
    keys = []
    for h in hashes:
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(mix(h) * forward[:n], out=prefix[1:])
        keys.append(mix((prefix[end] - prefix[start]) * backward[start]))
    return start, end, np.stack(keys, axis=1)


def _keys(hashed: DataFrame, least: int) -> DataFrame:
    """(did, th, n_lines, one, two, len, at): every key of every document and the lines where it starts, counting
    lines with words only."""
    out = pa.schema([
        ("did", pa.int64()), ("th", pa.int64()), ("n_lines", pa.int32()), ("one", pa.int64()), ("two", pa.int64()),
        ("len", pa.int32()), ("at", pa.list_(pa.int32())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dids, ths, sizes, ones, twos, lengths, starts, times = [], [], [], [], [], [], [], []
            offsets = batch.column(2).offsets.to_numpy()
            flat = [batch.column(c).values.to_numpy() for c in (2, 3, 4)]
            for i in range(batch.num_rows):
                one, two, words = (x[offsets[i] : offsets[i + 1]] for x in flat)
                some = words > 0
                words = words[some]
                if words.sum() < least:
                    continue
                start, end, key = keys_of([one[some].view(np.uint64), two[some].view(np.uint64)], words, least)
                order = np.lexsort((start, key[:, 1], key[:, 0]))
                start, end, key = start[order], end[order], key[order]
                new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
                row = np.full(len(new), i)
                dids.append(row)
                ths.append(row)
                sizes.append(np.full(len(new), len(words), dtype=np.int32))
                ones.append(key[new, 0])
                twos.append(key[new, 1])
                lengths.append((end - start)[new].astype(np.int32))
                starts.append(start.astype(np.int32))
                times.append(np.diff(np.append(new, len(start))))
            if not dids:
                continue
            row = pa.array(np.concatenate(dids))
            edges = np.concatenate([[0], np.cumsum(np.concatenate(times))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(row), batch.column(1).take(row), pa.array(np.concatenate(sizes)),
                    pa.array(np.concatenate(ones).view(np.int64)), pa.array(np.concatenate(twos).view(np.int64)),
                    pa.array(np.concatenate(lengths)), pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(starts))),
                ],
                schema=out,
            )

    return in_batches(hashed).mapInArrow(run, "did long, th long, n_lines int, one long, two long, len int, at array<int>")


def deletions(docs: DataFrame, min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """(did, th, gone): for each row key that loses lines, their 0-based numbers among its lines with words."""
    keys = materialise(_keys(_hashed(docs), min_block_words), "keys")
    earliest = F.min(F.struct("did", "th", F.col("at")[0].alias("at")))
    first = keys.groupBy("one", "two").agg(earliest.alias("first"), F.count("*").alias("n")).where("n > 1")
    first = materialise(first.select("one", "two", F.col("first.did").alias("did0"), F.col("first.th").alias("th0"), F.col("first.at").alias("at0"), "n"), "holders")
    later = keys.join(first, ["one", "two"]).where("did <> did0 OR th <> th0")
    # No more than a document's own keys meet in one group, so a group fits where its document does.
    held = later.groupBy("did", "th").agg(F.max("n_lines").alias("n_lines"), F.collect_set(F.struct("n", "did0", "th0", "at0", "at", "len")).alias("held"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dids, ths, gone = [], [], []
            for did, th, n_lines, held in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                shared = [(x["n"], (x["did0"], x["th0"]), x["at0"], at, x["len"]) for x in held.as_py() for at in x["at"]]
                dids.append(did)
                ths.append(th)
                gone.append(lost_lines(shared, n_lines))
            yield pa.RecordBatch.from_arrays([pa.array(dids, pa.int64()), pa.array(ths, pa.int64()), pa.array(gone, pa.list_(pa.int32()))], names=["did", "th", "gone"])

    out = materialise(in_batches(held).mapInArrow(align, "did long, th long, gone array<int>"), "deletions")
    drop(keys, first)
    return out


def line_dedup(docs: DataFrame, min_block_words: int = MIN_BLOCK_WORDS) -> DataFrame:
    """Every row of ``docs`` with all its columns, ``text`` without its deleted lines, and
    ``lines_removed`` (int array of 0-based line numbers, empty if none).

    A line with words goes exactly when it lies in a run of at least ``min_block_words`` words of consecutive lines
    that also stands in an earlier document; blank lines don't count in runs, and those between two lines that go
    go too. Lines are equal when their texts without spaces at the ends are, by 128 bits of hash. The earlier of
    two documents has the smaller doc_id (nulls first; of equal ids, the smaller text hash). Repeated rows with the
    same doc_id and text are one document, so they all keep or lose the same lines. Null and empty texts stay as
    they are, and an empty table gives an empty result. A text may end up empty. ``lines_removed`` replaces a
    column of that name; other columns pass through, whatever their names.
    """
    gone = deletions(docs, min_block_words)
    names = [c for c in docs.columns if c != "lines_removed"]
    keyed = docs.select(F.struct(*names).alias("row"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("did"), F.xxhash64("text").alias("th"))
    # Deletions grow with the corpus, so they are never broadcast, however few they are today.
    joined = keyed.join(gone.hint("merge"), ["did", "th"], "left")
    cut = F.when(F.col("gone").isNotNull(), F.col("row.text"))
    out = joined.select("row", _without(cut, "gone").alias("cut"))
    text = F.when(F.col("cut.removed").isNull(), F.col("row.text")).otherwise(F.col("cut.left"))
    removed = F.coalesce("cut.removed", F.array().cast("array<int>"))
    return in_batches(out).select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in names], removed.alias("lines_removed"))


@F.pandas_udf(T.StructType().add("left", T.StringType()).add("removed", T.ArrayType(T.IntegerType())))
def _without(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
    """Texts without the lines of ``gone`` (numbers among lines with words) and the blank lines between them, and
    the numbers of all of these; null where nothing goes."""
    out: list[tuple] = []
    for text, numbers in zip(texts, gone, strict=True):
        if text is None or numbers is None:
            out.append((None, None))
            continue
        lines = text.split("\n")
        full = np.array([x.strip(" ") != "" for x in lines])
        own = np.zeros(len(lines) + 2, dtype=bool)  # by number + 1, so that no line is before the first or behind the last
        own[np.asarray(numbers, dtype=np.int64) + 1] = True
        number = np.cumsum(full)
        drops = own[number] & (full | own[number + 1])
        out.append(("\n".join([x for x, d in zip(lines, drops, strict=True) if not d]), np.flatnonzero(drops).astype(np.int32)))
    return pd.DataFrame(out, columns=["left", "removed"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` after line dedup, same columns: rows of which nothing but white space is left go,
    and ``n_chars``, where there is one, follows the text."""
    marked = line_dedup(docs.select(F.struct("*").alias("row"), "doc_id", "text"))
    cut = F.size("lines_removed") > 0
    out = marked.where(~cut | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines_left, n_removed, lines_removed, and bytes and crc32 of the text that is left."""
    out = line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    left = F.coalesce("text", F.lit(""))
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return out.select(
        "doc_id",
        lines.alias("lines_left"),
        F.size("lines_removed").alias("n_removed"),
        "lines_removed",
        F.octet_length(left).cast("long").alias("bytes_left"),
        F.crc32(left.cast("binary")).alias("text_crc32"),
    )
