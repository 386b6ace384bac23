"""Quality by Bradley-Terry pairwise ranking.

A document's strength is linear in statistics of its whole text. For pairs of a document labelled
1 and one labelled 0, the chance that the first wins is the logistic of the difference of
strengths; the weights minimise the mean logistic loss over all such pairs of all learning rows. What
a row's pairs add to the gradient depends on its strength and on how many rows of the other label have
which strength, so a pass over the rows after a count of strengths serves all pairs. The strength at the
quantile of the learning documents that corresponds to the share of label 0 becomes score 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, drop, fold, in_batches, known_labels, materialise, with_ranks
from .textvec import span_hashes, word_spans

#: The ridge on weights, most Newton steps, and the change of weights at which they end.
RIDGE, STEPS, SETTLED = 1e-3, 25, 1e-4
#: Cells of a unit of strength in which strengths are counted, parts that a row is split into between two cells, and
#: ranges of strength for the curvature between labels, which decides how fast the steps get there, not where to.
CELLS, PARTS, RANGES = 64, 1 << 20, 48
FOLDS, HELD_OUT = 3, 1


def _kinds() -> np.ndarray:
    """A class for each byte value: common marks on their own, the rest by kind."""
    out = np.zeros(256, dtype=np.uint8)
    out[128:] = 1
    out[65:91], out[97:123], out[48:58] = 2, 3, 4
    out[[32, 9, 11, 12, 13]], out[10] = 5, 6
    for i, mark in enumerate(b".,!?;:'\"|()[]{}<>=+-_/\\*#$%&@~^`"):
        out[mark] = 7 + i
    return out


_KIND = _kinds()
N_KINDS = int(_KIND.max()) + 1
_ROUGH = np.array([0, 1, 2, 3, 4, 5, 6, *[7] * (N_KINDS - 7)], dtype=np.uint8)


def features(text: str | None) -> np.ndarray:
    """Statistics of a whole text; of an empty one, zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    data = np.frombuffer(raw, dtype=np.uint8)
    kind = _KIND[data]
    counts = np.bincount(kind, minlength=N_KINDS).astype(float)
    n = max(len(data), 1)
    lower, starts, ends = word_spans(raw)
    words = len(starts)
    w = max(words, 1)
    hashes = span_hashes(lower, starts, ends)
    distinct, times = np.unique(hashes, return_counts=True)
    lengths = ends - starts
    repeats = float((hashes[1:] == hashes[:-1]).sum())
    two = np.unique(hashes[1:] * np.uint64(3) + hashes[:-1]) if words > 1 else hashes
    lines = (text or "").split("\n")
    full = [x.strip() for x in lines if x.strip()]
    ended = sum(x[-1] in ".!?\"'" for x in full)
    short = sum(len(x) < 30 for x in full)
    last = _KIND[data[ends - 1]] if words else np.zeros(0, dtype=np.uint8)
    first = _KIND[data[starts]] if words else np.zeros(0, dtype=np.uint8)
    changes = float((np.diff(_ROUGH[kind].astype(np.int8)) != 0).sum()) if len(kind) > 1 else 0.0
    caps = np.concatenate([[0], np.cumsum(kind == 2)])
    shout = float(((caps[ends] - caps[starts]) * 2 > lengths).sum()) if words else 0.0
    share = counts / n
    return np.array([
        *np.sqrt(share),
        np.log1p(words) / 10,
        np.log1p(lengths.mean() if words else 0.0),
        np.log1p(lengths.std() if words else 0.0),
        len(distinct) / w,
        len(distinct) / np.sqrt(w),
        len(two) / w,
        np.sqrt(times.max() / w) if words else 0.0,
        np.sqrt(repeats / w),
        (last >= 7).sum() / w,
        (first == 2).sum() / w,
        shout / w,
        changes / n,
        np.log1p(len(lines)) / 5,
        np.log1p(len(data) / len(lines)) / 10,
        len(set(full)) / max(len(full), 1),
        ended / max(len(full), 1),
        short / max(len(full), 1),
    ])


def _expand(x: np.ndarray) -> np.ndarray:
    """Statistics, how far each is from the middle either way, and its square, all bounded."""
    x = np.clip(x, -6, 6)
    return np.concatenate([x, np.maximum(x - 1, 0), np.maximum(-x - 1, 0)], axis=-1)


class Model:
    def __init__(self, mean, scale, weights, middle: float, slope: float):
        self.mean, self.scale, self.weights, self.middle, self.slope = mean, scale, weights, middle, slope

    def strength(self, x: np.ndarray) -> np.ndarray:
        return _expand((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.strength(x) - self.middle), -30, 30)))

    @classmethod
    def fit(cls, texts: list[str], y: np.ndarray, sizes: dict[int, int]) -> Model:
        """``sizes``: rows of each label; their shares set the quantile."""
        width = len(features(""))
        return cls.learn(_Here(np.array([features(t) for t in texts]).reshape(len(texts), width), np.asarray(y)), sizes[0] / max(sizes[0] + sizes[1], 1))

    @classmethod
    def learn(cls, rows: _Here | _Staged, share: float | None = None) -> Model:
        """From all of ``rows``; ``share``: that of label 0, by default theirs."""
        width = len(features(""))
        sums = rows.total(lambda x, y: np.concatenate([[(y == 0).sum(), (y == 1).sum()], x.sum(axis=0), (x * x).sum(axis=0)]), 2 + 2 * width)
        bad, good = int(sums[0]), int(sums[1])
        if not good or not bad:  # nothing to compare: everything is like what was seen
            return cls(np.zeros(width), np.ones(width), np.zeros(3 * width), -1.0 if good or not bad else 1.0, 1.0)
        n = good + bad
        mean = sums[2 : 2 + width] / n
        scale = np.sqrt(np.maximum(sums[2 + width :] / n - mean**2, 0)) + 1e-3
        model = cls(mean, scale, np.zeros(3 * width), 0.0, 1.0)
        for _ in range(STEPS):  # Newton steps; the loss is convex
            step = _step(model, rows, good * bad)
            model = cls(mean, scale, model.weights - step, 0.0, 1.0)
            if np.abs(step).max() < SETTLED:
                break
        at = max(min(bad if share is None else round(share * n), n - 1), 1)
        model.middle = float(np.mean(rows.ranked(model.strength, at - 1)))
        return model


def _over(counts: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """At each cell, the sum over all cells of their counts times ``kernel`` at the distance from here to there."""
    size = len(counts) + len(kernel)
    return np.fft.irfft(np.fft.rfft(counts, size) * np.fft.rfft(kernel[::-1], size), size)[len(counts) - 1 : 2 * len(counts) - 1]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _step(model: Model, rows: _Here | _Staged, pairs: int) -> np.ndarray:
    """The Newton step of the mean loss over all ``pairs``."""
    first, counts = rows.strengths(model.strength)  # of label 0 and 1 in each cell
    at = (first + np.arange(len(counts[0]))) / CELLS
    apart = np.arange(1 - len(at), len(at)) / CELLS
    wins, steep = _logistic(apart), _logistic(apart) * _logistic(-apart)
    # How many pairs a row has against its label: of label 1 those that it loses, of label 0 those that it wins.
    against = [_over(counts[1], _logistic(-apart)), _over(counts[0], wins)]
    curve = [_over(counts[1], steep), _over(counts[0], steep)]
    reached = np.cumsum(counts.sum(axis=0)) / counts.sum()
    edges = np.unique(at[np.searchsorted(reached, np.arange(1, RANGES) / RANGES).clip(0, len(at) - 1)])
    d = len(model.weights)
    upper = np.triu_indices(d)

    def sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = _expand((x - model.mean) / model.scale)
        s = z @ model.weights
        pull = np.where(y == 1, np.interp(s, at, against[1]), -np.interp(s, at, against[0]))
        bend = np.where(y == 1, np.interp(s, at, curve[1]), np.interp(s, at, curve[0]))
        spot = np.zeros((2, len(edges) + 1, d + 2))
        np.add.at(spot, (y, np.searchsorted(edges, s)), np.concatenate([z, s[:, None], np.ones((len(s), 1))], axis=1))
        return np.concatenate([pull @ z, ((z * bend[:, None]).T @ z)[upper], spot.ravel()])

    total = rows.total(sums, d + len(upper[0]) + 2 * (len(edges) + 1) * (d + 2))
    gradient = RIDGE * model.weights - total[:d] / pairs
    own = np.zeros((d, d))
    own[upper] = total[d : d + len(upper[0])]
    own = own + np.triu(own, 1).T
    spot = total[d + len(upper[0]) :].reshape(2, len(edges) + 1, d + 2)
    middles = spot[:, :, d] / np.maximum(spot[:, :, d + 1], 1)
    far = middles[1][:, None] - middles[0][None, :]
    cross = spot[1, :, :d].T @ (_logistic(far) * _logistic(-far)) @ spot[0, :, :d]
    values, vectors = np.linalg.eigh((own - cross - cross.T) / pairs + RIDGE * np.eye(d))
    return vectors @ ((vectors.T @ gradient) / np.maximum(values, RIDGE))


def _cells(s: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells, labels and parts in them of strengths ``s``: each is split between its two neighbours, in whole parts, whose sums
    are the same in any order."""
    low = np.floor(s * CELLS).astype(np.int64)
    right = np.rint((s * CELLS - low) * PARTS).astype(np.int64)
    keys, where = np.unique(np.stack([np.concatenate([low, low + 1]), np.concatenate([y, y])]), axis=1, return_inverse=True)
    parts = np.zeros(keys.shape[1], dtype=np.int64)
    np.add.at(parts, where.ravel(), np.concatenate([PARTS - right, right]))
    return keys[0], keys[1], parts


def _counts(cell: np.ndarray, y: np.ndarray, parts: np.ndarray) -> tuple[int, np.ndarray]:
    first = int(cell.min())
    out = np.zeros((2, int(cell.max()) - first + 1))
    out[y, cell - first] = parts / PARTS
    return first, out


class _Here:
    """Learning rows as matrices."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = x, y

    def total(self, sums: Callable, size: int) -> np.ndarray:
        return sums(self.x, self.y)

    def strengths(self, strength: Callable) -> tuple[int, np.ndarray]:
        return _counts(*_cells(strength(self.x), self.y))

    def ranked(self, strength: Callable, at: int) -> list[float]:
        return np.sort(strength(self.x))[at : at + 2].tolist()


class _Staged:
    """Learning rows as a table (y, x): passes over them leave sums, counts by cells, or ranks."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def _blocks(self, run: Callable, schema: str) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = (
                (np.frombuffer(b"".join(b.column(1).to_pylist()), dtype=np.float64).reshape(b.num_rows, -1), b.column(0).to_numpy())
                for b in batches if b.num_rows
            )
            for arrays in run(blocks):
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=[c.split()[0] for c in schema.split(", ")])

        return in_batches(self.rows).mapInArrow(each, schema)

    def total(self, sums: Callable, size: int) -> np.ndarray:
        def run(blocks):
            total = np.zeros(size)
            for x, y in blocks:
                total += sums(x, y)
            yield [TaskContext.get().partitionId()], [total.tobytes()]

        # One row of bounded size a task, added up in the order of tasks.
        parts = sorted(self._blocks(run, "part long, sums binary").collect(), key=lambda r: r["part"])
        return sum((np.frombuffer(bytes(r["sums"]), dtype=np.float64) for r in parts), np.zeros(size))

    def strengths(self, strength: Callable) -> tuple[int, np.ndarray]:
        found = self._blocks(lambda blocks: (_cells(strength(x), y.astype(np.int64)) for x, y in blocks), "cell long, y long, parts long")
        rows = found.groupBy("cell", "y").agg(F.sum("parts").alias("parts")).collect()
        return _counts(*(np.array([r[c] for r in rows], dtype=np.int64) for c in ("cell", "y", "parts")))

    def ranked(self, strength: Callable, at: int) -> list[float]:
        found = self._blocks(lambda blocks: ((strength(x),) for x, _ in blocks), "s double")
        return [r["s"] for r in with_ranks(found, [F.col("s")], "strengths").where(F.col("rank").isin(at, at + 1)).collect()]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from all texts that have a label and are outside the held-out fold; a row of ``docs`` counts as often as it is there."""
    known = known_labels(labels, "quality", folds=FOLDS, held_out=HELD_OUT)
    usable = docs.where(F.col("text").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT)).select(F.col("doc_id").alias("did"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["y", "x"])

    rows = materialise(in_batches(usable.join(known, "did").select("_y", "text")).mapInArrow(run, "y int, x binary"), "features")
    model = Model.learn(_Staged(rows))
    drop(known, rows)
    return model


def score_column(docs: DataFrame, scorer, names: list[str], column: str) -> DataFrame:
    """``names`` of ``docs`` and ``column``, the double that ``scorer`` makes of a list of texts."""
    schema = docs.select(*names, F.lit(0.0).alias(column)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = scorer(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(values, pa.float64())], names=[*names, column])

    return in_batches(docs.select(*names, F.col("text").alias("_text"))).mapInArrow(run, schema)


def keep_rows(docs: DataFrame, keep) -> DataFrame:
    """The rows of ``docs``, with all columns whatever their names, whose text ``keep`` (texts to booleans) accepts.

    Each row is judged alone: repeated rows stay or go together, null texts are judged as None, and an
    empty table gives an empty result.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(at).to_pylist()), pa.bool_()))

    return in_batches(docs).mapInArrow(run, docs.schema)


def _score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    return model.score(np.array([features(t) for t in texts]).reshape(len(texts), -1)) if texts else np.zeros(0)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns; see ``keep_rows``."""
    return keep_rows(docs, lambda texts: _score_texts(model, texts) >= 0.5)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null texts score like empty ones, repeated rows alike, and a null doc_id is not held out. A score of exactly
    0.5 is predicted 1. Without labels of both kinds all rows score alike. An empty table gives an empty
    result; no other column is looked at.
    """
    held = docs.select("doc_id", "text", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"))
    out = score_column(held, lambda texts: _score_texts(model, texts), ["doc_id", "held_out"], "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
