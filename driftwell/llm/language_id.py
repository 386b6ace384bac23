"""Language ID by string kernels.

The kernel of two texts blends spectra: for n = 1, 2, 3 it counts the code-point n-grams present
in both (presence, not frequency; n-grams fall into 2**15 buckets by hash) and divides by the
geometric mean of the two sides. Landmark texts give the Nyström feature map, and one
ridge regression per language against the rest works in that map. Texts are scored in batches:
the sparse presence matrix of the batch times a matrix that folds landmarks, Nyström root and
ridge weights together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chosen_rows, documents, drop, fold, in_batches, materialise, texts_of

ORDERS = (1, 2, 3)
BUCKET_BITS = 15
#: Learning rows of one language at most; learning rows, landmarks and bytes of learning text in all, which
#: the languages share evenly.
PER_LANGUAGE, LEARNING, LANDMARKS, MAX_BYTES = 400, 4000, 256, 32 << 20
RIDGE = 1e-2
FOLDS, HELD_OUT = 5, 0

_MULTIPLY = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def presence(text: str) -> list[np.ndarray]:
    """Sorted distinct buckets of the lower-cased text's n-grams, for each order."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out, code = [], np.zeros(len(points), dtype=np.uint32)
    seen = np.zeros(1 << BUCKET_BITS, dtype=bool)
    for n in ORDERS:
        count = max(len(points) - n + 1, 0)
        code = (code[:count] ^ points[n - 1 : n - 1 + count]) * _MULTIPLY[n - 1]
        code ^= code >> np.uint32(15)
        seen[:] = False
        seen[(code * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS)] = True
        out.append(np.flatnonzero(seen))
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Model:
    """``languages`` and, for each order, the matrix from presence buckets to language scores."""

    def __init__(self, languages: list[str], weights: list[np.ndarray]):
        self.languages, self.weights = languages, weights

    @classmethod
    def fit(cls, texts: list[str], langs: list[str]) -> Model:
        languages = sorted(set(langs))
        y = np.array([languages.index(x) for x in langs])
        spectra = [presence(t) for t in texts]
        if not languages:
            return cls(languages, [np.zeros((1 << BUCKET_BITS, 0), dtype=np.float32) for _ in ORDERS])
        each = max(LANDMARKS // len(languages), 1)
        picked = np.concatenate([np.flatnonzero(y == c)[:each] for c in range(len(languages))])
        # Only the landmarks are held as a dense matrix; the other texts stay lists of buckets.
        dense = [np.zeros((len(picked), 1 << BUCKET_BITS), dtype=np.float32) for _ in ORDERS]
        kernel = np.zeros((len(texts), len(picked)))
        for k, m in enumerate(dense):
            for row, i in enumerate(picked):
                m[row, spectra[i][k]] = 1 / np.sqrt(max(len(spectra[i][k]), 1))
            for i, s in enumerate(spectra):
                kernel[i] += m[:, s[k]].sum(axis=1) / np.sqrt(max(len(s[k]), 1)) / len(ORDERS)
        values, vectors = np.linalg.eigh(kernel[picked])
        sound = values > 1e-6 * values.max()
        root = vectors[:, sound] / np.sqrt(values[sound])
        mapped = kernel @ root
        share = np.bincount(y, minlength=len(languages))
        weight = 1.0 / share[y]  # each language counts alike
        target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
        left = (mapped * weight[:, None]).T @ mapped + RIDGE * np.eye(mapped.shape[1])
        ridge = root @ np.linalg.solve(left, (mapped * weight[:, None]).T @ target)
        return cls(languages, [(m.T @ ridge / len(ORDERS)).astype(np.float32) for m in dense])

    def scores(self, texts: list[str]) -> np.ndarray:
        """One row per text, one ridge output per language: a sparse-by-dense matrix product."""
        spectra = [presence(t) for t in texts]
        out = np.zeros((len(texts), len(self.languages)))
        for k, weights in enumerate(self.weights):
            sizes = np.array([len(s[k]) for s in spectra])
            some = np.flatnonzero(sizes)
            if len(some):
                rows = weights[np.concatenate([spectra[i][k] for i in some])]
                starts = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                out[some] += np.add.reduceat(rows, starts, axis=0) / np.sqrt(sizes[some])[:, None]
        return out


def fit(docs: DataFrame) -> Model:
    """A model from at most PER_LANGUAGE texts of each language, none of the held-out fold.

    Only rows that can teach something are counted and drawn: those with a language and a letter. They are
    drawn row by row, so a doc_id that many rows share teaches like many ids.
    """
    learn = F.coalesce(fold("doc_id", FOLDS), F.lit(HELD_OUT)) != HELD_OUT
    usable = docs.where(F.col("lang").isNotNull() & learn & F.col("text").rlike(r"\p{L}"))
    rows = materialise(
        usable.select(F.col("doc_id").alias("did"), F.xxhash64("text").alias("th"), F.octet_length("text").alias("bytes"), "lang"), "usable"
    )
    chosen, _ = chosen_rows(rows, "lang", PER_LANGUAGE, LEARNING, MAX_BYTES)
    drop(rows)
    found = [(text, lang) for text, lang in texts_of(docs, chosen, "string") if has_letter(text)]
    return Model.fit([t for t, _ in found], [x for _, x in found])


def identify(docs: DataFrame, model: Model, batch: int = 256) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs``.

    The score is the softmax of four times the ridge outputs at the predicted language. Texts that
    are null, empty or without a letter are ``und`` with score 0; so is everything when nothing
    was learned. A null doc_id is not held out. Equal outputs go to the first language by name.
    """
    held = docs.select("doc_id", "text", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            langs: list[str] = []
            best: list[float] = []
            for start in range(0, whole.num_rows, batch):
                texts = whole.column("text").slice(start, batch).to_pylist()
                ok = [i for i, t in enumerate(texts) if t and model.languages and has_letter(t)]
                raw = model.scores([texts[i] for i in ok]) if ok else np.zeros((0, 1))
                soft = np.exp(4 * (raw - raw.max(axis=1, keepdims=True)))
                soft /= soft.sum(axis=1, keepdims=True)
                pred, score = ["und"] * len(texts), [0.0] * len(texts)
                for row, i in enumerate(ok):
                    c = int(raw[row].argmax())
                    pred[i], score[i] = model.languages[c], float(soft[row, c])
                langs += pred
                best += score
            yield pa.RecordBatch.from_arrays(
                [whole.column("doc_id"), whole.column("held_out"), pa.array(langs, pa.string()), pa.array(best, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return in_batches(held).mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, fit(docs))
