"""SentencePiece encoding and decoding by Viterbi with prefixes shared.

A text is cut into marked words (a run of U+2581 marks and what follows up to the next one). The
distinct words of a batch are sorted, which lays their trie out in depth-first order: going
from one word to the next, the forward table is cut back to the common prefix and only the new
characters are worked out. The table holds, for each prefix, the score of its best path, that path's last
piece and where it starts; words are read off by following the starts back.

A unigram model takes the path of the greatest sum of scores. A BPE model takes it among the paths
that BPE admits: those in which each two neighbours are what BPE leaves of their concatenation. Each prefix has
exactly one such path, so the scores, kept all the same, never decide between two. Which neighbours are admitted
is found once for each pair of pieces, by merging.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from math import inf
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, in_batches

#: The model's mark. Inside, a plain space stands for it: texts have no other spaces then, and strings stay narrow.
MARK = "▁"
_UNIT = re.compile(" +[^ ]*")
#: Bytes of words and ids that a worker remembers from batch to batch, and pairs of pieces.
MEMO, FITS = 160 << 20, 2_000_000
#: What a character outside a unigram vocabulary scores below its worst piece.
UNKNOWN_PENALTY = 10.0


class Codec:
    """Encoder and decoder of one model file of the given ``kind``, bpe or unigram; unless it is given, a model
    whose scores are all whole numbers (ranks of merges) is BPE. Pieces that reach across words raise a ValueError."""

    def __init__(self, model: str, kind: str | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.unk = sp.unk_id()
        self.ids: dict[str, int] = {}
        self.byte = [self.unk] * 256
        self.surface: list[bytes] = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.surface.append(b"")
            else:
                self.ids[piece.replace(MARK, " ")] = i
                self.surface.append(piece.replace(MARK, " ").encode())
        self.scores = [sp.get_score(i) for i in range(n)]
        self.pieces = {i: p for p, i in self.ids.items()}
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError(f"{model} has pieces that reach across words")
        self.bpe = kind == "bpe" if kind else all(self.scores[i].is_integer() for i in self.pieces)
        self.by_bytes = self.unk not in self.byte
        self.unknown = min((self.scores[i] for i in self.pieces), default=0.0) - UNKNOWN_PENALTY
        #: Every ending of a piece: the id of the piece that it is, or -1.
        self.endings: dict[str, int] = {p[i:]: -1 for p in self.ids for i in range(len(p))} | self.ids
        self.fits: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def merge(self, text: str) -> list[str]:
        """Plain BPE of a short string: merge the adjacent pair of best score, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                piece = self.ids.get(parts[i] + parts[i + 1])
                if piece is not None and (best is None or self.scores[piece] > best):
                    best, at = self.scores[piece], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _may_follow(self, a: int, b: int) -> bool:
        """Whether BPE leaves piece a and piece b side by side; a < 0 is the start or an unknown character."""
        if a < 0:
            return len(self.merge(self.pieces[b])) == 1
        x, y = self.pieces[a], self.pieces[b]
        return self.merge(x + y) == [x, y]

    def words(self, distinct: Iterable[str]) -> dict[str, bytes]:
        """Ids (32-bit, as bytes) of each marked word, by one depth-first walk over their trie."""
        out: dict[str, bytes] = {}
        endings, fits, scores, bpe, unknown = self.endings, self.fits, self.scores, self.bpe, self.unknown
        if len(fits) > FITS:
            fits.clear()
        # Of the prefix of each length: the best path's score, its last piece (-1 at the start, -2 an unknown character) and where that starts.
        forward: list[float] = [0.0]
        last: list[int] = [-1]
        start: list[int] = [0]
        before = ""
        for word, plain in sorted((w if w[0] == " " else " " + w, w) for w in distinct):
            shared = len(commonprefix((before, word)))
            del forward[shared + 1 :], last[shared + 1 :], start[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                # All pieces that end here, shortest first.
                begin = end
                ends: list[tuple[int, int]] = []
                while begin and (found := endings.get(word[begin - 1 : end])) is not None:
                    begin -= 1
                    if found >= 0:
                        ends.append((begin, found))
                best, piece, at = forward[end - 1] + unknown, -2, end - 1  # a character outside the vocabulary
                if bpe:
                    while ends:
                        begin, found = ends.pop()
                        pair = last[begin] << 32 | found
                        fit = fits.get(pair)
                        if fit is None:
                            fit = fits[pair] = self._may_follow(last[begin], found)
                        if fit:
                            best, piece, at = forward[begin] + scores[found], found, begin
                            break
                else:
                    if ends and ends[0][0] == at:  # the character is a piece
                        best = -inf
                    while ends:
                        begin, found = ends.pop()
                        total = forward[begin] + scores[found]
                        if total > best:
                            best, piece, at = total, found, begin
                forward.append(best)
                last.append(piece)
                start.append(at)
            got: list[int] = []
            end = len(word)
            while end:
                if last[end] >= 0:
                    got.append(last[end])
                elif self.by_bytes:
                    got.extend(self.byte[b] for b in reversed(word[end - 1].encode("utf-8", "surrogatepass")))
                elif not got or got[-1] != self.unk:  # neighbouring unknown characters are one
                    got.append(self.unk)
                end = start[end]
            got.reverse()
            out[plain] = array("i", got).tobytes()
            before = word
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, like the library's ``encode``: a mark in front, spaces as marks, bytes (or the unknown
        id) for characters outside the vocabulary. Null and empty texts have none."""
        units = [self._units(t) if t else [] for t in texts]
        memo = self.memo
        new = self.words({u for us in units for u in us}.difference(memo))
        memo.update(new)
        self.held += sum(len(w) + len(x) for w, x in new.items()) + 200 * len(new)
        out = [np.frombuffer(b"".join(map(memo.__getitem__, us)), dtype=np.int32) for us in units]
        if self.held > MEMO:
            memo.clear()
            self.held = 0
        return out

    @staticmethod
    def _units(text: str) -> list[str]:
        """Marked words of a text. Where single spaces stand between words, the mark in front is left out."""
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " not in text and text[0] != " " and text[-1] != " ":
            return text.split(" ")
        return [u if u[1:2] in ("", " ") else u[1:] for u in _UNIT.findall(" " + text)]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ``ids``; a literal U+2581 comes back as a space, all else as it was."""
        raw = b"".join([self.surface[i] for i in ids])
        return raw.decode("utf-8", "replace").removeprefix(" ")


_codecs: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    """One codec per worker process and model, with what it remembers."""
    if model not in _codecs:
        _codecs[model] = Codec(model)
    return _codecs[model]


def encode(docs: DataFrame, model: str, batch: int = 2000) -> DataFrame:
    """doc_id, n_ids, ids, decoded_crc32 and round_trip of every row of ``docs``.

    decoded_crc32 is that of the decoded ids in UTF-8; round_trip says whether they give the text
    back (null as empty). Texts of any length are encoded whole; repeated rows alike; a null doc_id stays null. An
    empty table gives an empty result; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        own = codec(model)
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                texts = part.column(1).to_pylist()
                ids = own.encode(texts)
                back = [own.decode(x.tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(x) for x in ids], pa.int64()),
                        pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32), np.concatenate(ids) if ids else []),
                        pa.array([crc32(t.encode("utf-8", "surrogatepass")) for t in back], pa.int64()),
                        pa.array([t == (x or "") for t, x in zip(back, texts, strict=True)]),
                    ],
                    names=["doc_id", "n_ids", "ids", "decoded_crc32", "round_trip"],
                )

    return in_batches(docs.select("doc_id", "text"), batch).mapInArrow(run, "doc_id long, n_ids long, ids array<int>, decoded_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for whole in batches:
            yield pa.RecordBatch.from_arrays(
                [whole.column(0), pa.array([own.decode(x or []) for x in whole.column(1).to_pylist()], pa.string())], names=["doc_id", "text"]
            )

    return in_batches(encoded.select("doc_id", "ids")).mapInArrow(run, "doc_id long, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(documents(spark, sf_dir), default_model())
