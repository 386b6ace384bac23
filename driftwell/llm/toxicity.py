"""Toxicity by a weighted finite-state pattern grammar.

Clauses are read by a cascade of weighted transducers, composed as they run. The lexicon reads a word as one
or more symbols (insult, threat, target, negation, report, other), each with a weight, so reading is
nondeterministic. Negation and reported speech take half the weight of what falls into their scope. The
target transducer lets a threat count only where a target stands on either side, and raises an insult that
does; what stands ahead is guessed and has to come true before the clause ends. The insult transducer lets an
insult without a target count only where it is said of something: a clause that is one lone
word matches nothing. A clause gets the weight of its best path (greatest sum over accepted hits of arc weight times
the factors on the way), and the document's score is the logistic of sums over matched clauses.

Lexicon weights are learned: an arc, a whole word or a word stem, is kept when it stands in
documents labelled toxic far more often than chance allows, counted over different neighbouring
words, so that copies of a document are no evidence of their own. An arc that mostly stands beside a target becomes
a threat, one that mostly stands beside insults and threats a target, any other an insult.
"""

from __future__ import annotations

import re
from math import log

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, labelled_sample
from .quality import keep_rows, score_column

#: Learning rows of each label, and bytes of learning text in all.
PER_CLASS, MAX_BYTES = 1500, 32 << 20
FOLDS, HELD_OUT, REJECT = 3, 1, 0.7
#: Stem lengths, and the evidence (nats beyond the log of the candidates tried) an arc needs.
STEMS, EVIDENCE = range(3, 10), 5.0
#: Words of one stem that a learning text counts for, and the parts that evidence is learned across.
STEM_WORDS, PARTS = 3, 4
#: Weights of seed insults and seed threats, and the share of an arc's places that decides what it becomes.
PRIOR_WEIGHT, THREAT_WEIGHT, MOSTLY = 3.0, 1.0, 0.5

# Words of the grammar in four languages.
WORDS = {
    "insult": "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown clowns dumb idiota idiotas imbécil estúpido estúpida imbécile crétin connard abruti dummkopf trottel arschloch abschaum",
    "threat": "kill hurt destroy beat shoot stab burn töten umbringen vernichten tuer frapper détruire matar golpear destruir",
    "target": "you your yours he she they them him her these those people du dich dir ihr euch sie ihn tu te toi vous ils elles lui usted ustedes tú ellos ellas",
    "negation": "not no never nobody isn't aren't wasn't don't doesn't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ni",
    "report": "said says wrote writes called claimed quoted reported alleged sagte schrieb behauptete dit écrit dijo escribió llamó",
}
OTHER, QUOTE = "other", "quote"
QUOTES = "\"“”„«»"
#: Words that a scope reaches: behind a negation, behind reported speech, and on either side of a target.
NEGATED, TOLD, AIMED = 3, 8, 6
#: Factors on a hit's weight.
DENIED_FACTOR, TOLD_FACTOR, AIMED_FACTOR = 0.5, 0.5, 1.2

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_TOKEN = re.compile(_WORD.pattern + f"|[{QUOTES}]")
_CLAUSE = re.compile(r"([.!?;:\n]+)")
_SEED = {w: s for s, ws in WORDS.items() for w in ws.split()} | dict.fromkeys(QUOTES, QUOTE)
_HITS = ("insult", "threat")
_IN_QUOTE = TOLD + 1


def negation(state: int, symbol: str) -> list[tuple[int, str, float]]:
    """State: words left in the scope."""
    if symbol == QUOTE:
        return [(state, symbol, 1.0)]
    if symbol == "negation":
        return [(NEGATED, symbol, 1.0)]
    return [(max(state - 1, 0), symbol, DENIED_FACTOR if state and symbol in _HITS else 1.0)]


def reported(state: int, symbol: str) -> list[tuple[int, str, float]]:
    """State: words left in the scope, or _IN_QUOTE up to the end of a quotation that begins in it."""
    if symbol == QUOTE:
        return [(0 if state in (0, _IN_QUOTE) else _IN_QUOTE, symbol, 1.0)]
    factor = TOLD_FACTOR if state and symbol in _HITS else 1.0
    if state == _IN_QUOTE:
        return [(state, symbol, factor)]
    return [(TOLD if symbol == "report" else max(state - 1, 0), symbol, factor)]


def target(state: tuple[int, int], symbol: str) -> list[tuple[tuple[int, int], str, float]]:
    """State: words for which the last target still reaches, and words within which a promised one has to come."""
    seen, owed = state
    if symbol == QUOTE:
        return [(state, symbol, 1.0)]
    if symbol == "target":
        return [((AIMED, 0), symbol, 1.0)]
    if owed == 1:
        return []  # the promise is broken
    on = (max(seen - 1, 0), max(owed - 1, 0))
    if symbol not in _HITS:
        return [(on, symbol, 1.0)]
    out = [(on, "insult" if symbol == "insult" else OTHER, 1.0)]
    if seen or owed:
        out.append((on, "aimed", AIMED_FACTOR))
    else:
        out.append(((on[0], AIMED), "aimed", AIMED_FACTOR))
    return out


def insult(state: int, symbol: str) -> list[tuple[int, str, float]]:
    """State: 0 before the first word, 1 behind a word, 2 where a word has to follow. Writes ``hit`` or other."""
    if symbol == QUOTE:
        return [(state, OTHER, 1.0)]
    if symbol == "insult":
        return [(1 if state else 2, "hit", 1.0), (1, OTHER, 1.0)]
    return [(1, "hit" if symbol == "aimed" else OTHER, 1.0)]


class Cascade:
    """Weighted transducers, each reading what the one before wrote, composed lazily: arcs of a composed
    state are worked out when a path first asks for them."""

    def __init__(self, *parts):
        """``parts``: (step, start, is_final) of each transducer."""
        self.steps = [p[0] for p in parts]
        self.start = tuple(p[1] for p in parts)
        self.finals = [p[2] for p in parts]
        self.known: dict[tuple, list] = {}

    def arcs(self, state: tuple, symbol: str) -> list[tuple[tuple, bool, float]]:
        """(state, whether a hit is accepted, factor) of every way to go on."""
        found = self.known.get((state, symbol))
        if found is None:
            ways: list = [((), symbol, 1.0)]
            for step, own in zip(self.steps, state, strict=True):
                ways = [((*to, s), out, f * g) for to, read, f in ways for s, out, g in step(own, read)]
            found = self.known[state, symbol] = [(to, out == "hit", f) for to, out, f in ways]
        return found

    def best(self, readings: list[tuple[tuple[str, float], ...]]) -> float:
        """Weight of the best accepting path over words, each given by its (symbol, weight) readings."""
        paths = {self.start: 0.0}
        for read in readings:
            after: dict[tuple, float] = {}
            for symbol, weight in read:
                for state, total in paths.items():
                    for to, hit, factor in self.arcs(state, symbol):
                        value = total + weight * factor if hit else total
                        if value > after.get(to, -1.0):
                            after[to] = value
            paths = after
        return max((v for state, v in paths.items() if all(f(s) for f, s in zip(self.finals, state, strict=True))), default=0.0)


def grammar() -> Cascade:
    """Negation, then reported speech, then targets, then insults."""
    always = lambda _: True
    return Cascade((negation, 0, always), (reported, 0, always), (target, (0, 0), lambda s: not s[1]), (insult, 0, lambda s: s != 2))


_GRAMMAR = grammar()
_PLAIN = ((OTHER, 0.0),)
#: So many words that mean nothing end every scope but a quotation; more of them in a row change no path.
_IDLE = max(NEGATED, TOLD, AIMED) + 1


class Lexicon:
    """Weighted arcs over words and stems; ``read`` gives a word's readings as (symbol, weight).

    ``words`` and ``stems`` have the weights of learned arcs and ``kinds`` their symbols (insult where it has none).
    """

    def __init__(self, words: dict[str, float], stems: dict[str, float], kinds: dict[str, str] | None = None):
        self.words, self.stems, self.kinds = words, stems, kinds or {}
        self.lengths = sorted({len(s) for s in stems})
        self.memo: dict[str, tuple[tuple[str, float], ...]] = {}

    def read(self, word: str) -> tuple[tuple[str, float], ...]:
        found = self.memo.get(word)
        if found is None:
            got: dict[str, float] = {}
            own = [(word, self.words[word])] if word in self.words else []
            own += [(word[:k], self.stems[word[:k]]) for k in self.lengths if len(word) >= k and word[:k] in self.stems]
            for arc, weight in own:
                kind = self.kinds.get(arc, "insult")
                got[kind] = max(got.get(kind, 0.0), weight)
            seed = _SEED.get(word)
            if seed:
                got.setdefault(seed, {"insult": PRIOR_WEIGHT, "threat": THREAT_WEIGHT}.get(seed, 0.0))
            found = tuple(got.items()) or _PLAIN
            if len(self.memo) > 100_000:
                self.memo.clear()
            if len(word) < 64:  # so that the memo is bounded in bytes too
                self.memo[word] = found
        return found

    def hits(self, words: list[str]) -> set[str]:
        """The words that read as an insult or a threat."""
        known, read = self.memo.get, self.read
        marked = [w for w in set(words) if (known(w) or read(w)) is not _PLAIN]
        return {w for w in marked if any(s in _HITS for s, _ in read(w))}

    def __getstate__(self):
        return {**self.__dict__, "memo": {}}

    @classmethod
    def learn(cls, sample: Sample, use: np.ndarray) -> Lexicon:
        """A lexicon from the texts of ``sample`` that the mask ``use`` has."""
        rows = use[sample.text]
        bad = rows & (sample.y[sample.text] == 1)
        good = rows & ~bad
        if not bad.any():
            return cls({}, {})
        n_words, n_stems = len(sample.words), max(len(sample.stem_names), 1)
        text, word, beside = sample.text[bad], sample.word[bad], sample.beside[bad]

        def stem_rows(mask: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
            """(row, stem) of every stem, in order of rows; only those that ``keep`` has."""
            stems = sample.stem_of[sample.word[mask]]
            ok = stems >= 0
            if keep is not None:
                ok &= keep[stems]
            at = np.nonzero(ok)
            return at[0], stems[at]

        def in_texts(mask: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Of each (text, stem): the stem, its first row, and its words."""
            row, stem = stem_rows(mask, keep)
            key = sample.text[mask][row].astype(np.int64) * n_stems + stem
            key, first, times = np.unique(key, return_index=True, return_counts=True)
            return key % n_stems, row[first], times

        # Arcs in fewer than three toxic texts are dropped first, so that the rest stays small.
        df_word = np.bincount(word, minlength=n_words)
        df_stem = np.bincount(in_texts(bad, None)[0], minlength=n_stems)
        tried = int((df_word > 0).sum()) + sample.stems_tried
        common = df_stem >= 3

        def different(arc: np.ndarray, mark: np.ndarray, n: int) -> np.ndarray:
            order = np.lexsort((mark, arc))
            a, m = arc[order], mark[order]
            new = np.ones(len(a), dtype=bool)
            new[1:] = (a[1:] != a[:-1]) | (m[1:] != m[:-1])
            return np.bincount(a[new], minlength=n)

        some = df_word[word] >= 3
        near_word = different(word[some], beside[some], n_words)
        stem, first, times = in_texts(bad, common)
        near_stem = different(stem, beside[first], n_stems)
        inside = np.bincount(stem, weights=np.minimum(times, STEM_WORDS), minlength=n_stems)
        family = np.bincount(stem, weights=times, minlength=n_stems)
        most = np.zeros(n_stems)
        seen = np.flatnonzero(df_word)
        for k in range(sample.stem_of.shape[1]):
            of = sample.stem_of[seen, k]
            np.maximum.at(most, of[of >= 0], df_word[seen][of >= 0])
        stem, _, times = in_texts(good, common)
        beyond_stem = np.bincount(stem, weights=np.minimum(times, STEM_WORDS), minlength=n_stems)
        beyond_word = np.bincount(sample.word[good], minlength=n_words)

        share = (bad.sum() + 1) / (rows.sum() + 2)
        need = log(tried + 1) + EVIDENCE
        proven = []

        def prove(a: np.ndarray, b: np.ndarray, ok: np.ndarray, names: list[str], mark: str) -> None:
            at = np.flatnonzero(ok & (a > 0))
            a, b = a[at].astype(float), b[at].astype(float)
            odds = np.log((a + 0.5) / (b + 0.5) * (1 - share) / share)
            found = a * np.log(a / ((a + b) * share)) + b * np.log(np.maximum(b, 1) / ((a + b) * (1 - share)))
            for i in np.flatnonzero((odds > 1.5) & (found > need)):
                proven.append((-found[i], names[at[i]] + mark, float(min(odds[i], 6.0)), at[i]))

        prove(near_word, beyond_word, df_word >= 3, sample.words, "$")
        # A stem stands for many words (its commonest one proves nothing) in several surroundings.
        prove(inside - most, beyond_stem, common & (np.minimum(near_stem, family - most) >= 3) & (inside - most >= 3), sample.stem_names, "")
        words: dict[str, float] = {}
        stems: dict[str, float] = {}
        kinds: dict[str, str] = {}
        # Of a stem, what it begins with and what begins with it, the best proven alone stays.
        for _, arc, odds, i in sorted(proven):
            bare = arc.rstrip("$")
            if any(bare[:k] in stems for k in range(STEMS[0], len(bare) + 1)):
                continue
            if arc[-1] == "$":
                words[bare] = odds
                places = word == i
            elif not any(held.startswith(bare) for held in (*stems, *words)):
                stems[bare] = odds
                places = (sample.stem_of[word] == i).any(axis=1)
            else:
                continue
            if sample.by_target[bad][places].mean() >= MOSTLY:
                kinds[bare] = "threat"
            elif sample.by_hit[bad][places].mean() >= MOSTLY:
                kinds[bare] = "target"
        return cls(words, stems, kinds)


class Sample:
    """Learning texts as tables of numbers: one row for each distinct word of each text, at its first place.

    ``text``, ``word``, ``beside`` (the words on either side as one number), ``by_target`` and ``by_hit`` (whether a
    seed target, or a seed insult or threat, is one of them) by row; ``stem_of`` has the stems of each word (-1: none).
    """

    def __init__(self, texts: list[str], y: np.ndarray):
        self.y = np.asarray(y)
        ids: dict[str, int] = {}
        own = [np.array([ids.setdefault(w, len(ids)) for w in _WORD.findall(t.lower())], dtype=np.int32) for t in texts]
        self.words = list(ids)
        seed = np.array([("target", "hit")[s != "target"] if (s := _SEED.get(w)) in ("target", *_HITS) else "" for w in self.words] + [""])
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for i, whole in enumerate(own):
            word, first = np.unique(whole, return_index=True)
            order = np.argsort(first)
            word, first = word[order], first[order]
            edged = np.concatenate([[-1], whole, [-1]]).astype(np.int32)
            for part, values in zip(parts, (np.full(len(word), i, dtype=np.int32), word, edged[first], edged[first + 2]), strict=True):
                part.append(values)
        self.text, self.word, left, right = (np.concatenate(p) if p else np.zeros(0, dtype=np.int32) for p in parts)
        self.beside = (left.astype(np.int64) + 1 << 31) + right + 1
        self.by_target = (seed[left] == "target") | (seed[right] == "target")
        self.by_hit = (seed[left] == "hit") | (seed[right] == "hit")
        self._stem(self.y[self.text] == 1)

    def _stem(self, bad: np.ndarray) -> None:
        """``stem_of``, ``stem_names`` and ``stems_tried``. Only stems in three toxic texts can prove anything, so the
        others are counted and forgotten."""
        text, word = self.text[bad], self.word[bad]
        stems: dict[str, int] = {}
        times: list[int] = []
        for i in np.unique(text):
            own = {w[:k] for at in word[np.searchsorted(text, i) : np.searchsorted(text, i, side="right")] for k in STEMS if len(w := self.words[at]) > k}
            for stem in own:
                at = stems.setdefault(stem, len(times))
                if at == len(times):
                    times.append(0)
                times[at] += 1
        self.stems_tried = len(stems)
        self.stem_names = [x for x, at in stems.items() if times[at] >= 3]
        known = {x: i for i, x in enumerate(self.stem_names)}
        del stems, times
        self.stem_of = np.full((len(self.words), len(STEMS)), -1, dtype=np.int32)
        for i, w in enumerate(self.words):
            for at, k in enumerate(STEMS):
                if len(w) <= k:
                    break
                self.stem_of[i, at] = known.get(w[:k], -1)


def clause_weight(words: list[str], lexicon: Lexicon) -> float:
    """Weight of the clause's best path."""
    readings, idle = [], 0
    for word in words:
        read = lexicon.read(word)
        idle = idle + 1 if read is _PLAIN else 0
        if idle <= _IDLE:
            readings.append(read)
    return _GRAMMAR.best(readings)


def clauses(low: str) -> list[list[str]]:
    """Words and quotation marks of each clause of a lower-cased text. A colon in reported speech ends
    none, and in a reported quotation only the end of the line does."""
    parts = _CLAUSE.split(low)
    out: list[list[str]] = []
    held: list[str] = []
    state = 0
    for part, mark in zip(parts[::2], [*parts[1::2], "\n"], strict=True):
        words = _TOKEN.findall(part)
        held += words
        if state or any(_SEED.get(w) == "report" for w in words):
            for w in words:
                state = reported(state, _SEED.get(w, OTHER))[0][0]
        if "\n" not in mark and (state == _IN_QUOTE or (state and mark == ":")):
            continue
        out.append(held)
        held, state = [], 0
    return out


def evidence(text: str | None, lexicon: Lexicon) -> list[float]:
    """Sums over the matched clauses of a whole text."""
    low = (text or "").lower()
    words = _WORD.findall(low)
    hits = lexicon.hits(words)
    if not hits:
        return [0.0, 0.0, 0.0, 0.0, 0.0]
    weights = [w for c in clauses(low) if not hits.isdisjoint(c) and (w := clause_weight(c, lexicon)) > 0]
    if not weights:
        return [0.0, 0.0, 0.0, 0.0, 0.0]
    total = sum(weights)
    return [min(max(weights), 12.0), min(log(1 + total), 6.0), min(len(weights), 6), 1.0, min(total * 50 / len(words), 12.0)]


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([[*evidence(t, self.lexicon), 1.0] for t in texts]).reshape(len(texts), 6)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))

    @classmethod
    def fit(cls, texts: list[str], y: np.ndarray, sizes: dict[int, int]) -> Model:
        """``sizes``: learning rows of each label before sampling."""
        # Evidence of each part comes from a lexicon learned on the others, as with new texts.
        sample = Sample(texts, y)
        part = np.arange(len(texts)) % PARTS
        x = np.zeros((len(texts), 6))
        for h in range(PARTS):
            other = Lexicon.learn(sample, part != h)
            for i in np.flatnonzero(part == h):
                x[i] = [*evidence(texts[i], other), 1.0]
        count = np.bincount(y, minlength=2)
        weight = np.array([sizes.get(k, 0) / max(count[k], 1) for k in (0, 1)])[y]
        weight /= max(weight.mean(), 1e-9) if len(weight) else 1
        # A weak prior at the odds that the seed words have on their own.
        prior = np.array([0.4, 0.8, 0.1, 0.5, 0.1, -3.0])
        w = prior.copy()

        def loss(v: np.ndarray) -> float:
            z = x @ v
            return float((weight * (np.logaddexp(0, z) - y * z)).sum() + ((v - prior) ** 2).sum())

        for _ in range(60):  # Newton steps, halved until the convex loss falls
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            gradient = x.T @ (weight * (p - y)) + 2.0 * (w - prior)
            curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 2.0 * np.eye(6)
            step = np.linalg.solve(curve, gradient)
            before, size = loss(w), 1.0
            while size > 1e-6 and loss(w - size * step) > before:
                size /= 2
            w -= size * step
            if np.abs(size * step).max() < 1e-8:
                break
        return cls(Lexicon.learn(sample, part >= 0), w)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from at most PER_CLASS texts of each label outside the held-out fold."""
    rows, sizes = labelled_sample(docs, labels, "toxic", folds=FOLDS, held_out=HELD_OUT, per_class=PER_CLASS, max_bytes=MAX_BYTES)
    return Model.fit([t for t, _ in rows], np.array([y for _, y in rows], dtype=int), sizes)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below REJECT, with all their columns; see ``keep_rows``."""
    return keep_rows(docs, lambda texts: model.scores(texts) < REJECT)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    Null texts score like empty ones, repeated rows alike, and a null doc_id is not held out. A score of exactly
    REJECT is predicted 1. Without labels the seed words alone decide. An empty table gives an empty result; no
    other column is looked at.
    """
    held = docs.select("doc_id", "text", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"))
    out = score_column(held, model.scores, ["doc_id", "held_out"], "score")
    return out.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
