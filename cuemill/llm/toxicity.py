"""Toxicity with a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel compares words by their common subsequences of three letters, also with gaps: a subsequence
that spans n letters weighs DECAY ** n (n up to SPAN), so "idiot", "idiiot", "id-iot" and "i d i o t" stay
close. It is divided by the two words' own weights, which depend on their lengths. Landmarks are words of
labelled texts; a word's Nyström features are its kernel values with the landmarks times the inverse root
of the landmarks' kernel matrix. A linear SVM on them scores words, and a text scores as its most toxic
word does, through a logistic curve fitted on texts.

Labels belong to texts, not words, so training alternates (multiple-instance SVM): pick the word of each
toxic text that scores highest, add the words of clean texts that score highest, fit, again. Because the
kernel has explicit features, the fitted sum over landmarks is one table over three-letter codes: a word
costs a few look-ups however many landmarks there are.

The classifier is fitted on a bounded sample: at most ``fit_rows`` distinct labelled texts per class with at
most ``fit_chars`` characters, chosen by hash. Scoring reads every whole text.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm._common import give_back, without_rows

#: Labelled texts per class for the fit, and their greatest length in characters.
FIT_ROWS, FIT_CHARS = 1000, 20_000
DECAY, SPAN = 0.6, 7
LANDMARKS = 240
#: Longer words are scored in overlapping pieces of this length.
WORD = 24
#: Words a task remembers the scores of, and words that it scores together.
CACHE, TOGETHER = 150_000, 8_000
_GAP = "\0" * SPAN
_PARTS = re.compile(r"[^\W\d_]+")
_SPELT = re.compile(r"(?<![^\W\d_])[^\W\d_](?:[\W\d_]{1,3}[^\W\d_](?![^\W\d_])){2,}")


def words_of(token: str) -> list[str]:
    """The letters of a token as one word; also its runs of letters, if other characters lie between them."""
    if token.isalpha():
        parts = [token]
    else:
        runs = _PARTS.findall(token)
        parts = [*runs, "".join(runs)] if len(runs) > 1 else runs
    return [p[k : k + WORD] for p in parts for k in range(0, max(1, len(p) - WORD // 2), WORD // 2)]


def tokens_of(text: str) -> set[str]:
    """Distinct tokens of a text in lower case, and words spelt letter by letter."""
    low = text.lower()
    tokens = set(low.split())
    if sum(1 for t in tokens if len(t.strip(".,;:!?-*_")) == 1) >= 2:
        tokens.update("".join(_PARTS.findall(m)) for m in _SPELT.findall(low))
    return tokens


@dataclass
class Kernel:
    """Letter codes and weights of the three-letter subsequences."""

    letters: np.ndarray  # code (1 to 63) of each UTF-16 unit

    @classmethod
    def of(cls, counts: Counter) -> Kernel:
        letters = np.full(1 << 16, 63, np.int32)
        letters[0] = 0
        for k, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:62]):
            letters[ord(c) & 0xFFFF] = k + 1
        return cls(letters)

    def codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words' codes in one array with gaps of zeros, where words begin in it, and words' lengths."""
        units = np.frombuffer((_GAP.join(words) + _GAP).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begins = np.concatenate([[0], np.cumsum(sizes + SPAN)[:-1]]) if len(words) else sizes
        return self.letters[units & 0xFFFF], begins, sizes

    @staticmethod
    def triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """For each pair of gaps: positions that begin a triple, the triples' codes, their weight."""
        for b in range(2, SPAN):
            at = np.flatnonzero((codes[:-b] > 0) & (codes[b:] > 0))
            ends = (codes[at] << 12) | codes[at + b]
            for a in range(1, b):
                yield at, ends | (codes[at + a] << 6), DECAY ** (b + 1)

    @staticmethod
    def norms(sizes: np.ndarray) -> np.ndarray:
        squares = sum(np.maximum(sizes - b, 0) * (b - 1) * DECAY ** (2 * (b + 1)) for b in range(2, SPAN))
        return np.sqrt(np.maximum(squares, 1e-12))

    def against(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Sum of ``table`` (one value per code) over each word's weighted subsequences, over its norm."""
        if not words:
            return np.zeros(0)
        codes, begins, sizes = self.codes(words)
        total = np.zeros(len(codes))
        for at, code, weight in self.triples(codes):
            total[at] += weight * table[code]
        return np.where(sizes >= 3, np.add.reduceat(total, begins) / self.norms(sizes), 0.0)

    def table(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """The weighted sum of words' features, by code."""
        codes, begins, sizes = self.codes(words)
        share = np.repeat(weights / self.norms(sizes) * (sizes >= 3), sizes + SPAN)
        out = np.zeros(1 << 18)
        for at, code, weight in self.triples(codes):
            out += np.bincount(code, share[at] * weight, minlength=1 << 18)
        return out

    def matrix(self, words: list[str], landmarks: list[str]) -> np.ndarray:
        """Kernel values of all words with all landmarks."""
        codes, begins, sizes = self.codes(landmarks)
        owner = np.repeat(np.arange(len(landmarks)), sizes + SPAN)
        found = [(owner[at], code, np.full(len(at), weight)) for at, code, weight in self.triples(codes)]
        own, code, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        known, row = np.unique(code, return_inverse=True)
        features = np.zeros((len(known) + 1, len(landmarks)), np.float32)
        np.add.at(features, (row + 1, own), weight)
        place = np.zeros(1 << 18, np.int32)
        place[known] = np.arange(1, len(known) + 1)
        out = np.zeros((len(words), len(landmarks)))
        for lo in range(0, len(words), 1000):
            part = words[lo : lo + 1000]
            codes, begins, sizes_of = self.codes(part)
            word = np.repeat(np.arange(len(part)), sizes_of + SPAN)
            found = [(word[at], place[code], np.full(len(at), weight, np.float32)) for at, code, weight in self.triples(codes)]
            own, rows, weight = (np.concatenate(x) for x in zip(*found, strict=True))
            own, rows, weight = own[rows > 0], rows[rows > 0], weight[rows > 0]
            turn = np.argsort(own, kind="stable")
            own, rows, weight = own[turn], rows[turn], weight[turn]
            firsts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else np.empty(0, int)
            if len(firsts):
                out[lo + own[firsts]] = np.add.reduceat(features[rows] * weight[:, None], firsts, axis=0)
            out[lo : lo + 1000] /= self.norms(sizes_of)[:, None]
        return out / self.norms(sizes)


@dataclass
class Model:
    kernel: Kernel
    table: np.ndarray
    bias: float
    slope: float
    shift: float

    def words(self, words: list[str]) -> np.ndarray:
        return self.kernel.against(words, self.table) + self.bias

    def score(self, value: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -30, 30))))


def linear_svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM by Newton steps on the rows inside the margin; y is -1 or 1."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    inside = np.ones(len(x), bool)
    for _ in range(rounds):
        part = x[inside] * cost[inside, None]
        w = np.linalg.solve(ridge + part.T @ x[inside], part.T @ y[inside])
        now = y * (x @ w) < 1
        if (now == inside).all():
            break
        inside = now
    return w[:-1], float(w[-1])


def logistic(values: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the likeliest logistic curve, slightly regularised."""
    a, b = 1.0, 0.0
    smooth = np.where(labels > 0, 1 - 1 / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * values + b, -30, 30)))
        d, h = p - smooth, np.maximum(p * (1 - p), 1e-6)
        g = np.array([(d * values).sum() + 1e-3 * a, d.sum()])
        m = np.array([[(h * values**2).sum() + 1e-3, (h * values).sum()], [(h * values).sum(), h.sum() + 1e-9]])
        step = np.linalg.solve(m, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def disguise(word: str, rng: np.random.Generator) -> str:
    """The word with one letter doubled or another one put in, as training examples of such spellings."""
    at = int(rng.integers(1, len(word)))
    return word[:at] + (word[at - 1] if rng.random() < 0.4 else chr(97 + int(rng.integers(26)))) + word[at:]


def fit_texts(toxic: list[str], clean: list[str], *, rounds: int = 4, seed: int = 11) -> Model | None:
    """Fit on texts with label 1 and label 0; None if a class is missing."""
    split = lambda text: sorted({w for t in tokens_of(text) for w in words_of(t) if len(w) >= 3})
    bad, good = [x for x in map(split, toxic) if x], [x for x in map(split, clean) if x]
    if not bad or not good:
        return None
    rng = np.random.default_rng(seed)
    counts = Counter(c for x in (*bad, *good) for w in x for c in w)
    kernel = Kernel.of(counts)
    # First guess: the word with the four letters in a row that most set toxic texts apart.
    grams = lambda x: {w[k : k + 4] for w in x for k in range(max(1, len(w) - 3))}
    in_bad, in_good = Counter(), Counter()
    for x in bad:
        in_bad.update(grams(x))
    for x in good:
        in_good.update(grams(x))
    odds = lambda g: np.log((in_bad[g] + 0.1) / (len(bad) + 1)) - np.log((in_good[g] + 0.5) / (len(good) + 1)) + 0.3 * np.log(in_bad[g] + 1)
    picks = [max(x, key=lambda w: (max(odds(g) for g in grams([w])), w)) for x in bad]
    vocabulary = sorted({w for x in good for w in x})
    place = {w: k for k, w in enumerate(vocabulary)}
    hard = list(rng.permutation(vocabulary)[:4000])
    model = None
    for _ in range(rounds):
        common = [w for w, _ in Counter(picks).most_common()]
        positives = common[: LANDMARKS // 2] if len(common) <= LANDMARKS else [*common[: LANDMARKS // 4], *rng.choice(common[LANDMARKS // 4 :], LANDMARKS // 4, replace=False)]
        negatives = list(rng.choice(hard, min(len(hard), LANDMARKS - len(positives)), replace=False))
        landmarks = [*dict.fromkeys([*positives, *negatives])]
        square = kernel.matrix(landmarks, landmarks)
        values, vectors = np.linalg.eigh((square + square.T) / 2)
        root = vectors * (1 / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
        chosen = [*dict.fromkeys(picks)]
        bent = [disguise(w, rng) for w in (*common[:400], *common[:100])]
        sample = [*chosen, *bent, *hard]
        x = kernel.matrix(sample, landmarks) @ root
        y = np.r_[np.ones(len(chosen) + len(bent)), -np.ones(len(hard))]
        weigh = Counter(picks)
        cost = np.r_[[weigh[w] ** 0.5 for w in chosen], np.full(len(bent), 0.5), np.ones(len(hard))]
        cost[y > 0] *= 0.5 * len(hard) / cost[y > 0].sum()
        w, bias = linear_svm(x, y, cost)
        model = Model(kernel, kernel.table(landmarks, root @ w), bias, 1.0, 0.0)
        of_good = model.words(vocabulary)
        tops = [x[int(np.argmax(v))] for x, v in ((x, model.words(x)) for x in bad)]
        worst = np.argsort(-of_good)[:1500]
        hard = sorted({*(vocabulary[k] for k in worst), *rng.permutation(vocabulary)[:3000]})
        if tops == picks:
            break
        picks = tops
    values = np.r_[[model.words(x).max() for x in bad], [max(of_good[place[w]] for w in x) for x in good]]
    model.slope, model.shift = logistic(values, np.r_[np.ones(len(bad)), np.zeros(len(good))])
    return model


def fit(docs: DataFrame, labels: DataFrame, *, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    """Fit on documents with labels (null labels are left out; of repeated labels the largest counts)."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k")).agg((F.max(label) > 0).cast("int").alias("y"))
    # Keys are chosen before texts are read; twice as many, since some texts are too long.
    some = [known.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(2 * fit_rows) for y in (0, 1)]
    rows = docs.where(F.length(text).between(1, fit_chars)).select(F.col(key).alias("d"), F.col(text).alias("t"))
    found = rows.join(F.broadcast(some[0].unionByName(some[1])), F.col("d") == F.col("k")).select("y", "t").dropDuplicates(["y", "t"]).collect()
    sample = {y: sorted((r["t"] for r in found if r["y"] == y), key=lambda t: zlib.crc32(t.encode()))[:fit_rows] for y in (0, 1)}
    return fit_texts(sample[1], sample[0])


def _scored(batches: Iterator[pa.RecordBatch], text: str, m: Model | None) -> Iterator[tuple[pa.RecordBatch, list[float], list[str | None]]]:
    """Slices of the batches with each row's score and the word that decided."""
    known: dict[str, float] = {}
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text))
        lo = 0
        while lo < len(batch):
            sets, fresh, size, hi = [], set(), 0, lo
            while hi < len(batch) and (hi == lo or size < 1 << 20):
                words = texts[hi].as_py() or ""
                tokens = tokens_of(words) if m is not None else set()
                fresh.update(t for t in tokens if t not in known)
                sets.append(tokens)
                size += len(words)
                hi += 1
            if fresh:
                if len(known) + len(fresh) > CACHE:
                    known = {}
                    fresh = set().union(*sets)
                tokens = list(fresh)
                for first in range(0, len(tokens), TOGETHER):
                    some = tokens[first : first + TOGETHER]
                    parts = [words_of(t) for t in some]
                    values = m.words([w for p in parts for w in p])
                    at = 0
                    for t, p in zip(some, parts, strict=True):
                        known[t] = float(values[at : at + len(p)].max(initial=m.bias))
                        at += len(p)
            worst = [max(s, key=lambda t: (known[t], t)) if s else None for s in sets]
            yield batch.slice(lo, hi - lo), [0.0 if m is None else m.score(m.bias if w is None else known[w]) for w in worst], worst
            lo = hi


def score(docs: DataFrame, model: Model | None, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score, predicted, worst (the word that decided) for every row.

    A null text is empty. A text without a word of three letters scores as the least toxic word does;
    without a model every score is 0. Repeated rows get equal scores; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores, worst in _scored(batches, "t", shared.value):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(worst, pa.string())], ["doc_id", "score", "predicted", "worst"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, score double, predicted int, worst string")


def without_toxic(docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """``docs`` without the rows that are predicted toxic; same columns.

    Each row is judged by its own text in the pass that scores it, so nothing is shuffled, null keys are
    like others, and repeated rows share their fate. Null texts stay unless the empty text is toxic.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores, _ in _scored(batches, text, shared.value):
            yield without_rows(part, np.array(scores) >= 0.5)
        give_back()

    return docs.mapInArrow(run, docs.schema)
