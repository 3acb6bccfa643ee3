"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte n-grams (2 to 4 bytes of its lower-cased letters), weighted by
TF-IDF and scaled to length one. Training clusters the vectors of each language by spherical k-means;
a text gets the language of the centroid with the highest cosine. ``score`` is the softmax of the best
cosine per language; a ``distance`` (1 - cosine) beyond ``reject_beyond`` is ``rejected``. Unless the caller
gives that distance, it is calibrated on the sample: a share of ``REJECT`` of its texts lies beyond.

Document frequencies are counted over all texts that may be learned from. The centroids are fitted on
a bounded sample: at most ``fit_rows`` texts per language of at most ``fit_chars`` characters, the first by a
hash of their text. The hash below which enough texts lie is estimated first (distinct hashes are counted by
sketches), so only the sample's texts leave their partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm._common import batches_of, text_parts

BUCKETS = 1 << 12
#: Bytes of a text whose grams are counted at once.
PART = 1 << 20
#: Texts per language for the centroids, and their greatest length in characters.
FIT_ROWS, FIT_CHARS = 600, 50_000
#: Share of the sample that lies beyond the calibrated distance; smaller samples than this give none, and nothing is rejected.
REJECT, CALIBRATE = 0.002, 100
UNKNOWN = "und"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Everything that is neither a letter nor part of a non-ASCII character becomes one blank.
_LOWER[[b for b in range(128) if not chr(b).isalpha()]] = 32


def _folded(data: np.ndarray) -> np.ndarray:
    """One text's bytes: lower case, runs of other characters as one blank, a blank around; empty without letters."""
    low = _LOWER[data]
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
    low = low[keep]
    if not len(low) or (len(low) == 1 and low[0] == 32):
        return np.empty(0, np.uint8)
    return np.concatenate([[32], low, [32]]).astype(np.uint8)


def gram_buckets(data: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the 2-, 3- and 4-grams of one text's bytes, some millions at once; each gram once, also at the cuts."""
    whole = _folded(data)
    for lo in range(0, max(0, len(whole) - 1), PART):
        low = whole[lo : lo + PART + 3].astype(np.uint64)
        two = (low[:-1] << np.uint64(8)) | low[1:]
        three = (two[:-1] << np.uint64(8)) | low[2:]
        four = (three[:-1] << np.uint64(8)) | low[3:]
        mixed = np.concatenate([two[:PART], three[:PART] | np.uint64(1 << 33), four[:PART] | np.uint64(1 << 34)]) * np.uint64(0x9E3779B97F4A7C15)
        yield (mixed >> np.uint64(52)).astype(np.int64)


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of all buckets, one row per text."""
    out = np.zeros((len(offsets) - 1, BUCKETS), np.float32)
    for k in range(len(offsets) - 1):
        for grams in gram_buckets(data[offsets[k] : offsets[k + 1]]):
            out[k] += np.bincount(grams, minlength=BUCKETS)
    return out


@dataclass
class Model:
    languages: list[str]
    of: np.ndarray  # language of each centroid
    centroids: np.ndarray  # rows of length one
    idf: np.ndarray
    sharpness: float
    reject_beyond: float | None

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def cosines(self, counts: np.ndarray) -> np.ndarray:
        """The highest cosine of each text with a centroid of each language."""
        every = self.vectors(counts) @ self.centroids.T
        return np.stack([every[:, self.of == k].max(axis=1) for k in range(len(self.languages))], axis=1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centroids of length one; begins with far points, so clusters are distinct."""
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(x)))]
    nearest = x @ x[chosen[0]]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, x @ x[chosen[-1]])
    centers = x[chosen].copy()
    for _ in range(rounds):
        own = np.argmax(x @ centers.T, axis=1)
        for c in range(len(centers)):
            if (own == c).any():
                centers[c] = x[own == c].mean(axis=0)
        centers /= np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
    return centers


def document_frequencies(docs: DataFrame, text: str = "text") -> np.ndarray:
    """In how many texts each bucket occurs; the last entry is the number of texts. All rows count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for _, data, offsets in batches_of(batches, "t"):
            for k in range(len(offsets) - 1):
                seen = np.zeros(BUCKETS, bool)
                for grams in gram_buckets(data[offsets[k] : offsets[k + 1]]):
                    seen[grams] = True
                total[:-1] += seen
            total[-1] += len(offsets) - 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["b", "n"])

    rows = docs.select(F.col(text).alias("t")).mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS + 1, np.int64)  # at most BUCKETS + 1 rows come back
    for r in rows:
        out[r["b"]] = r["n"]
    return out


def sample_of(rows: DataFrame, fit_rows: int, fit_chars: int) -> pa.Table:
    """(l, t): at most ``fit_rows`` distinct texts of each language of ``rows`` (l, t), the first by hash."""
    short = rows.where(F.length("t").between(1, fit_chars)).withColumn("h", F.shiftrightunsigned(F.xxhash64("t"), 11))
    # A sketch counts a language's distinct texts; a fifth more than needed, as it errs by some hundredths. One row a language.
    sizes = {r["l"]: r["n"] for r in short.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    edges = [(name, int(min(1.0, 1.2 * (fit_rows + 40) / max(1, n)) * (1 << 53))) for name, n in sizes.items()]
    if not edges:
        return rows.limit(0).toArrow()
    edges = rows.sparkSession.createDataFrame(edges, "e string, edge long")
    some = short.join(F.broadcast(edges), (F.col("l") == F.col("e")) & (F.col("h") <= F.col("edge"))).select("l", "h", "t").dropDuplicates(["l", "h"])
    found = some.toArrow().sort_by([("l", "ascending"), ("h", "ascending")])  # about 1.2 * fit_rows texts a language
    names = found.column("l").to_pylist()
    first = {name: k for k, name in reversed(list(enumerate(names)))}
    return found.select(["l", "t"]).filter(pa.array([k - first[name] < fit_rows for k, name in enumerate(names)], pa.bool_()))


def fit(labelled: DataFrame, *, text: str = "text", lang: str = "lang", per_language: int = 4, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS, reject_beyond: float | None = None) -> Model | None:
    """Centroids of all languages in ``labelled`` (rows with null text or language are left out); None without any."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"))
    counts = document_frequencies(rows, "t")
    idf = np.log((1 + counts[-1]) / (1 + counts[:-1])).astype(np.float32) + np.float32(0.1)
    sample = sample_of(rows, fit_rows, fit_chars)
    model = Model([], np.empty(0, int), np.empty((0, BUCKETS), np.float32), idf, 1.0, reject_beyond)
    vectors, labels = [], np.array(sample.column("l").to_pylist(), object)
    for batch in sample.to_batches():
        data, offsets = text_parts(batch.column(1))
        if len(batch):
            vectors.append(model.vectors(term_counts(data, offsets)))
    if not len(labels):
        return None
    x = np.concatenate(vectors)
    model.languages = sorted(set(labels))
    parts = [spherical_kmeans(x[labels == name], per_language) for name in model.languages]
    model.centroids = np.concatenate(parts).astype(np.float32)
    model.of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    # How sharp the softmax must be for the sample's labels to be as likely as possible.
    best = np.stack([(x @ model.centroids[model.of == k].T).max(axis=1) for k in range(len(parts))], axis=1)
    own = np.array([model.languages.index(v) for v in labels])
    losses = {}
    for sharp in (1, 2, 5, 10, 20, 40, 80):
        z = best * sharp
        losses[sharp] = float((np.log(np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)) + z.max(axis=1) - z[np.arange(len(own)), own]).mean())
    model.sharpness = float(min(losses, key=losses.get))
    if reject_beyond is None and len(x) >= CALIBRATE:
        # Distances of one half to centroids of the other: a centroid is too near to the texts that made it.
        fitted = np.concatenate([spherical_kmeans(half, per_language) for name in model.languages if len(half := x[1::2][labels[1::2] == name])])
        model.reject_beyond = float(np.quantile(1 - (x[::2] @ fitted.T).max(axis=1), 1 - REJECT))
    return model


def predict(docs: DataFrame, model: Model | None, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, nearest, score, distance, rejected for every row; whole texts are read.

    ``nearest`` is the language of the nearest centroid; ``und`` (score 0) if the text is null or has no letter,
    or if there is no model. ``lang_pred`` is ``und`` also where that centroid is farther than the model's
    ``reject_beyond``. Ties go to the first language by name.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, data, offsets in batches_of(batches, "t"):
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                n = len(part)
                letters = np.array(part.column(2).to_pylist(), bool)
                names, scores, far = [UNKNOWN] * n, np.zeros(n), np.ones(n)
                if m is not None:
                    own = offsets[lo : lo + n + 1]
                    best = m.cosines(term_counts(data, own)).astype(float)
                    odds = np.exp((best - best.max(axis=1, keepdims=True)) * m.sharpness)
                    top = best.argmax(axis=1)
                    far = np.where(letters, 1 - best.max(axis=1), 1.0)
                    scores = np.where(letters, odds.max(axis=1) / odds.sum(axis=1), 0.0)
                    names = [m.languages[k] if ok else UNKNOWN for k, ok in zip(top, letters, strict=True)]
                beyond = [m is not None and m.reject_beyond is not None and bool(d > m.reject_beyond) for d in far]
                kept = [UNKNOWN if b else x for x, b in zip(names, beyond, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(far, pa.float64()), pa.array(beyond, pa.bool_())], ["doc_id", "lang_pred", "nearest", "score", "distance", "rejected"])

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"), F.coalesce(F.regexp_like(text, F.lit(r"\p{L}")), F.lit(False)).alias("letters"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, nearest string, score double, distance double, rejected boolean")
