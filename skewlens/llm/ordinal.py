"""Quality classifier: cumulative-link regression on graded ratings.

A text is the set of its words and of their shapes (case, marks at the end,
digits), hashed to ``SIZE`` features. The features that tell the grades apart get a
weight: those whose log-likelihood ratio over the rated texts would pass for one of
all seen features by chance with ``ERROR`` at most. The bound does not grow with the
sample, so more ratings make rarer words telling. x is the mean over those that a
text has, each by its strength, the squared information on the grade that a text
with it gives: one strong word among thousands of faint ones decides as much as in a short
text, and ten decide no more than one.
One weight vector w is shared by all grades; with ordered thresholds t_1 < t_2
the chance of grade k or better is 1 / (1 + exp(t_k - w.x)). From these tail
probabilities follow the expected grade and the selection.

Grades come from the labels: 0 low quality, 1 good but toxic, 2 good. The model
is fitted on at most ``MAX_RATED`` rated documents, those with the smallest
seeded hash of their doc_id, in one task; every document is scored.

Defined cases. A null or empty text has no features and gets the score 0. Rated
rows without quality, without doc_id or without a document are not used; a null
toxic counts as 0; a document rated twice counts twice. Ties of the hash go to the
smaller doc_id. Without any rated document all weights are 0 and the grades are
equally likely. An empty table of documents gives an empty result. Repeated rows
are scored each. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import column

BITS = 18
SIZE = 1 << BITS
GRADES = 3
MAX_RATED = 8000
SEED = 5
TOP = SIZE            # every feature that passes gets a weight
ERROR = 0.05          # the chance that any feature passes that tells nothing
STEPS = 300
RATE = 0.05
DECAY = 1e-5
CACHED_WORDS = 300_000
MIN_TAIL = 0.5        # of the best grade, for a document to be kept
PIECE = 512

_WORDS: dict[str, tuple[int, int]] = {}


def word_features(word: str) -> tuple[int, int]:
    """The features of a word: itself without case, and its shape."""
    core = word.rstrip("!?.,;:#*$%&|<>\"')]}")
    marks = word[len(core):]
    case = "U" if len(core) > 1 and core.isupper() else "t" if core[:1].isupper() else "l" if core.islower() else "n"
    kind = f"{case}{marks[:1]}{min(len(marks), 3)}{'d' if any(c.isdigit() for c in core) else ''}{'x' if len(core) > 24 else ''}"
    return xxhash.xxh32_intdigest(core.lower(), SEED) >> (32 - BITS), xxhash.xxh32_intdigest(kind, SEED + 1) >> (32 - BITS)


def features(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, distinct and sorted."""
    if len(_WORDS) > CACHED_WORDS:
        _WORDS.clear()
    rows, pairs = [], []
    get = _WORDS.get
    for i, text in enumerate(texts):
        words = set((text or "").split())
        if not words:
            continue
        for w in words:
            f = get(w)
            if f is None:
                f = word_features(w)
                if len(w) <= 64:
                    _WORDS[w] = f
            pairs += f
        rows.append((i, 2 * len(words)))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.repeat([r[0] for r in rows], [r[1] for r in rows])
    key = np.unique(at * SIZE + np.array(pairs, np.int64))
    return key // SIZE, key % SIZE


def scores(weights: np.ndarray, texts: list, strength: np.ndarray | None = None) -> np.ndarray:
    """x of each text; without ``strength`` all features with a weight are alike."""
    at, f = features(texts)
    used = weights[f] != 0
    at, f = at[used], f[used]
    return np.bincount(at, weights[f] * shares(at, f, len(texts), strength), len(texts)).astype(float)  # of no pairs: integers


def shares(at: np.ndarray, f: np.ndarray, n: int, strength: np.ndarray | None) -> np.ndarray:
    """The share of each (text, feature) pair in the mean of its text."""
    s = np.ones(len(f)) if strength is None else strength[f]
    return s / np.bincount(at, s, n)[at]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """(texts, GRADES - 1): the chance of each grade from 1 on, or better."""
    return _sigmoid(score[:, None] - thresholds[None, :])


def strengths(at: np.ndarray, f: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Squared information on the grade (in nats) that a text with the feature gives; 0 for features that get no weight."""
    seen = np.stack([np.bincount(f[grades[at] == g], minlength=SIZE) for g in range(GRADES)], axis=1).astype(float)
    texts = seen.sum(axis=1)
    ratio = (seen + 1e-300) / np.maximum(texts[:, None] * np.bincount(grades, minlength=GRADES) / len(grades), 1e-300)
    nats = np.where(seen > 0, seen * np.log(ratio), 0.0).sum(axis=1)
    # the chance of a ratio of 2 x nats or more is exp(-nats) for three grades, with few texts as well
    return np.where(nats >= np.log(max(1, np.count_nonzero(texts)) / ERROR), (nats / np.maximum(texts, 1)) ** 2, 0.0)


def fit(at: np.ndarray, f: np.ndarray, grades: np.ndarray, steps: int = STEPS, strength: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds): maximum likelihood by full-batch Adam, thresholds as a first one and positive gaps.

    Without ``strength`` the telling features are alike in the mean.
    """
    n = len(grades)
    weights, free = np.zeros(SIZE), np.array([-0.7] + [np.log(1.4)] * (GRADES - 2))
    if n == 0:
        return weights, np.log(np.arange(1, GRADES) / np.arange(GRADES - 1, 0, -1))
    used = (strengths(at, f, grades) if strength is None else strength)[f] > 0
    at, f = at[used], f[used]
    value = shares(at, f, n, strength)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, free)]
    rows = np.arange(n)
    for step in range(1, steps + 1):
        thresholds = free[0] + np.r_[0, np.cumsum(np.exp(free[1:]))]
        score = np.bincount(at, weights[f] * value, n)
        tail = np.c_[np.ones(n), tails(score, thresholds), np.zeros(n)]
        slope = tail * (1 - tail)
        chance = np.maximum(tail[rows, grades] - tail[rows, grades + 1], 1e-12)
        by_score = -(slope[rows, grades] - slope[rows, grades + 1]) / chance / n
        by_threshold = np.zeros(GRADES + 1)
        np.add.at(by_threshold, grades, slope[rows, grades] / chance / n)
        np.add.at(by_threshold, grades + 1, -slope[rows, grades + 1] / chance / n)
        t = by_threshold[1:GRADES]
        by_free = np.r_[t.sum(), [t[i:].sum() * np.exp(free[i]) for i in range(1, GRADES - 1)]]
        by_weights = np.bincount(f, by_score[at] * value, SIZE) + DECAY * weights
        for x, g, (m, v) in ((weights, by_weights, moments[0]), (free, by_free, moments[1])):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            x -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-10)
    return weights, free[0] + np.r_[0, np.cumsum(np.exp(free[1:]))]


def _features(batches):
    for b in batches:
        for i in range(0, b.num_rows, PIECE):
            piece = b.slice(i, PIECE)
            at, f = features(piece.column(2).to_pylist())
            offsets = np.searchsorted(at, np.arange(piece.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.ListArray.from_arrays(pa.array(offsets), pa.array(f.astype(np.int32)))], ["h", "grade", "f"])


def _fit(batches):
    """One task: the bounded sample in, one row with the model out. Rows are put in order, so reruns agree."""
    rows = sorted((h, g, f) for b in batches for h, g, f in zip(*(c.to_pylist() for c in b.columns)))
    at = np.repeat(np.arange(len(rows)), [len(r[2]) for r in rows])
    f = np.concatenate([np.array(r[2], np.int64) for r in rows]) if rows else np.empty(0, np.int64)
    graded = np.array([r[1] for r in rows], np.int64)
    strength = strengths(at, f, graded) if rows else np.zeros(SIZE)
    weights, thresholds = fit(at, f, graded, strength=strength)
    weights = np.stack([weights, np.where(weights != 0, strength, 0)])
    yield pa.RecordBatch.from_arrays(
        [pa.array([weights.astype("<f4").tobytes()], pa.binary()), pa.array([thresholds.tolist()], pa.list_(pa.float64()))], ["weights", "thresholds"])


def grades(labels: DataFrame) -> DataFrame:
    """doc_id, grade of the usable ratings."""
    grade = F.when(F.col("quality") <= 0, 0).when(F.coalesce("toxic", F.lit(0)) > 0, 1).otherwise(2)
    return labels.filter("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade"))


def train(docs: DataFrame, rated: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rated: int = MAX_RATED) -> tuple[np.ndarray, np.ndarray]:
    """(weights and strengths in two rows, thresholds) from doc_id, grade rows. The sample of at most ``max_rated`` rows is sent to the scan of ``docs``."""
    h = F.xxhash64("doc_id", F.lit(SEED))
    sample = rated.select(h.alias("h"), F.col("doc_id").alias("_id"), "grade").orderBy("h", "_id").limit(max_rated)
    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    found = d.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("h", "grade", "text")
    fitted = found.mapInArrow(_features, "h bigint, grade int, f array<int>").repartition(1).mapInArrow(_fit, "weights binary, thresholds array<double>")
    row = fitted.first()
    if row is None:
        weights, thresholds = fit(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        return np.stack([weights, weights]), thresholds
    return np.frombuffer(row[0], "<f4").astype(np.float64).reshape(2, SIZE), np.array(row[1])


OUT_SQL = "doc_id bigint, score double, expected_grade double, tail_1 double, tail_2 double, kept boolean"
OUT_NAMES = [f.split()[0] for f in OUT_SQL.split(", ")]


def _score(model):
    def run(batches):
        (weights, strength), thresholds = model.value
        for b in batches:
            for i in range(0, b.num_rows, PIECE):
                piece = b.slice(i, PIECE)
                score = scores(weights, piece.column(1).to_pylist(), strength)
                tail = tails(score, thresholds)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(score), pa.array(tail.sum(axis=1)), *(pa.array(tail[:, k]) for k in range(GRADES - 1)),
                     pa.array(tail[:, -1] >= MIN_TAIL)], OUT_NAMES)

    return run


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rated: int = MAX_RATED) -> DataFrame:
    """doc_id, score, expected_grade, tail_1, tail_2, kept: one row per row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, grades(labels), id_col, text_col, max_rated))
    d = docs.select(column(docs, id_col).cast("long").alias("doc_id"), column(docs, text_col).alias("text"))
    return d.mapInArrow(_score(model), OUT_SQL)
