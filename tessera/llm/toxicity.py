"""Toxicity severity by cumulative-link (proportional-odds) regression on sparse text features.

``P(grade <= k | x) = sigmoid(threshold_k - w . x)`` with one weight vector for all thresholds,
which stay in order by construction.  Features are rates of words and of word beginnings; Spark
counts in how many toxic and clean labelled texts each occurs, and the most telling are kept.

Labels above 1 are severities themselves.  Where labels are only 0 and 1, grades are made from them: clean
texts are 0, toxic ones 1 to ``grades`` by how densely they use words that stand out in toxic texts (equal
shares of the toxic sample), so there the order of severities is learnt from that construction and is no
more than it.  The sample is bounded by parameters; every document is then scored in its own task.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches, stage, texts

#: Labelled texts of each label that the model is fitted on, the first by a hash of the identifier.
SAMPLE = 6000
#: Features kept at most, in how many sampled texts one has to occur, and how telling it has to be: the least
#: weight that does best on a held-out quarter of the training sample.
FEATURES, MIN_DOCS, MIN_WEIGHTS = 4096, 3, (2.5, 5.0, 10.0, 20.0)
#: Levels of severity above clean.
GRADES = 3
_WORD = re.compile(r"[^\W\d_]+")
_BEGINNINGS = (4, 5, 6)


def word_counts(text: str) -> tuple[Counter, int]:
    """Counts of a text's words in lower case, and the number of words."""
    words = Counter(_WORD.findall(text.lower()))
    return words, sum(words.values())


def features_of(word: str) -> list[str]:
    """A word and its beginnings, marked by a star."""
    return [word, *(word[:k] + "*" for k in _BEGINNINGS if len(word) > k)]


def rate(count: float, words: int) -> float:
    """Occurrences in a hundred words, damped for long and many."""
    return min(4.0, float(np.log1p(100.0 * count / (words + 20.0))))


@dataclass
class OrdinalModel:
    features: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray

    def __post_init__(self) -> None:
        self._known: dict[str, tuple[int, ...]] = {}

    def vector(self, text: str) -> dict[int, float]:
        """Nonzero features of a text."""
        counts, n = word_counts(text)
        total: dict[int, int] = {}
        known, names = self._known, self.features
        for word, c in counts.items():
            ids = known.get(word)
            if ids is None:
                ids = tuple(names[f] for f in features_of(word) if f in names)
                if len(known) > 500_000:
                    known.clear()
                known[word] = ids
            for i in ids:
                total[i] = total.get(i, 0) + c
        return {i: rate(c, n) for i, c in total.items()}

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """A row for each score: the probability of each grade, 0 first."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))
        return np.diff(np.hstack([np.zeros((len(score), 1)), below, np.ones((len(score), 1))]), axis=1)

    def score(self, text: str) -> float:
        return sum(self.weights[i] * x for i, x in self.vector(text).items())


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, levels: int, l2: float = 2e-4, steps: int = 600, rate_: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds at the penalised maximum likelihood, by Adam steps on all
    of the sample.  ``rows, cols, values`` are the nonzero features; grades are 0..levels."""
    n = len(grades)
    share = np.array([(grades <= k).mean() for k in range(levels)])
    share = np.clip(share, 0.02, 0.98)
    start = np.log(share / (1 - share))
    # thresholds as the first and the logarithms of the gaps
    theta = np.concatenate([[start[0]], np.log(np.maximum(np.diff(start), 0.05)), np.zeros(n_features)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    is_low, is_high = grades == 0, grades == levels
    for t in range(1, steps + 1):
        gaps = np.exp(theta[1:levels])
        cut = theta[0] + np.concatenate([[0.0], np.cumsum(gaps)])
        w = theta[levels:]
        s = np.bincount(rows, weights=values * w[cols], minlength=n)
        upper = np.where(is_high, np.inf, cut[np.minimum(grades, levels - 1)] - s)
        lower = np.where(is_low, -np.inf, cut[np.maximum(grades - 1, 0)] - s)
        fu, fl = 1 / (1 + np.exp(-np.clip(upper, -40, 40))), 1 / (1 + np.exp(-np.clip(lower, -40, 40)))
        fu[is_high], fl[is_low] = 1.0, 0.0
        du, dl = fu * (1 - fu), fl * (1 - fl)
        p = np.maximum(fu - fl, 1e-12)
        gu, gl = -du / p, dl / p  # of the loss by the upper and the lower cut
        g_cut = np.zeros(levels)
        np.add.at(g_cut, grades[~is_high], gu[~is_high])
        np.add.at(g_cut, grades[~is_low] - 1, gl[~is_low])
        g_s = -(gu + gl)
        grad = np.empty_like(theta)
        grad[0] = g_cut.sum() / n
        grad[1:levels] = np.cumsum(g_cut[::-1])[::-1][1:] * gaps / n
        grad[levels:] = np.bincount(cols, weights=values * g_s[rows], minlength=n_features) / n + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= rate_ * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    cut = theta[0] + np.concatenate([[0.0], np.cumsum(np.exp(theta[1:levels]))])
    return theta[levels:], cut


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``row_id, toxic, body`` of at most ``sample`` labelled texts that are clean, and as many that aren't."""
    parts = []
    for chosen in (F.col("toxic") == 0, F.col("toxic") >= 1):
        of = labels.where(chosen).select(F.col("doc_id").alias("row_id"), F.col("toxic").cast("int").alias("toxic")).where("row_id is not null")
        parts.append(of.orderBy(F.xxhash64("row_id"), "row_id").limit(sample))
    chosen = parts[0].unionByName(parts[1])  # 2 * sample rows at most
    return docs.select(F.col("doc_id").alias("row_id"), F.col("text").alias("body")).join(F.broadcast(chosen), "row_id")


def feature_counts(sample: DataFrame) -> DataFrame:
    """``feature, toxic_docs, clean_docs``: in how many sampled texts each feature occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, toxic in zip(texts(batch, "body"), batch.column("toxic").to_pylist(), strict=True):
                seen.update((f, toxic > 0) for f in {f for w in word_counts(text)[0] for f in features_of(w)})
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in seen], pa.string()), pa.array([c if t else 0 for (_, t), c in seen.items()], pa.int64()), pa.array([0 if t else c for (_, t), c in seen.items()], pa.int64())],
                names=["feature", "toxic_docs", "clean_docs"])

    return sample.select("body", "toxic").mapInArrow(run, "feature string, toxic_docs long, clean_docs long").groupBy("feature").agg(F.sum("toxic_docs").alias("toxic_docs"), F.sum("clean_docs").alias("clean_docs"))


def _grades(toxic: np.ndarray, density: np.ndarray, grades: int) -> np.ndarray:
    """Severities as labelled, or else equal shares of the toxic texts by the density of their telling words."""
    if (toxic > 1).any():
        return np.minimum(toxic, grades)
    marks = np.quantile(density[toxic == 1], np.arange(1, grades) / grades)
    return np.where(toxic == 1, 1 + np.searchsorted(marks, density, side="left"), 0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, n_features: int = FEATURES, grades: int = GRADES, min_weights: tuple[float, ...] = MIN_WEIGHTS) -> OrdinalModel:
    """Fit on a bounded sample; ``labels`` has ``doc_id`` and ``toxic``, 0 for clean.  Without both kinds in it
    the model calls everything clean.  Which features are kept is decided within the sample."""
    rows = stage(training_sample(docs, labels, sample), "labelled")
    totals = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = totals.get(True, 0), totals.get(False, 0)
    if not n_toxic or not n_clean:
        return OrdinalModel({}, np.zeros(0), np.full(grades, 20.0) + np.arange(grades))
    a, b = (F.col("toxic_docs") + 0.5) / (n_toxic + 1.0), (F.col("clean_docs") + 0.5) / (n_clean + 1.0)
    evidence = F.log(a / b)
    # by how much the counts differ from what equal rates would give
    weight = F.abs(evidence) * F.sqrt(F.col("toxic_docs") + F.col("clean_docs") + 1.0)
    top = feature_counts(rows).where((F.col("toxic_docs") + F.col("clean_docs") >= MIN_DOCS) & (weight >= min(min_weights))).select("feature", evidence.alias("evidence"), weight.alias("weight")).orderBy(F.desc("weight"), "feature").limit(n_features).collect()
    names = {r["feature"]: i for i, r in enumerate(top)}
    telling = np.array([r["evidence"] > 1.5 for r in top], dtype=bool)
    model = OrdinalModel(names, np.zeros(len(names)), np.zeros(grades))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [model.vector(t) for t in texts(batch, "body")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), batch.column("toxic"), pa.array([list(x) for x in vectors], pa.list_(pa.int32())), pa.array([list(x.values()) for x in vectors], pa.list_(pa.float64()))],
                names=["row_id", "toxic", "cols", "vals"])

    got = rows.select("row_id", "toxic", "body").mapInArrow(run, "row_id long, toxic int, cols array<int>, vals array<double>").collect()
    got.sort(key=lambda r: (r["row_id"], r["toxic"], r["cols"]))
    at = np.repeat(np.arange(len(got)), [len(r["cols"]) for r in got])
    cols = np.array([c for r in got for c in r["cols"]], dtype=np.int64)
    vals = np.array([v for r in got for v in r["vals"]])
    toxic = np.array([r["toxic"] for r in got])
    density = np.bincount(at, weights=vals * telling[cols], minlength=len(got)) if len(cols) else np.zeros(len(got))
    grade = _grades(toxic, density, grades)
    held = np.arange(len(got)) % 4 == 3  # rows are in the order of their identifiers

    def fit(use: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        of = use[at] & (cols < most)
        place = np.cumsum(use) - 1
        return fit_ordinal(place[at[of]], cols[of], vals[of], grade[use], most, grades)

    # features descend by weight, so a least weight is a number of features
    sizes = sorted({sum(r["weight"] >= w for r in top) for w in min_weights})
    best = (-1.0, 0)
    for most in sizes if len(sizes) > 1 and (toxic[held] > 0).any() and (toxic[~held] > 0).any() else []:
        w, cut = fit(~held, most)
        score = np.bincount(at, weights=vals * np.append(w, np.zeros(len(top) - most))[cols], minlength=len(got))
        called = score[held] >= cut[0]
        want = toxic[held] > 0
        share = called[want].mean() - (10 * called[~want].mean() if (~want).any() else 0.0)  # a false alarm costs ten misses
        best = max(best, (float(share), -most))
    most = -best[1] if best[0] > -1 else sizes[0]
    weights, model.thresholds = fit(np.ones(len(got), dtype=bool), most)
    model.weights = np.append(weights, np.zeros(len(top) - most))
    return model


def score_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, severity, grade, p_toxic, toxic`` for every row, without a shuffle.

    Severity is the expected grade, ``p_toxic`` the probability of a grade above 0, and ``toxic``
    whether that is at least a half.  Null and empty texts have no feature.  Repeated rows and null
    identifiers pass through; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.arange(len(model.thresholds) + 1)
        for batch in batches:
            p = model.probabilities(np.array([model.score(t) for t in texts(batch, "body")], dtype=float))
            toxic = 1 - p[:, 0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_id"), pa.array(p @ levels), pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(toxic), pa.array(toxic >= 0.5)],
                names=["row_id", "severity", "grade", "p_toxic", "toxic"])

    out = limit_batches(docs).select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("body")).mapInArrow(run, "row_id long, severity double, grade int, p_toxic double, toxic boolean")
    return out.withColumnRenamed("row_id", id_col)
