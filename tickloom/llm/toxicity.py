"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

P(grade <= k) = sigmoid(t_k - w.x): one weight vector w is shared by all ordered thresholds t_0 < t_1 < ... A document's
features are the words that it has and the beginnings (4 to 6 letters) of these words; a feature's value is the number of
distinct words that carry it, so that w.x is a sum over distinct words. Weights are fitted with an L1 penalty on a
bounded sample of labelled documents. Every whole text is then given the probability of each grade and the expected
severity.

Cases: a null or empty text has no feature and gets the grade that the thresholds alone give; labels that are null, out of
range or of no document play no part; of several labels of one id the most severe counts, of several texts the first in order;
without labels of two grades every document has severity 0; repeated rows and rows with a null id are scored each for itself;
texts of any length are read whole; ties go to the lower grade; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.shared import bounded_batches, slices

#: Bound of the labelled sample, per label value; the classifier alone is fitted on it.
SAMPLE_PER_LABEL = 2000
#: Grades are 0 to one less than this.
MOST_GRADES = 10
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W_]+")


def features_of(chunk: str) -> tuple[int, ...]:
    """Feature numbers of one white-space-separated part of a lower-cased text: even for words, odd for beginnings."""
    out = []
    for word in _WORD.findall(chunk):
        out.append(xxhash.xxh64_intdigest(word) >> 1 & ~1)
        out.extend(xxhash.xxh64_intdigest(word[:n]) >> 1 | 1 for n in PREFIXES if len(word) >= n)
    return tuple(dict.fromkeys(out))


def document_features(text: str | None) -> Counter:
    found: Counter = Counter()
    for chunk in set((text or "").lower().split()):
        found.update(features_of(chunk))
    return found


@dataclass
class Sample:
    """Features of the sampled documents: row, number and value of each, and 0/1 labels by row."""

    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray
    toxic: np.ndarray

    @classmethod
    def of(cls, features: list[Counter], toxic) -> Sample:
        row = np.repeat(np.arange(len(features)), [len(x) for x in features])
        keys = np.fromiter((f for x in features for f in x), np.int64, len(row))
        return cls(row, keys, np.fromiter((n for x in features for n in x.values()), np.float64, len(row)), np.asarray(toxic, int))


@dataclass
class OrdinalModel:
    """Non-zero weights and the ordered thresholds."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def grade_probabilities(self, margins: np.ndarray) -> np.ndarray:
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - margins[:, None], -40, 40)))
        edges = np.hstack([np.zeros((len(margins), 1)), below, np.ones((len(margins), 1))])
        return np.diff(edges, axis=1)


class _Margins(dict):
    """w.x of one part of a text, kept for the parts met before."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, chunk: str) -> float:
        value = self[chunk] = sum(self.weights.get(f, 0.0) for f in features_of(chunk))
        return value


def fit_ordinal(sample: Sample, grades: np.ndarray, levels: int, screen: float = 1e-3, relax: float = 1e-5) -> OrdinalModel:
    """Proximal adaptive-gradient descent: a strong L1 penalty picks the features, a weak one then sets their weights.

    Weights are 0 or more, a feature can only add severity, so that a long text does not outweigh what is toxic in it.
    Thresholds stay in order, since the logarithms of their gaps are fitted.
    """
    whole, column, df = np.unique(sample.feature, return_inverse=True, return_counts=True)
    names = np.flatnonzero((df >= 5) & (df <= 0.5 * len(grades)))
    for l1, rounds in ((screen, 100), (relax, 300)):
        place = np.full(len(whole), -1)
        place[names] = np.arange(len(names))
        use = place[column] >= 0
        w, t = _descend(sample.row[use], place[column[use]], sample.value[use], len(names), grades, levels, l1, rounds)
        names, w = names[w > 0], w[w > 0]
    return OrdinalModel(dict(zip(whole[names].tolist(), w.tolist(), strict=True)), t)


def _descend(row, column, value, features, grades, levels, l1, rounds):
    n = len(grades)
    below = np.clip(np.array([(grades <= k).mean() for k in range(levels - 1)]), 1e-3, 1 - 1e-3)
    start = np.log(below / (1 - below))
    base, gaps = start[0], np.log(np.maximum(np.diff(start), 1e-2))
    w, seen = np.zeros(features), np.full(features, 1e-8)
    seen_t = np.full(levels - 1, 1e-8)
    for _ in range(rounds):
        t = base + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))
        m = np.bincount(row, value * w[column], n)
        high, low = np.concatenate((t, [np.inf]))[grades], np.concatenate(([-np.inf], t))[grades]
        high_s, low_s = (1 / (1 + np.exp(-np.clip(e - m, -40, 40))) for e in (high, low))
        p = np.maximum(high_s - low_s, 1e-12) * n
        high_d, low_d = high_s * (1 - high_s), low_s * (1 - low_s)
        g_w = np.bincount(column, value * ((high_d - low_d) / p)[row], features)
        g_t = np.array([(low_d / p)[grades == k + 1].sum() - (high_d / p)[grades == k].sum() for k in range(levels - 1)])
        g = np.concatenate(([g_t.sum()], [g_t[k + 1 :].sum() * np.exp(gaps[k]) for k in range(levels - 2)]))
        seen_t += g * g
        step = 0.2 * g / np.sqrt(seen_t)
        base, gaps = base - step[0], gaps - step[1:]
        seen += g_w * g_w
        w = np.maximum(w - 0.3 / np.sqrt(seen) * (g_w + l1), 0)
    return w, base + np.concatenate(([0.0], np.cumsum(np.exp(gaps))))


def severity_grades(sample: Sample) -> np.ndarray:
    """The scale where labels say no more than toxic or not. 0: not toxic. A toxic document is graded by how many of its distinct
    words tell it from clean ones, that is, carry a feature with log odds over 3 (a word) or 4 (a beginning): 1 up to
    two words, 2 up to five, 3 above."""
    toxic = sample.toxic
    names, column = np.unique(sample.feature, return_inverse=True)
    yes = np.bincount(column[toxic[sample.row] == 1], minlength=len(names))
    no = np.bincount(column[toxic[sample.row] == 0], minlength=len(names))
    odds = np.log((yes + 0.5) / (toxic.sum() + 1)) - np.log((no + 0.5) / ((1 - toxic).sum() + 1))
    words, starts = (yes >= 5) & (odds > 3) & (names % 2 == 0), (yes >= 5) & (odds > 4) & (names % 2 == 1)
    hits = np.bincount(sample.row[words[column]], sample.value[words[column]], len(toxic))
    np.maximum.at(hits, sample.row[starts[column]], sample.value[starts[column]])
    return np.where(toxic == 0, 0, np.where(hits <= 2, 1, np.where(hits <= 5, 2, 3)))


def fit(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL, grade: str = "toxic") -> OrdinalModel:
    """About `per_label` labelled documents of each grade are read; as many of all, so that rarity doesn't hide toxic ones.

    labels has doc_id and `grade`: whole numbers from 0, in rising severity, or only 0 and 1, which severity_grades then spreads.
    """
    known = labels.where(f"doc_id IS NOT NULL AND {grade} BETWEEN 0 AND {MOST_GRADES - 1}").groupBy("doc_id").agg(F.max(grade).cast("int").alias("grade"))
    counts = {r["grade"]: r["count"] for r in known.groupBy("grade").count().collect()}
    if len(counts) < 2:
        return OrdinalModel({}, np.array([40.0, 41.0, 42.0]))
    share = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_label / n)))]), F.col("grade"))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            found = [document_features(t) for t in texts]
            columns = [part.column("doc_id"), part.column("grade"), pa.array([list(x) for x in found], pa.list_(pa.int64())), pa.array([list(x.values()) for x in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "grade", "features", "values"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    # a row for each sampled id: the first in order of the texts, should they differ
    rows = bounded_batches(docs).select("doc_id", "text").join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("grade").alias("grade"))
    table = rows.mapInArrow(run, f"doc_id {kind}, grade int, features array<bigint>, values array<int>").toArrow().sort_by([("doc_id", "ascending")])
    grades = table.column("grade").to_numpy()
    if len(set(grades.tolist())) < 2:
        return OrdinalModel({}, np.array([40.0, 41.0, 42.0]))
    sizes = table.column("features").combine_chunks().value_lengths().to_numpy()
    flat = [table.column(c).combine_chunks().flatten().to_numpy() for c in ("features", "values")]
    sample = Sample(np.repeat(np.arange(len(grades)), sizes), flat[0], flat[1].astype(float), (grades > 0).astype(int))
    if max(counts) == 1:
        return fit_ordinal(sample, severity_grades(sample), 4)
    return fit_ordinal(sample, grades, max(counts) + 1)


def score(docs: DataFrame, model: OrdinalModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, grade int (the likeliest), expected_severity double, p_toxic double (of any grade over 0), toxic boolean."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # features of the bounded sample at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        margins = _Margins(model.weights)
        for part, texts in slices(batches, "__text"):
            if len(margins) > 500_000:
                margins.clear()
            get = margins.__getitem__
            m = np.array([sum(map(get, set(t.lower().split()))) for t in texts], float)
            p = model.grade_probabilities(m)
            columns = [part.column("__key"), pa.array(p.argmax(1).astype(np.int32)), pa.array(p @ np.arange(p.shape[1])), pa.array(1 - p[:, 0]), pa.array(p[:, 0] <= 0.5)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "grade", "expected_severity", "p_toxic", "toxic"])

    source = bounded_batches(docs).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    kind = docs.schema[key].dataType.simpleString()
    out = source.mapInArrow(run, f"key {kind}, grade int, expected_severity double, p_toxic double, toxic boolean")
    return out.withColumnRenamed("key", key)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(docs, fit(docs, labels))
