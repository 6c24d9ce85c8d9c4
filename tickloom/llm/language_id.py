"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character n-grams of the lower-cased text, everything but letters read as a space, go to hashed buckets. A document's
weight in a bucket is its share of the document's n-grams times the bucket's inverse document frequency, which is
counted over every training document. The weights are trained with follow-the-regularised-leader (per-coordinate
rates, L1 and L2 penalties) on a bounded sample of labelled documents, and a temperature is fitted on the part of the
sample kept from training. Since the features are linear in the n-grams' occurrences, a prediction is a sum of table
rows over the whole text.

Cases: a null text, or one without a letter, is `und` with score 0; texts of any length are read whole; ties between
languages go to the alphabetically first; null labels take no part in training, equal texts of one language count once in
the sample; repeated rows and rows with a null id are predicted each for itself; without any labelled text every document
is `und`; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.shared import bounded_batches, slices

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Bound of the labelled sample that the classifier is fitted on, per language.
SAMPLE_PER_LANGUAGE = 1500
#: Bound of the learned languages, the commonest first: what is collected and broadcast grows with it.
MOST_LANGUAGES = 500
_SCALE = 20.0
_MULTIPLIERS = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by 0, and the limits of the texts."""
    data = "\0".join([*(t.lower().replace("\0", " ") for t in texts), ""])
    codes = np.frombuffer(data.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(codes == 0)
    codes = np.where(_letters()[codes] | (codes == 0), codes, np.uint32(32))
    return codes, np.concatenate(([0], ends + 1))


def _buckets(codes: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Where n-grams of one order start, and their buckets; none spans two texts or is of spaces only."""
    size = len(codes) - order + 1
    if size <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    h, solid, letter = np.full(size, order, np.uint32), np.ones(size, bool), np.zeros(size, bool)
    for k in range(order):
        part = codes[k : k + size]
        h = (h ^ part) * _MULTIPLIERS[k]
        h ^= h >> np.uint32(15)
        solid &= part != 0
        letter |= part != 32
    at = np.flatnonzero(solid & letter)
    return at, (h[at] * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 16)


def _grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the number of the text and the bucket of each n-gram."""
    codes, limits = _codes(texts)
    for order in ORDERS:
        at, bucket = _buckets(codes, order)
        yield np.searchsorted(limits, at, "right") - 1, bucket


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # a row of weights for each bucket, the idf and the temperature within
    bias: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        totals, sums = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        for text, bucket in _grams(texts):
            totals += np.bincount(text, minlength=len(texts))
            rows = self.table[bucket]
            for k in range(len(self.languages)):
                sums[:, k] += np.bincount(text, rows[:, k], len(texts))
        letters = totals > 0
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        margin = sums * (_SCALE / np.maximum(totals, 1))[:, None] + self.bias
        p = np.exp(margin - margin.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        names = [self.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
        return names, np.where(letters, p[np.arange(len(texts)), best], 0.0)


def document_frequencies(texts: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Documents with each bucket, and all documents: arrays of a fixed size, summed by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(BUCKETS, np.int64), 0
        seen = np.zeros(BUCKETS, bool)
        for _, part in slices(batches, text, 1 << 18):
            n += len(part)
            grams = [(d, b, np.searchsorted(d, np.arange(len(part) + 1))) for d, b in _grams(part)]
            for i in range(len(part)):
                seen[:] = False
                for _, bucket, limits in grams:
                    seen[bucket[limits[i] : limits[i + 1]]] = True
                found += seen
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(found[at], n))], names=["bucket", "n"])

    counts = bounded_batches(texts).select(text).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = counts.column("bucket").to_numpy(), counts.column("n").to_numpy()
    df = np.zeros(BUCKETS, np.int64)
    df[bucket[bucket >= 0]] = n[bucket >= 0]
    return df, int(n[bucket < 0].sum())


def _ftrl(row, train, labels, classes, epochs=3, alpha=0.5, beta=1.0, l1=0.02, l2=0.001):
    """Weights and bias; the proximal step gives exact zeros where the summed gradient stays within l1."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, (np.sign(zs) * l1 - zs) / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(train):
            at, x = row(i)
            zs, ns = z[at], n[at]
            w = weights(zs, ns)
            m = x @ w
            p = np.exp(m - m.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p
            more = ns + g * g
            z[at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[at] = more
    w = weights(z, n)
    return w[:-1], w[-1]


def _sampled(rows: DataFrame, shares: DataFrame, text: str, lang: str, key: str) -> pa.Table:
    """lang, buckets and counts of the sampled rows, featurised in tasks; equal texts of a language are one row."""
    drawn = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(text))
    rows = rows.join(F.broadcast(shares), F.col(lang) == F.col("__lang")).where(F.pmod(drawn, F.lit(1_000_000)) < F.col("__share") * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "__text", 1 << 18):
            found = [np.unique(np.concatenate([b for _, b in _grams([t])]), return_counts=True) for t in texts]
            columns = [pa.array([at.astype(np.int32) for at, _ in found], pa.list_(pa.int32())), pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([part.column("__lang"), part.column("__hash"), *columns], names=["lang", "hash", "buckets", "counts"])

    source = bounded_batches(rows).select("__lang", F.xxhash64(text).alias("__hash"), F.col(text).alias("__text"))
    found = source.mapInArrow(run, "lang string, hash bigint, buckets array<int>, counts array<int>").where("size(buckets) > 0")
    return found.dropDuplicates(["lang", "hash"]).toArrow()


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A calibrated model; idf over all labelled rows, weights on about `per_language` rows of each of the MOST_LANGUAGES commonest languages."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    commonest = rows.groupBy(F.col(lang).alias("__lang")).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), "__lang").limit(MOST_LANGUAGES)
    counts = {r["__lang"]: r["__n"] for r in commonest.collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    df, n = document_frequencies(rows, text)
    idf = np.log((1 + n) / (1 + df)) + 1
    # as Arrow: a list of rows is read by Python workers of their own, which stay
    shares = labelled.sparkSession.createDataFrame(pa.table({"__lang": pa.array(languages, pa.string()), "__share": [min(1.0, per_language / counts[k]) for k in languages]}))
    sample = _sampled(rows, shares, text, lang, key)
    # the driver holds the sample's n-grams once, as they came; a row's weights are made when they are needed
    at, times = (sample.column(c).combine_chunks() for c in ("buckets", "counts"))
    limits = np.concatenate(([0], np.cumsum(at.value_lengths().to_numpy()))) if len(at) else np.zeros(1, np.int64)
    at, times = at.flatten().to_numpy(), times.flatten().to_numpy()
    names, hashes = np.array(sample.column("lang").to_pylist(), object), sample.column("hash").to_numpy()
    place = np.lexsort((hashes, names.astype(str))) if len(names) else np.zeros(0, int)
    labels = np.searchsorted(languages, names[place].astype(str)) if len(names) else np.zeros(0, int)
    del sample

    def row(i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(limits[place[i]], limits[place[i] + 1])
        x = times[part] / times[part].sum() * idf[at[part]] * _SCALE
        return np.append(at[part], BUCKETS), np.append(x, 1.0)

    order = np.random.default_rng(11).permutation(len(labels))
    held = order[: len(labels) // 5] if len(labels) >= 50 else order[:0]
    train = order[len(held) :]
    w, bias = _ftrl(row, train, labels, len(languages))
    full = np.vstack([w, bias])
    inverse = 1.0
    if len(held):
        margins = np.array([x @ full[a] for a, x in map(row, held)])
        truth = labels[held]

        def loss(s):
            m = margins * s
            m = m - m.max(1, keepdims=True)
            return -(m[np.arange(len(m)), truth] - np.log(np.exp(m).sum(1))).mean()

        inverse = min(np.geomspace(0.1, 10, 81), key=loss)
    del at, times
    pa.default_memory_pool().release_unused()
    return Model(languages, (w * idf[:, None] * inverse).astype(np.float32), bias * inverse)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets by the languages
    names = [f"c{i}" for i in range(len(docs.columns))]  # any column names, clashing ones too
    at = docs.columns.index(text)
    fields = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, names[at], 1 << 18):
            langs, scores = shipped.value.predict(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    out = bounded_batches(docs).toDF(*names).mapInArrow(run, ", ".join([*fields, "lang_pred string", "score double"]))
    return out.toDF(*docs.columns, "lang_pred", "score")


def held_out(key: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) == 2


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.select("doc_id", "text", "lang").where(~F.coalesce(held_out(), F.lit(False))))
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
