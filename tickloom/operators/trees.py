"""Extra-trees over a whole panel, grown level by level by Spark aggregates.

At each level every open node draws one cut for each of a share of the features, uniformly between the least and the largest value that its rows have.
One pass over the rows gathers these ranges, one the sums on the left of all cuts, for all trees and models at once: a task sends a block
of numbers for each tree, whose size depends on the number of nodes, not of rows. Rows are drawn with replacement as Poisson counts from a hash of row and
tree, made anew wherever they are needed. The driver holds the trees. Missing values are the training rows' medians.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.validation import POISSON
from tickloom.sources.storage import stored

ROWS = 4096


@dataclass
class Forest:
    """Nodes are numbered as in a heap, the root 1; feature -1: a leaf. All arrays are by tree and node."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    seed: int

    @classmethod
    def empty(cls, trees: int, depth: int, seed: int) -> Forest:
        shape = (trees, 2 ** (depth + 1))
        return cls(np.full(shape, -1, np.int32), np.zeros(shape), np.zeros(shape), seed)

    def nodes(self, tree: int, x: np.ndarray) -> np.ndarray:
        """The node that each row of x has reached."""
        at, rows = np.ones(len(x), np.int64), np.arange(len(x))
        while True:
            f = self.feature[tree, at]
            if (f < 0).all():
                return at
            at = np.where(f >= 0, 2 * at + (x[rows, np.maximum(f, 0)] > self.cut[tree, at]), at)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([self.value[t, self.nodes(t, x)] for t in range(len(self.feature))], axis=0)


def drawn(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in a tree's sample."""
    x = keys.view(np.uint64) + np.uint64(((tree + 1) * 0x9E3779B97F4A7C15 + seed * 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.searchsorted(POISSON, (x >> np.uint64(11)) / float(1 << 53)).astype(float)


def draw_cuts(low: np.ndarray, high: np.ndarray, share: float, seed: tuple) -> np.ndarray:
    """A cut for each of a share of the features that vary, null for the others."""
    rng = np.random.default_rng(seed)
    few = rng.permutation(len(low))[: max(1, round(share * len(low)))]
    cuts = np.full(len(low), np.nan)
    cuts[few] = rng.uniform(low[few], np.maximum(high[few], low[few]))
    cuts[~(high > low)] = np.nan
    return cuts


def best_cut(left: np.ndarray, whole: np.ndarray, leaf: int) -> int:
    """The feature whose cut lowers the squared error most, -1 if none leaves `leaf` rows on both sides; columns: rows, weight, weighted target."""
    right = whole - left
    ok = (left[:, 0] >= leaf) & (right[:, 0] >= leaf) & (left[:, 1] > 0) & (right[:, 1] > 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, left[:, 2] ** 2 / left[:, 1] + right[:, 2] ** 2 / right[:, 1] - whole[2] ** 2 / whole[1], 0.0)
    return int(gain.argmax()) if gain.max() > 1e-12 else -1


def _rows_of(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """model, keys, x, y, weight, some thousand rows of one model at a time."""
    held: dict[str, list] = {}
    for batch in batches:
        models = np.array(batch.column("model").to_pylist())
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        for m in np.unique(models):
            at = models == m
            held.setdefault(str(m), []).append([batch.column("key").to_numpy()[at], x[at], batch.column("y").to_numpy()[at], batch.column("w").to_numpy()[at]])
            if sum(len(p[0]) for p in held[str(m)]) >= ROWS:
                yield str(m), *map(np.concatenate, zip(*held.pop(str(m)), strict=True))
    for m, parts in held.items():
        yield m, *map(np.concatenate, zip(*parts, strict=True))


def _by_tree(data: DataFrame, forests: dict[str, Forest], start: int, width: int, per_node, merge) -> DataFrame:
    """model, tree, block: per_node(model, tree, node, x, y, w, times) of the rows of each open node, merged over all tasks; nodes from `start` on."""
    shipped = data.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, totals = shipped.value, {}
        for model, keys, x, y, w in _rows_of(batches, width):
            forest = known[model]
            for t in range(len(forest.feature)):
                times = drawn(keys, t, forest.seed)
                at = forest.nodes(t, x)
                order = np.argsort(at, kind="stable")
                order = order[(at[order] >= start) & (times[order] > 0)]
                cuts = np.flatnonzero(np.diff(at[order], prepend=-1, append=-1))
                for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                    own = order[low:high]
                    node = int(at[own[0]])
                    block = per_node(model, t, node, x[own], y[own], w[own], times[own])
                    before = totals.get((model, t, node))
                    totals[model, t, node] = block if before is None else merge(before, block)
        if totals:
            m, t, n = zip(*totals, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(t, pa.int32()), pa.array(n, pa.int32()), pa.array([b.ravel().tolist() for b in totals.values()], pa.list_(pa.float64()))], names=["model", "tree", "node", "block"])

    return data.mapInArrow(run, "model string, tree int, node int, block array<double>")


def grow(data: DataFrame, models: dict[str, int], width: int, depth: int = 7, leaf: int = 10, share: float = 0.65, seed: int = 42) -> dict[str, Forest]:
    """A forest for each model, of as many trees as `models` says; data: model, key (a hash of the row), x (array of `width` numbers, none missing), y, w (weight)."""
    data = stored(data.select("model", "key", "x", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w")), "trees")
    forests = {m: Forest.empty(trees, depth, seed) for m, trees in models.items()}
    sent = data.sparkSession.sparkContext

    def merged(parts: DataFrame, merge, shape: tuple, then, schema: str) -> DataFrame:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            for (model, tree, node), group in pdf.groupby(["model", "tree", "node"], sort=False):
                block = None
                for b in group["block"]:
                    b = np.asarray(b).reshape(shape)
                    block = b if block is None else merge(block, b)
                out.append((model, tree, node, *then(model, tree, node, block)))
            return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

        return parts.groupBy("model", "tree").applyInPandas(run, schema)

    def ranges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.stack([np.minimum(a[0], b[0]), np.maximum(a[1], b[1])])

    for level in range(depth + 1):
        start = 2**level
        if level < depth:
            found = _by_tree(data, forests, start, width, lambda m, t, n, x, y, w, c: np.stack([x.min(0), x.max(0)]), ranges)
            cuts = {(r.model, r.tree, r.node): np.array([np.nan if c is None else c for c in r.cuts], float) for r in merged(found, ranges, (2, width), lambda m, t, n, b: (draw_cuts(b[0], b[1], share, (seed, t, n)),), "model string, tree int, node int, cuts array<double>").toLocalIterator()}
        else:
            cuts = {}
        shipped = sent.broadcast(cuts)

        def sums(model, tree, node, x, y, w, times, shipped=shipped):
            v = np.stack([times, times * w, times * w * y], axis=1)
            own = shipped.value.get((model, tree, node))
            out = np.zeros((width + 1, 3))
            out[width] = v.sum(0)
            if own is not None:
                out[:width] = (x <= own).astype(float).T @ v  # a null cut has nothing on its left
            return out

        def choose(model, tree, node, block, shipped=shipped):
            own, whole = shipped.value.get((model, tree, node)), block[width]
            f = best_cut(block[:width], whole, leaf) if own is not None else -1
            return f, float(own[f]) if f >= 0 else 0.0, float(whole[2] / whole[1]) if whole[1] > 0 else 0.0

        parts = _by_tree(data, forests, start, width, sums, np.add)
        for r in merged(parts, np.add, (width + 1, 3), choose, "model string, tree int, node int, feature int, cut double, value double").toLocalIterator():
            forest = forests[r.model]
            forest.feature[r.tree, r.node], forest.cut[r.tree, r.node], forest.value[r.tree, r.node] = r.feature, r.cut, r.value
        shipped.destroy()
        if not any((f.feature[:, start : 2 * start] >= 0).any() for f in forests.values()):
            break
    return forests


def predict(rows: DataFrame, forests: dict[str, Forest], keep: list[str], width: int) -> DataFrame:
    """keep, model, prediction of rows (model, x and the columns keep)."""
    shipped = rows.sparkSession.sparkContext.broadcast(forests)
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            models, out = np.array(batch.column("model").to_pylist()), np.zeros(len(batch))
            for m in np.unique(models):
                out[models == m] = shipped.value[str(m)].predict(x[models == m])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("model"), pa.array(out)], names=[*keep, "model", "prediction"])

    return rows.select(*keep, "model", "x").mapInArrow(run, f"{fields}, model string, prediction double")


def imputed(rows: DataFrame, features: list[str], train: Column) -> DataFrame:
    """rows with x, the features as an array, missing ones as the median of the rows where `train` holds; 0 where there is none."""
    medians = rows.where(train).agg(*[F.percentile_approx(F.when(~F.isnan(c), F.col(c)), 0.5, 10_000).alias(c) for c in features]).first()  # a number for each feature
    fill = {c: 0.0 if medians[c] is None else float(medians[c]) for c in features}
    return rows.withColumn("x", F.array(*[F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(fill[c])) for c in features]))
