"""Ranked lexical search over a K2-treap of the grid of terms and documents.

The items' terms are the rows of a grid, documents its columns, and a cell holds the impact of a term in a document: the whole
number that the term adds to the document's score. Rows are numbered over a block of items, columns inside a block of documents; a block's
grid is cut into quarters again and again, empty quarters are left out, and each cell that is left keeps the largest impact under it. An
item's terms descend together: a range of documents is bounded by the sum of the cells of its rows over that range; the ranges with the
largest bounds are halved first, and the search ends when no bound reaches the item's k-th best document. The ranking is exact.

Two readings of the corpus's postings: collection figures (documents, terms, document frequencies) first, then impacts and search. The
corpus is tokenised once; the postings are staged. Items enter a search with a floor, the k-th best score among a share of the documents,
so that what the blocks send to the final ranking doesn't grow with the number of blocks. Items come in blocks of a bounded number
of words, each with a pass of its own over the corpus: this bounds the vocabulary, its frequencies and weights, which the driver holds and ships.

Terms are told by 64-bit hashes: two of them are taken for one with a chance of about vocabulary x distinct terms / 2^64.

Cases: null and empty texts have no terms, count for nothing and are never found; items without terms find nothing; documents
whose score is 0 are not found; equal scores rank by doc_id, null ids last; repeated document rows are each a document; rows of one
item_id are one item, the row whose text sorts first, but rows with a null item_id are each an item; no documents or no items, no rows;
other columns play no part; a text is taken whole, at several times its bytes in memory.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import Scratch, bounded_batches, item_blocks, one_row_per_id, slices
from tickloom.llm.words import words_of

TOP = 50
#: Words of items in one pass; documents and postings of one treap; ranges that are halved at once.
ITEM_WORDS, BLOCK_DOCS, BLOCK_POSTINGS, AT_ONCE = 200_000, 1 << 15, 2_000_000, 128
#: The share of documents whose k-th best score is the others' floor.
FLOOR_SHARE = 1 / 16
#: Bytes of terms (ASCII letters and digits, all bytes of other characters); the saturation and length terms of the score.
TERM = np.zeros(256, bool)
TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
SCALE, TF_WEIGHT, M_WEIGHT, FLAT, SLOPE = 1_000_000_000, 1000, 20, 50, 50
_BITS = 20
_ONES = np.array([bin(i).count("1") for i in range(256)], np.int64)


class Vocabulary:
    """The distinct terms of a block of items, numbered; the rows of the grid."""

    def __init__(self, texts: list[str]):
        w = words_of(texts, TERM)
        self.terms, number = np.unique(w.hashes, return_inverse=True)
        self.rows = [np.unique(number[w.ptr[i] : w.ptr[i + 1]]) for i in range(len(texts))]
        self.table = np.zeros(1 << _BITS, bool)
        self.table[self.terms >> np.uint64(64 - _BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of hashes that are terms, and their rows."""
        at = np.flatnonzero(self.table[hashes >> np.uint64(64 - _BITS)])
        if not len(at) or not len(self.terms):
            return at[:0], at[:0]
        row = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        ok = self.terms[row] == hashes[at]
        return at[ok], row[ok]


@dataclass
class Query:
    """What the tasks of a search need: items, their rows, the rows' weights, the collection's size."""

    ids: list
    rows: list[np.ndarray]
    weights: np.ndarray
    documents: int
    terms: int
    floors: np.ndarray


class Treap:
    """Cells of all levels, the root first: a mask of the four quarters that aren't empty, the place of the first of these, the largest impact."""

    def __init__(self, row: np.ndarray, column: np.ndarray, impact: np.ndarray):
        self.height = max(1, int(max(row.max(), column.max())).bit_length())
        code = np.zeros(len(row), np.uint64)
        for bit in range(self.height):
            both = ((row >> bit) & 1) << 1 | (column >> bit) & 1
            code |= both.astype(np.uint64) << np.uint64(2 * bit)
        order = np.argsort(code, kind="stable")
        code, peak = code[order], impact[order]
        levels = [(np.zeros(len(code), np.uint8), np.zeros(len(code), np.int64), peak)]
        for _ in range(self.height):
            first = np.flatnonzero(np.append(True, code[1:] >> np.uint64(2) != code[:-1] >> np.uint64(2)))
            mask = np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), first)
            peak = np.maximum.reduceat(peak, first)
            code = code[first] >> np.uint64(2)
            levels.append((mask, first, peak))
        levels.reverse()
        sizes = np.cumsum([len(mask) for mask, _, _ in levels])
        self.mask = np.concatenate([mask for mask, _, _ in levels] + [np.zeros(1, np.uint8)])
        self.start = np.concatenate([first + size for (_, first, _), size in zip(levels, sizes, strict=True)] + [np.zeros(1, np.int64)])
        self.peak = np.concatenate([peak for _, _, peak in levels] + [np.zeros(1, np.int64)])
        self.nothing = len(self.mask) - 1

    def _quarter(self, cells: np.ndarray, quarter: np.ndarray) -> np.ndarray:
        mask = self.mask[cells]
        under = self.start[cells] + _ONES[mask & ((1 << quarter) - 1)]
        return np.where(mask >> quarter & 1, under, self.nothing)

    def best(self, rows: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The k columns with the largest sums over rows, of at least floor (and 1), largest first, ties to smaller columns; and the sums."""
        cells = np.zeros((1, len(rows)), np.int64)
        bound, low, level = self.peak[cells].sum(1), np.zeros(1, np.int64), np.zeros(1, np.int64)
        columns, sums = low[:0], bound[:0]
        floor = max(floor, 1)
        while len(bound):
            if len(bound) > AT_ONCE:
                order = np.argpartition(-bound, AT_ONCE)
                now, later = order[:AT_ONCE], order[AT_ONCE:]
            else:
                now, later = np.arange(len(bound)), np.arange(0)
            under = 2 * ((rows >> (self.height - 1 - level[now])[:, None]) & 1)
            here = cells[now]
            halves = np.concatenate([self._quarter(here, under), self._quarter(here, under + 1)])
            reach = self.peak[halves].sum(1)
            down = np.concatenate([level[now], level[now]]) + 1
            left = np.concatenate([low[now], low[now] + (1 << (self.height - 1 - level[now]))])
            leaf, good = down == self.height, reach >= floor
            if (ends := leaf & good).any():
                columns, sums = np.concatenate([columns, left[ends]]), np.concatenate([sums, reach[ends]])
                if len(sums) > k:
                    floor = max(floor, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
                    columns, sums = columns[sums >= floor], sums[sums >= floor]
            keep, later = ~leaf & (reach >= floor), later[bound[later] >= floor]
            cells = np.concatenate([cells[later], halves[keep]])
            bound, low, level = (np.concatenate([a[later], b[keep]]) for a, b in ((bound, reach), (low, left), (level, down)))
        order = np.lexsort((columns, -sums))[:k]
        return columns[order], sums[order]


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """doc_id, n (terms of the text), rows and tfs (arrays: terms of the vocabulary in it) of the documents with a term; vocabulary: a broadcast one."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n long, rows array<int>, tfs array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        width = max(1, len(known.terms))
        for part, texts in slices(batches, "text"):
            w = words_of(texts, TERM)
            at, row = known.find(w.hashes)
            pair, tf = np.unique((np.searchsorted(w.ptr, at, "right") - 1) * width + row, return_counts=True)
            n = np.diff(w.ptr)
            some = np.flatnonzero(n)
            # documents without a term are left out and have no pairs, so the pairs' limits are those of the others
            limits = pa.array(np.searchsorted(pair // width, np.append(some, len(n))), pa.int32())
            rows = pa.ListArray.from_arrays(limits, pa.array(pair % width, pa.int32()))
            tfs = pa.ListArray.from_arrays(limits, pa.array(tf, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(some)), pa.array(n[some], pa.int64()), rows, tfs], names=["doc_id", "n", "rows", "tfs"])

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of postings put together to blocks of at most about BLOCK_DOCS documents and BLOCK_POSTINGS postings."""
    held, docs, cells = [], 0, 0
    for batch in batches:
        if held and (docs + len(batch) > BLOCK_DOCS or cells + len(batch.column("rows").flatten()) > BLOCK_POSTINGS):
            yield pa.concat_batches(held)
            held, docs, cells = [], 0, 0
        held.append(batch)
        docs, cells = docs + len(batch), cells + len(batch.column("rows").flatten())
    if held:
        yield pa.concat_batches(held)


def search(found: DataFrame, query, k: int, item_type: str) -> DataFrame:
    """item_id, doc_id, score: of each block of documents each item's k best, but none under the item's floor; found: postings, query: a broadcast Query."""
    schema = f"item_id {item_type}, number int, doc_id {found.schema['doc_id'].dataType.simpleString()}, score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = query.value
        for block in _blocks(batches):
            # columns in the order in which ties rank
            block = block.take(pc.sort_indices(block, sort_keys=[("doc_id", "ascending")], null_placement="at_end"))
            row = block.column("rows").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = block.column("tfs").flatten().to_numpy(zero_copy_only=False)
            column = np.repeat(np.arange(len(block)), pc.list_value_length(block.column("rows")).to_numpy(zero_copy_only=False))
            m = FLAT + SLOPE * block.column("n").to_numpy(zero_copy_only=False) * q.documents // q.terms
            impact = q.weights[row] * (SCALE * tf // (TF_WEIGHT * tf + M_WEIGHT * m[column]))
            some = impact > 0
            if not some.any():
                continue
            treap = Treap(row[some], column[some], impact[some])
            hits = [treap.best(rows, k, int(q.floors[i])) for i, rows in enumerate(q.rows) if len(rows)]
            number = np.repeat([i for i, rows in enumerate(q.rows) if len(rows)], [len(c) for c, _ in hits])
            if not len(number):
                continue
            ids = block.column("doc_id").take(pa.array(np.concatenate([c for c, _ in hits])))
            items = pa.array(q.ids).take(pa.array(number))
            yield pa.RecordBatch.from_arrays([items, pa.array(number, pa.int32()), ids, pa.array(np.concatenate([s for _, s in hits]))], names=["item_id", "number", "doc_id", "score"])

    return found.mapInArrow(run, schema)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    by_item = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return hits.withColumn("rank", F.row_number().over(by_item)).where(f"rank <= {k}")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank int, doc_id, score long: each item's k best documents; docs: doc_id, text; items: item_id, text."""
    spark = docs.sparkSession
    item_type, doc_type = (t.schema[c].dataType.simpleString() for t, c in ((items, "item_id"), (docs, "doc_id")))
    scratch, out = Scratch(spark, "lexical"), []
    for ids, texts in item_blocks(one_row_per_id(items.select("item_id", "text"), "item_id"), ITEM_WORDS):
        vocabulary = Vocabulary(texts)
        shipped = spark.sparkContext.broadcast(vocabulary)
        found = scratch.stage(postings(docs, shipped), "postings")
        shipped.destroy()
        documents, terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            scratch.drop("postings")
            continue
        df = np.zeros(len(vocabulary.terms), np.int64)
        for r in found.select(F.explode("rows").alias("row")).groupBy("row").agg(F.count("*").alias("df")).toLocalIterator():  # at most the vocabulary's size
            df[r["row"]] = r["df"]
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        query = Query(ids, vocabulary.rows, weights, documents, terms, np.zeros(len(ids), np.int64))

        first = spark.sparkContext.broadcast(query)
        share = found.where(F.xxhash64("doc_id", "n", "rows") < F.lit(round((FLOOR_SHARE - 0.5) * 2**64)))
        for r in _ranked(search(share, first, k, item_type), k).where(f"rank = {k}").toLocalIterator():  # a row for each item
            query.floors[r["number"]] = r["score"]
        first.destroy()
        second = spark.sparkContext.broadcast(query)
        out.append(scratch.stage(_ranked(search(found, second, k, item_type), k).select("item_id", "rank", "doc_id", "score"), "ranked"))
        second.destroy()
        scratch.drop("postings")
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {doc_type}, score long")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
