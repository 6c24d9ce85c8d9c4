"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

The benchmark is taken in blocks of a bounded number of words, each block in one pass over the corpus. An item's seeds are its three-word
runs that few different items of the block hold; what many items share, as stems of questions are, neither starts an alignment
nor proves a copy: as large a share of the words outside shared runs must be in the passage as of the score. An item all of whose runs are shared has its rarest ones as seeds. How many documents hold a run plays no part: which runs
outlive the edits of a copy can't be told from that. Where a document meets an item in a seed, the passages along the seeds' diagonals, with a
margin on both sides, are aligned with the item if enough of their words are the item's for the score to be reached, those with the
most such words first, as long as they can still beat the best: Smith-Waterman on words, 2 for a match, -1 for a mismatch or a gap. The score is
divided by that of the whole item, so that an exact copy has 1; copies with words replaced, put in or left out score in between. A copy
without three words in a row that are rare among items is not seen.

Cases: null or empty texts and items match nothing; an item of fewer than three words has itself as its one seed;
copies of an item in one document give one row, the best, the first on ties; repeated items are each reported;
repeated document rows give repeated results; an empty benchmark gives no rows; other columns play no part. A document costs time in
proportion to its words times the items it shares a seed with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.shared import Scratch, bounded_batches, item_blocks, slices
from tickloom.llm.words import shingles_of, words_of

SEED_WORDS = 3
#: Different items that may share a seed.
RARE_ITEMS = 8
#: Words of benchmark items that one pass takes: bounds what is broadcast; more items mean more passes.
BLOCK_WORDS = 2_000_000
LEAST_SCORE = 0.5
_BITS = 20


class Seeds:
    """Hashes of a block's seeds with their places in the different items, found by a bit table and binary search."""

    def __init__(self, ids: list, texts: list[str]):
        w = words_of(texts)
        alike: dict[bytes, int] = {}  # items with the same words are one
        self.ids: list[list] = []
        first = []
        for i, item_id in enumerate(ids):
            number = alike.setdefault(w.hashes[w.ptr[i] : w.ptr[i + 1]].tobytes(), len(first))
            if number == len(first):
                first.append(i)
                self.ids.append([])
            self.ids[number].append(item_id)
        grams, ptr = shingles_of(w, SEED_WORDS)
        item = np.repeat(np.arange(len(first)), np.diff(ptr)[first])
        at = np.concatenate([np.arange(ptr[i], ptr[i + 1]) for i in first]).astype(np.int64) if first else np.zeros(0, np.int64)
        place, grams = at - ptr[first][item] if len(at) else at, grams[at]
        # how many items hold each run; an item keeps the rare ones, or its rarest
        _, run = np.unique(grams, return_inverse=True)
        pairs = np.unique(run.astype(np.int64) * max(1, len(first)) + item) // max(1, len(first))
        held = np.bincount(pairs, minlength=1)[run] if len(run) else run
        rarest = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(rarest, item, held)
        kept = np.flatnonzero(held <= np.maximum(RARE_ITEMS, rarest[item])) if len(run) else run
        order = kept[np.argsort(grams[kept], kind="stable")]
        self.words = [w.hashes[w.ptr[i] : w.ptr[i + 1]] for i in first]
        # the words of an item that no shared run covers
        inside = [np.zeros(len(own), bool) for own in self.words]
        for k in np.flatnonzero(held > RARE_ITEMS):
            inside[item[k]][place[k] : place[k] + SEED_WORDS] = True
        self.own = [own if covered.all() else own[~covered] for own, covered in zip(self.words, inside, strict=True)]
        self.hashes, self.item, self.place = grams[order], item[order], place[order]
        self.distinct, self.first, self.times = np.unique(self.hashes, return_index=True, return_counts=True)
        self.table = np.zeros(1 << _BITS, bool)
        self.table[self.distinct >> np.uint64(64 - _BITS)] = True

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in grams that hold a seed, and the number of the seed."""
        at = np.flatnonzero(self.table[grams >> np.uint64(64 - _BITS)])
        if not len(at) or not len(self.distinct):
            return at[:0], at[:0]
        seed = np.minimum(np.searchsorted(self.distinct, grams[at]), len(self.distinct) - 1)
        ok = self.distinct[seed] == grams[at]
        return at[ok], seed[ok]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best Smith-Waterman score of two word sequences, and the span of the passage that has it."""
    m = len(passage)
    ramp = np.arange(m + 1)
    above, above_from = np.zeros(m + 1, np.int64), ramp.copy()
    best, span = 0, (0, 0)
    for word in item:
        step = above[:-1] + np.where(passage == word, 2, -1)
        down = above[1:] - 1
        here = np.zeros(m + 1, np.int64)
        np.maximum(step, down, out=here[1:])
        origin = ramp.copy()
        origin[1:] = np.where(step >= down, above_from[:-1], above_from[1:])
        origin = np.where(here > 0, origin, ramp)
        np.maximum(here, 0, out=here)
        lifted = here + ramp  # a gap of k costs k: the best start to the left is a running maximum
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, ramp, 0))
        above, above_from = top - ramp, origin[source]
        if (high := int(above.max())) > best:
            end = int(above.argmax())
            best, span = high, (int(above_from[end]), end)
    return best, *span


def _matches(seeds: Seeds, words: np.ndarray, place: np.ndarray, seed: np.ndarray, least: float) -> list[tuple]:
    """(item number, score, first word, word after the last) for one document's seed positions."""
    times = seeds.times[seed]
    entry = np.repeat(seeds.first[seed] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
    item, diagonal = seeds.item[entry], np.repeat(place, times) - seeds.place[entry]
    order = np.lexsort((diagonal, item))
    item, diagonal = item[order], diagonal[order]
    out = []
    cuts = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        i, own = int(item[low]), diagonal[low:high]
        size = len(seeds.words[i])
        slack = max(4, size // 4)
        # hits along near diagonals are one passage
        jumps = np.flatnonzero(np.diff(own) > slack) + 1
        start = np.maximum(0, own[np.append(0, jumps)] - slack)
        end = np.minimum(len(words), own[np.append(jumps, len(own)) - 1] + size + slack)
        # no alignment scores more than its words that are the item's
        shared = np.concatenate(([0], np.cumsum(np.isin(words, seeds.words[i]))))
        most = 2 * np.minimum(shared[end] - shared[start], size)
        found = None
        for k in np.lexsort((start, -most)):
            if most[k] < max(least * 2 * size, found[1] if found else 0):
                break
            if found and most[k] == found[1] and start[k] > found[2]:
                continue
            s, x, y = align(seeds.words[i], words[start[k] : end[k]])
            here = (i, s, int(start[k]) + x, int(start[k]) + y)
            if np.isin(words[here[2] : here[3]], seeds.own[i]).sum() < least * len(seeds.own[i]):
                continue
            if s >= least * 2 * size and (found is None or (-s, here[2]) < (-found[1], found[2])):
                found = here
        if found:
            out.append((found[0], found[1] / (2 * size), found[2], found[3]))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """doc_id, item_id, score double, first_word int, end_word int of passages that score at least `least`."""
    spark = docs.sparkSession
    doc_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, score double, first_word int, end_word int"
    docs, scratch = bounded_batches(docs).select("doc_id", "text"), Scratch(spark, "contaminated")
    out = None
    for ids, texts in item_blocks(benchmark, BLOCK_WORDS):
        seeds = Seeds(ids, texts)
        shipped = spark.sparkContext.broadcast(seeds)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            seeds = shipped.value
            for part, texts in slices(batches, "text"):
                w = words_of(texts)
                grams, ptr = shingles_of(w, SEED_WORDS)
                at, seed = seeds.find(grams)
                doc = np.searchsorted(ptr, at, "right") - 1
                cuts = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
                rows = []
                for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                    d = int(doc[low])
                    own = w.hashes[w.ptr[d] : w.ptr[d + 1]]
                    rows += [(d, item_id, *m[1:]) for m in _matches(seeds, own, at[low:high] - ptr[d], seed[low:high], least) for item_id in seeds.ids[m[0]]]
                if rows:
                    d, i, s, a, b = zip(*rows, strict=True)
                    ids = part.column("doc_id").take(pa.array(d))
                    items = pa.array(i)
                    yield pa.RecordBatch.from_arrays([ids, items, pa.array(s), pa.array(a, pa.int32()), pa.array(b, pa.int32())], names=["doc_id", "item_id", "score", "first_word", "end_word"])

        found = scratch.stage(docs.mapInArrow(run, schema), "found")
        shipped.destroy()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
