"""Near-duplicate documents by SuperMinHash signatures, banding, verification and connected components.

A document's set is its distinct n-word shingles. Each element draws, for j = 0, 1, ..., a value j + u at the j-th place of
its own pseudo-random permutation of the signature's slots; a slot keeps its least value. Since ranks of one element are a
permutation, they are correlated and the signature varies less than independent hashes would. A document stops at the
first j that exceeds all its slots, after few rounds for all but tiny sets.

Documents with equal sets are one class. Classes that share a band of the signature are candidates; within a bucket each
is compared with one pivot drawn per bucket, in order of the bands shared: first the best pair of each class, then
what is still unconnected, then all members of buckets that hold several components, in blocks. Every link is
confirmed on the full sets before it counts, and the links' components are the groups. No step lists all pairs of a group.

Cases: null, empty and word-free texts have an empty set and link with nothing; a text of fewer than n words is one shingle;
repeated rows of one doc_id are one document, whose text is the first in order if they differ, and give equal rows; rows
with a null id have a null component and are kept; other columns play no part. Bands of BAND_ROWS slots miss a pair at the
threshold of 0.8 with a chance of about 1 in 10^5 (less when more similar).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.components import components
from tickloom.llm.shared import Scratch, bounded_batches, one_row_per_id, slices, tidied, with_id_in
from tickloom.llm.words import mix, seeded, shingles_of, words_of

BANDS, BAND_ROWS = 28, 5
SLOTS = BANDS * BAND_ROWS
#: Pairs that are sent to the sets instead of both being shuffled: a checked bound of under 1 MB.
FEW_PAIRS = 30_000
#: Members of an open bucket in one block of signatures, and bytes of sets in one block of sets.
BLOCK, SET_BYTES = 512, 1 << 20
_U = np.uint64


def sets_of(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text and their limits."""
    grams, ptr = shingles_of(words_of(texts), n)
    parts = [np.unique(grams[a:b]) for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
    return np.concatenate([*parts, np.zeros(0, np.uint64)]), np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)


def superminhash(elements: np.ndarray, ptr: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """A row of `slots` (at most 256) values for each set: rank j in the upper 8 bits, the fraction in the lower 24."""
    sets = len(ptr) - 1
    out = np.full(sets * slots, 0xFFFFFFFF, np.uint32)
    owner = np.repeat(np.arange(sets), np.diff(ptr))
    place = np.tile(np.arange(slots, dtype=np.uint8), (len(elements), 1))
    for j in range(slots):
        draw = seeded(elements, j)
        swap = j + ((draw >> _U(32)) % _U(slots - j)).astype(np.int64)
        row = np.arange(len(elements))
        slot = place[row, swap]
        place[row, swap] = place[:, j]
        place[:, j] = slot
        np.minimum.at(out, owner * slots + slot, ((draw & _U(0xFFFFFF)).astype(np.uint32)) | np.uint32(j << 24))
        going = out.reshape(sets, slots).max(1) >= np.uint32(min(j + 1, 255) << 24)
        active = going[owner]
        if not active.any():
            break
        if active.mean() < 0.7:
            elements, owner, place = elements[active], owner[active], place[active]
    return out.reshape(sets, slots)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    keys = np.tile(seeded(np.arange(BANDS, dtype=np.uint64), 99), (len(signatures), 1))
    for r in range(BAND_ROWS):
        keys = mix(keys * _U(0x9E3779B97F4A7C15) + signatures[:, r::BAND_ROWS].astype(np.uint64))
    return keys


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, the set's fingerprint f1 and f2, its band keys and the low bytes of its signature."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text", 1 << 19):
            elements, ptr = sets_of(texts, n)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(seeded(elements, 1001), dtype=np.uint64)))
            sums2 = np.concatenate((np.zeros(1, np.uint64), np.cumsum(seeded(elements, 1002), dtype=np.uint64)))
            signed = superminhash(elements, ptr)
            columns = [
                part.column("doc_id"),
                pa.array(np.diff(ptr)),
                pa.array((sums[ptr[1:]] - sums[ptr[:-1]]).view(np.int64)),
                pa.array((sums2[ptr[1:]] - sums2[ptr[:-1]]).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, (len(texts) + 1) * BANDS, BANDS), pa.int32()), pa.array(band_keys(signed).view(np.int64).ravel())),
                pa.array([row.tobytes() for row in signed.astype(np.uint8)], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "f1", "f2", "bands", "sig"])

    return bounded_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>, sig binary")


def _packed_sets(docs: DataFrame, n: int) -> DataFrame:
    """cls and its sorted set, 8 bytes an element."""
    kind = docs.schema["cls"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            elements, ptr = sets_of(texts, n)
            packed = [elements[a:b].tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array(packed, pa.binary())], names=["cls", "set"])

    return docs.select("cls", "text").mapInArrow(run, f"cls {kind}, set binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    pairs = scratch.stage(pairs, "pairs")
    few = pairs.count() <= FEW_PAIRS
    sent = F.broadcast(pairs) if few else pairs
    left = sent.join(sets.select(F.col("cls").alias("a"), F.col("set").alias("sa")), "a")
    if few:
        right = sent.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("sb")), "b")
        both = left.join(right, ["a", "b"])
    else:
        both = left.join(sets.select(F.col("cls").alias("b"), F.col("set").alias("sb")), "b")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            keep = [_similar(x.as_buffer(), y.as_buffer(), percent) for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    confirmed = scratch.stage(both.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}").distinct(), "confirmed")
    scratch.drop("pairs")
    return confirmed


def _ordered(x, y):
    return F.least(x, y).alias("a"), F.greatest(x, y).alias("b")


class _Groups:
    """Components that links of one task have joined."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        while self.up.get(x, x) != x:
            self.up[x] = self.up.get(self.up[x], self.up[x])
            x = self.up[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _likely(x: list[dict], y: list[dict], band: int, least: float) -> Iterator[tuple[int, int]]:
    """Pairs of different components whose signatures agree in `least` slots, and in no band before this one."""
    xs, ys = (np.frombuffer(b"".join(r["sig"] for r in rows), np.uint8).reshape(len(rows), -1) for rows in (x, y))
    for i, row in enumerate(xs):
        same = ys == row
        for k in np.flatnonzero(same.sum(1) >= least):
            if x[i]["component"] != y[k]["component"] and not same[k, : band * BAND_ROWS].reshape(band, BAND_ROWS).all(1).any():
                yield i, int(k)


def _open_links(members: DataFrame, labels: DataFrame, signed: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links between different components inside buckets, confirmed in blocks of members.

    A bucket's members outside its commonest component meet all its members, first by signature: likely are pairs that agree
    in at least the threshold less five standard deviations. The members that have a likely partner, not the pairs, then
    meet with their sets, and a task reports a link only where it joins components that its links have not joined yet.
    """
    rows = members.join(labels, F.col("cls") == F.col("node"), "left").select("key", "band", "cls", F.coalesce("component", "cls").alias("component"))
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = parts.groupBy("key").agg(F.sum("n").alias("total"), F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts"))
    open_ = sizes.where("parts > 1 AND total > 2").select("key", "total", F.col("main.component").alias("main"), (F.col("total") - F.col("main.n")).alias("minor"))
    rows = scratch.stage(rows.join(open_, "key").join(signed, "cls"), "open")
    if rows.isEmpty():
        return rows.select(F.col("cls").alias("a"), F.col("cls").alias("b"))
    share = percent / 100
    least = (share - 5 * (share * (1 - share) / SLOTS) ** 0.5) * SLOTS
    kind = members.schema["cls"].dataType.simpleString()

    def blocks(df, name, count, *fields):
        salt = F.pmod(F.xxhash64("cls"), F.col(count)).alias(f"{name}_salt")
        return df.groupBy("key", "band", salt).agg(F.collect_list(F.struct("cls", "component", *fields)).alias(name))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            key, cls = [], []
            for k, band, x, y in zip(*(batch.column(c).to_pylist() for c in ("key", "band", "few", "every")), strict=True):
                found = {c for i, j in _likely(x, y, band, least) for c in (x[i]["cls"], y[j]["cls"])}
                key += [k] * len(found)
                cls += found
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(cls, pa.int64())], names=["key", "cls"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = _Groups()
        for batch in tidied(batches):
            a, b = [], []
            for band, x, y in zip(*(batch.column(c).to_pylist() for c in ("band", "left", "right")), strict=True):
                for i, k in _likely(x, y, band, least):
                    if joined.find(x[i]["component"]) == joined.find(y[k]["component"]):
                        continue
                    if _similar(x[i]["set"], y[k]["set"], percent):
                        joined.join(x[i]["component"], y[k]["component"])
                        a.append(min(x[i]["cls"], y[k]["cls"]))
                        b.append(max(x[i]["cls"], y[k]["cls"]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    cut = rows.withColumns({c: F.ceil(F.col(c) / BLOCK) for c in ("minor", "total")})
    met = blocks(cut.where("component <> main"), "few", "minor", "sig").join(blocks(cut, "every", "total", "sig"), ["key", "band"])
    marked = scratch.stage(met.select("key", "band", "few", "every").mapInArrow(mark, f"key bigint, cls {kind}").distinct(), "marked")

    chosen = rows.select("key", "band", "cls", "component", "sig").join(marked, ["key", "cls"]).join(sets, "cls")
    weight = chosen.groupBy("key").agg(F.ceil(F.sum(F.octet_length("set")) / SET_BYTES).alias("blocks"))
    chosen = scratch.stage(chosen.join(weight, "key"), "chosen")
    pairs = blocks(chosen, "left", "blocks", "sig", "set").join(blocks(chosen, "right", "blocks", "sig", "set"), ["key", "band"]).where("left_salt <= right_salt")
    links = scratch.stage(pairs.select("band", "left", "right").mapInArrow(confirm, f"a {kind}, b {kind}").distinct(), "open_links")
    scratch.drop("open", "marked", "chosen")
    return links


def _similar(x: bytes, y: bytes, percent: int) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.sort(np.concatenate((x, y)))
    shared = int((both[1:] == both[:-1]).sum())
    return 100 * shared >= percent * (len(both) - shared)


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles long, component_id (the least doc_id of its group) and kept boolean for each row of docs.

    doc_id is of an integer type; documents link when 100 * intersection >= percent * union of their n-word shingle sets.
    """
    scratch = Scratch(docs.sparkSession, "near_duplicates")
    rows, docs = docs.select("doc_id"), one_row_per_id(docs.select("doc_id", "text"))
    repeats = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg((F.count("*") - 1).cast("int").alias("more")).where("more > 0")
    signed = scratch.stage(signatures(docs, n), "signatures")
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # a table of its own, so that the join with it is dealt out anew and Spark can split a class of very many copies
    classes = scratch.stage(full.groupBy("n_shingles", "f1", "f2").agg(F.min("doc_id").alias("cls")), "by_set")
    member_of = scratch.stage(signed.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["n_shingles", "f1", "f2"], "left").select("doc_id", "n_shingles", "cls"), "classes")
    one = scratch.stage(full.join(classes.select("cls"), F.col("doc_id") == F.col("cls"), "left_semi").select(F.col("doc_id").alias("cls"), "bands", "sig"), "first")
    scratch.drop("signatures", "by_set")

    banded = one.select("cls", F.posexplode("bands").alias("band", "key"))
    turn = F.xxhash64("key")  # the pivot is the least member after a turn that each bucket draws
    buckets = banded.groupBy("key").agg(F.min(F.col("cls").bitwiseXOR(turn)).alias("least"), F.max(F.col("cls").bitwiseXOR(turn)).alias("most"))
    buckets = scratch.stage(buckets.where("least < most").select("key", F.col("least").bitwiseXOR(turn).alias("pivot")), "buckets")
    members = scratch.stage(banded.join(buckets, "key"), "members")
    scratch.drop("buckets")
    pairs = members.where("cls <> pivot").groupBy("cls", "pivot").agg(F.count("*").alias("shared"))
    pairs = scratch.stage(pairs.select("cls", *_ordered("cls", "pivot"), "shared"), "candidates")

    needed = members.select("cls").distinct()
    texts = with_id_in(docs.select(F.col("doc_id").alias("cls"), "text"), needed, "cls")
    sets = scratch.stage(_packed_sets(texts, n), "sets")

    best = pairs.groupBy("cls").agg(F.max(F.struct("shared", (-F.col("a")).alias("a"), "b")).alias("m")).select((-F.col("m.a")).alias("a"), F.col("m.b").alias("b")).distinct()
    links = _confirmed(best, sets, percent, scratch)
    labels = components(links, scratch=scratch)
    rest = pairs.select("a", "b").distinct().join(best, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left")
    rest = rest.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    for step in ("pairs", "open"):
        if step == "pairs":
            more = _confirmed(rest, sets, percent, scratch)
        else:
            more = _open_links(members.select("key", "band", "cls"), labels, one.select("cls", "sig"), sets, percent, scratch)
        if not more.isEmpty():
            links = links.union(more)
            labels = components(links, scratch=scratch)
    grouped = member_of.join(labels.withColumnRenamed("node", "cls"), "cls", "left")
    group = F.coalesce("component", "cls", "doc_id")
    found = grouped.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), group).alias("component_id"), F.coalesce(group == F.col("doc_id"), F.lit(True)).alias("kept"))
    again = found.join(repeats, "doc_id").select(*found.columns, F.explode(F.array_repeat(F.lit(0), F.col("more")))).drop("col")
    found = scratch.stage(found.unionByName(again), "found")
    scratch.keep("found")
    return found


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n=2)
