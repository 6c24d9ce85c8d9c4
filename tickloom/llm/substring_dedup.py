"""Near-duplicate passages across documents by compact windows.

Tokens are the hashes of five-word runs. Under each of HASHES hash functions, the positions that are least in some stretch of
`min_words` words stand for all stretches that they are least in: a Cartesian tree over these positions gives each its
compact window, the widest span in which it is least. Windows whose token occurs in two documents or more meet, by hash
function, if they also share the token 20 places to one side (a passage of 50 words reaches that far to one side at least);
each meets the earliest document's window of its group. An interval join keeps pairs whose aligned
windows overlap by a whole passage, pairs that enough hash functions support are verified on the texts, and what is verified is
merged to passages. Windows that no verified passage holds meet once more: the next document of their group, and in finer groups those that also
share the min-hash, under one of CONTEXTS functions, of the tokens to one side of them, so that documents which share more than
their first head had find each other, and no group costs more than a multiple of its members. The earliest document keeps a passage; it is reported for the others.

Cases: null, empty and short texts have no passage; passages that repeat only inside one document are left alone; repeated
rows of one doc_id are one document, whose text is the first in order if they differ; rows with a null id take no part;
texts of any length are read whole; ties between earliest windows go to the smaller position; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.shared import Scratch, bounded_batches, one_row_per_id, perhaps_in, slices, tidied, with_id_in
from tickloom.llm.words import mix, seeded, shingles_of, words_of

SHINGLE = 5
HASHES, ENOUGH = 4, 2
SIDE = 20
SIMILARITY = 0.8
#: Min-hashes of the tokens to either side of a window that is left, by which it meets others again.
CONTEXTS = 1
_SLACK = 16
#: Tokens past the end of equal ones that tell whether a passage goes on behind an edit: an edited word changes five.
_EDIT = 12
#: Tokens of pairs that are compared at once.
CHUNK_TOKENS = 1 << 17
_U = np.uint64


def _minima(grams: np.ndarray, ptr: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """Positions that are least in some `width` tokens of their text, their values, and the first and last start of the stretches that they are least in."""
    none = np.zeros(0, np.int64)
    if len(grams) < width:
        return none, np.zeros(0, np.uint64), none, none
    bits = _U(int(len(grams)).bit_length())
    x = (seeded(grams, seed) >> bits << bits) | np.arange(len(grams), dtype=np.uint64)  # equal tokens: the first is least
    least, w = x, 1
    while 2 * w <= width:
        least = np.minimum(least[:-w], least[w:])
        w *= 2
    if width > w:
        least = np.minimum(least[: len(grams) - width + 1], least[width - w :])
    sizes = np.diff(ptr)
    inside = np.ones(len(least), bool)  # stretches that run over the end of a text
    edge = np.zeros(len(grams) + 1, np.int64)
    np.add.at(edge, np.maximum(ptr[1:] - width + 1, ptr[:-1])[sizes > 0], 1)
    np.add.at(edge, ptr[1:][sizes > 0], -1)
    inside = np.cumsum(edge[: len(least)]) == 0
    start, least = np.flatnonzero(inside), least[inside]
    if not len(start):
        return none, np.zeros(0, np.uint64), none, none
    cut = np.flatnonzero((np.diff(least) != 0) | (np.diff(start) != 1))
    first, last = start[np.append(0, cut + 1)], start[np.append(cut, len(start) - 1)]
    value = least[np.append(0, cut + 1)]
    return (value & ((_U(1) << bits) - _U(1))).astype(np.int64), value, first, last


def compact_windows(grams: np.ndarray, ptr: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions that are least in some `width` tokens of their text, with their compact windows [left, right]."""
    place, value, first, last = _minima(grams, ptr, width, seed)
    if not len(place):
        return (place,) * 3
    doc = np.searchsorted(ptr, place, "right") - 1
    low, high = ptr[doc], ptr[doc + 1] - 1
    # Cartesian tree over the chosen positions of each text: nearest smaller ones to both sides
    size = len(place)
    before, after, stack = [-1] * size, [size] * size, []
    keys, texts = value.tolist(), doc.tolist()
    for i in range(size):
        v = keys[i]
        if stack and texts[stack[-1]] != texts[i]:
            stack.clear()
        while stack and keys[stack[-1]] > v:
            after[stack.pop()] = i
        if stack:
            before[i] = stack[-1]
        stack.append(i)
    before, after = np.array(before), np.array(after)
    left = np.where(before >= 0, place[before] + 1, low)
    right = np.where(after < size, place[np.minimum(after, size - 1)] - 1, high)
    # a smaller token nearer than a passage's width is where the stretches that this one is least in begin or end
    left = np.where(first > np.maximum(low, place - width + 1), first, np.minimum(left, first))
    right = np.where(last < np.minimum(high - width + 1, place), last + width - 1, np.maximum(right, last + width - 1))
    return place, left, right


def _token_counts(docs: DataFrame, width: int) -> DataFrame:
    """key: tokens of windows that two documents or more have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, "text"):
            grams, ptr = shingles_of(words_of(texts), SHINGLE)
            place = np.unique(np.concatenate([_minima(grams, ptr, width, j)[0] for j in range(HASHES)]))
            doc = np.searchsorted(ptr, place, "right") - 1
            keys = np.sort(grams[place])
            if len(keys) > 1 and (keys[1:] == keys[:-1]).any():  # a token counts once for each document
                order = np.lexsort((doc, grams[place]))
                key, of = grams[place][order], doc[order]
                keys = key[np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))]
            keys, n = np.unique(keys, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    found = docs.select("text").mapInArrow(run, "key bigint, n bigint")
    return found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """key, doc_id, at, its distances to the window's ends, and group keys by the tokens SIDE places to the left and right."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            grams, ptr = shingles_of(words_of(texts), SHINGLE)
            for j in range(HASHES):
                place, left, right = compact_windows(grams, ptr, width, j)
                doc = np.searchsorted(ptr, place, "right") - 1
                key = grams[place]
                sides = []
                for far, salt in ((place - SIDE, 1), (place + SIDE, 2)):
                    inside = (far >= left) & (far <= right)
                    other = grams[np.clip(far, 0, max(len(grams) - 1, 0))] if len(grams) else key
                    sides.append(pa.array(mix(mix(key + _U(8 * j + salt)) ^ other).view(np.int64), mask=~inside))
                ids = part.column("doc_id").take(pa.array(doc))
                columns = [pa.array(key.view(np.int64)), ids, *(pa.array(v.astype(np.int32)) for v in (place - ptr[doc], place - left, right - place)), *sides, pa.array(np.full(len(key), j, np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "at", "back", "ahead", "lefts", "rights", "j"])

    return docs.select("doc_id", "text").mapInArrow(run, f"key bigint, doc_id {kind}, at int, back int, ahead int, lefts bigint, rights bigint, j int")


def _runs(match: np.ndarray, least: float, width: int) -> list[tuple[int, int]]:
    """Spans of matches of at least `width`, neighbours joined while at least that share of the joined span matches."""
    if np.count_nonzero(match) < least * width:
        return []
    edge = (np.flatnonzero(match[1:] != match[:-1]) + 1).tolist()
    edge = [*([0] if match[0] else []), *edge, *([len(match)] if match[-1] else [])]
    out: list[list[int]] = []
    for a, b in zip(edge[0::2], edge[1::2], strict=True):
        if out and out[-1][2] + b - a >= least * (b - out[-1][0]):
            out[-1][1], out[-1][2] = b, out[-1][2] + b - a
        else:
            out.append([a, b, b - a])
    return [(a, b) for a, b, _ in out if b - a >= width]


def verified(own: np.ndarray, other: np.ndarray, width: int) -> list[tuple[int, int, float]]:
    """Spans [first, end) of own that hold a passage of other: at least `width` tokens, Jaccard similarity of the token sets at least SIMILARITY."""
    found = []
    if min(len(own), len(other)) < width:
        return found
    if len(own) == len(other) and (own == other).all():
        return [(0, len(own), 1.0)]
    dense = 2 * SIMILARITY / (1 + SIMILARITY)
    for a, b in _runs(_member(own, np.sort(other)), dense, width):
        x = _distinct(own[a:b])
        for c, d in _runs(_member(other, x), dense, width):
            y = _distinct(other[c:d])
            shared = int(_member(y, x).sum())
            similarity = shared / (len(x) + len(y) - shared)
            if similarity >= SIMILARITY:
                found.append((a, b, similarity))
                break
    return found


def around(own: np.ndarray, other: np.ndarray, first: int, last: int, there: int, width: int) -> list[tuple[int, int, float]]:
    """Passages about the places of own from first to last, which meet other from `there` on: as verified() finds them, looking
    no further than they reach: farther and farther from the places.
    """
    reach = 4 * width
    while True:
        a, b = max(0, first - reach), min(len(own), last + 1 + reach)
        c, d = max(0, there - reach - _SLACK), max(0, there + last - first + 1 + reach + _SLACK)
        found = verified(own[a:b], other[c:d], width)
        if not any(x <= _SLACK and a > 0 or y + _SLACK >= b - a and b < len(own) for x, y, _ in found):
            return [(a + x, a + y, s) for x, y, s in found]
        reach *= 4


def plain_runs(own: list[np.ndarray], other: list[np.ndarray], first: np.ndarray, last: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each pair is decided by the run of equal tokens that its places lie in, and the run's first token and end in own.

    It is where no token past the run's ends is near the other text's: then it is the passage, or too short for one. Most pairs
    are decided so, all of a batch at once; the others, with edits, are left to around().
    """
    sizes, sizes_there = (np.array([len(x) for x in part], np.int64) for part in (own, other))
    at, at_there = (np.concatenate(([0], np.cumsum(n)))[:-1] for n in (sizes, sizes_there))
    x, y = (np.concatenate([*part, np.zeros(1, np.uint32)]) for part in (own, other))
    back, ahead = np.minimum(first, there), np.minimum(sizes - first, sizes_there - there)
    span = last - first
    length = np.maximum(back + ahead, 0)
    begin = np.concatenate(([0], np.cumsum(length)))
    inside = np.arange(begin[-1]) - np.repeat(begin[:-1], length)
    differs = np.flatnonzero(x[np.repeat(at + first - back, length) + inside] != y[np.repeat(at_there + there - back, length) + inside])
    bound = np.concatenate(([-1], differs, [begin[-1]]))
    i = np.searchsorted(differs, begin[:-1] + back)
    low = np.maximum(bound[i] + 1 - begin[:-1], 0)
    high = np.minimum(bound[i + 1] - begin[:-1], length)
    a, b, c, d = first - back + low, first - back + high, there - back + low, there - back + high
    ok = (ahead > span) & (high > back + span)

    def apart(place, place_there, offset, offset_there):
        here, away = place[:, None] + offset, place_there[:, None] + offset_there
        own_in, other_in = (here >= 0) & (here < sizes[:, None]), (away >= 0) & (away < sizes_there[:, None])
        here, away = np.where(own_in, at[:, None] + here, 0), np.where(other_in, at_there[:, None] + away, 0)
        same = (x[here][:, :, None] == y[away][:, None, :]) & own_in[:, :, None] & other_in[:, None, :]
        return ~same.any((1, 2))

    ok &= apart(a, c, np.arange(-_EDIT, 0), np.arange(-_EDIT - 2, 2)) & apart(b, d, np.arange(_EDIT), np.arange(-2, _EDIT + 2))
    return ok, a, b


def _parts(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Limits of runs of items whose sizes add up to `most`; a larger one is a run of its own."""
    low = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield low, i
            low, held = i, 0
        held += n
    if sizes:
        yield low, len(sizes)


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


def _distinct(values: np.ndarray) -> np.ndarray:
    ordered = np.sort(values)
    first = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:])
    return ordered[first]


def repeated_passages(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc_id, first_word int, end_word int, of_doc (an earlier document with the passage), similarity double.

    Overlapping findings of a document are merged; word numbers count white-space-separated words from 0.
    """
    width = min_words - SHINGLE + 1
    scratch = Scratch(docs.sparkSession, "repeated_passages")
    docs = one_row_per_id(bounded_batches(docs).select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = scratch.stage(_token_counts(docs, width), "shared")
    live = scratch.stage(_windows(docs, width).join(shared.hint("shuffle_hash"), "key").drop("key"), "windows")
    scratch.drop("shared")

    sided = live.select("doc_id", "at", "back", "ahead", "j", F.explode(F.array("lefts", "rights")).alias("g")).where("g IS NOT NULL")
    met = scratch.stage(_met(sided), "met")
    scratch.drop("windows")
    spans = scratch.stage(_spans(met, width), "spans")
    wanted = scratch.stage(_cover_first(_supported(spans)), "wanted")
    found = _found(docs, wanted, None, width, scratch)

    # windows that no verified passage holds meet again; in a group of two there is nobody left to meet
    left = met.where("many > 2 AND (doc_id <> head.doc_id OR at <> head.at)")
    left = left.select("g", "doc_id", "at", "back", "ahead", "j", (F.col("doc_id") == F.col("head.doc_id")).alias("first"))
    left = _outside(left.withColumns({"first_at": F.col("at"), "last_at": F.col("at")}), _held(found, kind)).drop("first_at", "last_at")
    left = scratch.stage(left.distinct(), "left")
    scratch.drop("met", "wanted")
    new = scratch.stage(_spans(scratch.stage(_met(_by_context(left, docs, width)), "finer"), width), "spans")
    # pairs that these windows support, with what the first meeting saw of them
    again = _supported(spans.unionByName(new)).join(new.select("doc_id", "of_doc").distinct(), ["doc_id", "of_doc"])
    wanted = scratch.stage(_cover_first(_outside(again, _held(found, kind))), "wanted")
    found = _found(docs, wanted, found, width, scratch)
    passages = scratch.stage(_merged(found, kind), "passages")
    scratch.keep("passages")
    return passages


def _found(docs: DataFrame, wanted: DataFrame, known: DataFrame | None, width: int, scratch: Scratch) -> DataFrame:
    """Findings so far and those of wanted: first the spans that cover a document's candidates, then those that no verified passage holds."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tokens = scratch.stage(_tokens(docs, wanted.select("doc_id").union(wanted.select("of_doc"))), "tokens")
    first = scratch.stage(_verified_spans(wanted.where("cover"), tokens, width), "verified")
    found = first if known is None else known.unionByName(first)
    rest = scratch.stage(_outside(wanted.where("NOT cover"), _held(found, kind)), "rest")
    found = found.unionByName(scratch.stage(_verified_spans(rest, tokens, width), "verified"))
    scratch.drop("tokens", "rest")
    return found


def _met(sided: DataFrame) -> DataFrame:
    """Windows of groups with two documents or more, each with its group's earliest window as head and with how many there are."""
    ends = sided.groupBy("g").agg(F.min(F.struct("doc_id", "at", "back", "ahead")).alias("head"), F.max("doc_id").alias("last"), F.count("*").alias("many"))
    return sided.join(ends.where("head.doc_id < last").drop("last").hint("shuffle_hash"), "g")


def _supported(spans: DataFrame) -> DataFrame:
    """Spans of pairs that enough hash functions support."""
    support = spans.groupBy("doc_id", "of_doc").agg(F.bit_count(F.bit_or("hashes")).alias("n")).where(F.col("n") >= ENOUGH).drop("n")
    return spans.join(support, ["doc_id", "of_doc"]).drop("hashes")


def _by_context(left: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Windows in their group without its first document, and in a group for each min-hash of the tokens on either side."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            keys = []
            for side, name in enumerate(("before", "after")):
                cuts = [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(name)]
                limits = np.concatenate(([0], np.cumsum([len(c) for c in cuts]))).astype(np.int64)
                whole = np.concatenate([*cuts, np.zeros(0, np.uint32)]).astype(np.uint64)
                for i in range(CONTEXTS):
                    least = np.minimum.reduceat(seeded(whole, 50 + i), limits[:-1]) if len(cuts) else np.zeros(0, np.uint64)
                    keys.append(mix(least + _U(2 * i + side)).view(np.int64))
            flat = np.stack(keys, 1).ravel() if keys else np.zeros(0, np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, 2 * CONTEXTS), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("at"), listed], names=["doc_id", "at", "contexts"])

    places = left.select("doc_id", "at").distinct()
    # both sides are shuffled, also small ones: a task whose tokens come from Python in the same stage would need two workers
    cut = places.join(_tokens(docs, left.select("doc_id")).hint("merge"), F.col("doc_id") == F.col("id"))
    before = F.expr(f"substring(tokens, 4 * greatest(at - {width - 1}, 0) + 1, 4 * (at - greatest(at - {width - 1}, 0) + 1))")
    cut = cut.select("doc_id", "at", before.alias("before"), F.expr(f"substring(tokens, 4 * at + 1, {4 * width})").alias("after"))
    contexts = cut.mapInArrow(run, f"doc_id {kind}, at int, contexts array<bigint>")
    rows = left.join(contexts, ["doc_id", "at"]).withColumn("context", F.explode(F.when(F.col("first"), F.col("contexts")).otherwise(F.array_append("contexts", F.lit(0).cast("long")))))
    return rows.select("doc_id", "at", "back", "ahead", "j", F.xxhash64("g", "context").alias("g"))


def _spans(met: DataFrame, width: int) -> DataFrame:
    """Aligned windows that overlap by a passage with an earlier head of their group, by pair of documents and shift."""
    met = met.where("doc_id > head.doc_id")
    reach_back, reach = F.least("back", F.col("head.back")), F.least("ahead", F.col("head.ahead"))
    met = met.where(reach_back + reach + 1 >= width)
    shift = F.col("at") - F.col("head.at")
    return met.groupBy("doc_id", F.col("head.doc_id").alias("of_doc"), shift.alias("shift")).agg(
        F.min(F.col("at") - reach_back).alias("low"), F.max(F.col("at") + reach).alias("high"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.bit_or(F.expr("shiftleft(1, j)")).alias("hashes")
    )


def _held(found: DataFrame, kind: str) -> DataFrame:
    return _merged(found, kind).groupBy("doc_id").agg(F.collect_list(F.struct("first_word", "end_word")).alias("held"))


def _outside(rows: DataFrame, held: DataFrame) -> DataFrame:
    """Rows whose tokens from first_at to last_at are in no verified passage of the document."""
    inside = F.exists("held", lambda h: (h["first_word"] <= F.col("first_at")) & (F.col("last_at") + SHINGLE <= h["end_word"]))
    return rows.join(held, "doc_id", "left").where(~F.coalesce(inside, F.lit(False))).drop("held")


def _cover_first(wanted: DataFrame) -> DataFrame:
    """wanted with cover: whether a span is one of the long ones that together cover the document's spans."""
    fields = ["of_doc", "shift", "low", "high", "first_at", "last_at"]
    kind = wanted.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            out = []
            for spans in batch.column("spans").to_pylist():
                covered, flags = np.zeros(max(s["high"] for s in spans) + 1, bool), [False] * len(spans)
                for i in sorted(range(len(spans)), key=lambda i: (spans[i]["low"] - spans[i]["high"], spans[i]["of_doc"], spans[i]["shift"])):
                    part = covered[spans[i]["low"] : spans[i]["high"] + 1]
                    flags[i] = not part.all()
                    part[:] = True
                out.append(flags)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("spans"), pa.array(out, pa.list_(pa.bool_()))], names=["doc_id", "spans", "covers"])

    types = ", ".join(f"{c}: {wanted.schema[c].dataType.simpleString()}" for c in fields)
    # a document's spans: their number is bounded by its own windows
    gathered = wanted.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("spans"))
    flagged = gathered.mapInArrow(run, f"doc_id {kind}, spans array<struct<{types}>>, covers array<boolean>")
    flat = flagged.select("doc_id", F.explode(F.arrays_zip("spans", "covers")).alias("x"))
    return flat.select("doc_id", *[F.col(f"x.spans.{c}").alias(c) for c in fields], F.col("x.covers").alias("cover"))


def _tokens(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and tokens (32 bits each) of the documents with these ids: each text is hashed once, however many pairs it is in."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, "text"):
            grams, ptr = shingles_of(words_of(texts), SHINGLE)
            small = grams.astype(np.uint32)
            packed = pa.array([small[a:b].tobytes() for a, b in zip(ptr[:-1], ptr[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("id"), packed], names=["id", "tokens"])

    return with_id_in(docs, ids).select(F.col("doc_id").alias("id"), "text").mapInArrow(run, f"id {kind}, tokens binary")


def _verified_spans(wanted: DataFrame, tokens: DataFrame, width: int) -> DataFrame:
    """Passages that the tokens bear out. Only the wanted stretches of both ends, cut out by Spark, are sent to Python."""
    kind = wanted.schema["doc_id"].dataType.simpleString()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            rows = []
            begin, there, shift, first, last = (batch.column(c).to_numpy().astype(np.int64) for c in ("begin", "begin_there", "shift", "first_at", "last_at"))
            own, other = ([np.frombuffer(v.as_buffer(), np.uint32) for v in batch.column(c)] for c in ("own", "other"))
            first, last, meets = first - begin, last - begin, first - shift - there
            for low, high in _parts([len(x) + len(y) for x, y in zip(own, other, strict=True)], CHUNK_TOKENS):
                part = slice(low, high)
                plain, starts, ends = plain_runs(own[part], other[part], first[part], last[part], meets[part])
                for i in range(low, high):
                    if plain[i - low]:
                        a, b = int(starts[i - low]), int(ends[i - low])
                        spans = [(a, b, 1.0)] if b - a >= width else []
                    else:
                        spans = around(own[i], other[i], int(first[i]), int(last[i]), int(meets[i]), width)
                    rows += [(i, int(begin[i]) + a, int(begin[i]) + b + SHINGLE - 1, s) for a, b, s in spans]
            if rows:
                i, a, b, s = zip(*rows, strict=True)
                at = pa.array(i)
                columns = [batch.column("doc_id").take(at), pa.array(a, pa.int32()), pa.array(b, pa.int32()), batch.column("of_doc").take(at), pa.array(s)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "first_word", "end_word", "of_doc", "similarity"])

    def stretch(first: str, end: str) -> Column:
        return F.expr(f"substring(tokens, 4 * {first} + 1, 4 * greatest({end} - {first}, 0))")

    low, high, shift = F.col("low"), F.col("high"), F.col("shift")
    ends = [F.greatest(F.lit(0), c).alias(n) for c, n in ((low - _SLACK, "begin"), (high + 1 + _SLACK, "end"), (low - shift - _SLACK, "begin_there"), (high - shift + 1 + _SLACK, "end_there"))]
    spans = wanted.select("doc_id", "of_doc", "shift", "first_at", "last_at", *ends)
    places = ["doc_id", "of_doc", "shift", "first_at", "last_at", "begin", "begin_there"]
    others = spans.join(tokens, F.col("of_doc") == F.col("id")).select(*places, "end", stretch("begin_there", "end_there").alias("other"))
    # rows are small and the work on them isn't: as many tasks as a shuffle has, not as few as their bytes would fill
    others = others.repartition(int(wanted.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    both = others.join(tokens, F.col("doc_id") == F.col("id")).select(*places, stretch("begin", "end").alias("own"), "other")
    return both.mapInArrow(confirm, f"doc_id {kind}, first_word int, end_word int, of_doc {kind}, similarity double")


def _merged(found: DataFrame, kind: str) -> DataFrame:
    """Overlapping findings of a document as one passage."""
    # passages of a document: a finding that starts past all ends before it opens a new one
    gathered = found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("first_word", "end_word", "of_doc", "similarity"))).alias("spans"))
    merged = F.expr(
        "aggregate(spans, cast(array() as array<struct<first_word:int,end_word:int,of_doc:" + kind + ",similarity:double>>), (out, s) -> "
        "if(size(out) = 0 or element_at(out, -1).end_word < s.first_word, concat(out, array(s)), "
        "concat(slice(out, 1, size(out) - 1), array(named_struct('first_word', element_at(out, -1).first_word, 'end_word', greatest(element_at(out, -1).end_word, s.end_word), "
        "'of_doc', least(element_at(out, -1).of_doc, s.of_doc), 'similarity', greatest(element_at(out, -1).similarity, s.similarity))))))"
    )
    return gathered.select("doc_id", F.explode(merged).alias("p")).select("doc_id", "p.*")


def without_passages(docs: DataFrame, passages: DataFrame, text: str = "text") -> DataFrame:
    """docs, the words of the passages cut from the texts; documents of which no word is left go."""
    spans = passages.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first_word", "end_word"))).alias("__spans")).withColumnRenamed("doc_id", "__id")

    # only documents with a passage are shuffled and rewritten
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = perhaps_in(docs, spans.select("__id"))

    @F.pandas_udf("string")
    def cut(texts, spans):
        import pandas as pd

        out = []
        for t, found in zip(texts, spans, strict=True):
            if found is None:
                out.append(t)
                continue
            w = words_of([t])
            parts, at = [], 0
            for s in found:
                end = min(s["end_word"], len(w.starts))
                if s["first_word"] >= end:
                    continue
                parts.append(w.data[at : w.starts[s["first_word"]]])
                at = int(w.ends[end - 1])
            parts.append(w.data[at:])
            out.append(b"".join(parts).decode("utf-8", "surrogatepass").strip())
        return pd.Series(out, dtype=object)

    same = marked.where("NOT __perhaps").select(*columns)
    joined = marked.where("__perhaps").join(spans, F.col("doc_id") == F.col("__id"), "left")
    # as non-deterministic, since Spark else cuts twice, for the condition and for the result, each in a worker of its own that stays
    cut = cut.asNondeterministic()
    less = joined.withColumn(text, cut(F.col(text), F.col("__spans"))).where(F.col("__spans").isNull() | (F.trim(text) != "")).select(*columns)
    return same.unionByName(less)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
