"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

A document longer than the longest sequence is cut into full pieces and a rest. Pieces are dealt at random to blocks of a
bounded number, each packed by itself: longest first, every piece goes to the open bin with the least room that still
holds it. If none does, a bin is opened, at the permitted length that costs least for each token it will hold: each length
is filled on trial with the longest pieces left that fit, so that the lengths are weighed jointly against what is still
to be packed. At the end each bin is cut down to the least permitted length that holds its contents. The cost of a
sequence grows faster than its length (attention), which weighs padding against length.

Cases: a document without tokens is a row with no bin; documents of any length are packed whole; ties go to the first
piece in order of document and position, and to the shorter opening length; repeated rows and rows with a null id are packed
each for itself, dealt by row and not by id; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.shared import staged
from tickloom.llm.token_counts import count_tokens

LENGTHS = (512, 1024, 2048, 4096)
#: Pieces that one task packs at a time.
BLOCK_PIECES = 20_000


def sequence_cost(length: int) -> float:
    """Relative work of one sequence: linear layers plus attention, equal at 16,384 tokens."""
    return length * (1 + length / 16384)


class _Left:
    """How many pieces of each size are left, with the sizes that occur as bits of a number."""

    def __init__(self, sizes: list[int]):
        self.count = [0] * (max(sizes, default=0) + 1)
        for s in sizes:
            self.count[s] += 1
        self.mask = sum(1 << s for s, n in enumerate(self.count) if n)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.mask ^= 1 << size

    def filled(self, room: int) -> int:
        """Tokens that the longest pieces left put into so much room."""
        got, mask = 0, self.mask
        while room > 0:
            mask &= (1 << (room + 1)) - 1
            if not mask:
                break
            size = mask.bit_length() - 1
            fits = min(self.count[size], room // size)
            got += fits * size
            room -= fits * size
            mask ^= 1 << size
        return got


def opening_length(size: int, lengths: tuple[int, ...], left: _Left) -> int:
    """The permitted length that costs least per token, for a bin that begins with `size` tokens and is then filled from what is left."""
    able = [n for n in lengths if n >= size]
    held = {n: size + left.filled(n - size) for n in able}
    # a bin is cut down to its contents in the end, so a length is charged for what it would be cut to
    return min(able, key=lambda n: (sequence_cost(next(m for m in lengths if m >= held[n])) / held[n], n))


def best_fit(sizes: list[int], lengths: tuple[int, ...] = LENGTHS) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each size (sizes in falling order), and each bin's length after cutting down."""
    left = _Left(sizes)
    room_bins: dict[int, list[int]] = {}
    mask = 0  # bit r: a bin with r tokens of room is open
    filled: list[int] = []
    bins, offsets = [], []
    for size in sizes:
        left.take(size)
        able = mask >> size
        if able:
            room = size + (able & -able).bit_length() - 1
            stack = room_bins[room]
            b = stack.pop()
            if not stack:
                mask &= ~(1 << room)
        else:
            room = opening_length(size, lengths, left)
            b = len(filled)
            filled.append(0)
        bins.append(b)
        offsets.append(filled[b])
        filled[b] += size
        if rest := room - size:
            room_bins.setdefault(rest, []).append(b)
            mask |= 1 << rest
    return bins, offsets, [next(n for n in lengths if n >= f) for f in filled]


def pack(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """docs has doc_id and n_tokens; the result has a row for each piece: doc_id, piece, first_token, n_tokens, bin_id, bin_length, bin_offset."""
    lengths, longest = tuple(sorted(lengths)), max(lengths)
    docs = staged(docs.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("total")), "lengths")
    kind = docs.schema["doc_id"].dataType.simpleString()
    count = docs.agg(F.sum(F.ceil(F.col("total") / longest))).first()[0] or 0
    blocks = max(1, -(-count // BLOCK_PIECES))
    # a number for each row of the staged table, the same whenever a task is run again
    pieces = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "total")
    pieces = pieces.select("doc_id", "row", "total", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("total") / longest) - 1, F.lit(0)).cast("int"))).alias("piece"))
    first = F.col("piece").cast("long") * longest
    pieces = pieces.select("doc_id", "row", "piece", first.alias("first_token"), F.least(F.col("total") - first, F.lit(longest)).cast("int").alias("n_tokens"))
    dealt = pieces.where("n_tokens > 0").withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)))

    def run(key: tuple[pa.Scalar, ...], block: pa.Table) -> pa.Table:
        block = block.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("row", "ascending")])
        bins, offsets, sizes = best_fit(block.column("n_tokens").to_pylist(), lengths)
        base = key[0].as_py() << 32
        out = block.select(["doc_id", "piece", "first_token", "n_tokens"])
        out = out.append_column("bin_id", pa.array([base + b for b in bins], pa.int64()))
        out = out.append_column("bin_length", pa.array([sizes[b] for b in bins], pa.int32()))
        return out.append_column("bin_offset", pa.array(offsets, pa.int32()))

    schema = f"doc_id {kind}, piece int, first_token bigint, n_tokens int, bin_id bigint, bin_length int, bin_offset int"
    packed = dealt.groupBy("block").applyInArrow(run, schema)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("bin_id", "long"), ("bin_length", "int"), ("bin_offset", "int"))]
    empty = pieces.where("n_tokens <= 0").select("doc_id", "piece", "first_token", "n_tokens", *none)
    return packed.unionByName(empty)


def packed_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    return pack(count_tokens(docs.select("doc_id", "text"), tokenizer))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
