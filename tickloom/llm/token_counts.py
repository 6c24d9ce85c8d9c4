"""Token counts with a whole-token shortcut.

Offline, once per tokenizer, every vocabulary string is encoded alone; those that give exactly one token are the
proven set. A text is cut into pre-tokens by the tokenizer's own pattern; a proven pre-token counts 1 without any
merging, and only the other pre-tokens of a batch, each distinct one once, go through the merges.

Cases: a null or empty text has 0 tokens and 0 bytes; texts of any length are counted whole; repeated rows and rows
with a null id are counted each for itself; the input's other columns play no part.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm.shared import bounded_batches, slices

#: The byte-level pre-token pattern and the printable stand-ins of bytes in the vocabulary.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Distinct merged pre-tokens that a worker remembers before it starts afresh: bounds memory, never results.
REMEMBERED = 400_000


def _byte_of() -> dict[str, int]:
    stand_in = dict(zip(map(chr, _PRINTABLE), _PRINTABLE, strict=True))
    rest = [b for b in range(256) if b not in set(_PRINTABLE)]
    return stand_in | {chr(256 + i): b for i, b in enumerate(rest)}


def proven_whole(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and that the tokenizer encodes alone as one token."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of, added = _byte_of(), {t["content"] for t in spec["added_tokens"]}
    strings = []
    for token in spec["model"]["vocab"]:
        if token not in added:
            try:
                strings.append(bytes(byte_of[c] for c in token).decode("utf-8"))
            except UnicodeDecodeError:
                continue
    strings = [s for s in strings if PRETOKEN.findall(s) == [s]]
    tokenizer, whole = Tokenizer.from_file(path), []
    for low in range(0, len(strings), 5000):  # the encodings of a part at a time
        part = strings[low : low + 5000]
        whole += [s for s, e in zip(part, tokenizer.encode_batch(part, add_special_tokens=False), strict=True) if len(e.ids) == 1]
    return frozenset(whole)


@lru_cache(2)
def _merger(path: str) -> tuple[tiktoken.Encoding, regex.Pattern | None]:
    """What merges one pre-token, and the pattern of the special strings that the tokenizer takes out of a text first."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    byte_of, special, vocab = _byte_of(), {t["content"] for t in spec["added_tokens"]}, spec["model"]["vocab"]
    if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(spec["model"]["merges"])):
        raise ValueError(f"{path}: the merges aren't in the order of their ids")
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in special}
    merges = tiktoken.Encoding("merges", pat_str=PRETOKEN.pattern, mergeable_ranks=ranks, special_tokens={})
    return merges, special and regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) or None


class _Known(dict):
    """Tokens of a pre-token: 1 for the proven ones, merged when first met for the rest."""

    def __init__(self, whole: frozenset[str], merges: tiktoken.Encoding):
        super().__init__(dict.fromkeys(whole, 1))
        self.merge = merges._encode_single_piece

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.merge(piece))
        return n


class TokenCounter:
    """Counts the tokens of texts inside a task."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.merges, self.special = _merger(path)
        self.whole, self.known = whole, _Known(whole, self.merges)

    def counts(self, texts: list[str]) -> list[int]:
        if len(self.known) > len(self.whole) + REMEMBERED:
            self.known = _Known(self.whole, self.merges)
        get, out = self.known.__getitem__, []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            out.append(len(parts) - 1 + sum(sum(map(get, PRETOKEN.findall(part))) for part in parts))
        return out


def _whole(spark: SparkSession, path: str) -> frozenset[str]:
    """proven_whole(path), found in a task: the tokenizer takes memory that the driver's process would not give back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(sorted(proven_whole(path)), pa.string())], names=["piece"])

    return frozenset(spark.range(0, 1, 1, 1).mapInArrow(run, "piece string").toArrow().column("piece").to_pylist())  # at most the vocabulary


def count_tokens(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The kept columns of df and n_tokens long, in place of a column of that name; `path` is a byte-level BPE tokenizer file that every worker can read."""
    spark = df.sparkSession
    whole = spark.sparkContext.broadcast(_whole(spark, path))  # at most the vocabulary
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text, "n_tokens")]
    names = [f"c{i}" for i in range(len(keep))]  # any column names
    source = bounded_batches(df).select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`")).toDF(*names, "__text")
    fields = [f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path, whole.value)
        for part, texts in slices(batches, "__text"):
            columns = [part.column(n) for n in names] + [pa.array(counter.counts(texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_tokens"])

    return source.mapInArrow(run, ", ".join([*fields, "n_tokens bigint"])).toDF(*keep, "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    counted = count_tokens(sized, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
