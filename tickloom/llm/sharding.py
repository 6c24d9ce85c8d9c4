"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

A row descends region, rack and shard levels. On each level every child of the node reached draws
-ln(u) / weight, u being a hash of the row's key and the child's name, and the smallest draw wins, so that a child is
taken in proportion to its weight. A draw depends on nothing but key, child and weight: when weights change, rows move
only into or out of the subtrees whose weights change. A shard added to a tree opens a region of its own, no
other node's weight changes, and so rows move into that shard only.

Cases: a null key is a key like any other (the word null); a null text has no bytes, size 16 and a null checksum;
repeated rows and equal keys go to one shard and get slots of their own, in the order of the staged table; draws never tie
but for equal names; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import staged

#: The regular part of the tree; shards past the base open regions of their own.
BASE_SHARDS, SHARDS_A_RACK, RACKS_A_REGION = 40, 5, 2
ROWS_A_BLOCK = 50_000


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def regular_tree(shards: int, base: int = BASE_SHARDS) -> list[Shard]:
    """`base` shards in full racks and regions, each further shard in a region and rack of its own."""
    racks, regions = -(-base // SHARDS_A_RACK), -(-base // (SHARDS_A_RACK * RACKS_A_REGION))
    out = []
    for s in range(shards):
        rack = s // SHARDS_A_RACK if s < base else racks + s - base
        region = rack // RACKS_A_REGION if s < base else regions + s - base
        out.append(Shard(region, rack, s))
    return out


def _draw(key: Column, level: str, node: Column, weight: Column) -> Column:
    name = F.concat(key, F.lit(f"/{level}"), node.cast("string"))
    u = (F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(16**12 + 1))
    return -F.log(u) / weight


def _choose(key: Column, level: str, children: Column) -> Column:
    """The child with the smallest draw, of an array of (node, weight)."""
    drawn = F.transform(children, lambda c: F.struct(_draw(key, level, c["node"], c["weight"]), c["node"]))
    return F.array_min(drawn)["node"]


def _children(tree: list[Shard], parent: str | None, child: str) -> dict[int | None, dict[int, float]]:
    out: dict[int | None, dict[int, float]] = {}
    for s in tree:
        under = out.setdefault(getattr(s, parent) if parent else None, {})
        under[getattr(s, child)] = under.get(getattr(s, child), 0.0) + s.weight
    return out


def _array(nodes: dict[int, float]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("node"), F.lit(w).alias("weight")) for n, w in sorted(nodes.items())])


def _level(tree: list[Shard], parent: str, child: str, at: Column) -> Column:
    pairs = [x for node, nodes in sorted(_children(tree, parent, child).items()) for x in (F.lit(node), _array(nodes))]
    return F.element_at(F.create_map(*pairs), at)


def assign(df: DataFrame, key: str, tree: list[Shard], out: str = "shard") -> DataFrame:
    """df with the shard of each row in column `out`, in place of one of that name; the key may be of any type with a string form."""
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))
    df = df.withColumn("__region", _choose(text, "region", _array(_children(tree, None, "region")[None])))
    df = df.withColumn("__rack", _choose(text, "rack", _level(tree, "region", "rack", F.col("__region"))))
    df = df.withColumn(out, _choose(text, "shard", _level(tree, "rack", "shard", F.col("__rack"))))
    return df.drop("__region", "__rack")


def with_slots(df: DataFrame, shard: str, order: list[str], rows: int) -> DataFrame:
    """df with a gapless slot in each shard, in place of a column `slot`: numbered in `order` inside blocks of a shard, the blocks laid end to end.

    df is a table as read from storage: rows are dealt to blocks by their number in it, so that equal rows are split too.
    """
    blocks = max(1, -(-rows // ROWS_A_BLOCK))
    df = df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__block", F.pmod(F.xxhash64("__row"), F.lit(blocks)).cast("int"))
    # one row for each shard and block: what a window of one shard sees is the number of blocks
    sizes = df.groupBy(shard, "__block").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(shard).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(shard, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy(shard, "__block").orderBy(*order, "__row"))
    out = df.join(offsets, [shard, "__block"]).withColumn("slot", (F.col("__before") + place - 1).cast("long"))
    return out.drop("__block", "__before", "__row")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.count()
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = assign(sized, "doc_id", regular_tree(BASE_SHARDS), "shard")
    placed = assign(placed, "doc_id", regular_tree(BASE_SHARDS + 1), "grown_shard")
    placed = staged(placed, "shards")  # the draws are made once; slots need two passes
    slotted = with_slots(placed, "shard", ["doc_id"], rows)
    return slotted.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
