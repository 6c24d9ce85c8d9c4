"""Approximate nearest neighbours: an NN-descent graph built by Spark joins, searched greedily.

Equal vectors are one node, which knows its smallest ids. The graph starts from random-projection tables: nodes with equal
sign codes, in blocks of a bounded number, find their nearest in the block. Then NN-descent: in each round a node's
neighbours, and nodes that have it as neighbour, are compared among each other at that node if one of them is new there;
each node keeps its best, until few links change. Nodes that share a code are one block of this work, so that a vector
travels once to a block, not along every link. A search keeps for each query a list of the best nodes found; in each round
the best ones not yet visited are joined with the graph, and their neighbours join the list, until all nodes of every list are visited.
What is found is scored again in double precision on the original vectors.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part; vectors of different lengths
are neighbours of none but their own length; rows with a null id take no part; ties go to the smaller id; with fewer
candidates than asked for, all are returned; of repeated ids the vector that sorts first counts; an empty table gives
an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import Scratch, one_row_per_id

NEIGHBOURS = 20
TABLES, BLOCK = 8, 512
#: The descent ends when no more than this share of all links is new, or after so many rounds.
FEW_NEW, ROUNDS = 0.02, 8
#: The most similar nodes that have a node as neighbour and meet at it in one round; the rest meet it through others.
REVERSE = 20
#: In the search a node leads to all its neighbours and to so many of those that have it as neighbour, the most similar first.
BACK = 60
#: Nodes of a query's list, and how many of them it leaves by in one round: a round costs shuffles, whatever their rows.
LIST, EXPANDED = 144, 72
_SEED = 20240229


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision, on the vectors as they are; scaled first where squares would leave the range of a double."""
    x, y = (F.transform(v, lambda e: e.cast("double")) for v in (a, b))

    def parts(x, y):
        return _sum(F.zip_with(x, y, lambda p, q: p * q)), F.sqrt(_sum(F.transform(x, lambda e: e * e))), F.sqrt(_sum(F.transform(y, lambda e: e * e)))

    def scaled(v):
        top = F.array_max(F.transform(v, lambda e: F.abs(e)))
        return F.transform(v, lambda e: e / top)

    dot, n, m = parts(x, y)
    plain = n.between(1e-140, 1e140) & m.between(1e-140, 1e140)
    dot_s, n_s, m_s = parts(scaled(x), scaled(y))
    return F.when(plain, F.try_divide(dot, n * m)).otherwise(dot_s / (n_s * m_s))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: one finite non-zero vector for each id."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & ~bad)
    return one_row_per_id(rows.where(F.exists("v", lambda x: x != 0)), "id", "v")


def _stack(vectors) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), np.float16).reshape(len(vectors), -1).astype(np.float32)


def _with_unit(rows: DataFrame, tables: int, bits: int) -> DataFrame:
    """node, vec (unit length, 16-bit), codes: the sign code in each table, of which vectors of another length have others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column("v")])
            for size in np.unique(lengths).tolist():
                part = batch.take(pa.array(np.flatnonzero(lengths == size)))
                x = part.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                x = x / np.abs(x).max(1, keepdims=True)
                unit = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float32)
                if size not in planes:
                    planes[size] = np.random.default_rng(_SEED).standard_normal((size, tables * bits)).astype(np.float32)
                signs = (unit @ planes[size] > 0).reshape(len(unit), tables, bits)
                codes = (signs * (1 << np.arange(bits, dtype=np.int64))).sum(2) + ((np.arange(tables, dtype=np.int64) + tables * size) << 40)
                packed = pa.array([r.tobytes() for r in unit.astype(np.float16)], pa.binary())
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables), pa.int32()), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("node"), packed, listed, pa.array(np.full(len(unit), size, np.int32))], names=["node", "vec", "codes", "size"])

    return rows.select("node", "v").mapInArrow(run, "node bigint, vec binary, codes array<bigint>, size int")


def _best(edges: DataFrame, k: int, by: str = "u") -> DataFrame:
    """The k most similar of each u; Spark limits each partition before the shuffle."""
    order = Window.partitionBy(by).orderBy(F.desc("sim"), "v")
    return edges.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")


def _blocked(coded: DataFrame) -> DataFrame:
    """Blocks of nodes that share a code: rows of at most about BLOCK nodes (two in three blocks hold fewer)."""
    rows = coded.select("node", "vec", F.explode("codes").alias("code"))
    sizes = rows.groupBy("code").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    salted = rows.join(sizes, "code").withColumn("salt", F.pmod(F.xxhash64("node", "code"), F.col("parts")))
    return salted.groupBy("code", "salt").agg(F.collect_list(F.struct("node", "vec")).alias("rows"))


def _members(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    values = cell.values
    return values.field("node").to_numpy(), _stack(values.field("vec").to_pylist())


def _first_graph(blocks: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("rows"):
                ids, x = _members(cell)
                m = min(k, len(ids) - 1)
                if m < 1:
                    continue
                for low in range(0, len(ids), BLOCK):
                    sim = x[low : low + BLOCK] @ x.T
                    sim[np.arange(len(sim)), np.arange(low, low + len(sim))] = -9
                    near = np.argpartition(-sim, m - 1, axis=1)[:, :m]
                    yield _edges(np.repeat(ids[low : low + BLOCK], m), ids[near].ravel(), np.take_along_axis(sim, near, 1).ravel())

    return blocks.select("rows").mapInArrow(run, "u bigint, v bigint, sim float")


def _edges(u, v, sim) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(sim, pa.float32())], names=["u", "v", "sim"])


def _compare(links: pa.Table, vectors: pa.Table) -> pa.Table:
    """One block: at each pivot, pairs of nodes of which one is new there and that beat the worst neighbour of one of them."""
    vectors = vectors.sort_by("id")
    ids, x, worst = vectors.column("id").to_numpy(), _stack(vectors.column("vec").to_pylist()), vectors.column("worst").to_numpy()
    links = links.sort_by([("pivot", "ascending"), ("node", "ascending")])
    pivot, fresh = links.column("pivot").to_numpy(), links.column("fresh").to_numpy(zero_copy_only=False)
    at = np.searchsorted(ids, links.column("node").to_numpy())
    cuts = np.flatnonzero(np.diff(pivot, prepend=pivot[:1] - 1, append=pivot[-1:] + 1))
    us, vs, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for low, high in zip(cuts[:-1], cuts[1:], strict=True):
        here, new = at[low:high], fresh[low:high]
        if len(here) < 2 or not new.any():
            continue
        sim = x[here] @ x[here].T
        ok = (new[:, None] | new[None, :]) & (sim > worst[here][:, None]) & ~np.eye(len(here), dtype=bool)
        a, b = np.nonzero(ok)
        if len(a) > 4 * len(here):  # each node takes its most similar few of a pivot; the rest would hardly stay
            masked = np.where(ok, sim, -9)
            near = np.argpartition(-masked, min(6, len(here) - 1), axis=1)[:, :6]
            a, b = np.repeat(np.arange(len(here)), near.shape[1]), near.ravel()
            keep = ok[a, b]
            a, b = a[keep], b[keep]
        us.append(ids[here[a]])
        vs.append(ids[here[b]])
        sims.append(sim[a, b])
    u, v, sim = np.concatenate(us), np.concatenate(vs), np.concatenate(sims)
    # several pivots bring the same pair: it leaves the block once
    order = np.lexsort((-sim, v, u))
    u, v, sim = u[order], v[order], sim[order]
    first = np.append(True, (u[1:] != u[:-1]) | (v[1:] != v[:-1]))[: len(u)]
    return pa.Table.from_batches([_edges(u[first], v[first], sim[first])])


def build_graph(nodes: DataFrame, count: int, scratch: Scratch, k: int = NEIGHBOURS) -> DataFrame:
    """nodes has node, vec and codes; the graph has u, v, sim: about the k nearest of each u."""
    # dealt by u once: both the grouping by u and v and the choice of the best need no other shuffle
    pairs = _first_graph(_blocked(nodes), k).repartition("u").groupBy("u", "v").agg(F.max("sim").alias("sim"))
    graph = _best(pairs, k).withColumn("fresh", F.lit(True))
    graph = scratch.stage(graph, "graph_0")
    # where each node's work is done: with nodes that share its first code, in parts of about BLOCK
    coded = nodes.select("node", F.col("codes")[0].alias("code"))
    parts = coded.groupBy("code").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    home = scratch.stage(coded.join(parts, "code").select(F.col("node").alias("pivot"), F.xxhash64("code", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("block")), "home")
    for turn in range(ROUNDS):
        worst = graph.groupBy("u").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0).cast("float")).alias("worst"))
        order = Window.partitionBy("v").orderBy(F.desc("fresh"), F.desc("sim"), "u")
        back = graph.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= REVERSE)
        meet = graph.select("u", "v", "fresh").unionByName(back.select(F.col("v").alias("u"), F.col("u").alias("v"), "fresh")).repartition("u").groupBy("u", "v").agg(F.max("fresh").alias("fresh"))
        links = meet.select(F.col("u").alias("pivot"), F.col("v").alias("node"), "fresh").join(home, "pivot")
        carried = nodes.select("node", "vec").join(worst, F.col("node") == F.col("u")).select("node", "vec", "worst")
        sent = links.select("block", "node").distinct().join(carried, "node").select(F.col("block").alias("into"), F.col("node").alias("id"), "vec", "worst")
        found = links.groupBy("block").cogroup(sent.groupBy("into")).applyInArrow(_compare, "u bigint, v bigint, sim float")
        both = graph.withColumn("old", F.lit(True)).select("u", "v", "sim", "old").unionByName(found.withColumn("old", F.lit(False)))
        both = both.repartition("u").groupBy("u", "v").agg(F.max("sim").alias("sim"), (~F.max("old")).alias("fresh"))
        graph = scratch.stage(_best(both, k), f"graph_{turn + 1}")
        scratch.drop(f"graph_{turn}")
        if graph.where("fresh").count() <= FEW_NEW * k * count:
            break
    return graph.select("u", "v", "sim")


def search(queries: DataFrame, nodes: DataFrame, graph: DataFrame, entries: DataFrame, scratch: Scratch) -> DataFrame:
    """query, node, sim: the list of each query at the end. queries: query, qvec; entries: query, node."""
    order = Window.partitionBy("v").orderBy(F.desc("sim"), "u")
    back = graph.withColumn("r", F.row_number().over(order)).where(F.col("r") <= BACK).select(F.col("v").alias("u"), F.col("u").alias("v"))
    # one row a node; its number of links is bounded
    links = scratch.stage(graph.select("u", "v").union(back).groupBy("u").agg(F.collect_set("v").alias("vs")), "links")
    vectors = nodes.select("node", "vec")

    @F.pandas_udf("float")
    def similarity(q, v):
        import pandas as pd

        return pd.Series([np.dot(np.frombuffer(a, np.float16).astype(np.float32), np.frombuffer(b, np.float16).astype(np.float32)) for a, b in zip(q, v, strict=True)], dtype=np.float32)

    best = Window.partitionBy("query").orderBy(F.desc("sim"), "node")
    next_ = Window.partitionBy("query").orderBy("seen", F.desc("sim"), "node")

    def listed(fresh: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """The best nodes of each query, and which it leaves by next (go)."""
        met = fresh.join(vectors, "node").join(queries, "query")
        rows = met.select("query", "node", similarity("qvec", "vec").alias("sim"), F.lit(False).alias("seen"))
        if known is not None:
            rows = rows.unionByName(known.select("query", "node", "sim", (F.col("seen") | F.col("go")).alias("seen")))
        rows = rows.withColumn("r", F.row_number().over(best)).where(F.col("r") <= LIST)
        return rows.withColumn("go", ~F.col("seen") & (F.row_number().over(next_) <= EXPANDED)).drop("r")

    found, turn = scratch.stage(listed(entries.distinct()), "found_0"), 0
    while True:
        now = found.where("go")
        if now.isEmpty():
            return found.select("query", "node", "sim")
        near = now.join(links, F.col("node") == F.col("u")).select("query", F.explode("vs").alias("node"), F.lit(True).alias("new"))
        # met before or by another way: all of a query's rows are in one task, so that counting them out needs no other shuffle
        met = near.unionByName(found.select("query", "node", F.lit(False).alias("new"))).repartition("query").groupBy("query", "node").agg(F.min("new").alias("new"))
        found = scratch.stage(listed(met.where("new").select("query", "node"), found), f"found_{turn + 1}")
        scratch.drop(f"found_{turn}")
        turn += 1


def nearest(vectors: DataFrame, query_ids: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that query_ids (on column id) holds for."""
    scratch = Scratch(vectors.sparkSession, "nearest")
    rows = usable(vectors, key, vector)
    rows = scratch.stage(rows.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")}), "vectors")
    least = Window.partitionBy("h1", "h2").orderBy("id")
    kept = rows.withColumn("r", F.row_number().over(least)).where(F.col("r") <= k + 1)
    groups = scratch.stage(kept.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.min_by("v", "id").alias("v")).withColumn("node", F.col("ids")[0]), "groups")
    count = groups.count()
    bits = max(1, int(np.ceil(np.log2(max(count / (BLOCK / 2), 2)))))
    nodes = scratch.stage(_with_unit(groups, TABLES, bits), "nodes")
    graph = build_graph(nodes, count, scratch)

    asked = scratch.stage(rows.where(query_ids).join(groups.select("h1", "h2", "node"), ["h1", "h2"]).select("id", "v", "node"), "asked")
    queries = scratch.stage(asked.select(F.col("node").alias("query")).distinct().join(nodes.withColumnRenamed("node", "query"), "query").select("query", F.col("vec").alias("qvec"), "codes", "size"), "queries")
    # a few nodes of the query's block in each table, whether or not the query is a node itself
    coded = nodes.select("node", F.explode("codes").alias("code"))
    order = Window.partitionBy("code").orderBy(F.xxhash64("node"))
    doors = coded.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 16).select("code", "node")
    entries = queries.select("query", F.explode("codes").alias("code")).join(doors, "code").select("query", "node")
    some = Window.partitionBy("size").orderBy(F.xxhash64("node"))
    any_ = nodes.select("size", "node").withColumn("r", F.row_number().over(some)).where(F.col("r") <= 16).select("size", "node")  # for codes that no node has
    entries = entries.union(queries.select("query", "size").join(any_, "size").select("query", "node"))
    found = search(queries.select("query", "qvec"), nodes, graph, entries, scratch)

    others = found.select(F.col("query").alias("q"), F.col("node").alias("n")).union(queries.select("query", "query")).distinct()
    members = groups.select(F.col("node").alias("n"), F.col("v").alias("nv"), "ids")
    met = asked.join(others, F.col("node") == F.col("q")).select(F.col("id").alias("query_id"), "v", "n").join(members, "n")
    scores = met.select("query_id", cosine(F.col("v"), F.col("nv")).alias("score"), F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).alias("rank")
    best = scratch.stage(scores.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k), "best")
    scratch.keep("best")
    return best


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.pmod(F.col("id"), F.lit(50)) == 0, 5)
