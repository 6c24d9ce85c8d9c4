"""Mixing sources to target weights by hash-threshold histograms, in DataFrame functions only.

Targets: sources in code point order, a null source last, have the weights 5, 2, 1, 5, 2, 1 ...; they share a multiple of all
words by weight, none more than twice its own words; what a source can't take goes to the others by weight. That is the level
at which weight times level, cut at twice the source, adds up to the budget, found by one running sum over the table of sources.

Documents: a source whose target is at least its size takes every document once; what is left of the target is its budget for
one more copy. Each document has a place on a line of hashes. Words are summed by source and hash bucket; the bucket in which a
running sum passes the budget is cut into buckets again, and so on until it holds one document: all documents before it are
taken. That threshold leaves a rest smaller than one document, which is the budget of the next threshold, further along the line and for
documents that fit into the rest only. When no document fits any more, one that is left is taken too, alone or in exchange for a document that was
taken, whichever of all such steps brings the source nearest to its target: a merge of the sizes of both kinds, each once, tells it. Thresholds are nested: one round's lies past that of the round before, and the filter at the end is a comparison of each document with
the few thresholds of its source; nothing is sorted, and no task holds a source.

The table of sources (one row each) is the one thing that a single task sees.

Cases: a null text has no words; a source without words has the target 0; documents without words take nothing; repeated rows,
rows of one id and rows with a null id are each a document of its own, and since equal rows have equal places, a second hash of the
row's number in the staged table splits them (equal rows are alike, so reruns agree all the same); an empty table gives no rows;
other columns play no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import Scratch

#: Fixed values of the mix.
WEIGHTS = (5, 2, 1)
SHARE, MOST_COPIES = 1.5, 2
#: A place is two hashes of 60 bits, taken apart 12 bits at a time.
BITS, DIGIT = 60, 12
#: Thresholds of a source at most; the rest of each is under one document that was small enough for the one before.
ROUNDS = 8
#: A source is done when what is left of its budget is under a part in so many of its target.
NEAR = 10_000
_SPACE = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """How many runs of characters other than ASCII white space a text has; 0 for null."""
    # each word, with the white space before it, becomes one character: no array of words is made
    marks = F.regexp_replace(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), f"[{_SPACE}]*+[^{_SPACE}]++", "x")
    return F.coalesce(F.length(marks), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, share: float = SHARE, most: int = MOST_COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target of a table (source, source_size long) with a row for each source."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place % len(weights) + 1).cast("int"))
    by_fill = Window.orderBy("fill", F.col("source").asc_nulls_last())
    filled = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    known = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    known = known.withColumn("fill", F.col("cap") / F.col("weight")).withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    # if all sources that fill up before this one are full, the others' level; the true level is the highest of these
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(filled), F.lit(0))) / F.sum("weight").over(rest)
    known = known.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return known.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")).alias("target"))


def _after(h: str, g: str, low_h: str, low_g: str) -> Column:
    return (F.col(h) > F.col(low_h)) | ((F.col(h) == F.col(low_h)) & (F.col(g) > F.col(low_g)))


def _refined(places: DataFrame, open_: DataFrame, level: int) -> DataFrame:
    """open_, each source's boundary bucket cut into buckets of the next digit, and the one of these kept in which the budget is passed.

    A source all of whose candidates fit comes back with n = 0 and its bucket past the end of the line.
    """
    first = level < BITS // DIGIT
    shift = BITS - DIGIT * (level % (BITS // DIGIT) + 1)
    digit = F.shiftright((F.col("h") - F.col("h_from")) if first else (F.col("g") - F.col("g_from")), shift)
    inside = F.col("h").between(F.col("h_from"), F.col("h_to")) & F.col("g").between(F.col("g_from"), F.col("g_to"))
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("most")) & _after("h", "g", "low_h", "low_g")
    own = open_.withColumnRenamed("source", "__source")
    met = places.join(own, F.col("source").eqNullSafe(F.col("__source"))).where(inside & fits)
    sums = met.groupBy("source", digit.alias("digit")).agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    running = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("digit")))
    running = running.join(own.select("__source", "left"), F.col("source").eqNullSafe(F.col("__source")))
    passed = running.groupBy(F.col("source").alias("__at")).agg(
        F.min(F.when(F.col("upto") > F.col("left"), F.struct("digit", (F.col("upto") - F.col("words")).alias("before"), "n"))).alias("hit"),
        F.max("upto").alias("all"),
    )
    out = open_.join(passed, F.col("source").eqNullSafe(F.col("__at")), "left")
    hit, end = F.col("hit").isNotNull(), F.lit(1 << BITS)
    at = F.col("hit.digit") * F.lit(1 << shift)
    h_from, g_from = (F.col("h_from") + at, F.col("g_from")) if first else (F.col("h_from"), F.col("g_from") + at)
    h_to, g_to = (h_from + ((1 << shift) - 1), F.col("g_to")) if first else (F.col("h_to"), g_from + ((1 << shift) - 1))
    return out.select(
        "source", "slack", "low_h", "low_g", "most",
        (F.col("left") - F.when(hit, F.col("hit.before")).otherwise(F.coalesce("all", F.lit(0)))).alias("left"),
        F.when(hit, h_from).otherwise(end).alias("h_from"), F.when(hit, h_to).otherwise(end).alias("h_to"),
        F.when(hit, g_from).otherwise(F.lit(0)).alias("g_from"), F.when(hit, g_to).otherwise(F.lit(0)).alias("g_to"),
        F.coalesce(F.col("hit.n"), F.lit(0)).alias("n"),
    )


def thresholds(places: DataFrame, budgets: DataFrame, scratch: Scratch) -> DataFrame:
    """source, cuts: array of (low_h, low_g, h, g, most), without: (h, g) or null.

    A place is taken if it lies past a cut's low, before its (h, g), its size is at most `most`, and it isn't `without`.
    places: source, h, g, size; budgets: source, left and slack (numbers of words: the budget, and a rest that is small enough).
    Each job sends one row a source and bucket, and reads the staged places.
    """
    line = [F.lit(v).cast("long").alias(k) for k, v in (("h_from", 0), ("h_to", (1 << BITS) - 1), ("g_from", 0), ("g_to", (1 << BITS) - 1))]
    start = F.lit(-1).cast("long")
    open_ = budgets.select("source", "slack", start.alias("low_h"), start.alias("low_g"), F.col("left").alias("most"), "left", *line)
    rounds, rests = [], []
    for _ in range(ROUNDS):
        done = None
        for level in range(2 * BITS // DIGIT):
            open_ = scratch.stage(_refined(places, open_, level), "threshold")
            # one document in the boundary bucket: it is the boundary; none: all fitted
            ready, open_ = open_.where("n <= 1"), open_.where("n > 1")
            done = ready if done is None else done.unionByName(ready)
            if open_.isEmpty():
                break
        done = done.unionByName(open_)
        rounds.append(done.select("source", F.struct("low_h", "low_g", F.col("h_from").alias("h"), F.col("g_from").alias("g"), "most").alias("cut")))
        rests.append(done.select("source", "left", "slack"))
        open_ = done.where("n > 0 AND left > slack").select("source", "slack", F.col("h_to").alias("low_h"), F.col("g_to").alias("low_g"), F.col("left").alias("most"), "left", *line)
        if open_.isEmpty():
            break
    all_cuts = reduce(DataFrame.unionByName, rounds).groupBy("source").agg(F.collect_list("cut").alias("cuts"))
    rest = reduce(DataFrame.unionByName, rests).groupBy(F.col("source").alias("__rest")).agg(F.min("left").alias("left"), F.first("slack").alias("slack"))
    cuts = scratch.stage(all_cuts.join(rest, F.col("source").eqNullSafe(F.col("__rest"))).drop("__rest"), "threshold").withColumnRenamed("source", "__at")
    short = cuts.where("left > slack").select("__at", "cuts", "left")
    met = places.join(short, F.col("source").eqNullSafe(F.col("__at"))).where("size > 0")
    sizes = met.groupBy("__at", F.exists("cuts", _takes).alias("has"), "size").agg(F.min(F.struct("h", "g")).alias("at"), F.first("left").alias("left"))
    whole = F.struct("size", F.col("at.h").alias("h"), F.col("at.g").alias("g"))
    none = F.lit(None).cast("struct<size:bigint,h:bigint,g:bigint>")
    nothing = F.struct(F.lit(0).cast("long").alias("size"), F.lit(None).cast("long").alias("h"), F.lit(None).cast("long").alias("g"))
    asks = sizes.where("NOT has").select("__at", "left", (F.col("size") - F.col("left")).alias("wanted"), F.lit(1).alias("asks"), whole.alias("x"), none.alias("y"))
    given = sizes.where("has").select("__at", "left", F.col("size").alias("wanted"), F.lit(0).alias("asks"), none.alias("x"), whole.alias("y"))
    given = given.unionByName(short.select("__at", "left", F.lit(0).cast("long").alias("wanted"), F.lit(0).alias("asks"), none.alias("x"), nothing.alias("y")))
    # a window sees a source's different sizes; each size that is left looks for the taken one, or none, that makes up for it best
    by_size = Window.partitionBy("__at").orderBy("wanted", "asks")
    under = F.last("y", ignorenulls=True).over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    over = F.first("y", ignorenulls=True).over(by_size.rowsBetween(0, Window.unboundedFollowing))
    merged = asks.unionByName(given).withColumns({"under": under, "over": over}).where("asks = 1")
    steps = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("wanted") - F.col(c)["size"]).alias("off"), F.col("x"), F.col(c).alias("y"))) for c in ("under", "over")]))
    best = merged.withColumn("step", F.array_min(steps)).groupBy(F.col("__at").alias("__extra")).agg(F.min("step").alias("step"), F.first("left").alias("left")).where("step.off < left")
    x, y = F.col("step.x"), F.col("step.y")
    one = F.struct(x["h"].alias("low_h"), (x["g"] - 1).alias("low_g"), x["h"].alias("h"), (x["g"] + 1).alias("g"), x["size"].alias("most"))
    extra = best.select("__extra", one.alias("one"), F.when(y["size"] > 0, F.struct(y["h"].alias("h"), y["g"].alias("g"))).alias("without"))
    cuts = cuts.join(extra, F.col("__at").eqNullSafe(F.col("__extra")), "left")
    return cuts.select(F.col("__at").alias("source"), F.when(F.col("one").isNull(), F.col("cuts")).otherwise(F.concat("cuts", F.array("one"))).alias("cuts"), "without")


def _takes(cut: Column) -> Column:
    past = (F.col("h") > cut["low_h"]) | ((F.col("h") == cut["low_h"]) & (F.col("g") > cut["low_g"]))
    before = (F.col("h") < cut["h"]) | ((F.col("h") == cut["h"]) & (F.col("g") < cut["g"]))
    return past & before & (F.col("size") <= cut["most"])


def mix(docs: DataFrame, share: float = SHARE, most: int = MOST_COPIES, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words) of every document; most: the copies of a document and source at most."""
    scratch = Scratch(docs.sparkSession, "mixing")
    mask = F.lit((1 << BITS) - 1)
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").bitwiseAND(mask).alias("h"), F.xxhash64(F.monotonically_increasing_id(), F.lit("row")).bitwiseAND(mask).alias("g"))
    places = scratch.stage(sized, "places")
    sources = source_targets(places.groupBy("source").agg(F.sum("size").alias("source_size")), share, most, weights)
    full = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(most)).cast("int")
    left, slack = F.floor(F.col("target") - F.col("full") * F.col("source_size")), F.floor(F.col("target") / NEAR)
    sources = scratch.stage(sources.withColumn("full", full).withColumns({"left": left.cast("long"), "slack": slack.cast("long")}), "sources")
    cuts = scratch.stage(thresholds(places, sources.where(f"full < {most}").select("source", "left", "slack"), scratch), "cuts")
    scratch.drop("threshold")
    known = sources.join(cuts.withColumnRenamed("source", "__at"), F.col("source").eqNullSafe(F.col("__at")), "left").select(F.col("source").alias("__source"), "source_size", "target", "full", "cuts", "without")
    given_up = F.coalesce((F.col("h") == F.col("without.h")) & (F.col("g") == F.col("without.g")), F.lit(False))
    once_more = F.when((F.col("size") > 0) & ~given_up & F.coalesce(F.exists("cuts", _takes), F.lit(False)), 1).otherwise(0)
    met = places.join(known, F.col("source").eqNullSafe(F.col("__source")))
    met = met.withColumn("copies", F.least(F.col("full") + once_more, F.lit(most)))
    return met.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows of docs as often as `copies` (from mix, of a table with unique ids) says; documents of no copies go."""
    often = copies.where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("copies").alias("__copies"))
    return docs.join(often, F.col("doc_id") == F.col("__id")).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[f"`{c}`" for c in docs.columns])


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
