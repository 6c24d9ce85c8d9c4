"""Rows chosen by marks before a join, and what stays out of the driver."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tickloom.llm import shared, substring_dedup, token_counts


@pytest.mark.parametrize("bits", [1 << 15, 1 << 24])
def test_rows_by_marks(spark, monkeypatch, bits):
    monkeypatch.setattr(shared, "MARK_BITS", bits)
    rows = spark.range(20_000).select((F.col("id") * 7919 - 50_000).alias("doc_id"), F.lit("t").alias("text")).union(spark.sql("SELECT cast(null AS long), 'null'"))
    ids = rows.where("pmod(doc_id, 11) = 3").select("doc_id").union(spark.sql("SELECT cast(null AS long)"))
    every, some = {r.doc_id for r in rows.collect()}, {r.doc_id for r in ids.collect() if r.doc_id is not None}
    kept, left = ([r.doc_id for r in f(rows, ids).collect()] for f in (shared.with_id_in, shared.without_id_in))
    assert (len(kept), set(kept)) == (len(some), some)
    assert (len(left), set(left)) == (len(every) - len(some), every - some)
    marked = shared.perhaps_in(rows, ids)
    assert marked.columns == ["doc_id", "text", "__perhaps"]
    if bits == 1 << 24:  # few others are marked
        assert marked.where("__perhaps").count() < len(some) + 50


def _shuffled_rows(df) -> int:
    """Rows that the plan's exchanges of texts wrote."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    total, stack = 0, [plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            stack.append(node.plan())
        if name == "ShuffleExchangeExec" and "text" in [a.name() for a in _listed(node.output())]:
            total += node.metrics().apply("shuffleRecordsWritten").value()
        stack += _listed(node.children())
    return total


def _listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def test_texts_without_a_passage_are_not_shuffled(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c d"), F.col("id").cast("string")).alias("text"))
        passages = spark.range(20).select((F.col("id") * 100).alias("doc_id"), F.lit(1).alias("first_word"), F.lit(3).alias("end_word"))
        out = substring_dedup.without_passages(docs, passages)
        found = {r.doc_id: r.text for r in out.collect()}
        assert len(found) == 3000 and found[100].split() == ["a", "d", "100"] and found[101] == "a b c d 101"
        assert 20 <= _shuffled_rows(out) < 100
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_tokenizer_is_not_loaded_by_the_driver(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_counts, "Tokenizer", None)  # tasks import their own
    docs = spark.createDataFrame([(1, "two words"), (2, None)], "doc_id long, text string")
    rows = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r.doc_id: r.n_tokens > 0 for r in rows} == {1: True, 2: False}
