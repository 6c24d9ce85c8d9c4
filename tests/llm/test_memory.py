"""What Python workers, which Spark keeps for other tasks, hold after a task."""

from __future__ import annotations

import subprocess
import sys

import pytest
from pyspark.sql import SparkSession

from tickloom.llm.language_id import fit
from tickloom.llm.substring_dedup import _by_context, without_passages

_TASK = """
import re
import numpy as np, pyarrow as pa
from tickloom.llm.shared import slices

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

batch = pa.record_batch([pa.array(["some text"])], names=["text"])
parts = slices(iter([batch]), "text")
next(parts)
before = held()
arrays = [np.ones(7_000) for _ in range(1_500)]  # 84 MB
last = np.ones(7_000)  # above them, so that they are a hole when they go
most = held()
del arrays
assert next(parts, None) is None
print(before, most, held())
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="memory is read from /proc")
def test_a_task_gives_back_what_it_needs_no_more():
    before, most, after = map(float, subprocess.run([sys.executable, "-c", _TASK], capture_output=True, text=True, check=True).stdout.split())
    assert most > before + 70
    assert after < before + 20


def test_shares_of_languages_need_no_python_workers_of_their_own(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"{'der die das und' if i % 2 else 'the and of to'} {i}", "de" if i % 2 else "en") for i in range(80)], "doc_id long, text string, lang string")

    def by_rows(*_, **__):
        raise AssertionError("a list of rows goes through Python workers")

    monkeypatch.setattr(SparkSession, "_createFromLocal", by_rows)
    model = fit(docs)
    assert model.languages == ["de", "en"] and model.predict(["der die das", "the and of"])[0] == ["de", "en"]


def _python_in_a_stage(plan) -> int:
    """The most operators of one stage that send rows to Python: so many workers a task needs at once."""
    most = 0

    def walk(node) -> int:
        nonlocal most
        below = node.children()
        n = sum(walk(below.apply(i)) for i in range(below.size())) + any(k in node.nodeName() for k in ("Python", "Arrow", "Pandas"))
        most = max(most, n)
        return 0 if "Exchange" in node.nodeName() else n

    walk(plan)
    return most


@pytest.fixture
def fixed_plans(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_passages_are_cut_once_by_one_worker_a_task(spark, fixed_plans):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c e"), (3, "a b"), (4, None), (None, "a b")], "doc_id long, text string")
    passages = spark.createDataFrame([(2, 0, 3), (3, 0, 2)], "doc_id long, first_word int, end_word int")
    left = without_passages(docs, passages)
    assert _python_in_a_stage(left._jdf.queryExecution().executedPlan()) == 1
    assert sorted(map(tuple, left.collect()), key=str) == sorted([(1, "a b c d"), (2, "e"), (4, None), (None, "a b")], key=str)


def test_contexts_need_one_worker_a_task(spark, fixed_plans, tmp_path):
    # tables read from files, as they are small enough to be broadcast
    spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(90))) for i in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    spark.createDataFrame([(7, i, 50, 40, 30, 0, i == 0) for i in range(4)], "g long, doc_id long, at int, back int, ahead int, j int, first boolean").write.parquet(f"{tmp_path}/left")
    docs, left = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("docs", "left"))
    finer = _by_context(left, docs, 46)
    assert _python_in_a_stage(finer._jdf.queryExecution().executedPlan()) == 1
    # the first document's window by both contexts, the others' also in their group without it; equal texts have equal contexts
    groups = {}
    for r in finer.collect():
        groups.setdefault(r["g"], []).append(r["doc_id"])
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2, 3], [0, 1, 2, 3], [1, 2, 3]]
