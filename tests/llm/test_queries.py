"""The registered queries themselves, on the smallest tables: their rows, keys and digest columns."""

import os
import zlib

import pyarrow.parquet as pq
import pytest

from tests.compare import compare, connect
from tickloom.llm import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def run(spark, name):
    return registry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def documents():
    return {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


@pytest.mark.parametrize("name", ["op11_lexical", "op13_conversations"])
def test_equal_to_sql(spark, name):
    said = compare(spark, connect(SF), name, registry.queries()[name], registry.oracle_sql()[name], SF)
    assert said is None, said


def test_op2_holds_out_by_checksum(spark, documents):
    rows = run(spark, "op2_language_id")
    assert {r.doc_id for r in rows} == set(documents)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    known = {r["lang"] for r in documents.values() if r["lang"]}
    assert {r.lang_pred for r in rows} <= known | {"und"}


def test_op3_counts_code_points(spark):
    rows, pages = run(spark, "op3_main_text"), pq.read_table(f"{SF}/pages.parquet").to_pylist()
    assert sorted((r.page_id, r.url) for r in rows) == sorted((p["page_id"], p["url"]) for p in pages)
    assert all(r.n_chars == len(r.text) for r in rows) and sum(r.n_chars > 0 for r in rows) > len(rows) / 2


def test_op4_asks_for_every_fiftieth(spark):
    rows = run(spark, "op4_nearest")
    ids = set(pq.read_table(f"{SF}/embeddings.parquet").column("vec_id").to_pylist())
    assert {r.query_id for r in rows} == {i for i in ids if i % 50 == 0}
    for q in {r.query_id for r in rows}:
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and own == sorted(own, key=lambda r: (-r.score, r.vec_id)) and all(r.vec_id != q for r in own)


def test_op7_counts_as_the_library_does(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in run(spark, "op7_token_counts"):
        text = documents[r.doc_id]["text"] or ""
        n = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512)


def test_op10_sizes_checksums_and_slots(spark, documents):
    rows = run(spark, "op10_sharding")
    for r in rows:
        text = documents[r.doc_id]["text"]
        assert (r.size, r.text_crc32, r.law) == (len((text or "").encode()) + 16, None if text is None else zlib.crc32(text.encode()), "key")
        assert 0 <= r.shard < 40 and (r.grown_shard == r.shard or r.grown_shard == 40)
    for s in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
