"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import decontamination, language_id, main_text, near_dedup, nearest, packing, sharding, substring_dedup, token_counts, toxicity
from tickloom.llm.components import components
from tickloom.llm.words import shingles_of, words_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
SYLLABLES = "ka lo mi tu re sha bon del fir gan hes jol".split()


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def table(spark, texts, schema=DOCS):
    rows = [(i, t, None, "s", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, schema)


ODD = [(0, None), (1, ""), (2, "  \n\t "), (3, "one"), (3, "one"), (4, "one"), (None, "no id here at all"), (5, "longword" * 20000), (6, "a b \U0001f600 \u0000 x"), (7, "123 ... !!")]


def same(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_words_match_the_pattern():
    texts = ["", " ", "A b\tC\x0b\x0cd", "Ä  x", "x" * 9000, "a b"]
    w = words_of(texts)
    spans = [bytes(w.data[s:e]) for s, e in zip(w.starts, w.ends)]
    assert [len(same(t)) for t in texts] == np.diff(w.ptr).tolist()
    assert len(set(w.hashes.tolist())) == len({s.lower() for s in spans})
    grams, ptr = shingles_of(w, 2)
    assert np.diff(ptr).tolist() == [0, 0, 3, 1, 1, 1]


# 1 toxicity


def test_toxicity_finds_unseen_words_of_a_known_stem(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        body = words(rng, rng.randint(5, 60))
        if i % 2:
            body[rng.randrange(len(body))] = "grumpf" + rng.choice(SYLLABLES) + rng.choice(SYLLABLES)
        rows.append((i, " ".join(body)))
        labels.append((i, 1, i % 2))
    docs = table(spark, [*rows, (1000, "kalo Grumpfzzz! mi"), (1001, "kalo mi"), *[(2000 + (i or 0), t) for i, t in ODD]])
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, known)
    assert all(w > 0 for w in model.weights.values()) and np.all(np.diff(model.thresholds) > 0)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert sum(got[i].toxic == (i % 2 == 1) for i in range(400)) >= 396
    assert got[1000].toxic and not got[1001].toxic and not got[2001].toxic
    assert got[1000].expected_severity > got[1001].expected_severity
    empty = toxicity.score(docs, toxicity.fit(docs, known.limit(0)))
    assert empty.where("toxic").count() == 0 and empty.count() == docs.count()
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(3)
    features, grades = [], []
    for _ in range(600):
        bad = int(rng.integers(0, 8))
        features.append(Counter({2: bad, 4: int(rng.integers(1, 9))} if bad else {4: 3}))
        grades.append(0 if bad == 0 else 1 if bad < 3 else 2 if bad < 6 else 3)
    grades = np.array(grades)
    sample = toxicity.Sample.of(features, grades > 0)
    # a feature of most documents is left out, so mark the telling one in fewer
    model = toxicity.fit_ordinal(toxicity.Sample(sample.row, sample.feature, sample.value, sample.toxic), grades, 4)
    assert np.all(np.diff(model.thresholds) > 0)


# 2 language identification


def languages(rng, n=150):
    sets = {"aa": "ka lo mi tu", "bb": "shr bon del fri", "cc": "él ün ño rê"}
    out = []
    for i in range(n):
        lang = list(sets)[i % 3]
        out.append((i, " ".join("".join(rng.choices(sets[lang].split(), k=3)) for _ in range(rng.randint(2, 40))), lang, "s", 0))
    return out


def test_language_id_held_out(spark):
    rows = languages(random.Random(5), 300)
    docs = spark.createDataFrame([*rows, *[(1000 + (i or 0), t, None, "s", 0) for i, t in ODD]], DOCS)
    held = F.coalesce(language_id.held_out(), F.lit(False))
    model = language_id.fit(docs.where(~held))
    assert model.languages == ["aa", "bb", "cc"] and (model.table == 0).mean() > 0.9
    got = {r.doc_id: r for r in language_id.predict(docs, model).select("doc_id", "lang_pred", "score").collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows)
    assert got[1001].lang_pred == "und" and got[1001].score == 0 and got[1007].lang_pred == "und"
    assert all(0 <= r.score <= 1 for r in got.values())
    none = language_id.fit(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in language_id.predict(docs, none).collect()} == {"und"}
    clash = docs.withColumnsRenamed({"source": "lang_pred"})
    assert language_id.predict(clash, model).count() == docs.count()


# 3 main text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home</a></li></ul></nav>
<div class="sidebar"><p>A long sidebar text, with commas, many of them, and more words than an article may have, indeed.</p></div>
<div id=main><h1>Title &amp; more</h1><p>First para,\n with  a <b>bold</b> word, commas, and a <a href=x>link</a>.<p>Second &lt;para&gt;, unclosed, with text that is long enough.
<script>var x = "</p><p>not text</p>";</script><ul><li>item one</li><li>item two</li></ul><form>Name <input></form><p>Short.</p></div>
<div class="comments"><p>Reader says, well, something long, very long, that is no part of the article at all.</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert main_text.main_text(PAGE) == "Title & more\nFirst para, with a bold word, commas, and a link.\nSecond <para>, unclosed, with text that is long enough.\nitem one\nitem two\nShort."
    for empty in (None, "", "  ", "<html></html>", "<script>x</script>", "<!-- only -->"):
        assert main_text.main_text(empty) == ""
    assert main_text.main_text("just text &eacute;") == "just text é"
    assert main_text.main_text("<p>" * 5000 + "deep" + "<div>" * 20000) == "deep"
    long = "<article>" + "<p>" + "word, " * 100000 + "</p></article>"
    assert len(main_text.main_text(long)) == 599999 - 0


def test_main_text_frames(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = main_text.extract(pages).collect()
    assert [r.n_chars for r in got if r.page_id is None] == [0] and sum(r.n_chars == len(r.text) > 50 for r in got) == 2
    assert main_text.extract(pages.limit(0)).count() == 0


# 4 nearest neighbours


def brute(rows, q, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x[list(ids).index(q)], 9)
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
    return [int(ids[i]) for i in order]


def test_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(1500)]
    rows[100:400] = [(i, rows[7][1]) for i in range(100, 400)]
    odd = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [None] * 16), (5200, [float("inf")] * 16), (5250, [1.0])]
    df = spark.createDataFrame([*rows, *odd, rows[3]], "vec_id long, embedding array<float>")
    got: dict = {}
    for r in nearest.nearest(df, F.pmod("id", F.lit(50)) == 0, 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    clean = [(i, np.float32(v).tolist()) for i, v in rows]
    asked = [i for i, _ in rows if i % 50 == 0]
    assert sorted(got) == asked
    hits = sum(len(set(got[q]) & set(brute(clean, q, 5))) for q in asked)
    assert hits >= 0.9 * 5 * len(asked)
    assert got[150] == [7, 100, 101, 102, 103] and got[100] == [7, 101, 102, 103, 104]


def test_nearest_pairs_leave_a_block_once():
    x = np.array([[1.0, 0.0], [0.8, 0.6], [0.6, 0.8]], np.float16)
    vectors = pa.table({"id": [1, 2, 3], "vec": [r.tobytes() for r in x], "worst": pa.array([-2.0] * 3, pa.float32())})
    links = pa.table({"pivot": [1, 1, 1, 9, 9, 9], "node": [1, 2, 3] * 2, "fresh": [True] * 6})
    got = nearest._compare(links, vectors).to_pylist()
    assert sorted((r["u"], r["v"]) for r in got) == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]
    assert nearest._compare(links.slice(0, 1), vectors).num_rows == 0


def test_nearest_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id) for r in nearest.nearest(df, F.col("id") == 0, 5).orderBy("rank").collect()]
    assert got == [(1, 2), (2, 1)]
    assert nearest.nearest(df.limit(0), F.col("id") == 0, 5).count() == 0


# 5 substring dedup


def test_repeated_passages(spark):
    rng = random.Random(11)
    shared, edited = words(rng, 60), words(rng, 70)
    changed = [*edited[:35], "other", *edited[36:]]
    short = words(rng, 40)
    body = {i: words(rng, 120) for i in range(8)}
    texts = [
        (10, " ".join(body[0] + shared + body[1])),
        (20, " ".join(shared + body[2])),
        (30, " ".join(body[3][:7] + shared).upper()),
        (40, " ".join(body[4] + edited)),
        (50, " ".join(body[5] + changed + body[6])),
        (60, " ".join(short + body[6][60:])),
        (70, " ".join(short)),
        (80, " ".join(shared * 2)),
    ]
    docs = table(spark, [*texts, *ODD]).withColumn("first_word", F.lit(1))
    got = {}
    for r in substring_dedup.repeated_passages(docs).collect():
        got.setdefault(r.doc_id, []).append((r.first_word, r.end_word, r.of_doc))
    assert got[20] == [(0, 60, 10)] and got[30] == [(7, 67, 10)] and got[80][0] == (0, 120, 10)
    assert 50 in got and got[50][0][2] == 40 and 115 <= got[50][0][0] <= 125 and 185 <= got[50][0][1] <= 195
    assert {d for d in got if d is not None and d >= 10} == {20, 30, 50, 60, 80} - ({60} if 60 not in got else set())
    left = {r.doc_id: r.text for r in substring_dedup.without_passages(docs, substring_dedup.repeated_passages(docs)).collect()}
    assert left[20] == " ".join(body[2]) and left[10] == texts[0][1] and 80 not in left and left[5] == "longword" * 20000
    assert substring_dedup.repeated_passages(docs.limit(0)).count() == 0


def test_repeated_passages_behind_a_head_that_fails(spark):
    """A holds a part of the passage only, or first elsewhere; B and C hold the whole."""
    rng = random.Random(12)
    texts, expected = [], {}
    for i in range(0, 120, 4):
        whole = words(rng, 55)
        part = whole[:48] if i % 8 else whole[7:]
        texts.append((1000 * i, " ".join(words(rng, 40) + part + words(rng, 40) + (part + words(rng, 30)) * (i % 3))))
        texts.append((1000 * i + 1, " ".join(words(rng, 60) + whole + words(rng, 30))))
        texts.append((1000 * i + 2, " ".join(words(rng, 20) + whole + words(rng, 50))))
        expected[1000 * i + 2] = [(20, 75, 1000 * i + 1)]
    got = {}
    for r in substring_dedup.repeated_passages(table(spark, texts)).collect():
        got.setdefault(r.doc_id, []).append((r.first_word, r.end_word, r.of_doc))
    assert got.keys() <= expected.keys() and all(got[d] == expected[d] for d in got)
    # what is missed is the chance of fewer than ENOUGH hash functions with a window, as without the heads
    pairs = table(spark, [t for t in texts if t[0] % 1000])
    assert got.keys() == {r.doc_id for r in substring_dedup.repeated_passages(pairs).collect()} and len(got) >= 27


def test_compact_windows_cover_every_passage():
    rng = np.random.default_rng(4)
    grams = rng.integers(1, 1 << 60, 300, dtype=np.uint64)
    ptr = np.array([0, 100, 101, 300])
    from tickloom.llm.words import seeded

    place, left, right = substring_dedup.compact_windows(grams, ptr, 20, 3)
    x = seeded(grams, 3)
    for a, b in ((0, 100), (101, 300)):
        for low in range(a, b):
            for high in range(low + 20, b + 1, 7):
                c = low + int(x[low:high].argmin())
                k = place.tolist().index(c)
                assert left[k] <= low and high - 1 <= right[k]
                assert x[left[k] : right[k] + 1].min() == x[c]


# 6 decontamination


def smith_waterman(a, b):
    best, above = 0, [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(max(0, above[j] + (2 if x == y else -1), above[j + 1] - 1, row[j] - 1))
        above, best = row, max(best, *row)
    return best


def test_alignment_is_smith_waterman():
    rng = np.random.default_rng(8)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 25)), rng.integers(0, 5, rng.integers(1, 40))
        score, low, high = decontamination.align(a, b)
        assert score == smith_waterman(a.tolist(), b.tolist())
        assert smith_waterman(a.tolist(), b[low:high].tolist()) == score


def test_contaminated(spark):
    rng = random.Random(21)
    items = [(i, " ".join(words(rng, 30))) for i in range(6)]
    plain = [words(rng, 200) for _ in range(12)]
    cut = items[2][1].split()
    cut[10], cut[20] = "xx", "yy"
    del cut[25]
    texts = [(i, " ".join(p)) for i, p in enumerate(plain)]
    texts[1] = (1, " ".join(plain[1][:50] + items[0][1].upper().split() + plain[1][50:]))
    texts[2] = (2, " ".join(plain[2][:90] + cut + plain[2][90:]))
    texts += [(100 + k, items[1][1]) for k in range(20)]
    bench = spark.createDataFrame([*items, (50, None), (51, ""), (52, "zzz")], "item_id long, text string")
    docs = table(spark, [*texts, *[(1000 + (i or 0), t) for i, t in ODD]]).withColumn("score", F.lit("x"))
    got = {(r.doc_id, r.item_id): r for r in decontamination.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 0), (2, 2), *((100 + k, 1) for k in range(20))}
    assert got[1, 0].score == 1 and (got[1, 0].first_word, got[1, 0].end_word) == (50, 80) and 0.7 < got[2, 2].score < 1
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0
    assert decontamination.contaminated(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("beside", [[], [0], [0, 1]])
def test_contaminated_by_an_edited_copy_only(spark, beside):
    """Copies with 20 % of the words replaced, evenly, so that most three-word runs are broken; `beside`: exact copies elsewhere."""
    rng = random.Random(22)
    items = [(i, " ".join(words(rng, 30))) for i in range(4)]
    plain = [words(rng, 120) for _ in range(8)]

    def edited(text):
        w = text.split()
        for k in range(2, 30, 5):
            w[k] = f"new{k}"
        return w

    texts = [(i, " ".join(plain[i][:60] + edited(items[i][1]) + plain[i][60:])) for i in range(4)]
    texts += [(10 + k, " ".join(plain[4 + k] + items[0][1].split())) for k in beside]
    short = "ene mene miste es rappelt kiste".split()
    texts.append((20, " ".join(plain[6] + ["ene", "xx", *short[2:5], "yy"] + plain[7])))
    bench = spark.createDataFrame([*items, (9, " ".join(short))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(table(spark, texts), bench).collect()}
    assert set(got) == {*((i, i) for i in range(4)), *((10 + k, 0) for k in beside), (20, 9)}
    assert all(got[i, i] == 0.7 for i in range(4)) and all(got[10 + k, 0] == 1 for k in beside)


# 7 token counts


def test_token_counts(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    texts = [*(t for _, t in ODD), " ".join(words(rng, 300)), "a<|endoftext|>b <|endoftext|>", "it's  we'll\n\n\tx  ", "你好 12½² naïvé", "don't" * 50]
    tok = Tokenizer.from_file(TOKENIZER)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n", F.lit(1))
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, TOKENIZER).collect()}
    assert got == {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert token_counts.count_tokens(docs.limit(0), TOKENIZER).count() == 0


# 8 near duplicates


def shingle_set(text, n):
    w = same(text or "")
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute_groups(texts, n):
    ids = sorted({i for i, _ in texts if i is not None})
    sets = [(i, shingle_set(t, n)) for i, t in texts if i is not None]
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    rng = random.Random(n)
    texts = []
    for g in range(12):
        base = words(rng, rng.choice([1, 2, 8, 60, 150]))
        for k in range(rng.choice([1, 2, 30])):
            new = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                new[rng.randrange(len(new))] = rng.choice(SYLLABLES)
            base = new if g % 2 else base  # chains of copies of copies
            texts.append((100 + len(texts), " ".join(new)))
    rng.shuffle(texts)
    texts += ODD
    docs = table(spark, texts).withColumn("component_id", F.lit("x"))
    rows = near_dedup.near_duplicates(docs, n).collect()
    want = brute_groups(texts, n)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or want[r.doc_id] == r.doc_id)
    assert {r.n_shingles for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert near_dedup.near_duplicates(docs.limit(0), n).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        errors = []
        for _ in range(40):
            x = rng.integers(1, 1 << 62, 300, dtype=np.uint64)
            both = int(round(300 * share))
            y = np.concatenate((x[:both], rng.integers(1, 1 << 62, 300 - both, dtype=np.uint64)))
            sig = near_dedup.superminhash(np.concatenate((x, y)), np.array([0, 300, 600]))
            errors.append((sig[0] == sig[1]).mean() - both / (600 - both))
        assert abs(np.mean(errors)) < 0.02


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 50), (50, 75)] + [(1000, x) for x in range(900, 960)]
    got = dict(map(tuple, components(spark.createDataFrame(chain, "a long, b long")).collect()))
    assert {got[i] for i in range(41)} == {0} and got[100] == got[75] == 50 and got[1000] == 900 and len(got) == 41 + 3 + 61


# 9 packing


def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 5, 300, 511, 512, 513, 700, 4096, 4097, 9000])) for i in range(400)] + [(None, 10), (3, None), (500, 1), (500, 1)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long")).collect()
    assert sum(r.n_tokens for r in got) == sum(n or 0 for _, n in rows)
    bins: dict = {}
    for r in got:
        if r.n_tokens:
            bins.setdefault((r.bin_id, r.bin_length), []).append((r.bin_offset, r.bin_offset + r.n_tokens))
        else:
            assert r.bin_id is None
    assert len({b for b, _ in bins}) == len(bins)
    for (_, length), spans in bins.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and spans[-1][1] <= length
        assert length == next(n for n in packing.LENGTHS if n >= spans[-1][1])
    used, held = sum(n or 0 for _, n in rows), sum(length for _, length in bins)
    assert used / held > 0.93
    assert packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


# 10 sharding


def test_sharding_moves_rows_into_the_new_shard_only(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id")).union(spark.sql("SELECT CAST(null AS long)")).union(spark.sql("SELECT 5L"))
    tree = sharding.regular_tree(40)
    placed = sharding.assign(sharding.assign(docs, "doc_id", tree, "a"), "doc_id", sharding.regular_tree(41), "b")
    assert placed.where("a <> b AND b <> 40").count() == 0 and 40 < placed.where("b = 40").count() < 180
    counts = [r["count"] for r in placed.groupBy("a").count().collect()]
    assert len(counts) == 40 and max(counts) < 160
    slots = sharding.with_slots(placed, "a", ["doc_id"], 4002 * 40).groupBy("a").agg(F.collect_list("slot").alias("s")).collect()
    assert all(sorted(r.s) == list(range(len(r.s))) for r in slots)


def test_weights_move_only_their_subtrees(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"))
    tree = sharding.regular_tree(40)
    heavier = [sharding.Shard(s.region, s.rack, s.shard, 2.0 if s.shard == 7 else 1.0) for s in tree]
    moved = sharding.assign(sharding.assign(docs, "doc_id", tree, "a"), "doc_id", heavier, "b").where("a <> b").collect()
    assert moved and all(r.b // 10 == 0 for r in moved)


# the pipeline


def test_pipeline_against_planted_cases(spark, tmp_path):
    rng = random.Random(9)
    plain = [(i, " ".join(words(rng, 90))) for i in range(40)]
    shared, item = words(rng, 65), words(rng, 40)
    texts = dict(plain)
    texts[50] = texts[3]  # exact copy
    texts[51] = texts[4].rsplit(" ", 1)[0]  # near copy
    texts[5] += " " + " ".join(shared)
    texts[6] = " ".join(shared) + " " + texts[6]
    texts[7] += " " + " ".join(item)
    texts[52], texts[53], texts[54] = None, "", "12 34"
    rows = [(i, t, "xx", "s", len(t or "")) for i, t in texts.items()] + [(8, texts[8], "xx", "s", 1)]
    spark.createDataFrame(rows, DOCS).withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(docs)
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in seen]
    assert ids[0] == sorted([*range(40), 8, 50, 51]) and ids[1] == list(range(40)) and ids[2] == list(range(40))
    assert {r.doc_id: r.text for r in seen[2].collect()}[6] == dict(plain)[6]
    assert ids[3] == [i for i in range(40) if i != 7] and set(ids[4]) == set(ids[3])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[-1].count()
