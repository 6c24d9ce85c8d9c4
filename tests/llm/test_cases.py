"""Packing against exhaustive search, pages that names must not empty, time in proportion to a page, repeated ids, clashing columns."""

import itertools
import random
import time

from pyspark.sql import functions as F

from tickloom.llm import language_id, main_text, near_dedup, packing, shared
from tickloom.llm.token_counts import count_tokens

LENGTHS = (8, 16, 32)


def cost(lengths):
    return sum(map(packing.sequence_cost, lengths))


def least_cost(sizes):
    """Of all ways to deal the sizes to bins, each bin of the least permitted length."""
    best = float("inf")
    for owners in itertools.product(range(len(sizes)), repeat=len(sizes)):
        bins: dict = {}
        for size, owner in zip(sizes, owners):
            bins[owner] = bins.get(owner, 0) + size
        if max(bins.values()) <= LENGTHS[-1]:
            best = min(best, cost(next(n for n in LENGTHS if n >= f) for f in bins.values()))
    return best


def test_best_fit_against_all_packings():
    rng = random.Random(4)
    ratios = []
    for _ in range(40):
        sizes = sorted((rng.randint(1, 32) for _ in range(5)), reverse=True)
        bins, offsets, lengths = packing.best_fit(sizes, LENGTHS)
        got, least = cost(lengths), least_cost(sizes)
        assert got >= least - 1e-9
        ratios.append(got / least)
    assert max(ratios) <= 1.5 and sum(ratios) / len(ratios) <= 1.06


def test_opening_takes_the_length_that_costs_least_per_token():
    left = packing._Left([8] * 3)
    assert packing.opening_length(24, LENGTHS, left) == 32  # 24 and 8 fill it
    assert packing.opening_length(9, LENGTHS, packing._Left([])) == 16
    assert packing._Left([5, 5, 3]).filled(11) == 10 and packing._Left([]).filled(11) == 0


PAGE = """<html><body><header><h1>Site</h1></header><article class="post"><header><h1>Headline</h1></header>
<p class="social">The social part of it, with commas, and so on for a while.</p><div class="share-price"><p>The share price rose, as it does, by some points on the day.</p></div>
<p>A long paragraph, with commas, and text that goes on and on and on, so that it counts.</p><ul><li>one point</li></ul><pre>x = 1</pre>
<div class="comments"><p>First! I like this article, really, very much, all of it.</p></div><div class="ad">Buy this now, it is cheap.</div></article><footer>end</footer></body></html>"""


def test_names_do_not_take_article_text():
    assert main_text.main_text(PAGE).split("\n") == [
        "Headline",
        "The social part of it, with commas, and so on for a while.",
        "The share price rose, as it does, by some points on the day.",
        "A long paragraph, with commas, and text that goes on and on and on, so that it counts.",
        "one point",
        "x = 1",
    ]
    wrapped = "<body class='has-sidebar'><div class='no-comments'><h1>T</h1><p>One paragraph, with commas, of some length.</p></div><div class='sidebar'><p>Side, side, side text that is long enough to count, too</p></div></body>"
    assert main_text.main_text(wrapped) == "T\nOne paragraph, with commas, of some length."


def test_time_grows_with_the_page():
    for piece in ("<a ", '<p title="x>y ', "<div>text, more text here for it", "<div>", "<ul><li>x, y", "<table><tr><td>x", "<", "<!--", "<svg>x"):
        took = []
        for size in (60_000, 480_000):
            began = time.thread_time()
            main_text.main_text(piece * (size // len(piece)))
            took.append(time.thread_time() - began)
        assert took[1] < 24 * took[0] + 0.5, piece  # eight times the page, far from 64 times the time


def test_one_row_per_id(spark):
    rows = [(1, "b", 1), (1, "a", 2), (1, None, 3), (2, "x", 1), (None, "n", 1), (None, "n", 1), (3, None, 2), (3, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    got = sorted(map(tuple, shared.one_row_per_id(docs).collect()), key=str)
    assert got == sorted([(1, "a", 2), (2, "x", 1), (3, None, 1), (None, "n", 1), (None, "n", 1)], key=str)
    assert shared.one_row_per_id(docs.limit(0)).count() == 0


def test_repeated_rows_of_two_near_copies(spark):
    body = [f"word{i}" for i in range(200)]
    texts = [(7, " ".join(body)), (9, " ".join([*body[:-1], "other"]))]
    docs = spark.createDataFrame([t for t in texts for _ in range(500)], "doc_id long, text string").repartition(4)
    got = near_dedup.near_duplicates(docs, 2).groupBy("doc_id", "component_id", "kept").agg(F.count("*").alias("n")).collect()
    assert sorted(map(tuple, got)) == [(7, 7, True, 500), (9, 7, False, 500)]


def test_columns_of_the_results_names_are_replaced(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "a b c", 99, "zz", 5.0)], "doc_id long, text string, n_tokens int, lang_pred string, score double")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert counted.columns.count("n_tokens") == 1 and counted.first().n_tokens == 3
    told = language_id.predict(docs, language_id.fit(docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))))
    assert told.columns.count("lang_pred") == 1 and told.first().lang_pred == "und"


def test_a_form_around_the_page_is_no_boilerplate():
    body = "<div><h2>Head</h2><p>A long paragraph, with commas, and text that goes on and on, so that it counts.</p></div>"
    login = "<form action=x>Login <input name=u><button>Go</button></form>"
    want = "Head\nA long paragraph, with commas, and text that goes on and on, so that it counts."
    assert main_text.main_text(f"<html><body><form id='aspnetForm'>{body}{login}</form></body></html>") == want
    assert main_text.main_text(f"<html><body><form id='aspnetForm'><article>{body}</article></form>{login}</body></html>") == want
    assert main_text.main_text(f"<html><body>{body}<form>Your mail, please: <input></form></body></html>") == want


def test_formulas_are_text():
    page = "<p>If <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation encoding='tex'>x=2</annotation></math> then the proof, as it is, ends here, in peace.</p>"
    assert main_text.main_text(page) == "If x=2 then the proof, as it is, ends here, in peace."


def test_articles_beside_each_other_stay():
    first, second = "First part, with commas, and so on. " * 5, "Second part, with commas, and so on. " * 4
    teaser = "<article><a href=x>Read this too, it is short, and a link</a></article>"
    page = f"<body><h1>Title</h1><div><article><p>{first}</p></article>{teaser}<article><p>{second}</p><div class=comments><article><p>Reader says, well, this, at length, and more.</p></article></div></article></div></body>"
    assert main_text.main_text(page) == f"{first.strip()}\n{second.strip()}"


def test_a_megabyte_of_tables_is_read_in_time():
    page = "<table><tr><td>" + "<table><tr><td>text, more text here, and so on, long enough</td></tr></table>" * 14000
    began = time.time()
    assert main_text.main_text(page).count("\n") == 13999
    assert time.time() - began < 10
