"""Seeds of items that share stems, repeated occurrences in one document, repeated items; against full alignment of all pairs."""

import random
import time

import numpy as np
import pytest

from tickloom.llm import decontamination as D
from tickloom.llm.words import shingles_of, words_of

SYLLABLES = "ka lo mi tu re sha bon del fir gan hes jol".split()
STEM = "which of the following is the"


def words(rng, n):
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(2, 4))) for _ in range(n)]


def found(spark, docs, items):
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id): (r.score, r.first_word, r.end_word) for r in got.collect()}


def test_a_stem_of_many_items_is_no_copy():
    rng = random.Random(1)
    items = [f"{STEM} {' '.join(words(rng, 6))}" for _ in range(500)]
    text = " ".join(f"{STEM} {' '.join(words(rng, 1))}" for _ in range(500))
    seeds, began = D.Seeds(list(range(500)), items), time.time()
    w = words_of([text])
    at, seed = seeds.find(shingles_of(w, D.SEED_WORDS)[0])
    assert D._matches(seeds, w.hashes, at, seed, D.LEAST_SCORE) == []
    assert time.time() - began < 1


def test_one_item_many_times_in_a_document():
    rng = random.Random(2)
    item, own = words(rng, 12), words(rng, 40)
    seeds = D.Seeds([7], [" ".join(item)])
    parts = [x for _ in range(3000) for x in (*item[:3], *own[:20])]
    text = " ".join([*parts, *item, *own, *item])
    began, w = time.time(), words_of([text])
    at, seed = seeds.find(shingles_of(w, D.SEED_WORDS)[0])
    assert D._matches(seeds, w.hashes, at, seed, D.LEAST_SCORE) == [(0, 1.0, len(parts), len(parts) + 12)]
    assert time.time() - began < 5


def test_items_with_a_shared_stem_are_found_in_copies(spark):
    rng = random.Random(3)
    items = [(i, f"{STEM} {' '.join(words(rng, 10))}") for i in range(60)]
    docs = [(i, " ".join([*words(rng, 50), text, *words(rng, 50)])) for i, text in items[:20]]
    docs += [(100 + i, " ".join([*words(rng, 50), STEM, *words(rng, 50)])) for i in range(20)]
    got = found(spark, docs, items)
    assert set(got) == {(i, i) for i in range(20)} and all(v == (1.0, 50, 66) for v in got.values())


def test_repeated_and_shared_items(spark):
    rng = random.Random(4)
    same = " ".join(words(rng, 15))
    shared = [" ".join(words(rng, 3)) for _ in range(2)]
    # twenty times one item; twenty items of which each run is in ten others
    items = [(i, same) for i in range(20)] + [(100 + i, f"{shared[i % 2]} {shared[i % 2]}") for i in range(20)] + [(None, same), (300, "two words"), (301, ""), (302, None)]
    got = found(spark, [(1, f"x y {same} z"), (2, f"{shared[0]} {shared[0]}"), (3, "two words"), (4, None), (5, "")], items)
    assert set(got) == {*((1, i) for i in range(20)), (1, None), *((2, 100 + i) for i in range(0, 20, 2)), (3, 300)}


def test_pairs_against_alignment_of_everything(spark):
    rng = random.Random(5)
    stems = [" ".join(words(rng, 5)) for _ in range(2)]
    items = [(i, " ".join([stems[i % 2], *words(rng, rng.randint(8, 24))])) for i in range(30)]
    docs = []
    for i in range(60):
        copy = items[rng.randrange(30)][1].split()
        for _ in range(rng.randint(0, 14)):
            k = rng.randrange(len(copy))
            copy[k : k + rng.randint(0, 1)] = words(rng, rng.randint(0, 1))
        docs.append((i, " ".join([*words(rng, 60), *copy, *words(rng, 30)])))
    got = found(spark, docs, items)
    item_words = [words_of([t]).hashes for _, t in items]
    runs = [set(shingles_of(words_of([t]), 3)[0].tolist()) for _, t in items]
    rare = [{r for r in own if sum(r in other for other in runs) <= D.RARE_ITEMS} for own in runs]
    at = [shingles_of(words_of([t]), 3)[0].tolist() for _, t in items]
    want = {}
    for doc_id, text in docs:
        w = words_of([text])
        grams = set(shingles_of(w, 3)[0].tolist())
        for (item_id, _), own, few in zip(items, item_words, rare):
            score, low, high = D.align(own, w.hashes)
            score /= 2 * len(own)
            places = [k for k in range(len(own)) if not any(r not in few for r in at[item_id][max(0, k - 2) : k + 1])]
            apart = own[places] if places else own
            if score >= D.LEAST_SCORE and grams & few and np.isin(w.hashes[low:high], apart).sum() >= D.LEAST_SCORE * len(apart):
                want[doc_id, item_id] = score
    assert {k: v[0] for k, v in got.items()} == pytest.approx(want) and len(want) > 30
    assert np.all([0 <= v[1] < v[2] for v in got.values()])
