"""Ranked search, mixing and conversation repair: against brute force and SQL, on nulls, ties, repeated rows, empty tables, hot groups."""

import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import conversations, lexical, mixing, oracles, registry, shared

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sql_rows(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(f"{name}_rows", pa.Table.from_pylist([r.asDict() for r in frame.collect()], schema=pa.schema([(f.name, pa.string() if f.dataType.simpleString() == "string" else pa.int64()) for f in frame.schema])))
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_rows")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted((dict(zip(names, r)) for r in cur.fetchall()), key=str)


def spark_rows(df, names=None):
    return sorted((r.asDict() for r in df.select(*(names or df.columns)).collect()), key=str)


# 11 ranked search


def test_treap_finds_the_best_columns():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n_rows, n_columns = int(rng.integers(1, 40)), int(rng.integers(1, 300))
        grid = np.where(rng.random((n_rows, n_columns)) < 0.1, rng.integers(1, 6, (n_rows, n_columns)), 0)
        row, column = np.nonzero(grid)
        if not len(row):
            continue
        treap = lexical.Treap(row, column, grid[row, column])
        asked = np.unique(rng.integers(0, n_rows, 5))
        for k, floor in ((1, 0), (7, 0), (7, 5), (400, 0)):
            sums = grid[asked].sum(0)
            want = sorted((-s, c) for c, s in enumerate(sums.tolist()) if s >= max(1, floor))[:k]
            columns, got = treap.best(asked, k, floor)
            assert [(-s, c) for c, s in zip(columns.tolist(), got.tolist())] == want


def corpus(spark, rng, n=400):
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, weights=[1 / (i + 1) for i in range(60)], k=rng.randint(0, 30))) for _ in range(n)]
    rows = [(i, t, None, "s", 0) for i, t in enumerate(texts)]
    rows += [(n, None, None, "s", 0), (n + 1, "", None, "s", 0), (n + 2, "-- .. \u0000", None, "s", 0), (n + 3, "W1 w1,W2-w3_é É " * 4000, None, "s", 0), (7, texts[7], None, "s", 0), (None, texts[9], None, "s", 0)]
    rows += [(n + 10 + i, "w40 w41 W42 w41 w40 w42", None, "s", 0) for i in range(150)]
    return spark.createDataFrame(rows, DOCS)


def test_lexical_equals_sql(spark):
    docs = corpus(spark, random.Random(4)).where("doc_id IS NOT NULL")
    items = spark.createDataFrame([(1, "w1 w40, w41"), (2, "W2 w2 w2 nothing"), (3, None), (4, ""), (5, "éé É w59"), (6, "W1"), (7, "w40 W41 w42")], "item_id long, text string")
    want = sql_rows(oracles.LEXICAL, documents=docs, benchmark=items)
    got = spark_rows(lexical.ranked(docs, items))
    assert got == want and len(got) > 100
    first = [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["item_id"] == 7]
    assert first == [*range(410, 460)]  # ties by doc_id


def test_lexical_cases(spark):
    docs = corpus(spark, random.Random(5))
    items = spark.createDataFrame([(1, "w1", 3), (1, "a word that sorts first w5", 3), (None, "w3", 4)], "item_id long, text string, rank int")
    got = lexical.ranked(docs.withColumnRenamed("lang", "score"), items, 5).collect()
    assert Counter(r.item_id for r in got) == {1: 5, None: 5}
    first = lexical.ranked(docs, items.where("text LIKE 'a word%'"), 5).collect()
    assert sorted(r.score for r in got if r.item_id == 1) == sorted(r.score for r in first)
    last = lexical.ranked(docs.where("doc_id IS NULL OR doc_id = 7").limit(9), items.where("item_id IS NULL"), 5).collect()
    assert all(r.rank >= 1 for r in last)
    assert lexical.ranked(docs.limit(0), items).count() == 0 and lexical.ranked(docs, items.limit(0)).count() == 0
    batches = [pa.RecordBatch.from_pydict({"doc_id": [1, 2], "rows": [[1, 2], [3]]})] * 5
    assert [len(b) for b in lexical._blocks(iter(batches))] == [10]


def test_lexical_in_many_blocks(spark, monkeypatch):
    docs = corpus(spark, random.Random(6)).where("doc_id IS NOT NULL").repartition(7, "doc_id")
    items = spark.createDataFrame([(i, f"w{i} w{i + 3} w{i * 2}") for i in range(20)], "item_id long, text string")
    whole = spark_rows(lexical.ranked(docs, items))
    monkeypatch.setattr(lexical, "ITEM_WORDS", 10)
    assert spark_rows(lexical.ranked(docs, items)) == whole == sql_rows(oracles.LEXICAL, documents=docs, benchmark=items)


# 12 mixing


def reshared(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    """Targets by sharing, cutting and resharing the excess, again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while left > 1e-9 and free:
        whole = sum(weight[s] for s in free)
        given = {s: left * weight[s] / whole for s in free}
        left = 0.0
        for s in list(free):
            target[s] += given[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def off_by(documents):
    """Of the smallest document that is left, one is taken or not: half the largest at most, and far less where another makes up for it."""
    sizes = [r.size for r in documents if r.size]
    return 1 if len(sizes) > 20 and max(sizes) < 50 else max(sizes, default=2) / 2


def mixture(rng):
    rows = [(i, " ".join("x" * (1 + i % 3) for _ in range(rng.randint(0, 40))), None, f"s{i % 7}", 0) for i in range(700)]
    rows += [(1000 + i, "y " * rng.randint(200, 3000), None, f"s{i % 3}", 0) for i in range(9)]
    rows += [(None, "same text of five words", None, "hot", 0)] * 400 + [(2000 + i, "lone é word here", None, None, 0) for i in range(30)]
    return [*rows, (1, "again", None, "s1", 0), (3000, None, None, "s2", 0), (3001, " \t\n", None, "none", 0)]


def test_mixing_near_targets(spark):
    rows = mixture(random.Random(8))
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    out = mixing.mix(docs.withColumn("taken", F.lit(1)))
    got = out.collect()
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = reshared(sizes)
    assert len(got) == len(rows) and Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows)
    taken, most, documents = Counter(), {}, defaultdict(list)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9) and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        documents[r.source].append(r)
    for source, target in want.items():
        assert abs(taken[source] - target) <= off_by(documents[source])
    assert taken["hot"] > 0 and taken["none"] == 0
    again = mixing.mix(docs.repartition(3, "n_chars")).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)


def test_mixing_follows_the_line(spark):
    """The thresholds against a walk along the sorted line."""
    rng = random.Random(9)
    places = [(("a", "b")[i % 2], rng.randrange(1 << 60) if i % 5 else 12345, rng.randrange(1 << 60), rng.choice([1, 2, 3, 50, 700])) for i in range(500)]
    df = spark.createDataFrame(places, "source string, h long, g long, size long")
    budgets = {"a": 9001, "b": 333}
    scratch = shared.Scratch(spark, "test")
    cuts = {r.source: r for r in mixing.thresholds(df, spark.createDataFrame([(s, n, 0) for s, n in budgets.items()], "source string, left long, slack long"), scratch).collect()}
    for source, budget in budgets.items():
        line, taken, left, low = sorted((h, g, n) for s, h, g, n in places if s == source), set(), budget, (-1, -1)
        for _ in range(mixing.ROUNDS):
            most, stop = left, None
            for h, g, n in line:
                if (h, g) > low and n <= most:
                    if n > left:
                        stop = (h, g)
                        break
                    taken.add((h, g, n))
                    left -= n
            if stop is None or not left:
                break
            low = stop
        rest = [x for x in line if x not in taken]
        off = min([left, *(abs(left - x[2] + y) for x in rest for y in (0, *{t[2] for t in taken}))])
        r = cuts[source]
        got = {x for x in line if any((c.low_h, c.low_g) < x[:2] < (c.h, c.g) and x[2] <= c.most for c in r.cuts) and (r.without is None or x[:2] != tuple(r.without))}
        assert len(got ^ taken) <= 2 and abs(sum(x[2] for x in got) - budget) == off <= 3


def test_mixing_cases(spark):
    docs = spark.createDataFrame(mixture(random.Random(8)), DOCS)
    assert mixing.mix(docs.limit(0)).count() == 0
    nothing = mixing.mix(docs.where("doc_id IN (3000, 3001)")).collect()
    assert all(r.target == 0 and r.taken == 0 for r in nothing) and len(nothing) == 2
    own = docs.where("doc_id BETWEEN 100 AND 600")
    copies = mixing.mix(own)
    assert mixing.mixed(own, copies).count() == copies.agg(F.sum("copies")).first()[0]
    assert "Python" not in (plan := copies._jdf.queryExecution().executedPlan().toString()) and "Arrow" not in plan


def test_op12_query(spark):
    out = registry.queries()["op12_mixing"](spark, SF)
    rows = out.collect()
    assert out.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"] and len(rows) == 200
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    want = reshared({s: sum(r.size for r in x) for s, x in by.items()})
    for s, x in by.items():
        assert x[0].target == pytest.approx(want[s]) and abs(sum(r.taken for r in x) - want[s]) <= off_by(x)


# 13 conversation repair

LEGAL = re.compile(r"(s?(ua)+)?")


def cheapest(symbols):
    """All edits of a few turns, up to two insertions between two of them."""
    puts = [(0, "", "")] + [(5 * len(x), "I" * len(x), "".join(x)) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    choices = [puts]
    for s in symbols:
        more, kind = 5 * s.isupper(), s.lower()
        own = [(2, "D", "")]
        if kind != "x":
            own += [(more, "K", kind), (1 + more, "R", "u"), (1 + more, "R", "a")]
        choices += [own, puts]
    best = None
    for picked in itertools.product(*choices):
        if LEGAL.fullmatch("".join(p[2] for p in picked)):
            found = (sum(p[0] for p in picked), "".join(p[1] for p in picked))
            best = found if best is None else min(best, found)
    return best


@pytest.mark.parametrize("symbols", ["", "u", "a", "s", "x", "ua", "uu", "ss", "so", "Ua", "UA", "sua", "xua", "uxa", "uau", "aua", "osu", "UuA", "ssa", "aaa", "SUA"])
def test_repair_against_all_edits(symbols):
    assert conversations.repair(symbols) == cheapest(symbols)


def test_repair_is_legal_and_never_dearer_than_a_plain_path():
    rng = random.Random(10)
    for _ in range(300):
        symbols = "".join(rng.choices("suaoxUA", k=rng.randint(0, 40)))
        cost, audit = conversations.repair(symbols)
        roles = iter([(s.lower(), "") for s in symbols])
        out = list(conversations.replay(audit, roles, conversations._odd(audit)))
        assert LEGAL.fullmatch("".join(r[0] for _, r, _ in out)) and next(roles, None) is None
        assert cost <= 2 * len(symbols)


def talk(rng, n=60):
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 14)):
            role = "system" if t == 0 and rng.random() < 0.3 else rng.choice(["user", "assistant", "user", "tool", ""] if rng.random() < 0.2 else [("user", "assistant")[t % 2]])
            rows.append((c, t if rng.random() < 0.95 else None, role, rng.choice(["Hello there.", "What?", "Unfinished", " ", "", "é!", "line\nline. "]) + str(rng.randint(0, 3)) * (rng.random() < 0.5)))
    rows += [(500, None, None, None), (501, 3, "user", None), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (502, 5, "user", "same."), (502, 5, "user", "same."), (502, 5, "assistant", "tie."), (503, 1, "user", "w. " * 100000)]
    return rows


TURNS = "conv_id long, turn long, role string, text string"


def test_conversations_equal_sql(spark):
    table = spark.createDataFrame(talk(random.Random(11)), TURNS)
    got = spark_rows(conversations.structure(conversations.damaged(table.withColumn("copies", F.lit(7)))))
    want = sql_rows(oracles.CONVERSATIONS, conversations=table)
    assert got == want and len({r["audit"] for r in got}) > 20


def test_long_conversations_are_the_same_in_runs(spark):
    rng = random.Random(12)
    rows = talk(rng, 12) + [(900, t // 2, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "c!", f"t{t}."])) for t in range(700)] + [(901, 1, "user", "same.")] * 90
    turns = conversations.damaged(spark.createDataFrame(rows, TURNS))
    whole = spark_rows(conversations.structure(turns))
    assert spark_rows(conversations.structure(turns, long_rows=3, run_bits=3)) == whole
    assert spark_rows(conversations.structure(turns, long_bytes=1000, run_bits=10)) == whole
    lines = spark_rows(conversations.repaired_turns(turns))
    assert spark_rows(conversations.repaired_turns(turns, long_rows=3, run_bits=2)) == lines and lines
    roles = pd.DataFrame(lines).sort_values("position").groupby("conv_id").role.agg(lambda x: "".join(r[0] for r in x))
    assert all(LEGAL.fullmatch(r) for r in roles)


def test_conversations_cases(spark):
    empty = spark.createDataFrame([], TURNS)
    assert conversations.structure(conversations.damaged(empty)).count() == 0
    gone = spark.createDataFrame([(1, 1, "user", "x.", 0), (2, 1, "user", "x.", 1)], f"{TURNS}, copies int")
    for long_rows in (0, 100):
        got = {r.conv_id: r for r in conversations.structure(gone, long_rows=long_rows).collect()}
        assert got[1].audit == "" and got[1].cost == 0 and got[1].repaired_sha256.startswith("e3b0c44298fc1c14") and got[2].audit == "D"
