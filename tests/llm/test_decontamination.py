import hashlib
import random
import re

import pytest

from candlewick.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(text, items):
    ws, hit, got = words(text), set(), set()
    for i, t in items:
        x = words(t)
        n = min(len(x), 13)
        if i is None or not n:
            continue
        wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
        for k in range(len(ws) - n + 1):
            if tuple(ws[k : k + n]) in wins:
                hit.update(range(k, k + n))
                got.add(str(i))
    return len(ws), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(ws)


@pytest.fixture(scope="module")
def case():
    rng = random.Random(2)
    make = lambda n: " ".join(rng.choices("Alpha beta, gamma-3 délta É; x1".split(), k=n))
    long = [" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n)) for n in (13, 14, 30, 60)]
    items = [(1, long[0]), (22, long[1]), (3, long[2]), (100, long[3]), (5, "one"), (6, "two short words"), (7, ""), (8, None), (None, "Alpha"), (22, long[3]), (9, "É x1"), (10, make(13))]
    docs = [None, "", "ONE!", "one", "two short  WORDS", "É x1 é x1", long[0].upper(), "pad " * 300 + long[1]]
    for _ in range(60):
        x = rng.choice(long).split()
        a = rng.randint(0, 8)
        docs.append(make(rng.randint(0, 40)) + " " + " ".join(x[a : a + rng.randint(3, 40)]) + rng.choice([" one", "\n", ""]) + make(rng.randint(0, 200)))
    return items, docs


def test_report_equals_brute_force(spark, case):
    items, docs = case
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as n")
    rows = [*enumerate(docs), (3, docs[3]), (None, "one"), (None, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as digest", "2 as n_words")
    got = sorted((tuple(r) for r in d.report(df, b).collect()), key=str)
    assert got == sorted(((i, *brute(t, items)) for i, t in rows), key=str)
    assert d.report(df.limit(0), b).count() == 0
    assert {(r.n_hit, r.n_items) for r in d.report(df, b.limit(0)).collect()} == {(0, 0)}


def test_tables_too_large_to_broadcast(spark, case, monkeypatch):
    items, docs = case
    monkeypatch.setattr(d._small, "__defaults__", (1_000_000, 10))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = d.report(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted(map(tuple, got)) == sorted((i, *brute(t, items)) for i, t in enumerate(docs))


def test_very_long_text(spark):
    rng = random.Random(9)
    long = [f"w{rng.randint(0, 50)}" for _ in range(60_000)]
    items = [(1, " ".join(long[31_000:31_020])), (2, " ".join(long[5:40])), (3, "w1")]
    df = spark.createDataFrame([(1, " ".join(long))], "doc_id long, text string")
    assert tuple(d.report(df, spark.createDataFrame(items, "item_id long, text string")).first()) == (1, *brute(" ".join(long), items))


def test_removal(spark, case):
    items, docs = case
    b = spark.createDataFrame(items, "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").selectExpr("*", "1 as digest", "2 as __digest", "3 as __HITS", "4 as `__ws`", "5 as `a.b`")
    left = d.decontaminate(df, b)
    assert left.columns == df.columns and {r.doc_id for r in left.collect()} == {i for i, t in enumerate(docs) if not brute(t, items)[4]}
    for r in d.decontaminate(df, b, "spans").collect():
        n, hit, *_ = brute(docs[r.doc_id], items)
        assert len(words(r.text)) == n - hit and (hit or r.text == docs[r.doc_id])
