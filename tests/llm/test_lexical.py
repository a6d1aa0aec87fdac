"""Ranked search against a plain scan of all documents, and MaxScore's own bounds."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from candlewick.llm import entries, lexical

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def expected(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        found = []
        for doc_id, bag in bags:
            if bag:
                m = 50 + (50 * sum(bag.values()) * n_docs) // length
                score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 20 * m)) for t in own if bag[t])
                if score > 0:
                    found.append((-score, doc_id is None, doc_id or 0))
        out += [(item, rank, None if none else doc_id, -score) for rank, (score, none, doc_id) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, k=3, **bounds):
    a = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in docs], "doc_id long, text string, item_id string, score int, rank int").repartition(6)
    b = spark.createDataFrame([(i, t, 9) for i, t in items], "item_id long, text string, doc_id int").repartition(3)
    df = lexical.search(a, b, k, **bounds)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def corpus(seed, n, words=40):
    rng = np.random.default_rng(seed)
    vocabulary = [*(f"w{i}" for i in range(words)), "Été", "ÉTÉ", "A1", "日本", "ß"]
    p = 1 / np.arange(1, len(vocabulary) + 1)
    draw = lambda size: " ,_".join(rng.choice(vocabulary, size, p=p / p.sum()))
    docs = [(int(i), draw(int(rng.integers(0, 40)))) for i in rng.permutation(n)]
    docs += docs[:9] + [(None, docs[3][1]), (None, None), (n + 1, ""), (n + 2, "- _ -"), (n + 3, "w0 " * 60_000), (n + 4, "é" * 70_000)]
    items = [(i, draw(6)) for i in range(12)] + [(3, "w1 zz"), (None, "w5 A1"), (40, None), (41, ""), (42, "nowhere"), (43, "é" * 70_000)]
    return docs, items


@pytest.mark.parametrize(("seed", "bounds"), [(1, {}), (2, {"most_docs": 16, "most_postings": 100}), (3, {"most_docs": 40, "block_bytes": 60_000})])
def test_brute_force(spark, seed, bounds):
    docs, items = corpus(seed, 300)
    for k in (3, 50):
        assert run(spark, docs, items, k, **bounds) == expected(docs, items, k)


def test_ties_and_copies(spark):
    docs = [(i, "same words here" if i % 3 else "other things") for i in range(400, 0, -1)] + [(5, "same words here")] * 4
    items = [(1, "same words"), (2, "things other")]
    assert run(spark, docs, items, 50, most_docs=16) == expected(docs, items, 50)


def test_empty(spark):
    assert run(spark, [], [(1, "a")]) == [] == run(spark, [(1, "a")], []) == run(spark, [(1, None)], [(1, "a")])


def test_words_everywhere_count_for_what_the_formula_says(spark):
    docs = [(i, "the the cat" if i % 2 else "the dog") for i in range(1500)]
    assert run(spark, docs, [(1, "the"), (2, "the cat")], 5) == expected(docs, [(1, "the"), (2, "the cat")], 5)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), min_size=30, max_size=30), min_size=1, max_size=6), st.integers(1, 5), st.integers(0, 40))
def test_max_score(shares, k, least):
    """Of every document that reaches both the k-th score elsewhere and that of the shard, the whole score comes back."""
    lists = []
    for s in np.array(shares, np.int64):
        docs = np.flatnonzero(s)
        if len(docs):
            lists.append((docs, s[docs], int(s.max())))
    scores = np.zeros(30, np.int64)
    docs, score = lexical.max_score(lists, least, k, scores)
    whole = np.array(shares, np.int64).sum(0)
    bound = max(least, int(np.sort(whole)[-k]), 1)
    assert not scores.any() and (whole[docs] == score).all() and set(np.flatnonzero(whole >= bound)) <= set(docs.tolist())


def test_non_essential_lists_are_probed_alone():
    """A frequent word of small weight is never added up over its list once the rare word has filled the best k."""
    touched = []

    class Spy(np.ndarray):
        def __setitem__(self, key, value):
            touched.append(len(key))
            super().__setitem__(key, value)

    rare = (np.arange(5), np.full(5, 1000, np.int64), 1000)
    common = (np.arange(10_000), np.ones(10_000, np.int64), 1)
    docs, score = lexical.max_score([common, rare], 0, 3, np.zeros(10_000, np.int64).view(Spy))
    assert docs.tolist() == [0, 1, 2, 3, 4] and score.tolist() == [1001] * 5 and set(touched) == {5}


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = {t: [tuple(r) for r in spark.read.parquet(f"{d}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id"))}
    assert sorted((tuple(r) for r in entries.op11_lexical_search(spark, d).collect()), key=str) == expected(rows["documents"], rows["benchmark"], 50)
