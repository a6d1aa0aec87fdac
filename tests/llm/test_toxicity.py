import math
import zlib

import numpy as np
import pytest
import xxhash

from candlewick.llm import toxicity as x


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    plain = [f"word{i}" for i in range(3000)]
    docs, labels = [], []
    for i in range(1200):
        ws = list(rng.choice(plain, rng.integers(5, 300)))
        toxic = i % 5 == 0
        if toxic:
            ws[int(rng.integers(len(ws)))] = "Zwixxor" + str(rng.choice(["ta", "mi", "lo", "ned"])) + str(rng.integers(100)) + "!"
        docs.append((i, " ".join(ws), "en" if i % 2 else "fr"))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 as score"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark, tables):
    docs, labels = tables
    got = x.report(docs, labels).collect()
    assert len(got) == 1200
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {i for i in range(1200) if zlib.crc32(str(i).encode()) % 4 == 2}
    right = sum((r.doc_id % 5 == 0) == (r.predicted == 1) for r in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    left = x.keep_clean(docs, labels)
    assert left.columns == docs.columns
    ids = {r.doc_id for r in left.select("doc_id").collect()}
    assert sum(i % 5 == 0 for i in ids) <= 12 and sum(i % 5 > 0 for i in ids) >= 945


def test_scores_use_whole_texts_and_no_label(spark, tables):
    docs, labels = tables
    m = x.learn(docs, labels)
    s = x.Scorer(m)
    far = ("word1 " * 30000 + "zwixxorta7").encode()
    a = s.scores([far, None, b"", b"word1 word2", far])
    assert a[0] >= 0.3 > a[3] and a[1] == a[2] and a[0] == a[4]
    flipped = labels.selectExpr("doc_id", "int(if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic)) toxic")
    assert np.array_equal(x.learn(docs, flipped).emb, m.emb)


def test_defined_cases(spark, tables):
    docs, labels = tables
    odd = spark.createDataFrame([(None, None, None), (None, None, None), (1, "", "en")], "doc_id long, text string, lang string")
    assert [(r.score, r.held_out) for r in x.report(odd, labels.limit(0)).collect()] == [(0.0, False)] * 3
    assert len(x.report(odd, labels.selectExpr("doc_id", "cast(null as int) toxic")).collect()) == 3
    assert x.report(docs.limit(0), labels).count() == 0
    assert x.keep_clean(odd, labels.limit(0)).count() == 3


def test_thresholds_rest_on_all_labelled_rows(spark, tables):
    docs, labels = tables
    noisy = labels.selectExpr("doc_id", "int(if(doc_id % 11 = 3, 1, toxic)) toxic")
    m = x.learn(docs, noisy, sample=120)
    label = {r.doc_id: r.toxic for r in noisy.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    rows = [r for r in docs.collect() if r.doc_id in label]
    scores = x.Scorer(m).scores([r.text.encode() for r in rows])
    want, grid = {"": 0.3}, np.linspace(0.1, 0.5, 41)
    for la in ("en", "fr"):
        mine = np.array([r.lang == la for r in rows])
        y = np.array([label[r.doc_id] == 1 for r in rows])[mine]
        f1 = np.array([2 * (y & (scores[mine] >= t)).sum() / (y.sum() + (scores[mine] >= t).sum()) for t in grid])
        best = np.flatnonzero(f1 >= f1.max() - 1e-12)
        want[la] = float(grid[best[len(best) // 2]])
    assert m.thresholds == want


def _slow_score(m, text):
    """One text's score, word by word and window by window."""
    rows = {int(r): e.astype(float) for r, e in zip(m.rows, m.emb, strict=True)}
    vectors = []
    for chunk in (text or "").encode().split():
        word = chunk.decode("utf-8", "replace").lower().strip(x.EDGE)
        keys = [word] + [word[:k] + "~" for k in x.PREFIXES if len(word) >= k]
        v = np.zeros(x.DIM)
        for k in keys:
            if k:
                v += rows.get(xxhash.xxh3_64_intdigest(k.encode()) % (x.BUCKETS - 1) + 1, np.zeros(x.DIM))
        vectors.append(v)
    total, number = 0.0, 0
    for width, w in zip(x.WIDTHS, m.filters, strict=True):
        for f in range(x.FILTERS):
            best = -math.inf
            for at in range(max(len(vectors), 1)):
                best = max(best, sum(float(vectors[at + j] @ w[j][:, f]) for j in range(width) if at + j < len(vectors)))
            total += max(best + float(m.bias[number]), 0) * float(m.out[number])
            number += 1
    at, y = m.knots
    if total <= at[0]:
        level = y[0]
    elif total >= at[-1]:
        level = y[-1]
    else:
        i = max(k for k in range(len(at)) if at[k] <= total)
        level = y[i] + (y[i + 1] - y[i]) * (total - at[i]) / (at[i + 1] - at[i])
    return 0.99 * level + 0.01 / (1 + math.exp(-total))


def test_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(3)
    word = lambda: f"w{int(rng.zipf(1.4)) % 400}"
    texts = [" ".join([word() for _ in range(int(rng.integers(0, 40)))] + (["Vile", "filth!"] if i % 4 == 0 else [])) for i in range(400)]
    m = x.train([t.encode() for t in texts], np.array([i % 4 == 0 for i in range(400)]), 0.25, steps=2000)
    odd = ["", " \n", "x", "Vile", "é VILE, filth", "(vile) " * 300, "a\x1cb c d", *texts[:60]]
    got = x.Scorer(m).scores([t.encode() for t in odd])
    assert max(abs(g - _slow_score(m, t)) for g, t in zip(got, odd, strict=True)) < 1e-4
    assert np.ptp(got) > 0.5
