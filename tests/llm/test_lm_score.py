import math
import zlib
from collections import Counter

import numpy as np
import pytest

from candlewick.llm import lm_score


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*low.encode().split(), b""]


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(lm_score, "VOCABULARY", 20)
    monkeypatch.setattr(lm_score, "HEAD", 40)
    monkeypatch.setattr(lm_score, "BATCH", 128)
    monkeypatch.setattr(lm_score, "ROWS", 256)


def _rows():
    rng = np.random.default_rng(1)
    out = [(1, None), (2, ""), (None, "the The É é"), (None, None), (2, "")]
    for i in range(10, 700):
        ws, state = [], 0
        for _ in range(int(rng.integers(1, 120))):
            state = (state + 1) % 3 if rng.random() < 0.9 else int(rng.integers(3))
            ws.append(["Alpha", "beta", "gamma"][state] if rng.random() < 0.8 else f"rare{int(rng.zipf(1.3)) % 5000}")
        out.append((i, " \n".join(ws)))
    return out


def test_base_equals_brute_force_and_model_beats_it(spark, small):
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as h", "2 as c").repartition(4)
    got = lm_score.report(df, rounds=4).collect()
    c = Counter(t for i, x in rows if not held(i) for t in tokens(x))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(t := tokens(x)), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, x in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    tested = [r for r in got if r.held_out]
    assert sum(r.score for r in tested) > sum(r.base_score for r in tested) + 0.05 * sum(r.n_tokens for r in tested)


def test_probabilities_are_normalised(spark, small):
    df = spark.createDataFrame(_rows(), "doc_id long, text string")
    table = lm_score.counts(df)
    m = lm_score.train(df, lm_score.start_model(table), table)
    h, c = (np.array(x) for x in zip(*[(r.h, r.c) for r in table.collect()], strict=True))
    tokens = np.append(h.view(np.uint64), np.uint64(12345))  # and one that never occurs
    log_c = np.append(np.log10(c + 1), 0)
    scorer = lm_score.Scorer(m)
    some = lm_score.Hasher()([b"alpha beta gamma rare1 rare17 never"])[0]
    for context in (some[:0], some[:1], some[[0, 1]], some[[1, 3]], some[[3, 4]], some[[5, 2]]):
        texts = np.array([[*context, t] for t in tokens], np.uint64)
        got = [x.reshape(texts.shape)[:, -1] for x in scorer(texts.ravel(), np.full(len(tokens), texts.shape[1]))]
        inside, w, base, first, seen, unseen = got
        mix = np.append(seen[:-1], unseen[-1])
        p = 10 ** (first + np.where(w == 0, mix + log_c - m.rest_norm, 0))
        assert abs(p.sum() - 1) < 1e-4 and (w == 0).sum() > 100 and inside[:-1].any()
    assert np.std(p[w == 0] / 10 ** log_c[w == 0]) > 0  # the mixture tells them apart


def test_learning_does_not_depend_on_partitions(spark, small, monkeypatch):
    monkeypatch.setattr(lm_score, "SHARD_TOKENS", 1500)  # some twenty shards, in levels
    df = spark.createDataFrame(_rows()[5:], "doc_id long, text string").repartition(3)
    got = [{r.doc_id: r.score for r in lm_score.report(x).collect()} for x in (df, df.repartition(11))]
    assert got[0].keys() == got[1].keys() and max(abs(got[0][k] - got[1][k]) for k in got[0]) < 1e-3


def test_empty_and_untrained(spark):
    df = spark.createDataFrame([(i, "a b") for i in range(40) if held(i)], "doc_id long, text string")
    rows = lm_score.report(df).collect()
    assert rows and all(r.n_tokens == 3 and r.n_known == 0 and r.train_tokens == 0 and r.base_score == r.score == 0 for r in rows)
    assert lm_score.report(df.limit(0)).count() == 0


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    find = lm_score.Lookup(keys)
    assert np.array_equal(find(keys), np.arange(len(keys))) and (find(keys + np.uint64(1)) == -1).all()


def test_production_parameters_beat_the_base_in_many_small_partitions(spark):
    df = spark.createDataFrame(_rows(), "doc_id long, text string")
    for n in (2, 64):
        tested = lm_score.report(df.repartition(n)).where("held_out").collect()
        assert sum(r.score - r.base_score for r in tested) > 0.05 * sum(r.n_tokens for r in tested)
