import random
import re

import numpy as np

from candlewick.llm import quality_rules as q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit.update(j for i in at for j in range(i, i + 8))
    n, r = len(words), len(hit)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), r, n < 20 or 100 * r > 30 * n)


def _texts():
    rng = random.Random(1)
    out = [None, "", " \n\t\r\x0b ", "a", "Shti " * 50, "x\n\nx\nx \n x\n" * 3, "é#ñ\xa0b <|> \x1c   c", "w " * 7, "w " * 8, "w " * 9, "lång " * 3000]
    for _ in range(80):
        block = [" ".join(rng.choices("ab cd ef gh ij kl mn op".split(), k=rng.randint(1, 12))) for _ in range(5)]
        out.append("\n".join(rng.choices([*block, " ".join(rng.choices("abcdefghijkl", k=rng.randint(0, 30)))], k=rng.randint(1, 9))))
    return out


def test_counts_equal_brute_force(spark):
    texts = _texts()
    df = spark.createDataFrame([*enumerate(texts), (None, "a"), (1, "")], "doc_id long, text string").selectExpr("*", "1 as n_words", "2 as kept")
    rows = q.judge(df, []).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r.doc_id is not None and r.doc_id != 1:
            assert tuple(r)[1:7] == brute(texts[r.doc_id]), texts[r.doc_id]
            assert r.kept == (not r.base_failed)
    assert q.judge(df.limit(0), []).count() == 0


def test_learned_list(spark):
    rng = np.random.default_rng(0)
    n = 3000
    x = {f: rng.random(n) for f in q.RATIOS}
    bad = (x["symbols_per_word"] > 0.9) | ((x["repeated"] > 0.8) & (x["word_length"] < 0.3))
    rules = q.learn(x, bad)
    got = np.zeros(n, bool)
    for r in rules:
        got |= r.holds(x)
    assert (got & ~bad).sum() <= 0.03 * got.sum() and (got & bad).sum() >= 0.9 * bad.sum()
    assert q.learn(x, np.zeros(n, bool)) == []
    clean = "plain words that make up one sound line of prose with no junk in it at all number {} and some more words"
    docs = spark.createDataFrame([(i, clean.format(i) if i % 4 else "## {0}$ $$ ## %{0}% ".format(i) + clean.format(i)) for i in range(400)], "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "int(doc_id % 4 > 0) quality").union(docs.selectExpr("doc_id + 9999", "null").limit(5))
    rules = q.learn_from(docs, labels)
    assert rules and all(r.kept == bool(r.doc_id % 4) and (r.rule is None) == r.kept for r in q.judge(docs, rules).collect())
    assert q.learn_from(docs, labels.limit(0)) == []
