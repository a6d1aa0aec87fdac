"""The pipeline's stages over the smallest tables, each against brute force on what the stage before it kept."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import test_decontamination
import test_ngram_join
import test_secrets
from tokenizers import Tokenizer

import corpus_pipeline
from candlewick.llm import secrets, toxicity

DIR = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _rows(df):
    return sorted(tuple(r) for r in df.select(COLUMNS).collect())


def test_stages_equal_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, DIR).write.parquet(path)
        docs = spark.read.parquet(path)
        kept.append(docs)
    start = _rows(spark.read.parquet(f"{DIR}/documents.parquet"))
    assert all(k.columns == COLUMNS for k in kept[:-1])

    model = toxicity.learn(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    want = [r for r in start if scorer.scores([r[1].encode()])[0] < model.thresholds.get(r[2], model.thresholds.get("", 0.3))]
    assert _rows(kept[0]) == want

    least = {d: c for d, _, c in test_ngram_join.brute([r[:2] for r in want])}
    want = [r for r in want if least[r[0]] == r[0]]
    assert _rows(kept[1]) == want

    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{DIR}/benchmark.parquet").to_pylist()]
    want = [r for r in want if not test_decontamination.brute(r[1], items)[4]]
    assert _rows(kept[2]) == want

    got = {r[0]: r for r in _rows(kept[3])}
    assert sorted(got) == [r[0] for r in want]
    for r in want:
        spans, text = test_secrets.brute(r[1])[2], r[1]
        merged = []
        for at, stop in sorted(tuple(map(int, x.split(":")[1:])) for x in spans.split(",") if x):
            if merged and at < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], stop)
            else:
                merged.append([at, stop])
        for at, stop in reversed(merged):
            text = text[:at] + secrets.MASK + text[stop:]
        assert got[r[0]] == (r[0], text, *r[2:])

    t, seen = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {}
    ids = {d: np.array([*t.encode(r[1], add_special_tokens=False).ids, 1], "<u4") for d, r in got.items()}
    for r in kept[4].collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {d: len(x) for d, x in ids.items()}
    assert corpus_pipeline.run(spark, DIR).count() == kept[4].count()


def test_odd_rows_pass_every_stage(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, an empty table, and columns whose names the stages use themselves."""
    clean = " ".join(f"plain{i}" for i in range(40))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, None, "en", None, 0), (3, clean, None, "a", 1), (3, clean, None, "a", 1), (4, "long " + " ".join(f"x{i}" for i in range(50_000)), "fr", "b", None), (5, clean + " token=abcdefghijklmnop", "zz", "b", 9)]
    for part in (rows, []):
        docs = spark.createDataFrame(part, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 as sig", "2 as __digest", "3 as score", "4 as start")
        columns, first = docs.columns, docs
        for name, stage in corpus_pipeline.STAGES:
            path = str(tmp_path / f"{len(part)}-{name}")
            stage(spark, docs, DIR).write.parquet(path)
            docs = spark.read.parquet(path)
            if name != "packing":
                assert docs.columns == columns, name
                first = docs
        kept = sorted(map(str, (tuple(r)[:2] for r in first.collect())))
        # 5 holds the set of 3 and one shingle family more, so 3 alone stays, both its rows.
        assert kept == sorted(map(str, [r[:2] for r in part if r[0] != 5]))
        assert docs.where("doc_id = 4").agg({"length": "sum"}).first()[0] == (docs.where("doc_id = 4").first() or {"doc_tokens": None})["doc_tokens"]
