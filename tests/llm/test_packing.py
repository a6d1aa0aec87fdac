import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from candlewick.llm import packing


def _check(rows, docs):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4") for i, x in docs}
    seen, fill, size = {}, {}, {}
    for r in rows:
        ids = want[r.doc_id]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
        size[r.sequence_id] = r.sequence_length
    for i, ids in want.items():
        at = 0
        for s, n in sorted(seen[i]):
            assert s == at and n > 0
            at += n
        assert at == len(ids)
    for k, parts in fill.items():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at == size[k] <= 2048 and at & (at - 1) == 0


def test_every_id_once_and_no_padding(spark):
    docs = [(i, "Word l'été it's <|endoftext|>  x\x1cy ÀB 12 " * (i * i % 97)) for i in range(120)] + [(500, None), (501, ""), (502, "a b " * 9000), (503, "x" * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 as start", "2 as ids")
    for window in (1_000_000, 3000):
        _check(packing.pack(df.repartition(3), window_tokens=window).collect(), docs)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, None), (None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    rows = packing.pack(df.coalesce(1), with_ids=True).collect()
    assert sum(r.length for r in rows) == 1 + 2 + 2 + 2 and sum(len(r.ids) for r in rows) == 28
    assert packing.pack(df.limit(0)).count() == 0
