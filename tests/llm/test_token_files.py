"""Token files: ids against the library, whole round trip against brute force, selective reads, format."""

import glob
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from candlewick.llm import entries, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
SHOWN = ["a", "Wort", "ñandú", "ß", "'s", "don't", "12", "²3", "ª", "α", "Ж", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", ".", ",", "_", "-", "<|endoftext|>", "é", "日本", "🙂", "\x00"]


def plain(text):
    return TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(SHOWN) | st.text(max_size=4), max_size=12).map("".join), max_size=5))
def test_ids_are_the_librarys(texts):
    encode = token_files.encoder(PATH)
    assert encode.chunked
    assert [np.frombuffer(x, "<u4").tolist() for x in encode.of(texts)] == [plain(t) for t in texts]


def test_memory_is_bounded():
    encode = token_files.Encoder(PATH, bound=40)
    for i in range(60):
        texts = [f"word{i} Wort und and\nZeile{i} " + "x" * 100, None]
        assert [np.frombuffer(x, "<u4").tolist() for x in encode.of(texts)] == [plain(texts[0]), []]
        assert len(encode.young) + len(encode.old) <= 60 and max(map(len, encode.young), default=0) <= 64


PIECES = ["a", "Zq", "é", "×", "÷", "ſ", "ʯ", "ʰ", "ñandú", "中", "文字", "🙂", "о", "\u0301", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u1680", "'", "'s", "'ll", "\u2019", "1", "42", ".", ",", "-", "(", "«", "\x00", "\x7f", "the", " of", "word" * 30]


@pytest.mark.parametrize("keys", ["spread", "few"])
def test_chunks_of_any_characters(monkeypatch, keys):
    """Chunks looked up by array operations, also where all of them share a few hashes."""
    if keys == "few":
        monkeypatch.setattr(token_files, "mix", lambda x: x & np.uint64(7))
    rng, encode = np.random.default_rng(11), token_files.Encoder(PATH, bound=600)
    for _ in range(60):
        texts = ["".join(PIECES[i] for i in rng.integers(0, len(PIECES), rng.integers(0, 40))) for _ in range(40)]
        assert [np.frombuffer(x, "<u4").tolist() for x in encode.of(texts)] == [plain(t) for t in texts]
    assert isinstance(encode.young, token_files.Chunks) and all(len(x) <= 64 for x in encode.young)


def test_pieces_of_long_texts():
    encode = token_files.Encoder(PATH)
    texts = ["word and\nline, " * 50, "", "x" * 3000, "é" * 500 + " end"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encode._chunked([t.encode() for t in texts], most=100)] == [plain(t) for t in texts]


def test_other_vocabularies_are_used_whole():
    encode = token_files.encoder(public_tokenizers.path("word_bpe_49k.json"))
    text = "Two  Words\nund <|endoftext|> don't"
    assert not encode.chunked and np.frombuffer(encode.of([text])[0], "<u4").tolist() == Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids


def expected(rows, end=token_files.END_ID):
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*plain(text or ""), end]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


ROWS = [(5, "five words of a text"), (None, "no id"), (3, None), (4, ""), (9, "long " * 60_000), (-2, "<|endoftext|> x"), *[(i, f"Text {i}\n\n ñ") for i in range(10, 60)]]


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_round_trip(spark, tmp_path, encoding):
    docs = spark.createDataFrame([(i, t, 1, [2]) for i, t in ROWS], "doc_id int, text string, part int, ids array<int>").repartition(5)
    path = f"file://{tmp_path}/tokens"
    token_files.write(docs, path, encoding=encoding, row_group_bytes=4096, page_bytes=1024, page_rows=4)
    want = expected(sorted(ROWS, key=lambda r: (r[0] is not None, r[0])))
    assert sorted(map(tuple, token_files.digests(spark, path).select("start", "doc_id", "n_tokens", "ids_crc32").collect())) == sorted((s, i, n, c) for i, s, n, c, _ in want)
    assert sorted(map(tuple, token_files.metadata(spark, path).select("start", "doc_id", "n_tokens").collect())) == sorted((s, i, n) for i, s, n, _, _ in want)
    assert sorted(map(tuple, token_files.documents(spark, path, 4, 9).select("doc_id", "start", "ids").collect())) == sorted((i, s, ids) for i, s, _, _, ids in want if i in (4, 5, 9))
    stream = [x for w in want for x in w[4]]
    for start, stop in ((0, 1), (3, 40), (7, 70_000), (len(stream) - 5, len(stream) + 9), (len(stream), len(stream) + 1), (60, 60)):
        got = sorted((r.start, r.ids) for r in token_files.window(spark, path, start, stop).collect())
        assert [x for _, ids in got for x in ids] == stream[start:stop] and all(ids for _, ids in got)
    seen = set()
    for name in glob.glob(f"{tmp_path}/tokens/files/*.parquet"):
        footer = pq.ParquetFile(name).metadata
        for g in range(footer.num_row_groups):
            column = footer.row_group(g).column(4)
            assert column.path_in_schema == "ids.list.element" and column.has_column_index and column.has_offset_index and footer.row_group(g).column(1).has_column_index
            seen |= {"DICTIONARY" if "DICTIONARY" in e else e for e in column.encodings}
    assert ("DICTIONARY" in seen) == (encoding == "dictionary") and ("DELTA_BINARY_PACKED" in seen) == (encoding == "delta")


def test_pushed_down(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_files.write(spark.range(0, 100).selectExpr("id AS doc_id", "'some text' AS text"), path)
    plan = token_files.documents(spark, path, 4, 9)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(doc_id,4)" in plan and "LessThanOrEqual(doc_id,9)" in plan
    plan = token_files.metadata(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema: ")[1].split("\n")[0]


def test_repeated_ids_and_empty(spark, tmp_path):
    rows = [(1, "a"), (1, "b"), (1, "a"), (0, "c"), (0, None)]
    path = f"file://{tmp_path}/tokens"
    token_files.write(spark.createDataFrame(rows * 30, "doc_id long, text string").repartition(7), path)
    got = sorted(map(tuple, token_files.digests(spark, path).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    assert [g[0] for g in got] == np.cumsum([0, *[g[2] for g in got]])[:-1].tolist() and [g[1] for g in got] == [0] * 60 + [1] * 90
    assert sorted(g[3] for g in got) == sorted(x[3] for x in expected(rows * 30))
    empty = f"file://{tmp_path}/none"
    token_files.write(spark.createDataFrame([], "doc_id long, text string"), empty)
    assert token_files.digests(spark, empty).count() == token_files.window(spark, empty, 0, 5).count() == 0
    with pytest.raises(ValueError, match="encoding"):
        token_files.write(spark.range(1), empty, encoding="plain")


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect())
    got = sorted(map(tuple, entries.op13_token_files(spark, d).collect()))
    assert got == [w[:4] for w in expected(rows)]
