"""Merkle manifests against a plain recursive version, for several fanouts and block sizes."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from candlewick.llm import entries, merkle


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, add=0):
    values = (r[0], r[3], r[2], None if r[4] is None else r[4] + add, r[1])  # doc_id, source, lang, n_chars, text
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def path(levels, at, fanout):
    """(place, siblings) of each level."""
    out = []
    for nodes in levels[:-1]:
        run = nodes[at // fanout * fanout : at // fanout * fanout + fanout]
        out.append((at % fanout, run[: at % fanout] + run[at % fanout + 1 :]))
        at //= fanout
    return out


def fold(digest, steps):
    for place, others in steps:
        digest = h(*others[:place], digest, *others[place:])
    return digest


def expected(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, text, lang, source, n_chars)."""
    key = lambda v: (v is not None, v)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = [sorted((r for r in rows if r[2] == lang), key=lambda r: (key(r[0]), leaf(r))) for lang in langs]
    trees = [tree([leaf(r) for r in g], fanout) for g in groups]
    top = tree([t[-1][0] for t in trees], fanout) if trees else []
    out = []
    for i, (g, t) in enumerate(zip(groups, trees, strict=True)):
        for at, r in enumerate(g):
            steps = path(t, at, fanout) + path(top, i, fanout)
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            out.append((r[0], leaf(r), t[-1][0], top[-1][0], h(*[s for _, others in steps for s in others]), fold(leaf(r, int(hit)), steps)))
    return out


DDL = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long, key int, leaf string"
NAMES = ["a", "", None, "é", "zz", "￿", "\U0001f600"]


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "clash", 1, 2, "leaf") for r in rows], DDL).repartition(parts)


def audited(spark, docs, fanout, block):
    hit = F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 7 == 0, F.lit(False))
    m = merkle.of_documents(docs, fanout, block, hit, {"n_chars": F.try_add(docs["n_chars"], F.lit(1))})
    return m, sorted((tuple(r[c] for c in ("key", "leaf", "subroot", "root", "proof_sha256", "folded_root")) for r in m.audit().collect()), key=str)


ROWS = [(i if i % 11 else None, None if i % 13 == 0 else f"text {i} ñ", NAMES[i * i % 3 if i % 2 else i % 7], None if i % 5 == 0 else f"s{i % 4}", None if i % 9 == 0 else i) for i in range(150)]


@pytest.mark.parametrize(("fanout", "block"), [(2, 4), (2, 2), (3, 9), (5, 4096), (4, 20)])
def test_brute_force(spark, fanout, block):
    rows = ROWS + ROWS[:20] + [(7, "x", "a", "s", 2**63 - 1)]
    want = sorted(expected([r for r in rows if r[4] != 2**63 - 1 or zlib.crc32(str(r[0]).encode()) % 7], fanout), key=str)
    rows = [r for r in rows if r[4] != 2**63 - 1 or zlib.crc32(str(r[0]).encode()) % 7]
    m, got = audited(spark, frame(spark, rows), fanout, block)
    assert got == want and any(g[5] != g[3] for g in got)
    proofs = m.proofs().collect()
    assert sorted((r.leaf, merkle.fold_path(r.leaf, r.places, r.others)) for r in proofs) == sorted((g[1], g[3]) for g in got)
    assert sorted((r.key is None, r.key or 0, h(*r.others)) for r in proofs) == sorted((g[0] is None, g[0] or 0, g[4]) for g in got)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", "s", 1)], [(None, None, None, None, None)], [(1, "a", "en", "s", 1), (1, "b", "de", "s", 1)], [(4, "a", "en", "s", 1)] * 9])
def test_small_tables(spark, rows):
    assert audited(spark, frame(spark, rows, 2), 2, 4)[1] == sorted(expected(rows), key=str)


def test_overflow_is_seen(spark):
    """A damaged field that has no value left to become is found null."""
    rows = [(i, "t", "en", "s", 2**63 - 1) for i in range(40)]
    _, got = audited(spark, frame(spark, rows), 2, 8)
    assert {g[0] for g in got if g[5] != g[3]} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 0}


def test_long_text(spark):
    rows = [(i, "é" * (200_000 if i == 2 else 1), "en", "s", 1) for i in range(5)]
    assert audited(spark, frame(spark, rows), 2, 4)[1] == sorted(expected(rows), key=str)


def test_shape():
    assert merkle.Shape(2).block == 4096 and merkle.Shape(3, 4).block == 3 and merkle.Shape(7, 5).block == 7
    with pytest.raises(ValueError, match="fanout"):
        merkle.Shape(1)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in entries.op12_merkle(spark, d).collect()), key=str)
    assert got == sorted(((*w, w[5] == w[3]) for w in expected(rows)), key=str)
