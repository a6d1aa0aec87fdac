import gzip
import hashlib
import random
import re

from candlewick.llm import warc


def test_round_trip(spark):
    rng = random.Random(0)
    long = [bytes(rng.choices(b"abc \n<>\r", k=300)).decode() + "é\0\x1f" for _ in range(3)]
    rows = [(1, "http://a/\r\nX: y", long[0]), (2, None, None), (3, "u", ""), (4, "u", "short"), (5, "u", "short"), (6, "u", long[0]), (6, "u", long[0]), (0, "u", long[1]), (9, "u", long[1]), (None, "u", long[1]), (None, "u", long[2]), (None, "v", long[2]), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9)]
    rows += [(100 + i, f"http://h/{i}", "".join(rng.choices("abcdefgh ", k=rng.randint(0, 5000)))) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as first").repartition(3)
    want = []
    for p, _, h in rows:
        raw = (h or "").encode()
        same = [q for q, _, g in rows if (g or "").encode() == raw and q is not None]
        first = min(same) if len(raw) >= 100 and same else None
        back = first is not None and first != p
        want.append((p, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if back else "response", first if back else None))
    assert sorted(map(str, (tuple(r) for r in warc.round_trip(df).collect()))) == sorted(map(str, want))
    assert warc.round_trip(df.limit(0)).count() == 0


def _archive(n=20):
    payloads = [(f"page {i} " * 50).encode() for i in range(n)]
    return payloads, [warc.record(i, f"http://h/{i}", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(payloads)]


def test_salvage_of_damaged_members_and_plain_records():
    payloads, records = _archive()
    for packed in (True, False):
        parts = [warc.members(r) if packed else r for r in records]
        data = bytearray(b"".join(parts))
        at = [sum(map(len, parts[:i])) for i in range(21)]
        data[at[4] - 30] ^= 255  # inside record 3
        data[at[7] : at[7] + 4] = b"????"  # the start of record 7
        data = data[: at[12]] + b"noise \x1f\x8b\x08 WARC/1.1\r\n bad" + data[at[12] : at[19] + 40]  # noise, and the last ones cut off
        s = warc.Salvage(bytes(data))
        got = [int(r.headers["warc-record-id"].rpartition(":")[2][:-1]) for r in s]
        assert got == [i for i in range(19) if i not in (3, 7)]
        assert [(g.start, g.stop) for g in s.gaps] == [(at[3], at[4]), (at[7], at[8]), (at[12], at[12] + 24), (at[19] + 24, len(data))]
        assert all(g.reason for g in s.gaps)


def test_large_record_and_foreign_gzip():
    raw = random.Random(1).randbytes(300_000)
    big = warc.record(1, "u", raw, hashlib.sha256(raw).hexdigest(), None)
    old, warc.PART = warc.PART, 65_536
    try:
        data = warc.members(big, warc.PART) + warc.members(_archive(1)[1][0])
        assert [len(r.block) > 300_000 for r in warc.Salvage(data)] == [True, False]
    finally:
        warc.PART = old
    s = warc.Salvage(gzip.compress(_archive(1)[1][0]) + b"")
    assert len(list(s)) == 1 and not s.gaps
    assert list(warc.Salvage(b"")) == [] and list(warc.Salvage(b"junk")) == []


def test_gaps_are_logged_by_the_reader(spark, tmp_path):
    _, records = _archive(3)
    data = warc.members(records[0]) + b"xx" + warc.members(records[2])
    (tmp_path / "a.warc.gz").write_bytes(data)
    rows = warc.read(spark, str(tmp_path)).collect()
    assert [r.kind for r in rows] == ["record", "record", "gap"] and rows[2].stop - rows[2].start == 2
    assert rows[1].payload == b"page 2 " * 50 and rows[1].target_uri == "http://h/2"


def _numbers(s):
    return [int(re.search(rb"page (\d+) ", r.block)[1]) for r in s]  # a plain record's headers have no checksum


def test_members_with_several_records():
    _, records = _archive(30)
    whole = b"".join(records)
    s = warc.Salvage(gzip.compress(whole))
    assert _numbers(s) == list(range(30)) and not s.gaps
    rs = list(warc.Salvage(gzip.compress(whole)))
    assert [whole[r.inner_start : r.inner_stop] for r in rs] == records and {r.checks for r in rs} == {"member,block"}
    # damaged before it was packed: record 5's block, record 9's version line, noise after record 20
    at = [sum(map(len, records[:i])) for i in range(31)]
    bad = bytearray(whole)
    bad[at[6] - 20] ^= 1
    bad[at[9]] ^= 1
    bad = bytes(bad[: at[21]]) + b"noise WARC/1.1\r\n x" + bytes(bad[at[21] :])
    s = warc.Salvage(warc.members(records[0]) + gzip.compress(bad) + b"??" + warc.members(whole[: at[3]]))
    assert _numbers(s) == [0, *(i for i in range(30) if i not in (5, 9)), 0, 1, 2]
    inner = [(g.inner_start, g.inner_stop) for g in s.gaps]
    assert inner == [(at[5], at[6]), (at[9], at[10]), (at[21], at[21] + 18), (None, None)]


def test_damaged_member_keeps_what_its_digests_prove():
    _, records = _archive(400)
    whole = b"".join(records)
    rng = random.Random(3)
    packed = bytearray(gzip.compress(whole, 1))
    packed[len(packed) // 2] ^= 255
    s = warc.Salvage(bytes(packed) + warc.members(records[7]))
    got = _numbers(s)
    assert got[-1] == 7 and got[:-1] == list(range(len(got) - 1)) and 50 < len(got) < 400
    assert len(s.gaps) == 1 and s.gaps[0].start == 0 and s.gaps[0].stop == len(packed)
    assert s.gaps[0].inner_start == sum(map(len, records[: len(got) - 1]))
    cut = warc.Salvage(gzip.compress(whole, 1)[: len(packed) // 3])
    assert 20 < len(_numbers(cut)) < 400 and cut.gaps[0].reason == "gzip: cut off"
    trailer = bytearray(gzip.compress(whole))
    trailer[-6] ^= 1  # the checksum alone
    s = warc.Salvage(bytes(trailer))
    assert [r.checks for r in s] == ["block"] * 400 and len(s.gaps) == 1
    # mixed plain and packed, any damage: no sound record is lost, none is made up
    for _ in range(60):
        parts, inside = [], []
        while len(inside) < 40:
            n = rng.randint(1, 6)
            group = range(len(inside), min(40, len(inside) + n))
            data = b"".join(records[i] for i in group)
            parts.append((data if rng.random() < 0.4 else gzip.compress(data, 6), list(group)))
            inside += group
        k = rng.randrange(len(parts))
        data = bytearray(parts[k][0])
        data[rng.randrange(len(data))] ^= rng.randint(1, 255)
        got = _numbers(warc.Salvage(b"".join(bytes(data) if i == k else p for i, (p, _) in enumerate(parts))))
        assert set(range(40)) - set(parts[k][1]) <= set(got) <= set(range(40)) and len(got) == len(set(got))


def test_long_member_in_pieces(monkeypatch):
    monkeypatch.setattr(warc, "HELD", 1 << 12)
    monkeypatch.setattr(warc, "PIECE", 1 << 8)
    _, records = _archive(200)
    assert _numbers(warc.Salvage(gzip.compress(b"".join(records)))) == list(range(200))
    bad = records[:50] + [records[50][:-9]] + records[51:]
    s = warc.Salvage(gzip.compress(b"".join(bad)))
    assert _numbers(s) == [i for i in range(200) if i != 50] and len(s.gaps) == 1


def test_salted_revisits_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "SALTS", 3)
    rows = [(i, "u", "same page " * 20 if i % 3 else f"page {i} " * 20) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(str, warc.round_trip(df).collect()))
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert sorted(map(str, warc.round_trip(df).collect())) == want
