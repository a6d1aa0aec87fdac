import random

import pytest

from candlewick.llm import components, ngram_join


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None and sets[i]:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def _rows():
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 400)}"
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n", "a", "A", "a b", "a b c d", "a b c d e", "A B c d e", "a b c d e f", "x " * 500]
    for _ in range(25):  # documents around one passage
        texts.append(" ".join([word() for _ in range(rng.randint(0, 60))] + passage + [word() for _ in range(rng.randint(0, 60))]))
    for n, edits in ((12, 1), (40, 3), (120, 6), (300, 14)):  # families near the bound
        base = [word() for _ in range(n)]
        for _ in range(30):
            x = list(base)
            for _ in range(rng.randint(0, edits)):
                x[rng.randrange(n)] = word()
            texts.append(" ".join(x[: rng.randint(n * 8 // 10, n)]))
    ids = rng.sample(range(10_000), len(texts))
    return [*zip(ids, texts, strict=True), (ids[20], texts[20]), (None, texts[40]), (None, texts[40]), (None, "all alone here with null and words"), (ids[3], "b " * 40)]


def test_components_equal_brute_force(spark, monkeypatch):
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # many small steps
    rows = _rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as sig", "2 as n").repartition(5)
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(brute(rows), key=key)
    monkeypatch.setattr(ngram_join._rest, "__defaults__", (3, 8))
    for hot in (2,):
        got = [tuple(r) for r in ngram_join.classes(df, hot).select("doc_id", "n_shingles", "component_id").collect()]
        assert sorted(got, key=key) == want
    assert len({c for _, _, c in want}) > 20
    monkeypatch.undo()
    left = ngram_join.keep_one(df)
    assert left.columns == df.columns
    stays = {d for d, _, c in want if d == c or c is None}
    assert {r.doc_id for r in left.collect()} == stays and left.count() == sum(d in stays for d, _, _ in want)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in ngram_join.classes(df).collect()) == [(1, 0, 1), (2, 0, 2)]
    assert ngram_join.classes(df.limit(0)).count() == 0


def test_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1001), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in components.components(links).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_families_at_production_values(spark):
    """More than 48 nodes share a shingle, so they are multiplied in blocks; some are long enough for blocks by shingles."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 3000)}"
    rows, n = [], 0
    for size, members, edits in ((200, 130, 40), (90, 120, 20), (1500, 60, 300)):
        base = [word() for _ in range(size)]
        for _ in range(members):
            x = list(base)
            for i in rng.sample(range(10, size), rng.randint(0, edits)):  # the first words stay, so all share a few shingles
                x[i] = word()
            rows.append((n, " ".join(x)))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(r) for r in ngram_join.classes(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(brute(rows)) and 3 < len({c for *_, c in got}) < n


def test_unsettled_components_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(links, rounds=2)


def _families(members=60):
    rng = random.Random(8)
    word = lambda: f"w{rng.randint(0, 3000)}"
    rows = []
    for size, edits in ((200, 40), (90, 20)):
        base = [word() for _ in range(size)]
        for _ in range(members):
            x = list(base)
            for i in rng.sample(range(10, size), rng.randint(0, edits)):
                x[i] = word()
            rows.append((len(rows), " ".join(x)))
    return rows


def test_rounds_change_nothing(spark, monkeypatch):
    """Many rounds of pairs, blocks and nodes, which bound what lies on the disk, give what one round gives."""
    rows = [*_families(), (None, "all alone here with null and words"), (None, "all alone here with null and words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(ngram_join._rest, "__defaults__", (3, 8))
    monkeypatch.setattr(ngram_join._needed_sets, "__defaults__", (25,))
    for name, value in (("ROUND_PAIRS", 10), ("ROUNDS", 3), ("SENT_LEAST", 10_000)):
        monkeypatch.setattr(ngram_join, name, value)
    labels, kept = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, label: labels.append(label) or kept(df, label))
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in ngram_join.classes(df, 200).select("doc_id", "n_shingles", "component_id").collect()), key=key)
    assert got == sorted(brute(rows), key=key)
    assert labels.count("join-links") >= 3 and labels.count("join-block-links") > 1 and labels.count("join-shingles") > 3


def test_steps_leave_little_on_disk(spark):
    """What a step has read is removed once it has ended: its shuffle files and the tables that no later step reads."""
    from pathlib import Path

    from candlewick.session import shared_dir, written

    blocks = lambda: sum(f.stat().st_size for f in Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]).rglob("shuffle_*.data"))
    spark.range(0, 300_000, 1, 4).count()
    before = blocks()
    written(spark.range(0, 300_000, 1, 4).selectExpr("uuid() as u").groupBy("u").count(), "test-cleaned")
    assert blocks() - before < 1_000_000
    top = Path(shared_dir(spark).removeprefix("file:"))
    label = lambda: {p.name for p in top.iterdir()}
    there = label()
    ngram_join.classes(spark.createDataFrame(_families(), "doc_id long, text string").repartition(4), 24).count()
    left = {n.removeprefix("candlewick-").rpartition("-")[0] for n in label() - there}
    assert not left & {"join-sets", "join-postings", "join-rooted", "join-open", "join-mixed", "join-hubs", "join-bins", "join-all-bins", "join-shingles", "cc-large", "cc-least"}


def test_map_grows_with_shared_shingles(spark):
    """At some 20 million shared shingles (6 GB of documents) a map of 2^26 bits was a quarter full."""
    assert ngram_join.map_words(0) == ngram_join.map_words(1_700_000) == 1 << 20
    assert 16 * 20_000_000 <= 64 * ngram_join.map_words(20_000_000) <= 1 << 30 >= 64 * ngram_join.map_words(10**10)


def test_keep_one_never_shuffles_texts(spark, monkeypatch):
    """Ids that go are broadcast in parts where they are many."""
    df = spark.createDataFrame([(i, f"one of {i // 4} families of equal texts") for i in range(80)] + [(None, "alone here")], "doc_id long, text string")
    found = [(i, 1, i - i % 4) for i in range(80)] + [(None, 1, None)]
    monkeypatch.setattr(ngram_join, "classes", lambda docs: spark.createDataFrame(found, "doc_id long, n_shingles long, component_id long"))
    left = ngram_join.keep_one(df, few=7)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftAnti") > 3 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert sorted((r.doc_id for r in left.collect()), key=lambda d: (d is None, d)) == [*range(0, 80, 4), None]
