"""Stored vectors, search within series, and the inverted-file index, against plain numpy."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from candlewick.operators import vector_store, vectors

DDL = "record_id string, symbol string, label string, embedding array<double>"


def rows_of(rng, n, length=8, centres=6, first=0):
    middle = rng.normal(size=(centres, length)) * 3
    own = rng.integers(0, centres, n)
    x = middle[own] + rng.normal(size=(n, length))
    return [(f"r{i + first:05d}", f"S{i % 3}" if i % 7 else None, "Good" if i % 2 else "Bad", [float(v) for v in x[i]]) for i in range(n)]


def nearest(rows, query, k):
    """(record_id, similarity) by falling similarity, then id."""
    q, found = np.array(query), []
    for r in rows:
        v = np.array(r[3])
        found.append((-(v @ q) / (np.linalg.norm(v) * np.linalg.norm(q) + 1e-12), r[0]))
    return [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in found)[:k]]


def as_lists(df, k):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.record_id, r.similarity))
    assert all(len(x) <= k for x in out.values())
    return out


def same(got, want):
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want])


@pytest.mark.parametrize("tile", [2048, 7])
def test_search_by_key(spark, tile):
    rows = rows_of(np.random.default_rng(1), 160)
    rows += [("copy" + r[0], *r[1:]) for r in rows[:12]] + [("zero", "S1", "Good", [0.0] * 8), ("none", "S1", "Good", None)]
    store = spark.createDataFrame(rows, DDL)
    asked = store.where("record_id <> 'none'").select(F.col("record_id").alias("query_id"), "symbol", F.col("embedding").alias("query"))
    asked = asked.unionByName(spark.createDataFrame([("stranger", "S9", [1.0] * 8)], asked.schema))
    got = as_lists(vectors.search_by_key(asked, store, ["symbol"], 5, tile=tile), 5)
    known = [r for r in rows if r[3] is not None]
    assert set(got) == {r[0] for r in known if r[0] != "zero"}
    for r in known:
        if r[0] in got:
            same(got[r[0]], nearest([x for x in known if x[1] == r[1]], r[3], 5))
    with pytest.raises(Exception, match="haven't 8 numbers"):
        vectors.search_by_key(asked, spark.createDataFrame([("x", "S1", "Good", [1.0])], DDL), ["symbol"], 5).collect()
    assert vectors.search_by_key(asked.limit(0), store, ["symbol"], 5).count() == vectors.search_by_key(asked, store.limit(0), ["symbol"], 5).count() == 0


def test_store(spark, tmp_path):
    path, rng = f"file://{tmp_path}/s", np.random.default_rng(2)
    with pytest.raises(ValueError, match="no vector store"):
        vector_store.VectorStore(spark, path)
    store = vector_store.VectorStore(spark, path, 8, buckets=5)
    assert store.count() == 0 == store.rows().count()
    first, more = rows_of(rng, 60), rows_of(rng, 30, first=45)
    frame = lambda rows: spark.createDataFrame(rows, DDL)
    store.upsert(frame(first))
    store.upsert(frame(more))
    store.upsert(frame(first).limit(0))
    want = {r[0]: r for r in first} | {r[0]: r for r in more}
    read = lambda s, **equal: {r[0]: tuple(r) for r in s.rows(**equal).collect()}
    opened = vector_store.VectorStore(spark, path, 8)
    assert read(opened) == want and opened.count() == 75 and opened.buckets == 5
    assert read(opened, symbol="S1", label=None) == {k: r for k, r in want.items() if r[1] == "S1"}
    for wrong, message in ((["x", "S", "Good", [1.0]], "haven't 8 numbers"), ([None, "S", "Good", [1.0] * 8], "lack an id"), (["x", "S", "Good", None], "vector")):
        with pytest.raises(ValueError, match=message):
            opened.upsert(frame([tuple(wrong)]))
    with pytest.raises(ValueError, match="ids"):
        opened.upsert(frame([first[0], first[0]]))
    with pytest.raises(ValueError, match="stored vectors have 8"):
        vector_store.VectorStore(spark, path, 9)
    assert read(vector_store.VectorStore(spark, path)) == want
    opened.delete(frame(more).where("record_id < 'r00050'"))
    want = {k: r for k, r in want.items() if not "r00045" <= k < "r00050"}
    assert read(vector_store.VectorStore(spark, path)) == want
    assert opened.vacuum(1) > 0 and read(vector_store.VectorStore(spark, path)) == want
    opened.overwrite(frame(first[:3]))
    assert read(vector_store.VectorStore(spark, path)) == {r[0]: r for r in first[:3]}
    opened.overwrite(frame([]))
    assert vector_store.VectorStore(spark, path).count() == 0 == opened.rows().count()


def test_a_lost_write_is_never_read(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    store, rows = vector_store.VectorStore(spark, path, 8, buckets=3), rows_of(np.random.default_rng(3), 20)
    store.upsert(spark.createDataFrame(rows, DDL))
    spark.createDataFrame(rows[:2], DDL).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/rows/v2")
    again = vector_store.VectorStore(spark, path)
    assert again.count() == 20
    with pytest.raises(Exception, match="(?i)exists"):
        again.overwrite(spark.createDataFrame(rows[:1], DDL))


def test_index(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = rows_of(rng, 600, centres=10) + [("zero", "S1", "Good", [0.0] * 8), ("none", "S1", "Good", None)]
    known = rows[:-1]
    df = spark.createDataFrame(rows, DDL)
    index = vector_store.InvertedIndex.build(df, f"file://{tmp_path}/i", cells=12, sample=300)
    opened = vector_store.InvertedIndex(spark, f"file://{tmp_path}/i")
    assert opened.rows().count() == 601 and len(opened.centroids) <= 12 and np.allclose(opened.centroids, index.centroids)
    asked = spark.createDataFrame([(r[0], r[3]) for r in rows[:600:20]], "query_id string, query array<double>")
    exact = as_lists(opened.search(asked, 10, probes=2, exact=True), 10)
    near = as_lists(opened.search(asked, 10, probes=3), 10)
    hits = 0
    for r in rows[:600:20]:
        want = nearest(known, r[3], 10)
        same(exact[r[0]], want)
        hits += len({i for i, _ in want} & {i for i, _ in near[r[0]]})
    assert hits >= 0.9 * 300
    filtered = as_lists(opened.search(asked, 4, probes=2, exact=True, where=F.col("symbol") == "S2"), 4)
    for r in rows[:600:100]:
        same(filtered[r[0]], nearest([x for x in known if x[1] == "S2"], r[3], 4))
    plan = opened.rows().where(F.col("cell").isin([0, 1]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_recall_of_the_query(spark):
    """The registered approximate search against all rows."""
    from candlewick.plans import queries

    d = "/root/testdata/sf0.1"
    store = queries._store(spark, d)
    asked = store.where("record_id % 100 = 0").select(F.col("record_id").alias("query_id"), F.col("embedding").alias("query"))
    got = {(r.query_id, r.record_id) for r in queries.vector_ann_topk(spark, d).collect()}
    want = {(r.query_id, r.record_id) for r in vectors.search(asked, store, 10).collect()}
    assert len(got & want) >= 0.9 * len(want), (len(got & want), len(want))


def test_all_pairs_in_rounds(spark):
    """A large key's pairs are worked through in rounds, of which ids stay; vectors aren't sorted or shuffled with every neighbour."""
    rows = [(*r[:1], "S", *r[2:]) for r in rows_of(np.random.default_rng(6), 240)]
    store = spark.createDataFrame(rows, DDL)
    asked = store.select(F.col("record_id").alias("query_id"), "symbol", F.col("embedding").alias("query"))
    narrow = vectors.search_by_key(asked, store, ["symbol"], 5).select("query_id", "record_id", "rank")
    plan = narrow._jdf.queryExecution().optimizedPlan().toString()
    pairs = [line for line in plan.splitlines() if "FlatMapCoGroupsInArrow" in line]
    assert pairs and not any("embedding" in line for line in pairs) and narrow.count() == 1200
    kept, plain = [], vectors.written

    def noted(df, label):
        out = plain(df, label)
        kept.append((label, out.count(), out.columns))
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(vectors, "written", noted)
        got = as_lists(vectors.search_by_key(asked, store, ["symbol"], 5, tile=20, copies=700), 5)
    for r in rows:
        same(got[r[0]], nearest(rows, r[3], 5))
    rounds = [(n, columns) for label, n, columns in kept if label == "keyed-best"]
    assert len(rounds) > 2 and sum(n for n, _ in rounds) == 5 * len(rows) and all("embedding" not in c for _, c in rounds)


def test_equal_vectors_are_equally_similar():
    """Whatever their places in a block are: a matrix product alone rounds them differently."""
    x = np.random.default_rng(8).normal(size=64)
    for n in range(1, 40):
        _, _, s = vectors._block_best(np.stack([x * 0.3] * 3), np.stack([x] * n), np.arange(n), n)
        assert len(set(s)) == 1


def held_at_most(run):
    """MB that a function's arrays take at once."""
    tracemalloc.start()
    run()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return peak / 1e6


def test_search_holds_few_similarities():
    """1500 queries and a batch of 8000 rows have 96 MB of similarities."""
    x = np.random.default_rng(9).normal(size=(8000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000)), pa.array(list(x), pa.list_(pa.float64()))], names=["record_id", "embedding"])
    held, out = SimpleNamespace(value=(pa.array(range(1500)), x[:1500])), []
    peak = held_at_most(lambda: out.extend(vectors._nearest(held, 3, "embedding", "record_id")(iter([batch]))))
    table = pa.Table.from_batches(out)
    first = {q: r for q, r, s in zip(*(table.column(c).to_pylist() for c in ("q", "record_id", "similarity")), strict=True) if s > 1 - 1e-9}
    assert table.num_rows == 4500 and first == {i: i for i in range(1500)}
    assert peak < 60, peak


def test_index_holds_few_angles():
    """4000 queries and 1500 cells have 48 MB of angles; which cells a query is to look into is told by its id alone."""
    rng = np.random.default_rng(10)
    index = object.__new__(vector_store.InvertedIndex)
    index.spark = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda v: SimpleNamespace(value=v)))
    index.centroids, index.widest = rng.normal(size=(1500, 8)), np.zeros(1500)
    asked = SimpleNamespace(schema=StructType([StructField("query_id", LongType())]), mapInArrow=lambda run, schema: (run, schema))
    run, schema = index._probed(asked, "__q", 2)
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000)), pa.array(list(rng.normal(size=(4000, 8))), pa.list_(pa.float64()))], names=["query_id", "__q"])
    out = []
    peak = held_at_most(lambda: out.extend(run(iter([batch]))))
    assert pa.Table.from_batches(out).num_rows == 8000 and schema.fieldNames() == ["query_id", "cell"]
    assert peak < 40, peak
