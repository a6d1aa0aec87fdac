"""Vector store and filtered top-k search by cosine similarity, exact."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from candlewick.session import written


def conditions(**equal: object) -> Column:
    """All of the equalities; those that are None don't filter."""
    out = F.lit(True)
    for c, v in equal.items():
        if v is not None:
            out = out & (F.col(c) == v)
    return out


def unit(vector: str) -> Column:
    """The vector by its length; itself if that is 0."""
    return F.expr(f"transform(array(sqrt(aggregate({vector}, 0D, (s, x) -> s + CAST(x AS double) * x))), z -> transform({vector}, x -> IF(z > 0, x / z, CAST(x AS double))))[0]")


def upsert(store: DataFrame, new: DataFrame, key: str = "record_id") -> DataFrame:
    """The store with rows of equal keys replaced by the new ones."""
    return store.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def search(queries: DataFrame, store: DataFrame, k: int, query: str = "query", vector: str = "embedding", ids: tuple[str, str] = ("query_id", "record_id"), few: int = 4096, after: Column | None = None) -> DataFrame:
    """The k most similar rows of the store for every query: (query_id, the store's columns, similarity, rank), ties by record_id.

    The queries meet the store in blocks of at most `few`, as a matrix: each task multiplies its rows with it batch by batch and keeps k rows a
    query, so k rows a query and task are shuffled, and the store is read once a block. Exact; queries without length are left out, rows without
    one have a similarity of 0, rows without a vector are none, vectors of another length are an error. `after` filters the neighbours after the k are taken, so fewer may be left.
    """
    q_id, r_id = ids
    q = queries.select(q_id, F.expr(f"transform({query}, x -> CAST(x AS double))").alias("__q")).where("aggregate(__q, 0D, (s, x) -> s + x * x) > 0")
    q = written(q, "vector-queries")
    parts, types = -(-max(1, q.count()) // few), {f.name: f.dataType for f in store.schema.fields}
    schema = StructType([StructField(q_id, q.schema[q_id].dataType), *[StructField(c, t) for c, t in types.items()], StructField("similarity", DoubleType())])
    out = None
    for i in range(parts):
        block = (q if parts == 1 else q.where(F.pmod(F.xxhash64(q_id), F.lit(parts)) == i)).toArrow()
        held = queries.sparkSession.sparkContext.broadcast((block.column(q_id).combine_chunks(), np.array(block.column("__q").to_pylist(), float)))
        near = store.mapInArrow(_nearest(held, k, vector, r_id), schema)
        order = [F.desc("similarity"), F.asc(r_id)]
        top = near.withColumn("rank", F.row_number().over(W.partitionBy(q_id).orderBy(*order))).where(F.col("rank") <= k)
        out = top if out is None else out.unionByName(top)
    return out.where(after) if after is not None else out


def _nearest(held: Broadcast, k: int, vector: str, r_id: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a task's rows, the k best for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = held.value
        if not len(names):
            return
        rows = None  # the store's rows that are among some query's best
        best = np.zeros((0, 2), np.int64)  # query, place in rows
        score = np.zeros(0)
        for b in batches:
            b = b.filter(b.column(vector).is_valid())
            lists = b.column(vector).cast(pa.list_(pa.float64()))
            if wrong := int((np.asarray(lists.value_lengths()) != matrix.shape[1]).sum()):
                raise ValueError(f"{wrong} vectors haven't {matrix.shape[1]} numbers")
            v = np.asarray(lists.flatten()).reshape(-1, matrix.shape[1])
            asks, at, near = _reaching(matrix, v, k)
            used, place = np.unique(at, return_inverse=True)
            more = pa.Table.from_batches([b.take(pa.array(used))])
            offset = rows.num_rows if rows is not None else 0
            rows = more if rows is None else pa.concat_tables([rows, more])
            best, score = np.concatenate([best, np.stack([asks, place + offset], 1)]), np.concatenate([score, near])
            order = np.lexsort((_rank_of(rows.column(r_id))[best[:, 1]], -score, best[:, 0]))
            best, score = best[order], score[order]
            first = np.searchsorted(best[:, 0], best[:, 0])
            kept = np.arange(len(best)) - first < k
            best, score = best[kept], score[kept]
            used, place = np.unique(best[:, 1], return_inverse=True)
            rows = rows.take(pa.array(used)).combine_chunks()
            best[:, 1] = place
        if rows is None:
            return
        for i in range(0, len(best), 10_000):
            part = best[i : i + 10_000]
            taken = rows.take(pa.array(part[:, 1]))
            yield from pa.table([names.take(pa.array(part[:, 0])), *taken.columns, pa.array(score[i : i + 10_000])], names=["q", *taken.column_names, "similarity"]).combine_chunks().to_batches()

    return run


#: Similarities that are held at once, at most (a query's with all vectors at hand at least).
CELLS = 1 << 20


def _reaching(matrix: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of matrix the vectors that reach its k-th best similarity or nearly so, which may be more than k: (row, place, similarity).

    Rows are taken a few at a time: what is held besides the result doesn't grow with their number. A matrix product rounds equal pairs of
    vectors differently by their places, so what it finds is worked out again pair by pair: equal vectors are equally similar.
    """
    n, dim = vectors.shape
    length, few, out = np.sqrt((vectors * vectors).sum(1)), max(1, CELLS // max(1, n, min(n, k) * dim)), []
    for i in range(0, len(matrix), few):
        part = matrix[i : i + few]
        size = np.sqrt((part * part).sum(1))
        s = part @ vectors.T
        s /= size[:, None] * length[None, :] + 1e-12
        if n > k:
            asks, at = np.nonzero(s >= -np.partition(-s, k - 1, axis=1)[:, k - 1][:, None] - 1e-12)
        else:
            asks, at = (x.ravel() for x in np.indices(s.shape))
        pair = part[asks]
        pair *= vectors[at]
        out.append((asks + i, at, pair.sum(1) / (size[asks] * length[at] + 1e-12)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def _block_best(matrix: np.ndarray, vectors: np.ndarray, ranks: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of matrix its k most similar vectors, equal ones by rank: (row, place, similarity)."""
    asks, at, s = _reaching(matrix, vectors, k)
    order = np.lexsort((ranks[at], -s, asks))
    asks, at, s = asks[order], at[order], s[order]
    kept = np.arange(len(asks)) - np.searchsorted(asks, asks) < k
    return asks[kept], at[kept], s[kept]


def matrix_of(column: pa.ChunkedArray, length: int) -> np.ndarray:
    """A list column without nulls as rows of so many numbers; another length is an error."""
    lists = column.cast(pa.list_(pa.float64())).combine_chunks()
    if wrong := int((np.asarray(lists.value_lengths()) != length).sum()):
        raise ValueError(f"{wrong} vectors haven't {length} numbers")
    return np.asarray(lists.flatten()).reshape(-1, length)


#: Queries and rows of a tile at most, on average; copies of queries and rows that are made in one round, if the tables aren't larger.
TILE, ROUND = 8192, 1 << 20


def search_by_key(queries: DataFrame, store: DataFrame, keys: list[str], k: int, query: str = "query", vector: str = "embedding", ids: tuple[str, str] = ("query_id", "record_id"), tile: int = TILE, copies: int = ROUND, asked: DataFrame | None = None) -> DataFrame:
    """The k most similar rows for every query among the store's rows with its keys (nulls are equal): (query_id, the store's columns,
    similarity, rank), ties by record_id.

    A key's queries and rows are cut into tiles of about `tile` by their ids, as many as it has of them, so a large key is spread; each tile
    of queries meets each tile of rows as a matrix product. All pairs are a quadratic number, but what lies on disk isn't: they are worked
    through in rounds of about `copies` copied queries and rows (or as many as the tables have), of which the k best of each query stay, as
    ids; the store's columns are joined to what is left. Nothing is broadcast. A query that has several rows (with different keys) gets the
    k best of all. Queries without length are left out, rows without a vector are none.

    asked: instead of queries' own columns, a row (query_id, keys) for each key in which a query is to look; queries then has a row a query.
    """
    q_id, r_id = ids
    key = F.to_json(F.struct(*keys)).alias("__k")
    long = F.expr(f"aggregate({query}, 0D, (s, x) -> s + CAST(x AS double) * x) > 0")
    if asked is None:
        q = written(queries.where(long).select(key, q_id, F.col(query).alias("__q")), "keyed-queries")
        places, matrix_q = q.select("__k", q_id), None
    else:
        places, matrix_q = written(asked.select(key, q_id), "keyed-queries"), queries.where(long).select(q_id, F.col(query).alias("__q"))
    rows = written(store.where(F.col(vector).isNotNull()).select("*", key, F.monotonically_increasing_id().alias("__row")), "keyed-rows")
    parts = lambda df, n, name: df.groupBy("__k").agg(F.count(F.lit(1)).alias(n), F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(name))
    counts = written(parts(places, "__nq", "__qs").join(parts(rows, "__nr", "__rs"), "__k"), "keyed-counts")
    made, given = counts.agg(F.coalesce(F.sum(F.expr("__nq * __rs + __nr * __qs")), F.lit(0)), F.coalesce(F.sum(F.expr("__nq + __nr")), F.lit(0))).first()
    rounds = max(1, -(-made // max(copies, given)))
    counts = counts.select("__k", "__qs", "__rs")
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    turn = lambda i: F.pmod(F.xxhash64("__k") + i, F.lit(rounds))  # noqa: E731  # a key's tiles of queries are spread over the rounds
    asks = (q if matrix_q is None else places).join(counts, "__k").withColumn("__i", place(q_id, "__qs"))
    found = rows.select("__k", "__row", F.col(r_id).alias("__r"), F.col(vector).alias("__v")).join(counts, "__k").withColumn("__j", place("__r", "__rs"))
    schema = StructType([StructField(q_id, queries.schema[q_id].dataType), StructField("__row", LongType()), StructField("__r", store.schema[r_id].dataType), StructField("similarity", DoubleType())])
    names = schema.fieldNames()

    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        if asked.num_rows and found.num_rows:
            matrix = matrix_of(asked.column("__q"), len(asked.column("__q")[0]))
            rows, at, score = _block_best(matrix, matrix_of(found.column("__v"), matrix.shape[1]), _rank_of(found.column("__r")), k)
        else:
            rows, at, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        mine, theirs = asked.take(pa.array(rows)), found.take(pa.array(at))
        return pa.table([mine.column(q_id), theirs.column("__row"), theirs.column("__r"), pa.array(score)], names=names)

    def best(near: DataFrame) -> DataFrame:
        order = W.partitionBy(q_id).orderBy(F.desc("similarity"), F.asc("__r"), F.asc("__row"))
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    near = None
    for r in range(rounds):
        mine = asks.where(turn(F.col("__i")) == r)
        mine = mine if matrix_q is None else mine.join(matrix_q, q_id)
        mine = mine.select("__k", "__i", F.explode(F.sequence(F.lit(0), F.col("__rs") - 1)).alias("__j"), q_id, "__q")
        tiles = F.filter(F.sequence(F.lit(0), F.col("__qs") - 1), lambda i: turn(i) == r)
        theirs = found.select("__k", "__j", F.explode(tiles).alias("__i"), "__row", "__r", "__v")
        here = mine.groupBy("__k", "__i", "__j").cogroup(theirs.groupBy("__k", "__i", "__j")).applyInArrow(run, schema)
        here = best(here)
        if rounds > 1:  # a round's shuffle files go before the next one's are written
            here = written(here, "keyed-best")
        near = here if near is None else near.unionByName(here)
    near = near if rounds == 1 else best(near.drop("rank"))
    near = near.select(q_id, "__row", "similarity", "rank").join(rows.drop("__k"), "__row")
    return near.select(q_id, *store.columns, "similarity", "rank")


def _rank_of(column: pa.ChunkedArray) -> np.ndarray:
    """Each value's place in the order of values."""
    order = np.asarray(pc.sort_indices(column))
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order))
    return out
