"""A stored vector memory: rows by id in buckets, versions with a manifest, and an inverted-file index over it.

Layout below a store's path: `rows/v<version>/bucket=<b>` (Parquet) and `manifest/v<version>` (JSON, a row per bucket that has rows: where it
lies and how many rows it has). A write puts the buckets that it touches beside the old ones and then a manifest that refers to them, which is
the commit: what a lost write leaves behind is never read. One writer at a time; of two that begin with the same version, one fails.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from candlewick.operators import vectors
from candlewick.session import written

_MANIFEST = "version long, dimension int, buckets int, schema string, bucket int, at long, n long"


def _fs(spark: SparkSession, path: str) -> tuple[object, object]:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest is whole."""
    fs, p = _fs(spark, f"{path}/manifest")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and fs.exists(_fs(spark, f"{path}/manifest/{n}/_SUCCESS")[1]))


class VectorStore:
    """Rows (record_id, embedding and any other columns) of vectors of one length; ids are unique."""

    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None, buckets: int = 64):
        """Opens the store at path; with a dimension, an empty one of so many buckets if there is none. A stored dimension must be the same."""
        self.spark, self.path = spark, path.rstrip("/")
        found = _versions(spark, self.path)
        if not found and dimension is None:
            raise ValueError(f"there is no vector store in {path}")
        self.version, self.dimension, self.buckets, self.schema, self.places = 0, dimension, buckets, None, {}
        if found:
            self._open(found[-1])
            if dimension is not None and dimension != self.dimension:
                raise ValueError(f"the stored vectors have {self.dimension} numbers, not {dimension}")

    def _open(self, version: int) -> None:
        rows = self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest/v{version}").collect()  # a row per bucket
        self.version, self.dimension, self.buckets = version, rows[0].dimension, rows[0].buckets
        self.schema = StructType.fromJson(json.loads(rows[0].schema)) if rows[0].schema else None
        self.places = {r.bucket: (r.at, r.n) for r in rows if r.bucket is not None}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("record_id").cast("string")), F.lit(self.buckets)).cast("int")

    def _checked(self, rows: DataFrame) -> DataFrame:
        """rows, written once; an error for vectors of another length, nulls in ids or vectors, and repeated ids."""
        rows = written(rows, "vector-rows")
        wrong, lacking, n, distinct = rows.agg(F.count_if(F.size("embedding") != self.dimension), F.count_if(F.col("record_id").isNull() | F.col("embedding").isNull()), F.count(F.lit(1)), F.count_distinct("record_id")).first()
        if wrong:
            raise ValueError(f"{wrong} vectors haven't {self.dimension} numbers")
        if lacking or n != distinct:
            raise ValueError(f"{lacking} rows lack an id or a vector; {n} rows have {distinct} ids")
        return rows

    def _commit(self, rows: DataFrame, kept: dict[int, tuple[int, int]]) -> None:
        """Writes rows as the new content of their buckets; buckets in `kept` stay."""
        version, schema = self.version + 1, rows.schema
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/rows/v{version}")
        places = {}
        if rows.limit(1).count():
            places = {r.bucket: (version, r.n) for r in self.spark.read.parquet(f"{self.path}/rows/v{version}").groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()}
        places = kept | places
        head = (version, self.dimension, self.buckets, schema.json())
        lines = [(*head, b, at, n) for b, (at, n) in sorted(places.items())] or [(*head, None, None, None)]
        self.spark.createDataFrame(lines, _MANIFEST).coalesce(1).write.json(f"{self.path}/manifest/v{version}")
        self._open(version)

    def upsert(self, rows: DataFrame) -> None:
        """Adds rows, in place of those with the same ids. Only buckets that get rows are read and written."""
        new = self._checked(rows)
        touched = [r.b for r in new.select(self._bucket().alias("b")).distinct().collect()]
        old = self._read([b for b in touched if b in self.places])
        if old is not None:
            new = old.join(new.select("record_id"), "record_id", "left_anti").select(*old.columns).unionByName(new, allowMissingColumns=True)
        self._commit(new, {b: p for b, p in self.places.items() if b not in touched})

    def overwrite(self, rows: DataFrame) -> None:
        """These rows alone."""
        self._commit(self._checked(rows), {})

    def delete(self, ids: DataFrame) -> None:
        """Without the rows that have an id of `ids` (record_id)."""
        touched = [r.b for r in ids.select(self._bucket().alias("b")).distinct().collect() if r.b in self.places]
        old = self._read(touched)
        if old is not None:
            self._commit(old.join(ids.select("record_id").distinct(), "record_id", "left_anti").select(*old.columns), {b: p for b, p in self.places.items() if b not in touched})

    def _read(self, buckets: list[int]) -> DataFrame | None:
        paths = [f"{self.path}/rows/v{self.places[b][0]}/bucket={b}" for b in sorted(buckets)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else None

    def rows(self, **equal: object) -> DataFrame:
        """The rows that meet all conditions; those that are None don't filter."""
        out = self._read(list(self.places))
        out = out if out is not None else self.spark.createDataFrame([], self.schema or "record_id string, embedding array<double>")
        return out.where(vectors.conditions(**equal))

    def count(self) -> int:
        """From the manifest."""
        return sum(n for _, n in self.places.values())

    def vacuum(self, keep: int = 2) -> int:
        """Removes buckets and manifests that the last `keep` versions don't refer to; how many folders of buckets went."""
        last, used, gone = _versions(self.spark, self.path)[-keep:], set(), 0
        for v in last:
            used |= {(r.at, r.bucket) for r in self.spark.read.schema(_MANIFEST).json(f"{self.path}/manifest/v{v}").collect()}
        fs, top = _fs(self.spark, f"{self.path}/rows")
        for version in fs.listStatus(top) if fs.exists(top) else []:
            v = int(version.getPath().getName()[1:])
            for bucket in fs.listStatus(version.getPath()):
                name = bucket.getPath().getName()
                if name.startswith("bucket=") and (v, int(name.removeprefix("bucket="))) not in used and v <= last[-1]:
                    gone += bool(fs.delete(bucket.getPath(), True))
        for v in _versions(self.spark, self.path)[:-keep]:
            fs.delete(_fs(self.spark, f"{self.path}/manifest/v{v}")[1], True)
        return gone


def centroids(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Directions that the vectors gather around: k-means by cosine; cells that end up empty are left out."""
    size = np.sqrt((sample * sample).sum(1))
    x = sample[size > 0] / size[size > 0][:, None]
    if not len(x):
        return np.zeros((1, sample.shape[1]))
    c = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        length = np.sqrt((sums * sums).sum(1))
        c = sums[length > 0] / length[length > 0][:, None]
    return c


def _few(batches: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of so few rows that a number for each row and cell takes a few MB."""
    rows = max(1, vectors.CELLS // 2 // max(1, cells))
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


class InvertedIndex:
    """Rows filed by the nearest of some centroids, in a table partitioned by that cell, so that a search reads the cells it probes.

    Centroids come from at most `sample` rows (those with the smallest hashes of their ids); every row is filed. Of each cell, the widest angle
    between its centroid and its rows is kept, from which an exact search knows the cells that can't hold a better row.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        cells = spark.read.parquet(f"{self.path}/cells").orderBy("cell").collect()  # as many as centroids, of which a sample bounds the number
        self.centroids = np.array([r.centroid for r in cells], float)
        self.widest = np.array([r.widest if r.widest is not None else -1.0 for r in cells])

    @staticmethod
    def build(rows: DataFrame, path: str, cells: int | None = None, sample: int = 20_000, vector: str = "embedding", rounds: int = 12) -> InvertedIndex:
        """Files rows (record_id, a vector, other columns) below path; by default the root of their number, a tenth of the sample at most."""
        spark = rows.sparkSession
        held = rows.where(F.col(vector).isNotNull())
        some = held.select("record_id", vector).orderBy(F.xxhash64("record_id"), "record_id").limit(sample).toArrow()
        length = len(some.column(vector)[0]) if some.num_rows else 1
        c = centroids(vectors.matrix_of(some.column(vector), length), max(1, min(cells or round(held.count() ** 0.5), max(1, some.num_rows // 10))), rounds)
        shared = spark.sparkContext.broadcast(c)

        def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _few(batches, len(shared.value)):
                x = vectors.matrix_of(pa.chunked_array([b.column(vector)]), length)
                near = x @ shared.value.T
                cell = np.argmax(near, 1)
                cosine = near[np.arange(len(x)), cell] / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(np.arccos(np.clip(cosine, -1, 1)))], names=[*b.schema.names, "cell", "angle"])

        schema = StructType([*held.schema.fields, StructField("cell", IntegerType()), StructField("angle", DoubleType())])
        # Cells of any size: small ones share a task, large ones are split.
        held.mapInArrow(filed, schema).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        widest = spark.read.schema(schema).parquet(f"{path}/rows").groupBy("cell").agg(F.max("angle").alias("widest"), F.count(F.lit(1)).alias("n"))
        middle = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(c)], "cell int, centroid array<double>")
        middle.join(widest, "cell", "left").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")
        return InvertedIndex(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _probed(self, asked: DataFrame, query: str, probes: int, least: str | None = None) -> DataFrame:
        """The first column of asked with a row per cell to look into: the `probes` nearest ones, or all others that may hold a similarity of
        the column `least`."""
        shared = self.spark.sparkContext.broadcast((self.centroids, self.widest))
        schema = StructType([asked.schema.fields[0], StructField("cell", IntegerType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, widest = shared.value
            for b in _few(batches, len(c)):
                x = vectors.matrix_of(pa.chunked_array([b.column(query)]), c.shape[1])
                near = np.clip(x @ c.T / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None], -1, 1)
                nearest = np.argsort(-near, 1, kind="stable")
                if least is None:
                    row, cell = np.repeat(np.arange(len(x)), min(probes, len(c))), nearest[:, :probes].ravel()
                else:
                    # The similarity of a row is at most the cosine of its angle to the centroid less the cell's widest angle.
                    most = np.cos(np.maximum(np.arccos(near) - widest[None, :], 0)) + 1e-9
                    reached = b.column(least).to_numpy(zero_copy_only=False)
                    seen = np.zeros_like(near, bool)
                    np.put_along_axis(seen, nearest[:, :probes], True, 1)
                    row, cell = np.nonzero((most >= reached[:, None]) & ~seen & (widest >= 0)[None, :])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(cell.astype(np.int32))], names=[b.schema.names[0], "cell"])

        return asked.mapInArrow(run, schema)

    def probes_for(self, recall: float = 0.95, k: int = 10, sample: int = 200, vector: str = "embedding") -> int:
        """The least number of cells with which a search finds so large a share of the k nearest rows, by an exact search for at most `sample`
        rows (those with the smallest hashes of their ids)."""
        some = self.rows().select(F.col("record_id").alias("query_id"), F.col(vector).alias("query")).orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
        some = written(some, "index-sample")
        found = self._best(some, k, 8, True, None, "query", vector, ("query_id", "record_id")).select("query_id", "cell").collect()  # sample x k rows
        if not found:
            return 1
        asked = some.toArrow()
        x = vectors.matrix_of(asked.column("query"), self.centroids.shape[1])
        place = np.argsort(np.argsort(-(x @ self.centroids.T), 1, kind="stable"), 1)
        row = {q: i for i, q in enumerate(asked.column("query_id").to_pylist())}
        needed = np.sort([place[row[r.query_id], r.cell] for r in found])
        return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1

    def search(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False, where: Column | None = None, query: str = "query", vector: str = "embedding", ids: tuple[str, str] = ("query_id", "record_id")) -> DataFrame:
        """For every query the k most similar rows of the `probes` nearest cells (as vectors.search_by_key gives them); rows that don't meet
        `where` don't count. exact: then also of all cells whose bound reaches the k-th similarity found, so none is missed.
        """
        return self._best(queries, k, probes, exact, where, query, vector, ids).drop("cell")

    def _best(self, queries: DataFrame, k: int, probes: int, exact: bool, where: Column | None, query: str, vector: str, ids: tuple[str, str]) -> DataFrame:
        q_id, r_id = ids
        asked = written(queries.select(q_id, F.expr(f"transform({query}, x -> CAST(x AS double))").alias("__q")).where("aggregate(__q, 0D, (s, x) -> s + x * x) > 0"), "index-queries")
        first = self._within(asked, self._probed(asked, "__q", probes), k, where, vector, ids)
        if not exact:
            return first
        first = written(first, "index-first")
        least = first.where(F.col("rank") == k).select(q_id, F.col("similarity").alias("__least"))
        more = self._probed(asked.join(least, q_id, "left").withColumn("__least", F.coalesce("__least", F.lit(-2.0))), "__q", probes, "__least")
        both = first.drop("rank").unionByName(self._within(asked, more, k, where, vector, ids).drop("rank"))
        best = vectors.W.partitionBy(q_id).orderBy(F.desc("similarity"), F.asc(r_id))  # 2 k rows a query
        return both.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def _within(self, asked: DataFrame, probed: DataFrame, k: int, where: Column | None, vector: str, ids: tuple[str, str]) -> DataFrame:
        probed = written(probed, "index-probes")  # ids and cells: a query's vector isn't repeated for its cells
        wanted = [r.cell for r in probed.select("cell").distinct().collect()]  # cells, not rows
        rows = self.rows().where(F.col("cell").isin(wanted)).drop("angle")
        rows = rows if where is None else rows.where(where)
        return vectors.search_by_key(asked, rows, ["cell"], k, "__q", vector, ids, asked=probed)
