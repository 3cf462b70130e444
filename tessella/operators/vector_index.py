"""An index of vectors by cells: distributed k-means, a table partitioned by cell, searches that read a part of it.

* ``build`` learns cell centres on a bounded sample (SAMPLE rows at most, chosen by a hash of the id) and writes every row
  under its nearest centre, as a Parquet table partitioned by ``cell``. Rows are dealt by ranges of (cell, id), so that a cell with a third of all rows is
  written and read by several tasks.
* ``add`` gives new rows to the same centres and appends them; nothing that is there is touched.
* ``search`` compares each query with the rows of its nearest cells. Cells that no query asks for are pruned from the scan.
* ``search_exact`` gives the rows of ``vector.nearest`` exactly: a first search bounds each query's kth distance, then the cells go whose
  centre is too far away for their radius; the rest is read. It needs the l2 metric.

Centres, at most MAX_CELLS, are broadcast; queries are broadcast in blocks of at most about QUERIES_AT_ONCE. Null vectors and vectors of another length than the centres' are left out.
A second row of one id is a row of its own; in a search the nearer one counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vector import QUERIES_AT_ONCE, _smallest

SAMPLE, MAX_CELLS, ROUNDS, ROW_BLOCK = 1_000_000, 4096, 12, 2048
#: Relative slack on bounds that are worked out in floating point.
SLACK = 1e-6


def _matrix(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows with dims components, all of them there, and their vectors."""
    length = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(length == dims)
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dims)
    good = np.isfinite(x).all(1)
    return at[good], x[good]


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def _round(sample: DataFrame, centers: np.ndarray) -> np.ndarray:
    """One round of k-means: sums and counts of each task's rows, added up; empty cells keep their centre."""
    shared, dims = sample.sparkSession.sparkContext.broadcast(centers), centers.shape[1]

    def run(batches: Iterator[pa.RecordBatch]):
        total, count = np.zeros_like(shared.value), np.zeros(len(shared.value), dtype=np.int64)
        for b in batches:
            _, x = _matrix(b.column(0), dims)
            for i in range(0, len(x), ROW_BLOCK):
                part = x[i : i + ROW_BLOCK]
                near = _squared(part, shared.value).argmin(1)
                np.add.at(total, near, part)
                count += np.bincount(near, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), pa.list_(pa.float64()))], names=["cell", "n", "s"])

    parts = sample.select("v").mapInArrow(run, "cell int, n bigint, s array<double>")
    sums = parts.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i]) for i in range(dims)])
    new = centers.copy()
    for r in sums.collect():  # a row for each cell
        new[r[0]] = np.array(r[2:]) / r[1]
    return new


def learn(rows: DataFrame, cells: int | None = None, rounds: int = ROUNDS, vector: str = "embedding", doc_id: str = "doc_id") -> np.ndarray:
    """Centres, learnt on at most about SAMPLE rows; as many as the root of the rows' number where ``cells`` isn't given."""
    v = rows.select(F.col(doc_id).alias("d"), F.col(vector).cast("array<double>").alias("v")).where("v IS NOT NULL AND size(v) > 0")
    n = v.count()
    if not n:
        return np.zeros((0, 0))
    sample = v.where(F.pmod(F.xxhash64("d"), F.lit(-(-n // SAMPLE))) == 0).persist()
    cells = min(cells or math.isqrt(n), MAX_CELLS)
    dims = sample.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()[0]
    # Different vectors in the order of a hash are a random choice that doesn't depend on the partitioning.
    first = sample.where(F.size("v") == dims).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(max(1, cells)).collect()
    centers = np.array([r[0] for r in first], dtype=np.float64)
    for _ in range(rounds):
        before, centers = centers, _round(sample, centers)
        if np.allclose(before, centers):
            break
    sample.unpersist()
    return centers


def _assigned(rows: DataFrame, centers: np.ndarray, vector: str) -> DataFrame:
    """rows with cell and the distance to its centre; rows that can't be compared are left out."""
    shared, dims, place = rows.sparkSession.sparkContext.broadcast(centers), centers.shape[1], rows.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for i in range(0, b.num_rows, ROW_BLOCK):
                part = b.slice(i, ROW_BLOCK)
                at, x = _matrix(part.column(place), dims)
                d = _squared(x, shared.value)
                near = d.argmin(1)
                own = part.take(pa.array(at))
                # Of differences, not of products: radii are held against exact bounds.
                far = np.sqrt(((x - shared.value[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(near.astype(np.int32)), pa.array(far)], names=[*own.schema.names, "cell", "cell_distance"])

    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("cell_distance", T.DoubleType())])
    return rows.mapInArrow(run, schema)


class VectorIndex:
    """An index under a path. Columns named cell or cell_distance can't be indexed."""

    def __init__(self, spark: SparkSession, path: str, doc_id: str = "doc_id", vector: str = "embedding"):
        self.spark, self.path, self.doc_id, self.vector = spark, path, doc_id, vector
        self.centers = np.array([r[0] for r in spark.read.parquet(f"{path}/centers").orderBy("cell").select("v").collect()], dtype=np.float64)

    @classmethod
    def build(cls, rows: DataFrame, path: str, cells: int | None = None, doc_id: str = "doc_id", vector: str = "embedding", rounds: int = ROUNDS) -> VectorIndex:
        spark, centers = rows.sparkSession, learn(rows, cells, rounds, vector, doc_id)
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cell int, v array<double>").write.mode("overwrite").parquet(f"{path}/centers")
        index = cls(spark, path, doc_id, vector)
        index._write(rows, "overwrite")
        return index

    def _write(self, rows: DataFrame, mode: str) -> None:
        if not self.centers.size:
            rows.limit(0).withColumns({"cell": F.lit(0), "cell_distance": F.lit(0.0)}).write.mode(mode).parquet(f"{self.path}/rows")
            return
        placed = _assigned(rows, self.centers, self.vector)
        placed.repartitionByRange("cell", self.doc_id).write.mode(mode).partitionBy("cell").parquet(f"{self.path}/rows")

    def add(self, rows: DataFrame) -> None:
        self._write(rows, "append")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def sizes(self) -> DataFrame:
        """cell, n, radius (the largest distance to the centre): a row for each cell that has rows."""
        return self.rows().groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("cell_distance").alias("radius"))

    def _blocks(self, queries: DataFrame, query_id: str, query_vector: str) -> Iterator[pd.DataFrame]:
        """The queries that can be compared, in blocks by a hash of their ids."""
        asked = queries.select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v")).where(F.size("v") == self.centers.shape[1]) if self.centers.size else None
        blocks = -(-asked.count() // QUERIES_AT_ONCE) if asked is not None else 0
        for b in range(blocks):
            part = asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toPandas() if blocks > 1 else asked.toPandas()
            if len(part):
                yield part

    def _compare(self, part: pd.DataFrame, probes: np.ndarray, k: int, digits: int, metric: str = "l2") -> DataFrame:
        """query_id, doc_id, distance: each task's k best of each query, among the cells that ``probes`` (queries x cells) marks."""
        cells = np.flatnonzero(probes.any(0))
        ids, x, dims = part["q"].to_numpy(dtype=np.int64), np.array(part["v"].tolist(), dtype=np.float64), self.centers.shape[1]
        shared = self.spark.sparkContext.broadcast((ids, x, {int(c): np.flatnonzero(probes[:, c]) for c in cells}))
        kind = self.rows().schema[self.doc_id].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]):
            ids, queries, of_cell = shared.value
            best: dict = {}
            for b in batches:
                at, x = _matrix(b.column(1), dims)
                doc, cell = np.array(b.column(0).to_pylist(), dtype=object if kind == "string" else np.int64)[at], b.column(2).to_numpy()[at]
                for c in np.unique(cell):
                    asked, own = of_cell[int(c)], np.flatnonzero(cell == c)
                    for i in range(0, len(own), ROW_BLOCK):
                        rows = own[i : i + ROW_BLOCK]
                        for j in range(0, len(asked), 1024):
                            some = asked[j : j + 1024]
                            d = _squared(queries[some], x[rows])
                            if metric == "cosine":
                                n = np.sqrt((queries[some] ** 2).sum(1))[:, None] * np.sqrt((x[rows] ** 2).sum(1))[None, :]
                                d = 1 - np.divide(queries[some] @ x[rows].T, n, out=np.zeros_like(n), where=n > 0)
                            got_d, got_i = _smallest(np.full((len(some), 0), 0.0), np.empty((len(some), 0), dtype=doc.dtype), np.round(d, digits) + 0.0, doc[rows], k)
                            for q, dd, ii in zip(some, got_d, got_i, strict=True):
                                old = best.get(q)
                                best[q] = (dd, ii) if old is None else _merged(old, (dd, ii), k)
            for q, (dd, ii) in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(dd), ids[q])), pa.array(ii.tolist(), pa.string() if kind == "string" else pa.int64()), pa.array(dd)], names=["query_id", "doc_id", "distance"])

        scan = self.rows().where(F.col("cell").isin([int(c) for c in cells])).select(self.doc_id, F.col(self.vector).cast("array<double>"), "cell")
        return scan.mapInArrow(run, f"query_id bigint, doc_id {'string' if kind == 'string' else 'bigint'}, distance double")

    def _ranked(self, found: list[DataFrame], k: int) -> DataFrame:
        if not found:
            kind = self.rows().schema[self.doc_id].dataType.simpleString()
            return self.spark.createDataFrame([], f"query_id bigint, doc_id {kind}, distance double, rank int")
        every = found[0]
        for f in found[1:]:
            every = every.unionAll(f)
        every = every.repartition("query_id").groupBy("query_id", "doc_id").agg(F.min("distance").alias("distance"))
        return every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "doc_id"))).where(F.col("rank") <= k)

    def _near(self, x: np.ndarray, n: int) -> np.ndarray:
        """Marks each query's n nearest cells, ties to the lower number."""
        d = _squared(x, self.centers)
        marks = np.zeros(d.shape, dtype=bool)
        np.put_along_axis(marks, np.argsort(d, axis=1, kind="stable")[:, :n], True, axis=1)
        return marks

    def search(self, queries: DataFrame, k: int, probes: int = 8, query_id: str = "query_id", query_vector: str = "query_vector", digits: int = 6, metric: str = "l2") -> DataFrame:
        """query_id, doc_id, distance (squared, or 1 less the cosine), rank: the k nearest rows of each query's ``probes`` nearest cells."""
        parts = self._blocks(queries, query_id, query_vector)
        return self._ranked([self._compare(p, self._near(np.array(p["v"].tolist()), probes), k, digits, metric) for p in parts], k)

    def search_exact(self, queries: DataFrame, k: int, probes: int = 4, query_id: str = "query_id", query_vector: str = "query_vector", digits: int = 6) -> DataFrame:
        """The k nearest rows of all, by squared distance; cells are read only where their bound allows a hit."""
        size = self.sizes().toPandas()  # a row for each cell
        radius, there = np.full(len(self.centers), -np.inf), np.zeros(len(self.centers), dtype=np.int64)
        radius[size["cell"]], there[size["cell"]] = size["radius"], size["n"]
        found = []
        for part in self._blocks(queries, query_id, query_vector):
            x = np.array(part["v"].tolist(), dtype=np.float64)
            first = self._ranked([self._compare(part, self._near(x, probes), k, digits)], k)
            # A query's bound is known when k different ids were found.
            seen = first.groupBy("query_id").agg(F.max("distance").alias("d"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).toPandas()
            bound = dict(zip(seen["query_id"], seen["d"], strict=True))
            most = np.sqrt(np.array([bound.get(q, np.inf) for q in part["q"]]) + 10.0**-digits)
            away = np.sqrt(_squared(x, self.centers))
            room = most[:, None] + radius[None, :]
            wanted = (away <= room + SLACK * (1 + away)) & (there > 0)[None, :]
            found.append(self._compare(part, wanted, k, digits))
        return self._ranked(found, k)

    def share_read(self, queries: DataFrame, probes: int, query_id: str = "query_id", query_vector: str = "query_vector") -> float:
        """The mean share of all rows that a query is compared with."""
        n = self.sizes().toPandas()
        there = np.zeros(len(self.centers))
        there[n["cell"]] = n["n"]
        parts = [(self._near(np.array(p["v"].tolist()), probes) @ there).tolist() for p in self._blocks(queries, query_id, query_vector)]
        return float(np.mean([y for p in parts for y in p]) / max(1.0, there.sum())) if parts else 0.0


def _merged(a: tuple, b: tuple, k: int) -> tuple:
    d, i = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.lexsort((i, d))[:k]
    return d[order], i[order]
