"""Vector search: distances, batched nearest neighbours with metadata filters, hashed embeddings, BM25."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words

#: Query vectors up to which the queries go to every task (64 dimensions: 26 MB in doubles); more run in rounds of that size.
QUERIES_AT_ONCE = 50_000
#: Queries and corpus rows of one matrix product (a block of 10 MB in single precision).
QUERY_BLOCK, ROW_BLOCK = 256, 10_000
#: Share of a block's pairs up to which those that may be among the k best are worked out one by one, and numbers of vectors held for that.
SPARSE, PAIRED = 0.05, 1 << 21


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "l2", query_id: str = "query_id", query_vector: str = "query_vector", doc_id: str = "doc_id", vector: str = "embedding", match: tuple[str, str] | None = None, digits: int = 6) -> DataFrame:
    """The k nearest corpus rows of each query: query_id, doc_id, distance, rank. Ties go to the smaller id.

    The corpus stays where it is: each task compares its rows with the queries in blocks and keeps its own k best a query; only those are shuffled and ranked, from no more tasks
    than the cluster has cores. A matrix product in single precision rules out what can't be among the k best, with a margin for all of its rounding; distances of the rest are worked out in double
    precision. The queries are read when this is called, in blocks. Ids of rows are numbers or strings. Rows of one query id are one query with several vectors, whose best distance to a row counts; rows of one doc_id count as one. Only vectors of equal length are compared. ``match`` names a query column (an array of allowed values) and a
    corpus column to filter by. Distances are rounded to ``digits`` places before ranking.
    """
    spark = corpus.sparkSession
    cols = [F.col(query_id).cast("long").alias("q"), _double(F.col(query_vector)).alias("v")] + ([F.col(match[0]).cast("array<string>").alias("m")] if match else [])
    asked = queries.select(*cols).where("v IS NOT NULL")
    kind = "string" if corpus.schema[doc_id].dataType.simpleString() == "string" else "bigint"
    rows = corpus.select(F.col(doc_id).cast(kind).alias("d"), _double(F.col(vector)).alias("v"), (F.col(match[1]).cast("string") if match else F.lit(None).cast("string")).alias("m")).where("v IS NOT NULL")
    rows = rows.coalesce(spark.sparkContext.defaultParallelism)  # each task sends k rows of every query
    found = None
    for part in _blocks(asked):
        allowed = [frozenset(x or ()) for x in part.column(2).to_pylist()] if match else None
        shared = spark.sparkContext.broadcast((part.column(0).to_numpy(), _by_length(part.column(1)), allowed))
        best = rows.mapInArrow(_block_search(shared, k, metric, digits, kind), f"query_id bigint, doc_id {kind}, distance double")
        found = best if found is None else found.unionAll(best)
    found = found.repartition("query_id").groupBy("query_id", "doc_id").agg(F.min("distance").alias("distance"))  # one shuffle for both steps
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _blocks(asked: DataFrame) -> Iterator[pa.Table]:
    """The queries in blocks of about QUERIES_AT_ONCE, by a hash of their ids: nothing is sorted, and a second block is read only if there is one."""
    first = asked.limit(QUERIES_AT_ONCE + 1).toArrow()
    if len(first) <= QUERIES_AT_ONCE:
        yield first
        return
    blocks = -(-asked.count() // QUERIES_AT_ONCE)
    for b in range(blocks):
        yield asked.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toArrow()


def _by_length(vectors: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of the vectors of each length, their places and a matrix."""
    lists = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    at = {int(n): np.flatnonzero(size == n) for n in np.unique(size)}
    return {n: (own, lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(own), n)) for n, own in at.items()}


def _block_search(shared, k: int, metric: str, digits: int, id_type: str = "bigint"):
    """Beside the queries a task holds its k best of each query, a batch of rows and one block of products (QUERY_BLOCK x ROW_BLOCK)."""

    def run(batches: Iterator[pa.RecordBatch]):
        ids, raw, allowed = shared.value
        if not len(ids):
            return
        text = id_type == "string"
        sides = {n: _Side(x, metric, at) for n, (at, x) in raw.items()}
        for side in sides.values():  # queries that allow the same are compared with the same rows
            for place, q in enumerate(side.at):
                side.by_types.setdefault(allowed[q] if allowed else None, []).append(place)
        best_d, best_i = np.full((len(ids), k), np.inf), np.full((len(ids), k), "" if text else 0, dtype=object if text else np.int64)
        for b in batches:
            doc, kind = b.column(0).to_numpy(zero_copy_only=False), np.array(b.column(2).to_pylist(), dtype=object)
            for n, (own, x) in _by_length(b.column(1)).items():
                if n not in sides:
                    continue
                side, kinds, groups = sides[n], set(kind[own]), {}
                for types, places in side.by_types.items():
                    groups.setdefault(None if types is None else types & kinds, []).extend(places)
                for fit, places in groups.items():
                    rows = np.arange(len(own)) if fit is None else np.flatnonzero(np.array([t in fit for t in kind[own]], dtype=bool))
                    for r in range(0, len(rows), ROW_BLOCK):
                        some = rows[r : r + ROW_BLOCK]
                        part = _Side(x[some], metric, own[some])
                        for c in range(0, len(places), QUERY_BLOCK):
                            _compare(side.part(np.array(places[c : c + QUERY_BLOCK])), part, doc, best_d, best_i, k, metric, digits)
        ok = np.isfinite(best_d)
        for c in range(0, len(ids), ROW_BLOCK):
            some = ok[c : c + ROW_BLOCK]
            q = np.broadcast_to(ids[c : c + ROW_BLOCK, None], some.shape)[some]
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(best_i[c : c + ROW_BLOCK][some], pa.string() if text else pa.int64()), pa.array(best_d[c : c + ROW_BLOCK][some])], names=["query_id", "doc_id", "distance"])

    return run


class _Side:
    """Vectors (those with a distance to others), their places, squared norms, and what the product in single precision is made of."""

    def __init__(self, x: np.ndarray, metric: str, at: np.ndarray):
        with np.errstate(over="ignore", invalid="ignore"):
            square = np.einsum("ij,ij->i", x, x)
            ok = np.isfinite(square) if metric == "l2" else np.isfinite(x).all(1)
            if not ok.all():
                x, at, square = x[ok], at[ok], square[ok]
            size = np.sqrt(square)
            self.x, self.at, self.square, self.by_types = x, at, square, {}
            light = np.concatenate([x, square[:, None] / -2], 1) if metric == "l2" else np.divide(x, size[:, None], out=np.zeros_like(x), where=size[:, None] > 0)
            self.light = light.astype(np.float32)

    def part(self, places: np.ndarray) -> _Side:
        out = object.__new__(_Side)
        out.x, out.at, out.square, out.light, out.by_types = self.x[places], self.at[places], self.square[places], self.light[places], {}
        return out


#: Squared norms up to which single precision rules pairs out; with larger ones all distances are worked out.
LIGHT = 1e30


def _compare(asked: _Side, rows: _Side, doc: np.ndarray, best_d: np.ndarray, best_i: np.ndarray, k: int, metric: str, digits: int) -> None:
    """Takes what is among the k best of each query into best_d and best_i. Nearness s: q * x - x * x / 2, so that a squared distance is q * q - 2 * s; or the cosine."""
    if not len(asked.at) or not len(rows.at):
        return
    at, l2 = asked.at, metric == "l2"
    top = max(asked.square.max(), rows.square.max())
    if l2 and top > LIGHT:
        near = None
    else:
        mine = asked.light
        if l2:
            mine = mine.copy()
            mine[:, -1] = 1  # meets the half squares of the rows
        s = mine @ rows.light.T
        # Rounding of s: of both vectors, of their products and sums, of the half square.
        error = (asked.x.shape[1] + 4) * np.finfo(np.float32).eps * (np.sqrt(asked.square * rows.square.max()) + rows.square.max() / 2 if l2 else np.ones(len(at))) + 1e-30
        slack = 10.0**-digits
        last = best_d[at, -1]
        least = (asked.square - last - slack) / 2 - error if l2 else 1 - last - slack - error
        if not np.isfinite(last).all():
            groups = min(len(rows.at), max(4 * k, len(rows.at) // 16))
            if groups >= k:  # the kth of the largest of groups of rows is no nearer than the kth of all
                wide = len(rows.at) // groups
                most = s[:, : groups * wide].reshape(len(at), wide, groups).max(1)
                kth = np.partition(most, groups - k, axis=1)[:, groups - k].astype(np.float64)
                least = np.maximum(least, kth - slack - 2 * error)
        near = np.flatnonzero(s >= np.nextafter(least.astype(np.float32), np.float32(-np.inf))[:, None])
    if near is None or len(near) > SPARSE * len(at) * len(rows.at):
        d = np.round(_distances(asked.x, rows.x, metric), digits) + 0.0
        best_d[at], best_i[at] = _smallest(best_d[at], best_i[at], d, doc[rows.at], k)
        return
    row, col = near // len(rows.at), near % len(rows.at)
    step, dots = max(1, PAIRED // max(1, asked.x.shape[1])), np.empty(len(near))
    for i in range(0, len(near), step):
        dots[i : i + step] = np.einsum("ij,ij->i", asked.x[row[i : i + step]], rows.x[col[i : i + step]])
    d = np.round(_distance(dots, asked.square[row], rows.square[col], metric), digits) + 0.0
    better = d <= best_d[at[row], -1]
    if better.any():
        some, new_d, new_i = _merged(best_d[at], best_i[at], row[better], d[better], doc[rows.at[col[better]]], k)
        best_d[at[some]], best_i[at[some]] = new_d, new_i


def _merged(best_d: np.ndarray, best_i: np.ndarray, row: np.ndarray, d: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows that get new distances (row, d, doc), and their k smallest of old and new, ties to the smaller id."""
    some = np.unique(row)
    at, d, i = np.concatenate([row, np.repeat(some, k)]), np.concatenate([d, best_d[some].ravel()]), np.concatenate([doc, best_i[some].ravel()])
    order = np.lexsort((pc.rank(pa.array(i, pa.string()), tiebreaker="dense").to_numpy() if i.dtype == object else i, d, at))
    count = np.bincount(at)[some]
    first = np.cumsum(count) - count
    kept = order[(first[:, None] + np.arange(k)).ravel()]
    return some, d[kept].reshape(-1, k), i[kept].reshape(-1, k)


def _smallest(best_d: np.ndarray, best_i: np.ndarray, d: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest of each row's best and new distances, ties to the smaller id: a partition by distance leaves few to sort."""
    i = np.broadcast_to(doc, d.shape)
    if d.shape[1] > 2 * k:
        last = np.partition(d, k - 1, axis=1)[:, k - 1]
        many = (d <= last[:, None]).sum(1).max()
        near = np.argpartition(d, min(many, d.shape[1]) - 1, axis=1)[:, :many]  # all ties of the kth are among them
        d, i = np.take_along_axis(d, near, 1), np.take_along_axis(i, near, 1)
    d, i = np.concatenate([best_d, d], 1), np.concatenate([best_i, i], 1)
    order = np.lexsort((i, d), axis=1)[:, :k]
    return np.take_along_axis(d, order, 1), np.take_along_axis(i, order, 1)


def _distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    return _distance(a @ b.T, (a * a).sum(1)[:, None], (b * b).sum(1)[None, :], metric)


def _distance(dots: np.ndarray, na: np.ndarray, nb: np.ndarray, metric: str) -> np.ndarray:
    """From products and squared norms."""
    if metric == "l2":
        return np.maximum(na + nb - 2 * dots, 0)
    n = np.sqrt(na) * np.sqrt(nb)
    return 1 - np.divide(dots, n, out=np.zeros_like(dots), where=n > 0)


def scan_by_metadata(corpus: DataFrame, filters: dict, limit: int = 50, order: str = "doc_id") -> DataFrame:
    """Rows that fit the filters (a value, or a list of allowed ones), the first by ``order``; the filter reaches the scan."""
    return filtered(corpus, filters).orderBy(order).limit(limit)


def filtered(df: DataFrame, filters: dict | None) -> DataFrame:
    for c, v in (filters or {}).items():
        allowed = v.get("$in") if isinstance(v, dict) else v
        df = df.where(F.col(c).isin(*allowed) if isinstance(allowed, (list, tuple)) else F.col(c) == F.lit(allowed))
    return df


def hashed_embedding(text: Column, dim: int = 64, limit: int = 8000) -> Column:
    """The offline embedding: signed feature hashing of lower-cased words, scaled to unit length (zero for no words).

    Words are cut and hashed natively; Arrow batches of their slots and signs are counted without a loop. The same hashes and
    values as ``embed_words``, which is native throughout and takes whole texts.
    """
    slot = F.transform(words(F.lower(F.substring(text, 1, limit))), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)) * 2 + F.pmod(F.xxhash64(F.concat(w, F.lit("#"))), F.lit(2)))

    @F.arrow_udf("array<double>")
    def run(slots: pa.Array) -> pa.Array:
        lists = slots.fill_null([])
        code, row = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
        x = np.bincount(row * dim + code // 2, 1.0 - 2.0 * (code % 2), minlength=len(lists) * dim).astype(np.float64).reshape(len(lists), dim)  # counts of a batch without words are integers
        n = np.sqrt((x * x).sum(1, keepdims=True))
        x = np.divide(x, n, out=np.zeros_like(x), where=n > 0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dim), pa.array(x.ravel()))

    return run(slot)


def embed(df: DataFrame, text_col: str, model=None, dim: int = 64, limit: int = 8000, out: str = "embedding") -> DataFrame:
    """Adds an embedding. ``model`` maps a list of texts to vectors and is called on Arrow batches, once loaded in each worker; without one, features are hashed."""
    if model is None:
        return df.withColumn(out, hashed_embedding(F.col(text_col), dim, limit))

    @F.pandas_udf("array<float>")
    def run(parts: pd.Series) -> pd.Series:
        return pd.Series([list(map(float, v)) for v in model([str(t or "empty")[:limit] for t in parts])])

    return df.withColumn(out, run(F.col(text_col)))


def embed_words(df: DataFrame, keys: list[str], text_col: str, dim: int = 64) -> DataFrame:
    """The same hashed embedding for long texts, in proportion to their words: explode, sum by slot, gather."""
    tokens = df.select(*keys, F.explode(words(F.lower(F.col(text_col)))).alias("t"))
    slots = tokens.groupBy(*keys, F.pmod(F.xxhash64("t"), F.lit(dim)).alias("j")).agg(F.sum(F.when(F.pmod(F.xxhash64(F.concat("t", F.lit("#"))), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("x"))
    rows = slots.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("j", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("s"))
    return rows.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.when(F.col("s") > 0, F.coalesce(F.try_element_at("m", j.cast("long")), F.lit(0.0)) / F.col("s")).otherwise(0.0)).alias("embedding"))


def bm25(queries: DataFrame, docs: DataFrame, k: int, query_id: str = "query_id", terms: str = "terms", doc_id: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
    """Lexical search: query_id, doc_id, score, rank. Only the queries' terms leave the scan; counts combine on the map side."""
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(F.col(terms))).alias("term"))
    counted = docs.select(F.col(doc_id).alias("doc_id"), F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)).alias("w"))
    size = docs.select(F.size(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))).alias("n")).agg(F.count(F.lit(1)).alias("docs"), F.avg("n").alias("mean"))
    tf = counted.select("doc_id", F.size("w").alias("n"), F.explode("w").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("doc_id", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = tf.join(df, "term").join(asked, "term").withColumns({"docs": size.select("docs").scalar(), "mean": size.select("mean").scalar()})
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
    scored = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), digits).alias("score"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where(F.col("rank") <= k)
