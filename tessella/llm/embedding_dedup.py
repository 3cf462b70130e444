"""Embedding near-dedup: random-hyperplane sign hashing, exact cosine, distributed components.

1. Equal vectors become one class with a count of its members.
2. Each class has a key of ``bits`` hyperplane signs in every one of ``tables`` tables. Both follow from the
   number of classes by one rule at every size: 2 bits more than it takes to give each class a bucket of its own (16
   at least), and as many tables as a pair at exactly the threshold needs to meet with
   probability RECALL. Closer pairs meet more surely: 0.9996 at cosine 0.95 for 16 bits.
3. A row (bucket, class) of 16 bytes stands for each key; buckets of two or more classes are dealt into blocks of BLOCK
   classes, and pairs of blocks into lots of about LOT rows. Only there the vectors join them, in the precision they came in, and a lot's
   buckets are compared together, in matrix products in double precision. A pair is counted only in the first
   table where its keys agree, so link counts need no list of pairs; keys are worked out again from the planes, for linked
   vectors alone. Edges for the components are all links of a bucket of FEW classes at most, else a spanning forest. No bucket is capped.

Null and zero vectors and vectors with null or non-finite components link with nothing. A table may mix lengths; only
vectors of equal length are compared. Repeated rows are separate vectors of one class. Rows with a null
id are compared and counted; a component's id is its smallest non-null id. An empty table gives no rows.
Extra columns, the label among them, are ignored.

The work within a bucket grows with the square of its members, as the link counts that it yields do.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_IDS, removed, written
from .components import components
from .words import mix

COSINE, RECALL, BLOCK, LOT, FEW, SEED = 0.9, 0.92, 512, 20_000, 8, 11
#: Low bits of a bucket's number that hold its table; the others are a hash of the key.
TABLE = 12


def plan(classes: int, cosine: float = COSINE, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables)."""
    bits = max(16, min(60, math.ceil(math.log2(max(2, classes))) + 2))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def planes(dim: int, bits: int, tables: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).normal(size=(dim, bits * tables))


def keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables) of int64 keys."""
    signs = (x @ planes(x.shape[1], bits, tables) >= 0).reshape(len(x), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _vectors(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.abs(x).max(1, keepdims=True)


def buckets(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(vectors, tables) of bucket numbers."""
    t = np.arange(tables, dtype=np.uint64)
    h = mix(mix(keys(x, bits, tables).view(np.uint64) + np.uint64(x.shape[1])) + t)
    return ((h >> np.uint64(TABLE) << np.uint64(TABLE)) | t).view(np.int64)


def first_tables(x: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The first table where the keys of x[a] and x[b] agree; there is one."""
    used, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    key, out = np.concatenate([keys(x[used[i : i + 4096]], bits, tables) for i in range(0, len(used), 4096)]), []
    mine, other = at[: len(a)], at[len(a) :]
    for i in range(0, len(a), 65536):  # memory: 65536 pairs x tables at a time
        out.append((key[mine[i : i + 65536]] == key[other[i : i + 65536]]).argmax(1))
    return np.concatenate(out)


def forest(node: np.ndarray, link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links between the nodes at ``left`` and at ``right`` (the same ones, if equal)."""
    same = left is right
    u, v, seen = [], [], [np.zeros(len(left), dtype=bool), np.zeros(len(right), dtype=bool)]
    if same:
        seen[1] = seen[0]
    for i in np.flatnonzero(link.any(1)):
        if seen[0][i]:
            continue
        seen[0][i], todo = True, [(0, int(i))]
        while todo:
            s, k = todo.pop()
            new = np.flatnonzero((link[:, k] if s else link[k]) & ~seen[1 - s])
            seen[1 - s][new] = True
            u += [node[(right if s else left)[k]]] * len(new)
            v += node[(left if s else right)[new]].tolist()
            todo += [(0 if same else 1 - s, int(q)) for q in new]
    return u, v


def compared(node, x, weight, table, side, groups, bits, tables, cosine) -> tuple[np.ndarray, list[int], list[int]]:
    """Links within the runs of rows that begin at ``groups`` (the end last): counts for each row, and edges.

    ``side``: 0 where a run is one block, else 0 and 1 for its two blocks, which are compared with each other.
    """
    count = np.zeros(len(node), dtype=np.int64)
    size = np.diff(groups)
    u: list[int] = []
    v: list[int] = []

    def tally(a, b):
        """Counts the pairs (a, b) of rows, which met in table[a], if that is their first."""
        first = first_tables(x, a, b, bits, tables) == table[a]
        np.add.at(count, a[first], weight[b[first]])
        np.add.at(count, b[first], weight[a[first]])
        return first

    pair = np.add.reduceat(side, groups[:-1]) > 0 if len(size) else size
    for m in np.unique(size[(size <= FEW) & ~pair]).tolist() if len(size) else []:
        begin = groups[:-1][(size == m) & ~pair]
        for i in range(0, len(begin), 4096):
            at = begin[i : i + 4096, None] + np.arange(m)
            g, p, q = np.nonzero(np.triu(x[at] @ x[at].transpose(0, 2, 1) >= cosine, 1))
            if len(g):
                a, b = at[g, p], at[g, q]
                first = tally(a, b)
                u += node[a[first]].tolist()
                v += node[b[first]].tolist()
    for k in np.flatnonzero((size > FEW) | pair):
        rows = np.arange(groups[k], groups[k + 1])
        left = rows[side[rows] == 0]
        right = rows[side[rows] == 1] if pair[k] else left
        link = x[left] @ x[right].T >= cosine
        if not pair[k]:
            np.fill_diagonal(link, False)
        p, q = np.nonzero(link if pair[k] else np.triu(link, 1))
        if len(p):
            first = tally(left[p], right[q])
            link[p[~first], q[~first]] = False
            if not pair[k]:
                link[q[~first], p[~first]] = False
            more = forest(node, link, left, right)
            u += more[0]
            v += more[1]
    return count, u, v


def linked(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept."""
    v = F.col("v")
    good = v.isNotNull() & ~F.coalesce(F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda e: e != 0), F.lit(False))
    kind = vectors.schema[vector_col].dataType.elementType
    single = isinstance(kind, T.FloatType)  # carried as they came, compared in double precision
    zero = F.lit(0.0).cast("float" if single else "double")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col).cast("array<float>" if single else "array<double>"), lambda e: e + zero).alias("v"))
    rows = written(rows.select("vec_id", F.when(good, v).alias("v"), F.when(good, F.sha2(F.to_json(F.struct(v)), 256)).alias("mark")), "vectors")
    marks = rows.where("mark IS NOT NULL").groupBy("mark").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    marks = written(marks.withColumn("node", F.monotonically_increasing_id()), "marks")
    classes = marks.count()
    bits, tables = plan(classes, cosine, recall)
    # One vector of each class; equal vectors, so any will do.
    one = rows.where("mark IS NOT NULL").groupBy("mark").agg(F.first("v").alias("v"))

    def each_length(batches, column):
        for b in batches:
            dim = pa.compute.list_value_length(b.column(column)).to_numpy()
            for d in np.unique(dim):
                part = b.filter(pa.array(dim == d))
                yield part, int(d), _unit(_scaled(_vectors(part.column(column))))

    def packed(batches):
        for part, d, _ in each_length(batches, 2):
            raw = part.column(2).flatten().to_numpy().reshape(len(part), d)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([r.tobytes() for r in raw], pa.binary())], names=["node", "weight", "raw"])

    def keyed(batches):
        for part, _, x in each_length(batches, 1):
            cell = buckets(x, bits, tables)
            yield pa.RecordBatch.from_arrays([pa.array(cell.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), tables))], names=["cell", "node"])

    held = written(one.join(marks, "mark").select("node", "weight", "v"), "classes")
    cells = written(held.select("node", "v").mapInArrow(keyed, "cell bigint, node bigint"), "keys", 1000, packed=False)
    whole = held.mapInArrow(packed, "node bigint, weight bigint, raw binary")
    sizes = written(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("g")).where("g > 1").select("cell", F.ceil(F.col("g") / BLOCK).cast("int").alias("blocks")), "buckets", packed=False)
    # A bucket with the same members as one of an earlier table adds nothing, but telling so would cost more than comparing.
    dealt = cells.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS // 2 else sizes, "cell").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = written(dealt.select("cell", "node", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") > F.col("other")).cast("int").alias("side")), "cells", packed=False)
    lots = max(1, -(-dealt.count() // LOT))

    def block(t: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        raws = t.column("raw").combine_chunks()
        length = pa.compute.binary_length(raws).to_numpy()
        columns = {c: t.column(c).to_numpy() for c in ("node", "weight", "cell", "x", "y", "side")}
        for n in np.unique(length):
            own = np.flatnonzero(length == n)
            c = {k: col[own] for k, col in columns.items()}
            order = np.lexsort((c["node"], c["side"], c["y"], c["x"], c["cell"]))
            c = {k: col[order] for k, col in c.items()}
            raw = np.frombuffer(b"".join(raws.take(pa.array(own[order])).to_pylist()), dtype=np.float32 if single else np.float64).reshape(len(own), -1).astype(np.float64)
            new = np.flatnonzero(np.any([np.diff(c[k], prepend=c[k][0] - 1) != 0 for k in ("cell", "x", "y")], axis=0))
            side = np.where(c["x"] == c["y"], 0, c["side"])
            count, u, v = compared(c["node"], _unit(_scaled(raw)), c["weight"], c["cell"] & ((1 << TABLE) - 1), side, np.append(new, len(own)), bits, tables, cosine)
            some = np.flatnonzero(count)
            for column, a, b in zip(out, (c["node"][some], np.full(len(some), -1), count[some]), (u, v, np.zeros(len(u))), strict=True):
                column += [a, np.asarray(b, dtype=np.int64)]
        return pa.table({k: pa.array(np.concatenate([*col, np.zeros(0)]).astype(np.int64)) for k, col in zip(("node", "peer", "links"), out, strict=True)})

    full = dealt.join(whole, "node").withColumn("lot", F.pmod(F.xxhash64("cell", "x", "y"), F.lit(lots)))
    found = written(full.groupBy("lot").applyInArrow(block, "node bigint, peer bigint, links bigint"), "found")
    removed(held, cells, sizes, dealt)
    links = found.where("peer < 0").groupBy("node").agg(F.sum("links").alias("links"))
    group = components(found.where("peer >= 0").select(F.col("node").alias("u"), F.col("peer").alias("v")))
    joined = marks.join(links, "node", "left").join(group, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    table = joined.join(least, "component").select("mark", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "mark").join(table, "mark", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("mark").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op4(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
