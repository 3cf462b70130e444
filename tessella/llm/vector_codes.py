"""Vector code compression: product codes trained by filtering Lloyd over kd-trees.

Vectors are cut into PARTS consecutive parts; each part position has a codebook of up to ENTRIES entries. Components are integers,
floor(SCALE * x), so that sums, distances and codes are exact whatever the partitioning.

1. Every partition builds kd-trees over its vectors' parts, in blocks of BLOCK vectors, once. A node has its bounding box, the
   sum and the count of its points. The trees are written to the shared folder, and read by every round.
2. A round sends the codebooks (PARTS * ENTRIES entries) to all partitions. A tree is walked level by level with the entries
   that can still be nearest to some point of a node: an entry goes when another one is nearer everywhere in the box.
   A node with one entry left gives that entry its whole sum and count; only leaves with several compare points.
3. A partition sends one row an entry and part; their sums are combined and make the next codebooks, at most PARTS * ENTRIES rows.

Ties go to the lower index, exactly: an entry of a higher index also goes when it is nowhere nearer. Entries without points stay.

Null vectors, those with null or non-finite components, empty ones, and vectors whose length isn't that of the smallest id's are
dropped. Fewer vectors than ENTRIES give as many entries. Repeated rows count as often as they occur; equal ids are ordered by their vectors, null ids last. Components
beyond a bound at which squared distances would leave 64 bits (46,340 for 64 dimensions) count as that bound. An empty table gives
no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors and points of a tree and of a leaf; trees in one Arrow batch (1 MB each at 64 dimensions).
BLOCK, LEAF, TREES = 2048, 32, 8


def bound(dims: int) -> int:
    """The largest magnitude of a component with which all sums of products here stay below 2**62."""
    return math.isqrt(2**62 // (32 * max(dims, 1)))


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), exact in doubles, within the bound."""
    most = bound(x.shape[1])
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * x), -most, most)


def cuts(dims: int) -> list[tuple[int, int]]:
    return [(p * dims // PARTS, (p + 1) * dims // PARTS) for p in range(PARTS)]


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def build(x: np.ndarray) -> dict:
    """A balanced kd-tree over the rows of x: boxes, sums and counts of its nodes in heap order, points in the leaves' order.

    All nodes of a level have the same size; the last row is repeated with weight zero to fill them.
    """
    n, d = x.shape
    levels = max(0, math.ceil(math.log2(max(n, 1) / LEAF))) if d else 0
    size = max(1, -(-n // 2**levels)) * 2**levels
    full = np.concatenate([x, np.repeat(x[-1:], size - n, axis=0)])
    order = np.arange(size)[None, :]
    for _ in range(levels):
        points = full[order]
        axis = (points.max(1) - points.min(1)).argmax(1)
        by = np.take_along_axis(points, axis[:, None, None], 2)[:, :, 0].argsort(1, kind="stable")
        order = np.take_along_axis(order, by, 1).reshape(2 * len(order), -1)
    order = order.ravel()
    points, real = full[order], order < n
    nodes: list[list] = [[], [], [], []]
    for level in range(levels + 1):
        p, w = points.reshape(2**level, size >> level, d), real.reshape(2**level, size >> level)
        for out, v in zip(nodes, (p.min(1), p.max(1), (p * w[:, :, None]).sum(1), w.sum(1)), strict=True):
            out.append(v)
    lo, hi, total, count = (np.concatenate(v) for v in nodes)
    return {"levels": levels, "n": n, "order": order.astype(np.int32), "points": _narrow(points), "lo": _narrow(lo), "hi": _narrow(hi), "sum": total.astype(np.int64), "count": count.astype(np.int64)}


def walk(tree: dict, book: np.ndarray, codes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Sums and counts of the points nearest to each entry, and, if asked for, every row's entry."""
    k, d = book.shape
    most = max(float(np.abs(book).max(initial=0)), float(np.abs(tree["points"]).max(initial=0)))
    kind = np.float64 if 32 * max(d, 1) * most * most < 2**53 else np.int64  # either is exact; matrix products of doubles are faster
    book = book.astype(kind)
    points = tree["points"].astype(kind)
    real = tree["order"] < tree["n"]
    norms, far = (book * book).sum(1), np.finfo(np.float64).max if kind is np.float64 else np.iinfo(np.int64).max
    total, count = np.zeros((k, d), dtype=np.int64), np.zeros(k, dtype=np.int64)
    chosen = np.zeros(len(points), dtype=np.int64) if codes else None
    numbers = np.arange(k)
    node, can = np.zeros(1, dtype=np.int64), np.ones((1, k), dtype=bool)
    for level in range(tree["levels"] + 1):
        at, span = node + 2**level - 1, len(points) >> level
        lo, hi = tree["lo"][at].astype(kind), tree["hi"][at].astype(kind)
        near = (lo + hi) @ book.T
        best = np.where(can, norms - near, far).argmin(1)  # |2z - (lo + hi)|**2 less what is the same for all, over 4
        apart = np.abs(book[None, :, :] - book[best][:, None, :])
        # How much nearer than the best one an entry is, at the corner of the box where that is most.
        gain = norms[best][:, None] - norms + near - near[np.arange(len(at)), best][:, None] + np.einsum("md,mkd->mk", hi - lo, apart)
        can &= (gain > 0) | ((gain == 0) & (numbers <= best[:, None]))
        one = can.sum(1) == 1
        np.add.at(total, best[one], tree["sum"][at[one]])
        np.add.at(count, best[one], tree["count"][at[one]])
        if codes:
            for i, e in zip(node[one], best[one], strict=True):
                chosen[i * span : (i + 1) * span] = e
        node, can = node[~one], can[~one]
        if not len(node):
            break
        if level < tree["levels"]:
            node, can = np.stack([2 * node, 2 * node + 1], 1).ravel(), np.repeat(can, 2, axis=0)
            continue
        rows = (node[:, None] * span + np.arange(span)).ravel()
        mine = np.where(np.repeat(can, span, axis=0), norms - 2 * (points[rows] @ book.T), far).argmin(1)
        if codes:
            chosen[rows] = mine
        w = real[rows]
        np.add.at(total, mine[w], tree["points"][rows[w]].astype(np.int64))
        count += np.bincount(mine[w], minlength=k)
    if not codes:
        return total, count, None
    out = np.zeros(tree["n"], dtype=np.int64)
    out[tree["order"][real]] = chosen[real]
    return total, count, out


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> tuple[DataFrame, int]:
    """vec_id, v (doubles), label of usable vectors, and their length."""
    v = F.col("v")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), F.col(f"`{label_col}`").alias("label"))
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select(F.size("v")).first()
    return rows.where(F.size("v") == (first[0] if first else 0)), first[0] if first else 0


def trees(rows: DataFrame, dims: int) -> DataFrame:
    """A row for each block of a partition: vec_id and label (lists) and one tree for each part, written to the shared folder."""
    kinds = rows.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                some = b.slice(at, BLOCK)
                x = integers(some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, dims))
                made = [pickle.dumps(build(x[:, i:j])) for i, j in cuts(dims)]
                ends = pa.array([0, some.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, some.column(0)), pa.ListArray.from_arrays(ends, some.column(2)), pa.array([made], pa.list_(pa.binary()))], names=["vec_id", "label", "trees"])

    return written(rows.mapInArrow(run, f"vec_id array<bigint>, label array<{kinds}>, trees array<binary>"), "trees", packed=False)


def _round(planted: DataFrame, books: list[np.ndarray], name: str) -> list[np.ndarray]:
    """The codebooks after one round."""
    width = max(b.shape[1] for b in books)
    shared = planted.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]):
        books = shared.value
        got = [[np.zeros(b.shape, dtype=np.int64), np.zeros(len(b), dtype=np.int64)] for b in books]
        for b in batches:
            for made in b.column(0):
                for own, book, raw in zip(got, books, made.as_py(), strict=True):
                    total, count, _ = walk(pickle.loads(raw), book)
                    own[0] += total
                    own[1] += count
        for p, (total, count) in enumerate(got):
            used = np.flatnonzero(count)
            sums = [pa.array(total[used, i] if i < total.shape[1] else np.zeros(len(used), dtype=np.int64)) for i in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), p, dtype=np.int32)), pa.array(used.astype(np.int32)), pa.array(count[used]), *sums], names=["part", "entry", "n", *[f"s{i}" for i in range(width)]])

    schema = ", ".join(["part int", "entry int", "n bigint", *[f"s{i} bigint" for i in range(width)]])
    sums = written(planted.select("trees").mapInArrow(run, schema), name, TREES)
    new = [b.copy() for b in books]
    for r in sums.groupBy("part", "entry").agg(F.sum("n"), *[F.sum(f"s{i}") for i in range(width)]).collect():  # at most PARTS * ENTRIES rows
        new[r[0]][r[1]] = [s // r[2] for s in r[3 : 3 + books[r[0]].shape[1]]]
    return new


def train(rows: DataFrame, planted: DataFrame, dims: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One codebook for each part, from the vectors of the smallest ids."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    x = integers(np.array([r["v"] for r in first], dtype=np.float64).reshape(len(first), dims)).astype(np.int64)
    books = [x[:, i:j].copy() for i, j in cuts(dims)]
    for n in range(rounds):
        books = _round(planted, books, f"sums_{n}")
    return books


def encode(planted: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distances, summed over parts)."""
    shared = planted.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for ids, labels, made in zip(*b.columns, strict=True):
                error, digits = 0, []
                for book, raw in zip(shared.value, made.as_py(), strict=True):
                    tree = pickle.loads(raw)
                    codes = walk(tree, book, codes=True)[2]
                    points = np.empty((tree["n"], book.shape[1]), dtype=np.int64)
                    real = tree["order"] < tree["n"]
                    points[tree["order"][real]] = tree["points"][real]
                    error = error + ((points - book[codes]) ** 2).sum(1)
                    digits.append(codes)
                text = [bytes(c).hex() for c in np.stack(digits, 1).astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, pa.array(text), pa.array(error)], names=["vec_id", "label", "code", "error"])

    kind = planted.schema["label"].dataType.elementType.simpleString()
    return written(planted.mapInArrow(run, f"vec_id bigint, label {kind}, code string, error bigint"), "codes", TREES)


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def compressed(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code, error, label_error of all usable vectors, and the codebooks."""
    rows, dims = _kept(vectors, id_col, vector_col, label_col)
    planted = trees(rows, dims)
    books = train(rows, planted, dims, entries, rounds)
    codes = encode(planted, books)
    sums = written(codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label_errors")
    side = F.broadcast(sums) if sums.count() <= BROADCAST_IDS // 4 else sums
    return codes.join(side, codes["label"].eqNullSafe(F.col("of"))).drop("of"), books


def op11(spark, sf_dir: str) -> DataFrame:
    out, books = compressed(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _sql() -> str:
    kept = "SELECT vec_id, label, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0"
    steps = [f"k AS ({kept})", "p AS (SELECT r, i AS part, v[i * len(v) // 4 + 1:(i + 1) * len(v) // 4] AS v FROM k, range(4) t(i))",
             "b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, p.v FROM p JOIN (SELECT r, vec_id FROM k ORDER BY vec_id LIMIT 256) f USING (r))"]
    for n in range(ROUNDS + 1):
        near = f"SELECT r, p.part, min({{'s': list_dot_product(b.v, b.v) - 2 * list_dot_product(p.v, b.v), 'e': e}}).e AS e FROM p JOIN b{n} b ON p.part = b.part GROUP BY r, p.part"
        steps.append(f"a{n} AS MATERIALIZED ({near})")
        if n < ROUNDS:
            mean = f"SELECT a.part, a.e, i, floor(sum(p.v[i]) / count(*)) AS x FROM a{n} a JOIN p ON a.r = p.r AND a.part = p.part, range(1, (SELECT max(len(v)) + 1 FROM p)) t(i) WHERE i <= len(p.v) GROUP BY a.part, a.e, i"
            steps.append(f"c{n} AS (SELECT part, e, list(x ORDER BY i) AS v FROM ({mean}) GROUP BY part, e)")
            steps.append(f"b{n + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(c.v, b.v) AS v FROM b{n} b LEFT JOIN c{n} c ON b.part = c.part AND b.e = c.e)")
    steps.append(f"o AS (SELECT a.r, string_agg(lower(printf('%02x', a.e)), '' ORDER BY a.part) AS code, sum(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i]))))::BIGINT AS error FROM a{ROUNDS} a JOIN p ON a.r = p.r AND a.part = p.part JOIN b{ROUNDS} b ON a.part = b.part AND a.e = b.e GROUP BY a.r)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(list_transform(v, lambda x: x::BIGINT), ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM b{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM k JOIN o USING (r), h"


OP11_SQL = _sql()
