"""Best-fit packing by swap-based local search.

1. Each text becomes ids and an end id. One longer than ``size`` is cut into pieces of ``size`` ids,
   the first of which may be shorter. Only the pieces' lengths and checksums go on.
2. Whole pieces are sequences of their own. The others are dealt evenly into blocks of about ``block``
   pieces by a hash of their row number (not of their id, so repeated ids don't meet in one block).
3. Each block is packed alone: best fit, longest first, then local search between its underfull
   bins. Starting from the emptiest bin, a document moves, or is exchanged one for one or two for one, into
   a fuller bin, taking the step that raises the sum of squared fills most, until no step does; bins
   empty on the way. A block wastes little more than a part of one bin, so the count stays within about one
   bin a block of the least possible, and blocks grow in number, not in size.

Null text counts as empty (the end id alone). Repeated rows are documents of their own. An empty table
gives no rows. Extra columns are ignored by ``packed`` and kept by ``with_sequences``.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TEXTS, written
from .tokenize import encoder
from .words import slices, trim

SIZE, BLOCK, END = 1024, 8192, 2


def cut(n: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return ([(0, first)] if first else []) + [(i, size) for i in range(first, n, size)]


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Bins of document numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    rooms = 0  # bit r: some bin has room r
    for d in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[d])
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(d)
        else:
            b, room = len(bins), size
            bins.append([d])
        left = room - n
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Moves and exchanges between underfull bins while the sum of squared fills rises; empty bins are left out."""
    fill = np.array([lengths[b].sum() for b in bins], dtype=np.int64)
    under = np.flatnonzero(fill < size)
    if len(under) < 2:
        return bins
    done = [bins[i] for i in np.flatnonzero(fill >= size)]
    bins, fill = [bins[i] for i in under], fill[under]
    doc = np.array([d for b in bins for d in b], dtype=np.int64)
    home = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    n = lengths[doc].astype(np.int64)
    open_ = fill > 0
    step, changed, tried = 0, np.zeros(len(bins), dtype=np.int64), np.full(len(bins), -1)  # numbers of the step that last changed a bin, and at which a source had none
    while (wait := np.flatnonzero(open_ & (tried < step))).size:
        source = int(wait[fill[wait].argmin()])
        mine = np.flatnonzero(home == source)
        x = n[mine]
        new = changed > (tried[source] if changed[source] <= tried[source] else -1)  # a source that was tried and not changed looks at changed bins
        away = np.flatnonzero(open_ & new & (fill < size) & (np.arange(len(bins)) != source))
        best = (0, None)

        def offer(net, target, what, best=None, source=source):
            """The step of the largest gain among arrays of net lengths into target bins."""
            ok = (net > 0) & (net <= size - fill[target])
            gain = np.where(ok, net * (fill[target] - fill[source] + net), 0)
            k = int(gain.argmax()) if gain.size else 0
            return (int(gain.flat[k]), what(k)) if gain.size and gain.flat[k] > best[0] else best

        if len(away):
            u, first = np.unique(x, return_index=True)
            best = offer(np.repeat(u, len(away)), np.tile(away, len(u)), lambda k: ([mine[first[k // len(away)]]], [], away[k % len(away)]), best)
            theirs = np.flatnonzero(np.isin(home, away))
            if len(theirs):
                y, ty = n[theirs], home[theirs]
                net = (u[:, None] - y[None, :]).ravel()
                best = offer(net, np.tile(ty, len(u)), lambda k: ([mine[first[k // len(theirs)]]], [theirs[k % len(theirs)]], ty[k % len(theirs)]), best)
                if len(x) > 1:
                    i, j = np.triu_indices(len(x), 1)
                    pair, at = np.unique(x[i] + x[j], return_index=True)
                    fits = np.searchsorted(pair, y + size - fill[ty], "right") - 1  # the largest sum that fits raises the fills most
                    net = np.where(fits >= 0, pair[fits] - y, 0)
                    best = offer(net, ty, lambda k: ([mine[i[at[fits[k]]]], mine[j[at[fits[k]]]]], [theirs[k]], ty[k]), best)
        if best[1] is None:
            tried[source] = step
            continue
        step += 1
        out, back, target = best[1]
        home[out], home[back] = target, source
        net = int(n[out].sum() - n[back].sum())
        changed[[source, target]] = step
        fill[target] += net
        fill[source] -= net
        open_[source] = fill[source] > 0
    order = np.argsort(home, kind="stable")
    at = np.searchsorted(home[order], np.arange(len(bins) + 1))
    return done + [doc[order[i:j]].tolist() for i, j in zip(at, at[1:], strict=False) if j > i]


def pack(lengths: np.ndarray, size: int = SIZE) -> list[list[int]]:
    return local_search(best_fit(lengths, size), lengths, size)


def pieces(docs: DataFrame, path: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (a number for each row of docs), piece, start, length, ids_crc32."""
    names = ["doc_id", "row", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        enc, tail = encoder(path), np.array([end], dtype="<u4").tobytes()
        for b in batches:
            doc, row = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j, texts in slices(b.column(2)):
                out: list[list] = [[] for _ in names]
                for d, r, ids in zip(doc[i:j], row[i:j], enc.encode(texts), strict=True):
                    ids += tail
                    for k, (start, n) in enumerate(cut(len(ids) // 4, size)):
                        for column, v in zip(out, (d, r, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])), strict=True):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
        trim()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def packed(docs: DataFrame, path: str, size: int = SIZE, end: int = END, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with sequence_id and offset."""
    made = written(pieces(docs, path, size, end, id_col, text_col), "pieces", TEXTS)
    part = made.where(F.col("length") < size)
    blocks = max(1, -(-part.count() // block))

    def place(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("row", "ascending"), ("piece", "ascending")])
        n = t.column("length").to_numpy()
        number, offset = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
        for k, b in enumerate(pack(n, size)):
            number[b] = k
            offset[b] = np.cumsum(n[b]) - n[b]
        own = t.column("block")[0].as_py()
        return t.drop_columns(["block"]).append_column("sequence_id", pa.array(number + (own << 32))).append_column("offset", pa.array(offset))

    dealt = part.withColumn("block", F.pmod(F.xxhash64("row", "piece"), F.lit(blocks)))
    shape = "doc_id bigint, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    few = dealt.groupBy("block").applyInArrow(place, shape)
    whole = made.where(F.col("length") == size).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return few.unionByName(whole)


def op1(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("row")
