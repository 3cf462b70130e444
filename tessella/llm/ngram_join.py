"""N-gram Jaccard join with token-combination prefixes; exact.

A document's set: the distinct shingles of ``WORDS`` words, as 64-bit hashes. Two sets link when
7 * common >= 3 * (n + m), a Jaccard similarity of 0.75. Copies of one set are one node.

1. A first pass counts how many nodes hold each token of the smallest hashes (a quarter more than a prefix).
   Tokens of more than ``FEW`` nodes are frequent; of these the ``FREQUENT`` most frequent at most are handed to all
   tasks. Which tokens are called frequent changes the cost only, never the result.
2. Order of tokens: rare ones by hash, then the frequent ones, rarest first. A rare token is a signature of its own.
   Frequent tokens fall into classes by their number of nodes (``CLASSES``), and each class into cells by a hash; within
   a cell every combination of k tokens is a signature. Two linked sets miss at most n - ceil(0.75 n) tokens of each other. So
   a prefix is extended until it holds one rare token, or one frequent token beyond the first k - 1 of its
   cell, more than that: to lose all signatures, more tokens would have to be missing. Of two linked sets, all
   common tokens of the prefix that ends first are in the other's prefix, so the two share a signature. The number of cells
   follows the size of the sets, by powers of two; a set that may be the smaller of a pair across such a border
   gives signatures for both sides. Cells hold a few prefix tokens each, so signatures grow in proportion to the set.
3. Nodes that share a rare token are paired; the number of tokens that two prefixes share, and all tokens
   behind them, bound the overlap, and pairs that can't reach the threshold go. The others are verified on whole sets.
4. Nodes that share a combination (or a token that was not known to be frequent) are filed under the smallest of them. First,
   every node is compared with the smallest node that it is filed under, in blocks, so a group of near copies of any size costs one
   comparison each. What these links join is one component. Files that lie in one component are done. In the others,
   nodes are dealt into blocks of about ``BLOCK`` nodes or ``TOKENS`` tokens, by component where one is large, and
   pairs of blocks are compared in products of incidence matrices, but for blocks of the same component. Each
   returns a spanning forest of its links, so output stays linear.
5. Components are computed distributedly.

Null or empty texts have no
shingles and link with nothing. Rows that share an id are placed each by its own text; different sets that stand under one id count as linked. Rows
with a null id link with nothing and have a null component. An empty table gives no rows; extra columns are ignored,
and kept by ``keep_one`` whatever their names.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, TEXTS, free, only_ids, removed, without_ids, written
from .components import components
from .words import mix, slices, trim, word_hashes

WORDS, FEW, BLOCK, TOKENS, FREQUENT = 5, 16, 512, 500_000, 500_000
#: (nodes that hold a token, tokens of a combination): a frequent token is of the last class whose number it exceeds.
CLASSES = ((0, 2), (1024, 3))
#: A cell of a set of this many tokens holds about a quarter of it: the length of its prefix within one cell.
CELL, SMALL = 16, 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str | None], k: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingles of each text; with fewer than k words the whole sequence is one."""
    h, begin = word_hashes(texts)
    long = np.zeros(0, dtype=np.uint64)
    if len(h) >= k:
        long = h[: len(h) - k + 1].copy()
        for i in range(1, k):
            long = mix(long * _STEP + h[i : len(h) - k + 1 + i])
    out = []
    for i, j in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if j - i >= k:
            out.append(np.unique(long[i : j - k + 1]))
        elif j == i:
            out.append(h[:0])
        else:
            s = np.array([j - i], dtype=np.uint64)
            for w in range(i, j):
                s = mix(s * _STEP + h[w : w + 1])
            out.append(s)
    return out


def need(n: Column) -> Column:
    """Length of the prefix of a set of n tokens."""
    return (n - F.ceil(n * 3 / 4) + 1).cast("int")


def _lists(sets: list[np.ndarray]) -> pa.Array:
    values = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)), pa.array(values))


def prefix_size(n):
    return n - -(-3 * n // 4) + 1


def _first(batches):
    """The tokens of the smallest hashes, a quarter more than a prefix, and a digest of the whole set."""
    for b in batches:
        for i, j, texts in slices(b.column(1)):
            sets = shingle_sets(texts)
            sizes = [len(s) for s in sets]
            cut = [s[: prefix_size(n) * 5 // 4 + 4] for s, n in zip(sets, sizes, strict=True)]
            marks = pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(sizes, pa.int32()), marks, _lists(cut)], names=["doc_id", "n", "mark", "tokens"])
    trim()


class Frequent:
    """Frequent tokens in order, with the number of nodes that hold each."""

    def __init__(self, tokens: np.ndarray, df: np.ndarray):
        order = np.argsort(tokens)
        self.tokens, self.df = tokens[order], df[order]

    def of(self, values: np.ndarray) -> np.ndarray:
        """df of each value, 0 where it isn't frequent."""
        if not len(self.tokens):
            return np.zeros(len(values), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.tokens, values), len(self.tokens) - 1)
        return np.where(self.tokens[at] == values, self.df[at], 0)


def _filled(frequent, wanted: bool):
    """From (node, n, first tokens): prefixes that rare tokens fill (wanted), or the nodes without one."""

    def run(batches):
        known = frequent.value
        for b in batches:
            lists = b.column(2)
            values = lists.flatten().to_numpy().view(np.uint64)
            size = pc.list_value_length(lists).to_numpy()
            n = b.column(1).to_numpy().astype(np.int64)
            need_ = prefix_size(n)
            rare = known.of(values) == 0
            row = np.repeat(np.arange(len(n)), size)
            rank = np.cumsum(rare) - rare  # rare tokens before this one, over all rows
            begin = np.cumsum(size) - size
            before = np.concatenate([rank, [rare.sum()]])[begin]
            own = np.bincount(row[rare], minlength=len(n))
            full = (own >= need_) | (size == n) & (own == n)
            if wanted:
                take = rare & full[row] & (rank - before[row] < need_[row])
                count = np.bincount(row[take], minlength=len(n))[full]
                out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.array(values[take].view(np.int64)))
                keep = pa.array(full)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), out], names=["node", "n", "tokens"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(~full))], names=["node"])
        trim()

    return run


def sides(n: int) -> list[int]:
    """Powers of two for which a set of n tokens gives combinations: that of its own size, and of the largest set that it may link with."""
    return sorted({n.bit_length() - 1, (4 * n // 3).bit_length() - 1})


def _chosen(x: int, k: int, _kept: dict = {}) -> np.ndarray:  # noqa: B006
    if (x, k) not in _kept:
        _kept[x, k] = np.array(list(combinations(range(x), k)), dtype=np.int64).reshape(-1, k)
    return _kept[x, k]


def signatures(tokens: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The rare tokens of a set's extended prefix, its combinations of frequent ones, and the number of frequent tokens that these take."""
    n = len(tokens)
    p = prefix_size(n)
    order = np.lexsort((tokens, df))
    t, d = tokens[order], df[order]
    rare = int(np.searchsorted(d, 0, side="right"))
    if rare >= p:
        return t[:p], t[:0], 0
    f, kind, made, most = t[rare:], np.searchsorted([c for c, _ in CLASSES], d[rare:], side="left") - 1, [], 0
    for side in sides(n):
        k = np.array([c for _, c in CLASSES])[kind] if 1 << side >= SMALL else np.full(len(f), 2)
        cells = max(1, (1 << side) // CELL)
        cell = (mix(f + np.uint64(side)) % np.uint64(cells)).astype(np.int64) * 8 + k
        by = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.diff(cell[by], prepend=-1))
        rank = np.empty(len(f), dtype=np.int64)
        rank[by] = np.arange(len(f)) - np.repeat(first, np.diff([*first, len(f)]))
        cut = int(np.searchsorted(rare + np.cumsum(rank >= k - 1), p)) + 1
        most = max(most, min(cut, len(f)))
        own, cell = f[:cut], cell[:cut]
        by = np.lexsort((own, cell))
        own, cell = own[by], cell[by]
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        size = np.diff([*first, len(own)])
        for c in range(len(CLASSES)):
            width = CLASSES[c][1]
            for x in np.unique(size[(cell[first] % 8 == width) & (size >= width)]).tolist():
                at = first[(size == x) & (cell[first] % 8 == width)][:, None, None] + _chosen(x, width)
                h = np.full(at.shape[:2], side * 8 + width, dtype=np.uint64)
                for j in range(width):
                    h = mix(h * _STEP + own[at[:, :, j]])
                made.append(h.ravel())
    return t[:rare], np.concatenate([*made, t[:0]]), most


def _extended(frequent):
    """From (node, text): a row for each signature, with the number of frequent tokens in the prefix, and whether it is a combination."""

    def run(batches):
        known = frequent.value
        for b in batches:
            for i, j, texts in slices(b.column(1)):
                sets = shingle_sets(texts)
                made = [signatures(x, known.of(x)) for x in sets]
                size = [len(single) + len(combined) for single, combined, _ in made]
                each = [np.repeat(v, size) for v in (b.column(0).slice(i, j - i).to_numpy(), np.array([len(x) for x in sets], dtype=np.int32), np.array([most for *_, most in made], dtype=np.int32))]
                token = np.concatenate([v for single, combined, _ in made for v in (single, combined)]).view(np.int64)
                kind = np.repeat(np.tile([False, True], len(sets)), [len(v) for single, combined, _ in made for v in (single, combined)])
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (token, *each, kind)], names=["token", "node", "n", "f", "combined"])
        trim()

    return run


def _whole(batches):
    for b in batches:
        for i, j, texts in slices(b.column(1)):
            sets = shingle_sets(texts)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "n", "tokens"])
    trim()


def frequent_tokens(nodes: DataFrame, most: int = FREQUENT) -> Frequent:
    """At most ``most`` tokens (8 MB) that more than FEW nodes hold."""
    counts = nodes.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > FEW)
    top = counts.orderBy(F.desc("df"), "token").limit(most).toPandas()
    return Frequent(top["token"].to_numpy(dtype=np.int64).view(np.uint64), top["df"].to_numpy(dtype=np.int64))


def shared(rows: DataFrame) -> DataFrame:
    """rows (token, node, n, f) of rare tokens that at least two nodes hold, with df, the number of its nodes."""
    return rows.select("token", "node", "n", "f", F.count(F.lit(1)).over(Window.partitionBy("token")).alias("df")).where("df > 1")


def rare_pairs(prefix: DataFrame) -> DataFrame:
    """From prefix rows (token, node, n, f, df): pairs a < b that the bound leaves. Groups have at most FEW nodes."""
    hot = prefix.where(F.col("df") > FEW).groupBy("node").agg(F.count(F.lit(1)).alias("hot"))
    groups = prefix.where(F.col("df") <= FEW).groupBy("token").agg(F.array_sort(F.collect_list(F.struct("node", "n", "f"))).alias("g")).where(F.size("g") > 1)
    mine = groups.select(F.posexplode("g").alias("i", "a"), "g").select("a", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("b"))
    mine = mine.where("a.node < b.node AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n")
    pairs = mine.groupBy(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb"), F.col("a.f").alias("fa"), F.col("b.f").alias("fb")).agg(F.count(F.lit(1)).alias("c"))
    for x in "ab":
        pairs = pairs.join(hot.select(F.col("node").alias(x), F.col("hot").alias(f"h{x}")), x, "left")
    both = F.least(*[F.col(f"f{x}") + F.coalesce(f"h{x}", F.lit(0)) for x in "ab"])
    behind = F.greatest(F.col("na") - need(F.col("na")), F.col("nb") - need(F.col("nb")))
    return pairs.where(7 * (F.col("c") + both + behind) >= 3 * (F.col("na") + F.col("nb"))).select("a", "b")


def _verified(batches):
    for b in batches:
        keep: list[bool] = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            keep.append(7 * len(np.intersect1d(x, y, assume_unique=True)) >= 3 * (len(x) + len(y)))
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), b.column(1).filter(pa.array(keep, pa.bool_()))], names=["u", "v"])


def forest(node: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between the sets at ``left`` and those at ``right`` (within, if both are the same)."""
    n = np.array([len(s) for s in sets])
    token, col, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, some = np.repeat(np.arange(len(sets)), n), times[col] > 1
    row, col = row[some], (np.cumsum(times > 1) - 1)[col[some]]  # a token of one set is common to none
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    total = int(col[-1]) + 1 if len(col) else 0
    same = left is right
    common = np.zeros((len(left), len(right)), dtype=np.float32)
    for c in range(0, total, 4096):  # memory: rows x 4096 columns at a time
        on = slice(*np.searchsorted(col, [c, c + 4096]))
        m = np.zeros((len(sets), min(4096, total - c)), dtype=np.float32)
        m[row[on], col[on] - c] = 1
        common += m[left] @ m[right].T
    link = 7 * common.astype(np.int64) >= 3 * (n[left][:, None] + n[right][None, :])
    u, v, seen = [], [], [np.zeros(len(left), dtype=bool), np.zeros(len(right), dtype=bool)]
    if same:
        seen[1] = seen[0]
    for i in range(len(left)):
        if seen[0][i]:
            continue
        seen[0][i], todo = True, [(0, i)]
        while todo:
            s, k = todo.pop()
            new = np.flatnonzero((link[:, k] if s else link[k]) & ~seen[1 - s])
            seen[1 - s][new] = True
            u += [node[(right if s else left)[k]]] * len(new)
            v += node[(left if s else right)[new]].tolist()
            todo += [(0 if same else 1 - s, int(q)) for q in new]
    return np.array(u, dtype=np.int64), np.array(v, dtype=np.int64)


def _compared(t: pa.Table) -> pa.Table:
    """Two blocks x and y of one file; ``own`` is the block that a node is of."""
    node, own = t.column("node").to_numpy(), t.column("own").to_numpy()
    x, y = t.column("x")[0].as_py(), t.column("y")[0].as_py()
    left = np.flatnonzero(own == x)
    right = left if x == y else np.flatnonzero(own == y)
    u, v = forest(node, [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column("tokens")], left, right)
    trim()
    return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _starred(t: pa.Table) -> pa.Table:
    """The links of a block's nodes with the file's first node."""
    node, sets, file = t.column("node").to_numpy(), [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column("tokens")], t.column("file")[0].as_py()
    v: set[int] = set()
    for first in (sets[i] for i in np.flatnonzero(node == file)):  # several, if rows of different texts share its id
        for k, s in zip(node.tolist(), sets, strict=True):
            at = np.minimum(np.searchsorted(first, s), len(first) - 1)
            if k != file and 7 * int((first[at] == s).sum()) >= 3 * (len(s) + len(first)):
                v.add(k)
    return pa.table({"u": pa.array([file] * len(v), pa.int64()), "v": pa.array(sorted(v), pa.int64())})


def filed_nodes(rows: DataFrame) -> DataFrame:
    """From signature rows (token, node, n): (file, node, n), all nodes of each signature filed under its smallest node."""
    leader = rows.groupBy("token").agg(F.min("node").alias("file"), F.count(F.lit(1)).alias("g")).where("g > 1").drop("g")
    leader = written(leader, "leaders", packed=False)
    side = F.broadcast(leader) if leader.count() <= BROADCAST_IDS // 2 else leader  # a frequent token's rows stay spread out
    filed = written(rows.join(side, "token").select("file", "node", "n").distinct(), "files", packed=False)
    removed(leader)
    return filed


def _small_side(table: DataFrame) -> DataFrame:
    """Broadcast up to BROADCAST_IDS // 4 rows, so that the rows of a large file stay spread out; beyond it the join shuffles."""
    return F.broadcast(table) if table.count() <= BROADCAST_IDS // 4 else table


def _blocks(nodes: Column, tokens: Column) -> Column:
    return F.greatest(F.ceil(nodes / BLOCK), F.ceil(tokens / TOKENS)).cast("int")


def _dealt(column: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(column), F.col(blocks)).cast("int")


def first_links(filed: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of each node with the smallest node that it is filed under; that one's set goes once to each block of its nodes."""
    one = filed.where("file <> node").groupBy("node").agg(F.min("file").alias("file"), F.first("n").alias("n"))
    sizes = written(one.groupBy("file").agg(_blocks(F.count(F.lit(1)), F.sum("n")).alias("blocks")), "sizes")
    some = one.join(_small_side(sizes), "file").select("file", "node", _dealt("node", "blocks").alias("block"))
    every = some.unionAll(sizes.select("file", F.col("file").alias("node"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")))
    return every.join(sets.select("node", "tokens"), "node").groupBy("file", "block").applyInArrow(_starred, "u bigint, v bigint")


def other_links(filed: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between nodes of a file that lie in different components so far: a spanning forest of each pair of blocks."""
    placed = filed.join(found.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    parts = written(placed.groupBy("file", "c").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("n")), "parts")
    # A component with a block's nodes or more has a lot of its own (named by it); the others of a file share one.
    parts = parts.join(parts.groupBy("file").agg(F.count(F.lit(1)).alias("many")).where("many > 1"), "file", "left_semi")
    parts = written(parts.withColumn("lot", F.when((F.col("g") >= BLOCK) | (F.col("n") >= TOKENS), F.col("c").cast("string")).otherwise("")), "named")
    lots = written(parts.groupBy("file", "lot").agg(_blocks(F.sum("g"), F.sum("n")).alias("blocks")), "lots")
    blocks = lots.select("file", "lot", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    left, right = (blocks.select("file", F.struct("lot", "block").alias(x)) for x in "xy")
    pairs = left.join(right, "file").where("x <= y AND NOT (x.lot = y.lot AND x.lot <> '')").select("file", "x", "y")
    nodes = placed.join(_small_side(parts.select("file", "c", "lot")), ["file", "c"]).join(_small_side(lots), ["file", "lot"]).select("file", "node", F.struct("lot", _dealt("node", "blocks").alias("block")).alias("own"))
    both = pairs.select("file", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("own"))
    named = lambda x: F.concat_ws(":", f"{x}.lot", f"{x}.block").alias(x)
    met = nodes.join(both, ["file", "own"]).select("file", "node", named("own"), named("x"), named("y"))
    return met.join(sets.select("node", "tokens"), "node").groupBy("file", "x", "y").applyInArrow(_compared, "u bigint, v bigint")


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    first = written(texts.mapInArrow(_first, "doc_id bigint, n int, mark binary, tokens array<bigint>"), "first", TEXTS, packed=False)
    known = first.where("n > 0 AND doc_id IS NOT NULL")
    reps = known.groupBy("mark").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    reps = written(reps.select("mark", "node"), "copied")
    side = F.broadcast(reps) if reps.count() <= BROADCAST_IDS // 2 else reps  # the rows of a set with many copies stay spread out
    members = known.select("doc_id", "n", "mark").join(side, "mark", "left").select("doc_id", "n", "mark", F.coalesce("node", "doc_id").alias("node"))
    copies = written(members.where("doc_id <> node").select("doc_id", "mark").distinct(), "copies")
    nodes = without_ids(known, copies, ["doc_id", "mark"], 3 * copies.count()).select(F.col("doc_id").alias("node"), "n", "tokens")

    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(nodes))
    named = texts.withColumnRenamed("doc_id", "node")
    short = written(nodes.mapInArrow(_filled(frequent, False), "node bigint").distinct(), "short", TEXTS)
    more = written(only_ids(named, short, "node", short.count()).mapInArrow(_extended(frequent), "token bigint, node bigint, n int, f int, combined boolean"), "extended", TEXTS, packed=False)
    rare = nodes.mapInArrow(_filled(frequent, True), "node bigint, n int, tokens array<bigint>").select(F.explode("tokens").alias("token"), "node", "n", F.lit(0).alias("f"))
    prefix = written(shared(rare.unionAll(more.where("NOT combined").drop("combined"))), "prefix", TEXTS, packed=False)
    pairs = written(rare_pairs(prefix), "pairs")
    filed = filed_nodes(prefix.where(F.col("df") > FEW).select("token", "node", "n").unionAll(more.where("combined").select("token", "node", "n")))
    frequent.destroy()
    removed(copies, short, more, prefix)

    wanted = written(filed.select("node").unionAll(pairs.select("a")).unionAll(pairs.select("b")).distinct(), "wanted")
    sets = written(only_ids(named, wanted, "node", wanted.count()).mapInArrow(_whole, "node bigint, n int, tokens binary"), "sets", TEXTS, packed=False)
    left, right = sets.select(F.col("node").alias("a"), F.col("tokens").alias("x")), sets.select(F.col("node").alias("b"), F.col("tokens").alias("y"))
    links = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_verified, "u bigint, v bigint")
    found = components(links.unionAll(first_links(filed, sets)))
    rest = written(other_links(filed, found, sets), "rest")
    if not rest.isEmpty():
        before, found = found, components(rest.unionAll(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))
        removed(before)
    removed(rest, pairs, filed, wanted, sets)

    placed = members.drop("mark").join(found, "node", "left").select("doc_id", "n", F.coalesce("component", "node").alias("component_id"))
    alone = first.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return placed.unionAll(alone).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the document with its smallest id; rows without shingles all stay."""
    own = free("lost_id", docs.columns)
    groups = joined(docs, id_col, text_col)
    lost = written(groups.where("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct(), "lost")
    return without_ids(docs.withColumn(own, F.col(id_col).cast("long")), lost, own, lost.count()).select(*[f"`{c}`" for c in docs.columns])


def op2(spark, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))
