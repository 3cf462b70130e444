"""Filter interaction audit: what each filter removes in every order, from counts of failure masks.

Five filters look at a whole text (null: empty): A too few words, B too few different words, C too many
capitals, D marks, E the same text under a smaller id. A document's failures are a mask of five bits, and all
that an order of filters does follows from how often each mask occurs, so the texts are read once.

1. Bits A to D, an xxhash of the text and its SHA-256 are written for each row, by column functions.
2. Texts whose xxhash occurs more than once are routed as an RDD, partitioned by it. Each task keeps, for each hash, a chain of the different
   texts behind it, with the smallest id so far; ids that aren't the smallest are emitted. The same is done before the shuffle, in runs of LOCAL
   characters, so that a group of copies however large sends one text a run, and short records beside it. Chains hold full
   texts: equal hashes never make texts equal. (Up to BROADCAST_IDS repeated hashes are broadcast to leave single texts where they are; beyond that all texts are routed.)
3. Emitted ids set bit E; records (part, mask, count) meet their labels; ``combineByKey`` merges a vector of counts for each part.
4. Each part's vector gives the rows of all orders and steps.

Rows with the same id and text are no copies of each other; a null id is no copy and makes none. A document is
good or toxic when any of its labels says so. Null parts count as empty ones. An empty table gives no rows. Extra columns are
ignored. A task holds the different texts routed to it, about a ROUTED-th of an input partition; very long texts are one record.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, free, table, written

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, MARKS = 100, 80, 10, "[#$%&*|]"
#: Characters of the texts that a task keeps before the shuffle, and the least number of routed partitions for each partition that is read.
LOCAL, ROUTED = 1 << 24, 2

COUNTS = "kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def text_failures(text: Column) -> Column:
    """The mask of filters A to D."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("k")))[0]
    few = F.transform(F.array(counts), lambda c: F.when(c["n"] < LEAST_WORDS, 1).otherwise(0) + F.when(100 * c["k"] < DISTINCT_PERCENT * c["n"], 2).otherwise(0))[0]
    capitals = 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITAL_PERCENT * F.length(text)
    return few + F.when(capitals, 4).otherwise(0) + F.when(text.rlike(MARKS), 8).otherwise(0)


def _place(chains: dict, key: int, text: str, doc_id: int, digest: bytes) -> tuple | None:
    """Puts a text into its chain; what turns out not to have the smallest id comes back."""
    chain = chains.setdefault(key, [])
    for link in chain:
        if link[0] == text:
            if doc_id < link[1]:
                lost, link[1] = link[1], doc_id
                return lost, digest
            return (doc_id, digest) if doc_id > link[1] else None
    chain.append([text, doc_id, digest])
    return None


def _spread(key: int, doc_id: int) -> int:
    """Records without a text go anywhere, so that those of one group don't meet."""
    return (key ^ (doc_id * 0x9E3779B97F4A7C15)) & 0x7FFFFFFFFFFFFFFF


def _before(rows: Iterable) -> Iterator[tuple]:
    """Records (key, (id, digest, text, or None where the id isn't the smallest)) of one input partition."""
    chains: dict = {}
    size = 0
    for key, doc_id, digest, text in rows:
        lost = _place(chains, key, text, doc_id, digest)
        if lost:
            yield _spread(key, lost[0]), (*lost, None)
        else:
            size += len(text)
        if size > LOCAL:
            yield from ((k, (d, x, t)) for k, chain in chains.items() for t, d, x in chain)
            chains, size = {}, 0
    yield from ((k, (d, x, t)) for k, chain in chains.items() for t, d, x in chain)


def _after(records: Iterable) -> Iterator[tuple]:
    """(id, digest) of one routed partition whose text a smaller id has."""
    chains: dict = {}
    for key, (doc_id, digest, text) in records:
        lost = (doc_id, digest) if text is None else _place(chains, key, text, doc_id, digest)
        if lost:
            yield lost[0], bytearray(lost[1])


def later_copies(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """copy_id, copy_digest: the different ids, with their texts' digests, of docs (key, doc_id, digest, text) whose text a smaller id has too. ``repeated``: the keys that occur more than once."""
    spark, n = docs.sparkSession, repeated.count()
    rows = docs.where("doc_id IS NOT NULL")
    rows = (rows.join(F.broadcast(repeated), "key", "left_semi") if n <= BROADCAST_IDS else rows).select("key", "doc_id", "digest", "text").rdd
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ROUTED * rows.getNumPartitions())
    routed = rows.mapPartitions(_before).partitionBy(parts, lambda key: key).mapPartitions(_after)
    return spark.createDataFrame(routed, "copy_id bigint, copy_digest binary", verifySchema=False).distinct()


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask, n: the failures of every row (n = 1); rows with a null id are counted together."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumns({"key": F.xxhash64("text"), "digest": F.unhex(F.sha2("text", 256))})
    facts = written(rows.select("doc_id", "part", "key", "digest", text_failures(F.col("text")).alias("mask")), "failures")
    repeated = written(facts.groupBy("key").count().where("count > 1").select("key"), "repeated_hashes")
    copies = written(later_copies(rows, repeated), "later_copies")
    copies = F.broadcast(copies) if copies.count() <= BROADCAST_IDS // 8 else copies
    named = facts.where("doc_id IS NOT NULL").join(copies, (F.col("doc_id") == F.col("copy_id")) & (F.col("digest") == F.col("copy_digest")), "left")
    named = named.select("doc_id", "part", F.when(F.col("copy_id").isNull(), F.col("mask")).otherwise(F.col("mask") + COPY).alias("mask"), F.lit(1).cast("long").alias("n"))
    nameless = facts.where("doc_id IS NULL").groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    return named.unionByName(nameless)


def _counted(row) -> np.ndarray:
    """All, good and toxic documents for each mask, from one record (mask, n, good, toxic)."""
    return _add(np.zeros((3, 1 << len(FILTERS)), dtype=np.int64), row)


def _add(vector: np.ndarray, row) -> np.ndarray:
    mask, n, good, toxic = row
    vector[:, mask] += n, n * good, n * toxic
    return vector


def vectors(marked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> RDD:
    """(part, counts of all, good and toxic documents by mask)."""
    own = free("label_id", marked.columns)
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias(own))
    said = said.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    rows = marked.join(said, marked["doc_id"] == F.col(own), "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)), F.coalesce("toxic", F.lit(0)))
    parts = int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.rdd.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(_counted, _add, np.add, parts)


def orders(part: str, counts: np.ndarray) -> list[tuple]:
    """The rows of one part: part, filter_order, step and the counts, for each order and step."""
    mask = np.arange(1 << len(FILTERS))
    rows, total = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        gone = np.zeros(len(mask), dtype=bool)
        for step, f in enumerate(order, 1):
            fails = (mask & (1 << FILTERS.index(f))) > 0
            here = fails & ~gone
            removed, good, toxic = (int(x) for x in counts[:, here].sum(1))
            redundant = int(counts[0, fails & gone].sum())
            gone = gone | fails
            total[f] += removed
            rows.append((f, part, "".join(order), step, int(counts[0, ~gone].sum()), removed, redundant, int(counts[0, 1 << FILTERS.index(f)]), good, toxic))
    return [(*r[1:], total[r[0]]) for r in rows]


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step."""
    found = vectors(masks(docs, id_col, text_col, part_col), labels).flatMap(lambda kv: orders(*kv))
    return docs.sparkSession.createDataFrame(found, f"part string, filter_order string, step int, {COUNTS}", verifySchema=False)


def op12(spark, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
      + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END)
      + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN d.doc_id > first THEN 16 ELSE 0 END) AS mask,
    coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
m AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, unnest([1, 2, 3, 4, 5]) AS step, unnest([a.bit, b.bit, c.bit, d.bit, e.bit]) AS bit,
    unnest([0, a.bit, a.bit + b.bit, a.bit + b.bit + c.bit, a.bit + b.bit + c.bit + d.bit]) AS before
  FROM x a, x b, x c, x d, x e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
r AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (WHERE mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (WHERE mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost
  FROM m, o GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
