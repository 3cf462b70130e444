"""Exact deduplication with a heavy-hitter split; DataFrame operations only.

1. One pass over the texts writes (id, row, SHA-256), 48 bytes a row.
2. A frequent-items sketch (``approx_top_k_accumulate``: a Misra-Gries summary with mergeable
   counters), merged in two levels, names candidate digests: one for each PER_HEAVY rows, 1024 to 50,000. Their winners and exact sizes
   come from an aggregation that combines on the map side and has one row a candidate.
3. Rows of verified heavy digests get their winner from a broadcast of as many rows at most (5 MB) and
   never move. A digest that stays behind occurs at most about
   rows / (16 * candidates) times, or less often than all candidates, or fell below ``least``; those rows shuffle by digest.

Null text counts as empty. Repeated rows with the same id and text are separate rows
of one group; exactly one row of a group stays, the one with the largest id (a null
id is smaller than any). An empty table gives an empty result. Columns other than
the id and the text are ignored, and kept by ``keep_one`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, free, removed, written

PER_HEAVY, HEAVY, MOST_HEAVY, FAN, LEAST = 100_000, 1024, 50_000, 256, 64


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))


def frequent(rows: DataFrame, heavy: int, tracked: int) -> DataFrame:
    """key, n: the ``heavy`` most frequent hashes of digests, by a sketch of ``tracked`` counters; FAN merged sketches reach the last task."""
    key = F.xxhash64("digest").alias("key")
    part = rows.select(key, F.pmod(F.shiftright("row", 33), F.lit(FAN)).alias("fan")).groupBy("fan").agg(F.expr(f"approx_top_k_accumulate(key, {tracked})").alias("s"))
    # Under a key: without one each empty partition would send an empty sketch, which can't be serialised.
    top = part.groupBy(F.lit(0).alias("one")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s")).select(F.explode(F.expr(f"approx_top_k_estimate(s, {heavy})")).alias("t"))
    return top.select(F.col("t.item").alias("key"), F.col("t.count").alias("n"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int | None = None, least: int = LEAST) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest (binary), row."""
    rows = written(digests(docs, id_col, text_col), "digests")
    key = F.xxhash64("digest")
    heavy = heavy or min(MOST_HEAVY, max(HEAVY, rows.count() // PER_HEAVY))
    names = frequent(rows, heavy, 16 * heavy).where(F.col("n") >= least).select("key")
    best = F.max(F.struct("doc_id", "row"))
    winners = rows.withColumn("key", key).join(F.broadcast(names), "key", "left_semi")
    winners = winners.groupBy("digest").agg(F.count(F.lit(1)).alias("size"), best.alias("best")).where(F.col("size") >= least)
    marked = rows.join(F.broadcast(written(winners, "heavy")), "digest", "left")
    own = Window.partitionBy("digest")
    light = marked.where(F.col("size").isNull()).select("doc_id", "row", "digest", F.count(F.lit(1)).over(own).alias("size"), best.over(own).alias("best"))
    both = marked.where(F.col("size").isNotNull()).select("doc_id", "row", "digest", "size", "best").unionAll(light)
    return both.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("size").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), "digest", "row")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; texts are not shuffled while the dropped ids can be broadcast."""
    own, mark = (free(c, [id_col, text_col, *docs.columns]) for c in ("own_id", "text_digest"))
    groups = written(exact_groups(docs, id_col, text_col), "groups")
    lost = groups.where(~F.col("kept")).select(F.col("doc_id").alias("lost_id"), F.col("digest").alias("lost_digest"))
    # An id with both a kept and a dropped row of one text: which of the equal rows stays makes no difference, but one must.
    twice = groups.groupBy("doc_id", "digest").agg(F.sum(F.col("kept").cast("int")).alias("stay"), F.count(F.lit(1)).alias("n")).where("n > 1 AND stay > 0")
    twice = written(twice.select(F.col("doc_id").alias("lost_id"), F.col("digest").alias("lost_digest")), "twice")
    both = docs.withColumns({own: F.col(f"`{id_col}`").cast("long"), mark: F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256))}).alias("d")
    same = F.col(f"d.{own}").eqNullSafe(F.col("l.lost_id")) & (F.col(f"d.{mark}") == F.col("l.lost_digest"))
    side = (F.broadcast(lost) if lost.count() <= BROADCAST_IDS // 4 else lost).alias("l")
    kept = both.join(side, same, "left_anti")
    if not twice.isEmpty():
        kept = kept.unionByName(both.join(twice.alias("l"), same, "left_semi").dropDuplicates([own, mark]))
    return kept.drop(own, mark)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
