"""Comparing retrieval variants: stable assignment, interleaved rankings, preferences from clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit(key: Column, experiment: str) -> Column:
    """A number from 0 to 9999 that depends on the key and the experiment alone, so that a user keeps a variant across sessions and experiments don't follow each other."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(experiment), F.lit("/"), key.cast("string"))), 1, 8), 16, 10).cast("long") % 10_000).cast("int")


def assigned(key: Column, experiment: str, shares: dict[str, float]) -> Column:
    """The variant of a key: shares of the units in the order given; null beyond them."""
    out, below = None, 0.0
    for name, share in shares.items():
        below += share
        hit = unit(key, experiment) < round(10_000 * below)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def interleaved(a: DataFrame, b: DataFrame, experiment: str, key: str = "doc_id") -> DataFrame:
    """Two rankings (query_id, key, rank from 1) as one: balanced, so that its first n hold the first of both to within one. query_id, key, rank, rank_a, rank_b, a_first.

    Which ranking begins is a coin of the query. A document of both stands where the better rank puts it.
    """
    both = a.select("query_id", key, F.col("rank").alias("rank_a")).join(b.select("query_id", key, F.col("rank").alias("rank_b")), ["query_id", key], "full")
    first = unit(F.col("query_id"), experiment) < 5000
    none = F.lit(2_147_483_647)
    ra, rb = F.coalesce("rank_a", none), F.coalesce("rank_b", none)
    turn = F.when((ra <= rb) == first, 0).when(ra == rb, 0).otherwise(1)
    order = Window.partitionBy("query_id").orderBy(F.least(ra, rb), turn, key)
    return both.withColumns({"a_first": first, "rank": F.row_number().over(order)}).select("query_id", key, "rank", "rank_a", "rank_b", "a_first")


def preferences(shown: DataFrame, clicks: DataFrame, key: str = "doc_id") -> DataFrame:
    """From interleaved rankings and clicks (query_id, key): query_id, clicks_a, clicks_b, winner (a, b or tie).

    Clicks are counted among as many first documents of each ranking as the last clicked one needs of the one that ranks it better.
    """
    hit = shown.join(clicks.select("query_id", key).distinct(), ["query_id", key], "left_semi")
    depth = F.max(F.least("rank_a", "rank_b")).over(Window.partitionBy("query_id"))  # the last click is the one furthest down
    rows = hit.withColumn("depth", depth).groupBy("query_id").agg(F.count_if(F.col("rank_a") <= F.col("depth")).alias("clicks_a"), F.count_if(F.col("rank_b") <= F.col("depth")).alias("clicks_b"))
    return rows.withColumn("winner", F.when(F.col("clicks_a") > F.col("clicks_b"), "a").when(F.col("clicks_a") < F.col("clicks_b"), "b").otherwise("tie"))
