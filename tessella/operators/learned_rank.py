"""Learned ranking: weights for ranking signals from judged hits, and the quality of a ranking.

``train`` fits a listwise model (the cross entropy between a query's gains and the softmax of its scores) on whole queries, chosen by a hash of their
ids, of at most MOST_ROWS hits together; that bound is the model's, scoring covers every hit. ``score`` is a sum of columns, so a ranking stays one native plan.
Null signals count as the mean.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_ROWS, STEPS, RATE, DECAY = 200_000, 300, 0.5, 1e-3


@dataclass(frozen=True)
class RankModel:
    names: tuple[str, ...]
    weights: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]

    def score(self, signal) -> Column:
        """``signal`` gives the column of a signal's name."""
        total = F.lit(0.0)
        for name, w, m, s in zip(self.names, self.weights, self.means, self.scales, strict=True):
            total = total + F.lit(w / s) * (F.coalesce(signal(name).cast("double"), F.lit(m)) - F.lit(m))
        return total


def sample(hits: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """Whole queries of at most about ``most`` hits together."""
    n = hits.count()
    return hits if n <= most else hits.where(F.pmod(F.xxhash64("query_id"), F.lit(1_000_003)) < int(1_000_003 * most / n))


def train(hits: DataFrame, names: list[str], signal, gain: str = "gain", most: int = MOST_ROWS) -> RankModel:
    """From hits (query_id, gain and signals); queries without any gain teach nothing."""
    rows = sample(hits, most).select("query_id", F.col(gain).cast("double").alias("g"), *[signal(n).cast("double").alias(f"s{i}") for i, n in enumerate(names)]).toPandas()
    x = rows[[f"s{i}" for i in range(len(names))]].to_numpy(dtype=float).reshape(len(rows), len(names))
    with np.errstate(all="ignore"):
        mean = np.where(np.isfinite(x).any(0), np.nanmean(np.where(np.isfinite(x), x, np.nan), 0), 0.0) if len(x) else np.zeros(len(names))
    x = np.where(np.isfinite(x), x, mean) - mean
    scale = x.std(0) if len(x) else np.ones(len(names))
    scale[scale == 0] = 1.0
    x /= scale
    _, query = np.unique(rows["query_id"].to_numpy(), return_inverse=True)
    many = int(query.max(initial=-1)) + 1
    gains = np.nan_to_num(rows["g"].to_numpy(dtype=float))
    total = np.bincount(query, gains, minlength=many)
    good = total[query] > 0 if many else np.zeros(0, bool)
    x, query, want = x[good], query[good], (gains / np.where(total[query] > 0, total[query], 1))[good]
    taught = max(1, len(np.unique(query)))
    w = np.zeros(len(names))
    for _ in range(STEPS if len(x) else 0):
        z = x @ w
        top = np.full(many, -np.inf)
        np.maximum.at(top, query, z)
        e = np.exp(z - top[query])
        w -= RATE * (x.T @ (e / np.bincount(query, e, minlength=many)[query] - want) / taught + DECAY * w)
    return RankModel(tuple(names), tuple(map(float, w)), tuple(map(float, mean)), tuple(map(float, scale)))


def ndcg(hits: DataFrame, score: str, gain: str = "gain", tie: str = "doc_id", k: int = 10) -> DataFrame:
    """query_id, ndcg of the first k by score (ties by ``tie``); 0 for queries without gain. Null scores come last, null gains are none."""
    g = F.coalesce(F.col(gain).cast("double"), F.lit(0.0))
    order = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(c, tie))
    rows = hits.select("query_id", tie, g.alias("g"), F.col(score).alias("s")).withColumns({"r": order(F.desc_nulls_last("s")), "best": order(F.desc("g"))})
    worth = lambda place: F.sum(F.when(F.col(place) <= k, (F.pow(F.lit(2.0), F.col("g")) - 1) / F.log2(F.col(place) + 1.0)).otherwise(0.0))
    return rows.groupBy("query_id").agg(worth("r").alias("dcg"), worth("best").alias("ideal")).select("query_id", F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0).alias("ndcg"))
