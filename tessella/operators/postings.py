"""A persisted inverted index with block bounds, and lexical search that prunes by them.

``build`` writes, in one pass without a shuffle, a Parquet row for each term of each shard: the shard's documents that hold it, how often, the documents'
lengths, and for each block of BLOCK postings the largest weight that a document in it can have. A shard is what one task has read up to
SHARD_TOKENS words, so memory follows the shard; its rows are sorted by term, so that a scan for a query's terms skips the row groups of others.

``search`` reads the postings of the asked terms only. Document frequencies are summed over shards first; then every shard ranks its own documents
for all queries, and keeps k a query. In a shard a query's terms are taken from the rarest on: once the terms left can't lift a document
that holds none of the others above the kth best, only documents that are there already are looked up in them, and of these only those
whose blocks allow it. So frequent words cost a lookup for a few candidates. Results equal ``vector.bm25``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

BLOCK, SHARD_TOKENS = 128, 500_000
#: Distinct terms of one round of queries, which go to all tasks (about 100 bytes each).
TERMS_AT_ONCE = 200_000
POSTINGS = "shard bigint, term string, docs array<bigint>, tf array<int>, size array<int>, top_tf array<int>, least_size array<int>"
SLACK = 1e-5


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in any script."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0))


def _shard(shard: int, ids: np.ndarray, size: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    """The rows of one shard, by term; postings in the order of document ids. size: words of each document; words: those of all, one after the other."""
    order = np.argsort(ids, kind="stable")
    place = np.empty(len(ids), dtype=np.int64)
    place[order] = np.arange(len(ids))
    coded = words.dictionary_encode()
    terms = coded.dictionary
    by_name = np.argsort(np.array(terms.to_pylist(), dtype=object), kind="stable")
    number = np.empty(len(terms), dtype=np.int64)
    number[by_name] = np.arange(len(terms))
    pairs, tf = np.unique(number[coded.indices.to_numpy()] * len(ids) + np.repeat(place, size), return_counts=True)
    term, doc = pairs // max(1, len(ids)), order[pairs % max(1, len(ids))]
    n = size[doc]
    first = np.searchsorted(term, np.arange(len(terms) + 1))
    blocks = -(-np.diff(first) // BLOCK)
    block_first = np.concatenate([[0], np.cumsum(blocks)])
    begin = np.repeat(first[:-1], blocks) + (np.arange(block_first[-1]) - np.repeat(block_first[:-1], blocks)) * BLOCK
    top, least = (f.reduceat(v, begin) if len(begin) else v for f, v in ((np.maximum, tf), (np.minimum, n)))
    lists = lambda at, v, kind: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, kind))
    cols = [lists(first, ids[doc], pa.int64()), lists(first, tf, pa.int32()), lists(first, n, pa.int32()), lists(block_first, top, pa.int32()), lists(block_first, least, pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), shard)), terms.take(pa.array(by_name)), *cols], names=["shard", "term", "docs", "tf", "size", "top_tf", "least_size"])


def build(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> PostingsIndex:
    """Writes the index of docs. Documents with a null id are left out; null and empty texts count as documents without words; ids should be unique."""

    def run(batches: Iterator[pa.RecordBatch]):
        number, used, held = TaskContext.get().partitionId() << 24, 0, []

        def shard():
            return _shard(number, *(np.concatenate([h[i] for h in held]) for i in (0, 1)), pa.concat_arrays([h[2] for h in held]))

        for b in batches:
            ids, size, words = b.column(0).to_numpy(zero_copy_only=False), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False).astype(np.int64), b.column(1).flatten()
            ends, begin = np.cumsum(size), 0
            while begin < len(ids):
                # A shard ends with the document that fills it.
                before = int(ends[begin - 1]) if begin else 0
                end = min(int(np.searchsorted(ends, before + SHARD_TOKENS - used)) + 1, len(ids))
                after = int(ends[end - 1])
                held.append((ids[begin:end], size[begin:end], words.slice(before, after - before)))
                used, begin = used + after - before, end
                if used >= SHARD_TOKENS:
                    yield shard()
                    number, used, held = number + 1, 0, []
        if held:
            yield shard()

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), tokens(F.col(text)).alias("w")).where("d IS NOT NULL")
    seen = Observation()
    rows = rows.observe(seen, F.count(F.lit(1)).alias("docs"), F.avg(F.size("w")).alias("mean"))  # counted while the texts are read
    rows.mapInArrow(run, POSTINGS).write.mode("overwrite").parquet(f"{path}/postings")
    docs.sparkSession.createDataFrame([(seen.get["docs"], seen.get["mean"])], "docs bigint, mean double").write.mode("overwrite").parquet(f"{path}/totals")
    return PostingsIndex(docs.sparkSession, path)


class PostingsIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def postings(self) -> DataFrame:
        return self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", terms: str = "terms", k1: float = 1.2, b: float = 0.75, digits: int = 6) -> DataFrame:
        """queries: query_id, terms (an array; each counts once). query_id, doc_id, score, rank; ties go to the smaller id."""
        asked = queries.select(F.col(query_id).cast("long").alias("q"), F.array_distinct(F.col(terms)).alias("t")).where("q IS NOT NULL AND size(t) > 0").toPandas()  # a batch of queries, as in ``vector.nearest``
        docs, mean = self.spark.read.parquet(f"{self.path}/totals").first()
        found, begin = None, 0
        while begin < len(asked) or found is None:
            end, seen = begin, set()
            while end < len(asked) and (end == begin or len(seen) < TERMS_AT_ONCE):
                seen.update(asked["t"][end])
                end += 1
            part = self._round(asked.iloc[begin:end], sorted(x for x in seen if x is not None), k, docs, mean, k1, b, digits)
            found, begin = part if found is None else found.unionAll(part), max(end, begin + 1)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    def _round(self, asked: pd.DataFrame, terms: list[str], k: int, docs: int, mean: float, k1: float, b: float, digits: int) -> DataFrame:
        names = self.spark.createDataFrame([(t,) for t in terms], "term string")
        rows = self.postings().join(F.broadcast(names), "term", "left_semi")
        df = {r[0]: r[1] for r in rows.groupBy("term").agg(F.sum(F.size("docs"))).collect()}  # a row a term of this round
        idf = {t: float(np.log(1 + (docs - n + 0.5) / (n + 0.5))) for t, n in df.items()}
        wanted = [(int(q), [t for t in ts if t in idf]) for q, ts in zip(asked["q"], asked["t"], strict=True)]
        shared = self.spark.sparkContext.broadcast((wanted, idf))

        def rank(shard: pd.DataFrame) -> pd.DataFrame:
            wanted, idf = shared.value
            own = {t: _List(np.asarray(d), np.asarray(tf), np.asarray(n), np.asarray(x), np.asarray(m), idf[t], k1, b, mean) for t, d, tf, n, x, m in zip(shard["term"], shard["docs"], shard["tf"], shard["size"], shard["top_tf"], shard["least_size"], strict=True)}
            out = [(q, *best(list(filter(None, (own.get(t) for t in ts))), k, digits)) for q, ts in wanted]
            return pd.DataFrame({"query_id": np.repeat([q for q, *_ in out], [len(d) for _, d, _ in out]).astype(np.int64), "doc_id": np.concatenate([d for _, d, _ in out] + [np.zeros(0, np.int64)]).astype(np.int64), "score": np.concatenate([s for *_, s in out] + [np.zeros(0)])})

        return rows.groupBy("shard").applyInPandas(rank, "query_id bigint, doc_id bigint, score double")


class _List:
    """One term's postings in a shard, with the weights that its blocks can't exceed."""

    def __init__(self, docs, tf, size, top_tf, least_size, idf, k1, b, mean):
        self.docs, self._raw, self._weigh = docs, (tf, size), lambda f, n: idf * f * (k1 + 1) / (f + k1 * (1 - b + b * n / mean))
        self.bounds = self._weigh(top_tf, least_size)
        self.top = float(self.bounds.max())
        self._weights = None

    @property
    def weights(self) -> np.ndarray:
        if self._weights is None:
            self._weights = self._weigh(*self._raw)
        return self._weights

    def lookup(self, docs: np.ndarray, worth) -> np.ndarray:
        """The weights of these documents (0 where they don't hold the term); only of those that ``worth(bounds)`` marks."""
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        there = self.docs[at] == docs
        there &= worth(np.where(there, self.bounds[at // BLOCK], 0.0))
        out = np.zeros(len(docs))
        f, n = self._raw
        out[there] = self._weigh(f[at[there]], n[at[there]])
        return out


def best(lists: list[_List], k: int, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best documents of the sum of these lists' weights, and their scores, rounded."""
    lists = sorted(lists, key=lambda x: -x.top)
    rest = np.array([x.top for x in lists])[::-1].cumsum()[::-1] if lists else np.zeros(0)  # what the lists from i on can add
    docs, score, least, i = np.zeros(0, dtype=np.int64), np.zeros(0), -np.inf, 0
    for i, x in enumerate(lists):
        if rest[i] < least:
            break
        docs, at = np.unique(np.concatenate([docs, x.docs]), return_inverse=True)
        score = np.bincount(at, np.concatenate([score, x.weights]), minlength=len(docs))
        if len(score) >= k:
            least = np.partition(score, len(score) - k)[len(score) - k] - SLACK
    else:
        i = len(lists)
    for j in range(i, len(lists)):
        left = rest[j + 1] if j + 1 < len(lists) else 0.0
        keep = score + rest[j] >= least
        docs, score = docs[keep], score[keep]
        score = score + lists[j].lookup(docs, lambda bound: score + bound + left >= least)  # noqa: B023
        if len(score) >= k:
            least = max(least, np.partition(score, len(score) - k)[len(score) - k] - SLACK)
    score = np.round(score, digits)
    order = np.lexsort((docs, -score))[:k]
    return docs[order], score[order]
