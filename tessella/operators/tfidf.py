"""Keywords by tf-idf without moving the texts' terms: frequencies by hash, then only as many candidates as the answer needs.

1. One pass counts in how many texts each term's hash occurs. Tasks add up before they send (hash, count), 16 bytes each; terms of a single text are not kept.
2. The most frequent hashes, KNOWN at most, are broadcast with their counts. The score of any other term is at most its count in the text times the idf of a term
   of one text. Each text sends its FIRST best candidates by that bound, in the order (bound, term), and the bound of the next one. They meet their frequencies by
   hash. A text is done when k of its scores come before anything unsent; the others send GROW times as many in the next round. So the
   rounds end, and every text's k best are exact (but for two terms with one 64-bit hash).

Terms are words and pairs of neighbouring words, without stop words and words of one or two characters. Null texts have none.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import STOP_WORDS
from ..sources.shared import shared_folder

FIRST, GROW = 4, 8
#: Hashes that a task adds up before it sends their counts (32 MB).
HELD = 4_000_000
#: Frequent hashes that go to all tasks (16 bytes each; some 100 in a worker's table).
KNOWN = 300_000
#: Candidates that a task gathers before it sends them (some 500 bytes each in Python).
SENT = 50_000
#: Bounds nearer than this are not told apart: scores are rounded before they are ranked.
NEAR = 2e-6
#: Texts that are left up to which their ids are broadcast in a later round.
BROADCAST_TEXTS = 1_000_000
_WORD = re.compile(r"\w+")


def _terms(low: str, stop: frozenset[str]) -> Counter:
    w = [x for x in _WORD.findall(low) if len(x) > 2 and x not in stop]
    return Counter(w) + Counter([f"{a} {b}" for a, b in zip(w, w[1:], strict=False)])


def _hash(term: str) -> int:
    return xxhash.xxh64_intdigest(term) - (1 << 63)


def frequencies(low: DataFrame, stop: frozenset[str]) -> DataFrame:
    """hash, df of the terms of at least two texts (rows of low: text in lower case)."""

    def run(batches: Iterator[pa.RecordBatch]):
        held, size = [], 0

        def sums():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["hash", "n"])

        for b in batches:
            for t in b.column(0):
                own = np.fromiter((_hash(x) for x in _terms(t.as_py(), stop)), dtype=np.int64)
                held.append(own)
                size += len(own)
                if size >= HELD:
                    yield sums()
                    held, size = [], 0
        if held:
            yield sums()

    return low.mapInArrow(run, "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("df")).where("df > 1")


def most_frequent(df: DataFrame, most: int = KNOWN) -> dict[int, int]:
    """Frequencies of all hashes above the lowest power of two that at most ``most`` exceed."""
    steps = [1 << i for i in range(1, 40)]
    above = df.agg(*[F.count_if(F.col("df") > t) for t in steps]).first()
    least = next((t for t, n in zip(steps, above, strict=True) if n <= most), None)
    return {} if least is None else {r[0]: r[1] for r in df.where(F.col("df") > least).select("hash", "df").collect()}  # at most KNOWN rows


def _candidates(rows: DataFrame, keys: list[str], stop: frozenset[str], most: int, known: dict[int, int], texts: int) -> DataFrame:
    """keys, keyword, tf, hash of each text's ``most`` candidates, with next_tf, next_df (1: not known) and next_keyword of the first one that isn't sent (null: none); apart: no later one is near its bound."""
    n, shared = len(keys), rows.sparkSession.sparkContext.broadcast(known)

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())

    def sent(b: pa.RecordBatch, at: list[int], out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) or [()] * 7
        own = [b.column(c).take(pa.array(at, pa.int64())) for c in range(n)]
        return pa.RecordBatch.from_arrays([*own, *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=[*b.schema.names[:n], "keyword", "tf", "hash", "next_tf", "next_df", "next_keyword", "apart"])

    def run(batches: Iterator[pa.RecordBatch]):
        known = shared.value
        idf = {d: math.log((1 + texts) / (1 + d)) for d in {1, *known.values()}}
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column(n)):
                rated = []
                for term, tf in _terms(t.as_py(), stop).items():
                    h = _hash(term)
                    d = known.get(h, 1)
                    rated.append((-tf * idf[d], term, tf, h, d))
                rated.sort()
                after, apart = (None, None, None), True
                if len(rated) > most:
                    bound, term, tf, _, d = rated[most]
                    after = (tf, d, term)
                    apart = next((x[0] - bound > NEAR for x in rated[most + 1 :] if x[0] != bound), True)
                for _, term, tf, h, _ in rated[:most]:
                    at.append(i)
                    out.append((term, tf, h, *after, apart))
                if len(out) >= SENT:  # of a batch too: a later round sends thousands of candidates a text
                    yield sent(b, at, out)
                    at, out = [], []
            yield sent(b, at, out)

    made = [T.StructField(c, k) for c, k in (("keyword", T.StringType()), ("tf", T.LongType()), ("hash", T.LongType()), ("next_tf", T.LongType()), ("next_df", T.LongType()), ("next_keyword", T.StringType()), ("apart", T.BooleanType()))]
    return rows.mapInArrow(run, T.StructType([*rows.select(*keys).schema.fields, *made]))


def keywords(docs: DataFrame, k: int = 10, doc_id: str = "doc_id", text: str = "text", stop=STOP_WORDS, digits: int = 6) -> DataFrame:
    """doc_id, keyword, score, rank: the k terms of highest tf * ln((1 + texts) / (1 + df)) of each text, ties by term. Ids have to be unique and not null."""
    spark, folder, words = docs.sparkSession, shared_folder(docs.sparkSession, "keywords"), frozenset(stop)
    low = docs.select(F.col(doc_id), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    frequencies(low.select("text"), words).write.parquet(f"{folder}/df")
    df, n = spark.read.parquet(f"{folder}/df"), docs.count()
    known = most_frequent(df)
    rated = lambda tf, d: F.round(F.col(tf) * F.log(F.lit(float(1 + n)) / (1 + d)), digits)
    out, left, most, number = None, low, FIRST * k if n > 1 else 1 << 60, 0  # of a single text all scores are equal
    while True:
        rows = _candidates(left, [doc_id], words, most, known, n).join(df, "hash", "left")
        rows = rows.withColumn("score", rated("tf", F.coalesce("df", F.lit(1)))).drop("hash", "tf", "df")
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(doc_id).orderBy(F.desc("score"), "keyword"))).where(F.col("rank") <= k)
        own = Window.partitionBy(doc_id)
        worst, bound = F.max(F.struct((-F.col("score")).alias("s"), F.col("keyword").alias("w"))).over(own), rated("next_tf", F.col("next_df"))
        over = -F.col("worst.s") - bound
        before = (over > NEAR) | ((F.abs(over) <= NEAR) & F.col("apart") & (-F.col("worst.s") >= bound) & (F.col("worst.w") < F.col("next_keyword")))
        rows = rows.withColumns({"worst": worst, "of": F.count(F.lit(1)).over(own)}).withColumn("sure", F.col("next_tf").isNull() | ((F.col("of") == k) & before))
        rows.select(doc_id, "keyword", "score", "rank", "sure").write.parquet(f"{folder}/{number}")
        rows = spark.read.parquet(f"{folder}/{number}")
        done = rows.where("sure").drop("sure")
        out = done if out is None else out.unionByName(done)
        open_ids = rows.where("NOT sure").select(doc_id).distinct()
        many = open_ids.count()
        if not many:
            return out.select(doc_id, "keyword", "score", F.col("rank").cast("int").alias("rank"))
        left = low.join(F.broadcast(open_ids) if many <= BROADCAST_TEXTS else open_ids, doc_id, "left_semi")
        most, number = most * GROW, number + 1
