"""A semantic cache: answers of earlier questions for questions that mean the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vector import hashed_embedding, nearest
from .ledger import Ledger

ANSWERS = "answer_id string, query string, answer string, embedding array<double>, created_at timestamp"


def matches(asked: DataFrame, earlier: DataFrame, least: float = 0.95) -> DataFrame:
    """query_id, doc_id, similarity: for each vector (query_id, query_vector) the most similar earlier one (doc_id, embedding), if the cosine is at least ``least``; ties go to the smaller id."""
    found = nearest(asked, earlier, 1, "cosine", digits=9)
    return found.withColumn("similarity", F.round(1 - F.col("distance"), 9)).where(F.col("similarity") >= least).select("query_id", "doc_id", "similarity")


class AnswerCache:
    """Answers under a path. Adding writes the new rows alone; old answers don't count after ``max_age`` (an interval) and go with ``expire``."""

    def __init__(self, spark: SparkSession, path: str, embedder=None, least: float = 0.95, max_age: str = "7 days"):
        self.ledger, self.embedder, self.least, self.max_age = Ledger(spark, path), embedder or hashed_embedding, least, max_age

    def _fresh(self, now: Column) -> DataFrame:
        rows = self.ledger.read("answers", ANSWERS).drop("_seq")
        return rows.where((F.col("created_at") >= now - F.expr(f"INTERVAL {self.max_age}")) & (F.col("created_at") <= now))

    def put(self, answered: DataFrame, now: Column) -> None:
        """answered: query, answer."""
        rows = answered.select(F.md5(F.concat_ws("\u0001", "query", now.cast("string"))).alias("answer_id"), "query", "answer", self.embedder(F.col("query")).cast("array<double>").alias("embedding"), now.alias("created_at"))
        self.ledger.add({"answers": (rows.dropDuplicates(["answer_id"]), ANSWERS)})

    def get(self, questions: DataFrame, now: Column) -> DataFrame:
        """questions (query_id, query) with answer, cached_query, similarity, hit; without a match these are null and hit is false."""
        fresh = self._fresh(now)
        found = matches(questions.select("query_id", self.embedder(F.col("query")).alias("query_vector")), fresh.withColumnRenamed("answer_id", "doc_id"), self.least)
        own = found.join(fresh.select(F.col("answer_id").alias("doc_id"), F.col("query").alias("cached_query"), "answer"), "doc_id").drop("doc_id")
        return questions.join(own, "query_id", "left").withColumn("hit", F.col("answer").isNotNull())

    def answer(self, questions: DataFrame, ask, now: Column) -> DataFrame:
        """Answers from the cache where it has them; the others from ``ask`` (questions to query_id, query, answer), which are kept. query_id, query, answer, hit."""
        got = self.get(questions, now)
        known = got.where("hit").select("query_id", "query", "answer", "hit")
        made = ask(got.where("NOT hit").select("query_id", "query")).select("query_id", "query", "answer").persist()
        self.put(made.where(F.col("answer").isNotNull()).select("query", "answer"), now)
        return known.unionByName(made.withColumn("hit", F.lit(False)))

    def expire(self, now: Column) -> None:
        base = self.ledger.state()[0]
        self.ledger.replace({"answers": (self._fresh(now), ANSWERS)}, base)
