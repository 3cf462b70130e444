"""Learned ranking on held-out queries, ranking quality, interleaving, stable assignment, the answer cache."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessella.operators import experiments, learned_rank
from tessella.sources import answers


def judged_hits(queries=60, each=20, seed=2):
    """Hits whose gain follows two of four signals, in opposite directions; the product of all four is a poor order."""
    rnd = random.Random(seed)
    rows = []
    for q in range(queries):
        for d in range(each):
            s = [rnd.random() for _ in range(4)]
            worth = 3 * s[0] - 2 * s[2] + 0.3 * rnd.random()
            rows.append((q, d, *[x if rnd.random() > 0.02 else None for x in s], int(max(0, min(3, round(worth + 0.5))))))
    return rows


def test_learned_order_beats_the_product_on_unseen_queries(spark):
    hits = spark.createDataFrame(judged_hits(), "query_id int, doc_id int, a double, b double, c double, d double, gain int")
    names = ["a", "b", "c", "d"]
    model = learned_rank.train(hits.where("query_id < 40"), names, F.col)
    product = F.lit(1.0)
    for n in names:
        product = product * F.coalesce(F.col(n), F.lit(0.5))
    held = hits.where("query_id >= 40").withColumns({"learned": model.score(F.col), "product": product}).cache()
    quality = {s: learned_rank.ndcg(held, s).agg(F.avg("ndcg")).first()[0] for s in ("learned", "product")}
    assert quality["learned"] > 0.95 > 0.8 > quality["product"]
    assert model.weights[0] > 0 > model.weights[2]
    small = learned_rank.sample(hits, 300)
    kept = {r.query_id: r.n for r in small.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert 0 < sum(kept.values()) < 700 and set(kept.values()) == {20}  # whole queries
    empty = learned_rank.train(hits.limit(0), names, F.col)
    assert empty.weights == (0.0,) * 4 and held.select(empty.score(F.col)).distinct().count() == 1


def test_ndcg(spark):
    rows = [(1, 1, 0.9, 0), (1, 2, 0.8, 3), (1, 3, 0.7, 1), (2, 1, 0.1, 0), (3, 1, None, 2), (3, 2, 0.5, None)]
    got = {r.query_id: r.ndcg for r in learned_rank.ndcg(spark.createDataFrame(rows, "query_id int, doc_id int, s double, gain int"), "s").collect()}
    want = (7 / math.log2(3) + 1 / 2) / (7 + 1 / math.log2(3))
    assert got == pytest.approx({1: want, 2: 0.0, 3: 1 / math.log2(3)})


def test_assignment_is_stable_and_independent(spark):
    users = spark.range(20_000).withColumns({"a": experiments.assigned(F.col("id"), "one", {"x": 0.2, "y": 0.3}), "b": experiments.assigned(F.col("id"), "two", {"x": 0.5, "y": 0.5})})
    rows = users.collect()
    assert [r.a for r in users.repartition(3).orderBy("id").collect()] == [r.a for r in sorted(rows, key=lambda r: r.id)]
    n = Counter((r.a, r.b) for r in rows)
    assert sum(v for (a, _), v in n.items() if a == "x") == pytest.approx(4000, rel=0.06) and sum(v for (a, _), v in n.items() if a is None) == pytest.approx(10_000, rel=0.06)
    assert n["x", "x"] == pytest.approx(2000, rel=0.1)  # one experiment's groups are spread over the other's


def test_interleaving_is_balanced(spark):
    rnd = random.Random(4)
    a, b = [], []
    for q in range(40):
        docs = list(range(30))
        a += [(q, d, i) for i, d in enumerate(rnd.sample(docs, 10), 1)]
        b += [(q, d, i) for i, d in enumerate(rnd.sample(docs, 10), 1)]
    frame = lambda rows: spark.createDataFrame(rows, "query_id int, doc_id int, rank int")
    shown = experiments.interleaved(frame(a), frame(b), "e")
    by = defaultdict(list)
    for r in sorted(shown.collect(), key=lambda r: (r.query_id, r["rank"])):
        by[r.query_id].append(r)
    first = {q: rows[0].a_first for q, rows in by.items()}
    assert 8 < sum(first.values()) < 32
    for q, rows in by.items():
        assert len({r.doc_id for r in rows}) == len(rows)
        best = [min(r.rank_a or 99, r.rank_b or 99) for r in rows]
        assert best == sorted(best)
        for n in range(1, len(rows) + 1):  # whoever is shown, all of better rank in either ranking are shown before
            seen = {r.doc_id for r in rows[:n]}
            assert all(d in seen for s in (a, b) for x, d, rank in s if x == q and rank < best[n - 1])
        for r, other in zip(rows, rows[1:], strict=False):
            if min(r.rank_a or 99, r.rank_b or 99) == min(other.rank_a or 99, other.rank_b or 99):
                assert ((r.rank_a or 99) <= (r.rank_b or 99)) == first[q]
    clicks = frame([x for x in a if x[2] <= 2]).select("query_id", "doc_id")
    won = Counter(r.winner for r in experiments.preferences(shown, clicks).collect())
    assert won["a"] > 3 * won["b"]


def test_answer_cache(spark, tmp_path):
    at = lambda s: F.lit(f"2024-05-05 12:00:{s:02d}").cast("timestamp")
    cache = answers.AnswerCache(spark, str(tmp_path / "a"), max_age="30 seconds")
    calls = []

    def ask(left):
        calls.append(sorted(r["query"] for r in left.collect()))
        return left.withColumn("answer", F.concat(F.lit("about "), "query"))

    questions = spark.createDataFrame([(1, "who leads the vision lab"), (2, "list all courses")], "query_id int, query string")
    first = {r.query_id: (r.answer, r.hit) for r in cache.answer(questions, ask, at(0)).collect()}
    assert first == {1: ("about who leads the vision lab", False), 2: ("about list all courses", False)}
    again = spark.createDataFrame([(7, "Who leads  the VISION lab"), (8, "something new")], "query_id int, query string")
    got = {r.query_id: (r.answer, r.hit) for r in cache.answer(again, ask, at(10)).collect()}
    assert got == {7: ("about who leads the vision lab", True), 8: ("about something new", False)}
    assert calls == [["list all courses", "who leads the vision lab"], ["something new"]]
    hits = {r.query_id: r.hit for r in cache.get(spark.createDataFrame([(1, "list all courses"), (2, "something new"), (3, "unheard of")], "query_id int, query string"), at(35)).collect()}
    assert hits == {1: False, 2: True, 3: False}  # the first answers are too old
    cache.expire(at(35))
    assert cache.ledger.read("answers", answers.ANSWERS).count() == 1 and cache.ledger.batches("answers") == 1
