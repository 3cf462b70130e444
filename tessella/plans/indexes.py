"""Registered queries over indexes, dictionaries, ledgers and rounds, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adaptive, dictionary, experiments, fuse, learned_rank, postings, rerank, statistical_keywords, vector
from ..operators.vector_index import VectorIndex
from ..sources import answers, stores
from ..sources.shared import shared_folder
from . import sql as S
from .queries import ORACLES, QUERIES, _asked, _found, _page_hits, _t, _vectors, _wide, query

__all__ = ["ORACLES", "QUERIES"]

_WORD = r"[\p{L}\p{N}_]+"


@query("knn_indexed", S.knn("l2"))
def knn_indexed(spark, sf):
    """The same rows as the scan, through cells that bounds can rule out."""
    index = VectorIndex.build(_vectors(spark, sf), shared_folder(spark, "cells"))
    return _found(index.search_exact(_asked(spark, sf), 50))


@query("bm25_indexed", S.BM25)
def bm25_indexed(spark, sf):
    """The same rows as the scan, from postings with block bounds."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0))
    asked = _t(spark, sf, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query_id"), words.alias("terms"))
    index = postings.build(_wide(spark, sf, "documents").select("doc_id", "text"), shared_folder(spark, "postings"))
    return index.search(asked, 10).withColumn("rank", F.col("rank").cast("int"))


@query("statistical_keywords")
def keywords(spark, sf):
    return statistical_keywords.keywords(_wide(spark, sf, "documents").select("doc_id", "text"))


@query("dictionary_mentions", f"""
WITH b AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM benchmark),
n AS (SELECT DISTINCT array_to_string(w[i:i + 2], ' ') AS name FROM b, unnest(range(1, len(w) - 1)) t(i)),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{_WORD}') AS w FROM documents),
g AS (SELECT doc_id, array_to_string(w[i:i + 2], ' ') AS name FROM d, unnest(range(1, len(w) - 1)) t(i))
SELECT doc_id, name, count(*) AS count FROM g JOIN n USING (name) GROUP BY ALL""")
def dictionary_mentions(spark, sf):
    """All phrases of three words of the benchmark as names, in whole documents, over runs of words with single spaces."""
    spaced = F.array_join(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_WORD), F.lit(0)), " ")
    w = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_WORD), F.lit(0))
    phrases = F.transform(F.when(F.size("w") >= 3, F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1)))), lambda i: F.array_join(F.slice("w", i, 3), " "))
    names = _t(spark, sf, "benchmark").select(w.alias("w")).select(F.explode(phrases).alias("name"))
    return dictionary.occurrences(_wide(spark, sf, "documents").select("doc_id", spaced.alias("text")), names, ["doc_id"]).select("doc_id", "name", "count")


_C = {k: S._conf(f"rank <= {min(10, k)}", ("/nowhere/",)) for k in (3, 6, 9)}


@query("adaptive_retrieve", f"""
WITH {S._PH}, c AS (SELECT query_id, count(*) AS n, CASE WHEN query_id = 6 THEN 0.0 ELSE {_C[3]} END AS c3, {_C[6]} AS c6, {_C[9]} AS c9 FROM h GROUP BY 1),
p AS (SELECT *, CASE WHEN c3 >= 0.65 THEN 3 WHEN c6 >= 0.65 THEN 6 WHEN c9 >= 0.65 THEN 9 WHEN c3 >= greatest(c6, c9) THEN 3 WHEN c6 >= c9 THEN 6 ELSE 9 END AS k FROM c)
SELECT query_id, k::INT AS k, round(CASE k WHEN 3 THEN c3 WHEN 6 THEN c6 ELSE c9 END, 6)::DOUBLE AS confidence, (CASE WHEN c3 >= 0.65 THEN 1 WHEN c6 >= 0.65 THEN 2 ELSE 3 END)::INT AS rounds,
  CASE WHEN c3 < 0.4 THEN 1.5 ELSE 1.0 END::DOUBLE AS graph_weight, c3 < 0.4 AS use_entity_aggregation, least(n, k) AS hits FROM p""")
def adaptive_retrieve(spark, sf):
    """Rounds over given hits; one query finds nothing until its strategy aggregates entities."""
    hits = _page_hits(spark, sf).select("query_id", "source", "score", "rank")
    strategy = F.struct(F.lit(1.0).alias("vector_weight"), F.lit(1.0).alias("graph_weight"), F.lit(False).alias("use_entity_aggregation"), F.array(F.lit("/nowhere/")).alias("boost_url_patterns"))
    asked = hits.select("query_id").distinct().withColumn("search_strategy", strategy)

    def search(left, k):
        found = (F.col("query_id") != 6) | F.col("search_strategy.use_entity_aggregation")
        return hits.join(left.where(found).select("query_id"), "query_id").where(F.col("rank") <= k)

    out = adaptive.adaptive_retrieve(asked, search, first_k=3, more=3, most=12, good=0.65)
    return out.groupBy("query_id", F.col("k").cast("int").alias("k"), F.round("confidence", 6).alias("confidence"), F.col("rounds").cast("int").alias("rounds"), "graph_weight", "use_entity_aggregation").agg(F.count(F.lit(1)).alias("hits"))


@query("ledger_edges", "SELECT source AS src_key, lang AS dst_key, sum(n_chars)::BIGINT AS count FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY 1, 2")
def ledger_edges(spark, sf):
    """Edges added in three commits, each of which comes twice, merged by a read."""
    store = stores.GraphStore(spark, shared_folder(spark, "graph"))
    rows = _t(spark, sf, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select(
        F.lit("Source").alias("src_label"), F.col("source").alias("src_key"), F.lit("IN").alias("rel"), F.lit("Language").alias("dst_label"), F.col("lang").alias("dst_key"), F.col("n_chars").cast("long").alias("count"), F.create_map(F.lit("kind"), F.lit("text")).alias("props"), F.pmod("doc_id", F.lit(3)).alias("part"))
    for n in (0, 1, 2, 2, 0):
        store.add(edges=rows.where(F.col("part") == n).groupBy("src_label", "src_key", "rel", "dst_label", "dst_key").agg(F.sum("count").alias("count"), F.first("props").alias("props")), source=("load", n))
    return store.edges().select("src_key", "dst_key", "count")


@query("ranking_quality", f"""
WITH {S._PH}, r AS (SELECT query_id, page_id % 5 % 3 AS g, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS r, row_number() OVER (PARTITION BY query_id ORDER BY page_id % 5 % 3 DESC, page_id) AS b FROM h),
s AS (SELECT query_id, sum(CASE WHEN r <= 10 THEN (pow(2.0, g) - 1) / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN b <= 10 THEN (pow(2.0, g) - 1) / log2(b + 1) ELSE 0 END) AS ideal FROM r GROUP BY 1)
SELECT query_id, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 9)::DOUBLE AS ndcg FROM s""")
def ranking_quality(spark, sf):
    hits = _page_hits(spark, sf).withColumn("gain", F.col("page_id") % 5 % 3)
    return learned_rank.ndcg(hits, "score", tie="page_id").select("query_id", F.round("ndcg", 9).alias("ndcg"))


@query("learned_order")
def learned_order(spark, sf):
    """All page hits in the order of a model of the ten signals, taught on the even queries' gains."""
    hits = rerank.stage4(fuse.intelligence_boost(_page_hits(spark, sf)).withColumn("stage3_score", F.col("score"))).withColumn("gain", F.col("matches_dept").cast("int") * 2 + (F.col("page_type") == "faculty").cast("int"))
    signal = lambda n: F.col("signal_scores")[n]
    model = learned_rank.train(hits.where("query_id % 2 = 0"), list(rerank.signals()), signal)
    return hits.select("query_id", "page_id", F.round(model.score(signal), 6).alias("score"), "gain")


_UNIT = "(('0x' || md5('ab/' || {0})[1:8])::BIGINT % 10000)"


@query("variant_shares", f"SELECT user_id, CASE WHEN {_UNIT.format('user_id')} < 2500 THEN 'new' WHEN {_UNIT.format('user_id')} < 7500 THEN 'old' END AS variant, count(*) AS events FROM events GROUP BY 1, 2")
def variant_shares(spark, sf):
    """The variant of each user, with their events."""
    return _t(spark, sf, "events").groupBy("user_id", experiments.assigned(F.col("user_id"), "ab", {"new": 0.25, "old": 0.5}).alias("variant")).agg(F.count(F.lit(1)).alias("events"))


@query("interleaved_ranking", f"""
WITH {S._PH}, a AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS r FROM h), b AS (SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY page_id * 7 % 31, page_id) AS r FROM h),
j AS (SELECT query_id, page_id, a.r AS ra, b.r AS rb, {_UNIT.format('query_id')} < 5000 AS f FROM (SELECT * FROM a WHERE r <= 20) a FULL JOIN (SELECT * FROM b WHERE r <= 20) b USING (query_id, page_id)),
k AS (SELECT *, coalesce(ra, 2147483647) AS x, coalesce(rb, 2147483647) AS y FROM j)
SELECT query_id, page_id, row_number() OVER (PARTITION BY query_id ORDER BY least(x, y), CASE WHEN (x <= y) = f OR x = y THEN 0 ELSE 1 END, page_id)::INT AS rank FROM k""")
def interleaved_ranking(spark, sf):
    """Two rankings of each query, the first twenty of each, as one."""
    h = _page_hits(spark, sf)
    a = rerank_by(h, F.desc("score"))
    b = rerank_by(h, F.col("page_id") * 7 % 31)
    return experiments.interleaved(a.where("rank <= 20"), b.where("rank <= 20"), "ab", "page_id").select("query_id", "page_id", F.col("rank").cast("int").alias("rank"))


def rerank_by(hits, order):
    from pyspark.sql import Window

    return hits.select("query_id", "page_id", F.row_number().over(Window.partitionBy("query_id").orderBy(order, "page_id")).alias("rank"))


@query("cached_questions", """
WITH q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings WHERE vec_id % 100 = 0), e AS (SELECT vec_id AS doc_id, list_transform(embedding, lambda x: x::DOUBLE) AS b FROM embeddings WHERE vec_id % 100 <> 0 AND label <> 3),
d AS (SELECT query_id, doc_id, round(1 - list_dot_product(a, b) / sqrt(list_dot_product(a, a)) / sqrt(list_dot_product(b, b)), 9) AS d FROM q, e)
SELECT query_id, doc_id, round(1 - d, 9)::DOUBLE AS similarity FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) = 1 AND round(1 - d, 9) >= 0.4""")
def cached_questions(spark, sf):
    """Vectors as questions: the most similar one that is not too old (its label), if it is similar enough."""
    earlier = _vectors(spark, sf).where("doc_id % 100 <> 0 AND page_type <> '3'")
    return answers.matches(_asked(spark, sf), earlier, 0.4)


@query("conversation_rerank", f"""
WITH {S._PH}, f AS (SELECT conv_id % 7 AS query_id, min(conv_id) AS conv_id FROM conversations WHERE turn = 0 GROUP BY 1),
e AS (SELECT f.query_id, list_distinct(list_filter(regexp_extract_all(lower(text), '{_WORD}'), lambda w: length(w) >= 8)) AS es FROM f JOIN conversations c ON c.conv_id = f.conv_id AND c.turn = 0),
m AS (SELECT h.page_id, h.query_id, h.rank, h.score, coalesce(len(list_filter(es, lambda w: contains(lower(coalesce(h.text, '')), w))) > 0, false) AS hit FROM h LEFT JOIN e ON h.query_id = e.query_id)
SELECT query_id, page_id, hit AS history_match, row_number() OVER (PARTITION BY query_id ORDER BY round(CASE WHEN hit THEN score * 1.3 ELSE score END, 12) DESC, rank)::INT AS rank FROM m""")
def conversation_rerank(spark, sf):
    """Page hits after a conversation: the longer words of a first turn stand for the entities spoken of."""
    first = _t(spark, sf, "conversations").where("turn = 0").withColumn("query_id", F.col("conv_id") % 7)
    said = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(_WORD), F.lit(0)), lambda w: F.length(w) >= 8))
    history = first.groupBy("query_id").agg(F.min_by("text", "conv_id").alias("text")).select("query_id", said.alias("entities"))
    out = rerank.conversation_rerank(_page_hits(spark, sf), history)
    return out.select("query_id", "page_id", "history_match", F.col("rank").cast("int").alias("rank"))
