"""Adaptive retrieval: confidence, growing candidate lists, query variations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profile import EXAMPLE, Profile
from ..sources.shared import shared_folder
from . import graph
from .fuse import dynamic_boost, fuse_variations
from .vector import hashed_embedding, nearest, similarity

GOOD, POOR = 0.6, 0.4
K_STEPS = (35, 55, 75)


def confidence(hits: DataFrame, patterns: str = "boost_url_patterns", score: str = "score", rank: str = "rank") -> DataFrame:
    """query_id, confidence: 0.5, up to 0.2 for the top score, 0.1 each for varied scores and sources of the top ten, up to 0.1 for fitting URLs."""
    top = F.col(rank) <= 10
    fits = F.exists(F.col(patterns), lambda p: F.contains(F.lower("source"), F.lower(p)))
    out = hits.where(top).groupBy("query_id").agg(F.max(F.when(F.col(rank) == 1, F.col(score))).alias("s"), F.countDistinct(score).alias("a"), F.countDistinct("source").alias("b"), F.count(F.when(fits, 1)).alias("h"))
    total = 0.5 + F.least(0.2 * F.col("s"), F.lit(0.2)) + F.when(F.col("a") > 5, 0.1).otherwise(0.0) + F.when(F.col("b") > 5, 0.1).otherwise(0.0) + F.least(F.col("h") / 10, F.lit(0.1))
    return out.select("query_id", F.least(F.lit(1.0), total).alias("confidence"))


def boosted(hits: DataFrame, profile: Profile = EXAMPLE) -> DataFrame:
    """Vector hits with the dynamic URL boost, in their new order."""
    s = hits.withColumn("url_boost", dynamic_boost(F.col("source"), F.col("boost_url_patterns"), F.col("domain_hints"), profile))
    s = s.withColumn("score", F.col("score") * F.col("url_boost"))
    return s.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "rank")))


def adaptive(hits: DataFrame, steps=K_STEPS, good: float = GOOD) -> DataFrame:
    """The smallest candidate list (35, 55, 75 hits) whose confidence suffices, else the most confident: the hits with k and confidence.

    All lists come from one ranking of the largest; nothing is searched again.
    """
    tried = None
    for i, k in enumerate(steps):
        c = confidence(hits.where(F.col("rank") <= k)).select("query_id", F.lit(i).alias("i"), F.lit(k).alias("k"), "confidence")
        tried = c if tried is None else tried.unionAll(c)
    first = F.min(F.when(F.col("confidence") >= good, F.col("i")))
    best = F.max(F.struct("confidence", (-F.col("i")).alias("j"), "k"))
    pick = tried.groupBy("query_id").agg(first.alias("f"), best.alias("b"), F.array_sort(F.collect_list(F.struct("i", "k", "confidence"))).alias("all"))
    at = F.element_at("all", F.col("f") + 1)
    pick = pick.select("query_id", F.when(F.col("f").isNotNull(), at["k"]).otherwise(F.col("b.k")).alias("k"), F.when(F.col("f").isNotNull(), at["confidence"]).otherwise(F.col("b.confidence")).alias("confidence"))
    return hits.join(pick, "query_id").where(F.col("rank") <= F.col("k"))


def adapted_strategy(graph_weight: Column, confidence: Column) -> Column:
    """Struct (graph_weight, use_entity_aggregation) after a poor round."""
    poor = confidence < POOR
    return F.struct(F.when(poor, graph_weight * 1.5).otherwise(graph_weight).alias("graph_weight"), poor.alias("use_entity_aggregation"))


def variations(queries: DataFrame, hyde=None, multi=None, rewrite=None, most: int = 5) -> DataFrame:
    """query_id, variation, text: the question, then what models make of it (functions of a column to an array), five at most."""
    parts = [F.array(F.col("query"))] + [f(F.col("query")) for f in (hyde, multi, rewrite) if f is not None]
    rows = queries.select("query_id", F.posexplode(F.slice(F.array_distinct(F.concat(*parts)), 1, most)).alias("variation", "text"))
    return rows


def prefiltered(hits: DataFrame, least: float = 0.3, k: int = 25) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("query_id", "variation").orderBy(F.desc("score"), "source"))
    return hits.where(F.col("score") > least).withColumn("rank", r - 1).where(F.col("rank") < k)


def fused_variations(hits: DataFrame, top: int | None = None) -> DataFrame:
    """Hits of all variations (query_id, variation, source, score): filtered, ranked and fused."""
    return fuse_variations(prefiltered(hits), "source", top)


#: Candidates of the first round, how many more a later one has, at most; rounds.
FIRST_K, MORE_K, MOST_K, ROUNDS = 35, 20, 80, 3
HIT = "query_id bigint, source string, title string, text string, score double, source_type string, rank int"


def vector_hits(asked: DataFrame, corpus: DataFrame, k: int, embedder=None, profile: Profile = EXAMPLE, metric: str = "l2") -> DataFrame:
    """The nearest int(k * vector_weight) rows of each query with its expansion terms, in the order of their boosted similarity."""
    s = F.col("search_strategy")
    most = (k * s["vector_weight"]).cast("int")
    texts = asked.withColumn("v", (embedder or hashed_embedding)(F.concat("query", F.lit(" "), F.array_join("expansion_terms", " "))))
    largest = asked.agg(F.max(most)).first()[0] or 0
    if not largest:
        return asked.sparkSession.createDataFrame([], HIT)
    found = nearest(texts, corpus, largest, metric, query_vector="v").join(asked.select("query_id", most.alias("most"), s["boost_url_patterns"].alias("boost_url_patterns"), "domain_hints"), "query_id").where(F.col("rank") <= F.col("most"))
    hits = found.join(corpus.select("doc_id", "source", "title", "text"), "doc_id").withColumn("score", similarity(F.col("distance")))
    return boosted(hits, profile).select("query_id", "source", "title", "text", "score", F.lit("vector").alias("source_type"), "rank")


def graph_hits(asked: DataFrame, mentions: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """Entities for each query: those of its type and domain where its strategy aggregates, else int(0.3 * k) whose names hold a keyword."""
    listing = F.col("search_strategy.use_entity_aggregation")
    listed = graph.aggregate_entities(asked.where(listing).select("query_id", "entities"), mentions, pages)
    listed = listed.withColumns({"text": F.format_string("%s (%s) - Mentioned %s times", "entity_name", "entity_type", "total_mentions"), "source_type": F.lit("graph_entity")})
    plain = asked.where(~listing).select("query_id", F.col("entities.keywords").alias("keywords"))
    found = graph.named_entities(plain, mentions, pages, int(k * 0.3)).withColumns({"text": F.format_string("Entity: %s (%s)", "entity_name", "entity_type"), "source_type": F.lit("graph")})
    cols = ["query_id", "source", "title", "text", "score", "source_type", "rank"]
    return listed.select(*cols).unionByName(found.select(*cols))


def in_turn(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two rankings of each query, one behind the other."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_o", "rank"))).drop("_o")


def adaptive_retrieve(asked: DataFrame, search: Callable[[DataFrame, int], DataFrame], rounds: int = ROUNDS, first_k: int = FIRST_K, more: int = MORE_K, most: int = MOST_K, good: float = GOOD) -> DataFrame:
    """Searches in rounds until each query's hits are trusted: the hits of its best round, with k, confidence, rounds and the strategy at the end.

    asked: analysed queries (query_id, search_strategy, ...). ``search(asked, k)`` gives their ranked hits (query_id, source, score, rank and more);
    it is called once a round, for the queries that are left. A query leaves when its confidence is ``good``; else k grows, and after a poor round
    its graph weight grows and entities are aggregated. Of equal confidence the earlier round counts. Hits of each round are written to the shared
    folder, so that nothing is searched twice and later rounds don't grow the plan. A query that never has hits is not in the result.
    """
    spark, folder = asked.sparkSession, shared_folder(asked.sparkSession, "adaptive")
    left, tried, hits, k = asked, None, None, first_k
    for n in range(rounds):
        path = f"{folder}/{n}"
        own = search(left, k).withColumn("round", F.lit(n))
        own.write.parquet(f"{path}/hits")
        own = spark.read.schema(own.schema).parquet(f"{path}/hits")
        rated = confidence(own.join(left.select("query_id", F.col("search_strategy.boost_url_patterns").alias("boost_url_patterns")), "query_id"))
        state = left.join(rated, "query_id", "left").withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        strategy = adapted_strategy(F.col("search_strategy.graph_weight"), F.col("confidence"))
        s = F.col("search_strategy")
        changed = s.withField("graph_weight", strategy["graph_weight"]).withField("use_entity_aggregation", s["use_entity_aggregation"] | strategy["use_entity_aggregation"])
        state = state.withColumns({"round": F.lit(n), "k": F.lit(k), "search_strategy": F.when(F.col("confidence") >= good, s).otherwise(changed)})
        state.write.parquet(f"{path}/state")
        state = spark.read.schema(state.schema).parquet(f"{path}/state")
        tried, hits = (state, own) if tried is None else (tried.unionByName(state), hits.unionByName(own))
        left = state.where(F.col("confidence") < good).select(*asked.columns)
        if left.isEmpty():
            break
        k = min(k + more, most)
    last = F.max_by("search_strategy", "round")
    pick = tried.groupBy("query_id").agg(F.max(F.struct("confidence", (-F.col("round")).alias("r"), "k")).alias("b"), (F.max("round") + 1).alias("rounds"), last["graph_weight"].alias("graph_weight"), last["use_entity_aggregation"].alias("use_entity_aggregation"))
    pick = pick.select("query_id", (-F.col("b.r")).alias("round"), F.col("b.k").alias("k"), F.col("b.confidence").alias("confidence"), "rounds", "graph_weight", "use_entity_aggregation")
    return hits.join(pick, ["query_id", "round"]).drop("round")


def knowledge_search(corpus: DataFrame, mentions: DataFrame, pages: DataFrame, embedder=None, profile: Profile = EXAMPLE) -> Callable[[DataFrame, int], DataFrame]:
    """The search of ``adaptive_retrieve`` over chunks (doc_id, source, title, text, embedding), mentions and pages (page_id, url, title)."""
    return lambda asked, k: in_turn(vector_hits(asked, corpus, k, embedder, profile), graph_hits(asked, mentions, pages, k))
