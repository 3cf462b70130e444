"""Whole flows: hybrid retrieval, answering, ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.profile import EXAMPLE, Profile
from ..functions.text import chunks
from ..operators import analyze, context, entities, fuse, graph, pages, rerank
from ..operators.vector import embed, filtered, hashed_embedding, nearest, similarity
from ..sources.shared import shared_folder


def retrieve(queries: DataFrame, corpus: DataFrame, mentions: DataFrame | None = None, known: DataFrame | None = None, k: int = 50, filters: dict | None = None, profile: Profile = EXAMPLE, embedder=None, metric: str = "l2") -> DataFrame:
    """Four strategies, fused, boosted and diversified; all queries at once.

    queries: query_id, query. corpus: doc_id, source, title, page_type, domain, text, embedding. known: entities (entity_name,
    entity_type, alias) for the graph strategy. embedder: a function from a text column to vectors (features are hashed without one).
    """
    vector = embedder or hashed_embedding
    asked = analyze.analyze(queries, "query", profile)
    asked = asked.withColumns({"v_dense": vector(F.col("expanded_query")), "v_lexical": vector(F.concat_ws(" ", F.array_join("search_keywords", " "), F.array_join("departments", " "))), "v_plain": vector(F.col("query"))})
    # Every strategy reads the analysed queries; they are written, so that they are worked out once.
    folder = shared_folder(corpus.sparkSession, "asked")
    asked.write.parquet(folder)
    asked = corpus.sparkSession.read.schema(asked.schema).parquet(folder)
    base = filtered(corpus, filters)
    named = lambda found, strategy: found.select("query_id", "doc_id", "distance", "rank", F.lit(strategy).alias("strategy"))
    typed = asked.where(F.size("target_page_types") > 0)
    free = asked.where(F.size("target_page_types") == 0)
    near = nearest(typed, base, min(30, k), metric, query_vector="v_plain", match=("target_page_types", "page_type")).unionByName(nearest(free, base, min(30, k), metric, query_vector="v_plain"))
    found = named(nearest(asked, base, k, metric, query_vector="v_dense"), "dense").unionByName(named(nearest(asked, base, min(50, k), metric, query_vector="v_lexical"), "lexical")).unionByName(named(near, "targeted"))
    # Ids, ranks and what boosts look at are fused; titles, texts and embeddings join the k hits that are left.
    light = base.select("doc_id", "source", "page_type", "domain", fuse.document_key(F.col("source"), F.lit(None).cast("string"), F.col("text")).alias("doc_key"))
    info = asked.select("query_id", "query", "departments", "is_list_query", "is_faculty_query")
    hits = found.join(light, "doc_id").join(info.select("query_id", "query"), "query_id")
    boost = F.when(F.col("strategy") == "targeted", fuse.url_boost(F.col("source"), F.col("query"), profile)).otherwise(1.0)
    hits = hits.withColumn("score", similarity(F.col("distance")) * boost).drop("query")
    if known is not None:
        found = graph.search(asked, mentions, known).select("query_id", F.lit("graph").alias("strategy"), "rank", "source", F.lit("entity").alias("page_type"), F.col("text").alias("graph_text"), "score")
        found = found.withColumn("doc_key", fuse.document_key(F.col("source"), F.lit(None).cast("string"), F.col("graph_text")))
        hits = hits.unionByName(found, allowMissingColumns=True)
    else:
        hits = hits.withColumn("graph_text", F.lit(None).cast("string"))
    fused = fuse.reciprocal_rank(hits, "doc_key", 2 * k, ["doc_id", "source", "page_type", "domain", "graph_text", "score"])
    fused = fused.join(info, "query_id").withColumn("matches_dept", fuse.department_match(F.col("departments"), F.col("domain"), F.col("source")))
    best = fuse.diversified(fuse.intelligence_boost(fused), k).withColumn("rank", F.col("div_rank"))
    out = best.join(base.select("doc_id", "title", "text", "embedding"), "doc_id", "left")
    return out.withColumn("text", F.coalesce("graph_text", "text")).drop("doc_id", "graph_text")


def explained(hits: DataFrame) -> DataFrame:
    """query_id, debug: of retrieved hits, their number, the number that each strategy found, how many were found by several, the best scores and sources."""
    best = F.slice(F.array_sort(F.collect_list(F.struct("rank", "source", "final_score", "matched_strategies"))), 1, 5)
    each = F.flatten(F.collect_list(F.array_distinct("matched_strategies")))
    out = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), each.alias("s"), F.count_if(F.col("n_distinct_strategies") > 1).alias("by_several"), best.alias("best"))
    counts = F.transform(F.array_sort(F.array_distinct("s")), lambda x: F.struct(x.alias("strategy"), F.size(F.filter("s", lambda y: y == x)).alias("hits")))
    return out.select("query_id", F.struct("hits", counts.alias("strategies"), "by_several", "best").alias("debug"))


def ask(queries: DataFrame, corpus: DataFrame, mentions: DataFrame | None = None, known: DataFrame | None = None, history: DataFrame | None = None, k: int = 50, filters: dict | None = None, scorer=None, generate=None, profile: Profile = EXAMPLE, embedder=None, debug: bool = False) -> DataFrame:
    """query_id, query, answer, context, sources, and debug if asked for: retrieval, reranking, context and an answer (extractive without a generator).

    history (query_id, history_size, last_question) resolves references. generate: a function of the prompt struct's columns.
    """
    q = queries
    if history is not None:
        q = q.join(history, "query_id", "left").withColumn("query", analyze.resolved(F.col("query"), F.coalesce("history_size", F.lit(0)), F.coalesce("last_question", F.lit("")))).select(*queries.columns)
    q = q.withColumn("query", analyze.expand_acronyms(F.col("query"), profile))
    # Reranking, sources and debug read the hits; they are written, so that the search runs once.
    folder = shared_folder(corpus.sparkSession, "hits")
    found = retrieve(q, corpus, mentions, known, k, filters, profile, embedder)
    found.write.parquet(folder)
    hits = corpus.sparkSession.read.schema(found.schema).parquet(folder).withColumn("score", F.col("final_score"))
    best = rerank.rerank(hits, k, scorer, profile)
    text = context.enhanced_context(best)
    cited = context.sources(best).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "url", "page_type", "relevance_score"))).alias("sources"))
    out = q.join(text, "query_id", "left").join(cited, "query_id", "left")
    made = context.prompt(F.col("query"), analyze.is_list_query(F.col("query")), F.lit(""), F.coalesce("context", F.lit("")))
    out = out.withColumn("prompt", made).withColumn("answer", generate(F.col("prompt")) if generate else context.extractive_answer(F.col("context")))
    if debug:
        out = out.join(explained(hits), "query_id", "left")
    return out.select("query_id", "query", "answer", "context", "sources", *["debug"] * debug)


#: Questions with their metadata filters, for batches of names, departments or topics.
TEMPLATES = {
    "faculty": ("Tell me about %s, including their research interests and affiliations.", None),
    "faculty_list": ("List all faculty members in the %s department", None),
    "topic": ("What research is being done on %s?", {"page_type": "faculty"}),
    "courses": ("%s", {"page_type": "course"}),
}


def templated(names: DataFrame, kind: str, column: str = "name") -> tuple[DataFrame, dict | None]:
    """(queries, filters) from rows with query_id and a name; an empty department asks for all faculty members."""
    pattern, filters = TEMPLATES[kind]
    question = F.format_string(pattern, F.col(column))
    if kind == "faculty_list":
        question = F.when(F.coalesce(column, F.lit("")) == "", "List all faculty members").otherwise(question)
    return names.select("query_id", question.alias("query")), filters


#: Columns of processed pages that chunks, embeddings and mentions are made from.
READ_COLUMNS = ("page_id", "url", "domain", "page_type", "title", "cleaned_text", "drop_reason")


def ingest(raw: DataFrame, dim: int = 64, embedder=None, path: str | None = None, columns: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """From raw pages: page rows, dropped pages, chunks with embeddings, mentions; all, kept and dropped, for callers to unpersist.

    Pages are processed once: written under ``path`` and read back, or kept by persist() where no path is given. Without
    that border the optimizer would work out a page's text again in every expression that is made from it. ``columns``: what is asked of page rows
    (READ_COLUMNS at least), where not all is; the border keeps the optimizer from finding that out.
    """
    every = pages.process(raw)
    every = every.select(*columns) if columns else every
    if path:
        every.write.mode("overwrite").parquet(f"{path}/pages")
        every = raw.sparkSession.read.parquet(f"{path}/pages")
    else:
        every = every.persist()
    kept = every.where("drop_reason IS NULL")
    cut = chunks(kept, ["page_id", "url", "domain", "page_type", "title"], "cleaned_text")
    cut = embed(cut.withColumn("chunk_key", F.concat("page_id", F.lit("_"), F.col("chunk_id").cast("string"))), "text", embedder, dim)
    named = kept.select("page_id", entities.page_entities(F.col("cleaned_text"), F.col("url"), F.col("title")).alias("entities"))
    return {"all": every, "pages": kept, "dropped": every.where("drop_reason IS NOT NULL"), "chunks": cut, "mentions": entities.mentions(named)}


def ranked(df: DataFrame, score: Column, tie: str, k: int | None = None) -> DataFrame:
    out = df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), tie)))
    return out.where(F.col("rank") <= k) if k else out
